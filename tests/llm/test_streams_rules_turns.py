"""Phrase collocations, URL rules and conversation repair against brute force, on odd rows too."""

import hashlib
import itertools
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelyard.llm import count_streams, turn_repair, url_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases -------------------------------------------------------------------

def phrases_by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    often = {k: a for k, a in f.items() if a >= least}
    inside = defaultdict(int)
    for (lang, words), a in often.items():
        for i, j in itertools.combinations(range(len(words) + 1), 2):
            if j - i < len(words):
                inside[lang, words[i:j]] = max(inside[lang, words[i:j]], a)
    found = defaultdict(list)
    for (lang, words), a in often.items():
        if len(words) < 2 or 100 * inside[lang, words] >= 100 * a:
            continue
        score, _, left, right = min(
            (1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))
        )
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, held in found.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(held)[:top], 1)
    }


def odd_texts():
    rng = np.random.default_rng(7)
    words = ["New", "York", "new", "ñandú", "日本", "a\x01", "a", "\x00", "B-C", "\u00a0x", "the", "of"]
    rows = [("en", None), (None, ""), ("en", " \t\n\r"), (None, "one"), ("xx", "...;:!?\x0b\x0c")]
    rows += [(["en", "en", None, "und", "de"][i % 5], " ".join(rng.choice(words, rng.integers(1, 40))) + "." * (i % 3)) for i in range(150)]
    rows += [("de", "san  francisco\tbay, area\nsan francisco bay")] * 9
    rows += [("en", "the " * 3000 + "end")]
    return rows


@pytest.mark.parametrize("least, top", [(2, 1000), (7, 20), (100, 5)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(count_streams, "SLICE", 257)  # pieces then cross slices
    rows = odd_texts()
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, words string").repartition(3)
    got = count_streams.collocations(docs, count_streams.Mining(least=least, top=top)).collect()
    want = phrases_by_hand(rows, least, top)
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_phrases_of_nothing(spark):
    assert count_streams.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert count_streams.collocations(spark.createDataFrame([(None, None), ("a", "")], "lang string, text string")).count() == 0


def test_a_full_filter_only_ships_more(spark, monkeypatch):
    monkeypatch.setattr(count_streams, "STRETCH_BITS", 8)
    monkeypatch.setattr(count_streams, "LARGEST_BITS", 8)
    rows = odd_texts()
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = count_streams.collocations(docs, count_streams.Mining(least=7, top=50)).collect()
    assert {tuple(r) for r in got} == phrases_by_hand(rows, 7, 50)


# --- URLs ----------------------------------------------------------------------

ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://COM/", "http://com", "http://com/x", "http://a.COM?q=://net/es/", "x://net/es/", "x://a.net/es", "x://net/ES/",
    "x://evilexample.com/en/", "x://example.com/en/a#b", "x://www.example.com/en/", "x://a.www.example.com/en/?x", "x://com:80/", "x://u@net/fr/",
    "x://É.com/é/É", "x://net/fr/\n/en", "a://b://c", "x://net./es/", "x://" + "a/" * 30000, "x:///path", "x://h#/f", "x://net/es/", "x://net/es/",
]


def rule_by_hand(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    tail = rest[len(host) + len(path):]
    host = host.translate(LOWER)
    fits = [(len(d + s), d + s, v) for v, d, s in url_rules.LISTED if (host == d or host.endswith("." + d)) and path.startswith(s)]
    tokens = {m + w for m, said in (("h:", host), ("p:", path), ("q:", tail)) for w in re.findall("[a-z0-9\x80-\U0010ffff]+", said.translate(LOWER))}
    return host, path, max(fits)[1:] if fits else None, tokens


def judged_by_hand(urls, mining):
    seen = [rule_by_hand(u) for u in urls]
    labelled = [(tokens, rule[1]) for _, _, rule, tokens in seen if rule]
    least = max(mining.least, -int(-mining.support * len(labelled) // 1))
    often = {t for t, n in Counter(t for tokens, _ in labelled for t in tokens).items() if n >= least}
    whole, mine = Counter(), Counter()
    for tokens, verdict in labelled:
        for size in range(1, mining.tokens + 1):
            for held in itertools.combinations(sorted(tokens & often), size):
                whole[held] += 1
                mine[held, verdict] += 1
    rules = {k: (n / whole[k[0]], n) for k, n in mine.items() if n >= least and n / whole[k[0]] >= mining.confidence}
    rules = {
        (held, v): x for (held, v), x in rules.items()
        if not any((part, v) in rules and rules[part, v][0] >= x[0] for size in range(1, len(held)) for part in itertools.combinations(held, size))
    }
    out = Counter()
    for host, path, rule, tokens in seen:
        best = min(((-c, -n, -len(held), v, held) for (held, v), (c, n) in rules.items() if set(held) <= tokens), default=None)
        verdict = rule[1] if rule else best[3] if best else mining.default
        out[host, path, rule and rule[0], verdict, None if rule or not best else " ".join(best[4])] += 1
    return out


def test_urls_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    hosts = ["a.com", "www.example.com", "example.com", "b.net", "casino.net", "casino.org", "x.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.integers(9)}{rng.choice(['', '.html', '?ref=x', '#top'])}" for _ in range(400)] + ODD_URLS
    pages = spark.createDataFrame([(i // 2 if i % 7 else None, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, verdict string, tokens int").repartition(3)
    mining = url_rules.Mining(support=0.02, least=3, confidence=0.6)
    got = url_rules.judge(pages, mining=mining).collect()
    assert Counter((r.host, r.path, r.rule, r.verdict, r.mined) for r in got) == judged_by_hand(urls, mining)
    assert Counter(r.page_id for r in got) == Counter(i // 2 if i % 7 else None for i in range(len(urls)))
    assert any(r.mined for r in got)


def test_long_urls_are_mined_in_blocks(spark):
    """Forty tokens that always come together give no 2^40 combinations, and all of them are still looked at."""
    many = [(i, "http://a.net/es/" + "/".join(f"t{k}" for k in range(40))) for i in range(30)] + [(100 + i, f"http://b.com/ok/{i}") for i in range(30)]
    pages = spark.createDataFrame(many + [(1000, "http://x.org/t39"), (1001, "http://x.org/ok")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_rules.judge(pages).collect()}
    assert got[1000] == ("block", "p:t39") and got[1001][0] == "allow"


def test_urls_of_nothing_and_without_labels(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    got = url_rules.judge(spark.createDataFrame([(1, None), (1, "x://y.org/a")], "page_id long, url string")).collect()
    assert [(r.verdict, r.rule, r.mined) for r in got] == [("allow", None, None)] * 2


# --- conversations ----------------------------------------------------------------

def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def repaired_by_hand(held):
    """The answer for one conversation, by trying all edits at each turn and keeping whole audits."""
    held = sorted(held, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in held:
        bare = text.strip("\x20\t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state):
        """(cost, audit, lines) of the rest, from a state: '' nothing yet, or the initial before."""
        wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        role = {"u": "user", "a": "assistant"}[wanted]
        ways = []
        if i == len(held):
            if state in ("", "a"):
                return 0, "", ()
            cost, audit, lines = best(i, wanted)
            return cost + 2, "I" + audit, (f"{role}:",) + lines
        for inserts in (1, 2):
            chain, now = [], state
            for _ in range(inserts):
                now = {"": "u", "s": "u", "u": "a", "a": "u"}[now]
                chain.append({"u": "user:", "a": "assistant:"}[now])
            cost, audit, lines = turn(i, now)
            ways.append((cost + 2 * inserts, "I" * inserts + audit, tuple(chain) + lines))
        ways.append(turn(i, state))
        return min(ways)

    def turn(i, state):
        _, _, role, text = held[i]
        wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        late = faults[i] == "truncated"
        cost, audit, lines = best(i + 1, state)
        ways = [(cost + 3, "D" + audit, lines)]
        if faults[i] not in ("blank", "duplicate"):
            if role[:1] == wanted or (state == "" and role[:1] == "s"):
                cost, audit, lines = best(i + 1, role[:1])
                ways.append((cost + late, "K" + audit, (f"{role}:{text}",) + lines))
            cost, audit, lines = best(i + 1, wanted)
            ways.append((cost + 2 + late, "R" + audit, ({"u": "user", "a": "assistant"}[wanted] + ":" + text,) + lines))
        return min(ways)

    sys.setrecursionlimit(20_000)
    cost, audit, lines = best(0, "")
    turns = {r[1] for r in held if r[1] is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = Counter(faults)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), lines


def odd_conversations():
    rng = np.random.default_rng(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ünknown"]
    texts = ["Hi.", "What?", "cut off", "", " \t\n", None, "Ünicode!", "same.", "same.", "x" * 50000 + ".", "end. \n"]
    rows = []
    for conv in [None, *range(60)]:
        for i in range(int(rng.integers(1, 9))):
            turn = None if rng.random() < 0.1 else int(rng.choice([i, i, i, i * 2, 3]))
            rows.append((conv, turn, roles[int(rng.choice(8, p=[.3, .3, .1, .06, .06, .06, .06, .06]))], texts[int(rng.integers(len(texts)))]))
    return rows + rows[:6] + [(1000, t, r, "fine.") for t, r in enumerate(["user", "assistant"] * 40)]


def by_conversation(rows, every):
    held = {c: [] for c in every}
    for r in rows:
        held[r[0]].append(r)
    return held


@pytest.mark.parametrize("spill", [8, 1 << 20])
def test_repair_equals_brute_force(spark, spill):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "conv_id long, turn long, role string, text string, conv string, at int, known boolean").repartition(4)
    damaged = turn_repair.damage(table)
    held = by_conversation(damaged_by_hand(rows), {r[0] for r in rows})
    want = {c: repaired_by_hand(h) for c, h in held.items()}
    reports = turn_repair.repair(damaged, spill=spill)
    got = {r.conv_id: tuple(r)[1:] for r in reports.collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    if spill > 8:
        lines = defaultdict(list)
        for r in turn_repair.repaired_turns(damaged, reports).orderBy("position").collect():
            lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert {c: list(said) for c, (_, said) in want.items() if said} == dict(lines)


def test_a_conversation_crosses_batches(spark, monkeypatch):
    """A conversation of many Arrow batches whose backpointers are spilled; and one all of whose rows are gone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(1, i, ["user", "assistant", "user"][i % 3], f"{i}.") for i in range(400)] + [(2, 0, "user", "x")]
        table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("gone", F.col("conv_id") == 2)
        got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(table, spill=64).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: repaired_by_hand(rows[:400])[0], 2: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert turn_repair.repair(turn_repair.damage(empty)).count() == 0


def test_rules_whose_tokens_stand_far_apart_in_long_urls(spark):
    """Combinations over more tokens than a block, and their confidence over short and long URLs together."""
    import itertools

    rows = []
    for i in range(30):
        words = [f"p:w{j:02}" for j in range(14) if (i * 7 + j * j) % 5] if i % 3 else [f"p:w{j:02}" for j in (i % 14, (i + 9) % 14)]
        rows.append((words, "block" if "p:w01" in words and "p:w12" in words else "allow"))
    mining = url_rules.Mining(support=0.1, least=3, confidence=0.8, tokens=3, block=4)
    got = {(tuple(r.antecedent), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), mining).collect()}
    rules = {}
    for size in (1, 2, 3):
        for part in itertools.combinations(sorted({w for ws, _ in rows for w in ws}), size):
            said = [v for ws, v in rows if set(part) <= set(ws)]
            for verdict in ("allow", "block"):
                n = said.count(verdict)
                if n >= 3 and n / len(said) >= 0.8:
                    rules[part, verdict] = (round(n / len(said), 9), round(n / 30, 9))
    best = {
        key: value for key, value in rules.items()
        if not any(rules.get((part, key[1]), (0, 0))[0] >= value[0] for size in range(1, len(key[0])) for part in itertools.combinations(key[0], size))
    }
    assert got == best and any(len(part) > 1 for part, _ in best)
