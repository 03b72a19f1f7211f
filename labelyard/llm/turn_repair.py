"""Repair of conversation structure as a streamed edit distance.

Turns are shuffled by conversation and sorted within the task. A task reads them as a stream of
Arrow batches and carries, across batches, the cheapest way into each state of the grammar
``(s?(ua)+)?`` over role initials, together with a running digest of the repaired text on that way.
Only four bytes of backpointers are kept per turn; those of a giant conversation are spilled to an
anonymous file of the task, which a retried task writes again. No conversation is held whole.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: White space: a text of nothing else is blank.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of the edits and of a turn that stays without a full stop.
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind an initial that may come next, and the state behind the user or assistant turn that may.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WRITTEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that end a conversation in each state.
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: A way that costs this much more than the cheapest one can't be part of the answer: from any state
#: two inserts lead to any later state, and a system turn kept by the other way can be deleted.
HOPELESS = 2 * INSERT + DELETE
FAR = 1 << 30
#: Edits at one turn, in the numbering of backpointers: inserts before it, then what happens to it.
EDITS = [i * "I" + last for i in range(3) for last in "DKR"]
SPILL_BYTES = 4 << 20

REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(turns: DataFrame) -> DataFrame:
    """Damage turns by crc32 of ``conv_id:turn`` modulo 20; a null id or turn counts as one space there.

    0 marks the turn as gone, 1 empties the text, 2 removes its ``.!?``, 3 repeats the turn, 4 makes
    the role ``user``. A null role or text is one space. Returns conv_id, turn, role, text, gone.
    """
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(said) % 20
    text = F.coalesce("text", F.lit(" "))
    damaged = turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return damaged.drop("copy")


def _stream(turns: DataFrame) -> DataFrame:
    """Turns with their order and faults: conv, known, at, role, text, blank, truncated, seen, gone.

    ``seen`` says that the same role and text stand at an earlier turn; the stream itself sees equal
    rows of one turn, as they are neighbours. Earlier turns are looked up by a 128-bit digest, so a
    conversation of any size is no group of its own here.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.when(~gone, F.coalesce("role", F.lit(" "))).alias("role"), F.when(~gone, F.coalesce("text", F.lit(" "))).alias("text"),
        gone.alias("gone"),
    )
    stripped = F.rtrim(F.col("text"), F.lit(BLANK))
    rows = rows.withColumns({
        "blank": F.coalesce(stripped == "", F.lit(False)),
        "truncated": F.coalesce((stripped != "") & ~F.right(stripped, F.lit(1)).isin(".", "!", "?"), F.lit(False)),
        "digest": _digest(F.col("conv"), F.col("role"), F.col("text")),
        "order": F.struct("known", "at"),
    })
    repeated = (
        rows.filter("not gone").groupBy("digest").agg(F.min("order").alias("first"), F.max("order").alias("last"))
        .filter(F.col("first") < F.col("last")).select("digest", "first")
    )
    joined = rows.join(repeated, "digest", "left")
    seen = F.coalesce(F.col("order") > F.col("first"), F.lit(False))
    return joined.select("conv", "known", "at", "role", "text", "blank", "truncated", seen.alias("seen"), "gone")


def _digest(*parts: Column) -> Column:
    """A 128-bit digest of strings and nulls, with their lengths, so that their borders count."""
    return F.md5(F.concat(*(F.concat(F.coalesce(F.length(p).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts)))


def step(costs: tuple, ranks: tuple, initial: str, forced: bool, truncated: bool) -> tuple:
    """One turn of the distance.

    ``costs`` are those of the cheapest way into each state, less the least of them; ``ranks`` order
    the ways by their audits. Audits of ways over the same turns never are prefixes of each other,
    because inserts are written before the turn they precede, so what follows can't change that order.
    Returns what the least cost grew by, the new costs and ranks, and for each state (state before,
    number of the edit) or None.
    """
    ways: list[list[tuple]] = [[] for _ in range(4)]
    for before in range(4):
        if costs[before] >= FAR:
            continue
        state = before
        for inserts in range(3):
            spent = costs[before] + inserts * INSERT
            ways[state].append((spent + DELETE, ranks[before], inserts * "I" + "D", before))
            if not forced:
                late = CUT_SHORT * truncated
                if initial in NEXT[state]:
                    ways[NEXT[state][initial]].append((spent + late, ranks[before], inserts * "I" + "K", before))
                ways[WRITTEN[state]].append((spent + late + REROLE, ranks[before], inserts * "I" + "R", before))
            state = WRITTEN[state]
    best = [min(w) if w else None for w in ways]
    least = min(w[0] for w in best if w)
    best = [w if w and w[0] - least <= HOPELESS else None for w in best]
    order = sorted((w[1], w[2], state) for state, w in enumerate(best) if w)
    rank = {state: place for place, (*_, state) in enumerate(order)}
    return (
        least, tuple(w[0] - least if w else FAR for w in best), tuple(rank.get(s, 0) for s in range(4)),
        [(w[3], EDITS.index(w[2])) if w else None for w in best],
    )


class Backpointers:
    """Four bytes per turn, in memory up to ``SPILL_BYTES`` and behind that in an anonymous file."""

    def __init__(self, most: int = SPILL_BYTES):
        self.most, self.held, self.file, self.turns = most, bytearray(), None, 0

    def add(self, four: bytes) -> None:
        self.held += four
        self.turns += 1
        if len(self.held) >= self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held = bytearray()

    def backwards(self) -> Iterator[bytes]:
        """Stretches of whole turns, last first."""
        yield bytes(self.held)
        end = self.file.tell() if self.file else 0
        while end:
            size = min(end, max(4, self.most // 4 * 4))
            end -= size
            self.file.seek(end)
            yield self.file.read(size)

    def audit(self, state: int) -> str:
        """The initials of all edits on the way into ``state``."""
        out, reverse = bytearray(), [e[::-1].encode() for e in EDITS]
        for part in self.backwards():
            for at in range(len(part) - 4, -1, -4):
                packed = part[at + state]
                out += reverse[packed & 15]
                state = packed >> 4
        if self.file:
            self.file.close()
        out.reverse()
        return out.decode()


class Conversation:
    """The state carried for the conversation that is being read."""

    def __init__(self, conv: str | None, memo: dict, spill: int):
        self.conv, self.memo, self.back = conv, memo, Backpointers(spill)
        self.costs, self.ranks, self.base = (0, FAR, FAR, FAR), (0, 0, 0, 0), 0
        self.digests = [hashlib.sha256(), None, None, None]
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before, self.span, self.distinct = None, None, 0

    def add(self, known: bool, at: int, role: str, text: str, blank: bool, truncated: bool, seen: bool) -> None:
        if known:
            if self.span is None or at != self.span[1]:
                self.distinct += 1
            self.span = (at if self.span is None else self.span[0], at)
        place = (known, at, role, text)
        duplicate = not blank and (seen or place == self.before)
        truncated = truncated and not duplicate
        for name, holds in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[name] += holds
        if self.before is not None and self.before[2][:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = place
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        key = (self.costs, self.ranks, initial, blank or duplicate, truncated)
        known_step = self.memo.get(key)
        if known_step is None:
            grown, costs, ranks, ways = step(*key)
            packed = bytes((w[0] << 4 | w[1]) if w else 0 for w in ways)
            known_step = self.memo[key] = grown, costs, ranks, ways, packed
        grown, self.costs, self.ranks, ways, packed = known_step
        self.base += grown
        self.back.add(packed)
        kept, said = f"{role}:{text}".encode(), text.encode()
        digests: list = [None] * 4
        for state, way in enumerate(ways):
            if way:
                digests[state] = self.digests[way[0]].copy()
                written = _written(way[0], EDITS[way[1]], kept, said)
                if written:
                    digests[state].update(written)
        self.digests = digests

    def report(self) -> tuple:
        cost, _, state = min((c + CLOSING[s] * INSERT, self.ranks[s], s) for s, c in enumerate(self.costs) if c < FAR)
        digest = self.digests[state]
        if CLOSING[state]:
            digest.update(_written(state, CLOSING[state] * "I", b"", b""))
        gaps = self.span[1] - self.span[0] + 1 - self.distinct if self.span else 0
        audit = self.back.audit(state) + CLOSING[state] * "I"
        return (self.conv, gaps, *self.counts.values(), self.base + cost, audit, digest.hexdigest())


def _written(state: int, edit: str, kept: bytes, said: bytes) -> bytes:
    """What an edit adds to the repaired text: lines, each behind a newline if one is there before it."""
    out = b""
    for letter in edit:
        if letter == "D":
            continue
        line = kept if letter == "K" else ROLES[WRITTEN[state]].encode() + b":" + (said if letter == "R" else b"")
        out += line if state == START else b"\n" + line
        # a kept system turn is the only way out of the start that is not a written turn
        state = NEXT[state].get(chr(kept[0]), WRITTEN[state]) if letter == "K" else WRITTEN[state]
    return out


def repair(turns: DataFrame, spill: int = SPILL_BYTES) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` needs conv_id, turn, role and text; rows whose column ``gone`` is true only tell that
    the conversation exists. Turns are taken by number, those without one first, equal numbers by role
    and text. Blank turns (nothing but white space) and turns whose role and text were seen earlier
    are deleted (3); others are kept (0), given the role user or assistant (2) or deleted; turns of
    user or assistant without text may be inserted anywhere (2). A turn that stays without ``.!?`` at
    its end adds 1. The audit has the initials of the cheapest edits that make the role initials
    ``(s?(ua)+)?``, the ASCII-least one of equals; the digest is that of the repaired ``role:text``
    lines. A null conv_id is a conversation, a null role or text is one space, an unknown or empty role
    is never kept. A conversation without turns has zeros, an empty audit and the digest of nothing.
    Repeated rows are repeated turns; an empty table gives no rows; further columns are left out.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        current: Conversation | None = None
        names = [c.split()[0] for c in REPORT.split(", ")]
        for batch in batches:
            done = []
            columns = (batch[c].tolist() for c in ("conv", "known", "at", "role", "text", "blank", "truncated", "seen", "gone"))
            for conv, known, at, role, text, blank, truncated, seen, gone in zip(*columns):
                conv = conv if isinstance(conv, str) else None
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.report())
                    current = Conversation(conv, memo, spill)
                if not gone:
                    current.add(known, at, role, text, blank, truncated, seen)
            if done:
                yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([current.report()], columns=names)

    sorted_rows = _stream(turns).repartition("conv").sortWithinPartitions("conv", "known", "at", "role", "text")
    kind = turns.schema["conv_id"].dataType
    return sorted_rows.mapInPandas(read, REPORT).select(F.col("conv").cast(kind).alias("conv_id"), *(c.split()[0] for c in REPORT.split(", ")[1:]))


def repaired_turns(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, edit: the conversations as the reports of ``repair`` say.

    The audit of a conversation is sorted before its turns and steers them as they stream by.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, audit, at, state, position = None, "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []
            for name, kind, steering, role, text in zip(*(batch[c].tolist() for c in ("conv", "kind", "audit", "role", "text"))):
                if kind == 0:
                    conv, audit, at, state, position = (name if isinstance(name, str) else None), steering, 0, START, 0
                    continue
                while at < len(audit):  # inserts, then what happens to this turn; only inserts are left behind the last one
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        now = role if letter == "K" else ROLES[WRITTEN[state]]
                        out.append((conv, position, now, "" if letter == "I" else text, letter))
                        position += 1
                        state = NEXT[state][now[:1]]
                    if letter != "I":
                        break
            yield pd.DataFrame(out, columns=["conv", "position", "role", "text", "edit"])

    rows = _stream(turns).filter("not gone").select("conv", F.lit(1).alias("kind"), F.lit("").alias("audit"), "known", "at", "role", "text")
    ends = reports.select(
        F.col("conv_id").cast("string").alias("conv"), F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"), "audit",
        F.lit(True).alias("known"), F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"),
    )
    ends = ends.withColumn("audit", F.when(F.col("kind") == 0, F.col("audit")).otherwise(""))
    stream = rows.unionByName(ends).repartition("conv").sortWithinPartitions("conv", "kind", "known", "at", "role", "text")
    kind = turns.schema["conv_id"].dataType
    return stream.mapInPandas(read, "conv string, position long, role string, text string, edit string").select(
        F.col("conv").cast(kind).alias("conv_id"), "position", "role", "text", "edit"
    )
