"""Secret spans: base patterns, and a linear-chain conditional random field that adds to them.

Tokens are tagged as begin, inside or outside of a secret from their shape, the words beside them and
features of the file. The field is trained on windows around base matches of a bounded sample, and on
rewritten ones: other separators, key words or none, values in upper case, cut short, of other alphabets or
with marks in them. So it finds secrets that the patterns miss and the rest of values that they cut short.
Decoding is by Viterbi; a text that cannot hold a span by the scores of its tokens is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from labelyard.llm.shingles import byte_hashes, raw
from labelyard.llm.workers import batches_of_texts
from labelyard.sizing import materialise

# --- fixed values: base patterns and the least length of what they must hold --------------------
BASE = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
# ------------------------------------------------------------------------------------------------
ADDED = "crf"
KINDS = {name: at for at, name in enumerate([*(name for name, *_ in BASE), ADDED])}
#: Long runs are looked for first, as most texts hold none.
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: Parts of the key words of "assign", and the letters beyond A-Z that match one of theirs in either case.
_KEY_PARTS, _OTHER_CASE = ("passw", "secret", "token", "api"), ("\u017f", "\u0130", "\u0131")

O, B, I = range(3)
#: Training: the most documents with and without a base match, windows of one document, tokens to each
#: side, characters of a token, words known by themselves, rewritten windows, steps of the fit and of a first one, rate and decay.
SAMPLE_DOCS, WINDOWS, AROUND, TOKEN_CHARS, KNOWN_WORDS, MADE = 400, 4, 12, 256, 20_000, 1_500
STEPS, FIRST_STEPS, RATE, DECAY = 100, 15, 0.5, 2e-3
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: Marks that may stand around a value, and what rewriting uses: words before a value, separators, marks inside.
MARKS = "\"'`([{<>}]),;.!?#*$%&|"
KEY_WORDS = ["password", "passwd", "secret", "token", "api_key", "pwd", "passphrase", "credential", "bearer", "authorization"]
SEPARATORS = ["=", ":", "->", "=>", "is", ":=", ""]
INNER_MARKS = "!#$%^&*~"
#: Tokens that look like values to a careless eye and are none.
HARMLESS = [
    "2024-01-31", "4785380592391139", "192.168.0.1", "some.12@mail2.example.com", "https://www.example.com/en/825?page=2", "+49-151-1234567",
    "v1.2.3-rc1", "978-3-16-148410-0", "3.14159", "(555)-0100", "12:45:30", "1,000,000", "README.md", "snake_case_name", "someCamelCase",
]


def _may_assign(text: str) -> bool:
    """False only for texts in which "assign" cannot match."""
    if ":" not in text and "=" not in text:
        return False
    low = text.lower()
    return any(part in low for part in _KEY_PARTS) or any(c in text for c in _OTHER_CASE)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of base matches in code points, by start and then as kinds are listed."""
    spans = []
    for kind, pattern, group, least in BASE:
        if kind == "access" and "AKIA" not in text or kind == "hex" and not _LONG_HEX.search(text) or kind == "assign" and not _may_assign(text):
            continue
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(spans, key=lambda s: (s[0], KINDS[s[1]], s[2]))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


# --- features --------------------------------------------------------------------------------------

#: Families of a token's own features and their sizes: length with digits, length with case and marks, length
#: with changes of kind, alphabet, marks that assign or address with the first kind. Then the file's size and marks of code.
FAMILIES = (8 * 9, 8 * 25, 8 * 9, 8, 8 * 5)
FILE_FAMILIES = (17, 5)
OWN = sum(FAMILIES)
_OFFSETS = np.cumsum((0, *FAMILIES))[:-1]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte (lower, upper, digit, mark, other script), and whether it may stand around a value."""
    kind = np.full(256, 3, np.int8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 4
    around = np.zeros(256, bool)
    around[list(MARKS.encode())] = True
    return kind, around


def looks(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own features (places in the weights, a column per family) and a word hash of each token in ``data``."""
    kinds, around = _tables()
    starts, stops = starts.copy(), stops.copy()
    padded = np.append(data, np.uint8(0))
    for _ in range(8):
        starts += (starts < stops) & around[padded[starts]]
    for _ in range(8):
        stops -= (starts < stops) & around[padded[stops - 1]]
    kind = kinds[data]
    size = stops - starts
    n = np.maximum(size, 1)

    def within(marked: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        return total[stops] - total[starts]

    lower, upper, digit, mark = (within(kind == k) for k in range(4))
    changed = np.zeros(len(data) + 1, bool)
    changed[1:-1] = kind[1:] != kind[:-1]
    total = np.concatenate([[0], np.cumsum(changed, dtype=np.int64)])
    changes = np.maximum(total[np.maximum(stops, 1)] - total[np.minimum(starts + 1, len(data))], 0)
    hexa = within((kind == 2) | (data >= 97) & (data <= 102) | (data >= 65) & (data <= 70))
    length = np.minimum(np.floor(np.log2(n)).astype(np.int64) + (size > 0), 7)
    mixed_case = (lower > 0).astype(int) + (upper > 0) + (digit > 0)
    alphabet = np.select(
        [size < 6, (hexa == size) & (digit > 0) & (digit < size) & (size >= 16), (hexa == size) & (digit > 0) & (digit < size), digit == size,
         (mixed_case == 3) & (size >= 10), (digit > 0) & (mixed_case == 2) & (size >= 10), (mark > 0) & (digit > 0)],
        [0, 1, 2, 3, 4, 5, 6], 7,
    )
    equals, colon, address = (within(data == ord(c)) > 0 for c in "=:@")
    first = np.where(size > 0, kinds[padded[starts]], 3)
    own = np.stack([
        length * 9 + 8 * digit // n, length * 25 + 5 * (4 * upper // n) + 4 * mark // n, length * 9 + np.minimum(8 * changes // n, 8),
        alphabet, (4 * address + 2 * equals + colon) * 5 + first,
    ], axis=1)
    return own + _OFFSETS, byte_hashes(data, starts, stops)


def file_features(text: str) -> list[int]:
    """Size of the text and how many marks of code it has, as places among the file's features."""
    coded = sum(mark in text for mark in ("=", "{", "://", "();"))
    return [min(len(text).bit_length(), FILE_FAMILIES[0] - 1), FILE_FAMILIES[0] + coded]


N_FILE = len(FILE_FAMILIES)


# --- the field -------------------------------------------------------------------------------------

ILLEGAL = -1e4


class Field:
    """weights[feature, tag], moves[tag, tag], start[tag], and the sorted hashes of the words it knows.

    Rows of the weights: a token's own features, the known words before it, those behind it (the
    first row of each is for all others), then features of the file.
    """

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray, words: np.ndarray):
        self.weights, self.moves, self.start, self.words = weights, moves, start, words

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """0 for unknown words, else 1 and more."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def parts(self, own: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of tokens: their own, what each adds to the next one, and to the one before."""
        word = self.places(hashes)
        behind = OWN + len(self.words) + 1
        return self.weights[own].sum(axis=1), self.weights[OWN + word], self.weights[behind + word]

    def file(self, places: list[int]) -> np.ndarray:
        return self.weights[len(self.weights) - sum(FILE_FAMILIES):][places].sum(axis=0)

    def legal(self) -> tuple[np.ndarray, np.ndarray]:
        moves, start = self.moves.copy(), self.start.copy()
        moves[O, I] = start[I] = ILLEGAL
        return moves, start

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of one text; ``scores`` has a row per token."""
        moves, start = self.legal()
        best, back = start + scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, len(scores)):
            step = best[:, None] + moves
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + scores[t]
        tags = np.zeros(len(scores), np.int64)
        tags[-1] = int(best.argmax())
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def slack(self) -> tuple[float, float]:
        """What a span can gain from moves at most: for each token in it, and once."""
        moves, start = self.legal()
        stay = moves[O, O]
        inside = max(moves[B, I], moves[I, I], moves[B, B], moves[I, B]) - stay
        enter = max(moves[O, B] - stay, start[B] - start[O])
        leave = max(moves[B, O], moves[I, O]) - stay
        return max(0.0, inside), enter + max(0.0, leave)


def _forward_backward(field: Field, scores: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag and move probabilities of many padded sequences, [N, L, 3] and [3, 3] summed."""
    moves, start = field.legal()
    n, length, _ = scores.shape
    forward, backward = np.zeros(scores.shape), np.zeros(scores.shape)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    forward[:, 0] = start + scores[:, 0]
    for t in range(1, length):
        new = total(forward[:, t - 1, :, None] + moves, 1) + scores[:, t]
        forward[:, t] = np.where(valid[:, t, None], new, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = total(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(valid[:, t + 1, None], new, 0.0)
    whole = total(forward[:, -1], 1)
    tags = np.exp(np.clip(forward + backward - whole[:, None, None], -60, 0)) * valid[:, :, None]
    pair = forward[:, :-1, :, None] + moves + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    moved = (np.exp(np.clip(pair, -60, 0)) * valid[:, 1:, None, None]).sum(axis=(0, 1))
    return tags, moved, tags[:, 0].sum(axis=0)


Window = tuple[list[str], list[int], list[int]]  # tokens, their tags, file features


def windows(text: str, pick: int) -> list[Window]:
    """Windows around base matches, or one around a token that ``pick`` chooses."""
    spans = [(a, b) for a, kind, b in base_spans(text)]
    found = [m.span() for m in SPACE.finditer(text)]
    tags, before = [], None
    for a, b in found:
        inside = next((s for s in spans if a < s[1] and b > s[0]), None)
        core = text[a:b].strip(MARKS)
        value = inside is not None and len(core) >= 6 and core[-1:] not in ":=" and b >= inside[1]
        tags.append((I if before == inside else B) if value else O)
        before = inside if value else None
    centres = [t for t, tag in enumerate(tags) if tag == B][:WINDOWS] or ([pick % len(found)] if found else [])
    out = []
    for c in centres:
        part = range(max(0, c - AROUND), min(len(found), c + AROUND))
        out.append(([text[a:b][:TOKEN_CHARS] for a, b in found[part.start:part.stop]], tags[part.start:part.stop], file_features(text)))
    return out


def _value(rng: np.random.Generator) -> str:
    """A made-up value of one of several alphabets."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabet = ["0123456789abcdef", "0123456789ABCDEF", letters + letters.upper() + "0123456789", letters + "0123456789", letters + letters.upper() + "0123456789+/_-"][int(rng.integers(5))]
    made = "".join(rng.choice(list(alphabet), int(rng.integers(10, 45))))
    while not any(c.isdigit() for c in made) or made.isdigit():
        made = "".join(rng.choice(list(alphabet), len(made)))
    return made


def rewritten(window: Window, rng: np.random.Generator) -> Window:
    """A window with its values, key words and separators replaced; what was a value still is one."""
    tokens, tags, file_ = window
    out, marks = [], []
    for t, (token, tag) in enumerate(zip(tokens, tags)):
        ahead = tags[t + 1:t + 3]
        if tag == O and B in ahead:  # the key word and the separator go; new ones come with the value
            if ahead[0] == B or token.strip(MARKS) not in ("", "=", ":"):
                continue
        if tag == B:
            value = _value(rng)
            kind = int(rng.integers(4))
            if kind == 0:  # cut short by a mark, where a pattern ends
                at = int(rng.integers(3, len(value) - 2))
                value = value[:at] + str(rng.choice(list(INNER_MARKS))) + value[at:]
            quote = str(rng.choice(["", '"', "'"]))
            key, separator = str(rng.choice(KEY_WORDS)), str(rng.choice(SEPARATORS))
            shown = int(rng.integers(4))
            if shown == 0:  # without any context a value must look like one by itself
                out += [quote + value + quote]
                marks += [B if len(value) >= 16 else O]
            elif shown == 1 and separator in ("=", ":"):
                out += [key + separator + quote + value + quote]
                marks += [B]
            else:
                lead = [x for x in (key, separator) if x]
                out += [*lead, quote + value + quote]
                marks += [*[O] * len(lead), B]
        elif tag == O:
            out.append(token)
            marks.append(O)
    return out, marks, file_


def harmless(window: Window, rng: np.random.Generator) -> Window:
    """A window without values, at times shouted, with long words, key words before ordinary words and
    tokens that only look like values."""
    tokens, _, file_ = window
    style = int(rng.integers(4))
    out = [t.upper() + "!!" if style == 0 else t.title() if style == 1 else t for t in tokens]
    out = ["".join(out[i:i + 2]).replace("!!", "") if out and style < 3 and rng.random() < 0.2 else t for i, t in enumerate(out)]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    name, host = ("".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(2))
    address = f"{name}.{int(rng.integers(1000))}@{host}{int(rng.integers(10))}.example.{str(rng.choice(['com', 'org', 'de']))}"
    for token in (str(rng.choice(HARMLESS)), str(rng.choice(HARMLESS)), address):
        out.insert(int(rng.integers(len(out) + 1)), token)
    word = str(rng.choice(tokens)) if tokens else "value"
    at = int(rng.integers(len(out) + 1))
    out[at:at] = [str(rng.choice(KEY_WORDS)), *[x for x in [str(rng.choice(SEPARATORS))] if x], word]
    return out, [O] * len(out), file_


def train(sample: list[Window]) -> Field:
    """Fit on windows, at least ``MADE`` rewritten ones with values and as many harmless ones.

    Texts without a base match may hold secrets too. A first, short fit looks for them, and windows in which it
    sees one are not taken for windows without values.
    """
    with_values = [w for w in sample if B in w[1]]
    without = [w for w in sample if B not in w[1] and w[0]]
    if not with_values:
        weights = np.zeros((OWN + 2 + sum(FILE_FAMILIES), 3))
        weights[:, O] = 1.0
        return Field(weights, np.zeros((3, 3)), np.zeros(3), np.zeros(0, np.uint64))
    rng = np.random.default_rng(11)
    made = [rewritten(w, rng) for w in with_values for _ in range(max(3, MADE // len(with_values)))]
    first = _fitted([*with_values, *made, *(([t for t in HARMLESS], [O] * len(HARMLESS), w[2]) for w in with_values), *without], FIRST_STEPS)
    seen = tagged(first, pa.array([" ".join(w[0]) for w in without], pa.string())) if without else {}
    without = [w for at, w in enumerate(without) if at not in seen]
    calm = [harmless(w, rng) for w in without for _ in range(max(2, MADE // max(1, len(without))))]
    return _fitted([*with_values, *without, *made, *calm], STEPS)


def _fitted(every: list[Window], steps: int) -> Field:
    """Gradient ascent on the likelihood of the tags of windows, with a rate for each weight."""
    every = [w for w in every if w[0]]
    tokens = pa.array([t for w in every for t in w[0]], pa.large_string())
    own, hashes = looks(*_bytes(tokens))
    # a word is known if it stands in several windows of different documents, key words always
    times = Counter(x for w, h in zip(every, np.split(hashes, np.cumsum([len(w[0]) for w in every])[:-1])) for x in set(h.tolist()))
    words = np.array(sorted(h for h, n in times.most_common(KNOWN_WORDS) if n >= 5), np.uint64)
    field = Field(np.zeros((OWN + 2 * (len(words) + 1) + sum(FILE_FAMILIES), 3)), np.zeros((3, 3)), np.zeros(3), words)
    word = field.places(hashes)
    length = max(len(w[0]) for w in every)
    width = len(FAMILIES) + 2 + N_FILE
    x, gold, valid = np.zeros((len(every), length, width), np.int64), np.zeros((len(every), length), np.int64), np.zeros((len(every), length), bool)
    behind, file_at, at = OWN + len(words) + 1, len(field.weights) - sum(FILE_FAMILIES), 0
    for row, (said, tags, file_) in enumerate(every):
        n = len(said)
        x[row, :n, :len(FAMILIES)] = own[at:at + n]
        x[row, 0, len(FAMILIES)], x[row, 1:n, len(FAMILIES)] = OWN, OWN + word[at:at + n - 1]
        x[row, n - 1, len(FAMILIES) + 1], x[row, :n - 1, len(FAMILIES) + 1] = behind, behind + word[at + 1:at + n]
        x[row, :n, len(FAMILIES) + 2:] = [file_at + f for f in file_]
        gold[row, :n], valid[row, :n] = tags, True
        at += n
    truth = np.eye(3)[gold] * valid[:, :, None]
    pairs = valid[:, 1:].ravel()
    moved_gold = np.zeros((3, 3))
    np.add.at(moved_gold, (gold[:, :-1].ravel()[pairs], gold[:, 1:].ravel()[pairs]), 1)
    squares = [np.full(field.weights.shape, 1e-3), np.full((3, 3), 1e-3), np.full(3, 1e-3)]
    places = x.ravel()
    for _ in range(steps):
        scores = field.weights[x].sum(axis=2)
        tags, moved, first = _forward_backward(field, scores, valid)
        gap = (truth - tags) / len(every)
        grad = np.stack([np.bincount(places, np.repeat(gap[:, :, k].ravel(), width), len(field.weights)) for k in range(3)], axis=1)
        moved_by = (grad - DECAY * field.weights / len(every) ** 0.5, (moved_gold - moved) / len(every), (truth[:, 0].sum(axis=0) - first) / len(every))
        for target, step, square in zip((field.weights, field.moves, field.start), moved_by, squares):
            square += step * step
            target += RATE * step / np.sqrt(square)
    return field


def _bytes(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of tokens, and where each starts and stops."""
    data, bounds = raw(tokens)
    return data, bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)


def tagged(field: Field, texts: pa.Array) -> dict[int, list[tuple[int, int]]]:
    """Decoded spans, in code points, of the texts that have any; keys are places in ``texts``."""
    trimmed = pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null(""))
    lists = pc.ascii_split_whitespace(trimmed)
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return {}
    alone, to_next, to_last = field.parts(*looks(*_bytes(coded.dictionary)))
    row = coded.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    scores, from_left, from_right = alone[row], to_next[row[:-1]], to_last[row[1:]]
    inner = bounds[(bounds > 0) & (bounds < len(row))]
    from_left[inner - 1] = field.weights[OWN]  # nothing crosses from one text to the next
    from_right[inner - 1] = field.weights[OWN + len(field.words) + 1]
    scores[1:] += from_left
    scores[:-1] += from_right
    scores[0] += field.weights[OWN]
    scores[-1] += field.weights[OWN + len(field.words) + 1]
    each, once = field.slack()
    gain = np.maximum(scores[:, B], scores[:, I]) - scores[:, O] + each
    some = np.flatnonzero(np.diff(bounds))
    top = np.maximum.reduceat(gain, bounds[:-1][some])
    # A text is decoded if any token could gain; the file adds at most so much to each.
    file_ = field.weights[len(field.weights) - sum(FILE_FAMILIES):]
    file_ = np.maximum(file_[:, B], file_[:, I]) - file_[:, O]
    at_most = top + sum(max(0.0, float(part.max())) for part in np.split(file_, [FILE_FAMILIES[0]])) + max(0.0, once)
    found: dict[int, list[tuple[int, int]]] = {}
    for at, best in zip(some[at_most > 0].tolist(), top[at_most > 0].tolist()):
        text = texts[at].as_py()
        places = file_features(text)
        if best + float(file_[places].sum()) + max(0.0, once) <= 0:
            continue
        tags = field.viterbi(scores[bounds[at]:bounds[at + 1]] + field.file(places))
        if (tags == B).any():
            found[at] = _spans(text, tags)
    return found


def _spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """From the first to the last token of each run, without the marks around it."""
    places = [m.span() for m in SPACE.finditer(text)]
    spans = []
    for t in np.flatnonzero(tags == B).tolist():
        end = t
        while end + 1 < len(tags) and tags[end + 1] == I:
            end += 1
        spans.append((places[t][0], places[end][1]))
    return [s for s in (_bare(text, a, b) for a, b in spans) if s]


def _bare(text: str, a: int, b: int) -> tuple[int, int] | None:
    """A stretch without marks around it; none without a letter or digit."""
    while a < b and text[a] in MARKS:
        a += 1
    while b > a and text[b - 1] in MARKS:
        b -= 1
    return (a, b) if any(c.isalnum() for c in text[a:b]) else None


def beyond(text: str, span: tuple[int, int], base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What is left of a decoded span outside all base spans."""
    parts, at = [], span[0]
    for start, _, end in base:
        if start < span[1] and end > at:
            parts.append((at, max(at, start)))
            at = end
    parts.append((at, max(at, span[1])))
    return [p for p in (_bare(text, a, b) for a, b in parts) if p]


def sampled(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[Window]:
    """Windows of at most ``most`` documents with a base match and as many without, first by a hash.

    One pass over the texts decides which ones match; the driver then takes hashes, and after a second one only windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = text.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}") | text.rlike(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""")
    order = F.xxhash64(F.lit("secrets"), F.col("doc_id").cast("string"), text)
    marked = materialise(docs.select(order.alias("order"), likely.alias("likely")), "secret-sample")
    first = [marked.filter(F.col("likely") == wanted).select("order").distinct().orderBy("order").limit(most) for wanted in (True, False)]
    chosen = F.broadcast(first[0].union(first[1]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(o, *w) for o, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in windows(text, o & 0x7FFFFFFF)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["order", "tokens", "tags", "file"])

    taken = docs.select(order.alias("order"), text.alias("text")).join(chosen, "order").mapInArrow(
        cut, "order long, tokens array<string>, tags array<int>, file array<int>"
    )
    rows = taken.dropDuplicates().orderBy("order", "tokens").collect()
    return [(r["tokens"], r["tags"], r["file"]) for r in rows]


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans (base and added) of every row.

    Spans are "kind:start:end" in code points, end exclusive, by start and then kind. Of a decoded span
    the parts outside base spans are added, without the marks around them. A null text is empty and
    has no spans; equal rows get equal spans; without any base match in the table the field tags nothing.
    """
    field = train(sampled(docs)) if field is None else field
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves, field.start, field.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            for some in batches_of_texts(batch, 1):
                added = tagged(own, some.column(1))
                counts, base, whole = [], [], []
                for at, text in enumerate(some.column(1).to_pylist()):
                    text = text or ""
                    spans = base_spans(text)
                    counts.append([sum(s[1] == kind for s in spans) for kind in ("assign", "access", "hex")])
                    base.append(written(spans))
                    extra = [(a, ADDED, b) for span in added.get(at, ()) for a, b in beyond(text, span, spans)]
                    whole.append(written(sorted(spans + extra, key=lambda s: (s[0], KINDS[s[1]], s[2]))) if extra else base[-1])
                n = np.array(counts, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *[pa.array(n[:, i]) for i in range(3)], pa.array(base, pa.string()), pa.array(whole, pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")
