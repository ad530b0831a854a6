"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The field's features are word shapes of a token and its neighbours, hashed to weights for each tag
(outside, or begin and inside of each kind). It is trained by Adam on the log likelihood over a
small labelled table. Every token of every text is decoded by Viterbi: tokens, shapes and features of many
texts are found at once over arrays of code points, and the texts' paths are followed side by side,
longest first, so that a step costs as much as there are texts that long.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Shared, batch_of, map_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
BUCKETS = 1 << 12
#: Features of a token, and code points of texts that are decoded at once; a longer text is decoded by itself.
WIDTH, CHUNK = 8, 1 << 21
#: Tokens of a segment; a text of over MANY segments is decoded by these, which pays only for many at once.
SEGMENT, MANY = 2048, 16

# The patterns start only where a match can, so that long runs take linear time: a match from the
# middle of a run of digits, or of characters of a mail name, ends as the one from its start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

_MAIL_SIGN = re.compile(r"@|\(\s?at\s?\)|\[\s?at\s?\]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, reach, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > reach and text[a - 1] in _NAME_CHARS:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            reach = m.end()
            at = text.find("@", reach)
        else:
            reach, at = at + 1, text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return found


# --- the random field


_SPACE, _DIGIT, _LOWER, _UPPER, _OTHER = range(5)
#: Code points from here on are letters (the planes of ideographs) and have no other case.
_PLANES = 0x20000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point below _PLANES, and its lower-case form."""
    kinds, lower = np.full(_PLANES + 1, _LOWER, np.uint8), np.arange(_PLANES + 1, dtype=np.uint32)
    for c in range(_PLANES):
        t = chr(c)
        kinds[c] = _DIGIT if "0" <= t <= "9" else _SPACE if t.isspace() else (_UPPER if t.isupper() else _LOWER) if t.isalpha() else _OTHER
        if kinds[c] == _UPPER and len(t.lower()) == 1:
            lower[c] = ord(t.lower())
    return kinds, lower


@dataclass
class Tokens:
    """Runs of digits, runs of letters, and other code points but space, of several texts: the text's number, start
    and end in it, and features of each."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        joined = " ".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        table, lower = _tables()
        kinds = table[np.minimum(codes, _PLANES)]
        group = np.where(kinds == _UPPER, np.uint8(_LOWER), kinds)
        changed = np.ones(len(codes), bool)
        changed[1:] = (group[1:] != group[:-1]) | (group[1:] == _OTHER)
        edges = np.flatnonzero(changed)
        named = group[edges] != _SPACE
        start, end = edges[named], np.append(edges[1:], len(codes))[named]
        own, size = group[start], end - start
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        text = np.searchsorted(first, start, "right") - 1
        lowers = np.add.reduceat(kinds == _LOWER, edges, dtype=np.int32)[named] if len(edges) else np.zeros(0, np.int32)
        letters = 20 + 2 * (lowers == 0) + (size == 1)
        shape = np.where(own == _DIGIT, np.where(size < 13, size, np.where(size < 20, 13, 14)), np.where(own == _OTHER, 32 + codes[start].astype(np.int64), letters)).astype(np.uint64)
        glued = np.zeros(len(start) + 1, np.uint64)
        glued[1:-1] = start[1:] == end[:-1]
        small = np.zeros(len(start), np.uint64)
        for k in range(3):
            has = (size > k) & (size <= 3) & (own != _DIGIT)
            small[has] |= lower[np.minimum(codes[start[has] + k], _PLANES)].astype(np.uint64) << np.uint64(21 * k)
        return cls(text, start - first[text], end - first[text], _features(text, shape, glued, small))


def _features(text: np.ndarray, shape: np.ndarray, glued: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Hashed features: a token's shape with those of its neighbours in the text (0: none) and whether they touch."""

    def near(k: int) -> np.ndarray:
        out = np.zeros_like(shape)
        a, b = (slice(-k, None), slice(None, k)) if k < 0 else (slice(None, -k), slice(k, None))
        out[a] = np.where(text[a] == text[b], shape[b], 0)
        return out

    p3, p2, p1, n1, n2 = map(near, (-3, -2, -1, 1, 2))
    left, right = glued[:-1], glued[1:]
    seen = [(shape,), (p1, left, shape), (shape, right, n1), (p2, p1, left, shape), (shape, right, n1, n2), (p1, left, shape, right, n1), (small,), (p3, p2, p1, shape)]
    out = np.empty((len(shape), WIDTH), np.int16)
    for k, parts in enumerate(seen):
        h = np.full(len(shape), k + 1, np.uint64) * _MIX
        for part in parts:
            h = (h ^ part) * _MIX
            h ^= h >> np.uint64(31)
        out[:, k] = h * _MIX >> np.uint64(64 - 12)
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Field:
    weights: np.ndarray  # BUCKETS x tags
    moves: np.ndarray  # tags x tags
    first: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.weights, self.moves, self.first]


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([*map(len, rows)])
    out = np.zeros((len(rows), sizes.max(), WIDTH), np.int16)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, sizes


def decode(field: Field, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best tag of each token of texts of so many tokens. Of equal paths the one with the lower tags, seen from
    the end, is taken."""
    emit = np.zeros((len(features), len(TAGS)))
    for k in range(WIDTH):
        emit += field.weights[features[:, k]]
    emit = np.ascontiguousarray(emit.T)
    first, out = np.cumsum(sizes) - sizes, np.zeros(len(features), np.int8)
    long = sizes > MANY * SEGMENT
    for a, n in zip(first[long], sizes[long]):
        out[a : a + n] = _by_segments(field, emit[:, a : a + n])
    order = np.argsort(-sizes, kind="stable")
    order = order[(sizes[order] > 0) & ~long[order]]
    longest, starts = int(sizes[order].max(initial=0)), first[order]
    live = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # texts longer than t come first
    at = lambda t: starts[: live[t]] + t
    scores = _forward([emit[:, at(t)] for t in range(longest)], field.first[:, None], field.moves)
    tags = np.zeros(0, int)
    for t in range(longest - 1, -1, -1):
        s = scores[t].T.copy()
        s[: len(tags)] += field.moves.T[tags]
        tags = s.argmax(axis=1)
        out[at(t)] = tags
    return out


def _forward(emit: list[np.ndarray], start: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """tags x sequences at each step: the best score of a path that ends there. Sequences may end, the last ones
    first. start: what the tags of the first step have before them."""
    scores: list[np.ndarray] = []
    for e in emit:
        scores.append(e + ((scores[-1][:, None, : e.shape[1]] + moves[:, :, None]).max(axis=0) if scores else start))
    return scores


def _by_segments(field: Field, emit: np.ndarray) -> np.ndarray:
    """The path of one long text. All segments at once: the best scores from each tag before a segment to each at
    its end; these, combined one after another, give the scores at the segments' starts; then all
    paths, back from each tag at an end, of which the true ones are picked from the last."""
    moves, count, n = field.moves, len(TAGS), emit.shape[1]
    head = n % SEGMENT or SEGMENT
    before = _forward([emit[:, t : t + 1] for t in range(head)], field.first[:, None], moves)
    parts = emit[:, head:].reshape(count, -1, SEGMENT)
    through = moves[:, :, None] + parts[None, :, :, 0]
    for t in range(1, SEGMENT):
        through = np.stack([(row[:, None] + moves[:, :, None]).max(axis=0) for row in through]) + parts[None, :, :, t]
    starts = [before[-1][:, 0]]
    for k in range(parts.shape[1]):
        starts.append((starts[-1][:, None] + through[:, :, k]).max(axis=0))
    entered = (np.stack(starts[:-1], axis=1)[:, None] + moves[:, :, None]).max(axis=0)
    scores = _forward([parts[:, :, t] for t in range(SEGMENT)], entered, moves)
    paths = np.empty((SEGMENT, count, parts.shape[1]), np.int8)
    paths[-1] = np.arange(count)[:, None]
    for t in range(SEGMENT - 2, -1, -1):
        paths[t] = (scores[t][:, None] + moves[:, paths[t + 1]]).argmax(axis=0)
    out, tag = np.empty(n, np.int8), int(starts[-1].argmax())
    for k in range(parts.shape[1] - 1, -1, -1):
        a = head + k * SEGMENT
        out[a : a + SEGMENT] = paths[:, tag, k]
        tag = int((starts[k] + moves[:, out[a]]).argmax())
    for t in range(head - 1, -1, -1):
        out[t] = tag
        tag = int((before[t - 1][:, 0] + moves[:, tag]).argmax()) if t else 0
    return out


def _log_sum(v: np.ndarray, axis: int) -> np.ndarray:
    m = v.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis=axis))


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 40, rate: float = 0.15, penalty: float = 1e-4) -> Field:
    """examples: (text, labelled spans), each text a whole sequence."""
    rows, tags = [], []
    for text, spans in examples:
        tokens = Tokens.of([text])
        if len(tokens.text):
            rows.append(tokens.features)
            tags.append([_tag_of(a, b, spans) for a, b in zip(tokens.start, tokens.end)])
    n = len(TAGS)
    field = Field(np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n))
    if not rows:
        return field
    x, sizes = _padded(rows)
    y = np.zeros(x.shape[:2], int)
    for k, t in enumerate(tags):
        y[k, : len(t)] = t
    count, length = y.shape
    live = np.arange(length) < sizes[:, None]
    gold, seen = np.eye(n)[y] * live[:, :, None], x[live].ravel()
    pairs = live[:, 1:]
    gold_moves = np.einsum("kta,ktb->ab", gold[:, :-1] * pairs[:, :, None], gold[:, 1:])
    first, second = [np.zeros_like(p) for p in field.parts()], [np.zeros_like(p) for p in field.parts()]
    for step in range(1, rounds + 1):
        emit = field.weights[x].sum(axis=2)
        alpha, beta = np.zeros((count, length, n)), np.zeros((count, length, n))
        alpha[:, 0] = field.first + emit[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.where(live[:, t, None], _log_sum(alpha[:, t - 1, :, None] + field.moves, 1) + emit[:, t], alpha[:, t - 1])
        total = _log_sum(alpha[:, -1], 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], _log_sum(field.moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        mean = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        g_moves = -gold_moves
        for t in range(length - 1):
            g_moves = g_moves + (np.exp(alpha[:, t, :, None] + field.moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None]) * pairs[:, t, None, None]).sum(axis=0)
        excess = np.repeat((mean - gold)[live], WIDTH, axis=0)
        g_weights = np.stack([np.bincount(seen, excess[:, k], BUCKETS) for k in range(n)], axis=1)
        grads = [g_weights / count + penalty * field.weights, g_moves / count + penalty * field.moves, (mean - gold)[:, 0].sum(axis=0) / count + penalty * field.first]
        for p, g, m, v in zip(field.parts(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def _tag_of(a: int, b: int, spans: list[tuple[str, int, int]]) -> int:
    for kind, s, e in spans:
        if s <= a and b <= e:
            return TAGS.index(f"{'B' if a == s else 'I'}-{kind}")
    return 0


#: How many digits, or other signs, a span of the field must have to count.
_LEAST = {"ip": (4, 12), "card": (13, 19), "phone": (9, 15)}


def marked(field: Field, texts: list[str]) -> Iterator[tuple[int, str, int, int]]:
    """(text, kind, start, end) of the stretches that the field marks, in order."""
    for low, high in _chunks(texts):
        tokens = Tokens.of(texts[low:high])
        tags = decode(field, tokens.features, np.bincount(tokens.text, minlength=high - low))
        open_at, last = None, -2
        for k in np.flatnonzero(tags).tolist():
            t, kind, begins = low + int(tokens.text[k]), TAGS[tags[k]][2:], TAGS[tags[k]][0] == "B"
            if open_at and not begins and k == last + 1 and open_at[:2] == (t, kind):
                open_at = (*open_at[:3], int(tokens.end[k]))
            else:
                if open_at:
                    yield open_at
                open_at = (t, kind, int(tokens.start[k]), int(tokens.end[k]))
            last = k
        if open_at:
            yield open_at


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    low, chars = 0, 0
    for k, t in enumerate(texts):
        if chars and chars + len(t) > CHUNK:
            yield low, k
            low, chars = k, 0
        chars += len(t)
    if low < len(texts):
        yield low, len(texts)


def added_spans(field: Field, texts: list[str], base: list[dict[str, list[tuple[int, int]]]]) -> list[list[tuple[str, int, int]]]:
    """The field's spans that overlap no base span."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken: dict[int, tuple[list[int], list[int]]] = {}
    for k, kind, a, b in marked(field, texts):
        if _plausible(kind, texts[k][a:b]):
            if k not in taken:
                taken[k] = _merged([s for spans in base[k].values() for s in spans])
            if not _overlaps(taken[k], a, b):
                out[k].append((kind, a, b))
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union, both ascending."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _overlaps(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    k = bisect_right(taken[1], a)
    return k < len(taken[0]) and taken[0][k] < b


def _plausible(kind: str, found: str) -> bool:
    if kind == "email":
        return "." in found and bool(_MAIL_SIGN.search(found))
    low, high = _LEAST[kind]
    return low <= len(_NO_DIGIT.sub("", found)) <= high and (kind != "ip" or found.count(".") == 3)


# --- the labelled table


def labelled_table(rows: int = 700, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): invented words around invented personal data, and numbers that are none. No rows give an
    empty table, from which train() makes a field of zeros; the same seed gives the same rows."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick("an", "to", "re", "li", "mo", "sche", "ti", "on", "ga", "be", "é", "ñu", "ö") for _ in range(rng.integers(1, 4)))
    name = lambda: "".join(pick("ann", "bo", "lee", "ti", "mar", "on", "ga") for _ in range(rng.integers(1, 4)))
    cap = lambda w: w.title() if rng.random() < 0.2 else w
    ip = lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4))
    makers = [
        ("email", lambda: f"{name()}{pick('.', '_', '')}{digits(rng.integers(0, 3))}@{name()}{digits(rng.integers(0, 2))}.{pick('example.com', 'org', 'net')}"),
        ("email", lambda: f"{name()}.{name()} {pick('(at)', '[at]')} {name()}.{pick('com', 'org')}"),
        ("ip", ip),
        ("card", lambda: digits(16)),
        ("card", lambda: pick(" ", "-").join(digits(4) for _ in range(4))),
        ("card", lambda: digits(rng.integers(13, 20))),
        ("phone", lambda: f"+{digits(rng.integers(1, 3))} ({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("", lambda: digits(rng.integers(1, 9))),
        ("", lambda: f"{digits(1)}.{digits(1)}"),
        ("", lambda: f"20{digits(2)}-{pick('01', '07', '12')}-{digits(2)}"),
        ("", lambda: f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"'),
        ("", lambda: f"${digits(2)},{digits(3)}.{digits(2)}"),
        ("", lambda: f"{digits(2)}:{digits(2)}"),
        ("", lambda: digits(rng.integers(21, 30))),
        ("", lambda: f"{word()}{digits(3)}{word()}{digits(2)}"),
        ("", lambda: f"@{word()}"),
        ("", lambda: f"version {digits(1)}.{digits(1)}.{digits(2)}"),
    ]
    out = []
    for k in range(rows):
        kind, make = makers[k % len(makers)]
        body = make()
        before = " ".join(cap(word()) for _ in range(rng.integers(0, 5)))
        before += pick("", "", ".", ",", "!!", "%%%", " |", "###", "***") + pick(" ", "\n") if before else ""
        after = " ".join(cap(word()) for _ in range(rng.integers(0, 5)))
        after = pick(" ", " ", ", ", ". ", "&&& ", "!! ", "%%% ", " | ", "### ", "*** ", "") * bool(after) + after + pick("", ".")
        if after[:1].isalnum():
            after = " " + after
        if rng.random() < 0.1:
            before, after = before.upper(), after.upper()
        out.append((before + body + after, [(kind, len(before), len(before) + len(body))] if kind else []))
    return out


def find_personal_data(documents: DataFrame, field: Field) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id; n_email, n_ip, n_card, n_phone and
    base_sha256 of the base spans; spans, all of them, and n_added, those of the field.

    Spans are kind:start:end in code points, end exclusive, by kind as listed, then start. Null
    counts as empty, with no spans; an empty table gives no rows; repeated rows are searched one by
    one; of paths with equal scores the one with the lower tags, seen from the end, is taken; other
    columns are ignored. Every token of a text is decoded, in time and memory in proportion to its
    length. No shuffle.
    """
    from hashlib import sha256

    shared = Shared(documents.sparkSession, field)

    def start():
        def each(batch):
            texts = [t or "" for t in batch["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, base)
            joined = lambda found: ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found[k]))
            every = [{k: b[k] + [(s, e) for kind, s, e in more if kind == k] for k in KINDS} for b, more in zip(base, added)]
            yield batch_of(
                doc_id=batch["doc_id"], **{f"n_{k}": pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS},
                base_sha256=pa.array([sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), spans=pa.array([joined(e) for e in every], pa.string()), n_added=pa.array([*map(len, added)], pa.int64()),
            )

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", F.col("text")), start, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
