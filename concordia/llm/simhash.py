"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 3 differ in at most 3 of their 8 bytes, so a linked
pair shares at least 5 positional bytes. The index posts a fingerprint under the bytes at each of
the 14 sets of four positions whose numbers have the exclusive-or 0. Any three positions lie inside
such a set, and so does the complement of one: hence any pair with 5 shared positional bytes meets
in some list, while a list needs 4 equal bytes and stays short. In a list, shared positional bytes
are tallied per pair, pairs with fewer than 5 dropped and the others verified bit by bit.

Documents with one fingerprint are one entry. A list returns, for each member, the smallest member
that it is linked to through the list, so the rows it gives grow with its length and not with its
pairs. A list beyond MAX_LIST is posted again, under each 5 of its 8 other half-bytes: such lists
have 12 free bits, at most 4096 members, and again every linked pair meets in one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_of, lower_ascii_words, map_batches, materialize, release, unused

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Positional bytes that pairs within MAX_BITS share at least.
LEAST_SHARED = 8 - MAX_BITS
#: Members of a list that are compared in one task (at most 64 KB).
MAX_LIST = 8192

POSITIONS = [s for s in itertools.combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Shingles whose bits are counted at once.
_SLICE = 1 << 18


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned; 0 without words. A bit is 1 if over half of the shingle hashes have it."""
    words = lower_ascii_words(data or b"")
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    h = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), _SLICE):
        counts += np.unpackbits(h[i : i + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def text_hash(text: Column) -> Column:
    """Tells rows with one doc_id apart; null as the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text), fp (the fingerprint as a signed long) for each row of documents(doc_id, text)."""

    def start():
        def each(batch):
            fp = np.array([fingerprint(t, size) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield batch_of(doc_id=batch["doc_id"], th=batch["th"], fp=pa.array(fp))

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", text_hash(F.col("text")).alias("th"), F.col("text").cast("binary").alias("text")), start, f"doc_id {kind}, th bigint, fp bigint")


def roots_of(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each of the different fingerprints (uint64), the smallest that it is linked to through them."""
    if len(fps) == 2:
        a, b = map(int, fps)
        shared = sum(not (a ^ b) >> k & 255 for k in range(0, 64, 8))
        return np.full(2, min(a, b), np.uint64) if shared >= 8 - max_bits and (a ^ b).bit_count() <= max_bits else fps.copy()
    order = np.argsort(fps)
    left, roots = fps[order], np.empty(len(fps), np.uint64)
    at = np.arange(len(fps))
    while len(left):
        root, front = left[0], left[:1]
        roots[order[at[0]]] = root
        left, at = left[1:], at[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                rest = np.flatnonzero(~near)
                x = left[rest] ^ f
                shared = 8 - (x.view(np.uint8).reshape(-1, 8) != 0).sum(axis=1) if len(x) else np.zeros(0, int)
                rest, x = rest[shared >= 8 - max_bits], x[shared >= 8 - max_bits]
                near[rest[np.bitwise_count(x) <= max_bits]] = True
            roots[order[at[near]]] = root
            front, left, at = left[near], left[~near], at[~near]
    return roots


def _linked(lists: DataFrame) -> DataFrame:
    """lists(fps array<long>) to the links (fp, root) within each, fp > root as unsigned numbers."""

    def start():
        def each(batch):
            own, root = [], []
            for fps in batch["fps"].to_pylist():
                f = np.unique(np.array(fps, np.int64).view(np.uint64))
                r = roots_of(f)
                own.append(f[f != r])
                root.append(r[f != r])
            yield batch_of(fp=pa.array(np.concatenate(own).view(np.int64)), root=pa.array(np.concatenate(root).view(np.int64)))

        return each

    return map_batches(lists, start, "fp bigint, root bigint")


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def _key(fp: Column, which: tuple[int, ...]) -> Column:
    """The bytes at the positions as one long."""
    out = F.lit(0).cast("long")
    for n, k in enumerate(which):
        out = out.bitwiseOR(F.shiftleft(_byte(fp, k), 8 * n))
    return out


def _half_bytes(fp: Column, which: int) -> Column:
    """The keys, 56 structs (s, w), of five of the eight half-bytes outside POSITIONS[which]."""
    free = [8 * p + h for p in range(8) if p not in POSITIONS[which] for h in (0, 4)]
    keys = []
    for s, five in enumerate(itertools.combinations(free, 5)):
        w = F.lit(0).cast("long")
        for n, bit in enumerate(five):
            w = w.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(15)), 4 * n))
        keys.append(F.struct(F.lit(s).alias("s"), w.alias("w")))
    return F.array(*keys)


def links(different: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """different(fp): each fingerprint once. Links (fp, root) that join every linked pair."""
    fp = F.col("fp")
    posted = different.select(fp, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _key(fp, p).alias("v")) for k, p in enumerate(POSITIONS)])).alias("key")).select("fp", "key.k", "key.v")
    sizes = materialize(posted.groupBy("k", "v").count().filter("count > 1"), "lists")
    posted = posted.join(sizes, ["k", "v"])
    out = _linked(posted.filter(F.col("count") <= max_list).groupBy("k", "v").agg(F.collect_list("fp").alias("fps")).select("fps"))
    if not sizes.filter(F.col("count") > max_list).isEmpty():
        long = materialize(posted.filter(F.col("count") > max_list).select("fp", "k", "v"), "long-lists")
        for k in range(len(POSITIONS)):
            again = long.filter(F.col("k") == k).select("fp", "v", F.explode(_half_bytes(fp, k)).alias("key"))
            again = again.groupBy("v", "key.s", "key.w").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
            out = out.unionByName(_linked(again.select("fps")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), a > b, to (a, b) with b the smallest node that a reaches, a any node but such.

    Alternating large and small stars: each round every node's neighbours are linked to the smallest
    one, first the larger neighbours, then the smaller; it ends when the stars stay as they are.
    """
    before = None
    edges = materialize(edges, "edges")
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        first = least
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        edges = materialize(small.select("a", F.col("m").alias("b")).unionByName(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        release(last, first, large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if now == before:
            return edges
        before = now


def _grouped(documents: DataFrame, size: int, max_list: int) -> DataFrame:
    """doc_id, th, fp, head of each row: the struct (whether null, doc_id, th) of its component's first row, which
    is the one with the smallest doc_id (null ids last), then the smallest th."""
    rows = materialize(fingerprints(documents, size), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    entries = materialize(rows.groupBy("fp").agg(F.min(own).alias("least")), "entries")
    found = links(entries.select("fp"), max_list)
    signed = found.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b"))
    stars = components(signed).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    entries = entries.join(stars, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    entries = materialize(entries, "rooted")
    heads = materialize(entries.groupBy("root").agg(F.min("least").alias("head")), "heads")
    named = materialize(entries.join(heads, "root").select("fp", "head"), "named")
    return rows.join(named, "fp")


def near_duplicates(documents: DataFrame, size: int = SHINGLE, max_list: int = MAX_LIST) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable over links of at most 3 differing bits).

    A text of fewer than `size` words is one shingle; a null or empty text has the fingerprint zero,
    linked like any other; rows with one doc_id and different texts stand in the component of each;
    a component whose ids are all null has a null component_id; an empty table gives no rows; other
    columns are ignored.
    """
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(documents, size, max_list).select("doc_id", hex16.alias("fingerprint"), F.col("head.doc_id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component with all its columns, whatever these are called: the one with the
    smallest doc_id, null ids last, and of texts that share this doc_id the one whose hash is least. Rows
    that repeat a doc_id with an equal text are one document and stay or go together. Null and empty
    texts are near each other; an empty table stays empty."""
    found = _grouped(documents, SHINGLE, MAX_LIST)
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))
    gone = found.filter(~stays).select("doc_id", "th").distinct().alias("g")
    th = unused(documents, "th")
    rows = documents.withColumn(th, text_hash(F.col("text"))).alias("d")
    return rows.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{th}") == F.col("g.th")), "left_anti").drop(th)
