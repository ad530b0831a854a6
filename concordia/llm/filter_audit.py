"""Filter interaction audit: what each filter removes in every order of filters, from a packed bitmap index.

Each task turns its rows into bitsets, packed eight rows to a byte: one for each filter (rows that fail
it), one for each label, one for each part. For a set of filters that come first the survivors are the
rows AND NOT each filter of the set; popcounts of survivors by part and label are summed over tasks.
A filter's place in an order is the difference of two such sets, so 32 sets say all of 120 orders.

A row's filters are found in one scan of its text. The duplicate filter needs all rows: texts meet by
SHA-256, never as texts, and a text that many rows share is told to them by broadcast (see join_unique).
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_of, join_unique, map_batches, materialize

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
#: Rows of one bitset, and parts whose counts a task holds before it hands them on.
BITSET_ROWS, HELD_PARTS = 1 << 16, 4096

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """A text fails A below min_words, B below min_distinct per cent of different words, C above max_capitals per
    cent of A-Z among its code points, D with any of the symbols, E if a smaller doc_id has the same text."""

    min_words: int = 100
    min_distinct: int = 80
    max_capitals: int = 10
    symbols: str = "#$%&*|"

    def failed(self, text: bytes) -> int:
        """Bit k is set if the text fails the filter FILTERS[k]; the bit of E is left out."""
        words = text.split()
        a = len(words) < self.min_words
        b = 100 * len({*words}) < self.min_distinct * len(words)
        c = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > self.max_capitals * len(text.translate(None, _CONTINUED))
        d = len(text.translate(None, self.symbols.encode())) < len(text)
        return a | b << 1 | c << 2 | d << 3


def judged(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, part (lang, null as empty), sha and failed (filters A to D) of each row, in one scan of the texts."""

    def start():
        def each(batch):
            texts = [t or b"" for t in batch["text"].to_pylist()]
            yield batch_of(
                doc_id=batch["doc_id"], part=pa.array([p or "" for p in batch["part"].to_pylist()], pa.string()),
                sha=pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), failed=pa.array([limits.failed(t) for t in texts], pa.int32()),
            )

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("lang").alias("part"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, start, f"doc_id {kind}, part string, sha binary, failed int")


def index_rows(documents: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, failed (all filters), good, toxic of each row. An id with several labels is good (toxic) if one says so."""
    rows = materialize(judged(documents, limits), "judged")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = materialize(join_unique(rows, marks, "doc_id"), "marked")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    no = F.lit(False)
    return join_unique(marked, materialize(firsts, "firsts"), "sha").select(
        "part", F.col("failed").bitwiseOR(again).alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )


def popcount(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def counted(failed: np.ndarray, good: np.ndarray, toxic: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """counts[part, set of filters] = survivors, good ones, toxic ones, for rows whose part numbers ascend: a
    part's bitset is a run of ones, so only the bytes that it touches are read."""
    fails = [np.packbits(failed >> k & 1) for k in range(len(FILTERS))]
    labels = [np.packbits(good), np.packbits(toxic)]
    alive = [np.packbits(np.ones(len(failed), bool))]
    for s in range(1, EVERY + 1):
        low = (s & -s).bit_length() - 1
        alive.append(alive[s & s - 1] & ~fails[low])
    out = np.zeros((parts, EVERY + 1, 3), np.int64)
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        first, last = edges[p] // 8, -(-edges[p + 1] // 8)
        own = np.zeros(8 * (last - first), bool)
        own[edges[p] - 8 * first : edges[p + 1] - 8 * first] = True
        own = np.packbits(own)
        good_here, toxic_here = own & labels[0][first:last], own & labels[1][first:last]
        for s in range(EVERY + 1):
            left = alive[s][first:last]
            out[p, s] = popcount(left & own), popcount(left & good_here), popcount(left & toxic_here)
    return out


def set_counts(rows: DataFrame) -> DataFrame:
    """part, set, kept, good, toxic: rows of index_rows() that pass every filter of each set."""

    def start():
        pending: list[pa.RecordBatch] = []
        held: dict[str, np.ndarray] = {}

        def count() -> None:
            rows = pa.Table.from_batches(pending)
            pending.clear()
            names, part = np.unique(rows["part"].to_numpy(), return_inverse=True)
            order = np.argsort(part, kind="stable")
            failed, good, toxic = (rows[c].to_numpy()[order] for c in ("failed", "good", "toxic"))
            for name, c in zip(names, counted(failed, good, toxic, part[order], len(names))):
                held[name] = held.get(name, 0) + c

        def given() -> Iterator[pa.RecordBatch]:
            every = np.concatenate([*held.values()])
            yield batch_of(
                part=pa.array(np.repeat(np.array([*held], object), EVERY + 1), pa.string()), set=pa.array(np.tile(np.arange(EVERY + 1, dtype=np.int32), len(held))),
                kept=pa.array(every[:, 0]), good=pa.array(every[:, 1]), toxic=pa.array(every[:, 2]),
            )
            held.clear()

        def each(batch):
            pending.append(batch)
            if sum(b.num_rows for b in pending) >= BITSET_ROWS:
                count()
            if len(held) >= HELD_PARTS:
                yield from given()

        def finish():
            if pending:
                count()
            if held:
                yield from given()

        each.finish = finish
        return each

    found = map_batches(rows, start, "part string, set int, kept bigint, good bigint, toxic bigint")
    return found.groupBy("part", "set").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))


def _steps() -> Column:
    """All orders and their steps: a fixed table, whatever the input."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "k": k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, k: int, before: int, after: int>>")


def audit(documents: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step; kept after the step,
    removed by it; redundant, failing its filter but removed before; unique_fails, failing its filter only;
    good_lost and toxic_lost of those removed; shapley, what the filter removes summed over all orders.

    documents(doc_id, text, lang), labels(doc_id, quality, toxic). Null texts are empty, a null lang is the part
    with the empty name. A null doc_id is no smaller one and has none, and its row has no label; rows that repeat
    an id and a text don't fail E for each other. An id with several labels is good (toxic) if one says so. Other
    columns are ignored. An empty table has no part and gives no rows. A text is read whole, in time and
    memory in proportion to its length.
    """
    counts = set_counts(index_rows(documents, labels, limits))
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("kept", "good", "toxic")))).alias("of"))
    of = lambda s, c: F.col("of")[s][c]
    lost = lambda c: of(F.col("before"), c) - of(F.col("after"), c)

    def only(k: int) -> list[Column]:
        """fails, fails of no other filter, and the sum over orders of filter k."""
        kept = lambda s: of(F.lit(s), "kept")
        others = [s for s in range(EVERY + 1) if not s >> k & 1]
        orders = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return [kept(0) - kept(1 << k), kept(EVERY & ~(1 << k)) - kept(EVERY), sum((F.lit(orders(s)) * (kept(s) - kept(s | 1 << k)) for s in others), F.lit(0))]

    sums = [F.struct(*(c.cast("bigint").alias(n) for n, c in zip(("fails", "alone", "shapley"), only(k)))) for k in range(len(FILTERS))]
    own = F.col("sums")[F.col("k")]
    rows = held.select("part", "of", F.array(*sums).alias("sums")).select("part", "of", "sums", F.inline(_steps()))
    return rows.select(
        "part", "filter_order", "step", of(F.col("after"), "kept").alias("kept"), lost("kept").alias("removed"), (own["fails"] - lost("kept")).alias("redundant"),
        own["alone"].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), own["shapley"].alias("shapley"),
    )


#: DuckDB. Rows are counted by part and set of failures; orders are words over the filters' letters.
ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)::INT AS failed
  FROM t LEFT JOIN marks ON t.doc_id = marks.doc_id
), c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE failed & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE failed & before = 0 AND failed & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE failed & before > 0 AND failed & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE failed = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE failed & before = 0 AND failed & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE failed & before = 0 AND failed & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
