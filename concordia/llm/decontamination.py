"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

A text is its words in order. Every word of the benchmark has a number, written as a fixed count of
digits to base DIGITS, the first one in signs of its own. So a node of the automaton has at most DIGITS
children however many words there are, a match can only start at a word, and its place divided by
the count of digits is a word position; word positions are mapped to offsets of the original text
where spans are asked for. A text is parted into words and scanned once. A match lies between two
words that the benchmark doesn't have, so only runs of words that it has pass through the automaton,
and of these only runs as long as the shortest window.

A benchmark whose windows take over SHARD_BYTES is dealt to several automata, one after another:
each shard is collected, sent, used to write down its matches, and dropped before the next, so the
driver and the workers hold one at a time whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Shared, batch_of, filter_texts, map_batches, materialize, release

#: Words of a window.
WINDOW = 10
#: Signs of a digit: the most children of a node.
DIGITS = 16
#: Bytes of windows that one automaton holds (some 100,000 windows, 0.35 GB of memory); a larger benchmark is dealt to several.
SHARD_BYTES = 8 << 20

_SPACED = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased; bytes from x80 belong to words."""
    return (data or b"").lower().translate(_SPACED).split()


def windows_of(data: bytes | None, size: int = WINDOW) -> list[bytes]:
    """Each run of `size` words; a text of fewer words, but not none, is one window."""
    words = words_of(data)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Automaton:
    """windows: (window, item ids), of any number of different words."""

    def __init__(self, windows: Iterable[tuple[bytes, list[str]]]):
        windows = [(w.split(), items) for w, items in windows]
        self.items = [items for _, items in windows]
        self.shortest = min((len(words) for words, _ in windows), default=1)
        different = dict.fromkeys(w for words, _ in windows for w in words)
        self.digits = 1
        while DIGITS**self.digits < len(different):
            self.digits += 1
        self.code = {w: self._written(k) for k, w in enumerate(different)}
        self.machine = ahocorasick.Automaton()
        for k, (words, _) in enumerate(windows):
            self.machine.add_word("".join([self.code[w] for w in words]), (len(words), k))
        if self.items:
            self.machine.make_automaton()

    def _written(self, number: int) -> str:
        out = ""
        for place in range(self.digits):
            number, digit = divmod(number, DIGITS)
            out = chr(ord("A") + digit + (DIGITS if place == self.digits - 1 else 0)) + out
        return out

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, window number) of every occurrence."""
        out: list[tuple[int, int, int]] = []
        if not self.items:
            return out
        codes: list[str | None] = [*map(self.code.get, words), None]
        first = 0
        while first < len(words):
            end = codes.index(None, first)
            if end - first >= self.shortest:
                for last, (n, k) in self.machine.iter("".join(codes[first:end])):
                    stop = first + (last + 1) // self.digits
                    out.append((stop - n, stop, k))
            first = end + 1
        return out


def window_table(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items): the different windows of benchmark(item_id, text) and the sorted ids that have each."""

    def start():
        def each(batch):
            out = [(w, i) for i, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()) for w in set(windows_of(t, size))]
            yield batch_of(window=pa.array([w for w, _ in out], pa.binary()), item=pa.array([i for _, i in out], pa.string()))

        return each

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, start, "window binary, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


Windows = list[tuple[bytes, list[str]]]


def shards(benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> tuple[int, Iterator[Windows]]:
    """How many lists of at most about shard_bytes the windows are dealt to by their hash, and these, each
    collected when it is asked for."""
    table = window_table(benchmark, size)
    total = table.agg(F.sum(F.octet_length("window") + 16 * F.size("items"))).head()[0] or 0
    n = -(-total // shard_bytes) or 1

    def parts():
        rows = table if n == 1 else materialize(table, "windows")
        for k in range(n):
            part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
            yield [(bytes(r.window), list(r["items"])) for r in part.toLocalIterator()]
        if n > 1:
            release(rows)

    return n, parts()


def _covered(found: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(found):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def spans_of(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged hit word ranges as code point offsets of the original text, end exclusive."""
    at = [m.span() for m in _WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][2]:
            if b > out[-1][2]:
                out[-1][1:] = [at[b - 1][1], b]
        else:
            out.append([at[a][0], at[b - 1][1], b])
    return [(a, b) for a, b, _ in out]


_RESULT = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<start:int,end:int>>, contaminated boolean"


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, n_words, n_hit, n_items, items
    (sorted), spans (struct start, end; of the original text), contaminated.

    A null or empty text has no words and isn't contaminated; an empty benchmark, or one of null texts,
    hits nothing; equal items are all named; an empty table gives no rows; repeated rows are judged one
    by one; other columns are ignored. One scan of each text and no shuffle. For a benchmark beyond
    shard_bytes, one scan for each shard, and the matches of different texts are joined to the rows.
    """
    rows = documents.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n, parts = shards(benchmark, size, shard_bytes)
    if n == 1:
        return map_batches(rows, _judge(Shared(documents.sparkSession, next(parts))), f"doc_id {kind}, {_RESULT}")
    rows, found = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit(b"")), 256)), []
    for part in parts:
        shared = Shared(documents.sparkSession, part)
        found.append(materialize(map_batches(rows.select("sha", "text"), _matches(shared), "sha string, hits array<int>, items array<string>").dropDuplicates(["sha"]), "matches"))
        shared.sent.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    joined = every.groupBy("sha").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return map_batches(rows.join(joined, "sha", "left").select("doc_id", "text", "hits", "items"), _close, f"doc_id {kind}, {_RESULT}")


def _result(doc_id: pa.Array, texts: list[bytes | None], n_words: list[int], hits: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
    spans = [[{"start": a, "end": b} for a, b in spans_of(t.decode("utf-8", "replace"), h)] if h else [] for t, h in zip(texts, hits)]
    n_hit = [_covered(h) for h in hits]
    return batch_of(
        doc_id=doc_id, n_words=pa.array(n_words, pa.int64()), n_hit=pa.array(n_hit, pa.int64()), n_items=pa.array([len(x) for x in items], pa.int64()), items=pa.array(items, pa.list_(pa.string())),
        spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), contaminated=pa.array([n > 0 for n in n_hit], pa.bool_()),
    )


def _found(auto: Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
    """Hit word ranges, and the items that have their windows."""
    found = auto.matches(words)
    return [(a, b) for a, b, _ in found], sorted({i for w in {w for _, _, w in found} for i in auto.items[w]})


def _judge(part: Shared):
    def start():
        auto = part.build(Automaton)

        def each(batch):
            texts = batch["text"].to_pylist()
            n_words, found = [], []
            for text in texts:
                words = words_of(text)
                n_words.append(len(words))
                found.append(_found(auto, words))
            yield _result(batch["doc_id"], texts, n_words, [h for h, _ in found], [x for _, x in found])

        return each

    return start


def _matches(part: Shared):
    """The matches of one shard, in the texts that have any."""

    def start():
        auto = part.build(Automaton)

        def each(batch):
            found = [(sha, *_found(auto, words_of(t))) for sha, t in zip(batch["sha"].to_pylist(), batch["text"].to_pylist())]
            found = [x for x in found if x[1]]
            yield batch_of(
                sha=pa.array([x[0] for x in found], pa.string()), hits=pa.array([[p for ab in x[1] for p in ab] for x in found], pa.list_(pa.int32())),
                items=pa.array([x[2] for x in found], pa.list_(pa.string())),
            )

        return each

    return start


def _close():
    def each(batch):
        texts, flat = batch["text"].to_pylist(), [x or [] for x in batch["hits"].to_pylist()]
        items = [sorted(x or []) for x in batch["items"].to_pylist()]
        yield _result(batch["doc_id"], texts, [len(words_of(t)) for t in texts], [[*zip(x[::2], x[1::2])] for x in flat], items)

    return each


def keep_clean(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows whose text has no window of the benchmark, with all their columns.

    Null and empty texts have none and stay; an empty benchmark keeps every row; repeated rows stay or
    go together; an empty table stays empty. For a benchmark beyond shard_bytes the rows that are left
    are written after each shard.
    """
    n, parts = shards(benchmark, size, shard_bytes)
    rows = documents
    for part in parts:
        shared = Shared(documents.sparkSession, part)

        def start(shared=shared):
            auto = shared.build(Automaton)
            return lambda texts: [not auto.matches(words_of(t)) for t in texts]

        left = filter_texts(rows, start)
        if n == 1:
            return left
        before, rows = rows, materialize(left, "clean")
        shared.sent.destroy()
        if before is not documents:
            release(before)
    return rows


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op10."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: DuckDB. Occurrences are found window by window here, by equality of word n-grams.
ORACLE_SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT row_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT row_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)
), hit AS (
  SELECT dw.row_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w
), words AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY row_id
), items AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT row_id, item FROM hit) GROUP BY row_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)
"""
