"""Exact search for the largest inner products by a pivot-distance index.

Components are floor(64 x). Vectors are put on a sphere of radius M, the largest norm, by one more
component: x' = (x, sqrt(M^2 - |x|^2)). A query is stretched to length M and gets 0: q' = (q M/|q|, 0). Then
|q' - x'|^2 = 2 M^2 - 2 (M/|q|) q.x, so the nearest points have the largest products.

Index: a vector's key is (its nearest pivot, the distance to it). The keys of a pivot are parted into
annuli of about as many vectors, and these are stored as blocks of bounded size. The directory of
annuli (pivot, least and largest distance) has at most MAX_PIVOTS * MAX_RINGS entries.

Search: by the triangle inequality no vector of an annulus [lo, hi] is nearer to q' than
max(lo - d, d - hi), d being the distance of q' to the pivot. A query opens annuli in the order of this
bound. The first ones, that hold FIRST vectors at least, give its k-th product so far; of all others
it opens those whose bound doesn't exclude a product as large. Blocks of queries meet blocks of vectors
by a join on groups of neighbouring annuli, so that a query travels once for each group and not for each annulus; a pair
of blocks is one matrix product of whole numbers.

Rows with the same vector are one entry with its k + 1 smallest ids, which is all that a result can
need, and equal queries are searched for once: a vector that a third of all rows share costs as one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Shared, batch_of, join_unique, map_batches, materialize

SCALE = 64
#: Bounds of the directory, and of the sample of different vectors that pivots are drawn from.
MAX_PIVOTS, MAX_RINGS, SAMPLE = 256, 64, 4096
#: Vectors of an annulus that are aimed at, of a stored block, of the first annuli, queries whose bounds are held at once.
RING_ROWS, BLOCK_ROWS, FIRST, BOUND_ROWS = 2048, 2048, 2048, 256
#: Groups of annuli that are aimed at, and annuli of a group at most.
GROUPS, GROUP_RINGS = 64, 64
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53
_LONG = np.iinfo(np.int64)


# --- vectors as bytes: equal vectors are equal bytes


def packed(v: np.ndarray) -> bytes:
    """Whole numbers as int16 where all fit, else as doubles; the first byte says which."""
    small = not len(v) or np.abs(v).max() < 1 << 15
    return b"h" + v.astype("<i2").tobytes() if small else b"d" + v.astype("<f8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"h" else "<f8", offset=1).astype(np.float64)


def matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """One row a vector; missing components are 0."""
    rows = [unpacked(v) for v in vectors]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (bytes), norm, for vectors without null or non-finite components."""

    def start():
        def each(batch):
            lists = batch["embedding"]
            values = np.floor(SCALE * lists.values.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0  # no negative zeros
            at, named = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            rows = [(k, values[at[k] : at[k + 1]]) for k in np.flatnonzero(named)]
            rows = [(k, v) for k, v in rows if np.isfinite(v).all()]
            yield batch_of(
                vec_id=batch["vec_id"].take(pa.array([k for k, _ in rows], pa.int64())), vec=pa.array([packed(v) for _, v in rows], pa.binary()),
                norm=pa.array([float(np.sqrt(np.dot(v, v))) for _, v in rows], pa.float64()),
            )

        return each

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(rows, start, f"vec_id {kind}, vec binary, norm double")


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as long; sums that long can't hold are cut to its range."""
    width = max(queries.shape[1], vectors.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, vectors))
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * width < _EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(np.dot(whole(q), whole(v).T), _LONG.min, _LONG.max).astype(np.int64)


# --- the index


def _lifted(v: np.ndarray, radius: float) -> np.ndarray:
    """Points on the sphere."""
    return np.hstack([v, np.sqrt(np.maximum(0, radius * radius - (v * v).sum(axis=1)))[:, None]])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.nan_to_num(np.sqrt(np.maximum(0, square)))


def choose_pivots(vectors: np.ndarray, count: int, radius: float, rounds: int = 8) -> np.ndarray:
    """Centres of count groups of the sample, by k-means from its first rows."""
    points = _lifted(vectors, radius)
    pivots = points[:count].copy()
    for _ in range(rounds):
        near = _distances(points, pivots).argmin(axis=1)
        for k in range(len(pivots)):
            if (near == k).any():
                pivots[k] = points[near == k].mean(axis=0)
    return pivots


@dataclass
class Directory:
    """Annuli by number: pivot, least and largest distance, vectors. Bounded by MAX_PIVOTS * MAX_RINGS."""

    radius: float
    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(_lifted(_wide(vectors, self.width), self.radius), self.pivots)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    @property
    def width(self) -> int:
        return self.pivots.shape[1] - 1

    @property
    def group(self) -> int:
        """Annuli of a group."""
        return min(GROUP_RINGS, max(1, -(-len(self.pivot) // GROUPS)))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and annulus: the least distance, the largest product, and the distance to the pivot."""
        queries = _wide(queries, self.width)
        norm = np.sqrt((queries * queries).sum(axis=1))
        stretch = np.divide(self.radius, norm, out=np.zeros_like(norm), where=norm > 0)
        points = np.hstack([queries * stretch[:, None], np.zeros((len(queries), 1))])
        d = _distances(points, self.pivots)[:, self.pivot]
        least = np.maximum(0, np.maximum(self.low - d, d - self.high))
        most = np.where(norm > 0, norm * self.radius, 0)[:, None] - np.where(stretch > 0, least.T**2 / np.where(stretch > 0, 2 * stretch, 1), 0).T
        most = most + 1e-6 * (1 + np.abs(most) + (norm * self.radius)[:, None])
        return least, np.where(np.isfinite(most), most, np.inf), d

    def first(self, queries: np.ndarray, least_rows: int) -> np.ndarray:
        """queries x annuli: which each query opens first, by their bound, then by the pivot's distance."""
        least, _, d = self.bounds(queries)
        out = np.zeros(least.shape, bool)
        for a, b, mark in zip(least, d, out):
            order = np.lexsort((np.arange(len(a)), b, a))
            mark[order[: int(np.searchsorted(np.cumsum(self.rows[order]), least_rows)) + 1]] = True
        return out

    def rest(self, queries: np.ndarray, reached: np.ndarray, least_rows: int) -> np.ndarray:
        """The other annuli that can hold a product as large as the one reached."""
        return (self.bounds(queries)[1] >= reached[:, None]) & ~self.first(queries, least_rows)


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def entries(rows: DataFrame, k: int) -> DataFrame:
    """vec, norm, ids: the different vectors of quantised rows with their k + 1 smallest ids (null last). Each task
    keeps so many before the shuffle."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    return few.groupBy("vec").agg(F.first("norm").alias("norm"), F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))).alias("ids")).select("vec", "norm", F.col("ids.vec_id").alias("ids"))


def _sampled(table: DataFrame, count: int) -> list[bytes]:
    """The SAMPLE different vectors that come first by their hash, all if there are fewer. Only hashes under a bound that
    twice as many are expected to have are sorted: else each task would send so many to the driver."""
    hashed = table.select(F.xxhash64("vec").alias("h"), "vec")
    bound = _LONG.min + int(2**64 * min(1.0, 2 * SAMPLE / count)) - 1
    first = lambda rows: [bytes(r.vec) for r in rows.orderBy("h", "vec").limit(SAMPLE).collect()]
    found = first(hashed.filter(F.col("h") <= bound))
    return found if len(found) == min(SAMPLE, count) else first(hashed)


def build(table: DataFrame, ring_rows: int = RING_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[Directory | None, DataFrame]:
    """The directory, and blocks (ring, chunk, vec, ids) of at most about block_rows vectors, of a table of entries."""
    spark = table.sparkSession
    count, radius = table.agg(F.count("*"), F.max("norm")).head()
    if not count:
        return None, table.select(F.lit(0).alias("ring"), F.lit(0).alias("chunk"), F.array("vec").alias("vec"), F.array("ids").alias("ids"))
    sample = _sampled(table, count)
    width = table.agg(F.max(F.when(F.substring("vec", 1, 1) == F.lit(b"h"), F.octet_length("vec") / 2).otherwise(F.octet_length("vec") / 8))).head()[0]
    pivots = choose_pivots(matrix(sample, int(width)), min(MAX_PIVOTS, max(1, round((count / ring_rows) ** 0.5))), radius)
    empty = np.zeros(0)
    keyed = materialize(_keyed(table, Directory(radius, pivots, empty, empty, empty, empty)), "keyed")
    # as many annuli for each pivot as its vectors fill, parted at quantiles of the distance
    sizes = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("d", [k / MAX_RINGS for k in range(1, MAX_RINGS)], 1000).alias("at"))
    edges: dict[int, list[float]] = {}
    for r in sizes.collect():  # one row for each pivot
        rings = min(MAX_RINGS, -(-r.n // ring_rows))
        edges[r.pivot] = sorted({r["at"][MAX_RINGS * k // rings - 1] for k in range(1, rings)})
    first = np.cumsum([0, *(len(edges.get(p, [])) + 1 for p in range(len(pivots)))])
    placed = materialize(_placed(keyed, [np.array(edges.get(p, [])) for p in range(len(pivots))], first), "placed")
    found = sorted(placed.groupBy("ring", "pivot").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).collect(), key=lambda r: r.ring)
    directory = Directory(radius, pivots, *(np.array([r[c] for r in found]) for c in ("pivot", "low", "high", "n")))
    chunks = spark.createDataFrame([(r.ring, k, -(-r.n // block_rows)) for k, r in enumerate(found)], "ring int, number int, chunks int")
    chunk = F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int")
    # broadcast: the directory
    blocks = placed.join(F.broadcast(chunks), "ring").withColumn("chunk", chunk).groupBy(F.col("number").alias("ring"), "chunk").agg(F.collect_list(F.struct("vec", "ids")).alias("of"))
    return directory, materialize(blocks.select("ring", "chunk", F.col("of.vec").alias("vec"), F.col("of.ids").alias("ids")), "blocks")


def _keyed(table: DataFrame, directory: Directory) -> DataFrame:
    shared = Shared(table.sparkSession, directory)

    def start():
        def each(batch):
            pivot, d = shared.value.keys(matrix(batch["vec"].to_pylist()))
            yield batch_of(vec=batch["vec"], ids=batch["ids"], pivot=pa.array(pivot, pa.int32()), d=pa.array(d, pa.float64()))

        return each

    kind = table.schema["ids"].dataType.simpleString()
    return map_batches(table.select("vec", "ids"), start, f"vec binary, ids {kind}, pivot int, d double")


def _placed(keyed: DataFrame, edges: list[np.ndarray], first: np.ndarray) -> DataFrame:
    """keyed with ring, the number of the annulus: the edges travel as data, so that the plan doesn't grow with them."""
    shared = Shared(keyed.sparkSession, (edges, first))

    def start():
        def each(batch):
            own, at = shared.value
            pivot, d = batch["pivot"].to_numpy(), batch["d"].to_numpy()
            ring = np.zeros(len(pivot), np.int32)
            for p in np.unique(pivot).tolist():
                ring[pivot == p] = at[p] + np.searchsorted(own[p], d[pivot == p], "left")
            yield batch_of(**{c: batch[c] for c in batch.schema.names}, ring=pa.array(ring, pa.int32()))

        return each

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    return map_batches(keyed, start, f"{kinds}, ring int")


# --- search


def _opened(queries: DataFrame, directory: Directory, least_rows: int) -> DataFrame:
    """Blocks of queries (qids, vecs, least) for each group of annuli that they open: the first ones, or the rest if the
    queries have a product `reached`. A block has the queries of a batch. lanes are the annuli of the group that any of
    them opens, opens has a row of bits for each query."""
    shared, again = Shared(queries.sparkSession, directory), "reached" in queries.columns

    def start():
        def each(batch):
            vecs = batch["vec"].to_pylist()
            m = matrix(vecs)
            least = batch["reached"].to_numpy() if again else np.full(len(vecs), _LONG.min)
            opens = []
            for at in range(0, len(vecs), BOUND_ROWS):
                part = slice(at, at + BOUND_ROWS)
                opens.append(shared.value.rest(m[part], least[part].astype(np.float64), least_rows) if again else shared.value.first(m[part], least_rows))
            opens = np.concatenate(opens) if opens else np.zeros((0, 0), bool)
            size = shared.value.group
            for group in np.unique(np.flatnonzero(opens.any(axis=0)) // size).tolist():
                part = opens[:, group * size : (group + 1) * size]
                own = np.flatnonzero(part.any(axis=1))
                yield batch_of(
                    group=pa.array([group], pa.int32()), lanes=pa.array([np.flatnonzero(part.any(axis=0)).tolist()], pa.list_(pa.int32())), opens=pa.array([np.packbits(part[own], axis=1).tobytes()], pa.binary()), qids=pa.array([batch["qid"].take(pa.array(own)).to_pylist()], pa.list_(pa.int64())),
                    vecs=pa.array([[vecs[k] for k in own]], pa.list_(pa.binary())), least=pa.array([least[own].tolist()], pa.list_(pa.int64())),
                )

        return each

    return map_batches(queries, start, "group int, lanes array<int>, opens binary, qids array<bigint>, vecs array<binary>, least array<bigint>")


def best(scores: np.ndarray, least: np.ndarray, ids: list[list[int | None]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of each query's k best vectors with at least its least score: by score, then smallest id."""
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    q, v = np.nonzero(scores >= least[:, None])
    smallest = np.array([_LONG.max if i[0] is None else i[0] for i in ids])
    order = np.lexsort((smallest[v], -scores[q, v], q))
    q, v = q[order], v[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k]


def _compared(opened: DataFrame, blocks: DataFrame, size: int, k: int, id_kind: str) -> DataFrame:
    """qid, score, vec_id: the k + 1 best rows of each query in each block of the annuli that it opens, of which a group
    has `size`. A join by shuffle, whatever Spark takes the sizes for: it sees the queries once, and not as often as
    they are opened."""

    def start():
        def each(batch):
            for pair in range(batch.num_rows):
                qids, vecs, least, opens, lane, own, ids = (batch[c][pair].as_py() for c in ("qids", "vecs", "least", "opens", "lane", "vec", "ids"))
                asks = np.flatnonzero(np.unpackbits(np.frombuffer(opens, np.uint8).reshape(len(qids), -1), axis=1)[:, lane])
                qids = [qids[a] for a in asks]
                scores = products(matrix([vecs[a] for a in asks]), matrix(own))
                q, v = best(scores, np.array(least)[asks], ids, k + 1)
                out = [(qids[a], int(scores[a, b]), i) for a, b in zip(q.tolist(), v.tolist()) for i in ids[b]]
                yield batch_of(qid=pa.array([r[0] for r in out], pa.int64()), score=pa.array([r[1] for r in out], pa.int64()), vec_id=pa.array([r[2] for r in out], batch.schema.field("ids").type.value_type.value_type))

        return each

    lanes = blocks.select(F.floor(F.col("ring") / size).cast("int").alias("group"), (F.col("ring") % size).alias("lane"), "vec", "ids")
    pairs = opened.join(lanes.hint("merge"), "group").filter(F.array_contains("lanes", F.col("lane")))
    return map_batches(pairs.select("qids", "vecs", "least", "opens", "lane", "vec", "ids"), start, f"qid bigint, score bigint, vec_id {id_kind}")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Each task keeps the k + 1 best before the shuffle."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, first: int = FIRST, ring_rows: int = RING_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of embeddings(vec_id, embedding) that is a query, the k other rows
    with the largest products, all if there are fewer; ties go to the smaller vec_id, null last.

    A vector that is null or has null or non-finite components takes no part. Missing components of a shorter
    vector count as 0. Rows that repeat a vec_id are rows of their own: each searches, and only itself is
    left out. Products beyond long are cut to its range. An empty table, and one without queries, gives
    no rows; one row alone finds nothing; other columns are ignored. A vector is read whole, whatever
    its length. Results are exact: pivots, annuli and the sample only decide what is opened first.
    """
    spark = embeddings.sparkSession
    id_kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = materialize(quantised(embeddings.select("vec_id", "embedding")), "vectors")
    directory, blocks = build(materialize(entries(rows, k), "entries"), ring_rows)
    own = materialize(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec"), "query-rows")
    if directory is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score bigint")
    # a number for each different query; written, so that it stays the same
    queries = materialize(own.select("vec").distinct().select(F.monotonically_increasing_id().alias("qid"), "vec"), "queries")
    found = materialize(_top(_compared(_opened(queries, directory, first), blocks, directory.group, k, id_kind), k).drop("place"), "first")
    reached = found.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("s")).select("qid", F.when(F.col("n") > k, F.col("s")).otherwise(F.lit(_LONG.min)).alias("reached"))
    more = _compared(_opened(queries.join(reached, "qid"), directory, first), blocks, directory.group, k, id_kind)
    every = _top(found.unionByName(more), k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("found"))
    results = materialize(queries.join(every, "qid").select("vec", "found"), "results")
    # the query's own row is one of those with its id and its product with itself
    norm = materialize(_selves(results), "selves")
    joined = join_unique(own, norm, "vec", wide=True)
    return joined.select("query_id", F.posexplode(_without_own(k)).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _selves(results: DataFrame) -> DataFrame:
    """results with each vector's product with itself."""

    def start():
        def each(batch):
            m = [matrix([v]) for v in batch["vec"].to_pylist()]
            yield batch_of(vec=batch["vec"], found=batch["found"], self=pa.array([int(products(x, x)[0, 0]) for x in m], pa.int64()))

        return each

    kind = results.schema["found"].dataType.simpleString()
    return map_batches(results, start, f"vec binary, found {kind}, self bigint")


def _without_own(k: int) -> Column:
    """The first k found, without the first one that is the query's row."""
    place = F.get(F.filter("found", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == F.col("self")))["place"], F.lit(0))
    return F.slice(F.filter("found", lambda x: place.isNull() | (x["place"] != place)), 1, k)


#: DuckDB: every pair of rows.
ORACLE_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row_id, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
