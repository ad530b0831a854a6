"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed number of bytes. The different blocks are sorted
and each gets an integer name, its place in that order: partitions of the sorted blocks are numbered
within themselves, with the partition's number in the upper bits. Adjacent names are then paired (one
that is left over at the end with -1), the different pairs sorted and named in the same way, level
by level, until each document has one name. Names of a level are equal exactly if their contents are,
so (level, name) is a document's identity and no hash takes part in it.

A block's order is by (64-bit hash, bytes). Blocks cross the network once, after a map-side
distinct, and documents look names up by the hash alone; only if different blocks share a hash, which
is looked for at every run, do the blocks of these hashes cross again to be told apart by content.
Nothing is collected but the number of levels and whether there is such a hash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns_of, materialize, release, unused

#: Bytes of a block.
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of x20 and x09-x0D as one space; null as the empty text. A lone x20 already is one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _blocks(data: Column, size: int) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _numbered(different: DataFrame, by: list[str], keep: list[str], name: str) -> DataFrame:
    """Rows in sorted order within partitions, and their integer names. Written, as names must not change."""
    return materialize(different.sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("name")), name)


def _block_names(different: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """different(h, block): (h, name) of each, and (h, block, name) of those that share their hash, if any do."""
    names = _numbered(different, ["h", "block"], ["h"], "block-names")
    shared = names.groupBy("h").count().filter("count > 1").select("h")
    if shared.isEmpty():
        return names, None
    shared = materialize(shared, "shared-hashes")
    # the k-th block of a hash, by content, has the hash's k-th name
    kth = lambda df, by: df.join(shared, "h", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy(by)))
    told = kth(different, "block").join(kth(names, "name"), ["h", "k"]).select("h", "block", "name")
    return names.join(shared, "h", "left_anti"), materialize(told, "told-apart")


def identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hashed: Callable[..., Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """rows(row, doc_id, text_sha256), one for each row of documents(doc_id, text), and names(row, doc_id,
    level, name): rows have equal normalised texts exactly if level and name are equal.

    hashed may be any hash to a long. A null text counts as empty, which is one empty block; an empty
    table gives no rows; rows that repeat are named alike.
    """
    data = documents.select("doc_id", normalised(F.col("text")).cast("binary").alias("data"))
    h = lambda block: hashed(block).cast("long").alias("h")
    different = data.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block")).select(h(F.col("block")), "block").distinct()
    names, told = _block_names(different)
    bytes_of = lambda b: (b if told else F.lit(None).cast("binary")).alias("block")
    parts = F.transform(_blocks(F.col("data"), block_bytes), lambda b: F.struct(h(b), bytes_of(b)))
    rows = materialize(data.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("data", 256).alias("text_sha256"), parts.alias("parts")), "rows")
    level = rows.select("row", "doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "part")).select("row", "doc_id", "n", "pos", "part.h", "part.block")
    named = level.drop("block").join(names, "h").drop("h")
    if told:
        named = named.unionByName(level.join(told, ["h", "block"]).drop("h", "block"))
    level = materialize(named, "level")
    most, levels = rows.agg(F.max(F.size("parts"))).head()[0] or 1, [level]
    while most > 1:
        place = F.expr("pos div 2").cast("int").alias("pos")
        first, last = F.min(F.struct("pos", "name"))["name"], F.max(F.struct("pos", "name"))["name"]
        pairs = level.filter("n > 1").groupBy("row", "doc_id", F.expr("(n + 1) div 2").cast("int").alias("n"), place).agg(first.alias("a"), F.when(F.count(F.lit(1)) == 2, last).otherwise(F.lit(-1)).alias("b"))
        pairs = materialize(pairs, "pairs")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "pair-names")
        level = materialize(pairs.join(names, ["a", "b"]).select("row", "doc_id", "n", "pos", "name"), "level")
        release(pairs, names)
        levels.append(level)
        most = -(-most // 2)
    done = [t.filter("n = 1").select("row", "doc_id", F.lit(k).alias("level"), "name") for k, t in enumerate(levels)]
    return rows.select("row", "doc_id", "text_sha256"), reduce(DataFrame.unionByName, done)


def exact_duplicates(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of x20 and x09-x0D by one space; null
    counts as empty. keep_id is the smallest doc_id of the group (null ids only if all are null) and
    kept says whether the row has it; rows that repeat a doc_id with its text are one document twice:
    group_size counts both and both are kept. An empty table gives no rows. Other columns are ignored.
    Groups are counted before the shuffle, and the few numbers of each go back to its rows in a join
    that Spark may split.
    """
    rows, names = identities(documents, block_bytes, hashed)
    groups = names.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.filter("group_size > 1"), "groups")
    several = names.join(groups, ["level", "name"]).select("row", "keep_id", "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        rows.join(several, "row", "left")
        .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def keep_first(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called: of equal texts the row
    with the smallest doc_id, and of rows that repeat a doc_id with an equal text one (the least text; of
    equal texts the one whose columns hash least, so a task that runs again keeps the same). Null texts
    count as empty, a null doc_id stays only if all of its group are null; an empty table stays empty.
    """
    found = materialize(exact_duplicates(documents, block_bytes).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept"), "found")
    sha = unused(documents, "sha")
    rows = documents.withColumn(sha, F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.id")) & (F.col(f"d.{sha}") == F.col("f.sha"))
    # the texts cross the network once, for the rows that go; again only the few that repeat a doc_id
    stay = rows.join(found.filter("not kept").select("id", "sha").distinct().alias("f"), same, "left_anti")
    again = found.filter("kept").groupBy("id", "sha").count().filter("count > 1").select("id", "sha")
    if not again.isEmpty():
        again, whole = again.alias("f"), F.struct(*columns_of(documents)).alias("whole")
        hashable = [c for c, f in zip(columns_of(documents), documents.schema.fields) if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "void"))]
        twice = stay.alias("d").join(again, same, "left_semi").select(F.col("doc_id").alias("id"), F.col(sha).alias("sha"), whole, F.struct("text", F.xxhash64(*hashable)).alias("by"))
        once = twice.groupBy("id", "sha").agg(F.min_by("whole", "by").alias("whole")).select("whole.*")
        stay = stay.alias("d").join(again, same, "left_anti").drop(sha).unionByName(once)
        return stay
    return stay.drop(sha)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
