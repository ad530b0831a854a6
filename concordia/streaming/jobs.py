"""Streams: requests by line, the log of missed questions, history of conversations, latest progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

QUESTION_CHARS, PAGE_CHARS = 500, 200


def requests(lines: DataFrame) -> DataFrame:
    """lines(value) of JSON: id, method, params as text; a line that is no request has an error."""
    parsed = F.from_json("value", "id STRING, method STRING, params MAP<STRING, STRING>")
    rows = lines.filter(F.trim("value") != "").select("value", parsed.alias("r"))
    return rows.select("r.id", "r.method", "r.params", F.when(F.col("r.method").isNull(), F.concat(F.lit("not a request: "), F.substring("value", 1, 80))).alias("error"))


def serve(lines: DataFrame, tools: dict[str, Callable[[SparkSession, dict], DataFrame]], sink: Callable[[str, DataFrame | None, str | None], None], checkpoint: str) -> StreamingQuery:
    """Answer a stream of requests: one batch of lines at a time, bad lines as errors. Requests are small and
    few; their answers are DataFrames that the sink writes."""

    def batch(rows: DataFrame, _: int) -> None:
        for r in requests(rows).toLocalIterator():
            if r.error or r.method not in tools:
                sink(r.id, None, r.error or f"unknown tool {r.method}")
            else:
                sink(r.id, tools[r.method](rows.sparkSession, r.params or {}), None)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missed(rows: DataFrame) -> DataFrame:
    """rows(question, page, at) cut to the log's lengths, blank questions dropped."""
    return rows.filter(F.trim("question") != "").select(F.substring("question", 1, QUESTION_CHARS).alias("question"), F.substring("page", 1, PAGE_CHARS).alias("page"), "at")


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return missed(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour and event_type. In update or append mode, rows later than `late` behind the newest are dropped
    once their hour closed, and its state with them."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    counts = at.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run a windowed aggregate over what is there now and return its rows. The stream updates: a batch writes the
    groups that it changed, under its number, so that a batch that runs again overwrites itself, and state behind
    the watermark goes. A group's row is that of its last batch."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v")).select(*keys, "__v.*")


def pages_of(turns: DataFrame, size: int = 10) -> DataFrame:
    """turns(conv_id, turn, text, intent): conv_id, turn, asked, first, last of each turn that asks for more: the
    last question before it, and the places of its answer that come next."""
    order = W.partitionBy("conv_id").orderBy("turn")
    is_more = F.col("intent").eqNullSafe("more")
    rows = turns.select("conv_id", "turn", F.last(F.when(~is_more, F.col("text")), ignorenulls=True).over(order).alias("asked"), is_more.alias("more"), F.sum((~is_more).cast("int")).over(order).alias("question"))
    page = F.row_number().over(W.partitionBy("conv_id", "question").orderBy("turn")) - F.when(F.col("question") > 0, 1).otherwise(0)
    rows = rows.withColumn("page", page.cast("long")).filter(F.col("more") & F.col("asked").isNotNull())
    return rows.select("conv_id", "turn", "asked", (F.col("page") * size + 1).alias("first"), ((F.col("page") + 1) * size).alias("last"))


def history(turns: DataFrame, k: int = 3) -> DataFrame:
    """turns(conv_id, turn, role, text): each turn with the texts of up to k turns before it, oldest first."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-k, -1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list("text").over(before), "\n").alias("history"))


def latest(updates: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key: an aggregate that combines before the shuffle, and also runs as a stream."""
    return updates.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
