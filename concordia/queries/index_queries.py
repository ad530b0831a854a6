"""Searches of the stored index, names of several words, and running values over one key."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import entities as EN, graph as GH, index as IX, joins as J, pointers as PT, scan as SC, search as S, timeline as L
from ..registry import query, table
from ..session import remove, scratch, stored
from ..sources.corpus import PARAGRAPHS_SQL as P, spread
from .search_queries import _SCORED, QUERY, pars, spread_pars
from .table_queries import MICROS

_KEPT: dict[tuple[str, str], IX.Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> IX.Index:
    """The index of a folder's documents, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        folder = f"{scratch(spark)}/concordia/index-{uuid.uuid4().hex}"
        atexit.register(remove, spark, folder)
        _KEPT[key] = IX.build(spread_pars(spark, sf_dir), folder)
    return _KEPT[key]


@query(f"{_SCORED} SELECT ref, paper, section, par, CAST(matched AS INTEGER) AS matched, CAST(hits AS INTEGER) AS hits, round(CAST(raw AS DOUBLE), 4) AS score FROM scored ORDER BY raw DESC, paper, section, par LIMIT 20")
def search_indexed(spark, sf_dir):
    """The ranked search, by ranges of the index' words instead of a scan of the texts."""
    return IX.search(index_of(spark, sf_dir), QUERY).select("ref", "paper", "section", "par", "matched", "hits", S.rounded(F.col("score")).alias("score"))


@query(P + r""", f AS (SELECT ref, len(regexp_extract_all(lower(text), '\bde\s+la\b')) AS n FROM paragraphs) SELECT ref, CAST(n AS INTEGER) AS n FROM f WHERE n > 0""")
def phrase_indexed(spark, sf_dir):
    """Every paragraph with a phrase, by the positions of its words."""
    return IX.phrase(index_of(spark, sf_dir), "de la").select("ref", "n")


_DF_TERMS = ["tion", "er", "zzz", "the", "sch"]


@query(
    P
    + ", f AS (SELECT lower(text) AS f FROM paragraphs) "
    + " UNION ALL ".join(rf"SELECT '{t}{e}' AS term, count(*) FILTER (WHERE regexp_matches(f, '\b{t}{p}')) AS df FROM f" for t in _DF_TERMS for e, p in (("*", r"\w*"), ("", r"\b")))
)
def df_indexed(spark, sf_dir):
    """In how many paragraphs a prefix (with *) and a word stand: by a range of postings, and by the dictionary alone."""
    index = index_of(spark, sf_dir)
    prefixes = IX.document_frequency(index, _DF_TERMS).withColumn("term", F.concat("term", F.lit("*")))
    return prefixes.unionByName(IX.document_frequency(index, _DF_TERMS, whole=True))


# --- names of one to four words

#: Of each item eight runs of one to four words, as they are written there.
_NAMES = r"""names AS (
  SELECT DISTINCT array_to_string(ws[8 * k + 1 : 8 * k + 1 + (item_id + k) % 4], ' ') AS name FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws, unnest(range(0, 8)) AS k FROM benchmark) WHERE len(ws) >= 8 * k + 4
)"""
_ENTITY_NAMES = (
    P
    + f""", {_NAMES},
first AS (SELECT section, min(par) AS p FROM paragraphs GROUP BY section),
t AS (
  SELECT p.ref, p.paper, p.section, p.par, chr(31) || array_to_string(regexp_extract_all(lower(p.text), '[A-Za-z0-9_]+|[^A-Za-z0-9_]'), chr(31)) || chr(31) AS f,
    chr(31) || array_to_string(regexp_extract_all(lower(h.text), '[A-Za-z0-9_]+|[^A-Za-z0-9_]'), chr(31)) || chr(31) AS h
  FROM paragraphs p JOIN first USING (section) JOIN paragraphs h ON h.section = first.section AND h.par = first.p
), hits AS (
  SELECT name, ref, paper, section, par, CAST(len(string_split(f, k)) - 1 AS INTEGER) AS n FROM t, (SELECT name, chr(31) || replace(name, ' ', chr(31) || ' ' || chr(31)) || chr(31) AS k FROM names) WHERE contains(f, k) OR contains(h, k)
)"""
)


def names_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, term, no: runs of words of the benchmark's items, which are names here."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("ws"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).filter("size(ws) >= 8 * k + 4")
    return words.select(F.array_join(F.expr("slice(ws, 8 * k + 1, cast((item_id + k) % 4 as int) + 1)"), " ").alias("name")).distinct().select("name", F.col("name").alias("term"), F.lit(0).alias("no"))


@query(_ENTITY_NAMES + " SELECT name, count(*) AS paragraphs, CAST(sum(n) AS BIGINT) AS times, min(ref) AS first_ref FROM hits GROUP BY name")
def entity_names(spark, sf_dir):
    """Hundreds of names of one to four words in texts and headings, in one scan."""
    found = EN.mentions(spread_pars(spark, sf_dir, headings=True), names_table(spark, sf_dir))
    return found.groupBy("name").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("times"), F.min("ref").alias("first_ref"))


@query(
    _ENTITY_NAMES
    + """, pins AS (SELECT name, min(ref) AS ref, 1 AS place FROM hits WHERE length(name) % 2 = 0 GROUP BY name UNION ALL SELECT name, max(ref), 2 FROM hits WHERE length(name) % 2 = 0 GROUP BY name HAVING max(ref) <> min(ref) UNION ALL SELECT name, '99:1.1', 0 FROM names WHERE length(name) % 3 = 0),
chosen AS (SELECT name, ref, row_number() OVER (PARTITION BY name ORDER BY place) AS place FROM pins p WHERE EXISTS (SELECT 1 FROM hits h WHERE h.name = p.name AND h.ref = p.ref)),
free AS (SELECT * FROM hits WHERE name NOT IN (SELECT name FROM pins)),
home AS (SELECT name, paper FROM (SELECT name, paper, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, paper) AS r FROM free GROUP BY name, paper) WHERE r = 1),
o AS (SELECT h.*, row_number() OVER (PARTITION BY name ORDER BY section, par) AS f FROM free h JOIN home USING (name, paper)),
d AS (SELECT *, row_number() OVER (PARTITION BY name, f = 1 ORDER BY n DESC, section, par) AS d FROM o)
SELECT name, ref, CAST(place AS INTEGER) AS place FROM chosen UNION ALL SELECT name, ref, CAST(row_number() OVER (PARTITION BY name ORDER BY section, par) AS INTEGER) FROM d WHERE f = 1 OR d <= 2"""
)
def entity_pins(spark, sf_dir):
    """The entity index with pins: valid ones in their order, no other reference for a name that has pins."""
    names = names_table(spark, sf_dir)
    found = stored(EN.mentions(spread_pars(spark, sf_dir, headings=True), names), "named")
    even = found.filter("length(name) % 2 = 0").groupBy("name").agg(F.min("ref").alias("a"), F.max("ref").alias("b"))
    pins = even.select("name", F.col("a").alias("ref"), F.lit(1).alias("place")).unionByName(even.filter("a != b").select("name", F.col("b").alias("ref"), F.lit(2).alias("place")))
    pins = pins.unionByName(names.filter("length(name) % 3 = 0").select("name", F.lit("99:1.1").alias("ref"), F.lit(0).alias("place")))
    return EN.entity_index(found, pins)


# --- one key


@query(
    """WITH e AS (SELECT event_id, ts, value > 50 AS hit, value, CASE WHEN event_type = 'click' THEN event_id END AS click FROM events), i AS (SELECT *, sum((NOT hit)::INT) OVER (ORDER BY ts, event_id) AS island FROM e)
SELECT event_id, CAST(sum(hit::INT) OVER (PARTITION BY island ORDER BY ts, event_id) AS BIGINT) AS streak, CAST(sum(hit::INT) OVER o AS BIGINT) AS score, max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest,
  last_value(click IGNORE NULLS) OVER o AS last_click, first_value(click IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_click FROM i WINDOW o AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def running_one_key(spark, sf_dir):
    """All events as the rows of one key, in segments: score, streak, highest value before, last and next click."""
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type"))
    rows = SC.with_running(e, [], ["ts", "event_id"], {"highest": SC.Running("max", F.col("value"), own=False), "last_click": SC.Running("last", click), "next_click": SC.Running("last", click, back=True)})
    return L.streaks(rows, [], ["ts", "event_id"], F.col("value") > 50).select("event_id", "streak", "score", "highest", "last_click", "next_click")


# --- spans of any length


@query(
    """WITH s AS (SELECT s_suppkey, s_suppkey * 600 AS low, s_suppkey * 600 + CAST(floor(abs(s_acctbal)) AS BIGINT) AS high FROM supplier)
SELECT o_orderkey, count(*) AS spans, min(s_suppkey) AS first_span FROM orders JOIN s ON o_orderkey BETWEEN low AND high GROUP BY o_orderkey"""
)
def join_wide_spans(spark, sf_dir):
    """The spans that hold an order's key, thousands of keys wide, by dyadic nodes and a join by equality."""
    low = F.col("s_suppkey") * 600
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), (low + F.floor(F.abs("s_acctbal"))).alias("high"))
    found = J.in_spans(table(spark, sf_dir, "orders").select("o_orderkey"), spans, "o_orderkey", "low", "high")
    return found.groupBy("o_orderkey").agg(F.count("*").alias("spans"), F.min("s_suppkey").alias("first_span"))


# --- chains of links

_LINKS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN c_custkey + 5 WHEN c_custkey > c_nationkey + 1 THEN c_custkey - c_nationkey - 1 END AS next FROM customer"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 97 == 0, c + 5).when(c > n + 1, c - n - 1).alias("next"))


@query(
    f"""WITH RECURSIVE l AS (SELECT * FROM ({_LINKS}) WHERE next IS NOT NULL), r AS (SELECT id, next AS node FROM l UNION SELECT r.id, l.next FROM r JOIN l ON l.id = r.node)
SELECT id, max(node) FILTER (WHERE node NOT IN (SELECT id FROM l)) AS "end", CASE WHEN count(*) FILTER (WHERE node NOT IN (SELECT id FROM l)) > 0 THEN count(*) END AS steps, count(*) FILTER (WHERE node NOT IN (SELECT id FROM l)) = 0 AS loops FROM r GROUP BY id"""
)
def chain_ends(spark, sf_dir):
    """Each customer points at another: where its chain ends after how many links, or whether it runs into a loop."""
    return PT.chains(_links(spark, sf_dir))


@query(
    """WITH RECURSIVE m AS (SELECT DISTINCT epoch_us(ts) AS mark FROM events), k AS (SELECT min(mark) AS mark FROM m UNION ALL SELECT (SELECT min(m.mark) FROM m WHERE m.mark >= k.mark + 3600000000) FROM k WHERE k.mark IS NOT NULL)
SELECT mark FROM k WHERE mark IS NOT NULL"""
)
def thinned_one_key(spark, sf_dir):
    """Marks at least an hour after the last kept one over all events as one key, by doubled links."""
    return PT.kept_marks(table(spark, sf_dir, "events").select(F.expr(MICROS).alias("mark")), [], "mark", 3_600_000_000)


_KINDS = "CASE o_orderkey % 3 WHEN 0 THEN 'spouse' WHEN 1 THEN 'parent' END"


@query(
    f"""WITH n AS (SELECT c_custkey AS id, c_custkey // 20 AS tree FROM customer), e AS (SELECT o_custkey AS a, o_custkey + o_orderkey % 7 AS b, {_KINDS} AS kind FROM orders),
p AS (SELECT x.tree, count(*) AS parents FROM e JOIN n x ON x.id = e.a JOIN n y ON y.id = e.b AND y.tree = x.tree WHERE kind IS DISTINCT FROM 'spouse' GROUP BY x.tree)
SELECT tree, count(*) AS persons, coalesce(any_value(parents), 0) AS parents FROM n LEFT JOIN p USING (tree) GROUP BY tree"""
)
def graph_trees(spark, sf_dir):
    """How many persons and parent edges each tree has; an edge without a kind is one of a parent."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 20").alias("tree"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.expr("o_custkey + o_orderkey % 7").alias("b"), F.expr(_KINDS).alias("kind"))
    return GH.trees(nodes, edges)
