"""Citations, joins, aggregates, windows and set operations over the star schema and the corpus."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import refs as R, text as T
from ..operators import anchors as AN, ask as ASK, joins as J, recall as RC, rules as RL, timeline as L
from ..registry import query, table
from ..sources.corpus import PARAGRAPHS_SQL as P, spread
from .search_queries import GROUPS, java, pars, spread_pars

#: Microseconds since the epoch of events.ts, in no time zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"

# --- citations

_MADE = "l_linenumber || ':' || l_suppkey % 9 || '.' || CAST(l_quantity AS BIGINT) || CASE l_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '-' || l_partkey % 100 WHEN 2 THEN ' through ' || l_partkey % 60 WHEN 3 THEN '–' || (l_suppkey % 9 + 1) || '.' || l_partkey % 9 WHEN 4 THEN '; ' || l_linenumber || ':2.' || l_partkey % 30 ELSE ' to ' || l_linenumber || ':' || l_suppkey % 9 || '.' || (CAST(l_quantity AS BIGINT) + 3) END"


def citations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.expr(_MADE).alias("cite")).distinct()


#: The references of each citation, from the numbers that it was made of.
_CITES = f"""
WITH c AS (
  SELECT DISTINCT {_MADE} AS cite, l_orderkey % 6 AS kind, l_linenumber AS p, l_suppkey % 9 AS s, CAST(l_quantity AS BIGINT) AS a,
    CASE l_orderkey % 6 WHEN 1 THEN l_partkey % 100 WHEN 2 THEN l_partkey % 60 WHEN 3 THEN l_partkey % 9 WHEN 4 THEN l_partkey % 30 WHEN 5 THEN CAST(l_quantity AS BIGINT) + 3 END AS b FROM lineitem
), e AS (
  SELECT cite, CASE WHEN kind = 3 THEN [p || ':' || s || '.' || a, p || ':' || (s + 1) || '.' || b] WHEN kind = 4 THEN [p || ':' || s || '.' || a, p || ':2.' || b]
    WHEN b BETWEEN a AND a + 40 THEN list_transform(range(a, b + 1), lambda x: p || ':' || s || '.' || x) ELSE [p || ':' || s || '.' || a] END AS refs FROM c
)"""


@query(f"{_CITES}, r AS (SELECT cite, unnest(refs) AS ref FROM e) SELECT cite, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM r GROUP BY cite")
def citation_expand(spark, sf_dir):
    """Ranges up to 40 steps, lists, reversed ranges and ranges across sections."""
    return citations(spark, sf_dir).select("cite", F.array_join(F.array_sort(R.expand_citation(F.col("cite"))), ",").alias("refs"))


_PLAIN = "l_linenumber || ':0' || l_suppkey % 9 || '.' || CAST(l_quantity AS BIGINT) || CASE WHEN l_orderkey % 2 = 0 THEN '-' || l_partkey % 100 ELSE '' END"


@query(
    f"""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 2 = 0 THEN greatest(l_partkey % 100 - CAST(l_quantity AS BIGINT), 0) + 1 ELSE 1 END AS INTEGER) AS n,
  l_linenumber || ':' || l_suppkey % 9 || '.' || CAST(l_quantity AS BIGINT) AS first_ref FROM lineitem"""
)
def cited_refs(spark, sf_dir):
    """Ranges without a cap and leading zeros dropped."""
    refs = R.cited_refs(F.expr(_PLAIN))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.size(refs).alias("n"), refs[0].alias("first_ref"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN l_linenumber || ':1.' || l_partkey WHEN 1 THEN l_linenumber || ':1.' || l_partkey || ',' || l_linenumber || ':2.3' WHEN 2 THEN 'page' || l_partkey ELSE '' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 < 2 THEN replace(v, ',', '|') END AS refs, CASE l_orderkey % 4 WHEN 2 THEN 'not a reference: ' || v WHEN 3 THEN 'no reference given' END AS error FROM s"""
)
def ref_param(spark, sf_dir):
    """A link's references, all or an error."""
    v = F.expr("case l_orderkey % 4 when 0 then l_linenumber || ':1.' || l_partkey when 1 then l_linenumber || ':1.' || l_partkey || ',' || l_linenumber || ':2.3' when 2 then 'page' || l_partkey else '' end")
    got = R.parse_ref_param(F.concat(F.lit("?lang=en&ref="), v))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(got["refs"], "|").alias("refs"), got["error"].alias("error"))


@query(
    """SELECT o_orderkey, o_custkey % 40 || ':' || o_orderkey % 9 || '.' || o_custkey AS citation, 'as said ' || ' there' AS rest FROM orders"""
)
def citation_in_text(spark, sf_dir):
    made = F.expr("'as said (' || o_custkey % 40 || ':' || o_orderkey % 9 || '.' || o_custkey || ') there'")
    got = R.extract_citation(made)
    return table(spark, sf_dir, "orders").select("o_orderkey", got["citation"].alias("citation"), got["rest"].alias("rest"))


@query(
    P
    + """, span AS (SELECT section, min(par) + 1 AS lo, min(par) + 4 AS hi FROM paragraphs GROUP BY section)
SELECT p.ref, p.section, p.par FROM paragraphs p JOIN span s ON p.section = s.section AND p.par BETWEEN s.lo AND s.hi"""
)
def range_expand(spark, sf_dir):
    """Ranges by position: an equality on the section and a band on the position."""
    p = pars(spark, sf_dir)
    span = p.groupBy("section").agg((F.min("par") + 1).alias("lo"), (F.min("par") + 4).alias("hi"))
    return p.join(span, "section").filter("par between lo and hi").select("ref", "section", "par")


# --- joins

@query(
    P
    + """, cited AS (SELECT DISTINCT 'D' || item_id AS draft, paper || ':' || section || '.' || n AS ref FROM (SELECT item_id, CAST(item_id % 20 AS INTEGER) AS paper, item_id AS section, unnest(range(1, 9)) AS n FROM benchmark))
SELECT draft, c.ref, p.ref IS NULL AS missing FROM cited c LEFT JOIN paragraphs p ON p.ref = c.ref"""
)
def refs_resolved(spark, sf_dir):
    """Left outer: which cited references exist."""
    cited = table(spark, sf_dir, "benchmark").select(F.expr("'D' || item_id").alias("draft"), F.explode(F.expr("transform(sequence(1, 8), n -> cast(item_id % 20 as int) || ':' || item_id || '.' || n)")).alias("ref")).distinct()
    known = pars(spark, sf_dir).select("ref", F.lit(True).alias("there"))
    return cited.join(known, "ref", "left").select("draft", "ref", F.col("there").isNull().alias("missing"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti_unresolved(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def join_semi_valid(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").filter("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


_KEYS = "(VALUES ('3'), ('5-8'), ('12:12.1'), ('12:32.2'), ('nothing')) k(key)"


@query(
    P
    + f""", required AS (SELECT ref, paper FROM paragraphs WHERE regexp_matches(lower(text), '\\btion\\w*'))
SELECT ref, paper FROM required r WHERE NOT EXISTS (SELECT 1 FROM {_KEYS} WHERE key = r.ref OR key = CAST(paper AS VARCHAR) OR (regexp_matches(key, '^[0-9]+-[0-9]+$') AND paper BETWEEN CAST(split_part(key, '-', 1) AS INTEGER) AND CAST(split_part(key, '-', 2) AS INTEGER)))"""
)
def join_anti_unread(spark, sf_dir):
    """Required paragraphs that a read log doesn't cover, by reference, whole paper or span of papers."""
    required = pars(spark, sf_dir).filter(F.lower("text").rlike(T.prefix_pattern("tion"))).select("ref", "paper")
    keys = spark.createDataFrame([("3",), ("5-8",), ("12:12.1",), ("12:32.2",), ("nothing",)], "key string")
    return J.not_covered(required, keys)


@query(P + "SELECT p.ref, g.id FROM paragraphs p, (VALUES " + ", ".join(f"('{a}', '{c}')" for a, _, c in GROUPS) + ") g(id, book) WHERE regexp_matches(lower(p.text), g.book)")
def join_theta_regex(spark, sf_dir):
    """Paragraphs and rule patterns that match them: the rules are unrolled into one scan."""
    return RC.required(spread_pars(spark, sf_dir), [RC.Group(a, java(b), java(c)) for a, b, c in GROUPS]).select("ref", "id")


@query("SELECT conv_id, turn, g.id FROM conversations, (VALUES ('tionre', 'r'), ('thand', 't'), ('ing', 'g')) g(phrase, id) WHERE contains(lower(text), phrase)")
def term_map_match(spark, sf_dir):
    """Mapped terms of every turn, by containment of their phrases."""
    rules = [("tionre", "r"), ("thand", "t"), ("ing", "g")]
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(p)), i) for p, i in rules]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(hits).alias("id"))


@query(
    r"""WITH n AS (SELECT item_id, ' ' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ') || ' ' AS needle FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ') || ' ' AS words FROM documents)
SELECT item_id, doc_id FROM n, d WHERE contains(words, needle)"""
)
def join_containment(spark, sf_dir):
    """Needles inside texts as whole words: equality of a needle's rarest four words, then a recheck."""
    return AN.containment(table(spark, sf_dir, "benchmark").select("item_id", "text"), spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "item_id", "doc_id")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, event_type FROM events)
SELECT a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts - INTERVAL 10 MINUTE AND b.ts <= a.ts + INTERVAL 10 MINUTE"""
)
def join_interval(spark, sf_dir):
    """Events of one user within ten minutes of another: equality on time buckets, then the band."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(MICROS).alias("t"), "event_type")
    a = e.filter("event_type = 'click'").select(F.col("event_id").alias("a_id"), "user_id", F.col("t").alias("a_t"))
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("b_id"), "user_id", F.col("t").alias("b_t"))
    return J.band_join(a, b, ["user_id"], "a_t", "b_t", 600_000_000).select("a_id", "b_id")


@query(
    """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT c.event_id, v.event_id AS view_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts"""
)
def join_as_of(spark, sf_dir):
    """The latest view at or before each click of a user, by one window over both."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return J.as_of(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "user_id", "ts", "event_id").select("event_id", F.col("right_event_id").alias("view_id"))


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey + 6 AS until FROM orders WHERE o_orderpriority = '1-URGENT'), q AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1)
SELECT l_orderkey, o_orderkey FROM (SELECT l_orderkey, o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY o_orderkey) AS n FROM q JOIN s ON l_orderkey BETWEEN o_orderkey AND until) WHERE n = 1"""
)
def join_point_in_span(spark, sf_dir):
    """The first span that holds a point: spans of at most 7 keys are dealt to their keys, so the join is by equality."""
    spans = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.explode(F.sequence(F.col("o_orderkey"), F.col("o_orderkey") + 6)).alias("l_orderkey"))
    points = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey")
    return points.join(spans, "l_orderkey").groupBy("l_orderkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query(
    """WITH n AS (SELECT l_suppkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT l_suppkey, o_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, o_custkey) AS r FROM n) WHERE r = 1"""
)
def best_overlap(spark, sf_dir):
    """For each supplier the customer with most common rows; the argmax is an aggregate."""
    n = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.max_by(F.struct("o_custkey", "n"), F.struct("n", -F.col("o_custkey"))).alias("x")).select("l_suppkey", "x.o_custkey", "x.n")


@query(
    P
    + """, t AS (SELECT ref, 'en: ' || text AS text FROM paragraphs WHERE par % 2 = 0)
SELECT p.ref, coalesce(t.text, p.text) AS text, t.ref IS NULL AS fallback FROM paragraphs p LEFT JOIN t ON p.ref = t.ref"""
)
def translation_fallback(spark, sf_dir):
    en = pars(spark, sf_dir)
    return J.with_fallback(en.select("ref", "text"), en.filter("par % 2 = 0").select("ref", F.concat(F.lit("en: "), F.col("text")).alias("text")))


_TOPICS = "(VALUES (1, 'thes'), (2, 'tion'), (3, 'ing'), (4, 'ers'), (5, 'andthe')) t(id, name)"


@query(
    rf"""WITH w AS (SELECT DISTINCT conv_id, turn, regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z]+')), 's$', '') AS word FROM conversations),
h AS (SELECT conv_id, turn, id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY id) AS n FROM w JOIN (SELECT id, regexp_replace(name, 's$', '') AS word FROM {_TOPICS}) USING (word))
SELECT conv_id, turn, id FROM h WHERE n <= 2"""
)
def topics_of_questions(spark, sf_dir):
    """Topics named in each turn, plurals folded, at most two of them."""
    topics = spark.createDataFrame([(1, "thes"), (2, "tion"), (3, "ing"), (4, "ers"), (5, "andthe")], "id int, name string")
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w"))
    words = words.select("conv_id", "turn", T.singular(F.col("w")).alias("word")).distinct()
    hits = words.join(F.broadcast(topics.select("id", T.singular(F.col("name")).alias("word"))), "word")
    return hits.groupBy("conv_id", "turn").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 2).alias("ids")).select("conv_id", "turn", F.explode("ids").alias("id"))


@query(
    """WITH t AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red wid' THEN 1 WHEN lower(p_brand) = 'red wid' THEN 2 WHEN starts_with(lower(p_name), 'red') THEN 3 WHEN contains(lower(p_name), 'wid') THEN 4 END AS tier FROM part)
SELECT p_partkey, p_name, tier FROM t WHERE tier = (SELECT min(tier) FROM t)"""
)
def tiered_lookup(spark, sf_dir):
    """Exact name, exact alias, prefix, substring: only the best tier that has rows."""
    return J.best_tier(table(spark, sf_dir, "part"), "red wid", ["p_name"], ["p_brand"], "wid").select("p_partkey", "p_name", "tier")


@query("(SELECT c_custkey % 60 AS k, 'left' AS side FROM customer EXCEPT SELECT s_suppkey % 50 + 20, 'left' FROM supplier) UNION ALL (SELECT s_suppkey % 50 + 20, 'right' FROM supplier EXCEPT SELECT c_custkey % 60, 'right' FROM customer)")
def symmetric_difference(spark, sf_dir):
    return J.symmetric_difference(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 60).alias("k")), table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50 + 20).alias("k")))


@query("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def union_distinct(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderpriority = '1-URGENT'").select("o_custkey").union(o.filter("o_totalprice > 400000").select("o_custkey")).distinct()


@query("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def intersect_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderpriority = '1-URGENT'").select("o_custkey").intersect(o.filter("o_orderpriority = '5-LOW'").select("o_custkey"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ',') AS numbers FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) > 0")
def number_sets(spark, sf_dir):
    """The different numbers of each text, by array_distinct and array_except."""
    found = F.array_sort(F.array_except(F.regexp_extract_all("text", F.lit("([0-9]+)")), F.array().cast("array<string>")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("numbers")).filter("numbers != ''")


# --- aggregates

@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, round(sum((8 - i) / 32.0 + o_totalprice / 1000000), 6) AS score FROM o WHERE i < 8 GROUP BY o_custkey"""
)
def positional_scores(spark, sf_dir):
    """Each query's best rows with the bonus (limit - place) / (4 * limit), summed."""
    scores = RL.place_bonus(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 8, F.col("o_totalprice") / 1000000)
    return scores.select("o_custkey", F.round("score", 6).alias("score"))


@query(
    """WITH n AS (SELECT l_suppkey, count(*) FILTER (WHERE l_discount >= 0.05) AS hits FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN hits <= 330 THEN 2.0::DOUBLE WHEN l_quantity > 45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM lineitem JOIN n USING (l_suppkey) WHERE l_discount >= 0.05"""
)
def gated_boost(spark, sf_dir):
    """A boost for all hits of a group if they are few, else only for those that score otherwise."""
    hits = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.05").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return RL.gated_boosts(hits, "l_suppkey", 330, 2.0, 1.0, F.col("l_quantity") > 45).select("l_suppkey", "l_orderkey", "l_linenumber", "boost")


@query(
    r"""WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark)
SELECT word, count(*) AS df, round(1 / ln(count(*)::DOUBLE / any_value(n) * 1000 + 2), 6) AS weight FROM t, n GROUP BY word"""
)
def idf_weights(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    words = b.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))).alias("word"))
    n = b.agg(F.count("*").alias("n"))
    return words.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", "df", F.round(1 / F.ln(F.col("df") / F.col("n") * 1000 + 2), 6).alias("weight"))


@query("SELECT word, paper, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, paper) AS r FROM (SELECT word, paper, count(*) AS n FROM (" + P + r" SELECT paper, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM paragraphs) GROUP BY word, paper)) WHERE r = 1 AND n > 1")
def home_paper(spark, sf_dir):
    words = pars(spark, sf_dir).select("paper", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"))).alias("word"))
    n = words.groupBy("word", "paper").agg(F.count("*").alias("n"))
    return n.groupBy("word").agg(F.max_by(F.struct("paper", "n"), F.struct("n", -F.col("paper"))).alias("x")).select("word", "x.paper", "x.n").filter("n > 1")


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, count(DISTINCT user_id) AS users, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events")
def coverage_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return e.agg(F.count("*").alias("entries"), kind("click").alias("clicks"), kind("view").alias("views"), F.count_distinct("user_id").alias("users"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT o_custkey % 10 AS bucket, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def status_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("bucket", F.col("o_custkey") % 10)
    return o.groupBy("bucket").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0, ["F", "O", "P"])


@query("SELECT source, CAST(sum(quality) AS BIGINT) AS points, round(100.0 * sum(quality) / count(*), 2)::DOUBLE AS pct, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source")
def bench_totals(spark, sf_dir):
    """Points and per cent of each source; labels carry the flags."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.sum("quality").alias("points"), F.round(100 * F.sum("quality") / F.count("*"), 2).alias("pct"), F.sum("toxic").alias("toxic"))


@query("SELECT event_type, round(avg((value > 50)::INT), 6) AS exact_rate, round(min(value), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def alignment_stats(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg((v > 50).cast("int")), 6).alias("exact_rate"), F.round(F.min(v), 6).alias("low"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.avg(v), 6).alias("mean"))


@query(
    """SELECT user_id, count(*) AS n, round(count(*) * 3600000000.0 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6)::DOUBLE AS rate FROM events GROUP BY user_id
HAVING epoch_us(max(ts)) > epoch_us(min(ts)) AND count(*) * 3600000000.0 / (epoch_us(max(ts)) - epoch_us(min(ts))) NOT BETWEEN 0.001 AND 0.02"""
)
def speaking_rate(spark, sf_dir):
    """Rates outside their bounds: count over the span of time."""
    span = F.max(F.expr(MICROS)) - F.min(F.expr(MICROS))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), span.alias("span")).filter("span > 0")
    g = g.withColumn("rate", F.col("n") * 3600000000.0 / F.col("span"))
    return g.filter("rate not between 0.001 and 0.02").select("user_id", "n", F.round("rate", 6).alias("rate"))


@query("SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicates_by_name(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).filter("n > 1")


@query(
    P
    + r""", w AS (SELECT DISTINCT ref, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{3,}\b')) AS name FROM paragraphs), low AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[a-z]{4,}\b')) AS word FROM paragraphs)
SELECT name, count(*) AS n FROM w WHERE lower(name) NOT IN (SELECT word FROM low) GROUP BY name HAVING count(*) BETWEEN 1 AND 40"""
)
def rare_names(spark, sf_dir):
    """Capitalised words of at most 40 paragraphs that never come in lower case."""
    return RL.names_without_plain_use(pars(spark, sf_dir), "ref", 40)


@query(
    """WITH d AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS done FROM orders)
SELECT o_custkey, round(100.0 * count(*) FILTER (WHERE done) / count(*))::INTEGER AS pct, min(o_orderkey) FILTER (WHERE NOT done) AS next_day FROM d GROUP BY o_custkey"""
)
def reading_progress(spark, sf_dir):
    """Per cent done and the first item that isn't."""
    return RL.progress(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").withColumnRenamed("next_item", "next_day")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, value > 50 AS hit FROM events), i AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e)
SELECT event_id, user_id, CAST(sum(hit::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak, CAST(sum(hit::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS score FROM i"""
)
def quiz_streaks(spark, sf_dir):
    """Running score, and a streak that a miss resets."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return L.streaks(e, ["user_id"], ["ts", "event_id"], F.col("value") > 50).select("event_id", "user_id", "streak", "score")


@query(
    """WITH v AS (SELECT o_custkey, o_orderkey % 4 AS major, o_orderkey // 4 % 10 AS minor, o_orderkey // 40 AS patch FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY major DESC, minor DESC, patch DESC) AS n FROM v) SELECT o_custkey, 'v' || major || '.' || minor || '.' || patch AS newest FROM r WHERE n = 1"""
)
def newest_version(spark, sf_dir):
    """The largest published version: parts compare as numbers, not as text."""
    tag = F.expr("'desktop-v' || o_orderkey % 4 || '.' || (o_orderkey div 4) % 10 || '.' || o_orderkey div 40")
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_custkey", tag.alias("tag"))
    return RL.newest_version(rows, "o_custkey", "tag").withColumn("newest", F.regexp_replace("newest", "^desktop-", ""))


@query(
    r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:p|h1|li)>[^<]*')) AS b FROM pages), c AS (SELECT page_id, regexp_extract(b, '<(p|h1|li)>', 1) AS tag, sum(length(regexp_replace(b, '<[^>]*>', '', 'g'))) AS n FROM b GROUP BY 1, 2)
SELECT page_id, tag, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, tag DESC) AS r FROM c) WHERE r = 1"""
)
def largest_container(spark, sf_dir):
    blocks = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(<(?:p|h1|li)>[^<]*)"))).alias("b"))
    c = blocks.groupBy("page_id", F.regexp_extract("b", "<(p|h1|li)>", 1).alias("tag")).agg(F.sum(F.length(F.regexp_replace("b", "<[^>]*>", ""))).alias("n"))
    return c.groupBy("page_id").agg(F.max_by(F.struct("tag", "n"), F.struct("n", "tag")).alias("x")).select("page_id", "x.tag", "x.n")


# --- windows

@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_extendedprice >= 1000) WHERE n <= 3")
def top_k_per_query(spark, sf_dir):
    """Top three above a threshold; Spark limits each group before the shuffle."""
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").filter("l_extendedprice >= 1000").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN n <= 5 THEN 'top' ELSE 'more' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 15")
def top_and_more(spark, sf_dir):
    """The best five and the next ten: a top-k of 15 rows, numbered after the limit."""
    best = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")
    n = F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return best.withColumn("n", n).select("o_orderkey", F.when(F.col("n") <= 5, "top").otherwise("more").alias("part"))


@query(
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS f, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS d FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE f = 1 OR d <= 2"""
)
def first_and_densest(spark, sf_dir):
    """The first mention and the two densest, each once."""
    a = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    b = F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", a.alias("f"), b.alias("d")).filter("f = 1 or d <= 2").select("l_suppkey", "l_orderkey", "l_linenumber")


_TILES = """, n AS (SELECT count(*) AS n FROM part), o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS ord FROM part),
b AS (SELECT d, CAST(floor((d - 1) * n / 90.0 + 0.5) AS BIGINT) AS lo, CAST(floor(d * n / 90.0 + 0.5) AS BIGINT) AS hi FROM n, (SELECT unnest(range(1, 91)) AS d))"""


@query("WITH x AS (SELECT 1)" + _TILES + " SELECT d AS day, min(p_partkey) AS start_key, max(p_partkey) AS end_key, count(*) AS n FROM o JOIN b ON ord > lo AND ord <= hi GROUP BY d")
def win_tiles(spark, sf_dir):
    """90 tiles of equal size with their bounds rounded half up."""
    return L.tiles(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 90)


@query("WITH x AS (SELECT 1)" + _TILES + ", t AS (SELECT d, min(ord) AS a, max(ord) AS z FROM o JOIN b ON ord > lo AND ord <= hi GROUP BY d) SELECT d AS day, coalesce(lag(z) OVER (ORDER BY d) + 1 = a, a = 1) AS contiguous FROM t")
def win_tiles_contiguous(spark, sf_dir):
    """No gap and no overlap between tiles: lag over the tiles, of which there are 90."""
    t = L.tiles(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 90, with_places=True)
    before = F.lag("last").over(W.orderBy("day"))
    return t.select("day", F.coalesce(before + 1 == F.col("first"), F.col("first") == 1).alias("contiguous"))


_SPANS = "SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, epoch_us(ts) / 1000000.0::DOUBLE + value - 20 AS e, ts FROM events"


@query(
    f"""WITH t AS ({_SPANS}), p AS (SELECT *, greatest(coalesce(max(greatest(s, e)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS pe FROM t)
SELECT event_id, round(greatest(s, pe), 3) AS s, round(greatest(e, greatest(s, pe)), 3) AS e FROM p"""
)
def monotonic_repair(spark, sf_dir):
    """Each start at the latest end before it at least, each end at its start at least."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.expr(MICROS) / 1e6).alias("s"), (F.expr(MICROS) / 1e6 + F.col("value") - 20).alias("e"))
    fixed = L.monotonic(e, ["user_id"], ["ts", "event_id"], "s", "e")
    return fixed.select("event_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


@query(
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN value END AS v FROM events),
i AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS a, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, count(v) OVER w AS island FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id, island) AS n FROM i)
SELECT event_id, round(coalesce(v, a + (b - a) * j / n, a, b), 6) AS value FROM k"""
)
def gap_interpolation(spark, sf_dir):
    """Missing values on the line between the known ones around them; beside an end, the nearest known one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return L.interpolate(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", F.round("v", 6).alias("value"))


@query("SELECT l_orderkey, l_linenumber, round((sum(l_quantity) OVER w - l_quantity) / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS s, round(sum(l_quantity) OVER w / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def proportional_spread(spark, sf_dir):
    """A span shared out by weight, in order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, 0)
    total, run = F.sum("l_quantity").over(W.partitionBy("l_orderkey")), F.sum("l_quantity").over(order)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round((run - F.col("l_quantity")) / total, 6).alias("s"), F.round(run / total, 6).alias("e"))


@query(f"WITH t AS ({_SPANS}) SELECT user_id, count(*) FILTER (WHERE s < pe) AS overlaps, count(*) AS n FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pe FROM t) GROUP BY user_id")
def overlap_check(spark, sf_dir):
    before = F.lag("e").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.expr(MICROS) / 1e6).alias("s"), (F.expr(MICROS) / 1e6 + F.col("value") - 20).alias("e"))
    return e.withColumn("pe", before).groupBy("user_id").agg(F.count_if(F.col("s") < F.col("pe")).alias("overlaps"), F.count("*").alias("n"))


@query(P + " , f AS (SELECT ref, section, par, text, sum((par % 3 = 1)::INT) OVER (PARTITION BY section ORDER BY par) AS record FROM paragraphs) SELECT section, CAST(record AS BIGINT) AS record, count(*) AS n, min(par) AS first_par FROM f GROUP BY section, record")
def forward_fill_records(spark, sf_dir):
    """Lines belong to the record that the last header opened."""
    p = pars(spark, sf_dir)
    return L.records(p, ["section"], ["par"], F.col("par") % 3 == 1).groupBy("section", "record").agg(F.count("*").alias("n"), F.min("par").alias("first_par"))


@query(
    r"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS ws FROM benchmark),
x AS (SELECT item_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM t),
h AS (SELECT item_id, i, max(CASE WHEN w = 'the' THEN i END) OVER o AS a, max(CASE WHEN w = 'of' THEN i END) OVER o AS b FROM x WINDOW o AS (PARTITION BY item_id ORDER BY i))
SELECT item_id, min(greatest(a, b) - least(a, b)) AS span FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY item_id HAVING min(greatest(a, b) - least(a, b)) < 12"""
)
def minimal_span(spark, sf_dir):
    """The shortest stretch with both words, within 12 tokens."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("ws"))
    return L.minimal_span(t, "item_id", "ws", ["the", "of"], 12)


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM t), n AS (SELECT doc_id, i FROM x WHERE regexp_matches(w, '^[0-9]+$')), c AS (SELECT doc_id, i FROM x WHERE w = 'the')
SELECT DISTINCT n.doc_id FROM n JOIN c ON n.doc_id = c.doc_id AND abs(n.i - c.i) <= 4"""
)
def number_near_word(spark, sf_dir):
    """A number within four tokens of a word, on the token array: no join."""
    ws = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]")).filter(L.close_by(ws, lambda w: w == "the", lambda w: w.rlike("^[0-9]+$"), 4)).select("doc_id")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT user_id, n, t AS last, 1 AS kept FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t - k.last >= 3600 THEN e.t ELSE k.last END, k.kept + (e.t - k.last >= 3600)::INT FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
SELECT user_id, CAST(max(kept) AS INTEGER) AS kept FROM k GROUP BY user_id"""
)
def thinned_marks(spark, sf_dir):
    """Marks at least an hour after the last kept one: a fold over each user's sorted times."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.expr(MICROS) / 1000000)).alias("t"))
    return e.select("user_id", L.thinned(F.col("t"), 3600).alias("kept"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def sorted_names(spark, sf_dir):
    """25 nations: a global order over a table of fixed size."""
    return table(spark, sf_dir, "nation").select("n_name", F.row_number().over(W.orderBy("n_name")).cast("long").alias("place"))


@query(P + " SELECT ref, row_number() OVER (ORDER BY paper, section, par) AS place FROM paragraphs")
def citation_order(spark, sf_dir):
    """Every reference with its place, by the numbers it has, not its text; numbered within range partitions."""
    at = R.parse_ref(F.col("ref"))
    key = at["paper"].cast("long") * 10**13 + at["section"] * 10**6 + at["par"]
    return L.numbered(pars(spark, sf_dir).select("ref", key.alias("key")), "key").select("ref", F.col("place").cast("long").alias("place"))


@query("WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), n AS (SELECT count(*) AS n FROM benchmark) SELECT strftime(day, '%Y-%m-%d') AS day, item_id FROM d, n, (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) WHERE k = (day - DATE '1970-01-01') % n")
def quote_of_the_day(spark, sf_dir):
    """Days since the epoch modulo the number of quotes."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return RL.of_the_day(days, table(spark, sf_dir, "benchmark"), "item_id").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "item_id")


@query("SELECT item_id FROM benchmark ORDER BY md5('7/' || item_id), item_id LIMIT 7")
def seeded_sample(spark, sf_dir):
    """Seven rows that a seed picks, the same each time: a top-k by a digest."""
    return table(spark, sf_dir, "benchmark").orderBy(F.md5(F.concat(F.lit("7/"), F.col("item_id").cast("string"))), "item_id").limit(7).select("item_id")


# --- predicates over rows

@query("SELECT count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.1)) AS outside, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS odd_flag, count(*) FILTER (WHERE l_shipdate IS NULL) AS no_date FROM lineitem")
def quality_rules(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count_if(~F.col("l_discount").between(0, 0.1)).alias("outside"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("odd_flag"), F.count_if(F.col("l_shipdate").isNull()).alias("no_date")
    )


@query("SELECT user_id, count(*) FILTER (WHERE value < p) AS falls FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def sort_monotonicity(spark, sf_dir):
    before = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("p", before).groupBy("user_id").agg(F.count_if(F.col("value") < F.col("p")).alias("falls"))


@query(P + ", l AS (SELECT item_id, CAST(item_id % 20 AS INTEGER) AS paper, item_id AS lo, item_id + 30 AS hi FROM benchmark) SELECT item_id, p.ref FROM l JOIN paragraphs p ON p.paper = l.paper AND p.section BETWEEN lo AND hi WHERE lo <= 25 AND hi >= 10")
def link_overlap(spark, sf_dir):
    """Links whose span overlaps the asked one, with their paragraphs: spans are dealt to the sections they hold,
    at most 31 each, so that the join is by equality."""
    links = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 20).cast("int").alias("paper"), F.col("item_id").alias("lo"), (F.col("item_id") + 30).alias("hi"))
    dealt = RL.overlapping(links, 10, 25).select("item_id", "paper", F.explode(F.sequence("lo", "hi")).alias("section"))
    return pars(spark, sf_dir).join(dealt, ["paper", "section"]).select("item_id", "ref")


@query(
    """SELECT conv_id, turn, len(ws) <= 2 OR (len(ws) <= 5 AND contains(' ' || lower(text) || ' ', ' the ')::INT + contains(' ' || lower(text) || ' ', ' of ')::INT = 0) AS garbled, length(text) = 0 AS blank
FROM (SELECT *, list_filter(string_split(trim(text), ' '), lambda w: w <> '') AS ws FROM conversations)"""
)
def garbled_questions(spark, sf_dir):
    """Turns that are too short, or short with no mapped word ("the" and "of" stand for terms here)."""
    words = F.filter(F.split(F.trim("text"), " "), lambda w: w != "")
    has = lambda w: F.contains(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), F.lit(f" {w} ")).cast("int")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ASK.garbled(words, has("the") + has("of")).alias("garbled"), (F.length("text") == 0).alias("blank"))


@query("WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM conversations), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) SELECT conv_id, turn, count(*) AS never_used FROM w WHERE word NOT IN (SELECT word FROM k) GROUP BY conv_id, turn")
def missed_questions(spark, sf_dir):
    """Turns with words that the corpus never uses."""
    return RL.never_used(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents"), ["conv_id", "turn"])


_ARTICLES = """WITH a AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS slug, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
t AS (SELECT *, CASE WHEN lower(slug) = '{slug}' THEN 1 WHEN {words} THEN 2 END AS tier FROM (SELECT *, lower(replace(slug, '-', ' ') || ' ' || title) AS hay FROM a))
SELECT page_id, url, tier, count(*) OVER () = 1 AS "unique" FROM t WHERE tier = (SELECT min(tier) FROM t)"""


@query(_ARTICLES.format(slug="the-en", words="contains(hay, 'the') AND contains(hay, 'en')"))
def article_search(spark, sf_dir):
    """Articles by their address, else those whose address and title have all words, and whether there is one alone."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "[^/]*$", 0).alias("slug"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return RL.find_articles(pages, "the en", "slug", "title").select("page_id", "url", "tier", "unique")


@query(
    """WITH e AS (SELECT event_id, event_type, user_id || '/' || strftime(ts, '%Y-%m-%d') AS key FROM events)
SELECT key, min(event_id) AS first_event FROM e WHERE event_type = 'view' AND key NOT IN (SELECT key FROM e WHERE event_type = 'purchase') GROUP BY key"""
)
def study_list(spark, sf_dir):
    """Adds keep the first of each key, here a user's day; removals take it off."""
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", key.alias("key"))
    return RL.study_list(e, ["key"], "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")
