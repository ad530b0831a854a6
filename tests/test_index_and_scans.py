"""The stored index, names of several words, segmented scans, dyadic spans and citations, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from concordia.functions import refs as R
from concordia.operators import entities as EN, index as IX, joins as J, scan as SC, search as S, timeline as L
from concordia.plans import shapes
from concordia.queries import search_queries as SQ

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["The vine, the true vine", "vine branches and vineyards", "Évine of_the the the of the", "of, the", "of  the\tThe", "", "o'clock vine"]
    return spark.createDataFrame([(f"1:{k}.1", 1, k, 1, t) for k, t in enumerate(texts, 1)] + [("1:9.1", 1, 9, 1, None)], "ref string, paper int, section long, par long, text string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return IX.build(corpus, str(tmp_path_factory.mktemp("index") / "own"))


@pytest.fixture(scope="module")
def stored_index(spark, tmp_path_factory):
    return IX.build(SQ.pars(spark, FOLDER), str(tmp_path_factory.mktemp("index") / "all"))


@pytest.mark.parametrize("query", ["vine", "vine branches", "the vine", "of the", "absent words", "vine vineyard", "the"])
def test_index_scores_as_the_scan(corpus, index, query):
    got = {(r.ref, r.matched, r.hits, round(r.score, 6)) for r in IX.scored(index, query).collect()}
    assert got == {(r.ref, r.matched, r.hits, round(r.score, 6)) for r in S.scored(corpus, query).collect()}


@pytest.mark.parametrize("query", ["tion er ing", "de la", "the of", "sch"])
def test_index_finds_what_the_scan_finds_in_documents(spark, stored_index, query):
    p = SQ.pars(spark, FOLDER)
    for paper in (None, 3):
        assert [(r.ref, round(r.score, 6)) for r in IX.search(stored_index, query, paper).collect()] == [(r.ref, round(r.score, 6)) for r in S.search(p, query, paper).collect()]


def test_index_phrases_and_frequencies(corpus, index):
    assert {r.ref: r.n for r in IX.phrase(index, "of the").collect()} == {"1:3.1": 1, "1:5.1": 1}
    assert {r.ref: r.n for r in IX.phrase(index, "the the").collect()} == {"1:3.1": 1, "1:5.1": 1}
    terms = ["vine", "the", "zzz", "branch"]
    assert {r.term: r.df for r in IX.document_frequency(index, terms).collect()} == {r.term: r.df for r in S.document_frequency(corpus, terms).collect()}
    assert {r.term: r.df for r in IX.document_frequency(index, ["vine", "the", "vin"], whole=True).collect()} == {"vine": 4, "the": 4, "vin": 0}
    with pytest.raises(ValueError, match="isn't a word"):
        IX.phrase(index, "o'clock vine")


def test_index_reads_a_range_of_words(stored_index):
    plan = shapes.plan_of(IX.scored(stored_index, "tion er")) if hasattr(shapes, "plan_of") else IX.scored(stored_index, "tion er")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,tion)" in plan and "LessThan(token,tion" in plan and "text" not in re.findall(r"ReadSchema: (\S+)", plan)[0]
    files = stored_index.postings.select("token", F.input_file_name().alias("f")).groupBy("f").agg(F.min("token").alias("a"), F.max("token").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x.b <= y.a for x, y in zip(files, files[1:]))


def test_a_frequent_word_is_several_files(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("r").alias("ref"), F.lit(1).alias("paper"), "id", F.lit(1).cast("long").alias("par"), F.concat(F.lit("same same w"), F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "section")
    index = IX.build(rows, str(tmp_path / "hot"))
    assert index.postings.filter("token = 'same'").select(F.input_file_name()).distinct().count() > 1
    assert IX.phrase(index, "same same").count() == 4000


# --- names


def brute_mentions(rows, terms):
    out = {}
    for ref, text, heading in rows:
        for name, own in terms.items():
            pattern = "|".join(f"(?<![A-Za-z0-9_]){re.escape(t.lower())}(?![A-Za-z0-9_])" for t in own)
            n = len(re.findall(pattern, (text or "").lower()))
            if n or re.search(pattern, (heading or "").lower()):
                out[name, ref] = n
    return out


def test_names_of_several_words(spark):
    terms = {"Mary": ["mary", "Mary Magdalene"], "Magdalene": ["Mary Magdalene", "magdalene"], "Ab": ["ab ab"], "Dash": ["well-known", "-x"], "Clock": ["o'clock"], "None": ["!!"], "Tab": ["a  b"], "Paren": ["(ab)"]}
    texts = [
        "Mary Magdalene and Mary", "ab ab ab ab", "a well-known x, -x and y-x at two o'clock", "Marys maryMagdalene", "", None, "a  b", "a b (AB) x(ab)y ((ab))", "Mary\tMagdalene", "éab ab ab",
    ]
    rows = [(f"1:{k}.1", 1, k, 1, t, h) for k, (t, h) in enumerate(zip(texts, [None, "Mary Magdalene", "", "ab ab", "mary", "o'clock", None, None, None, None]), 1)]
    p = spark.createDataFrame(rows, "ref string, paper int, section long, par long, text string, heading string")
    got = {(r.name, r.ref): r.n for r in EN.mentions(p, terms).collect()}
    want = brute_mentions([(r[0], r[4], r[5]) for r in rows], {k: v for k, v in terms.items() if k != "None"})
    assert got == want
    assert {(r.name, r.ref) for r in EN.mentions(p.drop("heading"), terms).collect()} == {k for k, n in want.items() if n}


def test_hundreds_of_names_in_one_scan(spark):
    rng = random.Random(4)
    vocabulary = [a + b for a in ("ti", "on", "er", "sch", "an") for b in ("the", "re", "mo", "la")]
    terms = {f"n{k}": [" ".join(rng.choice(vocabulary) for _ in range(1 + k % 4))] for k in range(300)}
    rows = [(f"1:{k}.1", 1, k, 1, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(60)]
    p = spark.createDataFrame(rows, "ref string, paper int, section long, par long, text string")
    found = EN.mentions(p, terms)
    assert {(r.name, r.ref): r.n for r in found.collect()} == brute_mentions([(r[0], r[4], None) for r in rows], terms)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Scan ExistingRDD\[ref", plan)) == 1


def test_pins_replace_the_own_choice(spark):
    found = spark.createDataFrame([(n, f"{p}:1.{k}", p, 1, k, k) for n in ("a", "b", "c") for p in (1, 2) for k in (1, 2, 3)], "name string, ref string, paper int, section long, par long, n int")
    pins = spark.createDataFrame([("a", "2:1.3", 2), ("a", "1:1.1", 5), ("a", "9:9.9", 1), ("b", "9:9.9", 1)], "name string, ref string, place int")
    got = sorted((r.name, r.place, r.ref) for r in EN.entity_index(found, pins).collect())
    assert got == [("a", 1, "2:1.3"), ("a", 2, "1:1.1"), ("c", 1, "1:1.1"), ("c", 2, "1:1.2"), ("c", 3, "1:1.3")]


# --- scans


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_values_of_a_frequent_key(spark, keys):
    """One key has most rows; null keys, null values and equal times; every cut of the order."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, *range(40)]), rng.choice([None, None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(5)
    values = {"top": SC.Running("max", F.col("v"), own=False), "total": SC.Running("sum", F.col("v")), "last": SC.Running("last", F.col("v")), "next": SC.Running("last", F.col("v"), own=False, back=True), "rest": SC.Running("sum", F.col("v"), back=True)}
    for parts in (1, 2, 9):
        got = {r.id: (r.top, r.total, r["last"], r.next, r.rest) for r in SC.with_running(df, keys, ["t", "id"], values, parts).collect()}
        assert len(got) == 400
        for key in {r[1] if keys else 0 for r in rows}:
            own = sorted((r for r in rows if not keys or r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
            some = [[x[3] for x in part if x[3] is not None] for n in range(len(own)) for part in (own[:n], own[: n + 1], own[n + 1 :], own[n:])]
            for n, r in enumerate(own):
                before, upto, behind, on = some[4 * n : 4 * n + 4]
                assert got[r[0]] == (max(before, default=None), sum(upto) if upto else None, upto[-1] if upto else None, behind[0] if behind else None, sum(on) if on else None)


def test_no_task_holds_the_rows_of_one_key(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    out = SC.with_running(rows, ["k"], ["t"], {"s": SC.Running("sum", F.col("v"))}, 8)
    at = SC.cuts(rows, "t", 8)
    seg = F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c < F.col("t")))
    assert rows.groupBy(seg).count().agg(F.max("count")).head()[0] < 40_000 / 8 * 1.2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.agg(F.max("s")).head()[0] == sum(k % 7 for k in range(40_000))
    # every window over rows is by key and segment; the one by key alone is over the segments' totals
    assert all("__seg" in w for w in re.findall(r"Window \[[^\n]*?__n0[^\n]*", plan))


def test_streaks_and_lines_over_one_key(spark):
    hits = [1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([(k, h == 1, None if k in (0, 3, 4, 8) else float(k * k)) for k, h in enumerate(hits)], "t int, hit boolean, v double")
    got = L.streaks(df, [], ["t"], F.col("hit")).orderBy("t").collect()
    assert [(r.streak, r.score) for r in got] == [(1, 1), (2, 2), (0, 2), (1, 3), (0, 3), (0, 3), (1, 4), (2, 5), (3, 6)]
    line = [r.v for r in L.interpolate(df, [], ["t"], "v").orderBy("t").collect()]
    assert line == [1.0, 1.0, 4.0, 11.0, 18.0, 25.0, 36.0, 49.0, 49.0]


# --- spans


def test_dyadic_nodes_part_a_span(spark):
    spans = [(0, 0), (1, 6), (5, 4), (-7, 9), (3, 1_000_002), (-1, -1), (0, 1023), (1, 1 << 40)]
    df = spark.createDataFrame(spans, "a long, b long").withColumn("nodes", J.dyadic(F.col("a"), F.col("b")))
    for r in df.collect():
        parts = sorted((n.node << n.level, (n.node + 1 << n.level) - 1) for n in r.nodes)
        assert len(parts) <= 2 * 42 and (not parts) == (r.a > r.b)
        if parts:
            assert parts[0][0] == r.a and parts[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:]))


def test_points_in_spans_of_any_length(spark):
    rng = random.Random(6)
    spans = [(k, a, a + rng.choice([0, 3, 50, 1_000_000])) for k, a in enumerate(rng.choices(range(-500, 2_000_000), k=60))] + [(60, 5, 1), (61, None, 7), (62, 0, None), (3, 10, 20)]
    points = [(p,) for p in [*rng.choices(range(-600, 2_500_000), k=80), None, 10, 10, *(s[1] for s in spans[:9]), *(s[2] for s in spans[:9])]]
    got = J.in_spans(spark.createDataFrame(points, "p long"), spark.createDataFrame(spans, "s int, a long, b long"), "p", "a", "b")
    want = sorted((p, s, a, b) for (p,) in points for s, a, b in spans if None not in (p, a, b) and a <= p <= b)
    assert sorted((r.p, r.s, r.a, r.b) for r in got.collect()) == want and got.columns == ["p", "s", "a", "b"]


# --- citations


@pytest.mark.parametrize(
    ("text", "refs"),
    [
        ("1:2.3 through 1:2.5 to 1:2.7", ["1:2.3", "1:2.4", "1:2.5", "1:2.7"]), ("1:2.3 - 1:2.4; 3:1.1-", ["1:2.3", "1:2.4", "3:1.1"]), ("1:2.3—4.5", ["1:2.3", "1:4.5"]), ("1:2.3 to 2.5, then", ["1:2.3", "1:2.4", "1:2.5"]),
        ("1:2.3-4:5.6", ["1:2.3", "4:5.6"]), ("1:2.3 together 7", ["1:2.3"]), ("1:2.3-1:2.3", ["1:2.3"]), ("none", []), ("1:1.5\x011:1.6", ["1:1.5", "1:1.6"]), ("01:2.3", ["01:2.3"]),
    ],
)
def test_ranges_of_citations(spark, text, refs):
    assert spark.createDataFrame([(text,)], "c string").select(R.expand_citation(F.col("c"))).head()[0] == refs


def test_digits_of_references_in_texts(spark):
    got = lambda text, **k: spark.createDataFrame([(text,)], "c string").select(R.cited_refs(F.col("c"), **k)).head()[0]
    assert got("1:2.1234 and 1:2.5") == ["1:2.5"] and got("1:2.1234-1235 and 1:2.5", digits=4) == ["1:2.1234", "1:2.1235", "1:2.5"]
    assert got("x1:2.3 1:2.3x 1:2.3-5x 1:2.7 – 8") == ["1:2.3", "1:2.7", "1:2.8"]
    assert got("01:02.03-05:06.07") == ["1:2.3", "5:6.7"]
