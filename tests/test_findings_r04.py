"""Findings of round 4: each of these failed before."""


def test_spelling_sends_no_keys_to_the_driver(spark, tmp_path):
    """A stored table of words is small, its keys are dozens of times as many: Spark's estimate doesn't see that."""
    from concordia.operators import spell

    spark.createDataFrame([("wandering",), ("settlements",)], "word string").write.parquet(f"{tmp_path}/asked")
    spark.createDataFrame([("wanderings", 3), ("settlement", 2), ("setlement", 5)], "v string, n bigint").write.parquet(f"{tmp_path}/known")
    asked, known = spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/known")
    want = {spell.one_edit: {("wandering", "wanderings"), ("settlements", "settlement")}, spell.longer_forms: {("wandering", "wanderings")}, spell.two_edits: {("wandering", "wanderings"), ("settlements", "settlement"), ("settlements", "setlement")}}
    for step, pairs in want.items():
        found = step(asked, known)
        assert {(r.word, r.v) for r in found.collect()} == pairs
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    found = spell.suggest(asked, known.withColumnRenamed("v", "word"))
    assert {tuple(r) for r in found.collect()} == {("wandering", "wanderings"), ("settlements", "settlement")}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_search_sends_no_opened_blocks_to_the_driver(spark, tmp_path):
    """A query was repeated for each annulus that it opens, and Spark, which sees it once, broadcast all of them."""
    import numpy as np
    from pyspark.sql import functions as F

    from concordia.llm import pivot_search as PS
    from concordia.llm.common import materialize

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 6))
    embeddings = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    rows = materialize(PS.quantised(embeddings), "vectors")
    directory, blocks = PS.build(materialize(PS.entries(rows, 5), "entries"), 16)
    assert len(directory.pivot) > 2 * PS.GROUPS and directory.group > 1
    queries = materialize(rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "vec"), "queries")
    opened = PS._opened(queries, directory, 3000)
    # all annuli are opened, and a query is sent once for each group of them
    groups = -(-len(directory.pivot) // directory.group)
    assert opened.agg(F.sum(F.size("qids"))).head()[0] == 150 * groups <= 150 * PS.GROUPS
    found = PS._compared(opened, blocks, directory.group, 5, "bigint")
    whole = np.floor(64 * vectors).astype(int)
    best = {q: sorted((-int(s), v) for v, s in enumerate(whole @ whole[q]))[:6] for q in range(0, 3000, 20)}
    near = PS._top(found, 5).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("x")).collect()
    assert {r.qid: [tuple(x) for x in r.x] for r in near} == best
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    top = PS.top_k(embeddings, F.col("vec_id") % 20 == 0, 5, first=64, ring_rows=16).collect()
    want = {(q, k, v, -s) for q, found in best.items() for k, (s, v) in enumerate([x for x in found if x[1] != q][:5], 1)}
    assert {tuple(r) for r in top} == want


def test_only_pieces_that_may_be_anchors_are_shuffled(spark, monkeypatch):
    """Beyond what is broadcast, every piece of every text was shuffled, and then all texts and all needles."""
    import random

    from concordia.operators import anchors as AN

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [(k, " ".join(word() for _ in range(60))) for k in range(300)] + [(300, "One, two three FOUR five"), (301, "three four. one"), (302, None), (303, "one"), (304, "four three")]
    needles = [(k, " ".join(texts[k * 7][1].split()[k : k + 4 + k])) for k in range(20)] + [(20, "three four"), (21, "one"), (22, "two three four five"), (23, "no such words here"), (24, "Three: four"), (25, "five one")]
    seen = []
    among = AN.among
    monkeypatch.setattr(AN, "among", lambda rows, marked, *more: (seen.append((rows.count(), among(rows, marked, *more).count())), among(rows, marked, *more))[1])
    n, t = spark.createDataFrame(needles, "n int, text string"), spark.createDataFrame(texts, "t int, text string")
    found = {tuple(r) for r in AN.containment(n, t, "n", "t", sent_bytes=0).collect()}
    form = lambda s: " " + " ".join(s.lower().replace(",", "").replace(".", "").replace(":", "").split()) + " "
    assert found == {(i, j) for i, a in needles for j, b in texts if b and form(a) in form(b)}
    assert found == {tuple(r) for r in AN.containment(n, t, "n", "t").collect()}
    assert sum(all_ for all_, _ in seen) > 17000 and sum(few for _, few in seen) < 100
