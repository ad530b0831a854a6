"""Runs of words by their rarest piece, chains of links, graphs and thinned marks, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from concordia.operators import anchors as AN, graph as GH, pointers as PT


def words(text):
    return [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if w]


def holds(text, needle):
    a, b = words(text), words(needle)
    return bool(b) and any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
@pytest.mark.parametrize("cells", [1 << 20, 3])
def test_containment_as_plain_search(spark, sent_bytes, cells, monkeypatch):
    """Short and long needles, repeated and equal ones, nulls and empty texts, places at both ends of a text; counts that share cells."""
    monkeypatch.setattr(AN.anchors, "__defaults__", (AN.GRAM, cells))
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    texts = [(k, make(rng.randrange(1, 60))) for k in range(40)] + [(40, None), (41, ""), (42, "..."), (7, make(20)), (43, "A, b: C!"), (43, "A, b: C!")]
    needles = [(k, make(rng.randrange(1, 9))) for k in range(60)] + [(60, None), (61, " "), (62, texts[5][1]), (63, texts[6][1][-9:]), (63, "z q"), (64, "a b c"), (65, "A b, c"), (65, "A b, c")]
    got = AN.containment(spark.createDataFrame(needles, "n int, text string"), spark.createDataFrame(texts, "t int, text string"), "n", "t", sent_bytes=sent_bytes)
    assert got.columns == ["n", "t"] and sorted(map(tuple, got.collect())) == sorted({(n, t) for n, a in needles for t, b in texts if holds(b, a)})
    none = spark.createDataFrame([], "n int, text string")
    assert AN.containment(none, spark.createDataFrame(texts, "t int, text string"), "n", "t").count() == 0


def test_a_shared_opening_pairs_nothing(spark):
    """All texts and needles begin alike: needles are looked for by what they have alone."""
    opening = "it is written in the book of the law that"
    texts = spark.createDataFrame([(k, f"{opening} w{k} x{k} y{k} z{k} ends here as all do") for k in range(400)], "t int, text string").select("t", AN._words("text").alias("ws"))
    needles = spark.createDataFrame([(str(k), words(f"{opening} w{k} x{k} y{k} z{k}")) for k in range(0, 800, 2)], "digest string, ws array<string>")
    found = AN.anchors(needles, texts)
    assert found.count() == 200 and found.agg(F.min("at")).head()[0] > 5  # those that no text has are out before any text meets them
    assert AN.meetings(found, texts).count() == 200


def test_chains_of_links(spark):
    n = 10_000
    rows = [(k, k + 1) for k in range(n)] + [(20_001, 20_002), (20_002, 20_003), (20_003, 20_002), (20_004, 20_004), (20_005, None), (20_006, 5), (20_006, 9), (20_007, 20_005)]
    got = {r.id: (r.end, r.steps, r.loops) for r in PT.chains(spark.createDataFrame(rows, "id int, next int")).collect()}
    want = {k: (n, n - k, False) for k in range(n)} | {k: (None, None, True) for k in range(20_001, 20_005)} | {20_006: (n, n - 4, False), 20_007: (20_005, 1, False)}
    assert got == want
    assert PT.chains(spark.createDataFrame([], "id int, next int")).count() == 0


def test_reached_over_a_long_path_in_few_rounds(spark, monkeypatch):
    rounds = []
    put = PT.put
    monkeypatch.setattr(PT, "put", lambda df, name: (rounds.append(name), put(df, name))[1])
    links = spark.range(10_000).select("id", (F.col("id") + 1).alias("next")).unionByName(spark.createDataFrame([(20_000, 20_001), (20_001, 20_000)], "id long, next long"))
    assert PT.reached(links, spark.createDataFrame([(40,), (9_990,), (20_001,), (30_000,)], "id long")).count() == 10_001 - 40 + 2 + 1
    assert rounds.count("reached") < 20


def test_cycles(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a int, b int, kind string")
    diamond = [(1, 2, None), (1, 3, "parent"), (2, 4, "parent"), (3, 4, "adoptive"), (4, 5, "parent"), (4, 6, None), (5, 7, None), (6, 7, None), (7, None, None)]
    assert not GH.cyclic(edges(diamond))
    assert GH.cyclic(edges([*diamond, (7, 1, "spouse")])) and not GH.cyclic(edges([*diamond, (7, 1, "spouse")]), ["spouse"])
    assert GH.cyclic(edges([*diamond, (7, 1, None)]), ["spouse"]) and GH.cyclic(edges([(9, 9, None)])) and not GH.cyclic(edges([]))
    rng = random.Random(5)
    for _ in range(4):
        rows = [(rng.randrange(12), rng.randrange(12), None) for _ in range(11)]
        rows = [r for r in rows if r[0] != r[1]]
        left = {r[:2] for r in rows}
        while any(b not in {a for a, _ in left} for _, b in left):
            left = {(a, b) for a, b in left if b in {x for x, _ in left}}
        assert GH.cyclic(edges(rows)) == bool(left)


def test_thinned_marks_of_one_frequent_key(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), rng.choice([None, *range(4000)])) for _ in range(1500)] + [("a", 5), ("a", 5)]
    got = PT.kept_marks(spark.createDataFrame(rows, "k string, t long").repartition(6), ["k"], "t", 25).collect()
    want = []
    for key in {k for k, _ in rows}:
        last = None
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if last is None or t - last >= 25:
                want.append((key, t))
                last = t
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="above 0"):
        PT.kept_marks(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 0)
