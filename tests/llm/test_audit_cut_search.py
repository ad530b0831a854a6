"""Filter audit, fill-in-the-middle and pivot search against brute force."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from concordia.llm import fill_in_middle as FIM, filter_audit as FA, pivot_search as PS
from concordia.llm.common import join_unique, materialize

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, text, lang) rows; labels: (doc_id, quality, toxic)."""
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]
        fails.append(i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        rows.append((lang or "", fails, any(j == i and i is not None and q == 1 for j, q, _ in labels), any(j == i and i is not None and x == 1 for j, _, x in labels)))
    out = []
    for part in {p for p, *_ in rows}:
        own, shapley, steps = [r for r in rows if r[0] == part], [0] * 5, []
        for order in itertools.permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone = [r for r in left if r[1][k]]
                left = [r for r in left if not r[1][k]]
                shapley[k] += len(gone)
                fails = sum(r[1][k] for r in own)
                alone = sum(r[1][k] and sum(r[1]) == 1 for r in own)
                steps.append((part, "".join("ABCDE"[i] for i in order), step, len(left), len(gone), fails - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), k))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out, key=repr)


def test_audit_like_brute_force(spark, odd, documents):
    marks = [(0, 1, 1), (0, 0, 0), (1, None, 1), (7, 1, None), (8, 0, 1), (None, 1, 1), (14, 1, 0), (14, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r["lang"]) for r in odd.collect()]
    assert plain(FA.audit(odd, labels).collect()) == brute_audit(docs, marks)
    marks = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    docs = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    assert plain(FA.audit(documents, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()) == brute_audit(docs, marks)


def test_audit_of_empty_tables(odd, empty):
    labels = odd.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert FA.audit(empty, labels).count() == 0
    got = FA.audit(odd, labels).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count_distinct("part"), F.count("*")).head()
    assert tuple(got) == (0, 0, 2, 1200)


def test_bitsets_count_parts_that_share_a_byte():
    rng = np.random.default_rng(2)
    n, parts = 1003, 7
    failed, part = rng.integers(0, 32, n), np.sort(rng.integers(0, parts - 1, n))  # the last part is empty
    good, toxic = rng.random(n) < 0.3, rng.random(n) < 0.6
    got = FA.counted(failed, good, toxic, part, parts)
    for p, s in itertools.product(range(parts), range(32)):
        left = (part == p) & (failed & s == 0)
        assert got[p, s].tolist() == [left.sum(), (left & good).sum(), (left & toxic).sum()]


def test_many_parts_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(FA, "HELD_PARTS", 3)
    rows = spark.createDataFrame([(f"p{k % 50}", k % 32, k % 3 == 0, False) for k in range(500)], "part string, failed int, good boolean, toxic boolean")
    got = FA.set_counts(rows).filter("set = 0").collect()
    assert len(got) == 50 and all(r.kept == 10 for r in got)


@pytest.mark.parametrize("share", [1, 4, 1024])
def test_join_unique(spark, share):
    """A key with half of the rows, null keys, and keys of one row, whatever counts as frequent."""
    rows = materialize(spark.createDataFrame([(1 if k % 2 else None if k % 3 == 0 else k, k) for k in range(300)], "id long, k long"), "rows")
    unique = spark.createDataFrame([(k, f"v{k}") for k in range(0, 200)], "id long, v string")
    got = join_unique(rows, unique, "id", share).select("id", "k", "v").collect()
    assert len(got) == 300 and all(r.v == (f"v{r.id}" if r.id is not None and r.id < 200 else None) for r in got)


# --- fill-in-the-middle


def brute_cut(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=600, deadline=None)
@given(st.integers(0, 50), st.text(alphabet=st.sampled_from("aZ@[`{é漢😀<PSM>1 \n"), max_size=40))
def test_cut_like_brute_force(doc_id, text):
    c = FIM.transform(doc_id, text)
    assert (c.n, c.form, c.prefix_chars, c.middle_chars, c.output) == brute_cut(doc_id, text)


def test_runs_find_every_cut():
    for text in ("", "abc", "ab cd", " \t12ab,,c", "é漢a", "a" * 50 + "." * 50):
        units, runs = re.findall("[A-Za-z]+|[^A-Za-z]", text), FIM.Runs.of(text)
        assert runs.units == len(units)
        assert [runs.offset(u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_documents_are_cut_and_restored(documents, odd, empty):
    for df in (documents, odd):
        found = FIM.fill_in_middle(df)
        rows = found.withColumn("again", FIM.restored(F.col("output"), F.col("form"))).collect()
        want = sorted(((r.doc_id, *brute_cut(r.doc_id, r.text or ""), r.text or "") for r in df.select("doc_id", "text").collect()), key=repr)
        assert sorted((tuple(r) for r in rows), key=repr) == want
    assert {r.form for r in rows} | {"spm"} == {"plain", "psm", "spm"}
    assert FIM.digest(FIM.fill_in_middle(empty)).count() == 0


def test_ends_that_look_like_marks_are_restored(spark):
    texts = ["a<", "<P", "S>", "M> <", "<<P", "x<S", ">", "<M> plain"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 20)], "doc_id long, text string")
    found = FIM.fill_in_middle(df).withColumn("again", FIM.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.again == texts[r.doc_id % 8] for r in found) and {r.form for r in found} == {"plain", "psm", "spm"}


# --- pivot search


def brute_search(rows, k, is_query):
    kept = [(i, [int(x) for x in np.floor(64 * np.array(e, float))]) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and is_query(i):
            score = [(-cut(sum(x * y for x, y in zip(v, w))), j is None, j or 0, j) for b, (j, w) in enumerate(kept) if a != b]
            out += [(i, n, j, -s) for n, (s, _, _, j) in enumerate(sorted(score, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def searched(df, divisor, k=20, **more):
    return plain(PS.top_k(df, F.col("vec_id") % divisor == 0, k, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("ring_rows, first", [(2048, 2048), (20, 5)])
def test_search_like_sql(spark, ring_rows, first):
    got = searched(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), 20, ring_rows=ring_rows, first=first)
    want = duckdb.sql(PS.ORACLE_SQL.replace("FROM embeddings", f"FROM '{FOLDER}/embeddings.parquet'")).fetchall()
    assert got == plain(want)


def test_search_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    near = [[float(x) for x in rng.integers(-3, 4, 3) / 8] for _ in range(60)]  # many equal ones and ties
    far = [[float(x) for x in rng.normal(size=3) * 10 ** float(rng.integers(-2, 4))] for _ in range(40)]
    odd = [None, [], [1.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [0.0, -0.0, 0.0], [0.0] * 3, [3e30, 1.0, 1.0], [-3e30, 0.0, 1.0], [1e9, 1e9, 1e9], [0.1, 0.2, 0.3, 0.4, 0.5]]
    rows = list(enumerate(near + far + odd + [near[0]] * 70))
    rows += [(0, near[0]), (0, near[1]), (None, near[2]), (None, near[2]), rows[50]]
    df = spark.createDataFrame([(i, e, "x", 1.0) for i, e in rows], "vec_id long, embedding array<double>, vec string, norm double")
    assert searched(df, 5, 7, ring_rows=12, first=4) == brute_search(rows, 7, lambda i: i % 5 == 0)
    assert searched(df, 5, 300) == brute_search(rows, 300, lambda i: i % 5 == 0)


def test_search_of_few_rows(spark):
    kind = "vec_id int, embedding array<float>"
    assert searched(spark.createDataFrame([], kind), 20) == searched(spark.createDataFrame([(20, [1.0])], kind), 20) == searched(spark.createDataFrame([(1, [1.0]), (2, None)], kind), 20) == []
    assert searched(spark.createDataFrame([(20, [1.0]), (3, [1.0, 5.0])], kind), 20) == [(20, 1, 3, 4096)]


def test_bounds_close_annuli_of_clustered_vectors(spark):
    """With eight groups on axes far apart most annuli stay closed, and the result is the brute force one."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in 4 * np.eye(8)[k % 8] + rng.normal(size=8) * 0.02]) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = materialize(PS.quantised(df), "v")
    directory, blocks = PS.build(materialize(PS.entries(vectors, 3), "e"), 10)
    assert blocks.select(F.explode("vec")).count() == 800 and directory.rows.sum() == 800 and blocks.agg(F.max(F.size("vec"))).head()[0] <= PS.BLOCK_ROWS
    queries = PS.matrix([bytes(r.vec) for r in vectors.filter("vec_id % 100 = 0").collect()])
    all_products = np.sort(PS.products(queries, PS.matrix([bytes(r.vec) for r in vectors.collect()])), axis=1)
    opened = directory.first(queries, 20) | directory.rest(queries, all_products[:, -4].astype(float), 20)
    assert (opened @ directory.rows).mean() < 400
    assert searched(df, 100, 3, ring_rows=10, first=20) == brute_search(rows, 3, lambda i: i % 100 == 0)
