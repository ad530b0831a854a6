"""Exact and near duplicates against brute force."""

import itertools
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from concordia.llm import exact_dedup, simhash

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_exact_like_sql(documents):
    got = exact_dedup.exact_duplicates(documents)
    want = duckdb.sql(exact_dedup.ORACLE_SQL.replace("FROM documents", f"FROM '{FOLDER}/documents.parquet'")).fetchall()
    assert plain(got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == plain(want)


@pytest.mark.parametrize(("size", "weak"), [(4096, False), (16, False), (7, True)])
def test_exact_any_block_size_and_hash(spark, size, weak):
    """With few hash values nearly all blocks collide, and ranks alone tell them apart."""
    base = ["the same text over and over", "the same text over and  over", "the same text over and ovex", "xhe same text over and over", "a" * 40, "a" * 41, "b" * 40, "", None, " "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(base * 2)], "doc_id long, text string")
    hashed = (lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))) if weak else F.xxhash64
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df, size, hashed).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in base * 2]
    for k, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert got[k] == (same[0], len(same))


def test_exact_odd_rows(odd, empty):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 7, 1)}
    assert (by[4].keep_id, by[4].group_size, by[4].kept) == (4, 3, True) and by[14].keep_id == 4 and not by[14].kept
    one = [r for r in rows if r.doc_id is None]  # the same text as a row with a doc_id
    assert one[0].keep_id == 1 and not one[0].kept
    assert sum(r.doc_id == 7 and r.kept for r in rows) == 2
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sum(r.doc_id == 7 for r in kept.collect()) == 1
    assert {*kept.collect()} <= {*odd.collect()}
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.keep_first(empty).count() == 0


def test_exact_keeps_the_least_of_a_repeated_id(spark):
    rows = [(1, "a  b", "y"), (1, "a b", "z"), (1, "a b", "x"), (2, "a b", "w"), (1, "c", "v")]
    for data in (rows, rows[::-1]):
        kept = exact_dedup.keep_first(spark.createDataFrame(data, "doc_id int, text string, id string"))
        assert sorted(r.text for r in kept.collect()) == ["a  b", "c"]


def test_names_are_integers_by_level(spark):
    """Three blocks need two levels; a text that is another's first block has another level."""
    df = spark.createDataFrame([(1, "aabbcc"), (2, "aabbcc"), (3, "aabbcd"), (4, "aa"), (5, "aabb"), (6, "aabbccdd")], "doc_id int, text string")
    _, names = exact_dedup.identities(df, 2)
    got = {r.doc_id: (r.level, r.name) for r in names.collect()}
    assert got[1] == got[2] and len({*got.values()}) == 5 and [got[k][0] for k in (1, 4, 5, 6)] == [2, 0, 1, 2]
    assert all(isinstance(n, int) and n >= 0 for _, n in got.values())


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(fps))]


def test_near_like_brute_force(documents, texts):
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, brute_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()} == want


def test_any_three_bytes_lie_in_the_complement_of_an_indexed_set():
    for three in itertools.combinations(range(8), 3):
        assert any(not {*three} & {*p} for p in simhash.POSITIONS)
    assert len(simhash.POSITIONS) == 14


@pytest.mark.parametrize("max_list", [8192, 3])
def test_chains_and_balls(spark, max_list):
    """A ball around one fingerprint, a chain of steps of three bits, and lone ones; with short lists the
    half-byte index takes over."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    ball = {centre} | {centre ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (60, 2))}
    chain = [int(rng.integers(0, 1 << 63))]
    for k in range(20):
        chain.append(chain[-1] ^ 1 << 3 * k ^ 1 << 3 * k + 1 ^ 1 << 3 * k + 2)
    fps = sorted(ball | {*chain} | {int(x) for x in rng.integers(0, 1 << 63, 60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_list)
    stars = simhash.components(found.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b")))
    root = {r.a: r.b for r in stars.collect()}
    want = brute_components(fps)
    groups = lambda key: {frozenset(signed[i] for i in range(len(fps)) if key(i) == c) for c in {key(i) for i in range(len(fps))}}
    assert groups(lambda i: root.get(signed[i], signed[i])) == groups(lambda i: want[i])


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 255), min_size=1, max_size=30))
def test_roots_in_a_list(values):
    fps = np.array(sorted(v | v << 20 for v in values), np.uint64)
    got, want = simhash.roots_of(fps), brute_components([int(f) for f in fps])
    assert [int(x) for x in got] == [int(fps[w]) for w in want]


def test_one_of_a_doc_id_with_near_texts_stays(spark):
    long = " ".join(f"w{k}" for k in range(400))
    df = spark.createDataFrame([(5, long), (5, long + " end"), (None, long + " end"), (9, long), (None, "alone here now"), (4, "some other text")], "doc_id int, text string")
    assert simhash.near_duplicates(df).select("component_id").distinct().count() == 3
    assert sorted((r.doc_id or 0, r.text[:4]) for r in simhash.keep_one(df).collect()) == [(0, "alon"), (4, "some"), (5, long[:4])]


def test_near_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.doc_id in (0, 2)]
    assert all(r.fingerprint == "0" * 16 and r.component_id == 0 for r in zero)
    kept = simhash.keep_one(odd).collect()
    assert simhash.keep_one(odd).columns == odd.columns and {*kept} <= {*odd.collect()}
    assert sum(r.doc_id == 7 for r in kept) == 2 and [r.doc_id for r in kept if not (r.text or "").strip()] == [0]
    # "one" has a null doc_id in one row, and 1 in another
    assert [r.doc_id for r in kept if r.text == "one"] == [1]
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0
