"""The pipeline on small tables against a plain version of its stages."""

import hashlib
import re

import corpus_pipeline
from concordia.llm import bpe, quality
from test_duplicates import brute_components, brute_fingerprint
from test_text_operators import brute_hits
from llm_model import MODEL, library

FOLDER = "/root/testdata/sf0.001"


def test_run_like_brute_force(spark, documents, texts, benchmark_items):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    net = quality.fit(documents, labels)
    kept = [i for i in sorted(texts) if quality.probabilities(net, [texts[i].encode()])[0] >= 0.5]
    first = {}
    for i in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    kept = sorted(first.values())
    roots = brute_components([brute_fingerprint(texts[i]) for i in kept])
    kept = [i for k, i in enumerate(kept) if roots[k] == k]
    kept = [i for i in kept if not brute_hits(texts[i], benchmark_items)[1]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(got) == kept and 0 < len(kept) < len(texts)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i in kept:
        ids = library().encode(texts[i], add_eos=True)
        assert (got[i].n_tokens, got[i].ids, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), ids, digest(" ".join(map(str, ids))), digest(library().decode(ids)))


def test_stages_keep_columns_and_odd_rows(spark, odd, empty, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, str(tmp_path)).count() == odd.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece encoding"]
    assert len(bpe.load_vocabulary(MODEL)) == 32000
