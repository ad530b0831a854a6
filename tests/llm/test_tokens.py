"""Token counts and merge encoding against the sentencepiece library."""

import hashlib

from hypothesis import given, settings, strategies as st

from concordia.llm import bpe, token_counts
from llm_model import MODEL, library, unigram_library

CODEC = bpe.MergeCodec(bpe.load_vocabulary(MODEL))
COUNTER = token_counts.UnigramCounter(token_counts.unigram_vocabulary(bpe.load_vocabulary(MODEL)))
LETTERS = st.text(alphabet=st.sampled_from("aetionr sTh▁\n\té漢😀1,.\x00"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_any_text_like_the_library(text):
    ids = library().encode(text, add_eos=True)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == library().decode(ids)
    assert COUNTER.count(text) == len(unigram_library().encode(text))


def test_documents_like_the_library(spark, documents, texts):
    got = {r.doc_id: r for r in bpe.roundtrip(documents, MODEL).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(documents, MODEL).collect()}
    for i, t in texts.items():
        ids = library().encode(t, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library().decode(ids).encode()).hexdigest()
        assert (counts[i].n_chars, counts[i].n_tokens) == (len(t), len(unigram_library().encode(t)))


def test_every_piece_like_the_plain_merges():
    for k in range(300, 32000, 37):
        piece = CODEC.vocabulary[k][0].replace(bpe.SPACE, " ")
        assert CODEC.segment(CODEC.vocabulary[k][0]) == CODEC.merged(CODEC.vocabulary[k][0]), piece


def test_odd_rows(odd, empty):
    rows = bpe.encode(odd, MODEL).collect()
    assert len(rows) == odd.count() and [r.ids for r in rows if r.doc_id == 0] == [[2]]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, MODEL), MODEL).collect()}
    assert back[10] == "ok 漢字 😀 \x00 é  x" and back[0] == "" and back[9].endswith("end")
    counts = token_counts.count_tokens(odd, MODEL).collect()
    assert [r.n_tokens for r in counts if r.doc_id == 0] == [0] and len(counts) == odd.count()
    assert bpe.roundtrip(empty, MODEL).count() == bpe.encode(empty, MODEL).count() == token_counts.count_tokens(empty, MODEL).count() == 0


def test_a_vocabulary_with_inner_spaces_keeps_the_text_whole():
    assert bpe.chunk_pattern(["a▁b", "x"]).findall("▁a▁b\n") == ["▁a▁b\n"]
    assert bpe.chunk_pattern(["▁a", "b\n"]).findall("▁a▁b\nc") == ["▁a", "▁b\nc"]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.MergeCodec(CODEC.vocabulary)
    assert own.encode("one two three four five six") == library().encode("one two three four five six", add_eos=True)
    assert len(own.memo) <= 3
