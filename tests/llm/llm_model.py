from functools import cache

import sentencepiece

from concordia.llm import bpe, token_counts
from unigram_model import unigram_model

with open(bpe.model_path(), "rb") as f:
    MODEL = f.read()


@cache
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@cache
def unigram_library():
    scores = [s for _, s, _ in token_counts.unigram_vocabulary(bpe.load_vocabulary(MODEL))]
    return sentencepiece.SentencePieceProcessor(model_proto=unigram_model(MODEL, scores))
