"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The vocabulary's matches come from an Aho-Corasick automaton in order of their end, the longest
first. For each end only the best score and its number of pieces are carried. Ties go as in the
library's unigram encoder: of equal scores, the piece that starts first (the longest) stays, and
the unknown-character edge, score least - 10, comes last and only where no piece is the character.
Unknown characters count as their UTF-8 bytes.

The vocabulary files at hand are merge vocabularies, whose scores are ranks and no probabilities.
unigram_vocabulary() gives each piece the log probability that its rank has under Zipf and
Mandelbrot's law, as a multiple of 1/16: single-precision sums, which the library uses, are then
exact to 2**20, and the tests hold the counts against the library with these scores. Scores add up
within a chunk, from one place that no piece spans to the next.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import MEMO, MEMO_CHARS, SPACE, chunk_pattern, load_vocabulary
from .common import Shared, batch_of, map_batches

#: Fixed value of the library: what an unknown character's score lies below the least.
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's shift of ranks, and steps of a score.
SHIFT, STEPS = 2.7, 16


def unigram_vocabulary(vocabulary: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """The same pieces; normal ones with the log probability of their rank by score, then by id."""
    ranked = sorted((i for i, v in enumerate(vocabulary) if v[2] == "n"), key=lambda i: (-vocabulary[i][1], i))
    total = math.log(sum(1 / (r + SHIFT) for r in range(1, len(ranked) + 1)))
    score = {i: round(STEPS * (-math.log(r + SHIFT) - total)) / STEPS for r, i in enumerate(ranked, 1)}
    return [(p, score.get(i, s), kind) for i, (p, s, kind) in enumerate(vocabulary)]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        normal = [(p, s) for p, s, kind in vocabulary if kind == "n"]
        self.unknown = min(s for _, s in normal) - UNKNOWN_PENALTY
        self.machine = ahocorasick.Automaton()
        for p, s in normal:
            self.machine.add_word(p, (len(p), s))
        self.machine.make_automaton()
        self.chunks = chunk_pattern(p for p, _ in normal)
        self.memo: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        best, pieces = [0.0], [0]
        matches = self.machine.iter(text)
        end, found = next(matches, (-1, None))
        for e in range(len(text)):
            score, count, whole = None, 0, False
            while end == e:
                length, s = found
                whole |= length == 1
                if score is None or s + best[e + 1 - length] > score:
                    score, count = s + best[e + 1 - length], pieces[e + 1 - length] + 1
                end, found = next(matches, (-1, None))
            if not whole and (score is None or self.unknown + best[e] > score):
                score, count = self.unknown + best[e], pieces[e] + len(text[e].encode("utf-8", "replace"))
            best.append(score)
            pieces.append(count)
        return pieces[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for c in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            if (n := memo.get(c)) is None:
                n = self.chunk(c)
                if len(c) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[c] = n
            total += n
        return total


def count_tokens(documents: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens for each row of documents(doc_id, text).

    A null or empty text has 0 of both; repeated rows are counted one by one; other columns are
    ignored. No shuffle.
    """
    shared = Shared(documents.sparkSession, unigram_vocabulary(load_vocabulary(model)))

    def start():
        counter = shared.build(UnigramCounter)

        def each(batch):
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield batch_of(doc_id=batch["doc_id"], n_chars=pa.array([*map(len, texts)], pa.int64()), n_tokens=pa.array([*map(counter.count, texts)], pa.int64()))

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), start, f"doc_id {kind}, n_chars bigint, n_tokens bigint")
