"""Language identification in two steps: the language family first, then linear support vector
machines, one against one, between the languages of that family.

Features are hashed byte trigrams of the lower-cased text (square roots of counts, unit length).
The machines minimise the squared hinge loss with an L2 penalty by accelerated gradient descent.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Shared, batch_of, map_batches
from .quality import fold

#: Families of languages by ISO 639-1 code. A language without an entry is its own family.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "ru": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
}
BUCKETS = 4096
#: Bound of the training sample: rows of each language, whose texts are taken whole.
SAMPLE_ROWS = 500
PENALTY, ROUNDS = 1e-3, 150
UNDETERMINED = "und"


def features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, t in enumerate(texts):
        b = np.frombuffer(b" " + t.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
            v = np.sqrt(np.bincount(code, minlength=BUCKETS)).astype(np.float32)
            out[k] = v / np.linalg.norm(v)
    return out


def train_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y: 1 or -1. Weights and, last, the offset."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * 2 * cost.sum() + PENALTY)
    for k in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (PENALTY * ahead - 2 * x.T @ (cost * slack * y))
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Identifier:
    families: dict[str, list[str]] = field(default_factory=dict)
    #: (a, b) of two families, or of two languages of one: positive values speak for a.
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _vote(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the name that wins most of its pairs, the larger sum of margins among equals, and
        the probability of its closest win."""
        votes, margin = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        closest = np.full((len(x), len(names)), np.inf)
        for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
            w = self.machines[a, b]
            m = x @ w[:-1] + w[-1]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            margin[:, i] += m
            margin[:, j] -= m
            closest[:, i] = np.minimum(closest[:, i], m)
            closest[:, j] = np.minimum(closest[:, j], -m)
        win = (votes + 1e-3 * np.tanh(margin)).argmax(axis=1)
        return win, 1 / (1 + np.exp(-4 * closest[np.arange(len(x)), win]))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        x = features(texts)
        names = sorted(self.families)
        family, sure = self._vote(x, names)
        out, score = np.empty(len(texts), object), np.zeros(len(texts))
        for k, name in enumerate(names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                language, p = self._vote(x[rows], self.families[name])
                out[rows], score[rows] = np.array(self.families[name], object)[language], sure[rows] * p
        for k, t in enumerate(texts):
            if not any(map(str.isalpha, t)):
                out[k], score[k] = UNDETERMINED, 0.0
        return list(out), score


def train(texts: list[str], langs: list[str]) -> Identifier:
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        groups.setdefault(FAMILIES.get(lang, lang), []).append(lang)
    found = Identifier(groups)
    x, lang, family = features(texts), np.array(langs, object), np.array([FAMILIES.get(v, v) for v in langs], object)
    for names, own in [(sorted(groups), family), *((g, lang) for g in groups.values())]:
        for a, b in itertools.combinations(names, 2):
            rows = (own == a) | (own == b)
            found.machines[a, b] = train_machine(x[rows], np.where(own[rows] == a, 1, -1).astype(np.float32))
    return found


def fit(documents: DataFrame, rows: int = SAMPLE_ROWS) -> Identifier:
    """Learns from documents(doc_id, text, lang) outside the held-out fold with a text and a lang: of each
    language the `rows` texts whose doc_id hashes least, the same each time. Equal rows count once; an
    empty table gives an identifier without languages, one language is predicted always."""
    known = documents.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    # first the ids and digests, without the texts; only the chosen texts are collected
    keys = known.select("lang", "doc_id", F.xxhash64("text").alias("h")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h"))
    few = keys.withColumn("n", first).filter(F.col("n") <= rows).drop("n")
    # broadcast: `rows` ids of each language
    texts = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(few), ["lang", "doc_id", "h"]).groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    got = sorted(texts.collect(), key=lambda r: (str(r.doc_id), r.lang, r.h))
    return train([r.text for r in got], [r["lang"] for r in got]) if got else Identifier()


def identify(documents: DataFrame, found: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents(doc_id, text).

    lang_pred is a language of the training rows, or und (score 0) for a text that is null, empty or has no
    letter; score is the product of the probabilities of the closest family and language decision. Of
    names with equally many wins the one with the larger margins, then the first by name, is taken.
    Repeated rows are judged one by one and alike; an empty table gives no rows; a null doc_id is not
    held out; other columns are ignored. No shuffle.
    """
    shared = Shared(documents.sparkSession, found)

    def start():
        def each(batch):
            texts = [t or "" for t in batch["text"].to_pylist()]
            lang, score = [], []
            for i in range(0, len(texts), 250):
                a, b = shared.value.predict(texts[i : i + 250])
                lang += a
                score += [float(v) for v in b]
            yield batch_of(doc_id=batch["doc_id"], lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = map_batches(documents.select("doc_id", "text"), start, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
