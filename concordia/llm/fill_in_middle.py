"""Fill-in-the-middle: parts of a text trade places, so that a model learns to write a middle.

Cuts are counted in units: a run of letters A-Z, in either case, is one, and every other code point is one.
A text is stored as its maximal runs of a class (letters or not) with the units before each, so a cut is found by
binary search for its run, and its offset by arithmetic: the start of a run of letters, or the start
of another run and one code point a unit.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_of, map_batches

MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are transformed, and of these so many have the suffix first.
RATE, SPM_RATE = 90, 20


@dataclass
class Runs:
    """Maximal runs of one class: first code point of each, whether it is letters, and the units before it (last:
    units of the text)."""

    starts: np.ndarray
    letters: np.ndarray
    before: np.ndarray
    size: int

    @classmethod
    def of(cls, text: str) -> Runs:
        try:  # a byte is a code point in most texts
            codes = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (codes | 32) - codes.dtype.type(97) < 26
        starts = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]])) if len(codes) else np.zeros(0, int)
        letters, lengths = letter[starts], np.diff(starts, append=len(codes))
        return cls(starts, letters, np.concatenate([[0], np.cumsum(np.where(letters, 1, lengths))]), len(codes))

    @property
    def units(self) -> int:
        return int(self.before[-1])

    def offset(self, units: int) -> int:
        """The code point behind so many units."""
        if units >= self.units:
            return self.size
        run = int(np.searchsorted(self.before, units, "right")) - 1
        return int(self.starts[run]) + units - int(self.before[run])  # a cut never lies within a run of letters


def draws(doc_id: int | None) -> list[int]:
    """Four numbers of a document: the first groups of eight digits of a digest of its id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    output: str
    prefix_chars: int | None = None
    middle_chars: int | None = None


def transform(doc_id: int | None, text: str, rate: int = RATE, spm_rate: int = SPM_RATE) -> Cut:
    runs = Runs.of(text)
    n, (h1, h2, h3, h4) = runs.units, draws(doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return Cut(n, "plain", text)
    a, b = (runs.offset(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return Cut(n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a)
    return Cut(n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a)


def fill_in_middle(documents: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row for each row of documents(doc_id, text): doc_id, n (units), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain), output.

    A null or empty text, and one that has a mark already, stays plain. A null doc_id draws as an empty one; rows
    that repeat an id and a text give equal rows; equal draws make an empty middle; an empty table gives no
    rows; other columns are ignored. Texts are whole, and time and memory grow in proportion to a
    text's length. No shuffle.
    """

    def start():
        def each(batch):
            cuts = [transform(i, t or "", rate, spm_rate) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            column = lambda name, kind: pa.array([getattr(c, name) for c in cuts], kind)
            yield batch_of(
                doc_id=batch["doc_id"], n=column("n", pa.int64()), form=column("form", pa.string()), prefix_chars=column("prefix_chars", pa.int64()),
                middle_chars=column("middle_chars", pa.int64()), output=column("output", pa.string()),
            )

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", F.col("text")), start, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone. No part holds a mark, so each mark stands once."""
    first, last = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    behind = F.substring(first, 4, 2**31 - 1)  # without the mark that opens the output
    of = lambda mark, side: F.substring_index(behind, mark, side)
    return F.when(form == "plain", output).when(form == "psm", F.concat(of(SUFFIX, 1), last, of(SUFFIX, -1))).when(form == "spm", F.concat(of(PREFIX, -1), last, of(PREFIX, 1)))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op13."""
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: DuckDB. Units are listed here and parts joined from them; the text that an output gives back is the text.
ORACLE_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4, CAST(len(us) AS BIGINT) AS n FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(us[1 : a], '') AS prefix, array_to_string(us[a + 1 : b], '') AS middle, array_to_string(us[b + 1 :], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
