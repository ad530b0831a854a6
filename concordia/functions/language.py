"""Language votes, chat intents and guards as Column expressions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, StringType

from . import text as T


#: Own lists of glue words; English ones win ties.
GLUE = {
    "en": "what who when where why how which is are was were be the and or of to in on it that this tell about for with".split(),
    "es": "que el la los las de del y en un una es por para con como quien cuando donde se su".split(),
    "fr": "que le la les des de du et en un une est pour avec comme qui quand où dans sur pas".split(),
    "de": "was wer wann wo warum wie der die das und oder ist sind war in zu mit für nicht ein eine".split(),
    "pl": "czy co kto kiedy gdzie dlaczego jak jest są był być nie się na do z to ten ta i oraz lub ale dla przez".split(),
}
#: Polish glue that other languages have too: it counts only beside a word or letter that is Polish alone.
SHARED = "co jak na do z to ten ta i ale".split()
CUES = {"es": ("[¿¡]", 3, "ñ", 2), "fr": ("[çœ]", 2, "[êèù]", 2), "de": ("ß", 3, "[äöü]", 2), "pl": ("[ąćęłńśźż]", 3, "[ąćęłńśźż]", 0)}
#: The script that only Korean has, and own lists of content words, folded, for texts without glue words.
HANGUL = "[\uac00-\ud7af]"
CONTENT = {
    "es": "libro historia verdad mundo cielo vida muerte filosofia".split(), "fr": "livre histoire verite monde ciel mort philosophie".split(),
    "de": "buch geschichte wahrheit welt himmel leben philosophie".split(), "pl": "ksiega historia prawda swiat niebo zycie smierc filozofia".split(),
}


def detect_language(question: Column) -> Column:
    """Korean by its script; else the language with most glue words and character cues, if one leads English; English
    if it has glue words at all; else the first language with a content word; else English."""
    lit = lambda own: F.array(*[F.lit(w) for w in own])
    low = F.lower(question)
    words = F.array_distinct(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    # structs in arrays of one hold what several branches use, so that it is made once
    held = F.array(F.struct(low.alias("low"), words.alias("words")))

    def votes(x: Column) -> Column:
        count = lambda own: F.size(F.array_intersect(x["words"], lit(own)))
        out = {}
        for k, own in GLUE.items():
            a, n, b, m = CUES.get(k, ("", 0, "", 0))
            out[k] = count(own) + (F.when(x["low"].rlike(a), n).otherwise(0) if n else 0) + (F.when(x["low"].rlike(b), m).otherwise(0) if m else 0)
        sure = x["low"].rlike(CUES["pl"][0]) | (count([w for w in GLUE["pl"] if w not in SHARED]) > 0)
        out["pl"] = F.when(sure, out["pl"]).otherwise(0)
        return F.struct(x["low"].alias("low"), *[v.alias(k) for k, v in out.items()])

    rest = [k for k in GLUE if k != "en"]

    def leader(v: Column) -> Column:
        """The language that leads alone, en for ties and weak matches; null if no glue word says anything."""
        top = F.greatest(*[v[k] for k in rest])
        alone = sum((v[k] == top).cast("int") for k in rest) == 1
        out = F.when(v["en"] > 0, "en")
        for k in rest:
            out = F.when((top > v["en"]) & alone & (v[k] == top), k).otherwise(out)
        return out

    folded = F.array_distinct(F.split(F.translate(low, *T.ACCENTS), "[^a-z]+"))
    by_content = F.lit("en")
    for k in reversed(CONTENT):
        by_content = F.when(F.arrays_overlap(folded, lit(CONTENT[k])), k).otherwise(by_content)
    by_glue = F.transform(F.transform(held, votes), leader)[0]
    return F.when(question.rlike(HANGUL), "ko").otherwise(F.coalesce(by_glue, by_content))


def chat_models(ids: Column) -> Column:
    """Of a service's model names those that chat: no blank ones, none for embeddings."""
    return F.filter(ids, lambda m: m.isNotNull() & (F.trim(m) != "") & ~F.lower(m).contains("embed"))


#: (intent, pattern) in order; the first that fits decides.
INTENTS = [
    ("greeting", r"^(hi|hello|hey|good (morning|evening|day))( there)?[.! ]*$"),
    ("thanks", r"^(thanks|thank you|many thanks)\b.*$"),
    ("more", r"^(more|tell me more|go on|continue|say more)[.! ]*$"),
    ("paper", r"^(please )?(open|read|show|go to|summarize) (the )?paper [0-9]{1,3}$"),
]
TRIMS = [
    r"(?i)^(hi|hello|hey|good (morning|evening|day))[\s,!.-]*", r"(?i)\b(can|could|would) you (please )?(tell me|explain|show me|find)( about)?\s*",
    r"(?i)\bi (want|need|would like) to (know|learn|understand)( about)?\s*", r"(?i)\bplease\s*", r"(?i)[\s,.;!-]*\b(thank you|thanks)( (so|very) much)?[\s,.!]*$",
]


def chat_intent(message: Column) -> Column:
    q = F.trim(F.regexp_replace(F.lower(message), r"\s+", " "))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(INTENTS):
        out = F.when(q.rlike(pattern), kind).otherwise(out)
    return out


def trim_chat(message: Column) -> Column:
    """The message without courtesies."""
    for pattern in TRIMS:
        message = F.regexp_replace(message, pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(message, r"\s+([,.?!])", "$1"), r"\s+", " "))


def plain(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z'\s]", " "), r"\s+"), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def guard_intro(intro: Column, passage: Column) -> Column:
    """Whether an introduction may be shown: no quotation, citation or list, two sentences and 260
    characters at most, and no five words in a row of the passage."""
    t = F.trim(F.regexp_replace(F.regexp_replace(intro, "[*_#`>]", ""), r"\s+", " "))
    bad = t.rlike('["“”«»„]') | t.rlike(r"[0-9]{1,3}:[0-9]{1,2}") | t.rlike(r"(^|\s)(-|[0-9]+\.)\s")
    long = (F.length(t) > 260) | (F.size(F.regexp_extract_all(t, F.lit("([^.!?]+[.!?]+)"))) > 2)
    return (t != "") & ~bad & ~long & ~F.coalesce(F.arrays_overlap(grams(plain(t), 5), grams(plain(passage), 5)), F.lit(False))


def osa_distance(a: str, b: str, most: int = 2) -> int:
    """Edits with swaps of neighbours, most + 1 if more are needed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        rows = [rows[-1], row]
    return rows[-1][-1]


#: Letters up to which words are compared many at once.
SHORT = 64


def osa_distances(a: list[str], b: list[str], most: int = 2) -> np.ndarray:
    """osa_distance() of each a with its b: all pairs of short words step by step together, `most` cells to either
    side of the diagonal."""
    la, lb = (np.fromiter(map(len, s), int, len(s)) for s in (a, b))
    out = np.full(len(la), most + 1, np.int32)
    long = np.maximum(la, lb) > SHORT
    for i in np.flatnonzero(long):
        out[i] = osa_distance(a[i], b[i], most)
    at = np.flatnonzero(~long & (np.abs(la - lb) <= most))
    if not len(at):
        return out
    # letters in rows, a row for each place, with places before the first and behind the last ones
    x, y = (np.pad(np.array([s[i] for i in at], f"U{SHORT}").view(np.uint32).reshape(len(at), SHORT).T, ((2, most + 2), (0, 0))) for s in (a, b))
    la, lb, far = la[at], lb[at], np.full(len(at), most + 1, np.int32)
    ends = np.full(len(at), most + 1, np.int32)
    before, last = {}, {k: np.full(len(at), k, np.int32) for k in range(most + 1)}  # by place in b less place in a
    for i in range(la.max() + 1):
        row = last if i == 0 else {}
        for k in range(-most, most + 1) if i else ():
            j = i + k
            if j < 0:
                continue
            cell = np.minimum(np.minimum(last.get(k + 1, far), row.get(k - 1, far)) + 1, far)
            if j:
                cell = np.minimum(cell, last.get(k, far) + (x[i + 1] != y[j + 1]))
            if i > 1 and j > 1:
                swap = (x[i + 1] == y[j]) & (x[i] == y[j + 1])
                cell = np.where(swap, np.minimum(cell, before.get(k, far) + 1), cell)
            row[k] = cell
        for k, cell in row.items():
            ends = np.where((la == i) & (lb == i + k), cell, ends)
        before, last = (last, row) if i else ({}, row)
    out[at] = np.minimum(ends, most + 1)
    return out


@F.pandas_udf(IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(osa_distances(a.tolist(), b.tolist()), dtype="int32")


def title_case(text: str) -> str:
    return re.sub(r"[^\W\d_]+(?:['’][^\W\d_]+)?", lambda m: m[0][0].upper() + m[0][1:].lower(), text)


#: Korean particles, longest first.
PARTICLES = ("에서는", "으로는", "에게서", "이라는", "에서", "에게", "으로", "부터", "까지", "은", "는", "이", "가", "을", "를", "의", "에", "도", "와", "과", "로", "만")


def strip_particles(word: str) -> str:
    """Particles go one by one while a stem of two syllables stays."""
    while True:
        cut = next((p for p in PARTICLES if word.endswith(p) and len(word) - len(p) >= 2), None)
        if cut is None:
            return word
        word = word[: -len(cut)]


def first_json(text: str) -> str | None:
    """The first balanced JSON object inside a chatty text."""
    import json

    at = text.find("{")
    while at >= 0:
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None




@F.pandas_udf(StringType())
def title_case_udf(text: pd.Series) -> pd.Series:
    return text.map(title_case, na_action="ignore")


@F.pandas_udf(StringType())
def strip_particles_udf(word: pd.Series) -> pd.Series:
    return word.map(strip_particles, na_action="ignore")


@F.pandas_udf(StringType())
def first_json_udf(text: pd.Series) -> pd.Series:
    return text.map(first_json, na_action="ignore")
