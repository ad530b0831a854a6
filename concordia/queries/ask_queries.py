"""Plain-language questions: whole batches, a folded language, and two questions that SQL states in full."""

from __future__ import annotations

from ..operators import ask as ASK
from ..registry import query
from ..sources.corpus import PARAGRAPHS_SQL as P
from .search_queries import spread_pars as pars

ASK_RULES = ASK.Rules(terms={"theth": ["thand", "thanon"], "reenti": ["reanthe"]}, specific={"thand"}, names=None)
QUESTIONS = ["What is the tionre of ereati (thionesander)?", "How many anthe in paper 5?", "theth er's ing"]


@query()
def ask_batch(spark, sf_dir):
    """Three questions at once, names and headings from the corpus: every kind of search and boost."""
    return ASK.answer(pars(spark, sf_dir, headings=True), QUESTIONS, ASK_RULES)


@query()
def ask_folded(spark, sf_dir):
    """A French question with accents folded away on both sides."""
    rules = ASK.Rules(terms={"verite": ["queelle"]}, asking={"que", "est", "quoi", "dans"}, fold=True)
    return ASK.answer(pars(spark, sf_dir).filter("author = 'fr'"), ["Où est la vérité entre eux?"], rules)


#: Two questions whose plan doesn't depend on the corpus: (question, own words, mapped terms).
ASKED = [("Anthe tionre?", ["anthe", "tionre"], {"anthe": ["thand", "thionan"]}), ("What schen quemente?", ["schen", "quemente"], {})]


def _ask_sql() -> str:
    """Searches of the question's words and of mapped terms, their order and gate; whole words, headings, word order."""
    parts, boosts = [], []
    for q, (_, words, terms) in enumerate(ASKED):
        searches = [(" ".join(words), 1.0, "own words", "true"), *((t, 1.2, t, "false") for ts in terms.values() for t in ts)]
        for n, (asked, weight, label, own) in enumerate(searches):
            ts = asked.split()
            counts = [rf"len(regexp_extract_all(f, '\b{t}\w*'))" for t in ts]
            matched, hits, phrase = " + ".join(f"({c} > 0)::INT" for c in counts), " + ".join(counts), r"\s+".join(ts)
            parts.append(
                rf"""SELECT {q} AS qid, {q * 10 + n} AS no, {weight}::DOUBLE AS weight, '{label}' AS label, {own} AS own, ref, paper, section, par,
  CASE WHEN regexp_matches(f, '\b{phrase}\b') THEN 100.0 WHEN {matched} = {len(ts)} THEN 50.0 ELSE ({matched}) * 10.0 END + least({hits}, 49) / 50.0 AS raw FROM form WHERE {hits} > 0"""
            )
        whole = " AND ".join(rf"regexp_matches(f, '\b{w}\b')" for w in words if len(w) >= 4)
        heading = " AND ".join(rf"regexp_matches(heading, '\b{w}(?:s|es)?\b')" for w in words)
        a, b = words[:2]
        boosts.append(f"SELECT {q} AS qid, ref, 2.5::DOUBLE AS s, 'exact words' AS label, 0 AS kind, {q * 10} AS upto FROM form WHERE {whole}")
        boosts.append(f"SELECT {q}, ref, 1.5, 'section about it', 1, 0 FROM form WHERE {heading}")
        boosts.append(rf"SELECT {q}, ref, 1.5, '{b} of {a}', 2, 0 FROM form WHERE regexp_matches(f, '\b{b}s?\s+of\s+(?:[a-z-]+\s+){{0,2}}?{a}\b')")
    return (
        P
        + r""", head AS (SELECT doc_id AS section, lower(regexp_extract(text, '(?m)^[ \t]*(\S.*)$', 1)) AS heading FROM documents),
form AS (SELECT ref, paper, section, par, translate(lower(text), '‘’“”', '''''""') AS f, heading FROM paragraphs JOIN head USING (section)),
raw AS ("""
        + " UNION ALL ".join(parts)
        + """), r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY raw DESC, paper, section, par) - 1 AS i FROM raw),
kept AS (SELECT *, count(*) FILTER (WHERE own AND raw >= 50) OVER (PARTITION BY no) AS direct FROM r WHERE i < 40),
first AS (SELECT qid, ref, min(no) AS first FROM kept GROUP BY ALL), boost AS ("""
        + " UNION ALL ".join(boosts)
        + """), b AS (SELECT b.*, first, count(*) OVER (PARTITION BY b.qid, label) AS n, count(*) FILTER (WHERE first <= upto) OVER (PARTITION BY b.qid, label) AS few
  FROM boost b LEFT JOIN first f ON f.qid = b.qid AND f.ref = b.ref),
pts AS (SELECT qid, ref, (raw / 100 + (40 - i) / 160.0) * weight + CASE WHEN own AND raw >= 50 AND direct <= 8 THEN 2.0 ELSE 0 END AS s, label, no, i FROM kept
  UNION ALL SELECT qid, ref, s, label, 1048576, 0 FROM b WHERE CASE kind WHEN 0 THEN coalesce(first <= upto, false) AND few <= 8 WHEN 1 THEN first IS NOT NULL ELSE first IS NOT NULL OR n <= 300 END),
t AS (SELECT qid, ref, sum(s) AS score, array_to_string(list_sort(list_distinct(list(label))), ', ') AS why, min((no, i)) AS first FROM pts GROUP BY qid, ref),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first, ref) AS place FROM t)
SELECT qid, CAST(place AS INTEGER) AS place, ref, round(score, 4)::DOUBLE AS score, why, CASE WHEN place <= 5 THEN 'best' ELSE 'more' END AS part FROM p WHERE place <= 15"""
    )


@query(_ask_sql())
def ask_ranked(spark, sf_dir):
    """Two questions with a fixed rule table, in full: searches, gate, whole words, headings, word order, places."""
    rules = ASK.Rules(terms={k: v for _, _, terms in ASKED for k, v in terms.items()}, names=set())
    return ASK.answer(pars(spark, sf_dir, headings=True), [q for q, _, _ in ASKED], rules)
