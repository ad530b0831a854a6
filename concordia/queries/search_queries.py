"""Search, lookups, predicates and corpus statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import ask as ASK, rules as RL, search as S
from ..registry import query, table
from ..sources.corpus import PARAGRAPHS_SQL as P, paragraphs, spread

QUERY, TERMS = "Tion er ing", ["tion", "er", "ing"]
_FORM = "translate(lower(text), '‘’“”', '''''\"\"')"
_SCORED = (
    P
    + rf""", counted AS (
  SELECT *, len(regexp_extract_all(f, '\btion\w*')) AS c1, len(regexp_extract_all(f, '\ber\w*')) AS c2, len(regexp_extract_all(f, '\bing\w*')) AS c3 FROM (SELECT *, {_FORM} AS f FROM paragraphs)
), matched AS (SELECT *, (c1 > 0)::INT + (c2 > 0)::INT + (c3 > 0)::INT AS matched, c1 + c2 + c3 AS hits FROM counted),
scored AS (
  SELECT *, CASE WHEN regexp_matches(f, '\btion\s+er\s+ing\b') THEN 100.0 WHEN matched = 3 THEN 50.0 ELSE matched * 10.0 END + least(hits, 49) / 50.0 AS raw FROM matched WHERE matched > 0
)"""
)


def pars(spark: SparkSession, sf_dir: str, headings: bool = False) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "documents"), headings)


def spread_pars(spark: SparkSession, sf_dir: str, headings: bool = False) -> DataFrame:
    """pars() for work of many steps a row: a small corpus is dealt over all cores first."""
    return paragraphs(spread(table(spark, sf_dir, "documents")), headings)


@query(f"{_SCORED} SELECT ref, paper, section, par, text, CAST(matched AS INTEGER) AS matched, CAST(hits AS INTEGER) AS hits, round(CAST(raw AS DOUBLE), 4) AS score FROM scored ORDER BY raw DESC, paper, section, par LIMIT 20")
def search_ranked(spark, sf_dir):
    """The flagship: ranked keyword and phrase search over all paragraphs."""
    return S.search(pars(spark, sf_dir), QUERY).select("ref", "paper", "section", "par", "text", "matched", "hits", S.rounded(F.col("score")).alias("score"))


@query(f"{_SCORED} SELECT ref, paper, round(CAST(raw AS DOUBLE), 4) AS score FROM scored WHERE paper = 3 ORDER BY raw DESC, paper, section, par LIMIT 50")
def search_paper(spark, sf_dir):
    return S.search(pars(spark, sf_dir), QUERY, paper=3, limit=50).select("ref", "paper", S.rounded(F.col("score")).alias("score"))


@query(f"{_SCORED} SELECT count(*) AS total, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (WHERE matched = 3) AS all_terms, count(DISTINCT paper) AS papers FROM scored")
def search_total(spark, sf_dir):
    """What a search counts before its limit."""
    found = S.scored(pars(spark, sf_dir), QUERY)
    return found.agg(F.count("*").alias("total"), F.sum("hits").alias("hits"), F.count_if(F.col("matched") == 3).alias("all_terms"), F.count_distinct("paper").alias("papers"))


@query(
    f"""{_SCORED}, top AS (SELECT * FROM scored ORDER BY raw DESC, paper, section, par LIMIT 20),
around AS (SELECT ref, string_agg(text, '|') OVER (PARTITION BY section ORDER BY par ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, string_agg(text, '|') OVER (PARTITION BY section ORDER BY par ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM paragraphs)
SELECT ref, coalesce(before, '') AS before, coalesce(after, '') AS after FROM top JOIN around USING (ref)"""
)
def search_context(spark, sf_dir):
    """Two paragraphs of the same section before and after each result."""
    p = pars(spark, sf_dir)
    found = S.with_context(S.search(spread_pars(spark, sf_dir), QUERY).select("ref", "section"), p, 2)
    return found.select("ref", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"{_SCORED} SELECT ref, round(CAST(raw AS DOUBLE), 2) AS score FROM scored ORDER BY round(CAST(raw AS DOUBLE), 2) DESC, paper, section, par LIMIT 100")
def search_rounded_order(spark, sf_dir):
    """The client's order: scores at two places, then load order."""
    found = S.scored(pars(spark, sf_dir), QUERY).withColumn("score", F.round("score", 2))
    return S.ranked(found, 100).select("ref", "score")


_AT = r"strpos(f, regexp_extract(f, '\btion\w*')) - 1"


@query(
    f"""{_SCORED}, hit AS (SELECT ref, text, greatest({_AT} - 40, 0) AS a FROM scored WHERE c1 > 0)
SELECT ref, CASE WHEN a > 0 THEN '...' ELSE '' END || substr(text, a + 1, 120) || CASE WHEN a + 120 < length(text) THEN '...' ELSE '' END AS snippet FROM hit"""
)
def search_snippet(spark, sf_dir):
    p = pars(spark, sf_dir).filter(T.search_form(F.col("text")).rlike(T.prefix_pattern("tion")))
    at = F.greatest(F.instr(T.search_form(F.col("text")), F.regexp_extract(T.search_form(F.col("text")), f"({T.prefix_pattern('tion')})", 1)) - 1 - 40, F.lit(0))
    cut = F.substring("text", at + 1, F.lit(120))
    return p.select("ref", F.concat(F.when(at > 0, "...").otherwise(""), cut, F.when(at + 120 < F.length("text"), "...").otherwise("")).alias("snippet"))


@query(P + r""" SELECT ref, regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(\btion\w*)', '<mark>\1</mark>', 'g') AS marked FROM paragraphs WHERE regexp_matches(text, '\btion\w*')""")
def search_highlight(spark, sf_dir):
    p = pars(spark, sf_dir).filter(F.col("text").rlike(T.prefix_pattern("tion")))
    return p.select("ref", T.highlight(F.col("text"), T.prefix_pattern("tion")).alias("marked"))


@query(
    P
    + """, asked AS (SELECT doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN 'page ' || doc_id ELSE substr(source, 4) || ':' || doc_id || '.' || (doc_id % 5 + 1) END AS ref FROM documents)
SELECT pos, a.ref, p.paper, p.text, CASE WHEN pos % 7 = 0 THEN 'Bad reference; use Paper:Section.Paragraph' WHEN p.text IS NULL THEN 'Reference not found' END AS error FROM asked a LEFT JOIN paragraphs p ON a.ref = p.ref"""
)
def point_lookup(spark, sf_dir):
    """References in order, with errors as rows."""
    docs = table(spark, sf_dir, "documents")
    made = F.concat_ws("", F.substring("source", 4, 9), F.lit(":"), F.col("doc_id").cast("string"), F.lit("."), (F.col("doc_id") % 5 + 1).cast("string"))
    asked = docs.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("page "), F.col("doc_id").cast("string"))).otherwise(made).alias("ref"))
    return S.lookup(asked, pars(spark, sf_dir))


@query(P + " SELECT ref, par, text FROM paragraphs WHERE paper = 5 AND section = 5 ORDER BY par")
def section_scan(spark, sf_dir):
    return pars(spark, sf_dir).filter("paper = 5 AND section = 5").select("ref", "par", "text").orderBy("par")


@query(P + " SELECT DISTINCT paper, author FROM paragraphs")
def list_papers(spark, sf_dir):
    return pars(spark, sf_dir).select("paper", "author").distinct()


@query(
    P
    + r""", w AS (SELECT paper, count(*) AS n, sum(len(list_filter(regexp_split_to_array(trim(text, chr(32)), '\s+'), lambda x: x <> ''))) AS words FROM paragraphs GROUP BY paper)
SELECT paper, CAST(n AS BIGINT) AS paragraphs, CAST(words AS BIGINT) AS words FROM w UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(words) AS BIGINT) FROM w"""
)
def corpus_stats(spark, sf_dir):
    """Paragraphs and words of each paper, and of all by rollup."""
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    return pars(spark, sf_dir).rollup("paper").agg(F.count("*").alias("paragraphs"), F.sum(n).alias("words"))


@query(
    P
    + rf""", f AS (SELECT {_FORM} AS f FROM paragraphs)
SELECT 'tion' AS term, count(*) FILTER (WHERE regexp_matches(f, '\btion\w*')) AS df FROM f UNION ALL SELECT 'er', count(*) FILTER (WHERE regexp_matches(f, '\ber\w*')) FROM f
UNION ALL SELECT 'zzz', count(*) FILTER (WHERE regexp_matches(f, '\bzzz\w*')) FROM f"""
)
def term_frequency(spark, sf_dir):
    return S.document_frequency(spread_pars(spark, sf_dir), ["tion", "er", "zzz"])


_TOKENS = P + r""", tokens AS (SELECT ref, paper, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM paragraphs)"""


def _tokens(spark, sf_dir) -> DataFrame:
    return spread_pars(spark, sf_dir).select("ref", "paper", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"))).alias("word"))


#: Signs that a reference is made of, in their order, and how many _ref_number() takes.
_REF_DIGITS, REF_SIGNS = ("-.0123456789:", "123456789abcd"), 30


def _ref_number(ref: str) -> Column:
    """A reference of REF_SIGNS signs at most as a number of the same order: the least number is held in place by a
    hash aggregate, while for the least string Spark sorts all rows. Sixteen signs and fourteen, as two numbers in one."""
    signs = F.rpad(F.translate(ref, *_REF_DIGITS), REF_SIGNS, "0")
    return F.concat(F.conv(F.substring(signs, 1, 16), 16, 10), F.lpad(F.conv(F.substring(signs, 17, 14), 16, 10), 18, "0")).cast("decimal(38,0)")


def _ref_of(number: str) -> Column:
    """The reference of a _ref_number()."""
    digits = F.lpad(F.col(number).cast("string"), 38, "0")
    signs = F.concat(F.lpad(F.conv(F.substring(digits, 1, 20), 10, 16), 16, "0"), F.lpad(F.conv(F.substring(digits, 21, 18), 10, 16), 14, "0"))
    return F.translate(F.rtrim(F.lower(signs), F.lit("0")), *reversed(_REF_DIGITS))


@query(_TOKENS + " SELECT word, count(DISTINCT ref) AS df, min(ref) AS first_ref FROM tokens GROUP BY word HAVING count(DISTINCT ref) <= 3")
def silence_report(spark, sf_dir):
    """Words that at most three paragraphs have. A paragraph gives each of its words once, so words are counted where
    the texts are read and only counts are shuffled; the paragraphs of documents that come twice, which are looked for
    first, go with their reference, to count once."""
    documents = spread(table(spark, sf_dir, "documents"))
    again = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("id")).agg((F.count("*") > 1).alias("again")).filter("again")
    rows, twice = paragraphs(documents), F.lit(None).cast("string")
    if not again.isEmpty():
        rows, twice = rows.join(again, F.col("section").eqNullSafe(F.col("id")), "left"), F.when(F.col("again"), F.col("ref"))
    # a line's number has ten digits at most
    width = table(spark, sf_dir, "documents").agg(F.max(F.length(F.col("doc_id").cast("string"))), F.max(F.length("source"))).head()
    short = (width[0] or 0) + (width[1] or 0) + 12 <= REF_SIGNS
    words = rows.select((_ref_number("ref") if short else F.col("ref")).alias("ref"), twice.alias("twice"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})")))).alias("word"))
    once = words.groupBy("word", "twice").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"))
    df = F.sum(F.when(F.col("twice").isNull(), F.col("n")).otherwise(1))
    found = once.groupBy("word").agg(df.alias("df"), F.min("first_ref").alias("first_ref")).filter("df <= 3")
    return found.select("word", "df", _ref_of("first_ref").alias("first_ref")) if short else found


@query(_TOKENS + " SELECT word, count(*) AS n FROM tokens GROUP BY word HAVING count(*) >= 2")
def vocabulary(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


@query(
    P
    + r""", names AS (SELECT unnest(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b')) AS name FROM paragraphs)
SELECT name, count(*) AS n FROM names GROUP BY name HAVING count(*) >= 2"""
)
def corpus_names(spark, sf_dir):
    """Runs of two to four capitalised words that come up again."""
    pattern = f"(?<!{T.WORD})([A-Z][a-z]+(?: [A-Z][a-z]+){{1,3}})(?!{T.WORD})"
    return pars(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(pattern))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter("n >= 2")


@query(P + " SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM paragraphs WHERE par = 1")
def title_words(spark, sf_dir):
    """Different words of first lines, which stand for titles here."""
    return pars(spark, sf_dir).filter("par = 1").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"))).alias("word")).distinct()


@query(P + r""", f AS (SELECT ref, lower(text) AS f FROM paragraphs) SELECT ref, CAST(len(regexp_extract_all(f, '\bthe\w*')) AS INTEGER) AS prefix_hits, regexp_matches(f, '\bof\s+the\b') AS phrase FROM f""")
def prefix_and_phrase(spark, sf_dir):
    form = F.lower("text")
    return pars(spark, sf_dir).select("ref", T.count_matches(form, T.prefix_pattern("the")).alias("prefix_hits"), form.rlike(T.phrase_pattern("of the")).alias("phrase"))


GROUPS = [("ant", r"\bant\w*", r"\banthe\w*|\bantion\w*"), ("est", r"\best\w*", r"\besth\w*"), ("und", r"\bund\b", r"\bund\b"), ("lich", r"\blich\w*", r"\blichkeit\w*"), ("que", r"\bque\b", r"\bque\s+la\b")]
SKIPPED = [3, 7]


def java(pattern: str) -> str:
    """An ASCII word boundary for Java: between a word character and none, in either order. Beside a letter it is told
    by the other side alone, and the letter comes first, as most places of a text fail by it."""
    plain = "[A-Za-z0-9_]"
    pattern = re.sub(rf"\\b({plain})(?![?*+{{])", rf"\1(?<!{T.WORD}\1)", pattern)
    pattern = re.sub(rf"(?<![\\].)(?<={plain})\\b", f"(?!{T.WORD})", pattern)
    return pattern.replace(r"\b", f"(?:(?<={T.WORD})(?!{T.WORD})|(?<!{T.WORD})(?={T.WORD}))").replace(r"\w", T.WORD)


_GROUPS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in GROUPS) + ") g(id, article, book)"


def groups_table(spark: SparkSession) -> DataFrame:
    """A rule table: fixed and small, whatever the corpus."""
    return spark.createDataFrame([(a, java(b), java(c)) for a, b, c in GROUPS], "id string, article string, book string")


@query(P + f" SELECT ref, string_agg(id, ',' ORDER BY id) AS groups FROM paragraphs, {_GROUPS_SQL} WHERE paper NOT IN (3, 7) AND regexp_matches(lower(text), book) GROUP BY ref")
def group_match(spark, sf_dir):
    """Paragraphs by regex group, papers of the skip list left out. The rules are literals of one scan:
    no join, and each pattern is compiled once."""
    p = pars(spark, sf_dir).join(F.broadcast(spark.createDataFrame([(k,) for k in SKIPPED], "paper int")), "paper", "left_anti")
    form = F.lower("text")
    hit = F.array_compact(F.array(*[F.when(form.rlike(java(b)), a) for a, _, b in sorted(GROUPS)]))
    return p.select("ref", F.array_join(hit, ",").alias("groups")).filter("groups != ''")


@query(P + r""" SELECT ref, regexp_matches(lower(text), '\b(never|not|no|nothing|only|none|without|pas|nicht)\b') AS limiting, regexp_matches(text, '\b\d{1,3}\.\d{1,3}\b') AS bookish FROM paragraphs""")
def sentence_predicates(spark, sf_dir):
    limiting = java(r"\b(never|not|no|nothing|only|none|without|pas|nicht)\b")
    return pars(spark, sf_dir).select("ref", F.lower("text").rlike(limiting).alias("limiting"), F.col("text").rlike(java(r"\b[0-9]{1,3}\.[0-9]{1,3}\b")).alias("bookish"))


@query(
    P
    + r""", f AS (SELECT ref, regexp_replace(regexp_replace(lower(text), '\((?:[a-z]{2,5}\s*)?[0-9]{1,3}:[^)]*\)', ' ', 'g'), '"[^"]*"', '"…"', 'g') AS f FROM paragraphs),
g AS (SELECT ref, f, strpos(f, regexp_extract(f, '\bthe\b|\bla\b')) AS p, regexp_extract(f, '\bthe\b|\bla\b') AS k FROM f)
SELECT ref, regexp_matches(f, '\bourselves\b') OR (k <> '' AND regexp_matches(substr(f, instr(regexp_replace(f, '\b(the|la)\b', chr(1)), chr(1)), 140), '\bis\b|\bwas\b|\best\b')) AS claim FROM g"""
)
def claim_predicate(spark, sf_dir):
    """An own word, or a subject with a verb within 140 characters; citations and quotations don't count."""
    claim = RL.claims(F.lower("text"), java(r"\bthe\b|\bla\b"), java(r"\bis\b|\bwas\b|\best\b"), java(r"\bourselves\b"))
    return pars(spark, sf_dir).select("ref", claim.alias("claim"))


_SENTENCES = P + r""", sentences AS (
  SELECT ref, paper, section, par, i AS sent, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM paragraphs))
)"""


def sentence_rows(spark, sf_dir) -> DataFrame:
    return spread_pars(spark, sf_dir).select("ref", "paper", "section", "par", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("sent", (F.col("pos") + 1).cast("long")).drop("pos")


@query(_SENTENCES + " SELECT ref, sent, sentence FROM sentences")
def sentence_split(spark, sf_dir):
    return sentence_rows(spark, sf_dir).select("ref", "sent", "sentence")


@query(_SENTENCES + r""" SELECT ref, sent FROM sentences WHERE length(sentence) BETWEEN 80 AND 220 AND regexp_matches(sentence, '[.!?]$') AND regexp_matches(sentence, '^[A-Z]') AND NOT regexp_matches(sentence, '[<>|*]')""")
def usable_sentences(spark, sf_dir):
    return sentence_rows(spark, sf_dir).filter(RL.usable(F.col("sentence"), 80, 220)).select("ref", "sent")


@query(
    _SENTENCES
    + r""", hit AS (SELECT ref, sent, sentence, strpos(lower(sentence), k) AS p, k FROM (SELECT *, regexp_extract(lower(sentence), '\btion\w*|\bing\w*|\ber\w*') AS k FROM sentences) WHERE k <> '')
SELECT ref, sent, k AS keyword, CASE WHEN starts_with(k, 'tion') THEN 'a' WHEN starts_with(k, 'ing') THEN 'b' ELSE 'c' END AS topic FROM hit
WHERE length(sentence) BETWEEN 60 AND 160 AND NOT regexp_matches(sentence, '[0-9"]') AND NOT regexp_matches(substr(lower(sentence), greatest(p - 30, 1), least(30, p - 1)), '\bno\b|\bnot\b|\bis\b')"""
)
def bank_candidates(spark, sf_dir):
    """Sentences with a topic word and no negation in the 30 characters before it, classed by the first rule that fits."""
    topics = [("tion", "a"), ("ing", "b"), ("er", "c")]
    return RL.bank_candidates(sentence_rows(spark, sf_dir), topics, java(r"\bno\b|\bnot\b|\bis\b")).select("ref", "sent", "keyword", "topic")


@query(_SENTENCES + r""" SELECT paper, ref, sentence FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY section, par, sent) AS n FROM sentences WHERE length(sentence) BETWEEN 80 AND 220) WHERE n = 1""")
def first_usable_per_paper(spark, sf_dir):
    """By an aggregate, which combines before the shuffle; a window would gather a paper's rows in one task."""
    rows = sentence_rows(spark, sf_dir).filter(F.length("sentence").between(80, 220))
    return rows.groupBy("paper").agg(F.min_by(F.struct("ref", "sentence"), F.struct("section", "par", "sent")).alias("x")).select("paper", "x.ref", "x.sentence")


@query(
    P
    + r""" SELECT ref, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(translate(text, '“”„‟"‘’‚‛''`´', '')), '[—–-]', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ') AS words,
trim(regexp_replace(translate(text, '“”„‟"‘’‚‛''`´', ''), '\s+', ' ', 'g')) AS exact FROM paragraphs"""
)
def normal_forms(spark, sf_dir):
    return pars(spark, sf_dir).select("ref", F.array_join(T.words(F.col("text")), " ").alias("words"), T.exact_form(F.col("text")).alias("exact"))


_STRIPPED = r"""replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '{t}', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&mdash;', '—'), '&ndash;', '–'), '&rsquo;', '’'), '&lsquo;', '‘'), '&rdquo;', '"'), '&ldquo;', '"'), '&quot;', '"')"""


@query(
    "SELECT page_id, trim(" + _STRIPPED.format(t="") + r") AS clean, regexp_replace(regexp_replace(" + _STRIPPED.format(t=" ") + r", '[*_]{1,3}', '', 'g'), '^\s*>\s?', ' ', 'gm') AS stripped FROM pages"
)
def markup_forms(spark, sf_dir):
    """Both ways to take tags out, over whole pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.clean_content(F.col("html")).alias("clean"), T.strip_markup(F.col("html")).alias("stripped"))


@query("SELECT doc_id, CAST(len(string_split(substr(text, 1, CAST(n_chars // 2 AS BIGINT)), chr(10))) AS INTEGER) AS line FROM documents")
def line_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_of(F.col("text"), F.expr("cast(n_chars div 2 as int)")).alias("line"))


@query(f"SELECT doc_id, translate(lower(text), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}') AS folded FROM documents")
def accent_folding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query(
    "SELECT event_id, format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS ms FROM events WHERE value >= 0)"
)
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value >= 0").select("event_id", T.clock(F.col("value")).alias("stamp"))


@query(
    r"""WITH q AS (SELECT conv_id, turn, string_split(lower(trim(text)), ' ') AS ws FROM conversations),
t AS (SELECT conv_id, turn, ws, list_filter(list_transform(ws, lambda w: regexp_replace(w, '[^A-Za-z0-9_''-]', '', 'g')), lambda w: length(w) > 1 AND w NOT IN ("""
    + ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    + ")) AS terms FROM q) SELECT conv_id, turn, array_to_string(CASE WHEN len(terms) > 0 THEN terms ELSE ws END, ' ') AS terms FROM t"
)
def query_tokens(spark, sf_dir):
    """Search terms of every turn, all its words if only common ones are left."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))
