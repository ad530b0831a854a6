"""Readers, sinks and text functions: each query writes a fixture from the tables, reads it back and is compared
with SQL over the tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ..functions import language as LG, numbers as N, text as T
from ..operators import align as AL, claims as CL, recall as RC
from ..registry import query, table
from ..session import folder
from ..sources import corpus as CO, readers as RD
from ..sources.corpus import PARAGRAPHS_SQL as P
from ..streaming import jobs as ST
from .domain_queries import RULES
from .search_queries import _STRIPPED, pars


def _place(spark, name: str) -> str:
    return folder(spark, name)


def _items(spark, sf_dir):
    """The benchmark's items as single lines."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "benchmark").select("item_id", flat.alias("line"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

# --- papers and paragraphs

_CLEAN = _STRIPPED.format(t="")


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, lang FROM documents), x AS (SELECT doc_id, lang, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
h AS (SELECT doc_id, lang, i, '<p><em>' || line || '</em></p>' AS html FROM x)
SELECT doc_id || ':' || (i % 2) || '.' || i AS ref, CAST(doc_id AS INTEGER) AS paper, CASE i % 2 WHEN 0 THEN 'Introduction' ELSE 'Odd lines' END AS section_title, lang AS author, trim("""
    + _CLEAN
    + ", ' ') AS clean FROM h WHERE trim("
    + _CLEAN
    + ", ' ') <> ''"
)
def papers_flattened(spark, sf_dir):
    """Every document as a nested paper, written as JSON lines, read with its schema and flattened."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    par = lambda k: F.transform(F.filter(lines, lambda p: p["i"] % 2 == k), lambda p: F.struct(F.concat_ws("", F.col("doc_id").cast("string"), F.lit(f":{k}."), p["i"].cast("string")).alias("par_ref"), F.lit("1").alias("par_pageref"), F.concat(F.lit("<p><em>"), p["x"], F.lit("</em></p>")).alias("par_content")))
    section = lambda k, title: F.struct(F.lit(k).alias("section_index"), F.lit(str(k)).alias("section_ref"), title.alias("section_title"), par(k).alias("pars"))
    papers = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("int").alias("paper_index"), F.lit("A paper").alias("paper_title"), F.col("lang").alias("author"), F.array().cast("array<string>").alias("footnotes"),
        F.array(section(0, F.lit(None).cast("string")), section(1, F.lit("Odd lines"))).alias("sections"),
    )
    at = _place(spark, "papers")
    RD.write_json(papers, at)
    return CO.flatten_papers(CO.read_papers(spark, at, lines=True)).select("ref", "paper", "section_title", "author", "clean")


@query(P + " SELECT ref, paper, section, par, author, text FROM paragraphs")
def paragraph_store(spark, sf_dir):
    """The prebuilt fact table, written by paper and read again."""
    at = _place(spark, "paragraphs")
    CO.write_paragraphs(pars(spark, sf_dir), at)
    return CO.read_paragraphs(spark, at).select("ref", "paper", "section", "par", "author", "text")


@query(P + " SELECT section, count(*) AS n, max(par) AS last_par FROM paragraphs WHERE paper = 7 GROUP BY section")
def paragraph_store_paper(spark, sf_dir):
    """One paper of the prebuilt table: only its folder is read."""
    at = _place(spark, "paragraphs")
    CO.write_paragraphs(pars(spark, sf_dir), at)
    return CO.read_paragraphs(spark, at, 7).groupBy("section").agg(F.count("*").alias("n"), F.max("par").alias("last_par"))


# --- topics, verses, answers, scripts, archives, translations

@query(
    f"""SELECT 'Item ' || item_id AS name, 'Item ' || item_id || ',Thing ' || item_id AS names, 'See ' || item_id % 7 AS see_also, 'KIND' || item_id % 3 AS category, {_FLAT} AS line,
array_to_string(list_transform(range(1, least(item_id % 40 + 1, 21) + 1), lambda k: item_id % 20 || ':' || item_id || '.' || k), ',') AS refs FROM benchmark"""
)
def topic_records(spark, sf_dir):
    """Pipe-delimited topics with a detail line each; a range of references stops after 20 steps."""
    i = F.col("item_id").cast("string")
    refs = F.concat_ws("", (F.col("item_id") % 20).cast("string"), F.lit(":"), i, F.lit(".1-"), (F.col("item_id") % 40 + 1).cast("string"))
    head = F.concat_ws(" | ", F.concat(F.lit("Item "), i, F.lit("; Thing "), i), refs, F.concat(F.lit("See "), (F.col("item_id") % 7).cast("string")), F.concat(F.lit("KIND"), (F.col("item_id") % 3).cast("string")), F.lit("x"))
    at = _place(spark, "topics")
    RD.write_text(_items(spark, sf_dir).select(F.concat_ws("\n", head, F.concat(F.lit("  "), F.col("line")), F.lit("")).alias("value")), at)
    rows = RD.read_topics(spark, at)
    return rows.select("name", F.array_join("names", ",").alias("names"), "see_also", "category", F.trim(F.array_join("lines", " ")).alias("line"), F.array_join("refs", ",").alias("refs"))


def _verses(spark, sf_dir):
    """A book of each region: its nations by letters in the first chapter, one by one in further ones."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("ns"))
    book = F.struct(F.col("n_regionkey").alias("k"), F.lit("x").alias("name"), F.concat(F.array("ns"), F.transform("ns", lambda n: F.array(F.concat(n, F.lit("  again"))))).alias("chapters"))
    whole = names.agg(F.array_sort(F.collect_list(book)).alias("b")).select(F.transform("b", lambda x: F.struct(x["name"], x["chapters"])).alias("books"))
    at = _place(spark, "verses")
    RD.write_json(whole, at)
    return RD.read_verses(spark, at, ["Africa", "America", "Asia", "Europe"])


_VERSES = """WITH n AS (SELECT n_regionkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS v FROM nation),
v AS (SELECT k, 1 AS chapter, v AS verse, n_name AS text FROM n UNION ALL SELECT k, v + 1, 1, n_name || ' again' FROM n),
verses AS (SELECT coalesce((['Africa', 'America', 'Asia', 'Europe'])[k + 1], 'Book ' || (k + 1)) AS book, CAST(chapter AS INTEGER) AS chapter, CAST(verse AS INTEGER) AS verse, text FROM v)"""


@query(_VERSES + " SELECT book, chapter, verse, book || ' ' || chapter || ':' || verse AS ref, text FROM verses")
def verse_table(spark, sf_dir):
    return _verses(spark, sf_dir).select("book", "chapter", "verse", "ref", "text")


@query(_VERSES + " SELECT verse, text FROM verses WHERE book = 'Asia' AND chapter = 1 AND verse BETWEEN 2 AND 30")
def verse_span(spark, sf_dir):
    """A range of verses, whose end is cut to the chapter's length."""
    return RD.verse_range(_verses(spark, sf_dir), "Asia", 1, 2, 30).select("verse", "text")


@query(f"SELECT 'model ' || item_id % 3 AS model, 'Q' || item_id AS qid, {_FLAT} || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'second line' ELSE '' END AS answer FROM benchmark")
def answer_sheets(spark, sf_dir):
    """A sheet of each of three models: one as JSON, two as lines."""
    body = F.concat(F.col("line"), F.when(F.col("item_id") % 2 == 0, "\nsecond line").otherwise(""))
    q = F.struct(F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("q"), body.alias("a"))
    sheets = _items(spark, sf_dir).groupBy((F.col("item_id") % 3).alias("m")).agg(F.array_sort(F.collect_list(q)).alias("qs"))
    model = F.concat(F.lit("model "), F.col("m").cast("string"))
    lines = F.concat_ws("\n", F.concat(F.lit("MODEL: "), model), F.array_join(F.transform("qs", lambda x: F.concat(x["q"], F.lit(": "), x["a"])), "\n"))
    as_json = F.to_json(F.struct(model.alias("model"), F.map_from_entries("qs").alias("answers")))
    at = _place(spark, "sheets")
    for m in range(3):  # a file for each sheet
        one = sheets.filter(F.col("m") == m).select((as_json if m == 1 else lines).alias("value")).coalesce(1)
        RD.write_text(one, f"{at}/{m}")
    return RD.read_answers(spark, f"{at}/*").select("model", "qid", "answer")


@query(f"SELECT 'Item ' || item_id AS title, CAST(6 * (row_number() OVER (ORDER BY item_id) - 1) + 3 AS INTEGER) AS first_line, CAST(6 * (row_number() OVER (ORDER BY item_id) - 1) + 4 AS INTEGER) AS last_line, {_FLAT} || ' and more' AS text FROM benchmark UNION ALL SELECT 'Item ' || item_id, CAST(6 * row_number() OVER (ORDER BY item_id) AS INTEGER), CAST(6 * row_number() OVER (ORDER BY item_id) AS INTEGER), 'end ' || item_id FROM benchmark")
def script_paragraphs(spark, sf_dir):
    """A script of one file: a chapter an item, two paragraphs each."""
    i = F.col("item_id").cast("string")
    chapter = F.concat_ws("\n", F.concat(F.lit("## Item "), i), F.lit(""), F.col("line"), F.lit("and more"), F.lit(""), F.concat(F.lit("end "), i))
    at = _place(spark, "script")
    RD.write_text(_items(spark, sf_dir).orderBy("item_id").coalesce(1).select(chapter.alias("value")), at)
    return RD.read_script(spark, at).select("title", "first_line", "last_line", "text")


@query("SELECT 'a' || n_regionkey || '.zip' AS name, string_agg(n_name, chr(10) ORDER BY n_name) AS text FROM nation WHERE n_regionkey <> 3 GROUP BY n_regionkey UNION ALL SELECT 'a3.zip', NULL UNION ALL SELECT 'broken.zip', NULL")
def archive_texts(spark, sf_dir):
    """Zip files with one text each; one with two texts and a broken one give null."""
    at = _place(spark, "archives")
    names: dict[int, list[str]] = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_name").collect():  # 25 rows
        names.setdefault(r.n_regionkey, []).append(r.n_name)
    for k, own in names.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("one.txt", "\n".join(own))
            z.writestr("read.me", "no text")
            if k == 3:
                z.writestr("two.txt", "another")
        RD.write_bytes(spark, f"{at}/a{k}.zip", data.getvalue())
    RD.write_bytes(spark, f"{at}/broken.zip", b"no archive")
    return RD.read_archives(spark, f"{at}/*.zip").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "text")


@query(f"SELECT CAST(item_id AS INTEGER) AS paper, 'Title ' || item_id AS title, CASE k WHEN 0 THEN NULL ELSE 'Head ' || item_id END AS section_title, 'Ann' AS author, CASE k WHEN 0 THEN 'before' ELSE {_FLAT} END AS text, k AS section, 1 AS par FROM benchmark, range(2) t(k) WHERE {_FLAT} <> '' OR k = 0")
def translation_paragraphs(spark, sf_dir):
    """Lines of a translated paper become paragraphs: heads, page numbers and rules are told apart."""
    i = F.col("item_id").cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("Documento "), i), F.concat(F.lit("Title "), i), F.lit("[Ann]"), F.lit("before"), F.lit("12"), F.concat(F.lit("1. Head "), i), F.lit("-----"), F.col("line"), F.lit(""))
    files = _items(spark, sf_dir).select(i.alias("file"), text.alias("text"))
    rows = RD.parse_translation(files, "es")
    return rows.select("paper", "title", "section_title", "author", "text", F.col("section").cast("long").alias("section"), "par")


@query("SELECT n_nationkey, n_name, 2 AS place FROM nation")
def complete_source(spark, sf_dir):
    """Of a missing folder, one with too few files and a complete one, the last is read."""
    at, nations = _place(spark, "mirrors"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    RD.write_json(nations.filter("n_nationkey < 3").coalesce(1), f"{at}/one")
    RD.write_json(nations.repartition(3, "n_nationkey"), f"{at}/two")
    place = RD.first_complete(spark, [f"{at}/none", f"{at}/one", f"{at}/two"], 2, "*.json")
    return spark.read.schema(nations.schema).json(place).withColumn("place", F.lit([f"{at}/none", f"{at}/one", f"{at}/two"].index(place)))


@query("SELECT * FROM (VALUES ('nation.parquet', 'copied', 25), ('absent.parquet', 'skipped', NULL), ('region.parquet', 'copied', 5)) t(name, state, n)")
def copied_sources(spark, sf_dir):
    """Sources copied by name, one of them optional and absent."""
    at = _place(spark, "copies")
    done = RD.copy_files(spark, ["nation.parquet", "absent.parquet", "region.parquet"], sf_dir, at, {"absent.parquet"})
    return spark.createDataFrame([(n, s, spark.read.parquet(f"{at}/{n}").count() if s == "copied" else None) for n, s in done], "name string, state string, n long")


@query("SELECT p_brand AS service, array_to_string(list_sort(list_filter(list(p_name || CASE p_size % 3 WHEN 0 THEN '-Embed' ELSE '' END), lambda m: NOT contains(lower(m), 'embed'))), ',') AS models FROM part GROUP BY p_brand")
def chat_model_lists(spark, sf_dir):
    """Models that chat, of each service's list."""
    name = F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, "-Embed").otherwise(""))
    lists = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("service")).agg(F.collect_list(name).alias("ids"))
    return lists.select("service", F.array_join(F.sort_array(LG.chat_models(F.col("ids"))), ",").alias("models"))


# --- drafts

@query(f"SELECT item_id AS draft_id, line, block FROM (SELECT item_id, 6 AS line, 'The first, of item ' || item_id || ' and on' AS block FROM benchmark UNION ALL SELECT item_id, 15, {_FLAT} FROM benchmark WHERE {_FLAT} <> '')")
def draft_blocks(spark, sf_dir):
    """Paragraphs of prose: no front matter, heading, code or rule."""
    i = F.col("item_id").cast("string")
    text = F.concat_ws("\n", F.lit("---"), F.lit("title: x"), F.lit("---"), F.lit("# A head"), F.lit(""), F.concat(F.lit("The first, of item "), i), F.lit("and on"), F.lit(""), F.lit("```"), F.lit("code"), F.lit(""), F.lit("code"), F.lit("```"), F.lit("***"), F.col("line"), F.lit("## End"))
    return CL.draft_blocks(_items(spark, sf_dir).select(F.col("item_id").alias("draft_id"), text.alias("text"), F.lit(False).alias("is_data")))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_custkey::DOUBLE + 13, (o_orderkey % 90 + 2) * 1000.0, 45000.0])), ',') AS numbers FROM orders")
def own_figures(spark, sf_dir):
    """Figures in a draft's own words: with units, large ones and spelled ones; labels, quotations and places are none."""
    s = F.expr("'We count ' || (o_custkey + 13) || ' years, \"900 days\" of Paper 7 and 12 apples (XY ' || o_custkey % 99 || ':2.3), ' || (o_orderkey % 90 + 2) || ',000 men and forty-five thousand sheep, two days on'")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(N.own_numbers_udf(s), ",").alias("numbers"))


@query("SELECT * FROM (VALUES ('und', 'und'), ('lichkeit', 'lich'), ('anthe', 'ant'), ('que la', 'que'), ('Peru', '\"Peru\"')) t(term, ids)")
def resolved_groups(spark, sf_dir):
    """Typed names to groups: by id, by the draft's pattern, by the corpus' pattern, else the words themselves."""
    return spark.createDataFrame([(t, ",".join(g.id for g in RC.resolve(t, RC.python_groups(RULES)))) for t in ("und", "lichkeit", "anthe", "que la", "Peru")], "term string, ids string")


@query(
    r"""WITH t AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM benchmark),
s AS (SELECT item_id, list_concat(['He came c. 5 B.C. to us.', '"It is. So." he said!'], string_split(regexp_replace(regexp_replace(line, '(?i)\b(c|ca|vs|st|dr|mr|no|pp?)\.(\s)', '\1' || chr(2) || '\2', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS ss FROM t WHERE line <> '')
SELECT item_id, i AS n, replace(ss[i], chr(2), '.') AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)"""
)
def draft_sentences(spark, sf_dir):
    """Sentences of drafts: no end inside quotations or behind abbreviations."""
    block = F.concat(F.lit('He came c. 5 B.C. to us. “It is.  So.” he *said*! '), F.col("line"))
    found = _items(spark, sf_dir).filter("line != ''").select("item_id", F.posexplode(CL.split_sentences_udf(block)).alias("k", "sentence"))
    return found.select("item_id", (F.col("k") + 1).cast("long").alias("n"), "sentence")


@query(
    P
    + r""", g AS (SELECT ref, text, list_transform(regexp_extract_all(text, '[^.!?]+[.!?]+'), lambda s: trim(s, ' ')) AS g, regexp_replace(text, '\b(an|et|es)\.(\s)', '\1' || chr(1) || '\2', 'g') AS held FROM paragraphs)
SELECT ref, len(g) AS greedy, g[1] AS first_greedy, len(b) AS but, replace(b[len(b)], chr(1), '.') AS last_but FROM (SELECT *, string_split(regexp_replace(held, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) AS b FROM g)"""
)
def sentence_splitters(spark, sf_dir):
    """The greedy splitter, and the one that knows abbreviations ("an", "et", "es" here), of every paragraph."""
    rows = pars(spark, sf_dir).select("ref", T.greedy_sentences(F.col("text")).alias("g"), T.sentences_but(F.col("text"), ["an", "et", "es"]).alias("b"))
    return rows.select("ref", F.size("g").cast("long").alias("greedy"), F.try_element_at("g", F.lit(1)).alias("first_greedy"), F.size("b").cast("long").alias("but"), F.element_at("b", -1).alias("last_but"))


# --- words

@query(P + r" SELECT ref, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), lambda w: w <> ''), ' ') AS surface FROM paragraphs")
def surface_tokens(spark, sf_dir):
    """Tokens as an aligner compares them: punctuation is deleted, not spaced."""
    return pars(spark, sf_dir).select("ref", F.array_join(AL.surface_udf("text"), " ").alias("surface"))


_STEMS, _PARTICLES = ["사람", "하늘", "마음", "진리"], ["은", "에서", "으로는", "에서는", ""]


@query("SELECT p_partkey, (['" + "', '".join(_STEMS) + "'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS stem FROM part")
def particles_stripped(spark, sf_dir):
    """Korean particles come off again."""
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % n + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", LG.strip_particles_udf(F.concat(pick(_STEMS, 4), pick(_PARTICLES, 5))).alias("stem"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'b''' || p_name ELSE p_name END AS word FROM part")
def elisions_stripped(spark, sf_dir):
    """French l', d', qu' come off; other letters stay."""
    ahead = F.element_at(F.array(*[F.lit(w) for w in ("l'", "d’", "qu'", "", "b'")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_elision(F.concat(ahead, F.col("p_name"))).alias("word"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS title FROM part")
def title_cased(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", LG.title_case_udf(F.upper("p_name")).alias("title"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_in_chatter(spark, sf_dir):
    """The first whole JSON object of a chatty text."""
    said = F.concat(F.lit("Well { this: is "), F.lit("not it } but "), F.col("props"), F.lit(" or {\"k\": -1}"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(LG.first_json_udf(said), "$.k").cast("long").alias("k"))


# --- sinks and requests

@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_sink(spark, sf_dir):
    """Rows written as JSON and read again."""
    at = _place(spark, "nations")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    RD.write_json(nations, at)
    return spark.read.schema(nations.schema).json(at)


@query("""SELECT '{"jsonrpc":"2.0","result":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}}' AS value FROM nation""")
def rpc_results(spark, sf_dir):
    return RD.rpc_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("SELECT n_nationkey || chr(10) || format('00:00:{:02d},500 --> 00:00:{:02d},000', n_nationkey, n_nationkey + 2) || chr(10) || n_name || chr(10) AS value FROM nation")
def caption_lines(spark, sf_dir):
    """Numbered captions as a caption file has them."""
    n = F.col("n_nationkey")
    return RD.srt(table(spark, sf_dir, "nation").select(n.alias("cue"), (n + 0.5).alias("start"), (n + 2.0).alias("end"), F.col("n_name").alias("text")))


@query("SELECT 'r' || n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE NULL END AS answer, CASE n_nationkey % 3 WHEN 1 THEN 'unknown tool other' WHEN 2 THEN 'not a request: no request ' || n_nationkey END AS error FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT NULL, NULL, 'not a request: no request ' || n_nationkey FROM nation WHERE n_nationkey % 3 = 2")
def served_requests(spark, sf_dir):
    """A stream of request lines: a known tool, an unknown one, and lines that are no requests."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    i = F.col("n_nationkey").cast("string")
    call = F.concat(F.lit('{"id": "r'), i, F.when(F.col("n_nationkey") % 3 == 0, '", "method": "name", "params": {"key": "').otherwise('", "method": "other", "params": {"key": "'), i, F.lit('"}}'))
    at = _place(spark, "requests")
    RD.write_text(nations.select(F.when(F.col("n_nationkey") % 3 == 2, F.concat(F.lit("no request "), i)).otherwise(call).alias("value")), f"{at}/in")
    out: list[tuple] = []

    def sink(id, rows, error):
        out.append((id, rows.head()[0] if rows is not None else None, error))

    ST.serve(spark.readStream.text(f"{at}/in"), {"name": lambda s, p: nations.filter(F.col("n_nationkey") == int(p["key"])).select("n_name")}, sink, f"{at}/state").awaitTermination()
    return spark.createDataFrame(out, "id string, answer string, error string")
