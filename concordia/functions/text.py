"""Text forms and predicates as Column expressions.

Word characters are ASCII in every pattern here (letters, digits, underscore), and boundaries are
lookarounds, as Java's own boundary counts accented letters as word characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Marks that quote normalisation removes, common words that are no search terms,
#: entities and what they stand for.
QUOTE_MARKS = "“”„‟\"‘’‚‛'`´"
STOP_WORDS = "a an and are as at be but by for from had has have he his i in is it its not of on or our that the their them they this to was we were which who will with you your".split()
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&mdash;": "—", "&ndash;": "–", "&rsquo;": "’", "&lsquo;": "’", "&rdquo;": '"', "&ldquo;": '"', "&quot;": '"'}
#: Accented letters and the plain ones they fold to.
ACCENTS = ("áàâäãéèêëíìîïóòôöõúùûüñçąćęłńśźż", "aaaaaeeeeiiiiooooouuuuncacelnszz")
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV"]

WORD = "[A-Za-z0-9_]"


def _is_word(c: str) -> bool:
    return bool(re.fullmatch(WORD, c))


def prefix_pattern(term: str) -> str:
    """A word that starts with the term."""
    return (f"(?<!{WORD})" if _is_word(term[0]) else f"(?<={WORD})") + re.escape(term) + f"{WORD}*"


def phrase_pattern(phrase: str) -> str:
    """The phrase between word boundaries, with any white space between its words."""
    body = r"\s+".join(re.escape(w) for w in phrase.split())
    first, last = phrase.strip()[0], phrase.strip()[-1]
    return (f"(?<!{WORD})" if _is_word(first) else f"(?<={WORD})") + body + (f"(?!{WORD})" if _is_word(last) else f"(?={WORD})")


def fold_curly(text: str) -> str:
    return re.sub("[‘’]", "'", re.sub("[“”]", '"', text))


def query_terms(query: str) -> tuple[str, list[str]]:
    """The phrase, and its terms: words of two characters at least that aren't common; all words if none is left."""
    phrase = fold_curly(query.lower().strip())
    words = [re.sub(r"[^A-Za-z0-9_'-]", "", w) for w in phrase.split()]
    return phrase, [w for w in words if len(w) > 1 and w not in STOP_WORDS] or phrase.split()


def search_terms(text: Column) -> Column:
    """query_terms()'s terms of a column of queries."""
    words = F.split(F.trim(F.translate(F.lower(text), "‘’“”", "''\"\"")), " ")
    kept = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z0-9_'-]", "")), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def search_form(text: Column) -> Column:
    """Lower case with straight quotes."""
    return F.translate(F.lower(text), "‘’“”", "''\"\"")


def fold_quotes(text: Column) -> Column:
    """Quote marks go. A text of ASCII characters without one of its three is left as it is, which is told sooner."""
    bare = lambda t: (F.octet_length(t) == F.length(t)) & ~F.contains(t, F.lit('"')) & ~F.contains(t, F.lit("'")) & ~F.contains(t, F.lit("`"))
    return let(text, lambda t: F.when(bare(t), t).otherwise(F.translate(t, QUOTE_MARKS, "")))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def exact_form(text: Column) -> Column:
    """Only quote marks and spacing are left out."""
    return squash(fold_quotes(text))


def words(text: Column) -> Column:
    """Words without case and punctuation; dashes part words, as all does that is no letter and no digit."""
    return F.array_remove(F.split(F.lower(fold_quotes(text)), r"[^\p{L}\p{N}]+"), "")


def words_string(text: Column) -> Column:
    """The words between single spaces, with one on both sides, so that containment is by whole words."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def _entities(text: Column) -> Column:
    for name, mark in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def _where(text: Column, marks: str, use: Callable[[Column], Column]) -> Column:
    """use(text) if the text has one of the marks, without which it would change nothing; a search for a mark costs
    a fraction of a pattern."""
    return let(text, lambda t: F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks]), use(t)).otherwise(t))


def strip_markup(text: Column) -> Column:
    """Tags become spaces, entities characters; emphasis marks and line-leading quote signs go."""
    text = _where(text, "<", lambda t: F.regexp_replace(t, "<[^>]+>", " "))
    text = _where(text, "&", _entities)
    text = _where(text, "*_", lambda t: F.regexp_replace(t, "[*_]{1,3}", ""))
    return _where(text, ">", lambda t: F.regexp_replace(t, r"(?m)^\s*>\s?", " "))


def clean_content(text: Column) -> Column:
    """Tags go without a trace, entities become characters, the ends are trimmed."""
    return F.trim(_entities(F.regexp_replace(text, "<[^>]+>", "")))


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often `use` names it and wherever the optimizer moves it."""
    return F.transform(F.array(value), use)[0]


def starting_terms(text: Column, terms: list[str]) -> Column:
    """The term at each word that starts with one of the terms (words of plain characters), the longest if
    several do: one pass for all terms."""
    longest = "|".join(re.escape(t) for t in sorted({*terms}, key=lambda t: (-len(t), t)))
    return F.regexp_extract_all(text, F.lit(f"(?<!{WORD})({longest}){WORD}*"), F.lit(1))


def is_plain(term: str) -> bool:
    return bool(re.fullmatch(f"{WORD}+", term))


def with_term_counts(rows: DataFrame, form: str, terms: list[str], name: str) -> DataFrame:
    """rows with an array of how many words of column `form` start with each term. Terms of plain
    characters are found by one pass, others by one each."""
    plain = [t for t in terms if is_plain(t)]
    found = unused(rows, "__found")
    rows = rows.withColumn(found, starting_terms(F.col(form), plain) if plain else F.array().cast("array<string>"))
    one = lambda t: F.size(F.filter(found, lambda m: m.startswith(t))) if is_plain(t) else count_matches(F.col(form), prefix_pattern(t))
    return rows.withColumn(name, F.array(*[one(t) for t in terms]).cast("array<int>")).drop(found)


def unused(rows: DataFrame, name: str) -> str:
    """A column name that rows doesn't have."""
    while name in rows.columns:
        name += "_"
    return name


def snippet(text: Column, pattern: str, before: int, size: int) -> Column:
    """`size` characters that start `before` characters ahead of the first match, dots where text was cut."""
    at = F.greatest(F.regexp_instr(text, F.lit(pattern)) - 1 - before, F.lit(0))
    return F.concat(F.when(at > 0, "...").otherwise(""), F.substring(text, at + 1, F.lit(size)), F.when(at + size < F.length(text), "...").otherwise(""))


def highlight(text: Column, pattern: str) -> Column:
    return F.regexp_replace(escape_html(text), f"({pattern})", "<mark>$1</mark>")


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), *ACCENTS)


def singular(word: Column) -> Column:
    return F.regexp_replace(word, "s$", "")


def strip_elision(word: Column) -> Column:
    """French l', d', qu' and the like."""
    return F.regexp_replace(word, "^(?:[ldjmtsnc]|qu)['’]", "")


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based number of the line that holds a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def sentences(text: Column) -> Column:
    """Split at white space behind a full stop, exclamation or question mark."""
    return F.split(text, r"(?<=[.!?])\s+")


def greedy_sentences(text: Column) -> Column:
    """Runs up to their stops; what no stop ends is left out. Parted behind stops: a pattern of a run and its stops
    would try each place of a text that no stop ends, to the text's end each."""
    stop = lambda c: c.isin(".", "!", "?")
    runs = F.filter(F.split(text, r"(?<=[.!?])(?=[^.!?])"), lambda s: stop(F.right(s, F.lit(1))) & ~stop(F.left(s, F.lit(1))))
    return F.transform(runs, lambda s: F.trim(s))


def sentences_but(text: Column, abbreviations: list[str]) -> Column:
    """sentences(), but none ends behind an abbreviation."""
    held = F.regexp_replace(text, rf"(?<!{WORD})({'|'.join(re.escape(a) for a in abbreviations)})\.(\s)", "$1\u0001$2")
    return F.transform(sentences(held), lambda s: F.replace(s, F.lit("\u0001"), F.lit(".")))


def roman_number(word: Column) -> Column:
    pairs = [x for n, r in enumerate(ROMAN, 1) for x in (F.lit(r), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), word)


def clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm"""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("1") * F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def short_clock(seconds: Column) -> Column:
    """H:MM:SS"""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def typed_citation(text: Column) -> Column:
    """A typed citation without white space and with a plain dash."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s ]+", ""), "[–—]", "-")


def answer_text(question: Column, quotes: Column) -> Column:
    """Plain text of an answer: the question, then each quotation (struct text, ref) with its citation."""
    return F.concat_ws("\n\n", question, F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("“"), q["text"], F.lit("” ("), q["ref"], F.lit(")"))), "\n\n"))
