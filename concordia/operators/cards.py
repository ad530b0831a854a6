"""Cards cut from the text by anchors, and the times at which quotations are spoken."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..session import ship

LEAST_SECONDS, ENDS = 4.0, 4


def slice_cards(cards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """cards(topic, ref, start, end) to topic, ref, quote: the text from the start anchor to the end of the next
    end anchor; null where an anchor or the paragraph is missing."""
    rows = cards.join(paragraphs.select("ref", "text"), "ref", "left")
    a = F.instr("text", F.col("start"))
    b = F.call_function("locate", F.col("end"), F.col("text"), F.greatest(a, F.lit(1)))
    quote = F.when((a > 0) & (b > 0), F.substring("text", a, b + F.length("end") - a))
    return rows.select("topic", "ref", quote.alias("quote"))


def verify_cards(cards: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """cards(topic, ref, quote) with verified: whether the cited text has it but for quote marks and spacing."""
    rows = cards.join(paragraphs.select("ref", "text"), "ref", "left")
    held = F.contains(T.exact_form(F.col("text")), T.exact_form(F.col("quote")))
    return rows.select("topic", "ref", "quote", F.coalesce(held, F.lit(False)).alias("verified"))


class Spoken:
    """Words to look runs up in; a run is found as text, so that the search is linear."""

    def __init__(self, words: list[str]):
        self.text = " " + " ".join(words) + " "
        self.starts = [0, *accumulate(len(w) + 1 for w in words)]

    def find(self, run: list[str], start: int = 0) -> int:
        """Place of the run at or behind start, -1 if there is none or it has no words."""
        at = self.text.find(" " + " ".join(run) + " ", self.starts[start]) if run and start < len(self.starts) else -1
        return bisect_left(self.starts, at) if at >= 0 else -1


def place_quotes(quotes: DataFrame, spoken: DataFrame) -> DataFrame:
    """quotes(episode, n, words) and spoken(episode, i, w, start, end) to episode, n, start, end: from the
    quotation's first words to its last, LEAST_SECONDS at least, none before the one ahead has ended.
    A quotation that isn't heard has no row. Episodes run apart; one is hours of speech at most."""
    ship(quotes.sparkSession)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("i")
        words, starts, ends = right.w.tolist(), right.start.tolist(), right.end.tolist()
        spoken = Spoken(words)
        out, free = [], 0.0
        for q in left.sort_values("n").itertuples():
            own = list(q.words)
            a = spoken.find(own[:ENDS])
            b = spoken.find(own[-ENDS:], a) if a >= 0 else -1
            if a < 0:
                continue
            last = b + min(ENDS, len(own)) - 1 if b >= 0 else min(a + len(own), len(words)) - 1
            start = max(starts[a], free)
            end = max(ends[last], start + LEAST_SECONDS)
            free = end
            out.append((q.episode, q.n, start, end))
        return pd.DataFrame(out, columns=["episode", "n", "start", "end"])

    return quotes.groupBy("episode").cogroup(spoken.groupBy("episode")).applyInPandas(run, "episode long, n int, start double, end double")
