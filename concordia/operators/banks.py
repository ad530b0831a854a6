"""Banks of quotations with quotas, and captions: greedy and sequential, so each runs in one bounded group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import ship


def round_robin(candidates: DataFrame, n: int, per_paper: int = 2) -> DataFrame:
    """candidates(topic, ref, paper, score): one of each topic in turn, at most per_paper of a paper, n in
    all; a topic that runs out is passed over. Best scores first, ties by the numbers in ref, then by ref.

    A topic never uses more than per_paper rows of a paper. Of these rows its best 2 * n are enough: before
    its last turn it has taken fewer than n, and has passed over per_paper rows at most of each full paper,
    fewer than n too, as full papers hold per_paper chosen rows each."""
    ship(candidates.sparkSession)
    numbers = F.transform(F.regexp_extract_all("ref", F.lit("([0-9]+)")), lambda x: x.try_cast("long"))
    rows = candidates.select("topic", "ref", "paper", F.struct((-F.col("score")).alias("s"), numbers.alias("n"), "ref").alias("key"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    best = rows.withColumn("place", rank("topic", "paper")).filter(F.col("place") <= per_paper).withColumn("place", rank("topic")).filter(F.col("place") <= 2 * n).drop("key")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        queues = {t: [*zip(q.ref, q.paper)] for t, q in frame.sort_values("place").groupby("topic")}
        used: dict[int, int] = {}
        chosen = []
        while len(chosen) < n and any(queues.values()):
            for topic, queue in queues.items():
                while queue:
                    ref, paper = queue.pop(0)
                    if used.get(paper, 0) < per_paper:
                        used[paper] = used.get(paper, 0) + 1
                        chosen.append((len(chosen) + 1, topic, ref))
                        break
                if len(chosen) == n:
                    break
        return pd.DataFrame(chosen, columns=["place", "topic", "ref"])

    return best.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(run, "place int, topic string, ref string")


#: Characters of a caption line, how many let a comma end it, the tail that joins the line before it and
#: by how many characters, and seconds: shown behind the last word, at least, and between two lines.
LINE, COMMA, TAIL, MORE, HOLD, LEAST, GAP = 42, 26, 2, 8, 0.25, 1.0, 0.04
_CLOSING = "\"”’)"


def lines_of(words: list[tuple[str, float, float]], most: int = LINE) -> list[list[tuple[str, float, float]]]:
    """(word, start, end) of one paragraph dealt to lines of at most `most` characters. A stop ends a line of two
    words and more, a comma, colon or semicolon one of COMMA characters; closing marks may follow. A tail of TAIL
    words joins the line before it if that stays within MORE characters beyond."""
    text = lambda line: " ".join(w for w, _, _ in line)
    out: list[list[tuple[str, float, float]]] = [[]]
    for word in words:
        if out[-1] and len(text([*out[-1], word])) > most:
            out.append([])
        out[-1].append(word)
        mark = word[0].rstrip(_CLOSING)[-1:]
        if (mark in (".", "!", "?") and len(out[-1]) > 1) or (mark in (",", ";", ":") and len(text(out[-1])) >= COMMA):
            out.append([])
    out = [line for line in out if line]
    if len(out) > 1 and len(out[-1]) <= TAIL and len(text(out[-2] + out[-1])) <= most + MORE:
        tail = out.pop()
        out[-1] = out[-1] + tail
    return out


def shown(lines: list[list[tuple[str, float, float]]]) -> list[tuple[float, float, str]]:
    """(start, end, text): a line stays HOLD seconds behind its last word and LEAST seconds in all, but ends GAP
    before the next one starts."""
    out = []
    for line, after in zip(lines, [*lines[1:], None]):
        start, end = line[0][1], line[-1][2]
        until = after[0][1] if after else end + 2
        if until > start + 0.1:
            end = min(max(end + HOLD, start + LEAST), until - GAP)
        out.append((start, end, " ".join(w for w, _, _ in line)))
    return out


def cues(words: DataFrame, most: int = LINE) -> DataFrame:
    """words(chapter, par, i, w, start, end) to chapter, cue, start, end, text. Paragraphs end a line; chapters run
    apart, and one is an hour of speech at most."""
    ship(words.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        lines = [line for _, p in frame.groupby("par", sort=False) for line in lines_of([*zip(p.w, p.start, p.end)], most)]
        out = shown(lines)
        return pd.DataFrame({"chapter": frame.chapter.iloc[0], "cue": range(1, len(out) + 1), "start": [c[0] for c in out], "end": [c[1] for c in out], "text": [c[2] for c in out]})

    return words.groupBy("chapter").applyInPandas(run, "chapter long, cue int, start double, end double, text string")
