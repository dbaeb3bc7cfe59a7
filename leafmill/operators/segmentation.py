"""Words of CJK text: a vocabulary learned from the corpus, and the best path through the graph of its words in each run of characters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import CJK, TERM
from leafmill.sources.shared import SENT, save_point

#: Characters of a word at most, and how often a word of several characters has to occur.
LONGEST, LEAST = 4, 2


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CJK}+)"), F.lit(1))


def _substrings(longest: int) -> Column:
    """Structs of word, and where it ends (from 1), of all words of a run up to `longest` characters."""
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(i, F.lit(longest))), lambda n: F.struct(F.substr("run", i - n + 1, n).alias("word"), i.alias("end")))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), at))


def vocabulary(texts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """word, cost: every character and every string of characters that occurs `least` times in the texts' runs; its cost is a million times ln(characters / occurrences),
    rounded, so that the cheapest path is the likeliest of independent words. texts: text."""
    each = texts.select(F.explode(runs(F.col("text"))).alias("run"))
    counted = each.groupBy("run").agg(F.count("*").alias("times")).select("times", F.explode(_substrings(longest)).alias("x")).groupBy("x.word").agg(F.sum("times").alias("n"))
    counted = save_point(counted)
    whole = counted.filter(F.length("word") == 1).agg(F.sum("n").alias("chars"))
    kept = counted.filter((F.length("word") == 1) | (F.col("n") >= least))
    return kept.crossJoin(F.broadcast(whole)).select("word", F.round(F.log(F.col("chars") / F.col("n")) * 1e6).cast("long").alias("cost"))


def cheapest(size: int, edges: Iterable[tuple[int, int, int]]) -> list[int]:
    """Lengths of the words of the cheapest path over a run. edges: end, length, cost; ties to the longer word."""
    into: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    for end, length, cost in edges:
        into[end].append((length, cost))
    best, back = [0] + [0] * size, [0] * (size + 1)
    for i in range(1, size + 1):
        found = [(best[i - n] + c, -n) for n, c in into[i] if n == 1 or back[i - n] or i == n]
        best[i], least = min(found) if found else (best[i - 1] + 10**9, -1)
        back[i] = -least
    out = []
    while size:
        out.append(back[size])
        size -= back[size]
    return out[::-1]


def words_of_runs(found: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run, words of each distinct run. The graph's edges are the run's substrings that the vocabulary has, found by a join; each run is then walked by itself. A
    character that the vocabulary lacks is a word of its own. found: run; words: word, cost."""
    # runs go by a number, as each has four substrings a character; estimates of sizes know nothing of that, so that what is broadcast is measured
    own = save_point(found.select("run").distinct().withColumn("r", F.monotonically_increasing_id()))
    words = save_point(words)
    words = F.broadcast(words) if 96 * words.count() <= SENT else words.hint("merge")
    each = own.select("r", F.explode(_substrings(longest)).alias("x")).select("r", "x.word", "x.end")
    edges = each.join(words, "word").groupBy("r").agg(F.collect_list(F.struct("end", F.length("word").alias("n"), "cost")).alias("edges"))
    graph = own.join(edges.hint("merge"), "r").select("run", "edges")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for run, edges in zip(frame["run"], frame["edges"], strict=True):
                at, own = 0, []
                for n in cheapest(len(run), [(e["end"], e["n"], e["cost"]) for e in edges]):
                    own.append(run[at : at + n])
                    at += n
                out.append(own)
            yield pd.DataFrame({"run": frame["run"], "words": out})

    return graph.mapInPandas(walk, "run string, words array<string>")


def segmented(df: DataFrame, key: list[str], words: DataFrame | None = None) -> DataFrame:
    """key, terms: Latin terms in lower case, then the words of the CJK runs, in their order. df: key, text (null: no terms); words: a vocabulary, or else that of df's texts.

    Rows are known by their key, which has to be unique.
    """
    words = vocabulary(df) if words is None else words
    placed = df.select(*key, F.posexplode(runs(F.col("text"))).alias("at", "run"))
    cut = placed.join(words_of_runs(placed, words).hint("merge"), "run")
    own = cut.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("cjk"))
    latin = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({TERM})"), F.lit(1)), lambda t: F.lower(t))
    return df.select(*key, latin.alias("latin")).join(own.hint("merge"), key, "left").select(*key, F.concat("latin", F.coalesce("cjk", F.array().cast("array<string>"))).alias("terms"))
