"""Periodic runs of words, found at the points of a harmonic grid by prefix hashes and checked word by word."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import slices, table, utf8

#: Two primes under 2 ** 31, whose residues together are a prefix hash, so that products stay within 64 bits.
PRIMES = (2_147_483_629, 2_147_483_587)
#: Grid points that are looked at together.
POINTS = 1 << 21
WORDS = r"[^\\x20\\x09-\\x0D]+"


class Prefixes:
    """Sums of words times powers of a base, by which stretches at two places are compared; equal ones always agree."""

    def __init__(self, words: np.ndarray, seed: int = 1) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        kinds = int(words.max(initial=-1)) + 1
        self.sides = []
        for p in PRIMES:
            base, power = int(rng.integers(1 << 20, p)), np.ones(1, np.int64)
            step = base
            while len(power) <= len(words):
                power = np.concatenate([power, power * step % p])
                step = step * step % p
            values = rng.integers(1, p, kinds)
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum(values[words] * power[: len(words)] % p, out=sums[1:])
            self.sides.append((p, power, sums % p))

    def same(self, i: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i and those from i + q agree."""
        out = np.ones(len(i), bool)
        for p, power, sums in self.sides:
            out &= (sums[i + n] - sums[i]) % p * power[q] % p == (sums[i + q + n] - sums[i + q]) % p
        return out

    def extension(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i on (back: before i), `most` at most, agree with those q further on; by halving, for all at once."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            n = (low[open_] + high[open_] + 1) // 2
            good = self.same(i[open_] - n if back else i[open_], q[open_], n)
            low[open_] = np.where(good, n, low[open_])
            high[open_] = np.where(good, high[open_], n - 1)
        return low


def grid(starts: np.ndarray, ends: np.ndarray, shortest: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, period and document of the grid's points, about POINTS at a time.

    In a run of period q and length l, l - q consecutive words each equal the one q further on. The least l is max(shortest, times * q), so points
    that lie max(shortest, times * q) - q apart miss no run. Over all periods these are about n ln n / (times - 1) points of n words.
    """
    sizes = ends - starts
    periods = np.where(sizes >= shortest, sizes // times, 0)
    of = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(shortest, times * q) - q
    counts = -(-(sizes[of] - q) // step)
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // POINTS)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
        n = counts[a:b]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d = np.repeat(of[a:b], n)
        yield starts[d] + k * np.repeat(step[a:b], n), np.repeat(q[a:b], n), d


def _agree(words: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the words of each run [s, e) equal those q further on, word by word."""
    n, out = e - s - q, np.ones(len(s), bool)
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // POINTS)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)], strict=True):
        if b > a:
            first = np.cumsum(n[a:b]) - n[a:b]
            at = np.arange(n[a:b].sum()) + np.repeat(s[a:b] - first, n[a:b])
            out[a:b] = np.add.reduceat((words[at] != words[at + np.repeat(q[a:b], n[a:b])]).astype(np.int64), first) == 0
    return out


def plain_runs(words: np.ndarray, shortest: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of one document by comparing all words for each period; for words whose hashes met by chance."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // times + 1 if len(words) >= shortest else 1):
        same = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist(), strict=True):
            if e - s >= max(shortest, times * q):
                found.setdefault((s, e), q)
    return [(s, e, q) for (s, e), q in found.items()]


def runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, end and least period of the maximal runs of all documents, by document, start and period.

    words: numbers of the words of all documents, one document after another, from starts to ends. times: 2 at least.
    """
    hashes = Prefixes(words)
    found = []
    for i, q, d in grid(starts, ends, shortest, times):
        on = words[i] == words[i + q]
        i, q, d = i[on], q[on], d[on]
        s = i - hashes.extension(i, q, i - starts[d], True)
        e = i + q + hashes.extension(i, q, ends[d] - i - q, False)
        long = e - s >= np.maximum(shortest, times * q)
        # points of one run give it once each
        found.append(np.unique(np.stack([d[long], s[long], e[long], q[long]]), axis=1))
    d, s, e, q = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    # a multiple of a run's period gives the same stretch again
    order = np.lexsort((q, e, s, d))
    d, s, e, q = d[order], s[order], e[order], q[order]
    once = np.ones(len(d), bool)
    once[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    d, s, e, q = d[once], s[once], e[once], q[once]
    wrong = np.unique(d[~_agree(words, s, e, q)])
    if len(wrong):
        right = ~np.isin(d, wrong)
        again = [(k, s_ + starts[k], e_ + starts[k], q_) for k in wrong.tolist() for s_, e_, q_ in plain_runs(words[starts[k] : ends[k]], shortest, times)]
        d, s, e, q = np.concatenate([np.stack([d[right], s[right], e[right], q[right]]), np.array(again, np.int64).reshape(-1, 4).T], axis=1)
    order = np.lexsort((q, s, d))
    return d[order], s[order], e[order], q[order]


def periodic_runs(docs: DataFrame, shortest: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed (the words that stay, one space between).

    A run is a maximal stretch of words with least period q, words that lie q apart being equal, of max(shortest, times * q) words or more; of
    each run the first q words stay, unless another one drops them. Words are parted by ASCII white space. docs: doc_id, text; other
    columns are left aside. A null text counts as empty, and has no words or runs. Repeated rows are treated alike, each by itself. An empty table gives
    no rows. Documents are independent, so nothing is shuffled; a slice of 4 MB of texts, or one longer text, is held at a time.
    """
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(kind)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            each = [text.split() for text in utf8(batch.column(1))]
            numbers = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(each)))}
            sizes = np.array([len(w) for w in each], np.int64)
            ends = np.cumsum(sizes)
            words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(each)), np.int64, int(sizes.sum()))
            d, s, e, q = runs(words, ends - sizes, ends, shortest, times)
            dropped = np.zeros(len(words) + 1, np.int64)
            np.add.at(dropped, s + q, 1)
            np.add.at(dropped, e, -1)
            stays = np.cumsum(dropped)[:-1] == 0
            cut = set(d.tolist())
            texts = [b" ".join(compress(w, stays[end - len(w) : end].tolist()) if k in cut else w) for k, (w, end) in enumerate(zip(each, ends.tolist(), strict=True))]
            found = pa.StructArray.from_arrays([pa.array(x) for x in (s - (ends - sizes)[d], e - s, q)], fields=list(kind))
            places = pa.array(np.searchsorted(d, np.arange(len(each) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(places, found), pa.array(texts, pa.binary()).cast(pa.string())], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where about a tenth of the documents end in repetitions: with h = crc32 of the decimal doc_id and g = floor(h / 10), if
    h % 10 is 0, each word i of n from a = g % n on becomes word a + (i - a) % p, p being 1 + floor((n - a) / (3 + g % 8))."""
    g = "cast(floor(crc32(cast(doc_id as string)) / 10) as bigint)"
    n, a = "bigint(size(w))", f"{g} % bigint(size(w))"
    again = f"transform(w, (x, i) -> if(i < {a}, x, get(w, int({a} + (i - {a}) % (1 + floor(({n} - {a}) / (3 + {g} % 8)))))))"
    text = f"get(transform(array(regexp_extract_all(text, '{WORDS}', 0)), w -> if(size(w) = 0, text, array_join({again}, ' '))), 0)"
    chosen: Column = F.expr("crc32(cast(doc_id as string)) % 10 = 0")
    return docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", F.when(chosen & F.col("text").isNotNull(), F.expr(text)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which a tenth get repetitions: doc_id, n_runs, the run of greatest length by period (start, length, period,
    exponent_milli), runs_sha256, collapsed_sha256; and n_words and collapsed (the text that stays). Listed by start, so of equal ones the first wins."""
    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.withColumn("best", best)
    milli = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words", "collapsed")
