"""Divergence of sources within their language, by counts of byte-level terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import flat, save_point, sent, slices, table

#: Bytes of text that are counted together, and terms that are hashed at once.
SLICE, AT_ONCE = 16 << 20, 1 << 17
#: Counts of a language in one part of its terms, about, and sources whose pairs one task sums.
CHUNK, BLOCK = 500_000, 512
SCALE = 1_000_000_000
#: Bytes that are part of a term, and what each becomes: A-Z are lower-cased, and all beyond ASCII belongs to terms.
PART = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def term_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each term. data: texts one after another; at: where they begin, and the end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = PART[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    return np.flatnonzero(inside[1:] & (~inside[:-1] | edge)), np.flatnonzero(inside[:-1] & (~inside[1:] | edge))


def same_slices(data: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each slice [s, e) has the bytes of the slice of equal length that begins at other, byte by byte."""
    n = e - s
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(s - first, n)
    return np.add.reduceat((data[at] != data[at + np.repeat(other - s, n)]).astype(np.int32), first) == 0


def grouped(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slice the number of its group of equal slices, and for each group one slice of it. Slices are not empty.

    Groups are those of equal 64-bit hashes, whose bytes are then compared; if two differ, slices are grouped by their bytes.
    """
    raw = data.tobytes()
    hashes = np.concatenate([np.zeros(0, np.uint64), *(np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(s[k : k + AT_ONCE].tolist(), e[k : k + AT_ONCE].tolist(), strict=True)], np.uint64) for k in range(0, len(s), AT_ONCE))])
    _, one, group = np.unique(hashes, return_index=True, return_inverse=True)
    of = one[group]
    right = bool(((e - s) == (e[of] - s[of])).all()) and all(same_slices(data, s[k : k + AT_ONCE], e[k : k + AT_ONCE], s[of[k : k + AT_ONCE]]).all() for k in range(0, len(s), AT_ONCE))
    if not right:
        numbers: dict[bytes, int] = {}
        group = np.array([numbers.setdefault(raw[x:y], len(numbers)) for x, y in zip(s.tolist(), e.tolist(), strict=True)])
        _, one = np.unique(group, return_index=True)
    return group, one


def slice_counts(data: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of documents, first byte and end of a term, its count and how many of the group's documents have it. of: group of each document.

    Terms by documents are a sparse matrix in rows of terms, its documents in order of their groups; both counts are sums over parts of a row.
    """
    s, e = term_bounds(data, at)
    group, one = grouped(data, s, e)
    order = np.argsort(of, kind="stable")
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))
    key = np.sort(group * len(of) + place[np.searchsorted(at, s, "right") - 1])
    cells = np.flatnonzero(np.diff(key, prepend=-1))
    counts = np.diff(np.append(cells, len(key)))
    term, doc = np.divmod(key[cells], max(1, len(of)))
    source = of[order][doc]
    rows = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0))
    n = np.add.reduceat(counts, rows) if len(rows) else counts
    return source[rows], s[one[term[rows]]], e[one[term[rows]]], n, np.diff(np.append(rows, len(cells)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: how often a term occurs in the documents of a language's source, and in how many. docs: lang, source, text, none null."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
            data, at = flat(batch.column(2))
            data = LOWER[data]
            names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            of = pd.factorize(pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()]))[0]
            _, example = np.unique(of, return_index=True)
            source, s, e, n, df = slice_counts(data, at, of)
            for k in range(0, len(source), AT_ONCE):
                x, y = s[k : k + AT_ONCE], e[k : k + AT_ONCE]
                size = y - x
                ends = np.concatenate([[0], np.cumsum(size)])
                own = data[np.arange(ends[-1]) + np.repeat(x - ends[:-1], size)]
                terms = pa.Array.from_buffers(pa.string(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own)])
                named = names.take(pa.array(example[source[k : k + AT_ONCE]]))
                yield pa.RecordBatch.from_arrays([named.field(0), named.field(1), terms, pa.array(n[k : k + AT_ONCE]), pa.array(df[k : k + AT_ONCE])], schema=kinds)

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division three digits at a time, so that 64 bits hold it."""
    rest, out = count + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // (total + 2 * terms)
        rest = rest % (total + 2 * terms)
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row of a sparse matrix. starts: where rows begin, and the end."""
    out = np.zeros(len(starts) - 1, np.int64)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(x, starts[:-1][full])
    return out


def chunk_divergences(counts: pd.DataFrame, sources: pd.DataFrame, own: slice, top: int) -> pd.DataFrame:
    """source, part, item, value over some of a language's kept terms. counts: term, source, n; sources: source, total, terms and lang_total, all sources of the
    language; own: those of them, in order, whose pairs are wanted. The terms of all sources come with the first.

    Counts are a sparse matrix with sources as rows. A source's shares of terms that it lacks are all alike, so for two sources the terms that either has
    are summed one by one and the others at once.
    """
    names = np.sort(sources["source"].values.astype(object))
    known = sources.set_index("source").loc[names]
    total, terms, lang_total = known["total"].values.astype(np.int64), int(known["terms"].iloc[0]), int(known["lang_total"].iloc[0])
    each = range(len(names))[own]
    if not terms:
        return pd.DataFrame([(names[a], "pair", names[b], 0) for a in each for b in range(len(names)) if a != b], columns=["source", "part", "item", "value"])
    items, column = np.unique(counts["term"].values.astype(object), return_inverse=True)
    row = np.searchsorted(names, counts["source"].values.astype(object))
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], counts["n"].values.astype(np.int64)[order]
    starts = np.searchsorted(row, np.arange(len(names) + 1))
    p, least = share(n, total[row], terms), share(np.zeros(len(names), np.int64), total, terms)
    has_n = np.diff(starts)
    out = []
    for a in each:
        mine = slice(starts[a], starts[a + 1])
        dense, has = np.full(len(items), least[a]), np.zeros(len(items), bool)
        dense[column[mine]], has[column[mine]] = p[mine], True
        both = has[column]
        values = _sums(difference(dense[column], p) - np.where(both, difference(dense[column], least[row]), 0), starts)
        kinds, times = np.unique(p[mine], return_counts=True)
        for k in range(0, len(kinds), 4096):
            values += (difference(kinds[k : k + 4096, None], least[None, :]) * times[k : k + 4096, None]).sum(0)
        neither = len(items) - has_n[a] - has_n + _sums(both.astype(np.int64), starts)
        values += neither * difference(least[a], least)
        others = np.arange(len(names)) != a
        out.append(pd.DataFrame({"source": names[a], "part": "pair", "item": names[others], "value": values[others]}))
    if own.start == 0 and len(n):
        whole = np.zeros(len(items), np.int64)
        np.add.at(whole, column, n)
        q = share(whole, lang_total, terms)[column]
        more = np.flatnonzero(p > q)
        value = difference(p[more], q[more])
        more = more[by := np.lexsort((column[more], -value, row[more]))]
        first = np.arange(len(more)) - np.searchsorted(row[more], row[more]) < top
        out.append(pd.DataFrame({"source": names[row[more][first]], "part": "term", "item": items[column[more][first]], "value": value[by][first]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"source": [], "part": [], "item": [], "value": []})


def divergences(docs: DataFrame, floor: int = 10, top: int = 10, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank for every source of every language.

    A term is a longest run of letters A-Z, lower-cased, and of bytes beyond ASCII. A language keeps the terms that `floor` of its documents or more have. Of
    each kept term, a source has the share 1 + floor(10 ** 9 * (count + 2) / (total + 2 * terms)); so has its language. Two shares p and q differ by
    floor((p - q) ** 2 / (p + q)). Part pair: for each other source, the sum over all kept terms (0 if there are none). Part term: the
    `top` terms that the source has, with a greater share than its language, that differ most from it. Ranks go by value, ties to
    the smaller item by UTF-8. All whole numbers.

    docs: lang, source, text, null counting as empty; other columns are left aside. Repeated rows count each. An empty table gives no rows.
    Terms are counted in slices of texts, then by Spark; a language's terms are dealt by hash to parts of about `chunk` counts, each of which sums pairs for
    itself. The number of pairs, the square of a language's sources, is the result's own.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("own"))
    kept = save_point(by_term.filter(F.col("df") >= floor).select("lang", "term", F.posexplode("own").alias("nth", "x")).select("lang", "term", "nth", "x.source", "x.n"))
    group = ["lang", "source"]
    totals = kept.groupBy(*group).agg(F.sum("n").alias("total"), F.count_if(F.col("nth") == 0).alias("terms"), F.count("*").alias("cells"))
    known = docs.select(*group).distinct().join(totals, group, "left")
    all_of = W.partitionBy("lang")
    sums = [F.sum(F.coalesce(c, F.lit(0))).over(all_of).alias(n) for c, n in (("total", "lang_total"), ("terms", "terms"), ("cells", "cells"))]
    known = known.select(*group, F.coalesce("total", F.lit(0)).alias("total"), *sums, F.count("*").over(all_of).alias("n_sources"))
    parts, blocks = F.greatest(F.lit(1), F.ceil(F.col("cells") / chunk)).cast("int"), F.ceil(F.col("n_sources") / block).cast("int")
    known = save_point(known.select(*group, "total", "lang_total", "terms", parts.alias("parts"), blocks.alias("blocks")))
    langs = known.select("lang", "parts", "blocks").distinct()
    each = kept.join(sent(langs, 64 * langs.count()), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    each = each.select("lang", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "term", "source", "n")
    beside = known.select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "blocks", "source", "total", "lang_total", "terms")
    beside = beside.select("lang", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "lang_total", "terms")
    at = ["lang", "chunk", "block"]

    def run(key: tuple, counts: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        return chunk_divergences(counts, sources, slice(key[2] * block, (key[2] + 1) * block), top).assign(lang=key[0])[["lang", "source", "part", "item", "value"]]

    found = each.groupBy(*at).cogroup(beside.groupBy(*at)).applyInPandas(run, "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of documents from the others of its language, and the terms that set it apart."""
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with docs as (
    select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), words as (
    select i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
    from docs
), kept as (
    select lang, term, count(*)::hugeint as n from words group by lang, term having count(distinct i) >= 10
), langs as (
    select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by lang
), counts as (
    select w.lang, w.source, w.term, count(*)::hugeint as n from words w join kept using (lang, term) group by all
), sources as (
    select d.lang, d.source, coalesce(t.n, 0)::hugeint as n
    from (select distinct lang, source from docs) d left join (select lang, source, sum(n) as n from counts group by all) t using (lang, source)
), shares as (
    select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
        1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.n + 2 * l.v) as p,
        1 + (1000000000::hugeint * (k.n + 2)) // (l.n + 2 * l.v) as q
    from sources s join langs l using (lang) join kept k using (lang) left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term
), pairs as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), found as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
    from sources a join sources b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
    union all
    select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from shares where n > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item collate "binary")::int as rank from found
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
