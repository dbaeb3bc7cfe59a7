"""Periodic runs, packing and source divergence against brute-force versions or SQL, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import public_tokenizers
from leafmill.llm import divergence, first_fit, periodic
from leafmill.llm.registry import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, group int, runs string, n_words long, term string, rank int"
TEXTS = ["a b a b a b a b c", "a b a b a b a b c", None, "", " \n\t\x0b ", "x " * 40, "é é é é é é é <|endoftext|>  tail\n\n  x", "one"]
ROWS = [(k if k != 7 else None, t, "en" if k % 3 else None, "s", 1, "r", 5, "t", 2) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, "s", 1, "r", 5, "t", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words, shortest=6, times=4):
    """Every maximal stretch of every period, of which those count whose least period it is."""
    n, out = len(words), []
    w = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // times + 1):
        i = 0
        same = w[:-q] == w[q:]
        while i < len(same):
            if not same[i]:
                i += 1 + int(np.argmax(same[i + 1 :])) if same[i + 1 :].any() else len(same)
                continue
            j = i + (int(np.argmin(same[i:])) if not same[i:].all() else len(same) - i)
            s, e = i, j + q
            if e - s >= max(shortest, times * q) and not any((w[s : e - r] == w[s + r : e]).all() for r in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def rewritten(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_table(spark, table):
    got = {r.doc_id: r for r in entry.queries()["op11_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(table)
    some = 0
    for d, text in zip(table.doc_id, table.text, strict=True):
        words = rewritten(d, words_of(text))
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=(None,) * 3)
        some += bool(runs)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert some > 10


@pytest.mark.parametrize(("shortest", "times", "points"), [(6, 4, 1 << 21), (6, 4, 7), (2, 2, 1 << 21), (9, 3, 50)])
def test_periodic_random(monkeypatch, shortest, times, points):
    """Texts of few words and of repeated parts, all documents at once, with the grid cut small."""
    monkeypatch.setattr(periodic, "POINTS", points)
    rng = np.random.default_rng(4)
    each = []
    for _ in range(150):
        part = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 9))
        w = np.concatenate([rng.integers(0, 3, rng.integers(0, 12)), np.tile(part, rng.integers(1, 9)), rng.integers(0, 3, rng.integers(0, 12))])
        each.append(w)
    thue = [0]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    each += [np.array(thue), np.zeros(300, int), np.zeros(0, int), np.array([1])]
    ends = np.cumsum([len(w) for w in each])
    starts = ends - [len(w) for w in each]
    d, s, e, q = periodic.runs(np.concatenate(each).astype(np.int64), starts, ends, shortest, times)
    got = defaultdict(list)
    for k, *r in zip(d.tolist(), s.tolist(), e.tolist(), q.tolist(), strict=True):
        got[k].append((r[0] - starts[k], r[1] - r[0], r[2]))
    for k, w in enumerate(each):
        assert got[k] == brute_runs(w.tolist(), shortest, times), k


def test_periodic_hash_that_lies(monkeypatch):
    """Where hashes agree for words that differ, the check of the words finds it."""
    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7, 7, 7, 1, 2, 3], np.int64)
    ends = np.array([9, 23])
    want = [(0, 0, 8, 2), (1, 13, 20, 1)]
    for lie in (False, True):
        if lie:
            monkeypatch.setattr(periodic.Prefixes, "same", lambda self, i, q, n: np.ones(len(i), bool))
        assert list(zip(*(x.tolist() for x in periodic.runs(words, ends - [9, 14], ends)), strict=True)) == want


def test_periodic_edges(spark, docs, none):
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], len(words_of(r[1])), runs := brute_runs(words_of(r[1])), collapsed(words_of(r[1]), runs)) for r in ROWS), key=repr)
    assert periodic.periodic_runs(none).count() == 0 and periodic.planted(none).count() == 0
    assert periodic.planted(docs).count() == len(ROWS)
    long = np.array(["w", "v"] * 200_000 + ["x"] * 100_000)
    r = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 400_000, 2), (400_000, 100_000, 1)] and r.collapsed == "w v x"


def held_pieces(rows, texts, length=1024):
    """Pieces tile each document's ids, sequences are gapless, and no sequence needs padding; the share of padding if each rest stood alone."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at < length and not at & (at - 1)


def test_packing_table(spark, table):
    rows = entry.queries()["op12_packing"](spark, FOLDER).collect()
    held_pieces(rows, zip(table.doc_id, table.text, strict=True))
    assert sorted(rows) == sorted(entry.queries()["op12_packing"](spark, FOLDER).collect())


def test_packing_groups(spark, docs, none):
    """Small groups and sequences; nulls, empty texts, an added token in a text, and a row that is there twice."""
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.json")
    for group in (16, 1 << 20):
        rows = first_fit.packed(docs, path, 16, group=group).withColumn("ids_crc32", F.crc32("ids")).collect()
        assert sum(r.length for r in rows if r.doc_id == 0) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 0)
        held_pieces([r for r in rows if r.doc_id != 0], [(r[0], r[1]) for r in ROWS if r[0] != 0], 16) if group == 16 else None
        assert sum(r.length for r in rows) == sum(len(x) + 1 for x in Tokenizer.from_file(path).encode_batch([r[1] or "" for r in ROWS], add_special_tokens=False))
    assert first_fit.packed(none, path).count() == 0


def test_first_fit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 700):
        sizes = sorted(rng.integers(1, 101, n).tolist(), reverse=True)
        loads, want = [], []
        for x in sizes:
            k = next((k for k, load in enumerate(loads) if load + x <= 100), len(loads))
            if k == len(loads):
                loads.append(0)
            loads[k] += x
            want.append(k)
        assert first_fit.first_fit(sizes, 100) == want


def test_units_are_whole_texts():
    """Ids by units are those of whole texts, for texts of all kinds of white space, letters, digits, marks and added tokens."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(8)
    parts = [" ", "  ", "\n", "\t", " ", " ", "　", "\x0b", "a", "B", "word", "Straße", "don't", "'s", "'", "''", "12", "3", "½", ".", ",\n", "é", "é", "日本語", "日", "😀", "<|endoftext|>", "<|", "|>", "\x00", "\x7f", "ñ", "​", "_", "-"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(4000)]
    encoder = first_fit.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for size in (1, 7, 500):
        at = 0
        for k in range(0, 1000 if size == 1 else len(texts), size):
            own = texts[k : k + size]
            ids, counts = encoder(pa.array([None, *own]).slice(1))
            at = 0
            for text, n in zip(own, counts.tolist(), strict=True):
                assert ids[at : at + n].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
                at += n
    assert encoder(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_divergence_table(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op13_source_divergence"]).fetchall()
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in entry.queries()["op13_source_divergence"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)


def brute_divergences(rows, floor, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for _, _, t in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [[t.translate(low) for t in x] for x in terms]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(t for r, x in zip(rows, terms, strict=True) if r[0] == lang for t in set(x))
        kept = sorted(t for t, n in df.items() if n >= floor)
        count = defaultdict(Counter)
        for r, x in zip(rows, terms, strict=True):
            if r[0] == lang:
                count[r[1]].update(t for t in x if df[t] >= floor)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s))
            own = sorted((-f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k) for part, x in (("pair", pairs), ("term", own)) for k, (v, item) in enumerate(x, 1)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "block", "weak"), [(500_000, 512, False), (7, 2, False), (0, 0, True)])
def test_divergence_random(spark, monkeypatch, chunk, block, weak):
    """Nulls, sources without terms, a language without kept terms, repeated rows, and few terms a part; weak: a hash that many terms share."""
    rng = np.random.default_rng(6)
    names = [f"{a}{b}" for a in ("Haus", "é", "x", "日本", "B") for b in ("a", "ß", "", "Q", "z")]
    rows = [(["en", "de", None, ""][rng.integers(4)], [None, "a", "b", "ü", "c"][rng.integers(5)], " 1,".join(names[i] for i in rng.integers(0, rng.integers(1, 26), rng.integers(0, 30)))) for _ in range(300)]
    rows += [("fr", "a", "one two"), ("fr", "b", None), ("en", "none", "12 .."), ("it", "only", "uno " * 50)] + rows[:9]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    if weak:
        data, at = divergence.flat(pa.array([r[2] for r in rows]))
        monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 3)
        s, e = divergence.term_bounds(divergence.LOWER[data], at)
        group, one = divergence.grouped(divergence.LOWER[data], s, e)
        raw = divergence.LOWER[data].tobytes()
        assert all(raw[a:b] == raw[s[k] : e[k]] for a, b, k in zip(s.tolist(), e.tolist(), one[group].tolist(), strict=True)) and len({raw[a:b] for a, b in zip(s, e, strict=True)}) == len(one)
    else:
        got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergences(docs.repartition(4), 10, 10, chunk, block).collect()]
        assert sorted(got) == brute_divergences(rows, 10, 10)


def test_divergence_edges(docs, none):
    assert divergence.divergences(none).count() == 0
    got = divergence.divergences(docs, 1)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergences([(r[2], r[3], r[1]) for r in ROWS], 1, 10)
