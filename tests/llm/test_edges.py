"""Nulls, empty and repeated rows, empty tables and clashing columns, for every operator and pipeline stage."""

import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import html_text, line_dedup, mixing, near_texts, neighbours, pieces, quality, repeats, sharding, simhash_docs, weighted_prints

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, root long, _k1 int, sim int"
LONG = " ".join(f"word{i % 97}" for i in range(70_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1, "x", 1, 1, 1),
    (1, "one two three four five six seven", "en", "a", 1, "x", 1, 1, 1),
    (2, None, None, None, None, None, None, None, None),
    (None, "one two three four five six seven", None, "b", 2, None, 2, 2, 2),
    (None, None, "en", None, 3, "y", 3, 3, 3),
    (3, "", "en", "b", 0, "z", 4, 4, 4),
    (4, " \n\t ", "en", "b", 4, "z", 4, 4, 4),
    (5, LONG, "en", "a", 5, "z", 5, 5, 5),
    (6, "ééé\n\n12 | 13\nOne, two; three four FIVE six seven", "fr", "a", 6, "z", 6, 6, 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, None, 0), (None, 1, 1), (6, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("near_prints", [True, False])
def test_line_dedup(docs, none, near_prints):
    out = line_dedup.dedup_lines(docs, near_prints).select("doc_id", "text", "line_count", "removed_lines", "sim").collect()
    assert len(out) == len(ROWS)
    by = {(r.doc_id, r.sim): r for r in out}
    assert by[(1, 1)].removed_lines == [] and by[(None, 2)].removed_lines == [0] and by[(None, 2)].text == ""
    assert by[(6, 6)].removed_lines == [3] and by[(6, 6)].text == "ééé\n\n12 | 13"
    assert by[(2, None)].text is None and by[(2, None)].line_count == 0
    assert by[(5, 5)].text == LONG
    assert line_dedup.dedup_lines(none, near_prints).count() == 0


def test_many_lines(spark):
    """A document of very many lines that go is done in a time that grows with them, not with their square."""
    docs = spark.createDataFrame([(1, "\n".join(f"a line of words number {'abcdefghij'[i % 10] * (1 + i % 7)} here" for i in range(100_000))), (2, "x\n" * 50_000)], "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert out[1].line_count == 100_000 and len(out[1].removed_lines) + out[1].text.count("\n") + 1 == 100_000
    assert out[2].text == "x\n" and len(out[2].removed_lines) == 49_999


def test_line_marks_around(spark):
    """Lines that are equal but for marks at their ends are one line, however short."""
    texts = ["Read more", "Read more.", "- Read more", "...", "Read  MORE!\n..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {0: "Read more", 1: "", 2: "", 3: "...", 4: "..."}


@pytest.mark.parametrize("together", [4096, 3])
def test_alike_lines(spark, monkeypatch, together):
    """Lines against all pairs by edit similarity alone, with chains, words changed, lost and added, and groups cut into parts."""
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    rng = np.random.default_rng(3)
    lines = []
    for _ in range(40):
        words = ["v" + "abcdefghij"[x // 10 % 10] + "klmnopqrst"[x % 10] for x in rng.integers(0, 100, int(rng.integers(4, 45)))]
        for _ in range(int(rng.integers(1, 7))):
            for _ in range(int(rng.integers(0, 1 + len(words) // 4))):
                k = int(rng.integers(0, len(words)))
                words[k : k + int(rng.integers(0, 2))] = ["n" + "".join("abcdefghij"[x] for x in rng.integers(0, 10, 4))] * int(rng.integers(0, 2))
            lines.append(" ".join(words))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    root = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            a_, b_ = a.split(), b.split()
            if root[i] != root[j] and a_ and b_ and distance(a_, b_) <= max(len(a_), len(b_)) * 0.2 + 1e-9:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(docs, near_prints=False).filter("removed_lines = array(0)").collect()} == {i for i, r in enumerate(root) if r != i}


def test_line_lanes_agree(spark):
    """Lines of more words than a lane counts have the fingerprint that single counts give."""
    import xxhash

    words = ["w" + "abcdefghij"[i % 10] * (i % 7) for i in range(line_dedup.LANES + 10)]
    for w in (words, words[: line_dedup.LANES], ["a", "b", "c"]):
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in w], np.uint64)
        want = sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(w))
        line = spark.createDataFrame([(1, 1, 0, " ".join(w))], "d long, k long, at int, line string")
        assert line_dedup.simhashed(line).first().sim & (2**64 - 1) == want


def test_pieces(docs, none):
    out = pieces.encoded(docs).collect()
    assert sorted(bytes(r.decoded).decode() for r in out) == sorted(r[1] or "" for r in ROWS)
    assert all((len(r.ids) == 0) == (bytes(r.decoded) == b"") for r in out)
    assert pieces.encoded(none).count() == 0


def test_neighbours(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(30)] + [(40, None, 0), (41, [0.0, 0.0], 0), (42, [float("nan"), 1.0], 0), (43, [1.0, None], 0), (44, [1.0], 0), (None, [1.0, 1.0], 0), (50, [3.0, 1.0], 0), (51, [3.0, 1.0], 0), (60, [1.0, 2.0, 3.0], 0), (61, [1.0, 2.0, 5.0], 0), (70, [9.0], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = {}
    for r in neighbours.nearest(v, F.col("vec_id") % 10 == 0, k=3).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(out) == [0, 10, 20, 50, 60, 70] and out[60] == [(1, 61, 2.0)] and out[70] == [(1, 44, 8.0)]  # each length by itself
    assert sorted(out[50]) == [(1, 3, 0.0), (2, 51, 0.0), (3, 2, 1.0)]
    assert sorted(out[10]) == [(1, 9, 1.0), (2, 11, 1.0), (3, 8, 2.0)]
    assert len(neighbours.nearest(v.filter("vec_id in (0, 1)"), F.col("vec_id") == 0).collect()) == 1
    assert neighbours.nearest(v.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_repeats(spark):
    """Rows that are there several times, as queries and as candidates, and ids with several vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += rows[:40] * 3 + [(i, rng.normal(size=4).tolist()) for i in range(0, 200, 7)]
    out = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=10).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 200, 10):
        own = [np.array(v) for i, v in rows if i == q]
        near = {}
        for i, v in rows:
            if i != q:
                near[i] = min([near.get(i, np.inf), *(float(np.sqrt(((x - np.array(v)) ** 2).sum())) for x in own)])
        want = sorted((d, i) for i, d in near.items())[:10]
        got = sorted(out[q])
        assert [x[0] for x in got] == list(range(1, 11)) and [x[1] for x in got] == [i for _, i in want]
        assert np.allclose([x[2] for x in got], [d for d, _ in want])


def test_repeats(docs, none):
    for keep in ("first", "none"):
        out = repeats.remove_repeats(docs, 40, keep).collect()
        assert sorted(r.n_bytes for r in out) == sorted(len((r[1] or "").encode()) for r in ROWS)
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_of_rows(spark):
    """A row that is there 200 times gives its stretches once, and each of its rows loses what two of them would."""
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    shared = " ".join(words[:60])
    rows = [(1, " ".join(words))] * 200 + [(2, "x " + shared + " y " + " ".join(f"v{x}" for x in rng.integers(0, 5000, 200))), (3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = repeats.row_key("doc_id", "text")
    texts = docs.select("doc_id", a.alias("k1"), b.alias("k2"), "text")
    cut = repeats._cut(texts, texts.distinct().select("k1", "k2", F.lit(5).cast("long").alias("shard"), F.lit(1).cast("long").alias("copies"), F.lit(False).alias("hot"), F.lit(0).alias("start"), F.lit(1).alias("n")), 400)
    assert cut.count() == 3
    for keep in ("none", "first"):
        out = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats(docs, 100, keep).collect()}
        assert out[1] == ("" if keep == "none" else out[1]) and out[3] == "z" and shared[:200] not in out[2]
    assert repeats.remove_repeats(docs, 100, "none").count() == 202


def test_repeats_of_one_shard(spark, monkeypatch):
    """Stretches of one passage in very many different texts are joined with their shard by several tasks."""
    held = {"adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "8k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in held}
    rng, parts = np.random.default_rng(2), []
    passage = min((rng.bytes(16).hex() for _ in range(20_000)), key=lambda x: repeats._grams(np.frombuffer(x.encode(), np.uint8))[0])
    docs = spark.createDataFrame([(i, rng.bytes(40).hex() + passage + rng.bytes(40).hex()) for i in range(2000)], "doc_id long, text string").repartition(8)
    save, cut = repeats.save_point, repeats._cut

    def counted(df):
        whole = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.max(F.xxhash64(*df.columns)))
        parts.append(max(r["rows"] for r in whole.collect()))
        return df

    def saved(df):
        return counted(save(df)) if "copies" not in df.columns and {"shard", "s1"} <= set(df.columns) else save(df)

    monkeypatch.setattr(repeats, "save_point", saved)
    monkeypatch.setattr(repeats, "_cut", lambda texts, wanted, length: cut(texts, counted(wanted), length))
    try:
        for k, v in held.items():
            spark.conf.set(f"spark.sql.{k}", v)
        out = repeats.remove_repeats(docs, 100, "none").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert len(out) == 2000 and not any(r.spans for r in out)
    assert len(parts) == 3 and max(parts[1:]) < 1000, parts


def test_mixing(docs, none):
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS) and all(r.copies in (0, 1, 2) for r in out)
    assert {r.source for r in out} == {"a", "b", None}
    assert mixing.mix(none).count() == 0
    kept = mixing.apply_mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in out)


def test_sharding(docs, none):
    out = sharding.shard_rows(docs, 4).collect()
    assert len(out) == len(ROWS)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(none, 4).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", "x"), (2, None, None, "y"), (None, "u", "", "z"), (3, "u", "<article><h1>T</h1><p>x &amp; y</article><footer>f</footer>", "w"), (3, "u", "<article><h1>T</h1><p>x &amp; y</article><footer>f</footer>", "w")], "page_id long, url string, html string, _html string")
    out = html_text.extracted(pages.withColumn("main_text", F.lit("other"))).collect()
    assert sorted(r.main_text for r in out) == ["", "", "T\n\nx & y", "T\n\nx & y", "a\n\nb"]
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "id='page' class='no-sidebar'", "class='post share-enabled'", "class='layout-sidebar-right'", "class='sidebar'"])
def test_html_wrappers(wrapper):
    """Pages without article or main, whose wrapper's class has a word that marks what is around an article."""
    paragraphs = [f"This is paragraph {k} of the text, long enough to be what the page is about, and without links." for k in range(5)]
    around = "<ul class='site-nav'><li><a href='/'>Home</a><li><a href='/a'>About us</a></ul>"
    page = f"<body>{around}<div {wrapper}>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class='post-comments'><p>I like it.</p></div></div><div class='footer-links'><a href='/c'>Terms</a></div>"
    text = html_text.Page(page).text()
    assert text.startswith("\n\n".join(paragraphs)) and "Home" not in text and "Terms" not in text
    assert "I like it" not in text or wrapper == "class='sidebar'"
    assert html_text.Page(f"<p>a<div class='hidden' hidden>{paragraphs[0]}</div>").text() == "a"


def test_html_names_within():
    """Names of bars of links leave text in an article alone, and still take away what is mostly links; references end with their element."""
    long = "This paragraph is part of the article and says something at some length, whatever the name of its class may be."
    links = "<a href='/a'>Another page of this site with a long title</a> <a href='/b'>One more page of it with a long title</a>"
    kept = [f"<div class='social-history'><p>{long} One.</p></div>", f"<p class='related'>{long} Two.</p>", f"<p class='nav-theory'>{long} Three.</p>"]
    gone = [f"<div class='related'>{links}</div>", f"<p class='social-links'>Share: {links}</p>", "<div class='share'>Share this</div>", f"<div class='comments'><p>{long} Reader.</p></div>", f"<p class='sponsored'>{long} Paid.</p>"]
    for tag in ("article", "main", "div"):
        text = html_text.Page(f"<body><{tag}><h1>Title</h1><p>{long}</p>{kept[1]}{gone[0]}{kept[2]}{''.join(gone[1:])}{kept[0] if tag != 'div' else ''}<p>{long} End.</p></{tag}></body>").text()
        assert all(f"{long} {x}." in text for x in ("Two", "Three", "End", *(["One"] if tag != "div" else []))), text
        assert not any(x in text for x in ("Another page", "Share", "Reader.", "Paid.")), text
    assert html_text.Page(f"<article><p>{long} AT&am<b>p;amp;T</b> a &lt; b</p></article>").text() == f"{long} AT&amp;amp;T a < b"


def test_simhash(docs, none):
    found = simhash_docs.with_component(simhash_docs.near_duplicates(docs, 3)).collect()
    assert len(found) == len(ROWS)
    assert {r.component_id for r in found if r.fp == 0} == {2}
    kept = simhash_docs.keep_first(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in rows) == sorted({1, 2, 5, 6} & {r.doc_id for r in rows}) and 1 in {r.doc_id for r in rows}
    assert simhash_docs.keep_first(none).count() == 0


def test_near_texts(docs, none):
    """Nulls count as empty, texts without words are one group, repeated rows are copies, and other columns stay as they are."""
    kept = near_texts.keep_first(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in rows) == [1, 2, 5, 6]
    assert {r.doc_id: r.sim for r in rows} == {1: 1, 2: None, 5: 5, 6: 6}
    assert near_texts.keep_first(none).count() == 0


def test_near_texts_repeats(spark):
    """Copies of which one holds a run of one word longer than the text, or that have few shingles, against all pairs by sets of shingles."""
    rng = np.random.default_rng(9)
    texts = []
    for n in (300, 120, 60):
        text = " ".join(f"w{x}" for x in rng.integers(0, 9000, n))
        texts += [text, text + " ha" * 3 * n]
    for _ in range(150):  # sets of five and four shingles, a similarity of exactly 0.8
        text = " ".join(f"w{x}" for x in rng.integers(0, 9000, 9))
        texts += [text, text.rsplit(" ", 1)[0]]
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = {k for k in range(1, len(texts), 2) if len(shingles[k] & shingles[k - 1]) >= 0.8 * len(shingles[k] | shingles[k - 1])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(near) == 153 and {r.doc_id for r in near_texts.keep_first(docs).collect()} == set(range(len(texts))) - near


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.quality_score <= 1 for r in out)
    assert quality.scored(none, quality.train(none, labels.limit(0))).count() == 0


def test_prints(docs, none):
    out = weighted_prints.prints(docs).collect()
    assert len(out) == len(ROWS)
    assert len({r.fingerprint for r in out if r.n_chars == 33}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert weighted_prints.prints(none).count() == 0


def test_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, none):
        at = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, str(tmp_path))
            at.write.parquet(out := f"{tmp_path}/{name}{rows is none}")
            at = spark.read.parquet(out)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == docs.columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_texts_by_simhash(spark):
    """SimHash and BK-trees link texts of the stage by themselves; fingerprints that lie near, or are equal, do not link texts that are not alike."""
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words), *(" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 900, 30)), " ".join(words * 2), "", " ".join(words[:700])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    prints = near_texts._prints(docs, 5).localCheckpoint()
    each = prints.groupBy("u").agg(F.min("fp").alias("fp"), F.min(F.struct("k1", "k2")).alias("k"), F.min("doc_id").alias("d")).localCheckpoint()
    of = {r.u: (texts[r.d], r.fp) for r in each.collect()}
    links = near_texts.simhash_links(each.select("u", "fp", "k"), docs, 5).collect()
    near = [(x, y) for x, y in combinations(of, 2) if ((of[x][1] ^ of[y][1]) & (2**64 - 1)).bit_count() <= 3]
    alike = lambda x, y: near_texts.alike(*(near_texts.shingle_set(of[u][0].encode(), 5) for u in (x, y)))
    assert links and all(alike(r.a, r.b) for r in links) and {u for r in links for u in (r.a, r.b)} == {u for p in near if alike(*p) for u in p}
