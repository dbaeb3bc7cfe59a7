"""Operators on small frames of their own."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import routing, text
from leafmill.operators import cells, chunks, ingest, layout, packing, reports, retrieval, sections
from leafmill.plans import catalog
from leafmill.sources import store, urls
from leafmill.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_terms(spark):
    assert one(spark, text.terms(F.col("t")), t="Net-4.1 is -Origin 5% v2. end.") == ["net-4.1", "is", "origin", "5%", "v2.", "end."]
    assert one(spark, text.terms(F.col("t")), t="a 摘要文件 字") == ["a", "摘要", "要文", "文件", "字"]


def test_small_caps(spark):
    assert one(spark, text.repaired_caps(F.col("t")), t="A LPHA NET: S IMPLE A ND F AST") == "ALPHA NET: SIMPLE AND FAST"
    assert one(spark, text.repaired_caps(F.col("t")), t="A plain title of words") == "A plain title of words"


def test_percentile_rule(spark):
    v = F.array(*map(F.lit, [3.0, 1.0, 2.0, 4.0]))
    assert one(spark, text.rank_percentile(v, 0.5), t=1) == 3.0 and one(spark, text.rank_percentile(v, 0.95), t=1) == 4.0


@pytest.mark.parametrize(("url", "want"), [("2410.05779", "https://arxiv.org/pdf/2410.05779"), ("https://arxiv.org/abs/2410.05779v2", "https://arxiv.org/pdf/2410.05779v2"), ("http://a.org/x", "https://a.org/x"), ("a.org/x.pdf", "https://a.org/x.pdf"), ("ftp://a.org", None)])
def test_links(spark, url, want):
    assert one(spark, urls.normalized(F.col("t")), t=url) == want


@pytest.mark.parametrize(("url", "why"), [("https://127.0.0.1/x", "address"), ("https://169.254.169.254/", "address"), ("https://172.20.0.1", "address"), ("https://8.8.8.8/", None), ("http://a.org", "scheme"), ("https:///x", "host")])
def test_refusals(spark, url, why):
    assert one(spark, urls.refusal(F.col("t")), t=url) == why


@pytest.mark.parametrize(("q", "route", "pair"), [("Compare AlphaNet with BetaNet?", "comparison", ["AlphaNet", "BetaNet"]), ("A1 vs B2", "comparison", ["A1", "B2"]), ("give an Overview", "summary", []), ("what is it", "qa", []), ("比較 甲法 和 乙法", "comparison", ["甲法", "乙法"])])
def test_routes(spark, q, route, pair):
    assert one(spark, routing.route(F.col("t")), t=q) == route and one(spark, routing.compared(F.col("t")), t=q) == pair
    assert len(one(spark, routing.subqueries(F.col("t"), routing.compared(F.col("t"))), t=q)) == (5 if pair else 1)


def test_sections(spark):
    b = spark.createDataFrame([(1, 0.0, "Abstract of all"), (1, 1.0, "1 Intro words"), (1, 2.0, "text"), (1, 3.0, "1.2 More of it"), (1, 4.0, "text"), (2, 0.0, "no heading here, just a sentence that ends")], "doc_id long, ord double, text string")
    s = sections.sections_of(sections.text_headings(b).withColumn("seq", F.col("ord")))
    assert [(r.section_id, r.level) for r in s.orderBy("section_id").collect()] == [("s000", 1), ("s001", 2)]
    got = {(r.doc_id, r.ord): (r.section_id, r.section_title) for r in sections.assigned(b, s).collect()}
    assert got == {(1, 0.0): ("s000f", "Abstract"), (1, 1.0): ("s000", "1 Intro words"), (1, 2.0): ("s000", "1 Intro words"), (1, 3.0): ("s001", "1.2 More of it"), (1, 4.0): ("s001", "1.2 More of it")}
    ways = sections.cascade(s, s.unionByName(s.withColumn("section_id", F.concat(F.lit("x"), "section_id"))))
    assert {r.way for r in ways.collect()} == {1}


def test_outline(spark):
    e = spark.createDataFrame([(1, 0, "A", 1, 1, [5.0, 50.0]), (1, 1, "B", 1, 1, [3.0, 40.0]), (1, 2, "C", 2, 3, [])], "doc_id long, seq int, title string, level int, page int, places array<double>")
    assert [r.ord for r in sections.located(e).orderBy("seq").collect()] == [5.0, 40.0, 20000.0]


def test_split():
    long = "one two three. " * 300
    pieces = chunks.split_text(long, 100)
    assert all(len(p.split()) <= 100 for p in pieces) and " ".join(" ".join(pieces).replace(".", "").split()) == " ".join(long.replace(".", "").split())
    assert chunks.split_text("w " * 10, 3) and chunks.split_text("x" * 50, 3) == ["x" * 50]


def test_pack(spark):
    word = lambda n: " ".join(["w"] * n)
    rows = [(1, 300, 1, 10, "text", 100, word(100)), (1, 300, 2, 11, "table_full", 250, word(250)), (1, 300, 3, 12, "text", 150, word(90) + ". " + word(60)), (1, 300, 4, 13, "text", 500, word(150) + ". " + word(350)), (1, 300, 5, 14, "text", 30, word(30))]
    c = spark.createDataFrame(rows, "query_id long, budget int, place int, chunk_id long, kind string, n_tokens int, text string")
    out = packing.packed(c).orderBy("place").collect()
    assert [(r.outcome, r.n) for r in out] == [("kept", 1), ("dropped", None), ("kept", 2), ("dropped", None), ("dropped", None)]
    assert sum(r.tokens for r in out) <= 300


def test_round_robin(spark):
    h = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 6, 2), (1, 1, 5, 1), (1, 1, 7, 2)], "query_id long, sub int, chunk_id long, rank int")
    assert [r.chunk_id for r in retrieval.round_robin(h, 2).orderBy("rank").collect()] == [5, 6]


def test_histogram_quantile(spark):
    v = spark.createDataFrame([("a", x) for x in (0.4, 1.5, 1.6, 2.5)], "g string, x double")
    q = reports.quantiles(reports.histogram(v, ["g"], (1, 2, 3)), ["g"], 0.5)
    assert q.first().value == 1.5


def test_rows_of_words(spark):
    w = spark.createDataFrame([(1, 0.0, 10.0, 5.0, "a"), (1, 6.0, 12.0, 9.0, "b"), (1, 30.0, 11.0, 35.0, "c"), (1, 0.0, 20.0, 5.0, "d")], "doc_id long, x0 double, y0 double, x1 double, word string")
    c = layout.row_cells(layout.with_rows(w, ["doc_id"]), ["doc_id", "row"]).orderBy("row", "cell").collect()
    assert [(r.row, r.text) for r in c] == [(10.0, "a b"), (10.0, "c"), (20.0, "d")]


def test_tie_counts_as_loss(spark):
    rows = [(1, "T", 0, "A / m", 0, "X / A", "50%"), (1, "T", 0, "A / m", 1, "X / B", "50%"), (1, "T", 0, "A / m", 2, "Y / A", "40%"), (1, "T", 0, "A / m", 3, "Y / B", "60%")]
    t = cells.tallies(spark.createDataFrame(rows, "doc_id long, table_id string, row_idx int, row_label string, col_idx int, col_name string, val string")).first()
    assert (t.subject, t.wins, t.ties, t.losses) == ("B", 1, 1, "X")


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    store.save({"chunks": df}, str(tmp_path))
    store.save({"chunks": df.filter("doc_id = 'a'").withColumn("n", F.lit(9))}, str(tmp_path))
    schema = "n int, doc_id string"
    assert sorted((r.doc_id, r.n) for r in store.read(spark, str(tmp_path), "chunks", schema).collect()) == [("a", 9), ("b", 2)]
    assert store.read(spark, str(tmp_path), "sections", schema).count() == 0
    assert store.delete(spark, str(tmp_path), "a") and not store.delete(spark, str(tmp_path), "a")
    assert [r.doc_id for r in store.read(spark, str(tmp_path), "chunks", schema).collect()] == ["b"]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    assert [r.path.endswith("a.pdf") for r in store.uploads(spark, str(tmp_path)).collect()] == [True]


def test_answer_events(spark):
    a = spark.createDataFrame([(1, "qa", "two words", None)], "query_id long, route string, text string, error string")
    assert [(r.kind, r.value) for r in jobs.answer_events(a).orderBy("seq").collect()] == [("route", "qa"), ("stage", "retrieving"), ("stage", "packing"), ("stage", "generating"), ("token", "two "), ("token", "words"), ("done", "")]


def test_lexical_plan(spark):
    """The documents are read once, for postings that are kept; from there on no product of tables, and no shuffle but those of sums and best hits."""
    plan = catalog.QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "documents.parquet" not in plan and plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan


def test_ingest_tables(spark):
    """With the tables' switch their blocks leave the text and come back as whole tables and rows; a table of pairs says so."""
    blocks = spark.createDataFrame([(1, 0, 1, 0.0, 10.0, "1. Intro"), (1, 1, 1, 20.0, 30.0, "some text"), (1, 2, 1, 200.0, 210.0, "inside the table")], "doc_id long, ord long, page int, y0 double, y1 double, text string")
    tables = spark.createDataFrame([(1, "T1", 1, 190.0, 300.0, None, "s000", "Intro")], "doc_id long, table_id string, page int, y0 double, y1 double, caption string, section_id string, section_title string")
    cells = spark.createDataFrame([(1, "T1", 0, "r", 0, "X / A", "60%"), (1, "T1", 0, "r", 1, "X / B", "40%")], "doc_id long, table_id string, row_idx int, row_label string, col_idx int, col_name string, val string")
    profiles = spark.createDataFrame([(1, "Title", "front", 1, 1)], "doc_id long, title string, front string, n_pages int, n_sections int")
    out = {r.chunk_id: r for r in ingest.ingested(blocks, profiles, tables, cells).collect()}
    assert out["T1-full"].text == f"T1 (p. 1)\n{ingest.PAIRWISE}\n[T1 · p.1] r: X / A = 60%; X / B = 40%" and out["T1-r00"].row_label == "r"
    assert "doc-info" in out and not any("inside" in r.text for r in out.values())
    plain = ingest.ingested(blocks, profiles, tables, cells, use_tables=False).collect()
    assert {r.kind for r in plain} == {"text"} and any("inside the table" in r.text for r in plain)


def test_search_sums_of_parts_and_common_questions(spark, monkeypatch):
    """Small parts and blocks, equal questions, and a chunk that has the same rows twice give what a plain sum gives."""
    from leafmill.operators import retrieval

    monkeypatch.setattr(retrieval, "POSTINGS", 4)
    monkeypatch.setattr(retrieval, "ASKED", 2)
    texts = [(0, i, f"a{i % 3} b{i % 2} c" + " c" * (i % 4)) for i in range(12)] + [(0, 12, None), (0, 13, "")]
    chunks = spark.createDataFrame(texts, "index_id int, chunk_id long, text string")
    asked = spark.createDataFrame([(1, 0, "a1 b0"), (2, 0, "b0 a1"), (3, 0, "a2 a2 c"), (4, 0, None), (5, 0, "none")], "query_id long, index_id int, text string")
    got = {}
    for r in retrieval.lexical_top(chunks, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    stats = {r.term: r for r in retrieval.term_stats(retrieval.postings(chunks)).collect()}
    for q, words in ((1, "a1 b0"), (2, "b0 a1"), (3, "a2 a2 c")):
        scores = []
        for _, i, text in texts[:12]:
            has = text.split()
            n = sum(stats[w].idf * has.count(w) * 2.5 / (has.count(w) + 1.5 * (0.25 + 0.75 * len(has) / stats[w].avgdl)) for w in words.split())
            scores.append((-round(n, 6), i))
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:3]]
    assert sorted(got) == [1, 2, 3]


def test_dense_search_of_small_parts(spark, monkeypatch):
    from leafmill.operators import retrieval

    monkeypatch.setattr(retrieval, "PART", 7)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "PRODUCT", 2)
    v = [[float((i * 7) % 5), float(i % 3), 1.0] for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(v)), "chunk_id long, v array<double>")
    asked = rows.filter("chunk_id % 4 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in retrieval.dense_top(rows, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for q in range(0, 40, 4):
        best = sorted((-round(sum(a * b for a, b in zip(v[q], w, strict=True)), 6), i) for i, w in enumerate(v))[:5]
        assert got[q] == [(i, -s) for s, i in best]


def test_a_long_score_matrix_is_never_whole(spark):
    """A product takes a few queries at a time, so that a task of the largest part and block stays small."""
    from leafmill.operators import retrieval

    assert retrieval.PRODUCT * retrieval.PART * 8 <= 32 << 20


def test_streams_of_tables_in_several_files(spark, tmp_path):
    from leafmill.plans import streams

    spark.createDataFrame([(i // 3, i % 3) for i in range(30)], "conv_id long, turn long").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = streams.summary_progress(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.done, r.total) for r in got) == [(i, 3, 3) for i in range(10)]


def test_words_of_pages_are_not_shuffled(spark):
    """Cells, their columns and headers come of one shuffle of the lines."""
    from leafmill.plans import catalog

    for name in ("grid_cells", "aligned_cells", "spanned_headers"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange" in line]
        assert moved and all("REPARTITION_BY_NUM" in line for line in moved), moved


def test_segmentation_broadcasts_only_what_is_measured(spark, monkeypatch):
    from leafmill.operators import segmentation

    df = spark.createDataFrame([(1, "甲乙丙 甲乙 ab"), (2, "甲乙丁"), (3, None)], "id long, text string")
    small = {r.id: r.terms for r in segmentation.segmented(df, ["id"]).collect()}
    monkeypatch.setattr(segmentation, "SENT", 0)
    out = segmentation.segmented(df, ["id"])
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.terms for r in out.collect()} == small == {1: ["ab", "甲乙", "丙", "甲乙"], 2: ["甲乙", "丁"], 3: []}


def test_grams_of_a_text_are_counted_in_place(spark):
    import hashlib

    from leafmill.functions.embedding import embedder

    texts = ["Ab  cab cab", "日本𝄞語日本𝄞", "ab", None]
    out = embedder("grams")(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        bare, v = " ".join((texts[r.id] or "").lower().split()), [0.0] * 64
        for i in range(len(bare) - 2):
            h = int(hashlib.md5(bare[i : i + 3].encode()).hexdigest()[:8], 16)
            v[h % 64] += 1 if h >= 2**31 else -1
        n = max(sum(x * x for x in v) ** 0.5, 1e-12)
        assert [round(x, 9) for x in r.v] == [round(x / n, 9) for x in v]


def test_each_part_has_its_task(spark):
    """Parts and blocks of a search never meet in one task, of however many; by hash into 8 partitions, 24 places would."""
    rows = spark.range(2400).select((F.col("id") % 8).cast("int").alias("part"), (F.col("id") % 3).cast("int").alias("block"))
    placed = retrieval._placed(rows, 8, 3).select("place", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == len({r.place for r in placed}) == len({r.task for r in placed}) == 24


def test_questions_are_routed_once(spark):
    from leafmill.plans import answers

    plan = answers.asked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "regexp" not in plan


def test_state_calls_of_a_job_do_not_grow_with_its_followers():
    """A follower is written when it comes and not with each change; what it is sent is numbered across batches all the same."""
    from datetime import UTC, datetime, timedelta

    from pyspark.sql import Row

    from leafmill.streaming import keyed

    calls = []

    class State:
        def __init__(self, held=None):
            self.held = held

        def get(self):
            calls.append("get")
            return self.held if self.held is None or isinstance(self.held, tuple) else iter(self.held)

        def update(self, value):
            calls.append("update")
            self.held = value

        def appendList(self, values):
            calls.append("append")
            self.held = [*self.held, *values]

        def clear(self):
            calls.append("clear")
            self.held = []

    class Handle:
        timers = set()

        def getValueState(self, name, schema):
            return State()

        def getListState(self, name, schema):
            return State([])

        def registerTimer(self, at):
            calls.append("register")
            self.timers.add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            self.timers.remove(at)

    event, start, handle = Row("event_id", "ts", "kind", "stage", "detail"), datetime(2024, 1, 1, tzinfo=UTC), Handle()
    at = lambda i, kind, stage="parsing", detail=None: event(i, start + timedelta(seconds=i), kind, stage, detail)
    one = keyed.Jobs(60)
    one.init(handle)

    def call(*events):
        calls.clear()
        out = list(one.handleInputRows((7,), iter(events), None))
        assert len(calls) <= 6
        return [(r.subscriber, r.seq, r.stage, r.finished, r.updates) for r in out]

    came = call(*(at(i, "subscribe") for i in range(100)), at(100, "event"))
    assert came[:100] == [(i, 0, "queued", False, 0) for i in range(100)] and came[100:200] == [(i, 1, "parsing", False, 1) for i in range(100)]
    assert handle.timers == {int(start.timestamp() * 1000) + 160_000}
    more = call(at(300, "subscribe"), at(200, "event", "indexing"), at(201, "event", "ready"))  # in order of time, not of arrival
    assert more[0] == (0, 2, "indexing", False, 2) and more[199] == (99, 3, "ready", False, 3) and more[200] == (300, 0, "ready", False, 3) and len(more) == 202
    handle.timers.clear()  # the store drops a timer that has ended
    assert [(r.subscriber, r.stalled, r.updates) for r in one.handleExpiredTimer((7,), None, None)] == [(None, True, 3)]
    last = call(at(400, "event", "summarizing", "summary_ready"), at(401, "subscribe"), at(402, "event", "failed"), at(403, "event"))
    assert last[0] == (0, 4, "summarizing", True, 4) and last[100] == (300, 1, "summarizing", True, 4) and last[101:] == [(401, 0, "summarizing", True, 4), (None, None, "failed", True, 6)]
    assert not handle.timers


def test_memory_of_dense_products_is_that_of_their_input():
    """8,192 queries by 8,192 vectors: their scores at once would be 512 MB."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from leafmill.operators import retrieval

    v = list(np.random.default_rng(1).standard_normal((8192, 4)))
    left, right = pd.DataFrame({"chunk_id": np.arange(8192), "v": v}), pd.DataFrame({"query_id": np.arange(8192), "v": v})
    tracemalloc.start()
    try:
        found, peak = retrieval._products(3)(left, right), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 3 * 8192 and peak < 64 << 20
    score = np.round(np.stack(v)[:5] @ np.stack(v).T, 6)
    assert found["chunk_id"].values[:15].reshape(5, 3).tolist() == [np.lexsort((np.arange(8192), -row))[:3].tolist() for row in score]


def test_rows_of_one_index_have_one_order(spark):
    """Rows of one row_idx, of which one is a subheading: their order in the input changes no group."""
    kind = "doc_id long, table_id string, row_idx long, label string, rest array<string>, header array<string>"
    head, rows = ["base", "Head"], [(1, "row A", ["7"]), (2, "row B", ["8"]), (2, "row S", ["base", "Sub"]), (2, "row T", ["base", "Other"]), (3, "row C", ["9"])]
    made = [spark.createDataFrame([(1, "T", i, label, rest, head) for i, label, rest in each], kind).coalesce(1) for each in (rows, rows[::-1])]
    got = [sorted((r.row_idx, r.row_label) for r in cells.grouped_rows(df).collect()) for df in made]
    assert got[0] == got[1] == [(1, "row A"), (2, "row B"), (3, "Other / row C")]


def test_a_part_gives_on_only_what_may_be_among_the_best_of_all(spark):
    """A part's best that lie below what the k-th best of all has go no further; equal and negative weights, and several blocks, lose nothing."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    a = pd.DataFrame([(c, t, v) for c in range(200) for t, v in enumerate(rng.random(4)) if v > 0.3], columns=["chunk_id", "t", "v"])
    b = pd.DataFrame([(q, t, w) for q in range(40) for t, w in enumerate(rng.choice([-1.0, 0.5, 1.0, 2.0], 5)) if t % 4 <= q % 4], columns=["asked", "t", "w"])
    pairs = b.merge(a, on="t").assign(s=lambda x: x["w"] * x["v"]).groupby(["asked", "chunk_id"])["s"].sum().round(6).reset_index()
    kth = pairs[pairs["s"] > 0].sort_values("s", ascending=False).groupby("asked")["s"].apply(lambda s: s.iloc[min(2, len(s) - 1)])
    best = {q: [(-s, c) for s, c in sorted(zip(-x["s"], x["chunk_id"], strict=True))[:3] if s < 0] for q, x in pairs.groupby("asked")}
    for low in (0.0, 1.0):
        of = b.assign(low=b["asked"].map(kth).fillna(0.0) * low)
        got = retrieval._sums(3)(a, [of[of["asked"] % 2 == i] for i in (0, 1)])
        assert {q: list(zip(x["score"], x["chunk_id"], strict=True)) for q, x in got.groupby("query_id")} == {q: x for q, x in best.items() if x}
    one = b[(b["asked"] == 3) & (b["t"] == 3)].assign(w=1.0, low=a[a["t"] == 3]["v"].max())
    assert len(retrieval._sums(3)(a, [one])) == 1


@pytest.mark.parametrize("apart", [False, True])
def test_few_queries_go_to_the_vectors(spark, apart):
    """Where a task's best are fewer than its vectors no vector is moved; several blocks of queries move each once."""
    kind = "chunk_id long, v array<double>" + ", index_id int" * apart
    rows = spark.createDataFrame([(i, [float((i * 7) % 11), float(i % 3), 1.0], *[i % 2] * apart) for i in range(600)], kind).repartition(3)
    asked = rows.filter("chunk_id in (4, 9)").withColumnRenamed("chunk_id", "query_id")
    found = retrieval.dense_top(rows.localCheckpoint(), asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and plan.count("Exchange") == 1
    v = {r.chunk_id: r.v for r in rows.collect()}
    got = {q: [(r.chunk_id, r.score) for r in found.filter(F.col("query_id") == q).orderBy("rank").collect()] for q in (4, 9)}
    for q in (4, 9):
        best = sorted((-sum(a * b for a, b in zip(v[q], w, strict=True)), i) for i, w in v.items() if not apart or i % 2 == q % 2)[:5]
        assert got[q] == [(i, -s) for s, i in best]


def test_cells_are_worked_out_once(spark):
    """A table's columns come of the same rows as its cells: lines are split into words twice (for heights and words), not four times."""
    for name in ("aligned_cells", "spanned_headers"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 2, plan


def test_search_without_a_join_of_terms(spark, monkeypatch):
    """Where most terms are asked for, all postings go by numbers, and once, however many blocks of questions there are; the hits are the same."""
    texts = [(i % 2, i, f"a{i % 3} b{i % 2} c" + " d" * (i % 4) + f" e{i}") for i in range(40)]
    chunks = spark.createDataFrame(texts, "index_id int, chunk_id long, text string")
    asked = chunks.filter("chunk_id % 4 < 2").selectExpr("chunk_id as query_id", "index_id", "text")
    found = lambda: sorted(tuple(r) for r in retrieval.lexical_top(chunks, asked, 3).collect())
    want = found()
    monkeypatch.setattr(retrieval, "SENT", 400)
    monkeypatch.setattr(retrieval, "POSTINGS", 50)
    plan = retrieval.lexical_top(chunks, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert found() == want and len(want) == 60 and "sequence" not in plan and plan.count("xxhash64") >= 2
