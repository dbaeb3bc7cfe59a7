"""Table functions that ask for their partitions, and words of CJK text against all paths."""

from itertools import product

import numpy as np
import pytest

from leafmill.functions import tools
from leafmill.operators import segmentation


def test_cell_tool(spark):
    tools.register(spark)
    rows = [(1, "T", None, 0, "r", "a", "1", True), (1, "T", None, 1, "s", "a", "2", True), (1, "U", None, 0, "r", "a", "9", False), (1, "T", 7, None, "s", "a", None, None), (1, "T", 8, None, "s", "z", None, None), (1, "T", 9, None, None, "a", None, None), (1, "U", 10, None, "r", "a", None, None), (2, "T", 11, None, "r", "a", None, None)]
    spark.createDataFrame(rows, "doc_id long, table_id string, ask_id long, row_idx int, row_label string, col_name string, val string, sound boolean").repartition(4).createOrReplaceTempView("some_cells")
    got = {r.ask_id: tuple(r)[1:] for r in spark.sql("SELECT * FROM table_cells(TABLE(some_cells))").collect()}
    assert got == {7: ("value", "2", True, None), 8: ("value", None, False, None), 9: ("coordinates", None, None, "r,s"), 10: ("not_data", None, None, None), 11: ("no_table", None, None, None)}
    with pytest.raises(Exception, match="lacking"):
        spark.sql("SELECT * FROM table_cells(TABLE(SELECT 1L AS doc_id))").collect()


def test_cheapest_path():
    """Against all ways to cut a run, with ties and characters without a word of their own."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        edges = {(i, k): int(rng.integers(1, 4)) for i in range(1, n + 1) for k in range(1, min(i, 4) + 1) if k == 1 or rng.random() < 0.5}
        ways = [w for r in range(1, n + 1) for w in product(range(1, 5), repeat=r) if sum(w) == n and all((sum(w[: j + 1]), k) in edges for j, k in enumerate(w))]
        price = lambda w: sum(edges[(sum(w[: j + 1]), k)] for j, k in enumerate(w))  # noqa: B023, E731
        got = segmentation.cheapest(n, [(i, k, c) for (i, k), c in edges.items()])
        assert price(tuple(got)) == min(map(price, ways))
    assert segmentation.cheapest(3, [(2, 1, 5)]) == [1, 1, 1]


def test_segmented(spark):
    """Strings that come again are words, and a run is never one word because it is long."""
    texts = ["消融實驗顯示 LightRAG 的 dual-level retrieval 有效", "實驗有效", "消融有效", "顯示消融", "顯示有效", None, "", "plain Latin"]
    got = {r.k: r.terms for r in segmentation.segmented(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()}
    assert got[0] == ["lightrag", "dual-level", "retrieval", "消融", "實驗", "顯示", "的", "有效"]
    assert got[1] == ["實驗", "有效"] and got[5] == [] and got[6] == [] and got[7] == ["plain", "latin"]
