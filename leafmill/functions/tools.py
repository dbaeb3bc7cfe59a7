"""Deterministic tools as table functions of SQL, which get a table by partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: Columns of the rows that the tool gets: cells of tables (ask_id null), and what is asked of a table.
NEEDED = ("doc_id", "table_id", "ask_id", "row_idx", "row_label", "col_name", "val", "sound")


class CellTool:
    """The answer to each question of a table: no_table, not_data, coordinates (with the rows' labels), or value.

    A call says nothing of partitions: the function asks for one table of a document at a time itself, its cells before the questions, so that only one table's cells are held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        names = rows.dataType.fieldNames() if rows.isTable else []
        if lacking := [c for c in NEEDED if c not in names]:
            raise ValueError(f"the cell tool takes a table with {', '.join(NEEDED)}; {', '.join(lacking)} lacking")
        out = StructType().add("ask_id", LongType()).add("answer", StringType()).add("value", StringType()).add("found", BooleanType()).add("rows_", StringType())
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("table_id")], orderBy=[OrderingColumn("ask_id", True, True), OrderingColumn("row_idx")])

    def __init__(self) -> None:
        self.cells: dict[tuple[str, str], str] = {}
        self.labels: dict[int, str] = {}
        self.sound = True

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["ask_id"] is None:
            self.cells.setdefault((row["row_label"], row["col_name"]), row["val"])
            self.labels.setdefault(row["row_idx"], row["row_label"])
            self.sound = bool(row["sound"])
        elif not self.labels:
            yield row["ask_id"], "no_table", None, None, None
        elif not self.sound:
            yield row["ask_id"], "not_data", None, None, None
        elif row["row_label"] is None or row["col_name"] is None:
            yield row["ask_id"], "coordinates", None, None, ",".join(self.labels.values())
        else:
            value = self.cells.get((row["row_label"], row["col_name"]))
            yield row["ask_id"], "value", value, value is not None, None


def register(spark: SparkSession) -> None:
    """Makes the tools known to SQL: table_cells(TABLE(..))."""
    spark.udtf.register("table_cells", udtf(CellTool))
