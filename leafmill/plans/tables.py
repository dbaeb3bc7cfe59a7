"""Queries over reconstructed tables: cells made of lineitem, layout made of lineitem and of documents' words."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import tools
from leafmill.functions.text import repaired_caps, squeezed
from leafmill.operators import cells, layout, packing
from leafmill.operators import sections as sec
from leafmill.plans.base import Catalog
from leafmill.sources import store
from leafmill.sources.shared import shared_folder, spread
from leafmill.sources.tables import load

CATALOG = Catalog()

# Tables of percents by year: in T_<flag> the two line states against each other (each row begins with F), in S each line number against a common base.
CELL_SQL = """li AS (SELECT year(l_shipdate) AS doc_id, l_returnflag AS flag, l_linenumber AS line, l_linestatus AS state, quarter(l_shipdate) AS q FROM lineitem),
    tc AS (SELECT doc_id, flag, line, q, count(*) AS n, count(*) FILTER (state = 'F') AS f FROM li GROUP BY ALL),
    tcells AS (SELECT doc_id, 'T_' || flag AS table_id, line AS row_idx, 'F / M' || line AS row_label, q * 2 + s AS col_idx, 'Q' || q || ' / ' || CASE s WHEN 0 THEN 'F' ELSE 'O' END AS col_name, (CASE s WHEN 0 THEN (1000 * f // n) / 10.0::DOUBLE ELSE (1000 - 1000 * f // n) / 10.0::DOUBLE END)::VARCHAR || '%' AS val FROM tc, unnest([0, 1]) AS u(s)),
    sc AS (SELECT doc_id, line, state, q, count(*) AS n, count(*) FILTER (flag = 'R') AS r FROM li GROUP BY ALL),
    scells AS (SELECT doc_id, 'S' AS table_id, line * 2 + CASE state WHEN 'F' THEN 0 ELSE 1 END AS row_idx, 'L' || line || ' / ' || state AS row_label, q * 2 + s AS col_idx, 'Q' || q || ' / ' || CASE s WHEN 0 THEN 'L' || line ELSE 'base' END AS col_name, (CASE s WHEN 0 THEN (1000 * r // n) / 10.0::DOUBLE ELSE (1000 - 1000 * r // n) / 10.0::DOUBLE END)::VARCHAR || '%' AS val FROM sc, unnest([0, 1]) AS u(s)),
    cells AS (SELECT * FROM tcells UNION ALL SELECT * FROM scells)"""
PARTS_SQL = r"""p AS (SELECT *, trim(split_part(col_name, ' / ', 1)) AS grp, trim(split_part(col_name, ' / ', 2)) AS who, replace(val, '%', '')::DOUBLE AS pc, split_part(row_label, ' / ', 1) AS opponent, split_part(row_label, ' / ', 2) AS metric FROM cells)"""


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("doc_id"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("state"), F.quarter("l_shipdate").alias("q"))
    share = lambda part: F.expr(f"1000 * {part} div n")
    shown = lambda s, part: F.concat((F.when(s == 0, share(part)).otherwise(1000 - share(part)) / F.lit(10.0)).cast("string"), F.lit("%"))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("s")
    q, line, s = F.col("q"), F.col("line"), F.col("s")
    t = li.groupBy("doc_id", "flag", "line", "q").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "F").alias("f")).select("*", sides)
    t = t.select("doc_id", F.concat(F.lit("T_"), "flag").alias("table_id"), line.alias("row_idx"), F.concat(F.lit("F / M"), line).alias("row_label"), (q * 2 + s).alias("col_idx"), F.concat(F.lit("Q"), q, F.lit(" / "), F.when(s == 0, "F").otherwise("O")).alias("col_name"), shown(s, "f").alias("val"))
    b = li.groupBy("doc_id", "line", "state", "q").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "R").alias("r")).select("*", sides)
    b = b.select("doc_id", F.lit("S").alias("table_id"), (line * 2 + F.when(F.col("state") == "F", 0).otherwise(1)).alias("row_idx"), F.concat(F.lit("L"), line, F.lit(" / "), "state").alias("row_label"), (q * 2 + s).alias("col_idx"), F.concat(F.lit("Q"), q, F.lit(" / "), F.when(s == 0, F.concat(F.lit("L"), line)).otherwise("base")).alias("col_name"), shown(s, "r").alias("val"))
    return t.unionByName(b)


def tables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir).select("doc_id", "table_id").distinct().select("*", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Table "), "table_id")).alias("caption"), (F.col("doc_id") % 10).alias("page"), (F.col("table_id") != "T_N").alias("validated"), F.when(F.col("table_id") == "T_A", "prose").otherwise("data").alias("kind"))


@CATALOG.add("F13, F16", f"WITH {CELL_SQL} SELECT doc_id, table_id, row_idx::INTEGER AS row_idx, '[' || CASE WHEN doc_id % 2 = 0 THEN 'Table ' || table_id ELSE table_id END || ' · p.' || (doc_id % 10) || '] ' || row_label || ': ' || string_agg(col_name || ' = ' || val, '; ' ORDER BY col_idx) AS text FROM cells GROUP BY doc_id, table_id, row_idx, row_label")
def linearize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.sentences(cells_of(spark, sf_dir), tables_of(spark, sf_dir).select("doc_id", "table_id", "caption", "page"))


@CATALOG.add("F14", f"""WITH {CELL_SQL}, r AS (SELECT doc_id, table_id, row_idx, '| ' || row_label || ' | ' || string_agg(val, ' | ' ORDER BY col_idx) || ' |' AS line, list(col_name ORDER BY col_idx) AS c FROM cells GROUP BY doc_id, table_id, row_idx, row_label)
    SELECT doc_id, table_id, md5('|  | ' || array_to_string(arg_min(c, row_idx), ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', len(arg_min(c, row_idx)) + 1) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx)) AS digest FROM r GROUP BY ALL""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.markdown(cells_of(spark, sf_dir)).select("doc_id", "table_id", F.md5("markdown").alias("digest"))


ASK_SQL = "asked AS (SELECT c_custkey AS ask_id, 1992 + c_custkey % 8 AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'T_A' WHEN 2 THEN 'T_R' WHEN 3 THEN 'T_N' ELSE 'X' END AS table_id, CASE WHEN c_custkey % 5 = 0 THEN 'L' || (c_custkey % 8) || ' / F' WHEN c_custkey % 7 > 0 THEN 'F / M' || (c_custkey % 9) END AS row_label, 'Q' || (c_custkey % 4 + 1) || CASE WHEN c_custkey % 5 = 0 THEN ' / base' ELSE ' / F' END AS col_name FROM customer)"


@CATALOG.add("J16, S25", f"""WITH {CELL_SQL}, {ASK_SQL}, found AS (SELECT ask_id, CASE WHEN t.doc_id IS NULL THEN 'no_table' WHEN a.table_id IN ('T_N', 'T_A') THEN 'not_data' WHEN a.row_label IS NULL THEN 'coordinates' ELSE 'value' END AS answer, c.val FROM asked a LEFT JOIN (SELECT DISTINCT doc_id, table_id FROM cells) t USING (doc_id, table_id) LEFT JOIN cells c ON c.doc_id = a.doc_id AND c.table_id = a.table_id AND c.row_label = a.row_label AND c.col_name = a.col_name)
    , ids AS (SELECT doc_id, string_agg(DISTINCT table_id, ',' ORDER BY table_id) AS ids FROM cells GROUP BY doc_id), names AS (SELECT doc_id, table_id, string_agg(DISTINCT col_name, ',' ORDER BY col_name) AS columns_ FROM cells GROUP BY ALL), labels AS (SELECT doc_id, table_id, string_agg(row_label, ',' ORDER BY row_idx) AS rows_ FROM (SELECT DISTINCT doc_id, table_id, row_idx, row_label FROM cells) GROUP BY ALL),
    lines_ AS (SELECT doc_id, table_id, row_idx, '| ' || row_label || ' | ' || string_agg(val, ' | ' ORDER BY col_idx) || ' |' AS line, list(col_name ORDER BY col_idx) AS c FROM cells GROUP BY doc_id, table_id, row_idx, row_label), md AS (SELECT doc_id, table_id, md5('|  | ' || array_to_string(arg_min(c, row_idx), ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', len(arg_min(c, row_idx)) + 1) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx)) AS md FROM lines_ GROUP BY ALL)
    SELECT f.ask_id, answer, CASE WHEN answer = 'value' THEN val END AS value, CASE WHEN answer = 'value' THEN val IS NOT NULL END AS found, CASE WHEN answer = 'no_table' THEN ids END AS available, CASE WHEN answer = 'coordinates' THEN rows_ END AS rows_, CASE WHEN answer = 'coordinates' THEN columns_ END AS columns_, CASE WHEN answer = 'not_data' THEN md END AS markdown
    FROM found f JOIN asked a USING (ask_id) LEFT JOIN ids USING (doc_id) LEFT JOIN names n ON n.doc_id = a.doc_id AND n.table_id = a.table_id LEFT JOIN labels l ON l.doc_id = a.doc_id AND l.table_id = a.table_id LEFT JOIN md m ON m.doc_id = a.doc_id AND m.table_id = a.table_id""")
def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cells.looked_up(asked_of(spark, sf_dir), tables_of(spark, sf_dir), cells_of(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(f"{c}_" if c != "available" else c) for c in ("available", "rows", "columns")]
    return out.select("ask_id", "answer", "value", "found", *joined, F.md5("markdown").alias("markdown"))


def asked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    table = F.when(k % 5 == 0, "S").when(k % 5 == 1, "T_A").when(k % 5 == 2, "T_R").when(k % 5 == 3, "T_N").otherwise("X")
    row = F.when(k % 5 == 0, F.concat(F.lit("L"), k % 8, F.lit(" / F"))).when(k % 7 > 0, F.concat(F.lit("F / M"), k % 9))
    return load(spark, sf_dir, "customer").select(k.alias("ask_id"), (1992 + k % 8).alias("doc_id"), table.alias("table_id"), row.alias("row_label"), F.concat(F.lit("Q"), k % 4 + 1, F.when(k % 5 == 0, " / base").otherwise(" / F")).alias("col_name"))


@CATALOG.add("X7", f"""WITH {CELL_SQL}, {ASK_SQL} SELECT ask_id, c.val AS value, c.val IS NOT NULL AS found FROM asked a LEFT JOIN cells c ON c.doc_id = a.doc_id AND c.table_id = a.table_id AND c.row_label = a.row_label AND c.col_name = a.col_name""")
def cell_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-up of a cell as a table function of SQL, joined laterally with what is asked."""
    cells_of(spark, sf_dir).createOrReplaceTempView("tool_cells")
    asked_of(spark, sf_dir).createOrReplaceTempView("tool_asks")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION table_cell(doc BIGINT, tab STRING, line STRING, col STRING) RETURNS TABLE (value STRING, found BOOLEAN)
        RETURN SELECT min_by(val, row_idx), count(*) > 0 FROM tool_cells WHERE doc_id = doc AND table_id = tab AND row_label = line AND col_name = col""")
    return spark.sql("SELECT a.ask_id, t.value, t.found FROM tool_asks a, LATERAL table_cell(a.doc_id, a.table_id, a.row_label, a.col_name) t")


@CATALOG.add("X7, S25", f"""WITH {CELL_SQL}, {ASK_SQL}, found AS (SELECT ask_id, a.doc_id, a.table_id, CASE WHEN t.doc_id IS NULL THEN 'no_table' WHEN a.table_id IN ('T_N', 'T_A') THEN 'not_data' WHEN a.row_label IS NULL THEN 'coordinates' ELSE 'value' END AS answer, c.val FROM asked a LEFT JOIN (SELECT DISTINCT doc_id, table_id FROM cells) t USING (doc_id, table_id) LEFT JOIN cells c ON c.doc_id = a.doc_id AND c.table_id = a.table_id AND c.row_label = a.row_label AND c.col_name = a.col_name),
    labels AS (SELECT doc_id, table_id, string_agg(row_label, ',' ORDER BY row_idx) AS rows_ FROM (SELECT DISTINCT doc_id, table_id, row_idx, row_label FROM cells) GROUP BY ALL)
    SELECT ask_id, answer, CASE WHEN answer = 'value' THEN val END AS value, CASE WHEN answer = 'value' THEN val IS NOT NULL END AS found, CASE WHEN answer = 'coordinates' THEN rows_ END AS rows_ FROM found LEFT JOIN labels USING (doc_id, table_id)""")
def cell_tool_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-up of a cell as a table function that takes cells and questions by table, and asks for that order itself."""
    tools.register(spark)
    known = cells_of(spark, sf_dir).join(tables_of(spark, sf_dir).select("doc_id", "table_id", (F.col("validated") & (F.col("kind") == "data")).alias("sound")), ["doc_id", "table_id"])
    rows = known.select("doc_id", "table_id", F.lit(None).cast("long").alias("ask_id"), F.col("row_idx").cast("int").alias("row_idx"), "row_label", "col_name", "val", "sound")
    asked = asked_of(spark, sf_dir).select("doc_id", "table_id", "ask_id", F.lit(None).cast("int").alias("row_idx"), "row_label", "col_name", F.lit(None).cast("string").alias("val"), F.lit(None).cast("boolean").alias("sound"))
    rows.unionByName(asked).createOrReplaceTempView("tool_rows")
    return spark.sql("SELECT * FROM table_cells(TABLE(tool_rows))")


@CATALOG.add("R3", f"WITH {CELL_SQL} SELECT doc_id, table_id, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_columns FROM cells GROUP BY ALL")
def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of each document with their rows and columns."""
    return cells_of(spark, sf_dir).groupBy("doc_id", "table_id").agg(F.count_distinct("row_idx").alias("n_rows"), F.count_distinct("col_idx").alias("n_columns"))


@CATALOG.add("S12, S13", f"WITH {CELL_SQL} SELECT doc_id, count(*) AS n, md5(string_agg(table_id || row_label || col_name || val, ',' ORDER BY table_id, row_idx, col_idx)) AS digest FROM cells WHERE doc_id IN (1995, 1996) GROUP BY doc_id UNION ALL SELECT -1, 0, NULL")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index saved with one document replaced, and two of its documents read back from their directories; a part that was never written is empty (-1)."""
    folder, found = f"{shared_folder(spark)}/{uuid4().hex}", cells_of(spark, sf_dir)
    store.save({"cells": found.withColumn("val", F.when(F.col("doc_id") == 1995, "old").otherwise(F.col("val")))}, folder)
    store.save({"cells": found.filter("doc_id = 1995")}, folder)
    back = store.read(spark, folder, "cells", found.schema, [1995, 1996])
    listed = F.array_sort(F.collect_list(F.struct("table_id", "row_idx", "col_idx", F.concat("table_id", "row_label", "col_name", "val").alias("t"))))
    digest = F.md5(F.array_join(F.transform(listed, lambda x: x["t"]), ","))
    never = store.read(spark, folder, "sections", "doc_id long").agg(F.lit(-1).cast("long").alias("doc_id"), F.count("*").alias("n"), F.lit(None).cast("string").alias("digest"))
    return back.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), digest.alias("digest")).unionByName(never)


@CATALOG.add("A7, U2", rf"""WITH {CELL_SQL}, a AS (SELECT doc_id, table_id, x, count(*) AS n FROM (SELECT doc_id, table_id, unnest(regexp_extract_all(row_label || ' ' || val, '\d+(?:[.,]\d+)?')) AS x FROM cells WHERE NOT (table_id = 'T_A' AND row_idx = 3)) GROUP BY ALL),
    b AS (SELECT doc_id, table_id, x, count(*) AS n FROM (SELECT doc_id, table_id, unnest(regexp_extract_all(row_label || ' ' || val, '\d+(?:[.,]\d+)?')) AS x FROM cells WHERE NOT (table_id = 'T_N' AND row_idx = 5)) GROUP BY ALL)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.table_id, b.table_id) AS table_id, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::BIGINT AS missing, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::BIGINT AS extra FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.table_id = b.table_id AND a.x = b.x GROUP BY 1, 2""")
def numeric_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = cells_of(spark, sf_dir).select("doc_id", "table_id", "row_idx", F.concat_ws(" ", "row_label", "val").alias("text"))
    return cells.conserved(text.filter("not (table_id = 'T_A' and row_idx = 3)"), text.filter("not (table_id = 'T_N' and row_idx = 5)"))


@CATALOG.add("A8", f"""WITH {CELL_SQL}, c AS (SELECT doc_id, table_id, CASE WHEN table_id = 'T_A' THEN left(row_label, 5) ELSE row_label END || CASE WHEN doc_id % 2 = 0 AND table_id = 'T_R' THEN 'x' ELSE '' END AS r, CASE WHEN doc_id = 1995 THEN left(col_name, 2) ELSE col_name END AS k FROM cells)
    SELECT doc_id, table_id, count(*) AS n_values, count(DISTINCT (r, k)) AS n_keys, count(*) = count(DISTINCT (r, k)) AS "unique" FROM c GROUP BY ALL""")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells_of(spark, sf_dir).withColumn("row_label", F.when(F.col("table_id") == "T_A", F.left("row_label", F.lit(5))).otherwise(F.col("row_label")))
    return cells.unique_keys(c.withColumn("col_name", F.when(F.col("doc_id") == 1995, F.left("col_name", F.lit(2))).otherwise(F.col("col_name"))))


@CATALOG.add("A9", rf"""WITH c AS (SELECT o_custkey % 50 AS doc_id, 'T' || (o_orderkey % 3) AS table_id, CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority ELSE o_totalprice::BIGINT::VARCHAR END || CASE WHEN o_custkey % 7 = 0 THEN repeat('long ', 14) ELSE '' END AS val FROM orders), k AS (SELECT doc_id, table_id, round(avg(CASE WHEN regexp_matches(val, '\d+(?:[.,]\d+)?') THEN 1.0::DOUBLE ELSE 0 END), 6) AS numeric_share, round(avg(len(val)), 6) AS mean_length FROM c GROUP BY ALL)
    SELECT *, CASE WHEN numeric_share < 0.3 OR mean_length > 60 THEN 'prose' ELSE 'data' END AS kind FROM k""")
def prose_vs_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    val = F.concat(F.when(c % 5 == 0, F.col("o_orderpriority")).otherwise(F.round("o_totalprice").cast("long").cast("string")), F.when(c % 7 == 0, "long " * 14).otherwise(""))
    return cells.kinds(load(spark, sf_dir, "orders").select((c % 50).alias("doc_id"), F.concat(F.lit("T"), F.col("o_orderkey") % 3).alias("table_id"), val.alias("val")))


@CATALOG.add("A10", f"""WITH {CELL_SQL}, {PARTS_SQL}, g AS (SELECT doc_id, table_id, row_idx, grp, count(*) AS n, sum(pc) AS s FROM p WHERE NOT (table_id = 'T_R' AND doc_id % 3 = 0 AND col_idx = 2) GROUP BY ALL) SELECT doc_id, table_id, bool_and(n = 2 AND abs(s - 100) < 0.6) AS pairwise FROM g GROUP BY ALL""")
def pairwise_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.pairwise(cells_of(spark, sf_dir).filter("not (table_id = 'T_R' and doc_id % 3 = 0 and col_idx = 2)"))


@CATALOG.add("A11", f"""WITH {CELL_SQL}, {PARTS_SQL}, g AS (SELECT doc_id, table_id, row_idx, opponent, grp, count(*) AS n, count(*) FILTER (who <> opponent) AS others, max(who) FILTER (who <> opponent) AS subject, max(pc) FILTER (who <> opponent) AS mine, max(pc) FILTER (who = opponent) AS theirs FROM p GROUP BY ALL)
    SELECT doc_id, table_id, row_idx::INTEGER AS row_idx, opponent, max_by(subject, grp) AS subject, count(*) AS total, count(*) FILTER (mine > theirs) AS wins, count(*) FILTER (mine = theirs) AS ties, coalesce(string_agg(grp, ', ' ORDER BY grp) FILTER (mine <= theirs), '') AS losses FROM g GROUP BY doc_id, table_id, row_idx, opponent HAVING bool_and(n = 2 AND others = 1) AND count(*) >= 2""")
def pairwise_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.tallies(cells_of(spark, sf_dir))


REF_SQL = f"""{CELL_SQL}, {PARTS_SQL}, names AS (SELECT doc_id, table_id, who, count(DISTINCT row_idx) AS n FROM p GROUP BY ALL), rows_ AS (SELECT doc_id, table_id, count(DISTINCT row_idx) AS rows FROM p GROUP BY ALL), per AS (SELECT doc_id, table_id, min(k) = 2 AND max(k) = 2 AS two FROM (SELECT doc_id, table_id, row_idx, count(DISTINCT who) AS k FROM p GROUP BY ALL) GROUP BY ALL),
    refs AS (SELECT doc_id, table_id, max(who) FILTER (n = rows) AS ref FROM names JOIN rows_ USING (doc_id, table_id) JOIN per USING (doc_id, table_id) WHERE two GROUP BY ALL HAVING count(*) FILTER (n = rows) = 1 AND count(*) FILTER (n < rows) >= 2)"""


@CATALOG.add("A12, U3", f"WITH {REF_SQL} SELECT * FROM refs")
def shared_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.shared_reference(cells_of(spark, sf_dir))


@CATALOG.add("A13, A14", f"""WITH {REF_SQL}, m AS (SELECT doc_id, table_id, metric, grp, who, pc, max(pc) OVER w AS top, count(*) OVER w AS subjects FROM p JOIN refs USING (doc_id, table_id) WHERE who <> ref WINDOW w AS (PARTITION BY doc_id, table_id, metric, grp)),
    l AS (SELECT *, count(*) FILTER (pc = top) OVER (PARTITION BY doc_id, table_id, metric, grp) AS lead_n FROM m), n AS (SELECT doc_id, table_id FROM l GROUP BY ALL HAVING count(DISTINCT who) >= 2 AND min(subjects) = count(DISTINCT who)),
    s AS (SELECT doc_id, table_id, who AS focus, count(*) AS cells, count(*) FILTER (pc = top AND lead_n = 1) AS sole, count(*) FILTER (pc < top) AS behind, count(*) FILTER (pc = top AND lead_n > 1) AS tied, count(*) FILTER (pc > 50) AS above FROM l GROUP BY ALL)
    SELECT s.* FROM s JOIN n USING (doc_id, table_id) QUALIFY row_number() OVER (PARTITION BY doc_id, table_id ORDER BY sole DESC, focus) = 1""")
def cross_subject_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells_of(spark, sf_dir)
    return cells.leaders(c, cells.shared_reference(c))


@CATALOG.add("F17", f"WITH {REF_SQL} SELECT doc_id, table_id, row_idx::INTEGER AS row_idx, row_label, col_idx::INTEGER AS col_idx, grp AS col_name, val FROM p JOIN refs USING (doc_id, table_id) WHERE who <> ref")
def strip_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells_of(spark, sf_dir)
    return cells.without_reference(c, cells.shared_reference(c))


@CATALOG.add("J11, T9", f"""WITH {CELL_SQL}, q AS (SELECT c_custkey AS query_id, 1992 + c_custkey % 7 AS doc_id, 'how does ' || CASE c_custkey % 3 WHEN 0 THEN 'base' ELSE 'M' || (c_custkey % 3) END || ' do on BASE in metric l' || (c_custkey % 9) || ' and F / ?' AS question FROM customer),
    labels AS (SELECT DISTINCT doc_id, table_id, label FROM (SELECT doc_id, table_id, unnest(list_transform(list_concat(string_split(row_label, '/'), string_split(col_name, '/')), lambda x: trim(x))) AS label FROM (SELECT doc_id, table_id, CASE WHEN table_id = 'S' THEN 'Metric ' || row_label ELSE 'do on / ' || row_label END AS row_label, col_name FROM cells)) WHERE len(label) > 2),
    hit AS (SELECT query_id, table_id, label FROM q JOIN labels USING (doc_id) WHERE contains(lower(question), lower(label)))
    SELECT query_id, table_id, count(*) AS n, string_agg(label, ',' ORDER BY -len(label), label) AS labels FROM hit GROUP BY query_id, table_id HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, table_id) = 1""")
def table_label_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    question = F.concat(F.lit("how does "), F.when(k % 3 == 0, "base").otherwise(F.concat(F.lit("M"), k % 3)), F.lit(" do on BASE in metric l"), k % 9, F.lit(" and F / ?"))
    q = load(spark, sf_dir, "customer").select(k.alias("query_id"), (1992 + k % 7).alias("doc_id"), question.alias("question"))
    label = F.when(F.col("table_id") == "S", F.concat(F.lit("Metric "), "row_label")).otherwise(F.concat(F.lit("do on / "), "row_label"))
    return cells.label_hits(q, cells_of(spark, sf_dir).withColumn("row_label", label)).select("query_id", "table_id", F.size("labels").cast("long").alias("n"), F.array_join("labels", ",").alias("labels"))


@CATALOG.add("P12, P13, J23", """WITH r AS (SELECT l_orderkey % 500 AS query_id, l_returnflag AS table_id, l_orderkey * 10 + l_linenumber AS chunk_id, CASE WHEN l_linenumber % 2 = 0 THEN 'table_row' ELSE 'text' END AS kind, 'Alpha' || l_linenumber || CASE WHEN l_partkey % 2 = 0 THEN ' / Beta' ELSE ' / Gamma' END AS label FROM lineitem),
    named AS (SELECT * FROM r WHERE kind <> 'table_row' OR contains(lower(label), 'alpha') AND contains(lower(label), 'beta')), hit AS (SELECT *, contains(lower(label), 'alpha3') OR contains(lower(label), 'gamma') AS h FROM named)
    SELECT query_id, table_id, chunk_id FROM hit QUALIFY h OR sum(h::INTEGER) OVER (PARTITION BY query_id, table_id) = 0""")
def compared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the rows that name both things compared, then, in each table, those whose label names one of another pair."""
    n = F.col("l_linenumber")
    label = F.concat(F.lit("Alpha"), n, F.when(F.col("l_partkey") % 2 == 0, " / Beta").otherwise(" / Gamma"))
    r = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("query_id"), F.col("l_returnflag").alias("table_id"), (F.col("l_orderkey") * 10 + n).alias("chunk_id"), F.when(n % 2 == 0, "table_row").otherwise("text").alias("kind"), label.alias("text"), label.alias("row_label"), F.array(F.lit("Alpha"), F.lit("Beta")).alias("names"), F.array(F.lit("Alpha3"), F.lit("Gamma")).alias("other"))
    return packing.focused_rows(packing.named_rows(r, "names"), "other").select("query_id", "table_id", "chunk_id")


@CATALOG.add("W8", "SELECT l_orderkey, l_linenumber, label || CASE WHEN n > 1 THEN ' #' || n ELSE '' END AS label FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)")
def duplicate_label_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("label"))
    return cells.numbered(rows, "label", ["l_orderkey"], ["l_linenumber", "l_partkey"]).drop("l_partkey")


@CATALOG.add("F15, U4", """WITH h AS (SELECT o_custkey AS doc_id, o_orderkey % 4 AS col_idx, o_orderkey AS level, CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderpriority END AS text FROM orders), g AS (SELECT doc_id, col_idx, list(text ORDER BY level, text) AS t FROM h GROUP BY ALL),
    d AS (SELECT doc_id, col_idx, coalesce(nullif(array_to_string(list_filter(t, lambda x, i: x <> '' AND list_position(t, x) = i), ' / '), ''), 'col' || col_idx) AS name FROM g)
    SELECT doc_id, col_idx, name || CASE WHEN n > 1 THEN ' #' || n ELSE '' END AS col_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY col_idx) AS n FROM d)""")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    levels = o.select(F.col("o_custkey").alias("doc_id"), F.lit("T").alias("table_id"), (F.col("o_orderkey") % 4).alias("col_idx"), F.col("o_orderkey").alias("level"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("text"))
    return cells.column_names(levels).drop("table_id")


@CATALOG.add("W7", """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey * 2 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS row_idx, l_linenumber AS n, 'row ' || l_returnflag AS label, CASE WHEN l_linenumber % 3 = 1 AND l_linenumber > 1 THEN ['base', 'Sub' || l_linestatus] ELSE [l_quantity::BIGINT::VARCHAR] END AS rest FROM lineitem),
    m AS (SELECT *, n % 3 = 1 AND n > 1 AS sub FROM r), k AS (SELECT *, coalesce(last_value(CASE WHEN sub THEN rest END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ['base', 'Head']) AS known FROM m),
    g AS (SELECT *, last_value(CASE WHEN sub THEN CASE WHEN list_contains(known, rest[2]) THEN '' ELSE rest[2] END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM k),
    l AS (SELECT doc_id, row_idx, CASE WHEN coalesce(grp, '') <> '' THEN grp || ' / ' || label ELSE label END AS label FROM g WHERE NOT sub)
    SELECT doc_id, row_idx, label || CASE WHEN n > 1 THEN ' #' || n ELSE '' END AS row_label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY row_idx) AS n FROM l)""")
def group_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rest = F.when((n % 3 == 1) & (n > 1), F.array(F.lit("base"), F.concat(F.lit("Sub"), "l_linestatus"))).otherwise(F.array(F.round("l_quantity").cast("long").cast("string")))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("T").alias("table_id"), (n * 1000000 + F.col("l_partkey") * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("row_idx"), F.concat(F.lit("row "), "l_returnflag").alias("label"), rest.alias("rest"), F.array(F.lit("base"), F.lit("Head")).alias("header"))
    return cells.grouped_rows(rows).drop("table_id")


# Rules of pages from lineitem, 200 documents of 7 pages.
RULE_SQL = """rules AS (SELECT l_orderkey % 200 AS doc_id, l_linenumber AS page, (l_suppkey % 3 * 10)::DOUBLE AS x0, (l_partkey * 37 % 7000 / 10.0)::DOUBLE AS y0, (l_suppkey % 3 * 10 + 60 + l_suppkey % 5 * 50)::DOUBLE AS x1, (l_partkey * 37 % 7000 / 10.0)::DOUBLE + CASE WHEN l_partkey % 5 = 0 THEN 60 ELSE 1 END AS y1 FROM lineitem),
    flat AS (SELECT * FROM rules WHERE y1 - y0 < 2 AND x1 - x0 > 100)"""


def rules_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    y0 = p * 37 % 7000 / 10.0
    return load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("doc_id"), F.col("l_linenumber").alias("page"), (s % 3 * 10).cast("double").alias("x0"), y0.alias("y0"), (s % 3 * 10 + 60 + s % 5 * 50).cast("double").alias("x1"), (y0 + F.when(p % 5 == 0, 60).otherwise(1)).alias("y1"))


@CATALOG.add("P3, S8, A4, A5", f"""WITH {RULE_SQL}, n AS (SELECT doc_id, count(*) FILTER (y1 - y0 < 2 AND x1 - x0 > 100) AS n_h, count(*) FILTER (x1 - x0 < 2 AND y1 - y0 > 40) AS n_v FROM rules WHERE doc_id % 9 > 0 OR page = 1 AND y0 < 40 GROUP BY 1), d AS (SELECT range AS doc_id, range % 4 > 0 AS has_text FROM range(210))
    SELECT doc_id, coalesce(n_h, 0) AS n_h, coalesce(n_v, 0) AS n_v, CASE WHEN NOT has_text THEN 'unsupported' WHEN coalesce(n_h, 0) < 3 THEN 'whitespace' WHEN coalesce(n_v, 0) >= coalesce(n_h, 0) THEN 'lattice' ELSE 'booktabs' END AS strategy FROM d LEFT JOIN n USING (doc_id)""")
def rule_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.range(210).select(F.col("id").alias("doc_id"), (F.col("id") % 4 > 0).alias("has_text"))
    return layout.table_strategies(rules_of(spark, sf_dir).filter("doc_id % 9 > 0 or page = 1 and y0 < 40"), docs)


STEADY_SQL = f"""{RULE_SQL}, running AS (SELECT doc_id, round_even(y0, 0) AS h FROM flat GROUP BY ALL HAVING count(*) >= 2), steady AS (SELECT * FROM flat f WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.doc_id = f.doc_id AND r.h = round_even(f.y0, 0)))"""


@CATALOG.add("P5", f"WITH {STEADY_SQL} SELECT doc_id, page::INTEGER AS page, x0, y0, x1, y1 FROM steady")
def running_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.steady_rules(rules_of(spark, sf_dir), spark.range(200).select(F.col("id").alias("doc_id"), F.lit(7).alias("n_pages")))


CLUSTER_SQL = f"""{RULE_SQL}, opened AS (SELECT *, coalesce(y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, x1) > 12, false) AS o FROM flat),
    clustered AS (SELECT doc_id, page, x0, y0, x1, y1, sum(o::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, x1 ROWS UNBOUNDED PRECEDING) AS cluster FROM opened)"""


@CATALOG.add("W4", f"WITH {CLUSTER_SQL} SELECT doc_id, page::INTEGER AS page, cluster::BIGINT AS cluster, count(*) AS n, min(y0) AS top, max(y0) AS bottom FROM clustered GROUP BY ALL")
def rule_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = rules_of(spark, sf_dir).filter(layout.horizontal())
    return layout.clustered(flat, 12).groupBy("doc_id", "page", "cluster").agg(F.count("*").alias("n"), F.min("y0").alias("top"), F.max("y0").alias("bottom"))


@CATALOG.add("P6", f"""WITH {CLUSTER_SQL}, e AS (SELECT *, round_even(x0 / 10, 0) AS e0, round_even(x1 / 10, 0) AS e1 FROM clustered), c AS (SELECT doc_id, page, cluster, e0, e1, count(*) AS n, min((y0, x0, x1)) AS top FROM e GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page, cluster ORDER BY n DESC, top) = 1)
    SELECT doc_id, page::INTEGER AS page, cluster::BIGINT AS cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y0) AS y1, list_sort(list(y0))[2] AS mid FROM e JOIN b USING (doc_id, page, cluster, e0, e1) GROUP BY doc_id, page, cluster HAVING count(*) >= 3""")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = rules_of(spark, sf_dir).filter(layout.horizontal())
    return layout.regions(layout.consistent(layout.clustered(flat, 12)))


# Words of documents as pages of eight columns: each line a page, twelve points a row.
WORD_SQL = """toks AS (SELECT doc_id, i AS page, list_filter(string_split(l[i], ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    words AS (SELECT doc_id, page, w[k + 1] AS word, (k % 8 * 40 + len(w[k + 1]) % 5)::DOUBLE AS x0, (k // 8 * 12 + k % 3)::DOUBLE AS y0, (k % 8 * 40 + len(w[k + 1]) % 5 + least(len(w[k + 1]) * 4, 38))::DOUBLE AS x1, (k // 8 * 12 + k % 3 + 9)::DOUBLE AS y1, k // 8 AS r FROM (SELECT *, unnest(range(len(w))) AS k FROM toks)),
    rowed AS (SELECT *, min(y0) OVER (PARTITION BY doc_id, page, r) AS "row" FROM words),
    opened AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id, page, "row" ORDER BY x0, x1, word) > 6, false) AS o FROM rowed),
    celled AS (SELECT *, sum(o::INTEGER) OVER (PARTITION BY doc_id, page, "row" ORDER BY x0, x1, word ROWS UNBOUNDED PRECEDING) AS cell FROM opened),
    cells AS (SELECT doc_id, page, "row", cell, string_agg(word, ' ' ORDER BY x0, x1, word) AS text, min(x0) AS x0, arg_max(x1, (x0, x1, word)) AS x1 FROM celled GROUP BY ALL)"""


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    # lines are dealt out by page before their words are made, so that what is done by page moves no words
    paged = spread(lines.select("doc_id", (F.col("i") + 1).cast("long").alias("page"), "line"), "doc_id", "page", text="line")
    toks = paged.select("doc_id", "page", F.posexplode(F.filter(F.split("line", " "), lambda x: x != "")).alias("k", "word"))
    k, n = F.col("k"), F.length("word")
    x0 = k % 8 * 40 + n % 5
    y0 = F.floor(k / 8) * 12 + k % 3
    return toks.select("doc_id", "page", "word", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.least(n * 4, F.lit(38))).cast("double").alias("x1"), (y0 + 9).cast("double").alias("y1"))


KEY = ["doc_id", "page"]


def word_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_cells(layout.with_rows(words_of(spark, sf_dir), KEY), [*KEY, "row"])


@CATALOG.add("W5, W6", f"WITH {WORD_SQL} SELECT doc_id, page, \"row\", cell::BIGINT AS cell, text, x0, x1 FROM cells")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_cells(spark, sf_dir)


TEMPLATE_SQL = f"""{WORD_SQL}, per AS (SELECT doc_id, page, "row", count(*) AS n FROM cells GROUP BY ALL), often AS (SELECT doc_id, page, n, count(*) AS rows, min("row") AS first FROM per GROUP BY doc_id, page, n QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min("row")) = 1),
    template AS (SELECT c.doc_id, c.page, cell AS col, x0 AS t0, x1 AS t1 FROM cells c JOIN often o ON o.doc_id = c.doc_id AND o.page = c.page AND o.first = c."row")"""


@CATALOG.add("A6, J9", f"""WITH {TEMPLATE_SQL}, pairs AS (SELECT doc_id, page, "row", cell, text, col, least(x1, t1) - greatest(x0, t0) AS o, abs((t0 + t1) / 2 - (x0 + x1) / 2) AS d FROM cells JOIN template USING (doc_id, page)),
    placed AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, page, "row", cell ORDER BY greatest(o, 0) DESC, CASE WHEN o > 0 THEN 0 ELSE d END, CASE WHEN o > 0 THEN -col ELSE col END) = 1)
    SELECT doc_id, page, "row", col::BIGINT AS col, string_agg(text, ' ' ORDER BY cell) AS text FROM placed GROUP BY ALL""")
def aligned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.aligned(layout.tabled(word_cells(spark, sf_dir), KEY, "row"), KEY, "row")


@CATALOG.add("J10", f"""WITH {TEMPLATE_SQL}, bound AS (SELECT *, coalesce((lag(x1) OVER w + x0) / 2, x0) AS lo, coalesce((x1 + lead(x0) OVER w) / 2, 1e300) AS hi FROM cells WINDOW w AS (PARTITION BY doc_id, page, "row" ORDER BY cell)),
    pairs AS (SELECT *, least(x1, t1) - greatest(x0, t0) > 0 AS covers FROM bound JOIN template USING (doc_id, page)), marked AS (SELECT *, bool_or(covers) OVER (PARTITION BY doc_id, page, "row", col) AS covered FROM pairs)
    SELECT doc_id, page, "row", col::BIGINT AS col, string_agg(text, ' ' ORDER BY cell) AS text FROM marked WHERE covers OR NOT covered AND (t0 + t1) / 2 >= lo AND (t0 + t1) / 2 < hi GROUP BY ALL""")
def spanned_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spanned(layout.tabled(word_cells(spark, sf_dir), KEY, "row"), KEY, "row")


@CATALOG.add("S9", f"""WITH {WORD_SQL} SELECT doc_id, page, word, x0, y0, n FROM (SELECT doc_id, page, word, x0, y0, count(*) AS n FROM words WHERE y0 >= 11 AND y1 <= 61 AND x0 >= 38 AND x1 <= 202 GROUP BY ALL)""")
def region_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir)
    boxes = words.select(*KEY).distinct().select("*", F.lit(0).alias("cluster"), F.lit(40.0).alias("x0"), F.lit(12.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(60.0).alias("y1"))
    return layout.words_in(words, boxes).groupBy("doc_id", "page", "word", "x0", "y0").agg(F.count("*").alias("n"))


# Lines of documents as boxes of two columns, with type sizes.
BOX_SQL = """boxes AS (SELECT doc_id, (i - 1) // 8 + 1 AS page, ((i - 1) % 2 * 310)::DOUBLE AS x0, ((i - 1) % 8 * 90)::DOUBLE AS y0, CASE WHEN doc_id % 3 = 0 THEN 600.0::DOUBLE ELSE ((i - 1) % 2 * 310 + 20 + len(l[i]) % 260)::DOUBLE END AS x1, ((i - 1) % 8 * 90 + 10 + len(l[i]) % 40)::DOUBLE AS y1, l[i] AS text, CASE WHEN len(l[i]) < 60 THEN 14.04::DOUBLE + len(l[i]) % 4 ELSE 10.0 END AS size FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def boxes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    i, n = F.col("i"), F.length("text")
    right = F.when(F.col("doc_id") % 3 == 0, F.lit(600.0)).otherwise((i % 2 * 310 + 20 + n % 260).cast("double"))
    return lines.select("doc_id", (F.floor(i / 8) + 1).alias("page"), (i % 2 * 310).cast("double").alias("x0"), (i % 8 * 90).cast("double").alias("y0"), right.alias("x1"), (i % 8 * 90 + 10 + n % 40).cast("double").alias("y1"), "text", F.when(n < 60, F.lit(14.04) + n % 4).otherwise(10.0).alias("size"))


def pages_of(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("doc_id").agg(F.max("page").alias("n_pages")).select("doc_id", "n_pages", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


@CATALOG.add("P2, A3, P22", f"""WITH {BOX_SQL}, v AS (SELECT doc_id, page, CASE WHEN count(*) FILTER (x0 < 612 * 0.46 AND x1 > 612 * 0.54) > count(*) * 0.3 THEN 1 ELSE 2 END AS vote FROM boxes WHERE page BETWEEN 2 AND 10 AND trim(text) <> '' AND x1 - x0 > 612 * 0.15 GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT doc_id, vote, count(*) AS n, min(page) AS first FROM v GROUP BY doc_id, vote QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page)) = 1)
    SELECT doc_id, page, x0, y0, (page - 1) * 10000.0::DOUBLE + CASE WHEN coalesce(vote, 1) = 2 AND x0 >= 306 THEN 793 ELSE 0 END + y0 AS ord, count(*) AS n FROM boxes LEFT JOIN m USING (doc_id) GROUP BY ALL""")
def reading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = boxes_of(spark, sf_dir)
    pages = pages_of(boxes)
    columns = layout.column_counts(boxes, pages)
    out = layout.reading_order(boxes, pages.join(columns, "doc_id").select("doc_id", "columns", "width", "height"))
    return out.groupBy("doc_id", "page", "x0", "y0", "ord").agg(F.count("*").alias("n"))


@CATALOG.add("A1, A2", f"""WITH {BOX_SQL}, n AS (SELECT doc_id, round(size, 1) AS size, sum(len(text)) AS n FROM boxes WHERE page <= 6 GROUP BY ALL), b AS (SELECT doc_id, arg_max(size, (n, size)) AS body FROM n GROUP BY 1)
    SELECT doc_id, body, coalesce(array_to_string(list_sort(list(size) FILTER (size > body * 1.08), 'DESC')[1:4], ','), '') AS headings FROM n JOIN b USING (doc_id) GROUP BY ALL""")
def font_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.font_sizes(boxes_of(spark, sf_dir)).select("doc_id", "body", F.array_join(F.transform("headings", lambda x: x.cast("string")), ",").alias("headings"))


@CATALOG.add("R1", rf"""WITH {BOX_SQL}, sizes AS (SELECT DISTINCT doc_id, size FROM boxes WHERE size > 11), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC)::INTEGER AS level FROM sizes) SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title, level, count(*) AS n FROM boxes JOIN r USING (doc_id, size) WHERE len(trim(text)) <= 90 GROUP BY ALL""")
def font_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = boxes_of(spark, sf_dir).withColumn("ord", F.lit(0))
    found = sec.font_headings(boxes, boxes.filter("size > 11").select("doc_id", "size"))
    return found.groupBy("doc_id", "title", "level").agg(F.count("*").alias("n"))


#: Single capitals joined with the capitals after them, of a text {t} whose words single spaces part.
CAPS_SQL = r"""CASE WHEN len(string_split({t}, ' ')) >= 4 AND len(list_filter(string_split({t}, ' '), lambda x: regexp_full_match(regexp_replace(regexp_replace(x, '^[-–—:]+', ''), '[-–—:]+$', ''), '\p{{L}}'))) / len(string_split({t}, ' ')) >= 0.2
    THEN list_reduce(string_split({t}, ' '), lambda a, w: CASE WHEN regexp_matches(a, '(^| )[-–—:]*\p{{Lu}}$') AND w = upper(w) AND w <> lower(w) THEN a || w ELSE a || ' ' || w END) ELSE {t} END"""


@CATALOG.add("A31, F9", rf"""WITH t AS (SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(replace(text, 'ß', 'ss'), '\s+', ' ', 'g'), ' '), lambda x: x <> '')[1:12], lambda x: CASE WHEN doc_id % 3 = 0 THEN upper(x[1]) || ' ' || upper(x[2:]) WHEN doc_id % 3 = 1 THEN x ELSE upper(x[1]) END), ' ') AS s FROM documents), q AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM t) SELECT doc_id, {CAPS_SQL.format(t="s")} AS title FROM q""")
def small_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of twelve words in the three ways that small capitals are read: parted after each first letter, whole, and first letters alone."""
    words = F.slice(F.filter(F.split(squeezed(F.replace("text", F.lit("ß"), F.lit("ss"))), " "), lambda w: w != ""), 1, 12)
    d = F.col("doc_id") % 3
    shown = F.transform(words, lambda w: F.when(d == 0, F.concat(F.upper(F.left(w, F.lit(1))), F.lit(" "), F.upper(F.substring(w, 2, 1 << 20)))).when(d == 1, w).otherwise(F.upper(F.left(w, F.lit(1)))))
    return load(spark, sf_dir, "documents").select("doc_id", repaired_caps(squeezed(F.array_join(shown, " "))).alias("title"))


@CATALOG.add("T8, P21", rf"""WITH {BOX_SQL}, t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM boxes WHERE page = 1) SELECT doc_id, {CAPS_SQL.format(t="t")} AS title FROM t WHERE y0 <= 792 * 0.45 AND y1 - y0 <= x1 - x0 AND x1 >= 612 * 0.15 AND x0 <= 612 * 0.85 AND len(t) BETWEEN 8 AND 250 AND NOT regexp_matches(t, '(?i)^(arxiv:|doi:|preprint|under review|published as|proceedings of)') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(size, 1) DESC, y0, t) = 1""")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = boxes_of(spark, sf_dir)
    return layout.titles(boxes, pages_of(boxes))


REGION_SQL = "areas AS (SELECT DISTINCT doc_id, page, 200.0::DOUBLE AS y0, 400.0::DOUBLE AS y1, page - 1 AS cluster FROM boxes WHERE page % 2 = 1)"


@CATALOG.add("P7, J3", f"WITH {BOX_SQL}, {REGION_SQL} SELECT doc_id, page, y0, y1, count(*) AS n FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE a.doc_id = b.doc_id AND a.page = b.page AND b.y0 >= a.y0 - 90 AND b.y0 <= a.y1 AND b.y1 <= a.y1 + 20) GROUP BY ALL")
def blocks_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = boxes_of(spark, sf_dir)
    areas = boxes.filter("page % 2 = 1").select("doc_id", "page", F.lit(200.0).alias("y0"), F.lit(400.0).alias("y1")).distinct()
    return sec.without_tables(boxes, areas).groupBy("doc_id", "page", "y0", "y1").agg(F.count("*").alias("n"))


@CATALOG.add("J2", f"WITH {BOX_SQL}, s AS (SELECT doc_id, 's' || lpad((page - 1)::VARCHAR, 3, '0') AS section_id, page * 10.0::DOUBLE AS lo, page * 10.0::DOUBLE + 10 AS hi FROM (SELECT DISTINCT doc_id, page FROM boxes WHERE page > 1)), t AS (SELECT DISTINCT doc_id, page AS table_id, page * 10.0::DOUBLE + 5 AS ord FROM boxes) SELECT t.doc_id, table_id, ord, section_id FROM t LEFT JOIN s ON s.doc_id = t.doc_id AND ord >= lo AND ord < hi")
def owning_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = boxes_of(spark, sf_dir).select("doc_id", "page").distinct()
    found = pages.filter("page > 1").select("doc_id", F.concat(F.lit("s"), F.lpad((F.col("page") - 1).cast("string"), 3, "0")).alias("section_id"), (F.col("page") * 10.0).alias("start_ord"), (F.col("page") * 10.0 + 10).alias("end_ord"))
    return sec.owning_section(pages.select("doc_id", F.col("page").alias("table_id"), (F.col("page") * 10.0 + 5).alias("ord")), found)


@CATALOG.add("J21", rf"""WITH {BOX_SQL}, {REGION_SQL}, texts AS (SELECT doc_id, page, y0 AS ty, CASE WHEN (y0::INTEGER + doc_id) % 4 = 0 THEN 'Table ' || page || ': ' || left(text, 30) ELSE left(text, 30) END AS text FROM boxes),
    near AS (SELECT a.doc_id, a.page, a.cluster, ty, text, ty >= y0 - 90 AND ty <= y0 AS above FROM areas a JOIN texts t ON t.doc_id = a.doc_id AND t.page = a.page AND ty BETWEEN y0 - 90 AND y0 + 90), side AS (SELECT doc_id, page, cluster, above, string_agg(text, ' ' ORDER BY ty, text) AS text FROM near GROUP BY ALL)
    SELECT doc_id, page, cluster, rtrim('Table ' || regexp_extract(text, '(?s).*(?:Table|TABLE|表)\s*(\d+)\s*[:.、]\s*(.*)', 1) || ': ' || left(trim(regexp_replace(regexp_extract(text, '(?s).*(?:Table|TABLE|表)\s*(\d+)\s*[:.、]\s*(.*)', 2), '\s+', ' ', 'g')), 160)) AS caption FROM side WHERE regexp_matches(text, '(?s).*(?:Table|TABLE|表)\s*(\d+)\s*[:.、]\s*(.*)') QUALIFY row_number() OVER (PARTITION BY doc_id, page, cluster ORDER BY above DESC) = 1""")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = boxes_of(spark, sf_dir)
    named = F.when((F.col("y0").cast("int") + F.col("doc_id")) % 4 == 0, F.concat(F.lit("Table "), "page", F.lit(": "), F.left("text", F.lit(30)))).otherwise(F.left("text", F.lit(30)))
    areas = boxes.filter("page % 2 = 1").select("doc_id", "page", F.lit(200.0).alias("y0"), (F.col("page") - 1).alias("cluster")).distinct()
    return layout.captions(boxes.select("doc_id", "page", "y0", named.alias("text")), areas)
