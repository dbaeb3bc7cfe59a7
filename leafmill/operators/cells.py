"""Tables as cells: checks, reading by row and column, and what pairs of percents say.

Cells are kept long: doc_id, table_id, row_idx, row_label, col_idx, col_name, val.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: what counts as a number in a cell.
NUMBER = r"\d+(?:[.,]\d+)?"
PERCENT = r"^\d+(\.\d+)?%$"
TABLE = ["doc_id", "table_id"]
ROW = [*TABLE, "row_idx"]


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))


def percent(text: Column) -> Column:
    """A bare percent as a number, else null."""
    t = F.trim(text)
    return F.when(t.rlike(PERCENT), F.regexp_replace(t, "%", "").cast("double"))


def group_of(col_name: Column) -> Column:
    return F.trim(F.split_part(col_name, F.lit(" / "), F.lit(1)))


def member_of(col_name: Column) -> Column:
    """Everything after the first separator; null without one."""
    return F.when(F.contains(col_name, F.lit(" / ")), F.trim(F.regexp_replace(col_name, "^.*? / ", "")))


def conserved(region: DataFrame, emitted: DataFrame) -> DataFrame:
    """doc_id, table_id, missing, extra: how many numbers of a region's words are not in its cells, and the other way; counted with repeats.

    region, emitted: doc_id, table_id, text.
    """
    count = lambda df, name: df.select(*TABLE, F.explode(numbers(F.col("text"))).alias("x")).groupBy(*TABLE, "x").agg(F.count("*").alias(name))
    both = count(region, "a").join(count(emitted, "b"), [*TABLE, "x"], "full")
    over = lambda a, b: F.sum(F.greatest(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)), F.lit(0)))
    return both.groupBy(*TABLE).agg(over("a", "b").alias("missing"), over("b", "a").alias("extra"))


def unique_keys(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, n_values, n_keys, unique: whether each (row label, column) names one value."""
    out = cells.groupBy(*TABLE).agg(F.count("*").alias("n_values"), F.count_distinct("row_label", "col_name").alias("n_keys"))
    return out.withColumn("unique", F.col("n_values") == F.col("n_keys"))


def kinds(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, numeric_share, mean_length, kind: prose if under three tenths of the values have a number or they are long, else data."""
    share = F.avg(F.when(F.col("val").rlike(NUMBER), 1.0).otherwise(0.0))
    out = cells.groupBy(*TABLE).agg(F.round(share, 6).alias("numeric_share"), F.round(F.avg(F.length("val")), 6).alias("mean_length"))
    return out.withColumn("kind", F.when((F.col("numeric_share") < 0.3) | (F.col("mean_length") > 60), "prose").otherwise("data"))


def numbered(labels: DataFrame, name: str, by: list[str], order: list[str]) -> DataFrame:
    """The second and later of equal names get ' #2', ' #3', .."""
    n = F.row_number().over(W.partitionBy(*by, name).orderBy(*order))
    return labels.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(" #"), F.col("_n"))).otherwise(F.col(name))).drop("_n")


def column_names(levels: DataFrame) -> DataFrame:
    """doc_id, table_id, col_idx, col_name of header cells: the levels from the top, repeats once, 'colN' if all are empty; unique.

    levels: doc_id, table_id, level, col_idx, text.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("level", "text"))), lambda x: x["text"])
    parts = F.array_distinct(F.filter(listed, lambda t: F.coalesce(t, F.lit("")) != ""))
    out = levels.groupBy(*TABLE, "col_idx").agg(F.array_join(parts, " / ").alias("col_name"))
    out = out.withColumn("col_name", F.when(F.col("col_name") == "", F.concat(F.lit("col"), F.col("col_idx"))).otherwise(F.col("col_name")))
    return numbered(out, "col_name", TABLE, ["col_idx"])


def grouped_rows(rows: DataFrame) -> DataFrame:
    """doc_id, table_id, row_idx, row_label of body rows under their subheading. rows: doc_id, table_id, row_idx, label, rest (array), header (array).

    A row without numbers but with other values than a label is a subheading: of its names those that the subheading before it (at first
    the header) lacks become the group of the rows below. Labels that repeat are numbered. Of rows of one row_idx, body rows come
    before subheadings, then by label and values, so that no partitioning changes a group.
    """
    some = F.exists("rest", lambda v: F.coalesce(v, F.lit("")) != "")
    digits = F.exists(F.concat(F.array("label"), "rest"), lambda v: F.coalesce(v.rlike(NUMBER), F.lit(False)))
    marked = rows.withColumn("sub", some & ~digits)
    order = W.partitionBy(*TABLE).orderBy("row_idx", "sub", "label", "rest")
    names = F.filter("rest", lambda v: F.coalesce(v, F.lit("")) != "")
    last = F.last(F.when(F.col("sub"), names), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    known = F.coalesce(last, "header")
    marked = marked.withColumn("known", known).withColumn("names", names)
    fresh = F.array_join(F.array_distinct(F.array_except("names", "known")), " ")
    marked = marked.withColumn("grp", F.last(F.when(F.col("sub"), fresh), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    label = F.when(F.coalesce("grp", F.lit("")) != "", F.concat("grp", F.lit(" / "), "label")).otherwise(F.col("label"))
    out = marked.filter("not sub").select(*ROW, label.alias("row_label"))
    return numbered(out, "row_label", TABLE, ["row_idx"])


def sentences(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, table_id, row_idx, text: each row as '[caption · p.N] label: column = value; ..'. tables: doc_id, table_id, caption, page."""
    one = F.struct("col_idx", F.concat("col_name", F.lit(" = "), "val").alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "; ")
    rows = cells.groupBy(*ROW, "row_label").agg(body.alias("body")).join(tables, TABLE)
    head = F.concat(F.lit("["), F.coalesce(F.nullif("caption", F.lit("")), "table_id"), F.lit(" · p."), "page", F.lit("] "))
    return rows.select(*ROW, F.concat(head, "row_label", F.lit(": "), "body").alias("text"))


def markdown(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, markdown: the table with one header line, rows and columns in order."""
    listed = lambda v: F.transform(F.array_sort(F.collect_list(v)), lambda x: x["t"])
    rows = cells.groupBy(*ROW, "row_label").agg(listed(F.struct("col_idx", F.col("val").alias("t"))).alias("v"), listed(F.struct("col_idx", F.col("col_name").alias("t"))).alias("c"))
    line = F.concat(F.lit("| "), "row_label", F.lit(" | "), F.array_join("v", " | "), F.lit(" |"))
    out = rows.groupBy(*TABLE).agg(listed(F.struct("row_idx", line.alias("t"))).alias("lines"), F.min_by("c", "row_idx").alias("c"))
    head = F.concat(F.lit("|  | "), F.array_join("c", " | "), F.lit(" |\n|"), F.repeat(F.lit(" --- |"), F.size("c") + 1), F.lit("\n"))
    return out.select(*TABLE, F.concat(head, F.array_join("lines", "\n")).alias("markdown"))


def looked_up(asked: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """ask_id, answer, value, found, available, rows, columns, markdown. The answer is no_table (then available lists the document's), not_data (then the
    table as markdown), coordinates (rows and columns, of which one is to be named), or value, whether found.

    asked: ask_id, doc_id, table_id, row_label, col_name; tables: doc_id, table_id, kind, validated.
    """
    known = asked.join(tables.select(*TABLE, "kind", "validated"), TABLE, "left")
    values = cells.groupBy(*TABLE, "row_label", "col_name").agg(F.min_by("val", "row_idx").alias("value"))
    out = known.join(values, [*TABLE, "row_label", "col_name"], "left")
    sound = F.col("validated") & (F.col("kind") == "data")
    answer = F.when(F.col("kind").isNull(), "no_table").when(~sound, "not_data").when(F.col("row_label").isNull() | F.col("col_name").isNull(), "coordinates").otherwise("value")
    out = out.withColumn("answer", answer).withColumn("value", F.when(F.col("answer") == "value", F.col("value")))
    # what helps where there is no value: the document's tables, the table's rows and columns, or the table as it stands
    ids = tables.groupBy("doc_id").agg(F.sort_array(F.collect_set("table_id")).alias("available"))
    labels = cells.select(*ROW, "row_label").distinct().groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "row_label"))), lambda x: x["row_label"]).alias("rows"))
    names = cells.groupBy(*TABLE).agg(F.sort_array(F.collect_set("col_name")).alias("columns"))
    out = out.join(ids, "doc_id", "left").join(labels, TABLE, "left").join(names, TABLE, "left").join(markdown(cells), TABLE, "left")
    only = lambda c, a: F.when(F.col("answer") == a, F.col(c)).alias(c)
    return out.select("ask_id", "answer", "value", F.when(F.col("answer") == "value", F.col("value").isNotNull()).alias("found"), only("available", "no_table"), only("rows", "coordinates"), only("columns", "coordinates"), only("markdown", "not_data"))


def pairwise(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, pairwise: every value of every row a bare percent, two in each column group, adding up to 100 within 0.6."""
    p = cells.select(*ROW, group_of(F.col("col_name")).alias("grp"), percent(F.col("val")).alias("p"))
    groups = p.groupBy(*ROW, "grp").agg((F.count("p") == F.count("*")).alias("all"), F.count("*").alias("n"), F.sum("p").alias("s"))
    sound = F.col("all") & (F.col("n") == 2) & (F.abs(F.col("s") - 100) < 0.6)
    return groups.groupBy(*TABLE).agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("pairwise"))


def tallies(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row_idx, subject, opponent, total, wins, ties, losses (names) of the rows whose label begins with one of the two in each group.

    A tie counts as a loss, and is counted apart. Rows with other values, other names or fewer than two groups are left out.
    """
    opponent = F.trim(F.split_part("row_label", F.lit(" / "), F.lit(1)))
    p = cells.select(*ROW, opponent.alias("opponent"), group_of(F.col("col_name")).alias("grp"), F.coalesce(member_of(F.col("col_name")), F.lit("")).alias("who"), percent(F.col("val")).alias("p"))
    own = F.col("who") != F.col("opponent")
    g = p.groupBy(*ROW, "opponent", "grp").agg(F.count("*").alias("n"), F.count("p").alias("m"), F.count_if(own).alias("others"), F.max(F.when(own, F.col("who"))).alias("subject"), F.max(F.when(own, F.col("p"))).alias("mine"), F.max(F.when(~own, F.col("p"))).alias("theirs"))
    sound = (F.col("n") == 2) & (F.col("m") == 2) & (F.col("others") == 1)
    lost = F.when(F.col("mine") <= F.col("theirs"), F.col("grp"))
    rows = g.groupBy(*ROW, "opponent").agg(F.bool_and(sound).alias("sound"), F.max_by("subject", "grp").alias("subject"), F.count("*").alias("total"), F.count_if(F.col("mine") > F.col("theirs")).alias("wins"), F.count_if(F.col("mine") == F.col("theirs")).alias("ties"), F.array_join(F.array_sort(F.collect_list(lost)), ", ").alias("losses"))
    return rows.filter("sound and total >= 2").drop("sound")


def shared_reference(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, ref: the one name that all rows of a table of percents share, each row having two names, and two subjects at least."""
    p = cells.select(*ROW, member_of(F.col("col_name")).alias("who"), percent(F.col("val")).alias("p"))
    rows = p.groupBy(*ROW).agg(F.collect_set("who").alias("names"), (F.count("p") == F.count("*")).alias("sound"))
    t = rows.groupBy(*TABLE).agg(F.bool_and(F.col("sound") & (F.size("names") == 2)).alias("sound"), F.count("*").alias("rows"))
    names = rows.select(*TABLE, "row_idx", F.explode("names").alias("who")).groupBy(*TABLE, "who").agg(F.count("*").alias("n"))
    tab = names.join(t.filter("sound"), TABLE)
    every = tab.groupBy(*TABLE).agg(F.count_if(F.col("n") == F.col("rows")).alias("common"), F.max(F.when(F.col("n") == F.col("rows"), F.col("who"))).alias("ref"), F.count_if(F.col("n") < F.col("rows")).alias("subjects"))
    return every.filter("common = 1 and subjects >= 2").select(*TABLE, "ref")


def leaders(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, table_id, focus, cells, sole, behind, tied, above: of the subjects measured against one reference, the one that leads alone most
    often (ties by name), and in how many (metric, group) cells it leads alone, is behind, leads with others, and is above 50.
    Tables in which a subject lacks a cell are left out."""
    metric = F.trim(F.element_at(F.split("row_label", " / "), -1))
    m = cells.join(refs, TABLE).select(*TABLE, "ref", metric.alias("metric"), group_of(F.col("col_name")).alias("grp"), member_of(F.col("col_name")).alias("who"), percent(F.col("val")).alias("p")).filter("who != ref")
    cell = W.partitionBy(*TABLE, "metric", "grp")
    m = m.groupBy(*TABLE, "metric", "grp", "who").agg(F.last("p").alias("p"))
    m = m.withColumn("top", F.max("p").over(cell)).withColumn("subjects", F.count("*").over(cell))
    m = m.withColumn("leading", F.count_if(F.col("p") == F.col("top")).over(cell))
    n = m.groupBy(*TABLE).agg(F.count_distinct("who").alias("n"), F.min("subjects").alias("least"))
    s = m.groupBy(*TABLE, "who").agg(F.count_if((F.col("p") == F.col("top")) & (F.col("leading") == 1)).alias("sole"), F.count_if(F.col("p") < F.col("top")).alias("behind"), F.count_if((F.col("p") == F.col("top")) & (F.col("leading") > 1)).alias("tied"), F.count_if(F.col("p") > 50).alias("above"), F.count("*").alias("cells"))
    best = F.row_number().over(W.partitionBy(*TABLE).orderBy(F.desc("sole"), "who"))
    return s.join(n.filter("n >= 2 and least = n"), TABLE).withColumn("_n", best).filter("_n = 1").select(*TABLE, F.col("who").alias("focus"), "cells", "sole", "behind", "tied", "above")


def without_reference(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """Cells of the subjects alone: columns named by group, and labels that begin with the row's subject."""
    p = cells.join(refs, TABLE).withColumn("who", member_of(F.col("col_name"))).filter("who != ref")
    subject = F.col("who")
    label = F.when(F.startswith("row_label", subject), F.col("row_label")).otherwise(F.concat(subject, F.lit(" / "), F.element_at(F.split("row_label", " / "), -1)))
    return p.select(*ROW, label.alias("row_label"), "col_idx", group_of(F.col("col_name")).alias("col_name"), "val")


def label_hits(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """query_id, table_id, labels (longest first): the table of most labels (two at least, over two characters) that a question names, the first table on ties.

    questions: query_id, doc_id, question; labels are the parts of row labels and column names.
    """
    parts = lambda c: F.transform(F.split(F.regexp_replace(c, " #\\d+$", ""), "/"), lambda x: F.trim(x))
    labels = cells.select(*TABLE, F.explode(F.concat(parts("row_label"), parts("col_name"))).alias("label")).filter(F.length("label") > 2).distinct()
    hit = questions.join(labels, "doc_id").filter(F.contains(F.lower("question"), F.lower("label")))
    best = hit.groupBy("query_id", "table_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.length("label")).alias("l"), "label"))).alias("x")).filter("n >= 2")
    first = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "table_id"))
    return best.withColumn("_n", first).filter("_n = 1").select("query_id", "table_id", F.transform("x", lambda v: v["label"]).alias("labels"))
