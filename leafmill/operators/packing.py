"""Evidence for a question: tables made whole, discussion added, all within a budget; and what an answer cites of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A chunk is cut to no fewer tokens than this, and nothing is added to less room; discussion of one table is bounded.
USEFUL, DISCUSSION = 80, 700
#: What claims something of all cases, and two percents that a comparing word joins.
UNIVERSAL = r"(all (four )?datasets|所有(四個)?資料集|全面)"
COMPARED = r"(\d+\.\d+)%[^。\n]{0,26}?(?:而|vs\.?|versus)[^。\n]{0,26}?(\d+\.\d+)%"


def with_whole_tables(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank: a hit row of a table gives way to the whole table, at its first place and once.

    hits: query_id, chunk_id, rank; chunks: chunk_id, kind, table_id. Rows of tables without a whole one stay.
    """
    known = hits.join(chunks.select("chunk_id", "kind", "table_id"), "chunk_id")
    whole = chunks.filter("kind = 'table_full'").select("table_id", F.col("chunk_id").alias("full_id"))
    out = known.join(whole, "table_id", "left")
    shown = F.when(F.col("kind").isin("table_row", "table_full"), F.coalesce("full_id", "chunk_id")).otherwise(F.col("chunk_id"))
    out = out.select("query_id", shown.alias("chunk_id"), "rank")
    return out.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))


def with_discussion(shown: DataFrame, hits: DataFrame, chunks: DataFrame, most: int = DISCUSSION) -> DataFrame:
    """query_id, chunk_id, rank, place: after each whole table the text of its section in order, up to the first that exceeds `most`
    tokens in all, leaving out what was hit; a text is shown once a question, with the first of its tables.

    chunks: chunk_id, kind, section_id, n_tokens (chunk_id in document order).
    """
    tables = shown.join(chunks.filter("kind = 'table_full'").select("chunk_id", "section_id"), "chunk_id").select("query_id", "rank", "section_id")
    texts = chunks.filter("kind = 'text'").select("section_id", F.col("chunk_id").alias("text_id"), "n_tokens")
    found = tables.join(texts, "section_id").join(hits.select("query_id", F.col("chunk_id").alias("text_id")), ["query_id", "text_id"], "left_anti")
    used = F.sum("n_tokens").over(W.partitionBy("query_id", "rank").orderBy("text_id").rowsBetween(W.unboundedPreceding, 0))
    added = found.withColumn("used", used).filter(F.col("used") <= most).groupBy("query_id", "text_id").agg(F.min("rank").alias("rank"))
    own = shown.select("query_id", "chunk_id", "rank", F.lit(0).alias("kind"))
    both = own.unionByName(added.select("query_id", F.col("text_id").alias("chunk_id"), "rank", F.lit(1).alias("kind")))
    return both.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "kind", "chunk_id"))).drop("kind")


def packed(candidates: DataFrame, useful: int = USEFUL) -> DataFrame:
    """query_id, chunk_id, place, outcome (kept, cut or dropped), n (number of the block), tokens, text.

    candidates: query_id, budget, place, chunk_id, kind, n_tokens, text. In order of place each takes room while there is any; a text that
    is too long is cut at a sentence, if 80 tokens remain of it, and a table never; what does not fit is dropped, and the next one tried.
    """
    listed = candidates.groupBy("query_id", "budget").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "kind", "n_tokens", "text"))).alias("c"))
    # the sentences that fit into the room left, or else its first words
    words = "filter(split({t}, '\\\\s+'), w -> w != '')"
    sentences = "split(x.text, '(?<=[。！？.!?])\\\\s+')"
    fit = f"""aggregate({sentences}, struct(cast(array() as array<string>) as s, 0 as n, false as over), (b, y) -> if(b.over or b.n + size({words.format(t="y")}) > a.room, named_struct('s', b.s, 'n', b.n, 'over', true),
        named_struct('s', concat(b.s, array(y)), 'n', b.n + size({words.format(t="y")}), 'over', false)), b -> if(size(b.s) > 0, array_join(b.s, ' '), array_join(slice({words.format(t="x.text")}, 1, a.room), ' ')))"""
    long = f"x.n_tokens > a.room and x.kind = 'text' and a.room > {useful}"
    # what would be shown of the chunk and its size, then its fate, each worked out once
    shown = f"transform(array(if({long}, {fit}, x.text)), t -> named_struct('t', t, 'size', if({long}, size({words.format(t='t')}), x.n_tokens)))"
    fate = f"case when a.room <= {useful} then 'dropped' when x.n_tokens <= a.room then 'kept' when x.kind != 'text' then 'dropped' when y.size < {useful} then 'dropped' else 'cut' end"
    fated = f"transform({shown}, y -> named_struct('t', y.t, 'size', y.size, 'fate', {fate}, 'goes', {fate} = 'dropped'))"
    kind = "array<struct<place:int,chunk_id:bigint,outcome:string,n:int,tokens:int,text:string>>"
    row = "named_struct('place', cast(x.place as int), 'chunk_id', x.chunk_id, 'outcome', z.fate, 'n', if(z.goes, cast(null as int), a.n + 1), 'tokens', cast(if(z.goes, 0, z.size) as int), 'text', if(z.goes, cast(null as string), z.t))"
    step = f"get(transform({fated}, z -> named_struct('room', cast(a.room - if(z.goes, 0, z.size) as int), 'n', a.n + if(z.goes, 0, 1), 'out', concat(a.out, array({row})))), 0)"
    fold = f"aggregate(c, named_struct('room', cast(budget as int), 'n', 0, 'out', cast(array() as {kind})), (a, x) -> {step}, a -> a.out)"
    return listed.select("query_id", F.inline(F.expr(fold)))


def rendered(blocks: DataFrame) -> DataFrame:
    """query_id, context: the numbered blocks with source and kind. blocks: query_id, n, source, kind, text."""
    one = F.concat(F.lit("["), F.col("n"), F.lit("] Source: "), "source", F.lit("\n    Kind: "), F.when(F.col("kind") == "text", "text").otherwise("table"), F.lit("\n    Content: "), "text")
    listed = F.array_sort(F.collect_list(F.struct("n", one.alias("t"))))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("context"))


def cited_blocks(blocks: DataFrame, cite: Column) -> DataFrame:
    """Of each answer's blocks (with n, answer) those that it cites as [n], cited true; all of them, cited false, if it cites none; with label, as
    cite writes a block. Numbers without a block give no sources."""
    used = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    marked = blocks.withColumn("used", used).withColumn("cited", F.size("used") > 0)
    return marked.filter(~F.col("cited") | F.array_contains("used", F.col("n").cast("long"))).withColumn("label", cite).drop("used")


def named_rows(chunks: DataFrame, names: str) -> DataFrame:
    """Without table rows that lack one of the compared names; all stay if fewer than two names are longer than two characters. names: an array column."""
    low = F.transform(F.filter(names, lambda e: F.length(e) > 2), lambda e: F.lower(e))
    body = F.lower("text")
    return chunks.filter((F.size(low) < 2) | (F.col("kind") != "table_row") | F.forall(low, lambda e: F.contains(body, e)))


def focused_rows(rows: DataFrame, names: str) -> DataFrame:
    """Rows of whole tables whose label holds one of the names; all of a table's if none or every one does. rows: query_id, table_id, row_label."""
    hit = F.exists(F.transform(F.col(names), lambda e: F.lower(e)), lambda e: F.contains(F.lower("row_label"), e))
    n = F.sum(F.col("_hit").cast("int")).over(W.partitionBy("query_id", "table_id"))
    return rows.withColumn("_hit", hit).withColumn("_n", n).filter("_hit or _n = 0").drop("_hit", "_n")


def with_facts(prompt: DataFrame) -> DataFrame:
    """query_id, prompt: context, question, then the computed facts as a list. prompt: query_id, context, question, facts (array)."""
    facts = F.when(F.size("facts") > 0, F.concat(F.lit("Computed from the tables, use as they are:\n"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n")))
    return prompt.select("query_id", F.concat_ws("\n\n", "context", F.concat(F.lit("Question: "), "question"), facts).alias("prompt"))


def named_first(hits: DataFrame, named: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank: what a question names comes first, then its other hits. hits: query_id, chunk_id, rank; named: query_id, chunk_id."""
    others = hits.join(named, ["query_id", "chunk_id"], "left_anti")
    both = named.withColumn("rank", F.lit(0)).unionByName(others.select("query_id", "chunk_id", "rank"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "chunk_id")))


def claims(answers: DataFrame) -> DataFrame:
    """answers with universal (a sentence claims something of all cases), pairs (of percents that a comparing word joins) and mismatched (those of
    them that do not add up to 100 within 0.6, as they would if both were of one row)."""
    universal = F.exists(F.split("answer", r"[.。\n]"), lambda s: s.rlike(f"(?iu){UNIVERSAL}"))
    side = lambda k: F.transform(F.regexp_extract_all("answer", F.lit(COMPARED), F.lit(k)), lambda x: x.cast("double"))
    off = F.size(F.filter(F.zip_with(side(1), side(2), lambda a, b: F.abs(a + b - 100) >= 0.6), lambda x: x))
    return answers.withColumn("universal", universal).withColumn("pairs", F.size(side(1))).withColumn("mismatched", off)
