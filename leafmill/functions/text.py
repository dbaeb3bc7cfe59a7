"""Functions of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a Latin term is, and the characters of CJK text.
TERM = r"[A-Za-z0-9][A-Za-z0-9._\-+%/]*"
CJK = "[一-鿿぀-ヿ]"
#: Phrases of an answer that says that the document does not cover the question.
DECLINING = "未提及|沒有提及|未提到|沒有提到|未說明|沒有說明|未包含|沒有包含|未提供|沒有提供|無法回答|沒有相關(資訊|內容)|文件中(找不到|沒有)|does not (mention|contain|provide|include)|not mentioned|no information|cannot answer|is not (mentioned|provided|discussed)"


def terms(text: Column) -> Column:
    """Latin terms in lower case; of runs of CJK characters each pair, or the one. A stand-in for a dictionary segmenter."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1)), lambda t: F.lower(t))
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}+)"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.when(text.rlike(CJK), F.concat(latin, F.flatten(pairs))).otherwise(latin)


def word_count(text: Column) -> Column:
    """Tokens: runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def language(text: Column) -> Column:
    """zh if over a tenth of what is not white space is CJK, or nothing is left; else en."""
    bare = F.regexp_replace(text, r"\s", "")
    share = F.regexp_count(bare, F.lit(CJK)) / F.length(bare)
    return F.when(F.length(bare) == 0, "zh").when(share > 0.1, "zh").otherwise("en")


def declined(text: Column) -> Column:
    """A short answer with a declining phrase."""
    return text.rlike("(?iu)" + DECLINING) & (F.length(text) < 400)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[。！？.!?])\s+")


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def cost(prompt_tokens: Column, completion_tokens: Column, per_million_in: float = 0.15, per_million_out: float = 0.60) -> Column:
    return (prompt_tokens * per_million_in + completion_tokens * per_million_out) / 1e6


def rank_percentile(values: Column, share: float) -> Column:
    """The value at place min(floor(n * share), n - 1) in ascending order, counted from 0. values: an array."""
    ordered, n = F.array_sort(values), F.size(values)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(ordered, F.least(F.floor(n * share), (n - 1).cast("long")).cast("int") + 1))


def evidence_budget(question_tokens: Column, context: int = 10_000, system: int = 1800, question: int = 200, answer: int = 1500, margin: int = 500) -> Column:
    """Tokens left for evidence; a question beyond its reserve takes from it."""
    return F.greatest(F.lit(0), F.lit(context - system - answer - margin) - F.greatest(question_tokens, F.lit(question)))


def prefixed(model: Column, text: Column, side: str) -> Column:
    """The text with the prefix that an embedding model expects for queries or passages."""
    #: Part of a model's name, prefix of queries, prefix of passages.
    known = (("e5", "query: ", "passage: "), ("bge-small-zh", "为这个句子生成表示以用于检索相关文章：", ""))
    out = F.lit("")
    for name, query, passage in reversed(known):
        out = F.when(F.contains(model, F.lit(name)), query if side == "query" else passage).otherwise(out)
    return F.concat(out, text)


def titled(title: Column, text: Column) -> Column:
    """What is embedded and indexed of a chunk: title and text, or the text alone."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), text)


def repaired_caps(text: Column) -> Column:
    """Joins single capitals with the capitals after them (from small-caps type), if a fifth of four or more words are single letters."""
    parts = F.split(squeezed(text), " ")
    core = lambda w: F.regexp_replace(w, "^[-–—:]+|[-–—:]+$", "")
    single = F.size(F.filter(parts, lambda w: core(w).rlike(r"^\p{L}$")))
    joins = lambda prev, w: prev.rlike(r"\p{Lu}$") & (F.length(core(prev)) == 1) & (w == F.upper(w)) & (w != F.lower(w))
    step = lambda out, w: F.when((F.size(out) > 0) & joins(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("")), w), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), w)))).otherwise(F.concat(out, F.array(w)))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), " ")
    return F.when((F.size(parts) >= 4) & (single / F.size(parts) >= 0.2), folded).otherwise(text)
