"""Which way a question goes, and what it compares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that send a question to the summary or the comparison.
SUMMARY = r"\b(summar\w*|overview|tl;?dr)\b|摘要|總結|概述|重點整理"
COMPARE = r"\b(compare|comparison|versus|vs\.?|differ\w*|difference)\b|比較|差別|差異|對比|哪個好"
#: Forms of a comparison of two, tried in order.
PAIRS = (
    r"compar\w*\s+(.+?)\s+(?:with|to|and|against|vs\.?)\s+(.+?)[\s?.,]*$",
    r"^(.+?)\s+(?:vs\.?|versus)\s+(.+?)[\s?.,]*$",
    r"比較\s*(.+?)\s*(?:和|與|跟|及)\s*(.+?)[\s?。，、]*$",
    r"^(.+?)\s*(?:和|與|跟)\s*(.+?)\s*(?:有什麼|的)?(?:差別|差異|不同)",
)
#: What is asked besides the question itself when two things are compared.
ASPECTS = ("{a} architecture method how it works", "{b} architecture method how it works", "{a} {b} performance results comparison", "{a} {b} cost efficiency token overhead")


def route(question: Column, table_hit: Column | None = None) -> Column:
    """summary, comparison, table_lookup or qa, in this order of precedence."""
    hit = F.lit(False) if table_hit is None else table_hit
    return F.when(question.rlike(f"(?iuU){SUMMARY}"), "summary").when(question.rlike(f"(?iuU){COMPARE}"), "comparison").when(hit, "table_lookup").otherwise("qa")


def compared(question: Column) -> Column:
    """The two things compared, or an empty array: of the first form with two parts of 2 to 59 characters."""
    q = F.trim(question)
    found = F.array().cast("array<string>")
    for form in reversed(PAIRS):
        pair = [F.trim(F.regexp_replace(F.regexp_extract(q, f"(?iu){form}", i), r"\s+", " ")) for i in (1, 2)]
        fits = F.lit(True)
        for p in pair:
            fits = fits & F.length(p).between(2, 59)
        found = F.when(fits, F.array(*pair)).otherwise(found)
    return found


def subqueries(question: Column, pair: Column) -> Column:
    """The question, and four aspects if two things are compared."""
    a, b = F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2))
    aspects = [F.replace(F.replace(F.lit(t), F.lit("{a}"), a), F.lit("{b}"), b) for t in ASPECTS]
    return F.when(F.size(pair) == 2, F.array(question, *aspects)).otherwise(F.array(question))
