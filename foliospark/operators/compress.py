"""Context compression: near-duplicates out, key sentences, a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS

# Total characters beyond which contexts are thinned out, and cut down.
MEDIUM, AGGRESSIVE = 15_000, 30_000
BUDGET, LEAST_REST, ALIKE, LONG, SENTENCES = 25_000, 200, 0.85, 800, 500


def level(total: Column) -> Column:
    return F.when(total > AGGRESSIVE, "aggressive").when(total > MEDIUM, "medium").otherwise("none")


def within_budget(rows: DataFrame, by: list[str], order: list[str], budget: int | Column = BUDGET) -> DataFrame:
    """rows (by, order, content) until their characters fill the budget. The first row that overflows it is cut
    to what is left, with dots, if that is over 200 characters; what follows is left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    before = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = rows.withColumn("_before", before).withColumn("_fits", F.col("_before") + F.length("content") <= budget)
    # Once a row overflows, later sums are larger still: the first that doesn't fit is the one that starts within.
    rest = budget - F.col("_before")
    first_over = ~F.col("_fits") & (F.coalesce(F.min(F.col("_fits")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    cut = F.concat(F.substring(F.col("content"), F.lit(1), rest.cast("int")), F.lit("..."))
    return r.withColumn("_cut", first_over & (rest > LEAST_REST)).where(F.col("_fits") | F.col("_cut")).withColumn("content", F.when(F.col("_cut"), cut).otherwise(F.col("content"))).drop("_before", "_fits", "_cut")


def key_sentences(text: Column, most: int = SENTENCES) -> Column:
    """Up to most characters of a text's sentences, best first: the first, then long ones and the last. A
    text of three sentences or fewer is cut plainly. It stops at the first that doesn't fit."""
    # A sentence begins at the text's start or after an end mark: looked for only there, texts without marks take linear time.
    found = F.regexp_extract_all(text, F.lit(r"(?<![^.!?])[^.!?]++[.!?]++"), F.lit(0))
    trimmed = lambda s: F.regexp_replace(s, rf"\A{WS}+|{WS}+\z", "")

    def take(a, x):
        # Sentences are trimmed only until one doesn't fit.
        size = a["n"] + F.when(a["over"], F.lit(0)).otherwise(F.length(trimmed(x["s"])))
        over = a["over"] | (size > most)
        return F.struct(F.when(over, a["n"]).otherwise(size).alias("n"), over.alias("over"), F.when(over, a["kept"]).otherwise(F.concat(a["kept"], F.array(trimmed(x["s"])))).alias("kept"))

    def chosen(sentences):
        n = F.size(sentences)
        score = lambda s, i: F.when(i == 0, 3).when(i == n - 1, 2).otherwise(1) + F.when(F.length(s) > 50, 1).otherwise(0)
        scored = F.transform(sentences, lambda s, i: F.struct((-score(s, i)).alias("score"), i.alias("i"), s.alias("s")))
        start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))
        kept = F.aggregate(F.array_sort(scored), start, take)["kept"]
        return F.when(n <= 3, F.substring(text, 1, most)).otherwise(F.array_join(kept, " "))

    # The lambda binds the sentences, so that the text is searched once.
    return F.get(F.transform(F.array(found), chosen), F.lit(0))


def without_near_duplicates(rows: DataFrame, by: list[str], order: str, alike: float = ALIKE, where: str | None = None) -> DataFrame:
    """rows (by, order, content) without those whose words overlap an earlier kept row of their group by more
    than alike. The result depends on the order, so a group (a query's hits, some tens) is walked in order. where
    names a column that is true for groups to be thinned; others stay as they are."""
    schema = rows.schema

    def walk(table):
        import re

        import pyarrow as pa

        space = re.compile("[\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+")
        if where and not (table.num_rows and table[where][0].as_py()):
            return table
        table = table.sort_by(order)
        kept, at = [], []
        for i, content in enumerate(table["content"].to_pylist()):
            w = set(space.split((content or "").lower()))
            if all(len(w & k) / len(w | k) <= alike for k in kept):
                kept.append(w)
                at.append(i)
        return table.take(pa.array(at, pa.int64()))

    return rows.groupBy(*by).applyInArrow(walk, schema)


def compress(rows: DataFrame, by: list[str], order: str, budget: int = BUDGET) -> DataFrame:
    """rows (by, order, content) of each group as its total length asks: as they are; without near-duplicates;
    or also with long contents cut to key sentences and the whole to the budget."""
    total = F.sum(F.length("content")).over(Window.partitionBy(*by))
    marked = rows.withColumn("level", level(total)).withColumn("_thin", F.col("level") != "none")
    thinned = without_near_duplicates(marked, by, order, where="_thin").drop("_thin")
    hard = F.col("level") == "aggressive"
    cut = thinned.withColumn("content", F.when(hard & (F.length("content") > LONG), key_sentences(F.col("content"))).otherwise(F.col("content")))
    return within_budget(cut, by, [order], F.when(hard, F.lit(budget)).otherwise(F.lit(2**31 - 1)))
