"""Measures of rankings and classifiers.

Where rows are ranked by a score, counts by score are ordered, and of rows those at
the border of what is asked for, both in ranges: each range is summed by a task of
its own, and what lies before a range comes from a table with a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.text import canonical_text, parse_family_size, parse_income
from claimlens.session import materialize


def _running(rows: DataFrame, order: list[Column], count: str, before: str) -> DataFrame:
    """rows with the sum of count over the rows that stand before by order."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_range").agg(F.sum(count).alias("s"))
    earlier = F.sum("s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    base = totals.select("_range", F.coalesce(earlier, F.lit(0)).alias("_base"))
    own = F.sum(count).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(base), "_range")
    return out.withColumn(before, (F.col("_base") + F.col("_own")).cast("long")).select(*rows.columns, before)


def auc(rows: DataFrame) -> DataFrame:
    """Area under the curve of (positive 0/1, score) from counts by score: ties count half; 0.5 if a side is empty."""
    by = rows.groupBy("score").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("n"))
    below = _running(by, [F.asc("score")], "n", "below")
    t = below.withColumn("wins", F.col("p") * (F.col("below") + F.col("n") / 2)).agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.round(F.when(F.col("p") * F.col("n") > 0, F.col("w") / (F.col("p") * F.col("n"))).otherwise(0.5), 6).alias("auc"))


def precision_and_lift(rows: DataFrame, score: str, tie: str, k: int = 10) -> DataFrame:
    """Share of expected rows among the first k and in the top tenth against all; rows: score, tie, expected."""
    rows = materialize(rows.select(score, tie, "expected"), "ranked")
    hit = F.avg(F.col("expected").cast("int"))
    n = rows.count()
    tenth = max(1, int(n / 10 + 0.5))
    # The border score of the top tenth is found on counts by score; of the border's rows those that so many others don't precede belong to it.
    above = _running(rows.groupBy(score).agg(F.count(F.lit(1)).alias("c")), [F.desc(score)], "c", "above")
    border = above.where(F.col("above") < tenth).orderBy(score).limit(1).collect()  # one row
    top = rows.orderBy(F.desc(score), tie).limit(k)
    head = rows.limit(0)
    if border:
        b = border[0]
        ties = rows.where(F.col(score) == F.lit(b[score])).withColumn("one", F.lit(1))
        ties = _running(ties, [F.asc(tie)], "one", "before").where(F.col("before") < tenth - b["above"])
        head = rows.where(F.col(score) > F.lit(b[score])).unionByName(ties.select(*rows.columns))
    one = top.agg(hit.alias("p")).crossJoin(rows.agg(hit.alias("base"))).crossJoin(head.agg(hit.alias("t")))  # one row each
    return one.select(F.round("p", 6).alias("precision_at_10"), F.round("base", 6).alias("base_rate"), F.round(F.try_divide("t", "base"), 6).alias("lift"))


def recall(expected: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Expected rows, those with any flag, and their share (null where none are expected)."""
    hit = flags.select(key).distinct().withColumn("hit", F.lit(1))
    n = expected.join(hit, key, "left").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("caught"))
    return n.withColumn("recall", F.round(F.try_divide("caught", "expected"), 6))


def missed(expected: DataFrame, flags: DataFrame, key: list[str]) -> DataFrame:
    """Expected rows (key) that no flag meets."""
    return expected.join(flags.select(*key).distinct(), key, "left_anti")


def pass_rate(rows: DataFrame, flags: DataFrame, case: list[str], key: str) -> DataFrame:
    """Share of cases in which no row has a high flag."""
    high = flags.where("severity = 'high'").select(key).distinct().withColumn("hit", F.lit(1))
    cases = rows.join(high, key, "left").groupBy(*case).agg(F.count("hit").alias("high"))
    return cases.agg(F.round(F.avg((F.col("high") == 0).cast("int")), 6).alias("pass_rate"))


def error_rates(rows: DataFrame, score: str, threshold: float) -> DataFrame:
    """By variant: rows, mean score, and how many reach the threshold; rows: variant, score (null counts as unmeasured)."""
    hit = F.count_if(F.col(score) >= threshold)
    by = rows.groupBy("variant").agg(F.count(score).alias("measured"), F.round(F.avg(score), 6).alias("mean_score"), hit.alias("flagged"))
    return by.withColumn("rate", F.round(F.try_divide("flagged", "measured"), 6))


def graded(truth: DataFrame, read: DataFrame, key: str = "document") -> DataFrame:
    """(key, field, status) of every true value: right, wrong, or missing where nothing was read.

    truth, read: (key, field, value as text). Incomes and family sizes are read by their parsers and compared as
    numbers, all else as canonical text.
    """
    both = truth.select(key, "field", F.col("value").alias("want")).where("want is not null")
    both = both.join(read.select(key, "field", F.col("value").alias("got")), [key, "field"], "left")
    number = F.when(F.col("field") == "annual_income", parse_income(F.col("got"))).otherwise(parse_family_size(F.col("got")))
    numeric = F.col("field").isin("annual_income", "family_size")
    same = F.when(numeric, F.coalesce(number.cast("long") == F.col("want").try_cast("long"), F.lit(False))).otherwise(F.col("plain_got") == F.col("plain_want"))
    both = both.withColumns({"plain_got": canonical_text(F.col("got")), "plain_want": canonical_text(F.col("want"))})
    status = F.when(F.col("got").isNull() | (F.trim("got") == ""), "missing").when(same, "right").otherwise("wrong")
    return both.select(key, "field", status.alias("status"))


def whole_documents(grades: DataFrame, key: str = "document") -> DataFrame:
    """Documents graded, and those of which every field is right."""
    one = grades.groupBy(key).agg(F.bool_and(F.col("status") == "right").alias("whole"))
    return one.agg(F.count(F.lit(1)).alias("documents"), F.count_if("whole").alias("correct"))


def field_accuracy(graded: DataFrame) -> DataFrame:
    """From (check, status): how many of each field were graded and right; skipped ones are not graded."""
    done, right = F.count_if(F.col("status") != "skipped"), F.count_if(F.col("status") == "pass")
    return graded.groupBy("check").agg(done.alias("graded"), right.alias("correct")).withColumn("accuracy", F.round(F.try_divide("correct", "graded"), 6))


def expectations(expected: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Expected keys without any flag."""
    return expected.select(key).join(flags.select(key), key, "left_anti")


def retired(cases: DataFrame, caught: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of log (case_id, caught) that name no case or whose caught differs from the run's."""
    now = cases.select("case_id", F.lit(True).alias("known")).join(caught.select("case_id", F.lit(True).alias("hit")).distinct(), "case_id", "left")
    both = log.join(now, "case_id", "left")
    wrong = F.when(F.col("known").isNull(), "unknown").when(F.col("caught") != F.coalesce("hit", F.lit(False)), "differs")
    return both.withColumn("wrong", wrong).where("wrong is not null").select("case_id", "wrong")


def false_positive_rate(rows: DataFrame, score: str, control: Column, least: float = 0.5) -> DataFrame:
    """One row: how many controls there are, and the share of them that scores least or more."""
    return rows.where(control).agg(F.count(F.lit(1)).alias("controls"), F.round(F.avg((F.col(score) >= least).cast("int")), 6).alias("false_positive_rate"))
