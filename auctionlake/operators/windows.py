"""Features over time that never look at the present or the future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter(c: Column) -> Column:
    return F.date_trunc("quarter", c).cast("date")


def group_medians(df: DataFrame, keys: Sequence[str], period: Column, values: dict[str, Column]) -> DataFrame:
    """The interpolated median of each value by keys and period."""
    return df.groupBy(*keys, period.alias("period")).agg(*[F.median(v).alias(n) for n, v in values.items()])


def prior_period(medians: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the value of the previous period that was observed; groups with a null key have none."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return medians.withColumn(name, F.when(known, F.lag(value).over(Window.partitionBy(*keys).orderBy("period"))))


def trailing_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, periods: int = 4) -> DataFrame:
    """Adds the median of the ``periods`` observations before each row, without the row itself."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-periods, -1)
    return df.withColumn(name, F.percentile(value, 0.5).over(w))


def prior_event(df: DataFrame, keys: Sequence[str], date_col: str, tiebreak: str, value: str) -> DataFrame:
    """Adds the previous row's value and the months (of 30.4375 days) since; null keys are a group like others."""
    w = Window.partitionBy(*keys).orderBy(date_col, tiebreak)
    months = F.datediff(F.col(date_col), F.lag(date_col).over(w)) / F.lit(30.4375)
    return df.withColumn("prior_value", F.lag(value).over(w)).withColumn("months_since_prior", months)


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """The rows in which any watched column differs from the row before (nulls equal nulls); first rows count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for c in watched:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("first_", F.row_number().over(w) == 1).withColumn("same_", same).filter("first_ OR NOT same_").drop("first_", "same_")


def history_before(targets: DataFrame, history: DataFrame, target_id: str, key: str, date_col: str, quarters: int = 8) -> DataFrame:
    """Pairs of a target and the rows of its key in the ``quarters`` full quarters before its own.

    The range is an equi-join: a row of history is offered to each of the next quarters, a bounded number.
    """
    t = targets.withColumn("q_", quarter(F.col(date_col)))
    offered = history.select(*[F.col(c).alias(f"h_{c}") for c in history.columns])
    offered = offered.withColumn("q_", F.explode(F.transform(F.sequence(F.lit(1), F.lit(quarters)), lambda k: F.add_months(quarter(F.col(f"h_{date_col}")), k * 3))))
    return t.join(offered, (t[key] == offered[f"h_{key}"]) & (t["q_"] == offered["q_"])).drop("q_")
