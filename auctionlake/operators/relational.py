"""Rows per key, tiers, conditional aggregates, ordered lists and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the bracket of ``nearest_rank_quartile``.
BINS = 10_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by ``order``, which must be a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def largest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """As ``latest_per_key`` for orders that rise in every column: one aggregate with map-side partial results, no sort."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*by)).alias("best_"))
    return best.select(*keys, "best_.*")


def where_all(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Rows that meet every condition given; conditions that are None do not count."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(and_, given)) if given else df


def first_label(rules: Sequence[tuple[Column, str | None]], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for rule, label in rules[1:]:
        out = out.when(rule, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The labels of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules]))


def count_reasons(df: DataFrame, column: str) -> DataFrame:
    """How many rows have each label of an array column."""
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


def filtered_sum(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def filtered_count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def ordered_list(order: Sequence[Column], item: Column) -> Column:
    """An aggregate: the items of a group as a list, by ``order`` (ascending; negate or flag for others)."""
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], item.alias("item"))))
    return F.transform(rows, lambda r: r["item"])


def unanimous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys whose rows all have one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_"), F.min(value).alias(value)).filter("n_ = 1").drop("n_")


def tiered_match(left: DataFrame, right: DataFrame, id_col: str, tiers: Sequence[tuple[str, Column, Column]], right_id: str) -> DataFrame:
    """(id, right id, method): matches of the first tier in which an id has any; ids without one have null.

    A tier is a name and an equal key on either side, so each is a hash join whatever the sizes.
    """
    hits = None
    for rank, (name, lkey, rkey) in enumerate(tiers):
        a = left.select(F.col(id_col), lkey.alias("k_")).filter("k_ IS NOT NULL")
        b = right.select(F.col(right_id), rkey.alias("k_")).filter("k_ IS NOT NULL")
        tier = a.join(b, "k_").select(id_col, right_id, F.lit(rank).alias("tier_"), F.lit(name).alias("method"))
        hits = tier if hits is None else hits.unionByName(tier)
    first = hits.groupBy(id_col).agg(F.min("tier_").alias("tier_"))
    best = hits.join(first, [id_col, "tier_"]).select(id_col, right_id, "method").distinct()
    return left.select(id_col).join(best, id_col, "left")


def either_key(left: DataFrame, right: DataFrame, key: Column, keys: Sequence[Column]) -> DataFrame:
    """Rows of ``left`` whose key equals any of several keys of ``right``, as equal-key joins without repeats."""
    lookup = reduce(DataFrame.union, [right.select(k.alias("k_")) for k in keys]).filter("k_ IS NOT NULL").distinct()
    return left.withColumn("k_", key).join(lookup, "k_", "left_semi").drop("k_")


def nearest_year_match(sales: DataFrame, snapshots: DataFrame, sale_id: str, sale_year: str, snapshot_year: str, keys: Sequence[str], snapshot_id: str) -> DataFrame:
    """(sale id, chosen year, candidates, match id, status) in the snapshot year closest to the sale; ties go to the earlier.

    Years are few, so each distinct sale year is matched to one snapshot year first; sales then join by it.
    """
    years = snapshots.select(F.col(snapshot_year).alias("y_")).distinct()
    of = sales.select(F.col(sale_year).alias("s_")).distinct()
    listed = years.agg(F.sort_array(F.collect_set("y_")).alias("ys_"))
    near = of.join(F.broadcast(listed), how="cross").select("s_", F.expr("ys_[0]").alias("first_"), F.expr("aggregate(ys_, ys_[0], (b, y) -> if(abs(y - s_) < abs(b - s_), y, b))").alias("chosen_year"))
    placed = sales.join(near.select("s_", "chosen_year"), sales[sale_year] == F.col("s_")).drop("s_")
    right = snapshots.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(snapshot_year).alias("r_year"), F.col(snapshot_id).alias("r_id"))
    on = reduce(and_, [placed[k] == right[f"r_{k}"] for k in keys]) & (F.col("chosen_year") == F.col("r_year"))
    n, only = F.count("r_id"), F.min("r_id")
    return (
        placed.join(right, on, "left").groupBy(sale_id, "chosen_year").agg(n.alias("candidates"), only.alias("lowest_"))
        .select(sale_id, "chosen_year", "candidates", F.when(F.col("candidates") == 1, F.col("lowest_")).alias("match_id"),
                first_label([(F.col("candidates") == 1, "EXACT"), (F.col("candidates") > 1, "AMBIGUOUS")], "UNMATCHED").alias("match_status"))
    )


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a total order: pages from 1, sizes 1 to 200."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("pages start at 1 and have 1 to 200 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50, total: str = "total_rows") -> DataFrame:
    """A page whose rows carry the number of all rows. The count is its own aggregate: no window over everything."""
    counted = df.agg(F.count("*").alias(total))
    return page(df, order, number, size).join(F.broadcast(counted), how="cross")


def page_arithmetic(total: Column, number: int, size: int) -> Mapping[str, Column]:
    """Pages in all, and the first and last row on one."""
    return {
        "total_pages": F.greatest(F.ceil(total / size), F.lit(1)).cast("long"),
        "first_row": F.when(total == 0, 0).otherwise(F.lit((number - 1) * size + 1)).cast("long"),
        "last_row": F.least(total, F.lit(number * size)).cast("long"),
    }


def nearest_rank_quartile(df: DataFrame, column: str, share: float = 0.75) -> DataFrame:
    """One row: the value at place floor((n - 1) * share) of the sorted column, as ``threshold``.

    The column is numeric. Values near the place are counted in bins and those of one bin by value, so neither
    a list of all values nor all different values of the bracket ever meet in one task.
    """
    v = F.col(column)
    known = df.filter(v.isNotNull()).select(column)
    ends = [max(0.0, share - 0.01), min(1.0, share + 0.01)]
    rough = known.agg(F.percentile_approx(column, ends, 10_000).alias("q_"), F.min(v).alias("min_"), F.max(v).alias("max_"), F.floor((F.count("*") - 1) * share).alias("place_"))
    checked = known.join(F.broadcast(rough), how="cross").groupBy("q_", "min_", "max_", "place_").agg(filtered_count(v < F.col("q_")[0]).alias("under_"), filtered_count(v <= F.col("q_")[1]).alias("upto_"))
    # An end that the estimate put on the wrong side of the place gives way to the smallest or largest value.
    low = F.when(F.col("under_") <= F.col("place_"), F.col("q_")[0]).otherwise(F.col("min_"))
    high = F.when(F.col("upto_") > F.col("place_"), F.col("q_")[1]).otherwise(F.col("max_"))
    below = F.when(F.col("under_") <= F.col("place_"), F.col("under_")).otherwise(0)
    bracket = F.broadcast(checked.select(low.alias("low_"), high.alias("high_"), below.alias("below_"), "place_"))
    offset = F.try_divide((v - F.col("low_")).cast("double"), (F.col("high_") - F.col("low_")).cast("double"))
    near = known.join(bracket, how="cross").filter(v.between(F.col("low_"), F.col("high_"))).withColumn("bin_", F.coalesce(F.floor(offset * BINS), F.lit(0)))
    bins = near.groupBy("bin_", "below_", "place_").agg(F.count("*").alias("n_"))
    summed = bins.withColumn("upto_", F.col("below_") + F.sum("n_").over(Window.orderBy("bin_")))
    hit = summed.filter((F.col("upto_") > F.col("place_")) & (F.col("upto_") - F.col("n_") <= F.col("place_"))).select("bin_", (F.col("upto_") - F.col("n_")).alias("before_"))
    inside = near.join(F.broadcast(hit), "bin_").groupBy(column, "before_", "place_").agg(F.count("*").alias("n_"))
    placed = inside.withColumn("sum_", F.sum("n_").over(Window.orderBy(column)))
    return placed.filter(F.col("before_") + F.col("sum_") > F.col("place_")).agg(F.min(column).alias("threshold"))


def natural_key(text: Column) -> Column:
    """A sort key in which numbers inside a text go by value, however long, and case does not count.

    An array of (text, digits, number) parts: runs of digits have no text and sort by their number of digits without leading
    zeros, then by these; other runs sort by their text. Numbers come before text.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    bare = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    number = lambda r: F.struct(F.lit("").alias("text"), F.length(bare(r)).alias("digits"), bare(r).alias("number"))
    word = lambda r: F.struct(r.alias("text"), F.lit(0).alias("digits"), F.lit("").alias("number"))
    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(word(r)))


def missing_last(column: str, descending: bool = False, numeric: bool = False) -> list[Column]:
    """Order by a column, texts naturally (``natural_key``), numbers (``numeric``) by value; null and empty values come last either way."""
    c = F.col(column)
    missing = F.coalesce(c.cast("string") == "", F.lit(True))
    key = c if numeric else F.when(~missing, natural_key(c.cast("string")))
    return [missing.asc(), key.desc() if descending else key.asc()]


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of each column; the smallest of equals, null where there is none."""
    return df.agg(*[F.mode(c, deterministic=True).alias(c) for c in columns])


def fill_with(df: DataFrame, values: DataFrame) -> DataFrame:
    """``df`` with nulls filled from the one row of ``values``, column by column."""
    one = F.broadcast(values.select(*[F.col(c).alias(f"{c}_fill_") for c in values.columns]))
    return df.join(one, how="cross").select(*[F.coalesce(F.col(c), F.col(f"{c}_fill_")).alias(c) if c in values.columns else F.col(c) for c in df.columns])


def trimmed_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """An equi-join on pairs of columns whose right side is padded with spaces."""
    return left.join(right, reduce(and_, [left[a] == F.trim(right[b]) for a, b in keys]), how)
