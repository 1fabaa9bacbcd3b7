"""Upserts, appends and flags as pure functions from tables to the table that replaces them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.functions.text import content_hash

#: How a column of a row that exists on both sides is decided.
RULES = {
    "overwrite": lambda old, new: new,
    "keep": lambda old, new: F.coalesce(old, new),
    "prefer_new": lambda old, new: F.coalesce(new, old),
    "greatest": lambda old, new: F.greatest(old, new),
    "least": lambda old, new: F.least(old, new),
    "insert_only": lambda old, new: old,
}


def merge_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], rules: Mapping[str, str], frozen: Column | None = None) -> DataFrame:
    """``existing`` with ``incoming`` merged in, column by column; each key is there once on either side.

    Rows on one side only are taken as they are. ``frozen`` (over columns of the existing row, named
    ``old.<column>``) keeps decided rows as they were. One full outer join; both sides have the same columns.
    """
    old = existing.withColumn("in_", F.lit(True)).alias("old")
    new = incoming.withColumn("in_", F.lit(True)).alias("new")
    on = reduce(and_, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    both = F.col("old.in_").isNotNull() & F.col("new.in_").isNotNull()
    if frozen is not None:
        both = both & ~F.coalesce(frozen, F.lit(False))
    columns = []
    for c in existing.columns:
        o, n = F.col(f"old.{c}"), F.col(f"new.{c}")
        merged = F.coalesce(o, n) if c in keys else RULES[rules[c]](o, n)
        columns.append(F.when(both, merged).when(F.col("old.in_").isNotNull(), o).otherwise(n).alias(c))
    return old.join(new, on, "full_outer").select(*columns)


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``incoming``, one for each key, whose key ``existing`` does not have. Nulls equal nulls."""
    return _anti(incoming.dropDuplicates(list(keys)), existing, keys)


def _anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = right.select(*[F.col(k).alias(f"k_{k}") for k in keys])
    return left.join(known, reduce(and_, [left[k].eqNullSafe(known[f"k_{k}"]) for k in keys]), "left_anti")


def content_addressed(incoming: DataFrame, payload: Sequence[str], name: str = "content_hash") -> DataFrame:
    """Adds the SHA-256 of the payload columns, in name order, as one JSON text."""
    return incoming.withColumn(name, content_hash(*[F.col(c) for c in sorted(payload)]))


def replace_set(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` without the rows of any key that ``incoming`` has, and all of ``incoming``."""
    return _anti(existing, incoming, keys).unionByName(incoming)


def flag_current(versions: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "is_current") -> DataFrame:
    """Adds whether a row is its key's latest by ``order`` (a total order). The latest comes from an aggregate, not a sort."""
    latest = versions.groupBy(*keys).agg(F.max(F.struct(*order)).alias("latest_"))
    latest = latest.select(*[F.col(k).alias(f"k_{k}") for k in keys], "latest_")
    on = reduce(and_, [versions[k].eqNullSafe(latest[f"k_{k}"]) for k in keys])
    return versions.join(latest, on).withColumn(name, F.struct(*order) == F.col("latest_")).drop("latest_", *[f"k_{k}" for k in keys])


def flag_unless_stronger(existing: DataFrame, incoming: DataFrame, key: str, provider_col: str, provider: str, flag: str = "is_current") -> DataFrame:
    """A provider's new rows replace its own current ones and are current only where no other provider's is."""
    others = existing.filter(F.col(flag) & (F.col(provider_col) != provider)).select(F.col(key).alias("k_")).distinct()
    renewed = incoming.select(F.col(key).alias("n_")).distinct()
    cleared = existing.join(renewed, existing[key] == F.col("n_"), "left").withColumn(flag, F.col(flag) & ~((F.col(provider_col) == provider) & F.col("n_").isNotNull())).drop("n_")
    fresh = incoming.join(others, incoming[key] == F.col("k_"), "left").withColumn(flag, F.col("k_").isNull()).drop("k_")
    return cleared.unionByName(fresh.select(*existing.columns))


def decide(candidates: DataFrame, chosen: DataFrame, group: str, id_col: str, status: str = "review_status") -> DataFrame:
    """Pending candidates of a decided group: the chosen one APPROVED, the others REJECTED. Decided rows stay."""
    picked = chosen.select(F.col(group).alias("g_"), F.col(id_col).alias("c_"))
    joined = candidates.join(picked, candidates[group] == F.col("g_"), "left")
    new = F.when(F.col("c_").isNull() | (F.col(status) != "PENDING"), F.col(status)).when(F.col(id_col) == F.col("c_"), "APPROVED").otherwise("REJECTED")
    return joined.withColumn(status, new).drop("g_", "c_")


def fill_nulls(target: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``target`` with null columns filled from ``values`` by key; what is there stays."""
    v = values.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"v_{c}") for c in columns])
    joined = target.join(v, reduce(and_, [target[k] == v[f"k_{k}"] for k in keys]), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"v_{c}")).alias(c) if c in columns else F.col(c) for c in target.columns])


def split_rejects(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): a row goes to the rejects with the first rule that it meets as its reason."""
    reason = F.coalesce(*[F.when(rule, F.lit(label)) for rule, label in rules])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a contract, one for each rule broken; a null is no breach."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("rule", F.explode(broken))
