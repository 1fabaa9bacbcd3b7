"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.llm.common import UPPER_TO_LOWER, fresh, materialize, rank_within, texts_of

BUCKETS = 10_000
#: The target model is fitted on at most this many labelled documents (those with the smallest hashed ids).
MAX_TARGET = 20_000
#: Weights are those of a passage of so many n-grams with the document's mean ratio: length alone decides nothing.
#: None gives the ratio of the two models for the whole document, by which short ones are drawn almost at random.
PASSAGE = 200


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Features:
    """Counts of a text's words and word pairs by hash bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known = _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        w = text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()
        if len(self.known) > 1_000_000:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, w), np.uint64, len(w))
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x165667B19E3779F9))
            pairs ^= pairs >> np.uint64(31)
        return (np.concatenate([h, pairs]) % np.uint64(self.buckets)).astype(np.int64)


def target_ids(labels: DataFrame, id_col: str, label_col: str, limit: int) -> list:
    """Up to ``limit`` labelled target documents: a bounded sample for fitting, chosen by hashed id."""
    good = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    return [r[0] for r in good.orderBy(F.xxhash64(id_col), id_col).limit(limit).collect()]


def log_ratios(docs: DataFrame, targets: list, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability of each bucket. The raw model counts every document; both are smoothed by one."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, good = Features(buckets), wanted.value
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [features(t) for t in texts_of(batch.column(1))]
            raw += np.bincount(np.concatenate(found), minlength=buckets) if found else 0
            if chosen := [f for i, f in zip(ids, found, strict=True) if i in good]:
                target += np.bincount(np.concatenate(chosen), minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counts = docs.select(id_col, text_col).mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in counts.collect():  # as many rows as there are buckets at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", log_weight: str = "log_weight", n_features: str = "n_features", passage: int | None = PASSAGE) -> DataFrame:
    """Adds each whole text's log importance weight and number of n-grams; other columns stay as they are.

    The weight is the sum of its n-grams' log ratios, brought to the length of a ``passage`` unless that is
    None. Null texts and those without words weigh 0. The two names must be new.
    """
    if {log_weight.lower(), n_features.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{log_weight} or {n_features} is a column already")
    table = docs.sparkSession.sparkContext.broadcast(ratios)
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_features, T.LongType()), T.StructField(log_weight, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        features = Features(len(ratio))
        for batch in batches:
            found = [features(t) for t in texts_of(batch.column(place))]
            n = pa.array([len(f) for f in found], pa.int64())
            weights = pa.array([float(ratio[f].sum()) * (passage / len(f) if passage else 1.0) if len(f) else 0.0 for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n, weights], [*batch.schema.names, n_features, log_weight])

    return docs.mapInArrow(run, schema)


def gumbel_top_k(scored: DataFrame, weight_col: str, key_col: str, k: int, seed: int = 0, out_col: str = "selected") -> DataFrame:
    """Adds whether a row is among the ``k`` with the largest weight plus Gumbel noise: a sample without replacement.

    The noise comes from the row's key and the seed, so reruns agree on any partitioning; rows of one key share
    their noise, and of equal sums the smaller keys come first. Equal rows are interchangeable.
    Quantiles bracket the k-th value; only rows inside the bracket are ranked.
    """
    noisy, row, rank = fresh(scored, "noisy", "row", "rank")
    u = (F.pmod(F.xxhash64(F.col(key_col), F.lit(seed)), F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    d = materialize(scored.withColumn(noisy, F.col(weight_col) - F.log(-F.log(u))).withColumn(row, F.monotonically_increasing_id()), "noisy")
    n = d.count()
    if k >= n or k <= 0:
        return d.withColumn(out_col, F.lit(k >= n and n > 0)).drop(noisy, row)
    at = 1 - k / n
    low, high = d.agg(F.percentile_approx(noisy, [max(0.0, at - 0.002), min(1.0, at + 0.002)], 10_000).alias("q")).first()["q"]
    above = d.filter(F.col(noisy) > high).count()
    reached = d.filter(F.col(noisy) >= low).count()
    if above > k or reached < k:  # the quantiles missed: rank everything
        low, high, above, reached = float("-inf"), float("inf"), 0, n
    between = d.filter((F.col(noisy) >= low) & (F.col(noisy) <= high)).select(row, noisy, key_col)
    span = (high - low) or 1.0
    place = F.floor((F.lit(high) - F.col(noisy)) / span * 1_000_000).cast("long") if np.isfinite(span) else F.lit(0).cast("long")
    size = max(1, reached - above)
    spread = F.floor(place * max(1, -(-size // 50_000)) / 1_000_001).cast("long")
    ranked = rank_within(between.withColumn("all_", F.lit(0)), "all_", [F.desc(noisy), key_col, row], spread, size, rank)
    chosen = ranked.filter(F.col(rank) < k - above).select(F.col(row).alias("r_"))
    joined = d.join(chosen, d[row] == F.col("r_"), "left")
    return joined.select(*scored.columns, ((F.col(noisy) > high) | F.col("r_").isNotNull()).alias(out_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None, buckets: int = BUCKETS, max_target: int = MAX_TARGET, seed: int = 0, passage: int | None = PASSAGE) -> DataFrame:
    """(id, n_features, log_weight, selected) of every document.

    ``share`` of all documents is sampled; by default that of good ones among the labelled. Null texts and
    texts without words have weight 0. Repeated rows and null ids give a row each. Without labelled good
    documents the two models differ by smoothing alone. An empty table gives no rows.
    """
    if share is None:
        found = labels.agg(F.avg((F.col(label_col) == 1).cast("double")).alias("share")).first()["share"]
        share = 1.0 if found is None else found
    ratios = log_ratios(docs, target_ids(labels, id_col, label_col, max_target), id_col, text_col, buckets)
    scored = score(docs.select(id_col, text_col), ratios, text_col, passage=passage).drop(text_col)
    scored = materialize(scored, "scored")
    return gumbel_top_k(scored, "log_weight", id_col, round(share * scored.count()), seed)
