"""A training corpus from raw documents: the stages in order, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from auctionlake.llm.common import fresh, materialize, scratch, table

# All stages take empty tables, repeated rows, null ids and further columns of any name, and keep rows' own
# columns; what null and empty texts become is said at each.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with a null or empty text among them."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document left without any text goes with them. Null and empty texts have no lines and stay."""
    names = tuple(fresh(docs, "n_lines", "n_dropped"))
    done = line_dedup.drop_repeated_lines(docs, counts=names)
    lost = F.col(names[1]) > 0
    left = done.filter(~lost | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, Jaccard similarity 0.8.

    The smallest id stays; null, empty and wordless texts are copies of nothing.
    """
    return jaccard_join.keep_one(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have none."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; a null or empty text has none."""
    return byte_bpe.encode(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_copies), ("decontamination", benchmark), ("byte_bpe", tokens)]

#: Tokenisation and fertility have no SQL; the whole is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; a stage's table is deleted once the last one's input is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name, keep=name == STAGES[-2][0])
    return STAGES[-1][1](spark, docs, sf_dir)
