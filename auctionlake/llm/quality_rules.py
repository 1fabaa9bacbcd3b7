"""Quality rules: word and repetition counts, and tokeniser fertility with bands for each language or script."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.llm import vocab
from auctionlake.llm.common import ascii_words, materialize, scratch, texts_of

#: Characters per token and token entropy come from a byte-level vocabulary; the share of fallback bytes in words from one that falls back to bytes.
VOCABULARY, FALLBACK_VOCABULARY = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
REPEAT_WINDOW = 8
#: A document outside median +- WIDTH robust deviations of its language and length class is rejected ...
WIDTH = 4.5
#: ... where a deviation is never taken as less than this: characters per token and bits as shares of the median, the byte share absolutely.
LEAST = {"chars_per_token": 0.02, "token_entropy": 0.02, "byte_share": 0.01}
#: Figures are counted by steps of one in so many, so that medians are exact whatever the order of rows.
STEPS = 250
#: Words whose pieces a task remembers, and the longest of them in bytes.
KNOWN_WORDS, KNOWN_BYTES = 500_000, 64
#: Limits come from so many different texts; a class with fewer also reads the nearest classes of its language, all of them if need be.
MIN_TEXTS = 30
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

METRICS = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "n_tokens": T.LongType(), "chars_per_token": T.DoubleType(), "token_entropy": T.DoubleType(), "n_pieces": T.LongType(), "byte_share": T.DoubleType(), "band": T.StringType()}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``window`` words that stands at two places or more.

    Word numbers are paired into ranks of 2, 4, 8 ... words by sorting, so equal ranks are equal windows.
    """
    n = len(w) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w))
    size = 1
    while size < window:
        step = min(size, window - size)
        _, rank = np.unique(rank[: len(rank) - step] * (len(w) + 1) + rank[step:], return_inverse=True)
        size += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    change = np.zeros(len(w) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


class _Pieces(dict):
    """Pieces of a word << 32 | fallback bytes among them; every distinct word is encoded once, many at a time."""

    def __init__(self, fallback: str):
        self.model, self.is_byte = vocab.pieces(fallback)

    def _encoded(self, words: list[bytes]) -> list[int]:
        ids = self.model.encode([w.decode("utf-8", "surrogatepass") for w in words])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        ends = np.cumsum(sizes)
        return (sizes << 32 | upto[ends] - upto[ends - sizes]).tolist()

    def learn(self, texts: list[list[bytes]]) -> None:
        """Before the words of ``texts`` are asked for; longer ones than KNOWN_BYTES are not kept."""
        if len(self) > KNOWN_WORDS:
            self.clear()
        new = [w for w in set(chain.from_iterable(texts)) if w not in self and len(w) <= KNOWN_BYTES]
        self.update(zip(new, self._encoded(new), strict=True))

    def __missing__(self, word: bytes) -> int:
        return self._encoded([word])[0]

    def of(self, words: list[bytes]) -> tuple[int, float | None]:
        total = sum(map(self.__getitem__, words))
        n = total >> 32
        return n, (total & 0xFFFFFFFF) / n if n else None


@lru_cache(2)
def _pieces(fallback: str) -> _Pieces:
    return _Pieces(fallback)


def fertility(text: str, words: list[bytes], vocabulary: str = VOCABULARY, fallback: str = FALLBACK_VOCABULARY) -> tuple:
    """(tokens, characters per token, entropy in bits, pieces of the words, share of pieces that are fallback bytes); null figures without tokens."""
    n_pieces, share = _pieces(fallback).of(words)
    ids = np.array(vocab.encoding(vocabulary).encode_ordinary(text), np.int64)
    if not len(ids):
        return 0, None, None, n_pieces, share
    ids.sort()
    ends = np.flatnonzero(np.diff(ids, append=-1))
    p = np.diff(ends, prepend=-1) / len(ids)
    return len(ids), len(text) / len(ids), float(-(p * np.log2(p)).sum()), n_pieces, share


def script_of(text: str) -> str:
    """The script of most letters, as their Unicode names begin (LATIN, CYRILLIC, CJK ...); empty without letters. Ties go by name."""
    counts: Counter[str] = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            counts[unicodedata.name(char, "").split(" ")[0]] += n
    return min(counts, key=lambda s: (-counts[s], s), default="")


def measure(df: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, fallback: str = FALLBACK_VOCABULARY) -> DataFrame:
    """Adds the counts and fertility figures of each whole text, and its band: the language or, where that is null, the script.

    A null text counts as an empty one. Every row keeps all its columns, repeated rows too. The result columns
    must not exist yet. Without tokens the figures are null. An empty table gives no rows.
    """
    clash = set(METRICS) & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in METRICS.items())])
    place, lang_at = df.columns.index(text_col), df.columns.index(lang_col)
    kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = texts_of(batch.column(place))
            words = [ascii_words(t) for t in texts]
            _pieces(fallback).learn(words)
            for text, w, lang in zip(texts, words, batch.column(lang_at).to_pylist(), strict=True):
                data = np.frombuffer(b"".join(w), np.uint8)
                lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")] if w else []
                counts = (len(w), int(((data & 0xC0) != 0x80).sum()), int(_SYMBOLS[data].sum()), len(lines) - len(set(lines)), repeated_words(w))
                band = f"script {script_of(text)}" if lang is None else f"language {lang}"
                rows.append((*counts, *fertility(text, w, vocabulary, fallback), band))
            columns = list(zip(*rows, strict=True)) or [()] * len(METRICS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kinds[k]) for c, k in zip(columns, METRICS.values(), strict=True))], [*batch.schema.names, *METRICS])

    return df.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _length_class() -> Column:
    """Half powers of two of tokens."""
    return F.floor(2 * F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int")


def text_key(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text, F.octet_length(text))


def _pooled(one: DataFrame) -> DataFrame:
    """(band, from_class, class): the classes whose texts give a class its limits, the class itself always."""
    counts = materialize(one.groupBy("band", "class").agg(F.count("*").alias("n")), "counts")
    other = counts.select("band", F.col("class").alias("from_class"), F.col("n").alias("from_n"))
    pairs = counts.join(other, "band").withColumn("far", F.abs(F.col("class") - F.col("from_class")))
    nearer = Window.partitionBy("band", "class").orderBy("far").rangeBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("before", F.coalesce(F.sum("from_n").over(nearer), F.lit(0)))
    return materialize(pairs.filter(F.col("before") < MIN_TEXTS).select("band", "from_class", "class"), "pools")


def _median(counted: DataFrame, value: Column, name: str) -> DataFrame:
    """(band, class, figure, name): the lower median of ``value``, an integer, where rows count ``n`` times."""
    keys = ["band", "class", "figure"]
    values = counted.groupBy(*keys, value.alias("value")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return values.withColumn("reached", 2 * upto >= total).filter("reached").groupBy(*keys).agg(F.min("value").alias(name))


def bands(measured: DataFrame, key_col: str, width: float = WIDTH) -> DataFrame:
    """(band, class, lower and upper limits of each figure) by language or script and length class.

    Medians and median deviations over the different texts (``key_col``) that pass the base rules, so copies
    have no more weight than one text. Figures of short texts scatter more, so documents are compared with
    those of their own length class, and of the nearest ones where these are too few. All comes from counts
    of figures in steps, whose number does not grow with the documents.
    """
    passed = measured.filter(~base_failed() & (F.col("n_tokens") > 0))
    one = passed.groupBy("band", _length_class().alias("class"), F.col(key_col).alias("key")).agg(*(F.first(c).alias(c) for c in LEAST))
    one = materialize(one.drop("key"), "texts")
    figures = F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.floor(F.coalesce(c, F.lit(0.0)) * STEPS).alias("step")) for c in LEAST)))
    counted = materialize(one.select("band", F.col("class").alias("from_class"), figures.alias("f")).groupBy("band", "from_class", "f.figure", "f.step").agg(F.count("*").alias("n")), "steps")
    pooled = counted.join(_pooled(one), ["band", "from_class"]).groupBy("band", "class", "figure", "step").agg(F.sum("n").alias("n"))
    pooled = materialize(pooled, "pooled")
    middle = materialize(_median(pooled, F.col("step"), "middle"), "medians")
    keys = ["band", "class", "figure"]
    away = _median(pooled.join(middle, keys), F.abs(F.col("step") - F.col("middle")), "away")
    middle_value, away_value = (F.col(c) / STEPS for c in ("middle", "away"))
    least = F.coalesce(*(F.when(F.col("figure") == c, F.lit(x) if c == "byte_share" else x * middle_value) for c, x in LEAST.items()))
    dev = width * F.greatest(1.4826 * away_value, least)
    each = middle.join(away, keys).select(*keys, (middle_value - dev).alias("low"), (middle_value + dev).alias("high"))
    limits = [F.max(F.when(F.col("figure") == c, F.col(end))).alias(f"{c}_{end}") for c in LEAST for end in ("low", "high")]
    return materialize(each.groupBy("band", "class").agg(*limits), "bands", keep=True)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept to what ``measure`` gives. A document without limits (no such class) is judged by the base rules.

    A figure that is null is within its limits; ties with a limit are kept. Rows are neither merged nor dropped.
    """
    known = measured.columns
    joined = measured.withColumn("class_of_length", _length_class()).join(limits.withColumnRenamed("class", "class_of_length"), ["band", "class_of_length"], "left")
    inside = F.lit(True)
    for c in LEAST:
        inside = inside & F.coalesce(F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")), F.lit(True))
    failed = base_failed()
    return joined.select(*known, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def _judged(df: DataFrame, text: str, lang: str, vocabulary: str, keep_text: bool) -> DataFrame:
    """Every row of ``df`` (columns c0, c1 ...) with its figures and verdict. Texts are measured once; they never shuffle."""
    with scratch(df.sparkSession):
        measured = measure(df, text, lang, vocabulary).withColumn("text_key", text_key(text))
        measured = materialize(measured if keep_text else measured.drop(text), "measured", keep=True)
        return judge(measured.drop("text_key"), bands(measured, "text_key"))


def _numbered(df: DataFrame) -> DataFrame:
    """Columns under names that clash with nothing; ``df`` may have any."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts, verdict, language and figures of each document, without its text.

    Null and empty texts have no words and fail the base rules; a null language is judged by script. Repeated
    rows and null ids give a row each with the same verdict; an empty table gives none; other columns are not read.
    """
    judged = _judged(_numbered(df.select(id_col, lang_col, text_col)), "c2", "c1", vocabulary, False)
    more = [c for c in METRICS if c not in BASE]
    return judged.select(F.col("c0").alias(id_col), *BASE, "base_failed", "kept", F.col("c1").alias(lang_col), *more)


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``df`` that pass, with their own columns, whatever their names.

    Null and empty texts go; repeated rows stay or go together; an empty table gives no rows.
    """
    n = _numbered(df)
    judged = _judged(n, f"c{df.columns.index(text_col)}", f"c{df.columns.index(lang_col)}", vocabulary, True)
    return judged.filter("kept").select(*n.columns).toDF(*df.columns)
