"""Tokens: lossless split, vocabulary, encode, decode, length limit, padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import vocabulary_rank
from ..session import materialize

# The special tokens and their ids, in order.
SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")
PAD_ID, BOS_ID, EOS_ID, UNK_ID = range(4)

#: Most frequent tokens that are shipped to every task instead of being join keys.
HOT = 1024

#: Default token pattern: a word, a run of digits, or any single other character.
TOKEN_PATTERN = r"([a-z]+|[0-9]+|[^a-z0-9])"


def tokenize(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def is_lossless(text: Column, tokens: Column) -> Column:
    return F.array_join(tokens, "") == text


def tokenize_strict(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Tokens that rejoin to the text; anything else is an error."""
    tokens = tokenize(text, pattern)
    return F.when(is_lossless(text, tokens), tokens).otherwise(
        F.raise_error(F.concat(F.lit("tokens do not rejoin to: "), text)).cast("array<string>")
    )


def build_vocabulary(df: DataFrame, tokens: str, min_count: int = 1) -> DataFrame:
    """``token, n, id``: specials lead, then the kept tokens in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pc.value_counts(b.column(0).flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["token", "k"])

    # Repeats are counted inside the batch, so a token moves once per batch at most.
    counted = df.select(tokens).mapInArrow(run, "token string, k long").groupBy("token").agg(F.sum("k").cast("long").alias("n"))
    counted = materialize(counted.filter((F.col("n") >= min_count) & ~F.col("token").isin(*SPECIALS)), "counted")
    ranked = vocabulary_rank(counted, "token").select(
        "token", "n", (F.col("rank") - 1 + len(SPECIALS)).cast("long").alias("id")
    )
    spark = df.sparkSession
    head = spark.createDataFrame(
        [(t, 0, i) for i, t in enumerate(SPECIALS)], "token string, n long, id long"
    )
    return head.unionByName(ranked)


def _dictionary(df: DataFrame, item: str, values: str) -> DataFrame:
    """``item, names, place``: the distinct values of every row, and each value's place among them."""
    schema = T.StructType(
        [df.schema[item], T.StructField("names", df.schema[values].dataType), T.StructField("place", T.ArrayType(T.IntegerType()))]
    )

    def lists(counts: np.ndarray, flat: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = b.column(1).flatten().dictionary_encode(null_encoding="encode")
            width = max(1, len(coded.dictionary))
            row = np.repeat(np.arange(len(length)), length)
            pairs, inverse = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            distinct = np.bincount(pairs // width, minlength=len(length))
            place = inverse - (np.cumsum(distinct) - distinct)[row]
            names = lists(distinct, coded.dictionary.take(pa.array(pairs % width)))
            yield pa.RecordBatch.from_arrays([b.column(0), names, lists(length, pa.array(place.astype(np.int32)))], names=schema.names)

    return materialize(df.select(item, values).mapInArrow(run, schema), "dictionary")


def _replaced(df: DataFrame, item: str, values: str, names: DataFrame, missing: Column) -> DataFrame:
    """``item, codes``: the code of every value of the item, in the order of the values.

    ``names`` holds ``name, code, n``.  Frequent names, which would be hot join keys, are a
    broadcast of at most ``HOT`` rows; all others are joined, once per item that holds them.  The
    occurrences stay in their row as places among its distinct values.
    """
    rows = _dictionary(df, item, values)
    hot = F.broadcast(names.orderBy(F.desc("n"), "name").limit(HOT).select("name", F.col("code").alias("hot")))
    parts = rows.select(item, F.posexplode("names").alias("at", "name")).join(hot, "name", "left")
    rest = parts.filter(F.col("hot").isNull()).join(names.select("name", "code"), "name", "left")
    found = parts.filter(F.col("hot").isNotNull()).withColumnRenamed("hot", "code").unionByName(rest.drop("hot"))
    listed = found.groupBy(item).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("__c"))
    code = lambda p: F.coalesce(F.get(F.col("__c.code"), p), missing)
    return rows.select(item, "place").join(listed, item, "left").select(item, F.transform("place", code).alias("codes"))


def encode(
    df: DataFrame, item: str, tokens: str, vocab: DataFrame, *, add_special: bool = True
) -> DataFrame:
    """``item, ids``: unknown tokens become ``<unk>``.

    The vocabulary grows with the corpus, so it is joined, by each item's distinct tokens; the
    occurrences stay in their row.  ``vocab`` holds ``token, n, id``.
    """
    names = materialize(vocab.select(F.col("token").alias("name"), F.col("id").alias("code"), "n"), "vocabulary")
    coded = _replaced(df, item, tokens, names, F.lit(UNK_ID).cast("long"))
    ids = coded.select(item, F.col("codes").alias("ids"))
    if not add_special:
        return ids
    return ids.withColumn(
        "ids",
        F.concat(
            F.array(F.lit(BOS_ID).cast("long")), F.col("ids"), F.array(F.lit(EOS_ID).cast("long"))
        ),
    )


def decode(df: DataFrame, item: str, ids: str, vocab: DataFrame) -> DataFrame:
    """``item, text``: stop at the first ``<eos>`` and drop specials; ids without a token are left out."""
    stop = F.array_position(F.col(ids), F.lit(EOS_ID).cast("long"))
    body = F.when(stop > 0, F.slice(F.col(ids), F.lit(1), (stop - 1).cast("int"))).otherwise(
        F.col(ids)
    )
    kept = F.filter(body, lambda i: ~i.isin(PAD_ID, BOS_ID, UNK_ID))
    names = materialize(vocab.select(F.col("id").alias("name"), F.col("token").alias("code"), "n"), "vocabulary")
    rows = df.select(item, F.coalesce(kept, F.array().cast("array<bigint>")).alias("__v"))
    parts = _replaced(rows, item, "__v", names, F.lit(""))
    return parts.select(item, F.array_join("codes", "").alias("text"))


def limit_length(ids: Column, fallback: Column, limit: int) -> Column:
    """Use ``fallback`` when too long, and cut that one if it is too long as well."""
    chosen = F.when(F.size(ids) > limit, fallback).otherwise(ids)
    return F.slice(chosen, 1, limit)


def pad_to(values: Column, width: Column, fill: int) -> Column:
    missing = F.greatest(width - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(fill).cast("long"), missing))


def pad_mask(values: Column, width: Column) -> Column:
    """True where a real entry sits."""
    return F.transform(F.sequence(F.lit(1), width), lambda i: i <= F.size(values))
