"""Licence texts and notices inside documents, by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, everything but letters and digits a
space.  A text is read in lines (to a line break or the end of a sentence).  A line is a
*part* of a template if at least half of its distinct bigrams are the template's; runs of parts, with
gaps of at most one line, are the candidates.  A candidate is compared with its template only
if its number of bigrams lies within the bounds that the least Dice coefficient allows, and
reported if the coefficient over distinct bigrams reaches ``LEAST_DICE``.  Of the templates
that a run of lines fits, the best is reported, once for every run.

Texts are pruned first, without loss: a run with a Dice coefficient of ``t`` shares at least
``t / (2 - t)`` of its template's bigrams.  For each template, long words and then bigrams are
chosen until the bigrams without any of them are fewer than that; texts without one are out.

Everything is DataFrame functions; the templates are a fixed list that goes with every task.

Defined cases: null and empty texts have no licence; texts of any length are read whole;
repeated rows are reported each; ids may be null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .rows import SPACE, let
from .license_texts import templates

LEAST_DICE = 0.8
LEAST_PART = 0.5
#: Words of at least this many letters are anchors before bigrams are.
ANCHOR_LETTERS = 7

_CUT = rf"(?<=[{SPACE}])(?=[^{SPACE}])(?<=[.!?\n][\x20\x09]?)"


def normal_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def anchors(least: float = LEAST_DICE) -> tuple[list[str], list[str]]:
    """Words and bigrams of which every text with a licence has one."""
    words_chosen: set[str] = set()
    pairs_chosen: set[str] = set()
    for _, _, text in templates():
        free = {p for p in pairs(normal_words(text)) if not words_chosen & set(p.split())} - pairs_chosen
        need = least / (2 - least) * len(pairs(normal_words(text)))
        long = {w for w in normal_words(text) if len(w) >= ANCHOR_LETTERS}
        for w in sorted(long, key=lambda w: (-len(w), w)):
            if len(free) < need:
                break
            words_chosen.add(w)
            free = {p for p in free if w not in p.split()}
        while len(free) >= need:
            pairs_chosen.add(max(free, key=lambda p: (len(p), p)))
            free -= pairs_chosen
    return sorted(words_chosen), sorted(pairs_chosen)


def suspects(text: Column, least: float = LEAST_DICE) -> Column:
    """Whether a text has an anchor."""
    words, two = anchors(least)
    low = F.lower(text)
    found = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    if two:
        found = found | low.rlike("|".join(p.replace(" ", r"[^\p{L}\p{N}]+") for p in two))
    return found


def word_pairs(text: Column) -> Column:
    """Distinct bigrams of the normalised text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.array_distinct(
        F.transform(F.slice(w, F.lit(2), F.size(w)), lambda b, i: F.concat_ws(" ", F.get(w, i), b))
    )
    return let(words, of)


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(key, name, len(p), sorted(p)) for key, name, text in templates() for p in [pairs(normal_words(text))]]
    return spark.createDataFrame(rows, "template string, license string, n int, pairs array<string>")


def find(docs: DataFrame, least: float = LEAST_DICE) -> DataFrame:
    """``doc_id``, ``license``, ``template``, ``dice``, lines ``first`` and ``last``, per run of lines."""
    spark = docs.sparkSession
    lined = docs.select("doc_id", "text").where(suspects(F.col("text"), least)).select("doc_id", F.split("text", _CUT).alias("lines"))
    lined = materialize(lined.withColumn("r", F.monotonically_increasing_id()), "license-lines")
    known = template_table(spark)
    of_pair = known.select("template", F.explode("pairs").alias("pair"))  # some thousand rows, whatever the input

    lines = lined.select("r", F.posexplode("lines").alias("i", "line")).select("r", "i", word_pairs(F.col("line")).alias("p"))
    shared = (
        lines.select("r", "i", F.size("p").alias("n"), F.explode("p").alias("pair"))
        .join(F.broadcast(of_pair), "pair")
        .groupBy("r", "i", "template", "n")
        .agg(F.count(F.lit(1)).alias("k"))
        .where(F.col("k") >= LEAST_PART * F.col("n"))
        .select("r", "template", "i")
    )
    order = Window.partitionBy("r", "template").orderBy("i")
    fresh = F.coalesce((F.col("i") - F.lag("i").over(order) > 2).cast("int"), F.lit(1))
    runs = (
        shared.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(order))
        .groupBy("r", "template", "run")
        .agg(F.min("i").alias("first"), F.max("i").alias("last"))
    )
    found = lined.join(runs, "r").select(
        "r", "doc_id", "template", "first", "last",
        word_pairs(F.array_join(F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first") + 1), " ")).alias("p"),
    )
    m = F.size("p")
    fits = m.between(least / (2 - least) * F.col("n"), (2 - least) / least * F.col("n"))
    dice = 2 * F.size(F.array_intersect("p", "pairs")) / (m + F.col("n"))
    scored = (
        found.join(F.broadcast(known), "template")
        .where(fits)
        .select("r", "doc_id", "license", "template", F.round(dice, 6).alias("dice"), "first", "last")
        .where(F.col("dice") >= least)
    )
    best = F.max_by(
        F.struct("doc_id", "license", "template", "dice", "last"), F.struct("dice", F.col("last") - F.col("first"), "template")
    )
    return scored.groupBy("r", "first").agg(best.alias("b")).select("b.doc_id", "b.license", "b.template", "b.dice", "first", "b.last")
