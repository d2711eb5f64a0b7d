"""Repeated passages across documents, found by winnowing line hashes and cut from later copies.

A *line* is a piece of text up to a line break or the end of a sentence (a stop with any closing
quotes or brackets, then a blank), with all the blanks and empty lines behind it.
Lines are hashed.  A gram is the run of lines that starts at a line and reaches ``GRAM_WORDS``
words.  Every stretch of ``SURE_WORDS`` words contributes its smallest gram hash, so any two
places that share that many words in whole lines share a fingerprint.  The first place of a
fingerprint (by doc_id, text hash, line) is its original; each other place is compared with
the original line by line to both sides, and the equal run there is cut.  So of every repeat
of ``SURE_WORDS`` words at least one gram goes, and all of it unless a part of it is older
than the whole: then the part is compared with its own, shorter original.

A fingerprint shared by a third of all places costs one row per place: places meet only the
original, never each other.  Between two fingerprints of one run lie less than ``SURE_WORDS``
words, so comparing that far to both sides finds whole runs.

Everything is DataFrame functions.

Defined cases: null text stays null and takes no part; text without words stays as it is; rows equal
in id and text count as one document and are treated alike; ids that repeat with other texts
are documents of their own; null ids come first in the order; other columns pass through
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .rows import ROW, SPACE, field, let, packed

GRAM_WORDS = 25
SURE_WORDS = 50

# Signs that close a quotation or a bracket.
_CLOSERS = "\"')\\]}\u00bb\u2019\u201d"
_STOP = rf"[.!?][{_CLOSERS}]*+[{SPACE}]"
_LINE = rf"[^\n.!?]*+(?:(?!{_STOP})[.!?][^\n.!?]*+)*+(?:\n[{SPACE}]*+|{_STOP}[{SPACE}]*+|\z)"
_WORD = f"[^{SPACE}]+"


def pieces(text: Column) -> Column:
    """The lines of a text; joined, they are the text again."""
    return F.filter(F.regexp_extract_all(text, F.lit(_LINE), F.lit(0)), lambda u: u != "")


def lined(keyed: DataFrame) -> DataFrame:
    """Per document: the hash ``h`` and word count ``c`` of every line."""

    def measured(us: Column) -> Column:
        return F.struct(
            F.transform(us, lambda u: F.xxhash64(F.btrim(u, F.lit(" \t\n\x0b\f\r")))).alias("h"),
            F.transform(us, lambda u: F.regexp_count(u, F.lit(_WORD))).alias("c"),
        )

    lines = let(pieces(F.col("text")), measured)
    return keyed.where(F.col("text").isNotNull()).select("id", "th", lines.alias("l")).select("id", "th", "l.h", "l.c")


def fingerprints(lines: DataFrame, gram_words: int = GRAM_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """Selected grams: ``g``, document, first line ``p`` and number of lines ``n``.

    Frames over word offsets, one document at a time; a run of ``sure_words`` words holds a
    whole window of ``sure_words - gram_words`` gram starts, hence its smallest gram.
    """
    units = (
        lines.withColumn("r", F.monotonically_increasing_id())
        .select("r", "id", "th", F.posexplode(F.arrays_zip("h", "c")).alias("p", "u"))
        .where(F.col("u.c") > 0)
        .select("r", "id", "th", "p", F.col("u.h").alias("h"), F.col("u.c").alias("c"))
    )
    order = Window.partitionBy("r").orderBy("p")
    at = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at")
    by_word = Window.partitionBy("r").orderBy("at")
    gram = by_word.rangeBetween(0, gram_words - 1)
    grams = (
        units.select("*", at)
        .select(
            "r", "id", "th", "p", "at",
            F.collect_list("h").over(gram).alias("hs"),
            (F.sum("c").over(gram) >= gram_words).alias("whole"),
            (F.sum("c").over(by_word.rangeBetween(0, sure_words - 1)) >= sure_words).alias("sure"),
        )
        .select(
            "r", "id", "th", "p", "at", "sure",
            F.when(F.col("whole"), F.struct(F.xxhash64("hs").alias("g"), "at", "p", F.size("hs").alias("n"))).alias("x"),
        )
    )
    least = F.min("x").over(by_word.rangeBetween(0, sure_words - gram_words))
    picked = grams.select("r", "id", "th", "at", "sure", least.alias("x")).where("sure")
    before = F.lag("x.p").over(by_word)
    return (
        picked.select("id", "th", "x", before.alias("before"))
        .where(~F.col("before").eqNullSafe(F.col("x.p")))
        .select("x.g", "id", "th", "x.p", "x.n")
    )


def originals(seeds: DataFrame) -> DataFrame:
    """First place of every fingerprint that has more than one."""
    return (
        seeds.groupBy("g")
        .agg(F.min(F.struct("id", "th", "p", "n")).alias("o"), F.count(F.lit(1)).alias("places"))
        .where("places > 1")
        .select("g", F.col("o.id").alias("oid"), F.col("o.th").alias("oth"), F.col("o.p").alias("op"), F.col("o.n").alias("on_"))
    )


def _reach(hashes: Column, counts: Column, words: int) -> Column:
    """The leading hashes whose lines together hold at least ``words`` words."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    taken = F.aggregate(
        counts,
        start,
        lambda acc, c: F.when(acc["w"] >= words, acc).otherwise(
            F.struct((acc["w"] + c).alias("w"), (acc["n"] + 1).alias("n"))
        ),
    )
    return F.slice(hashes, F.lit(1), taken["n"])


def _before(lines: str, p: Column, n: Column | int) -> Column:
    """Up to ``n`` elements before place ``p``, nearest first."""
    return F.reverse(F.slice(lines, F.greatest(p - n, F.lit(0)) + 1, F.least(p, F.lit(n) if isinstance(n, int) else n)))


def _after(lines: str, p: Column, n: Column | int) -> Column:
    return F.slice(lines, p + 1, F.lit(n) if isinstance(n, int) else n)


def _equal_lead(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(F.array_position(same, False), lambda k: F.when(k > 0, k - 1).otherwise(F.size(a))).cast("int")


def repeats(keyed: DataFrame, gram_words: int = GRAM_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """Runs of lines to cut: document and merged intervals ``cuts`` (first and last line).

    ``keyed`` has ``id``, ``th`` (text hash) and ``text``.  Joins sort and merge at every size.
    """
    lines = materialize(lined(keyed), "dedup-lines")
    seeds = materialize(fingerprints(lines, gram_words, sure_words), "dedup-seeds")
    firsts = materialize(originals(seeds), "dedup-originals").hint("merge")
    docs = lines.dropDuplicates(["id", "th"])
    p, end = F.col("op"), F.col("op") + F.col("on_")
    sources = materialize(
        firsts.join(docs, firsts.oid.eqNullSafe(docs.id) & (firsts.oth == docs.th)).select(
            "g", "oid", "oth", "op",
            _reach(_before("h", p, sure_words), _before("c", p, sure_words), sure_words).alias("ol"),
            _reach(_after("h", end, sure_words), _after("c", end, sure_words), sure_words).alias("or_"),
        ),
        "dedup-sources",
    ).hint("merge")
    itself = F.col("id").eqNullSafe(F.col("oid")) & (F.col("th") == F.col("oth")) & (F.col("p") == F.col("op"))
    places = seeds.join(sources, "g").where(~itself).select(F.col("id").alias("pid"), F.col("th").alias("pth"), "p", "n", "ol", "or_")
    docs = docs.select("id", "th", "h")
    p, end = F.col("p"), F.col("p") + F.col("n")
    runs = places.hint("merge").join(docs, F.col("pid").eqNullSafe(docs.id) & (F.col("pth") == docs.th)).select(
        "id", "th",
        (p - _equal_lead(F.col("ol"), _before("h", p, F.size("ol")))).alias("a"),
        (end - 1 + _equal_lead(F.col("or_"), _after("h", end, F.size("or_")))).alias("b"),
    )
    return runs.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs")).select(
        "id", "th", _merged(F.col("runs")).alias("cuts")
    )


def _merged(runs: Column) -> Column:
    """Sorted intervals with overlapping and touching ones joined."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        return F.when(
            F.coalesce(x["a"] <= last["b"] + 1, F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)),
        ).otherwise(F.array_append(acc, x))

    return F.aggregate(runs, none, add)


def dedup(df: DataFrame, id_column: str = "doc_id", gram_words: int = GRAM_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """The rows (packed) with ``text`` freed of repeated runs, ``cuts`` and ``words_cut``."""
    rows = packed(df).select(ROW, field(id_column).alias("id"), F.xxhash64(field("text")).alias("th"))
    cuts = repeats(rows.select("id", "th", field("text").alias("text")), gram_words, sure_words)
    cuts = materialize(cuts.withColumnsRenamed({"id": "cid", "th": "cth"}), "dedup-cuts").hint("merge")

    def split_up(us: Column) -> Column:
        inside = lambda i: F.exists(F.col("cuts"), lambda c: i.between(c["a"], c["b"]))
        return F.struct(
            F.array_join(F.filter(us, lambda u, i: ~inside(i)), "").alias("text"),
            F.regexp_count(F.array_join(F.filter(us, lambda u, i: inside(i)), ""), F.lit(_WORD)).cast("long").alias("words"),
        )

    parted = F.when(F.col("cuts").isNotNull(), let(pieces(field("text")), split_up))
    return (
        rows.join(cuts, F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
        .select(ROW, "cuts", parted.alias("parts"))
        .select(
            ROW,
            F.when(F.col("cuts").isNotNull(), F.col("parts.text")).otherwise(field("text")).alias("text"),
            F.coalesce("cuts", F.array().cast("array<struct<a:int,b:int>>")).alias("cuts"),
            F.coalesce("parts.words", F.lit(0)).cast("long").alias("words_cut"),
        )
    )
