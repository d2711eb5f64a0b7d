"""Quality rules whose cutoffs come from quantile sketches per language and source.

Each text gets a few whole-number metrics.  A sketch is a table of counts per
(language, source, metric, bucket); buckets grow by 1/32 of their value, so two sketches
merge by adding counts and every quantile is right to about 3 %.  From the sketches come
one fence per group and metric; groups under ``MIN_GROUP`` rows take the sketch of their
language, then of the whole corpus.  Verdicts come from a join with the fences.

Everything is DataFrame functions, whole numbers throughout, so reruns and other engines
agree to the last row.

Defined cases: null and empty text have no words and fail; null language or source is a
group of its own; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import ROW, SPACE, field, let, packed, whole_text, within_broadcast

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A group with fewer rows than this takes its thresholds from the next wider group.
MIN_GROUP = 100
#: Fences lie this many spreads (median less 10th percentile) beyond the median.
SPREADS = 6
#: Least distance of a fence from the median: per mille of words, lines or characters;
#: word length in hundredths of a character.
SLACK = {"symbols": 100, "dup_lines": 400, "upper": 300, "word_length": 100}
METRICS = tuple(SLACK)
#: Groups up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words inside a ``WINDOW``-word window that occurs twice or more in the text."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = F.transform(
                s,
                lambda x, k: F.when(
                    ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                ),
            )
            return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows), let(let(placed, repeats), total)
        ).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(words) > WINDOW, let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def metrics(df: DataFrame) -> DataFrame:
    """The input rows (packed) with their language, source, counts, metrics and base verdict."""
    text = whole_text(field("text"))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    measured = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    lined = let(
        F.transform(lines, lambda x: F.xxhash64(x)),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    out = packed(df).select(
        ROW,
        F.coalesce(field("lang"), F.lit("")).alias("lang"),
        F.coalesce(field("source"), F.lit("")).alias("source"),
        F.struct(measured.alias("w"), lined.alias("l")).alias("m"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    out = out.select(
        ROW,
        "lang",
        "source",
        F.col("m.w.n_words").alias("n_words"),
        F.col("m.w.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("m.l.n_lines").alias("n_lines"),
        "n_upper",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    per = {
        "symbols": (1000 * F.col("n_symbols"), "n_words"),
        "dup_lines": (1000 * F.col("n_dup_lines"), "n_lines"),
        "upper": (1000 * F.col("n_upper"), "word_chars"),
        "word_length": (100 * F.col("word_chars"), "n_words"),
    }
    values = F.struct(*[_share(top, F.col(under)).alias(m) for m, (top, under) in per.items()])
    return out.select("*", values.alias("value"), failed.alias("base_failed"))


def _share(top: Column, under: Column) -> Column:
    return F.when(under > 0, F.floor(top / under)).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number: itself under 32, else 32 buckets per doubling."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 32, value).otherwise(
        (shift + 1) * 32 + F.floor(value / F.pow(F.lit(2.0), shift)) - 32
    ).cast("long")


def floor_of(b: Column) -> Column:
    """Least value of a bucket."""
    return F.when(b < 32, b).otherwise((b % 32 + 32) * F.pow(F.lit(2.0), F.floor(b / 32) - 1)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (lang, source, metric, bucket) over the rows that pass the base rules."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"value.{m}")).alias("bucket")) for m in METRICS])
    ).alias("p")
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", pairs)
        .groupBy("lang", "source", "p.metric", "p.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups: the counts of their parts, added."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], percents: tuple[int, ...] = (10, 50)) -> DataFrame:
    """``n`` and ``q<percent>`` per group and metric.  A group holds at most some hundred buckets."""
    by = [*keys, "metric"]
    cells = sketch.groupBy(*by).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells")
    )

    def at(percent: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bucket"))
        found = F.aggregate(
            F.col("cells"),
            start,
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.when(acc["bucket"].isNotNull(), acc["bucket"])
                .when(100 * (acc["seen"] + x["n"]) >= percent * F.col("n"), x["bucket"])
                .alias("bucket"),
            ),
        )
        return floor_of(found["bucket"])

    return cells.select(*by, "n", *[at(p).alias(f"q{p}") for p in percents])


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): ``low`` and ``high`` by metric, with the backing group's level."""
    own = quantiles(sketch, ["lang", "source"])
    wide = quantiles(merged(sketch, ["lang"]), ["lang"]).toDF("lang", "metric", "n1", "a1", "b1")
    whole = quantiles(merged(sketch, []), []).toDF("metric", "n2", "a2", "b2")
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n1") >= MIN_GROUP, 1).otherwise(2)
    rows = (
        own.join(wide, ["lang", "metric"])
        .join(F.broadcast(whole), ["metric"])  # one row per metric
        .select(
            "lang",
            "source",
            "metric",
            level.alias("level"),
            F.when(level == 0, F.col("q10")).when(level == 1, F.col("a1")).otherwise(F.col("a2")).alias("q10"),
            F.when(level == 0, F.col("q50")).when(level == 1, F.col("b1")).otherwise(F.col("b2")).alias("q50"),
        )
    )
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("metric"))
    reach = SPREADS * (F.col("q50") - F.col("q10")) + slack
    return (
        rows.groupBy("lang", "source")
        .agg(
            F.first("level").alias("level"),
            *[F.max(F.when(F.col("metric") == m, F.col("q50") + reach)).alias(f"high_{m}") for m in METRICS],
            F.max(F.when(F.col("metric") == "word_length", F.col("q50") - reach)).alias("low_word_length"),
        )
    )


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: false if the base rules or a fence of its group reject the row.

    A group without fences has no row that passed the base rules.
    """
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & (F.col(f"value.{m}") <= F.col(f"high_{m}"))
    inside = inside & (F.col("value.word_length") >= F.col("low_word_length"))
    return measured.join(within_broadcast(limits, BROADCAST_GROUPS), ["lang", "source"], "left").select(
        *[F.col(c) for c in measured.columns],
        "level",
        F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"),
    )
