"""Round trips: what the tables hold is written in each file form, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.bands import explode_bands
from ..operators import metrics
from ..plans import prepare
from ..session import shared_dir
from ..sources import corpus, dumps
from ..sources import tables as t
from . import corpus as c
from . import features as f
from . import sqlviews as v
from .curves import TRACE
from .judged import _summary
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/shortlist-file-{name}-{uuid.uuid4().hex}"


def _counted(df, *by):
    """Digests with their counts: rows of a file have no identity of their own."""
    return df.groupBy(*by, F.md5("raw").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "file_columns",
    f"""WITH {v.ITEMS} SELECT reader, md5(canonical) AS digest, count(*) AS n
      FROM items, (VALUES ('named'), ('second')) r(reader) WHERE canonical <> '' GROUP BY reader, canonical""",
)
def file_columns(spark, path):
    """A tab-separated file read by the column's name and by its place."""
    folder = _folder(spark, "columns")
    rows = t.documents(spark, path).select("item_id", "canonical", "lang")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False).csv(folder)
    named = corpus.read_column(spark, folder, "canonical").withColumn("reader", F.lit("named"))
    second = corpus.read_second_column(spark, folder).withColumn("reader", F.lit("second"))
    return _counted(named.unionByName(second), "reader")


@query(
    "file_exclusions",
    f"WITH {f._BQ} SELECT DISTINCT md5(canonical) AS digest FROM bq WHERE canonical <> ''",
)
def file_exclusions(spark, path):
    """Two overlapping lists with blank lines and stray spaces, as one list."""
    folder = _folder(spark, "exclusions")
    texts = t.benchmark_queries(spark, path).select("query_id", "canonical")
    padded = F.explode(F.array(F.concat(F.lit("  "), "canonical", F.lit(" ")), F.lit(""), F.lit("   ")))
    for part, rows in (("a", texts), ("b", texts.filter(F.col("query_id") % 2 == 0))):
        rows.select(padded.alias("value")).write.text(f"{folder}/{part}")
    return corpus.read_exclusions(spark, [f"{folder}/a", f"{folder}/b"]).select(F.md5("canonical").alias("digest"))


@query(
    "file_shard",
    f"""WITH {c._SPLIT}, {c._GROUPS.replace(c._CORPUS + ', ', '').replace('* 0.1)', '* 0.05)')}
    SELECT 'split' AS kind, split, item_id, true AS first_written, false AS written_again FROM split
    UNION ALL SELECT 'group_split', group_split, item_id, true, false FROM kept JOIN ga USING (group_key)""",
)
def file_shard(spark, path):
    """A prepared shard by split and by group split; a second preparation leaves it alone."""
    folder = _folder(spark, "shard")
    records = t.items(spark, path).select("item_id", "canonical", "group_key", "size")
    prepared = prepare.prepare_corpus(records, [("never", F.lit(False))])
    first, again = (prepare.write_shard(prepared, folder) for _ in range(2))
    out = None
    for kind, grouped in (("split", False), ("group_split", True)):
        for split in ("train", "valid", "test"):
            rows = corpus.read_split(spark, folder, split, grouped).select(
                F.lit(kind).alias("kind"), F.lit(split).alias("split"), "item_id",
                F.lit(first).alias("first_written"), F.lit(again).alias("written_again"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "file_lines",
    f"WITH {v.ITEMS} SELECT lang, md5(canonical) AS digest, count(*) AS n FROM items WHERE canonical <> '' GROUP BY lang, canonical",
)
def file_lines(spark, path):
    """Line texts, one folder per language; empty lines are not rows."""
    folder = _folder(spark, "lines")
    items = t.documents(spark, path).select("canonical", "lang")
    corpus.write_lines(items, "canonical", folder, column="lang")
    rows = None
    for (lang,) in items.select("lang").distinct().orderBy("lang").collect():  # a handful of names
        name = lang if lang is not None else "__HIVE_DEFAULT_PARTITION__"
        read = corpus.read_lines(spark, f"{folder}/lang={name}").select(F.col("value").alias("raw"), F.lit(lang).alias("lang"))
        rows = read if rows is None else rows.unionByName(read)
    return _counted(rows, "lang")


@query(
    "file_dumps",
    f"""WITH {v.judged_views()}, n AS (SELECT run, count(*) AS n_queries, sum(n_samples)::BIGINT AS n_samples,
        count(*) FILTER (fp_unseen) AS n_unseen FROM queries GROUP BY run)
      SELECT run, any_value(n_queries) AS n_queries, any_value(n_samples) AS n_samples, any_value(n_unseen) AS n_unseen,
        count(*) AS n_candidates, count(*) FILTER (valid) AS n_valid, count(*) FILTER (fp_match) AS n_match,
        count(*) FILTER (duplicate) AS n_duplicate, sum(pos)::BIGINT AS positions, round(sum(tanimoto), 6) AS tanimoto,
        true AS named_by_file
      FROM judged JOIN n USING (run) GROUP BY run""",
)
def file_dumps(spark, path):
    """Candidate lists nested into one line per query, and taken apart again."""
    folder = _folder(spark, "dumps")
    queries = t.queries(spark, path).withColumn("ref_canonical", F.concat(F.lit("query "), F.col("query_id").cast("string")))
    dumps.write_dumps(queries, t.judged(spark, path), folder)
    stored = dumps.read_written_dumps(spark, folder)
    asked = dumps.dump_queries(stored).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("n_samples").cast("long").alias("n_samples"), F.count_if("fp_unseen").alias("n_unseen")
    )
    listed = dumps.dump_judged(stored).filter(F.col("pos").isNotNull()).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if("valid").alias("n_valid"), F.count_if("fp_match").alias("n_match"),
        F.count_if("duplicate").alias("n_duplicate"), F.sum("pos").alias("positions"), F.round(F.sum("tanimoto"), 6).alias("tanimoto"),
    )
    by_file = dumps.read_dumps(spark, f"{folder}/run={t.RUNS[0]}").agg(
        F.every(F.col("run").startswith("part-") & ~F.col("run").endswith(".json"))
    ).first()[0]
    return asked.join(listed, "run").withColumn("named_by_file", F.lit(by_file))


_BAND_CELLS = f"""{v.bands(t.ELEMENTARY)}, cells AS (SELECT band, run, count(*) AS n_queries,
    avg(coalesce(rank_gen_fp < 20, false)::INT) AS rate FROM summary JOIN bands ON size BETWEEN lo AND hi WHERE fp_unseen GROUP BY band, run)"""


@query(
    "file_reports",
    f"""WITH {v.summary_views()}, {_BAND_CELLS}
    SELECT 'bands' AS report, run, band, n_queries, 20 AS k, round(rate, 8) AS rate FROM cells
    UNION ALL SELECT 'ladder', run, band, n_queries, 20, round(rate, 8) FROM cells WHERE run = 's1'
    UNION ALL SELECT 'mix', 's1', band, NULL, NULL, round(rate / 0.5, 8) FROM cells WHERE run = 's1'
    UNION ALL SELECT 'registered', 's1', band, n_queries, 20, round(rate, 8) FROM cells WHERE run = 's1'""",
)
def file_reports(spark, path):
    """Rates per band and run as the four report documents, each read by its reader."""
    folder = _folder(spark, "reports")
    hit = metrics.hit_at(20).cast("double")
    rows = explode_bands(_summary(spark, path).filter("fp_unseen"), "size", t.ELEMENTARY)
    cells = rows.groupBy("band", "run").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("rate"))
    one = cells.filter(F.col("run") == "s1")
    as_map = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))  # noqa: E731  bands and runs only
    per_band = cells.groupBy("band").agg(
        F.struct(F.max("n").alias("n_queries"), as_map("run", "rate").alias("per_run")).alias("b")
    )
    ladder = F.struct(F.col("n").alias("n_queries"), F.create_map(F.lit("20"), "rate").alias("recovery_at_k"))
    mix = F.struct(F.lit(0.5).alias("share"), F.col("rate").alias("weighted_share"))
    registered = F.struct("band", F.col("n").alias("n"), F.col("rate").alias("registered_lo"), F.lit(1.0).alias("registered_hi"))
    documents = {
        "bands": per_band.agg(F.lit(20).alias("k"), F.lit("recovery").alias("metric"), as_map("band", "b").alias("bands")),
        "ladder": one.select("band", ladder.alias("b")).agg(F.lit(20).alias("k"), as_map("band", "b").alias("bands")),
        "mix": one.select("band", mix.alias("b")).agg(F.struct(as_map("band", "b").alias("bands")).alias("size_weighted_mix")),
        "registered": one.agg(F.lit("recovery").alias("metric"), F.lit(20).alias("k"), F.collect_list(registered).alias("rows")),
    }
    for name, document in documents.items():
        document.coalesce(1).write.json(f"{folder}/{name}")
    none = F.lit(None).cast("long")
    read = {
        "bands": dumps.read_band_report(spark, f"{folder}/bands"),
        "ladder": dumps.read_anatomy_report(spark, f"{folder}/ladder", "s1").withColumnRenamed("recovery", "rate"),
        "mix": dumps.read_mix_record(spark, f"{folder}/mix", "s1").select(
            F.col("arm").alias("run"), "band", none.alias("n_queries"), none.alias("k"), F.col("ratio").alias("rate")
        ),
        "registered": dumps.read_registration(spark, f"{folder}/registered").select(
            F.lit("s1").alias("run"), "band", F.col("n").alias("n_queries"), "k", F.col("registered_lo").alias("rate")
        ),
    }
    out = None
    for name, rows in read.items():
        part = rows.select(F.lit(name).alias("report"), "run", "band", F.col("n_queries").cast("long").alias("n_queries"), F.col("k").cast("int").alias("k"), "rate")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "file_histories",
    f"""WITH {TRACE} SELECT run, epoch, step, valid_loss, recovery FROM trace""",
)
def file_histories(spark, path):
    """One history document per run, its evaluations nested as training writes them."""
    folder = _folder(spark, "histories")
    cell = F.struct(F.create_map(F.lit("20"), F.col("recovery")).alias("recovery_at_k"), F.lit(1.0).alias("budget_filled_rate"))
    valid = F.struct(F.lit("molecules").alias("budget"), F.array(F.lit(20)).alias("ks"), F.create_map(F.lit("all"), cell).alias("slices"))
    record = F.struct("epoch", "step", "valid_loss", valid.alias("valid"))
    # a history holds one run's evaluations, one per day
    texts = t.trace(spark, path).groupBy("run").agg(F.to_json(F.collect_list(record)).alias("value"))
    texts.repartition("run").write.partitionBy("run").text(folder)
    rows = dumps.read_histories(spark, f"{folder}/*/*.txt")
    return rows.select(F.regexp_replace("run", "^run=", "").alias("run"), "epoch", "step", "valid_loss", "recovery")


@query("file_vocabulary", f"WITH {c._VOCAB} SELECT token, id FROM vocab")
def file_vocabulary(spark, path):
    folder = _folder(spark, "vocabulary")
    dumps.write_vocabulary(c._vocab(spark, path)[1], folder)
    return dumps.read_vocabulary(spark, folder, tx.SPECIALS).filter(F.col("id") >= len(tx.SPECIALS)).select("token", "id")


@query(
    "file_mask",
    f"""WITH {f._TRAIN} SELECT item_id, key NOT IN (SELECT key FROM tr) AS fp_unseen, false AS written_again FROM va""",
)
def file_mask(spark, path):
    """A seen-mask is written once per configuration and read by whoever asks again."""
    folder = _folder(spark, "mask")
    train, valid = f._train_valid(spark, path)
    mask = f.retrieve.seen_flag(valid, train).select("item_id", "fp_unseen")
    dumps.cached_mask(mask, folder, f.B128.config_id, "valid")
    other = mask.withColumn("fp_unseen", F.lit(None).cast("boolean"))  # would show if it were written
    again = dumps.cached_mask(other, folder, f.B128.config_id, "valid")
    return again.withColumn("written_again", F.col("fp_unseen").isNull())
