"""Queries over the document corpus: rules, dedup, order, splits, samples, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import order_key
from ..operators import arms, order, prep
from ..operators.retrieve import clean_pool, contamination
from ..plans import prepare as plans
from ..plans import protocols
from ..sources import tables as t
from . import sqlviews as v
from .registry import query

_REASON = """CASE WHEN size = 0 THEN 'unparseable' WHEN size < 20 THEN 'too_small'
    WHEN size > {cap} THEN 'too_large' WHEN lang NOT IN ('de', 'en', 'es') THEN 'disallowed_element'
    WHEN canonical = '' THEN 'empty' WHEN length(canonical) > 2500 THEN 'too_many_tokens'
    ELSE 'ok' END"""
_STD = f"{v.ITEMS}, std AS (SELECT *, {_REASON.format(cap=400)} AS reason FROM items)"
_KEPT = f"""{_STD}, kept AS (SELECT * FROM std WHERE reason = 'ok'
  QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY order_key, item_id) = 1)"""
_CORPUS = f"""{v.ITEMS}, kept AS (SELECT * FROM items
  QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY order_key, item_id) = 1)"""
_TALLY = f"""{_KEPT}, tally AS (
  SELECT reason, count(*) AS n FROM std GROUP BY reason
  UNION ALL SELECT 'duplicate', (SELECT count(*) FROM std WHERE reason = 'ok') - count(*)
  FROM kept HAVING (SELECT count(*) FROM std WHERE reason = 'ok') > count(*))"""


@query("drop_reasons", f"WITH {_TALLY} SELECT reason, n FROM tally")
def drop_reasons(spark, path):
    rows = prep.drop_reasons(t.standardized(spark, path))
    return rows.orderBy(F.desc("n"), "reason")


@query(
    "consumed_counts",
    f"""WITH {_TALLY} SELECT (sum(n) FILTER (reason <> 'duplicate'))::BIGINT AS consumed,
    sum(n)::BIGINT AS consumed_legacy,
    round(sum(n) FILTER (reason = 'ok') / sum(n), 8) AS kept_rate FROM tally""",
)
def consumed_counts(spark, path):
    return prep.consumed_counts(prep.drop_reasons(t.standardized(spark, path)))


@query("rule_chain", f"WITH {_STD} SELECT item_id, reason FROM std")
def rule_chain(spark, path):
    return t.standardized(spark, path).select("item_id", "reason")


@query("first_seen_dedup", f"WITH {_KEPT} SELECT item_id, md5(canonical) AS digest FROM kept")
def first_seen_dedup(spark, path):
    kept = t.standardized(spark, path).filter(F.col("reason") == "ok")
    return prep.first_seen(
        kept.select("item_id", "digest", "order_key"), "digest", ["order_key", "item_id"]
    ).select("item_id", "digest")


@query(
    "nested_prefix",
    f"""WITH {_CORPUS}, r AS (SELECT item_id, row_number() OVER (ORDER BY order_key, item_id) AS rank
    FROM kept) SELECT item_id, rank FROM r WHERE rank <= 300""",
)
def nested_prefix(spark, path):
    """The 300-item subset; a larger subset contains it."""
    return order.nested_prefix(
        t.corpus(spark, path).select("item_id", "order_key"), "order_key", "item_id", 300
    ).select("item_id", "rank")


@query(
    "chunked_prefix",
    f"""WITH {_CORPUS}, r AS (SELECT s.item_id, k.item_id IS NOT NULL AS kept,
      row_number() OVER (ORDER BY s.order_key, s.item_id) AS read_rank
      FROM items s LEFT JOIN kept k USING (item_id)),
    c AS (SELECT (read_rank - 1) // 50 AS chunk, count(*) FILTER (kept) AS n FROM r GROUP BY 1),
    b AS (SELECT chunk, coalesce(sum(n) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS before FROM c)
    SELECT item_id, read_rank FROM r JOIN b ON b.chunk = (r.read_rank - 1) // 50
    WHERE kept AND before < 300""",
)
def chunked_prefix(spark, path):
    """The same target, tested once per chunk of records: the result overshoots."""
    kept = t.corpus(spark, path).select("item_id", F.lit(True).alias("kept"))
    rows = (
        t.items(spark, path)
        .select("item_id", "order_key")
        .join(kept, "item_id", "left")
        .withColumn("kept", F.coalesce("kept", F.lit(False)))
    )
    return order.chunked_prefix(rows, "order_key", "item_id", "kept", 300, 50).select(
        "item_id", "read_rank"
    )


_SPLIT = f"""{_CORPUS}, sr AS (SELECT item_id, canonical, group_key, size,
    row_number() OVER (ORDER BY {v.okey("'seed1:' || item_id")}, item_id) AS split_rank FROM kept),
  split AS (SELECT *, CASE
    WHEN split_rank <= floor((SELECT count(*) FROM kept) * 0.05) THEN 'test'
    WHEN split_rank <= 2 * floor((SELECT count(*) FROM kept) * 0.05) THEN 'valid'
    ELSE 'train' END AS split FROM sr)"""


def _split(spark, path, items=t.corpus):
    rows = items(spark, path).withColumn("k", order_key("seed1", F.col("item_id")))
    return order.random_split(rows, "k", "item_id", 0.05, 0.05).drop("k")


@query("split_random", f"WITH {_SPLIT} SELECT item_id, split_rank, split FROM split")
def split_random(spark, path):
    return _split(spark, path).select("item_id", "split_rank", "split")


@query(
    "split_overlaps",
    f"""WITH {_SPLIT} SELECT count(*) AS items, count(DISTINCT canonical) AS distinct_items,
    0 AS in_two_splits FROM split""",
)
def split_overlaps(spark, path):
    rows = _split(spark, path)
    shared = prep.split_overlaps(rows, "digest", "split")
    counted = shared.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("digest").alias("distinct_items")
    ).withColumn("in_two_splits", counted)


_GROUPS = f"""{_CORPUS}, gs AS (SELECT group_key, count(*) AS n,
    {v.okey("'seed2:' || group_key")} AS h FROM kept GROUP BY group_key),
  gb AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, group_key ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS before FROM gs),
  tt AS (SELECT floor(count(*) * 0.1) AS t FROM kept),
  ts AS (SELECT coalesce(max(before + n), 0) AS s FROM gb WHERE before < (SELECT t FROM tt)),
  ga AS (SELECT group_key, CASE WHEN before < (SELECT t FROM tt) THEN 'test'
    WHEN before - (SELECT s FROM ts) < (SELECT t FROM tt) THEN 'valid' ELSE 'train' END
    AS group_split FROM gb)"""


def _group_split(spark, path, items=t.corpus):
    return prep.group_split(items(spark, path), "group_key", 0.1, 0.1, "seed2")


@query(
    "split_group",
    f"WITH {_GROUPS} SELECT item_id, group_key, group_split FROM kept JOIN ga USING (group_key)",
)
def split_group(spark, path):
    return _group_split(spark, path).select("item_id", "group_key", "group_split")


@query(
    "shard_meta",
    f"""WITH {_TALLY}, {_SPLIT.replace(_CORPUS + ', ', '')}, {_GROUPS.replace(_CORPUS + ', ', '')}
    SELECT 'splits' AS section, split AS name, count(*) AS n FROM split GROUP BY split
    UNION ALL SELECT 'group_splits', group_split, count(*) FROM kept JOIN ga USING (group_key)
      GROUP BY group_split
    UNION ALL SELECT 'drop_reasons', reason, n FROM tally""",
)
def shard_meta(spark, path):
    return prep.shard_meta(
        _split(spark, path, t.shard),
        _group_split(spark, path, t.shard),
        prep.drop_reasons(t.standardized(spark, path)),
    )


_BLOCKED = """blocked AS (SELECT DISTINCT trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g'))
  AS canonical FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)"""


def _blocked(spark, path):
    toxic = t.table(spark, path, "labels").filter(F.col("toxic") == 1).select("doc_id")
    docs = t.table(spark, path, "documents").join(toxic, "doc_id", "left_semi")
    return prep.with_digest(docs.select(t.canonical_text(F.col("text")).alias("canonical")), "canonical")


@query(
    "exclude_anti",
    f"WITH {_CORPUS}, {_BLOCKED} SELECT item_id FROM kept WHERE canonical NOT IN "
    "(SELECT canonical FROM blocked)",
)
def exclude_anti(spark, path):
    return prep.exclude(t.corpus(spark, path), _blocked(spark, path), "digest").select("item_id")


@query(
    "exclude_record",
    f"WITH {_CORPUS}, {_BLOCKED} SELECT item_id FROM kept WHERE canonical IN "
    "(SELECT canonical FROM blocked)",
)
def exclude_record(spark, path):
    return prep.excluded(t.corpus(spark, path), _blocked(spark, path), "digest").select("item_id")


# ------------------------------------------------------------------ size caps


@query("size_histogram", f"WITH {v.ITEMS} SELECT size, count(*) AS n FROM items GROUP BY size")
def size_histogram(spark, path):
    return prep.size_histogram(t.items(spark, path).select("size"), "size")


_SAMPLE_A = f"""{v.ITEMS}, sa AS (SELECT size FROM items
    ORDER BY {v.okey("'cap-a:' || item_id")}, item_id LIMIT 200),
  sc AS (SELECT count(*) / least(count(*), 200) AS scale FROM items)"""


def _cap_cost(spark, path):
    rows = t.items(spark, path).withColumn("n_tokens", F.length(F.col("canonical")))

    def rules(cap):
        cfg = prep.StandardizeConfig(
            max_size=cap, min_size=20, max_tokens=2500, allowed=t.CORPUS_RULES.allowed
        )
        return t.corpus_rules(cfg)

    return plans.cap_cost(
        rows.select("item_id", "canonical", "size", "lang", "n_tokens"),
        rules,
        text="canonical",
        size="size",
        n_tokens="n_tokens",
        cap=64,
        raised=10**9,
        sample=200,
        yield_sample=300,
        seed="cap",
    )


@query(
    "cap_summary",
    f"""WITH {_SAMPLE_A} SELECT count(*) AS parsed, 0 AS failed,
    count(*) FILTER (size > 64) AS over_cap,
    round(count(*) FILTER (size > 64) / count(*), 8) AS over_cap_share, max(size) AS largest_seen,
    round((SELECT scale FROM sc), 8) AS scale,
    round_even(count(*) FILTER (size > 64) * (SELECT scale FROM sc), 0) AS implied_over_cap FROM sa""",
)
def cap_summary(spark, path):
    return _cap_cost(spark, path)["summary"].drop("tail")


@query(
    "cap_tail",
    f"""WITH {_SAMPLE_A}, tb(band, lo, hi) AS (VALUES ('65-69', 65, 69), ('70-79', 70, 79),
      ('80-99', 80, 99), ('100-149', 100, 149), ('150+', 150, 9223372036854775807))
    SELECT band, count(sa.size) AS n_sampled,
      round_even(count(sa.size) * (SELECT scale FROM sc), 0)::BIGINT AS implied
    FROM tb LEFT JOIN sa ON sa.size BETWEEN lo AND hi GROUP BY band""",
)
def cap_tail(spark, path):
    return _cap_cost(spark, path)["tail"]


@query(
    "raised_cap_fates",
    f"""WITH {v.ITEMS}, lg AS (SELECT * FROM items WHERE length(canonical) >= 65),
    s AS (SELECT * FROM lg ORDER BY {v.okey("'cap-b:' || item_id")}, item_id LIMIT 300),
    sc AS (SELECT count(*) / least(count(*), 300) AS scale FROM lg),
    f AS (SELECT size, length(canonical) AS nt, {_REASON.format(cap=10**9)} AS r2 FROM s
      WHERE {_REASON.format(cap=64)} = 'too_large'),
    g AS (SELECT CASE WHEN r2 = 'ok' THEN 'survives' ELSE r2 END AS fate,
      CASE WHEN r2 = 'ok' THEN size // 10 * 10 END AS decade, nt FROM f)
    SELECT fate, decade, count(*) AS n, CASE WHEN fate = 'survives' THEN max(nt) END
      AS longest_tokens, round((SELECT scale FROM sc), 8) AS scale,
      round_even(count(*) * (SELECT scale FROM sc), 0)::BIGINT AS implied FROM g GROUP BY fate, decade""",
)
def raised_cap_fates(spark, path):
    return _cap_cost(spark, path)["fates"]


# -------------------------------------------------------------------- samples


@query(
    "sample_exact",
    f"""WITH {_CORPUS} SELECT item_id, row_number() OVER (ORDER BY {v.okey("'s4:' || item_id")},
    item_id) AS draw FROM kept QUALIFY draw <= 100""",
)
def sample_exact(spark, path):
    return order.sample_exact(t.corpus(spark, path).select("item_id"), 100, "s4", "item_id")


@query(
    "sample_with_scale",
    f"""WITH {_CORPUS}, s AS (SELECT item_id, row_number() OVER (ORDER BY
      {v.okey("'s6:' || item_id")}, item_id) AS draw FROM kept)
    SELECT item_id, draw, (SELECT count(*) FROM kept) AS stream_length,
      round((SELECT count(*) / least(count(*), 150) FROM kept), 8) AS scale FROM s WHERE draw <= 150""",
)
def sample_with_scale(spark, path):
    return order.sample_with_scale(t.corpus(spark, path).select("item_id"), 150, "s6", "item_id")


@query(
    "stratified_sample",
    f"""WITH {_CORPUS} SELECT item_id, lang, row_number() OVER (PARTITION BY lang
    ORDER BY {v.okey("'s5:' || item_id")}, item_id) AS draw FROM kept QUALIFY draw <= 25""",
)
def stratified_sample(spark, path):
    return order.stratified_sample(
        t.corpus(spark, path).select("item_id", "lang"), "lang", 25, "s5", "item_id"
    )


@query(
    "weighted_draws",
    f"""WITH {_CORPUS}, m AS (SELECT item_id, size, size >= 200 AS heavy, row_number() OVER (
      PARTITION BY size >= 200 ORDER BY {v.okey("'w7:stratum:' || item_id")}, item_id) AS rank FROM kept),
    tt AS (SELECT count(*) FILTER (heavy) AS nh, count(*) FILTER (NOT heavy) AS nl FROM m),
    d AS (SELECT item_id AS draw, {v.unit("'w7:which:' || item_id")} * (nh * 3.0 + nl) < nh * 3.0
      AS heavy, {v.unit("'w7:rank:' || item_id")} AS u, nh, nl FROM m, tt),
    p AS (SELECT draw, heavy, floor(u * CASE WHEN heavy THEN nh ELSE nl END) + 1 AS rank FROM d)
    SELECT p.draw, m.item_id, m.size, p.heavy FROM p JOIN m ON m.heavy = p.heavy AND m.rank = p.rank""",
)
def weighted_draws(spark, path):
    rows = t.corpus(spark, path).select("item_id", "size")
    return order.weighted_draws(rows, "item_id", "size", 200, 3.0, "w7")


@query(
    "mix_summary",
    f"""WITH {_CORPUS}, {v.bands("0-49,50-99,100-199,200+")}, b2 AS (SELECT * FROM bands
      UNION ALL SELECT 'at_or_above_threshold', 200, 9223372036854775807),
    w AS (SELECT size, CASE WHEN size >= 200 THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM kept)
    SELECT band, round(count(*) FILTER (size BETWEEN lo AND hi) / count(*), 8) AS share,
      round(coalesce(sum(w) FILTER (size BETWEEN lo AND hi), 0) / sum(w), 8) AS weighted_share
    FROM w, b2 GROUP BY band""",
)
def mix_summary(spark, path):
    return arms.mix_summary(t.corpus(spark, path), "size", 200, 3.0, "0-49,50-99,100-199,200+")


# ----------------------------------------------------------- pools and leakage

# Two shards over one corpus: the small one is the first 300 of the shuffle order.
_NESTED = f"""{_CORPUS}, rk AS (SELECT *, row_number() OVER (ORDER BY order_key, item_id) AS rank
    FROM kept),
  small AS (SELECT *, {v.hb("'sm:' || item_id", 10)} = 0 AS held FROM rk WHERE rank <= 300),
  big AS (SELECT *, {v.hb("'bg:' || item_id", 10)} = 0 AS held FROM rk)"""


def _nested(spark, path):
    from ..functions.hashing import hash_bucket

    rows = t.corpus(spark, path).select("item_id", "digest", "size", "order_key", "canonical")
    small = order.nested_prefix(rows, "order_key", "item_id", 300).drop("rank")
    return (
        small.withColumn("held", hash_bucket(10, "sm", F.col("item_id")) == 0),
        rows.withColumn("held", hash_bucket(10, "bg", F.col("item_id")) == 0),
    )


@query(
    "nested_contamination",
    f"""WITH {_NESTED} SELECT (SELECT count(*) FROM small s JOIN big b USING (item_id)
      WHERE s.held AND NOT b.held) AS leaked, (SELECT count(*) FROM small WHERE held) AS held_out""",
)
def nested_contamination(spark, path):
    """Held-out items of the small shard that the big shard trains on."""
    small, big = _nested(spark, path)
    return contamination(small.filter("held"), big.filter(~F.col("held")), "digest")


_TRAINS = """trains AS (SELECT canonical FROM small WHERE NOT held
  UNION SELECT canonical FROM big WHERE NOT held)"""


@query(
    "training_union",
    f"WITH {_NESTED}, {_TRAINS} SELECT md5(canonical) AS digest FROM trains",
)
def training_union(spark, path):
    from ..operators.retrieve import union_of_keys

    small, big = _nested(spark, path)
    return union_of_keys(
        small.filter(~F.col("held")), big.filter(~F.col("held")), key="digest"
    )


@query(
    "clean_pool",
    f"WITH {_NESTED}, {_TRAINS} SELECT item_id FROM big WHERE held AND canonical NOT IN "
    "(SELECT canonical FROM trains)",
)
def clean_pool_query(spark, path):
    from ..operators.retrieve import union_of_keys

    small, big = _nested(spark, path)
    trains = union_of_keys(
        small.filter(~F.col("held")), big.filter(~F.col("held")), key="digest"
    )
    return clean_pool(big.filter("held"), trains, "digest").select("item_id")


_PROTOCOL = f"""{_NESTED}, {_TRAINS}, cp AS (SELECT * FROM big WHERE held AND canonical NOT IN
    (SELECT canonical FROM trains)),
  pr AS (SELECT item_id, row_number() OVER (ORDER BY {v.okey("'p0:' || item_id")}, item_id) AS draw
    FROM cp WHERE size BETWEEN 50 AND 300 QUALIFY draw <= 40)"""


def _protocol(spark, path):
    from ..operators.retrieve import union_of_keys

    small, big = _nested(spark, path)
    trains = union_of_keys(
        small.filter(~F.col("held")), big.filter(~F.col("held")), key="digest"
    )
    return protocols.common_protocol(
        big.filter("held"), trains, 40, "p0", key="digest", min_size=50, max_size=300
    ), clean_pool(big.filter("held"), trains, "digest")


@query(
    "common_protocol",
    f"WITH {_PROTOCOL} SELECT item_id, draw, true AS fp_unseen FROM pr",
)
def common_protocol(spark, path):
    """A seeded draw of size-bounded items that nobody trained on."""
    protocol, _ = _protocol(spark, path)
    return protocol.select("item_id", "draw", "fp_unseen")


@query(
    "tuning_draw",
    f"""WITH {_PROTOCOL} SELECT item_id, row_number() OVER (ORDER BY {v.okey("'p1:' || item_id")},
    item_id) AS draw FROM cp WHERE item_id NOT IN (SELECT item_id FROM pr) QUALIFY draw <= 15""",
)
def tuning_draw(spark, path):
    """A second draw that shares no item with the protocol."""
    protocol, pool = _protocol(spark, path)
    return protocols.tuning_draw(pool, protocol, 15, "p1").select("item_id", "draw")


@query(
    "pool_concat",
    f"""WITH {_SPLIT} SELECT split, count(*) AS n, sum(size)::BIGINT AS total_size
    FROM split GROUP BY split""",
)
def pool_concat(spark, path):
    """Splits put back together keep every row."""
    rows = _split(spark, path)
    parts = [rows.filter(F.col("split") == s) for s in ("train", "valid", "test")]
    pooled = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return pooled.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size")
    )


# --------------------------------------------------------------------- tokens

_PIECES = "regexp_extract_all(canonical, '[a-z]+|[0-9]+|[^a-z0-9]')"
_VOCAB = f"""{_CORPUS}, tk AS (SELECT item_id, unnest({_PIECES}) AS token,
    generate_subscripts({_PIECES}, 1) AS p FROM kept),
  vc AS (SELECT token, count(*) AS n FROM tk GROUP BY token HAVING count(*) >= 2),
  vocab AS (SELECT token, n, row_number() OVER (ORDER BY encode(token)) + 3 AS id FROM vc)"""


def _vocab(spark, path):
    rows = t.corpus(spark, path).select("item_id", "canonical", "lang")
    tokens = rows.withColumn("tokens", tx.tokenize(F.col("canonical")))
    return tokens, tx.build_vocabulary(tokens, "tokens", 2)


@query(
    "vocab_build",
    f"""WITH {_VOCAB} SELECT token, n, id FROM vocab
    UNION ALL SELECT * FROM (VALUES ('<pad>', 0, 0), ('<bos>', 0, 1), ('<eos>', 0, 2), ('<unk>', 0, 3))""",
)
def vocab_build(spark, path):
    return _vocab(spark, path)[1]


@query(
    "tokenize_lossless",
    f"""WITH {_CORPUS} SELECT item_id, len({_PIECES}) AS n_tokens,
    array_to_string({_PIECES}, '') = canonical AS lossless FROM kept""",
)
def tokenize_lossless(spark, path):
    rows = t.corpus(spark, path)
    tokens = tx.tokenize(F.col("canonical"))
    return rows.select(
        "item_id",
        F.size(tokens).alias("n_tokens"),
        tx.is_lossless(F.col("canonical"), tokens).alias("lossless"),
    )


_IDS = f"""{_VOCAB}, ids AS (SELECT item_id, list_concat(list_concat([1::BIGINT],
    list(coalesce(id, 3) ORDER BY p)), [2::BIGINT]) AS ids
  FROM tk LEFT JOIN vocab USING (token) GROUP BY item_id)"""


@query(
    "encode",
    f"""WITH {_IDS} SELECT item_id, len(ids)::INT AS n_ids,
    md5(array_to_string(ids, ',')) AS ids_digest FROM ids""",
)
def encode(spark, path):
    tokens, vocab = _vocab(spark, path)
    ids = tx.encode(tokens, "item_id", "tokens", vocab)
    return ids.select(
        "item_id",
        F.size("ids").alias("n_ids"),
        F.md5(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_digest"),
    )


@query(
    "decode",
    f"""WITH {_VOCAB} SELECT item_id, coalesce(string_agg(v.token, '' ORDER BY p), '') AS text
    FROM tk LEFT JOIN vocab v USING (token) GROUP BY item_id""",
)
def decode(spark, path):
    """Encode and decode again: only tokens below the count limit are lost."""
    tokens, vocab = _vocab(spark, path)
    ids = tx.encode(tokens, "item_id", "tokens", vocab)
    return tx.decode(ids, "item_id", "ids", vocab)


@query(
    "token_dataset",
    f"""WITH {_IDS}, l AS (SELECT item_id, lang, c AS chunk, ids[c * 64 + 1:c * 64 + 64] AS tokens
      FROM (SELECT *, unnest(range((len(ids) + 63) // 64)) AS c FROM ids) JOIN kept USING (item_id)),
    w AS (SELECT lang, max(len(tokens)) AS width FROM l GROUP BY lang)
    SELECT item_id, chunk::INT AS chunk, width::INT AS width, len(tokens)::INT AS n_real,
      md5(array_to_string(list_concat(tokens, list_transform(range(len(tokens), width),
        lambda i: 0::BIGINT)), ',')) AS tokens_digest FROM l JOIN w USING (lang)""",
)
def token_dataset(spark, path):
    """Encoded rows in chunks of 64 ids, padded to the longest chunk of their batch."""
    rows = t.corpus(spark, path).select("item_id", "canonical", "lang")
    padded, _ = plans.token_dataset(
        rows, "canonical", min_count=2, max_tokens=64, batch="lang"
    )
    return padded.select(
        "item_id",
        "chunk",
        "width",
        F.size(F.filter("mask", lambda m: m)).alias("n_real"),
        F.md5(F.concat_ws(",", F.col("tokens").cast("array<string>"))).alias("tokens_digest"),
    )
