"""The standard views in plain SQL, written apart from the Spark side."""

from __future__ import annotations

#: Every number of the tables lies within this.
_MOST = 2**63 - 1

RUN_OFFSETS = {"s1": 1, "s2": 7, "s3": 13, "s4": 19, "s5": 25}


def hb(text: str, modulus: int) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {modulus})"


def okey(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def unit(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def band_values(spec: str) -> str:
    rows = []
    for s in spec.split(","):
        if s == "all":
            rows.append(f"('all', {-_MOST}, {_MOST})")
        elif s.endswith("+"):
            rows.append(f"('{s}', {s[:-1]}, {_MOST})")
        else:
            lo, hi = s.split("-")
            rows.append(f"('{s}', {lo}, {hi})")
    return ", ".join(rows)


def bands(spec: str) -> str:
    return f"bands(band, lo, hi) AS (VALUES {band_values(spec)})"


def _untaken() -> str:
    """Order lines that no run takes by its own digits."""
    return " AND ".join(f"('0x' || substr(l.h, {o}, 2))::BIGINT >= 179" for o in RUN_OFFSETS.values())


def judged_views(runs=("s1", "s2", "s3")) -> str:
    values = ", ".join(f"('{r}', {RUN_OFFSETS[r]})" for r in runs)
    return f"""
runs(run, off) AS (VALUES {values}),
line AS (
  SELECT l_orderkey, (l_partkey % 120)::INT AS raw,
         md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS h
  FROM lineitem),
raw_c AS (
  SELECT r.run, o.o_custkey AS query_id, l.raw,
         ('0x' || substr(l.h, r.off + 2, 4))::BIGINT AS ord
  FROM line l JOIN orders o ON o.o_orderkey = l.l_orderkey CROSS JOIN runs r
  WHERE ('0x' || substr(l.h, r.off, 2))::BIGINT < 179 OR (r.run = 's1' AND {_untaken()})),
dd AS (
  SELECT run, query_id, raw, min(ord) AS ord, count(*) AS n
  FROM raw_c GROUP BY run, query_id, raw),
ns AS (
  SELECT run, query_id, sum(n)::BIGINT AS n_samples FROM dd GROUP BY run, query_id),
queries AS (
  SELECT r.run, c.c_custkey AS query_id, {hb("'z:' || c.c_custkey", 65)} AS size,
         {hb("'u:' || c.c_custkey", 10)} < 8 AS fp_unseen,
         coalesce(ns.n_samples, 0) AS n_samples
  FROM customer c CROSS JOIN runs r
  LEFT JOIN ns ON ns.run = r.run AND ns.query_id = c.c_custkey),
j0 AS (
  SELECT run, query_id, raw, raw % 40 AS item, raw % 11 <> 0 AS valid,
         row_number() OVER (PARTITION BY run, query_id ORDER BY ord, raw) - 1 AS pos,
         {hb("'z:' || query_id", 65)} AS size,
         {hb("'m:' || query_id || ':' || (raw % 40)", 100)} AS m
  FROM dd),
judged AS (
  SELECT run, query_id, pos, raw::VARCHAR AS raw, size,
         CASE WHEN valid THEN item::VARCHAR END AS canonical, valid,
         valid AND m < 6 - size // 13 AS fp_match,
         valid AND m < 5 - size // 13 AS exact_structure,
         CASE WHEN valid AND m < 6 - size // 13 THEN 1.0::DOUBLE
              WHEN valid THEN {hb("'t:' || query_id || ':' || item", 999)} / 1000.0::DOUBLE
              ELSE 0.0::DOUBLE END AS tanimoto,
         valid AND pos > min(CASE WHEN valid THEN pos END)
             OVER (PARTITION BY run, query_id, item) AS duplicate,
         CASE WHEN valid THEN greatest(size - 4
             + {hb("'s:' || query_id || ':' || item", 9)}, 1) END AS cand_size
  FROM j0)"""


SUMMARY_VIEWS = """
props AS (
  SELECT run, query_id, canonical, min(pos) AS first_pos, count(*) AS votes,
         bool_or(fp_match) AS fp_match, bool_or(exact_structure) AS exact_structure,
         max(tanimoto) AS tanimoto, max(cand_size) AS cand_size
  FROM judged WHERE valid GROUP BY run, query_id, canonical),
ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY run, query_id ORDER BY first_pos) - 1 AS gen,
    row_number() OVER (PARTITION BY run, query_id ORDER BY votes DESC, first_pos) - 1 AS con
  FROM props),
hr AS (
  SELECT run, query_id, count(*) AS n_scored,
    min(gen) FILTER (fp_match) AS rank_gen_fp, min(gen) FILTER (exact_structure) AS rank_gen_ex,
    min(con) FILTER (fp_match) AS rank_con_fp, min(con) FILTER (exact_structure) AS rank_con_ex
  FROM ranked GROUP BY run, query_id),
tot AS (
  SELECT run, query_id, count(*) AS n_candidates, count(*) FILTER (valid) AS n_valid,
         count(*) FILTER (duplicate) AS n_duplicate, max(tanimoto) AS best_tanimoto
  FROM judged GROUP BY run, query_id),
summary AS (
  SELECT q.*, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_valid, 0) AS n_valid,
         coalesce(n_duplicate, 0) AS n_duplicate, coalesce(n_scored, 0) AS n_scored,
         coalesce(best_tanimoto, 0.0) AS best_tanimoto,
         rank_gen_fp, rank_gen_ex, rank_con_fp, rank_con_ex
  FROM queries q LEFT JOIN tot USING (run, query_id) LEFT JOIN hr USING (run, query_id))"""


def summary_views(runs=("s1", "s2", "s3")) -> str:
    return judged_views(runs) + "," + SUMMARY_VIEWS


def wide_hits(runs, k: int, rank: str = "rank_gen_fp") -> str:
    """``wide(query_id, size, h_<run>...)`` over unseen queries."""
    cols = ", ".join(
        f"bool_or(coalesce({rank} < {k}, false)) FILTER (run = '{r}') AS h_{r}" for r in runs
    )
    return (
        f"wide AS (SELECT query_id, max(size) AS size, {cols} "
        "FROM summary WHERE fp_unseen GROUP BY query_id)"
    )


def mcnemar(b: str, c: str) -> str:
    """Exact two-sided p-value with a log-gamma sum."""
    n, lo = f"({b} + {c})", f"least({b}, {c})"
    return (
        f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform("
        f"range(0, {lo} + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) "
        f"- lgamma({n} - i + 1.0) - {n} * ln(2.0))))) END"
    )


ITEMS = f"""
items AS (
  SELECT doc_id AS item_id, text AS raw, lang, source AS group_key,
         trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS canonical,
         regexp_extract_all(lower(text), '[\\pL\\pN]+') AS tokens,
         len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS size,
         {okey("'seed0:' || doc_id")} AS order_key
  FROM documents)"""

DISTINCT_ITEMS = """
ditems AS (
  SELECT * FROM items
  QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY item_id) = 1)"""


def feature_bits(tokens: str, n_bits: int | None) -> str:
    """Sorted distinct identifiers of a token list."""
    h = "('0x' || substr(md5(t), 1, 8))::BIGINT"
    h = f"{h} % {n_bits}" if n_bits else h
    return f"list_sort(list_distinct(list_transform({tokens}, lambda t: {h})))"


def bits_key(bits: str) -> str:
    return f"md5(array_to_string({bits}, ','))"
