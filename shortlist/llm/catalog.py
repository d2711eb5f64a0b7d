"""Registered queries of the operators in this folder, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate_query,
    htmltext_query,
    licenses_query,
    linededup_query,
    negatives_query,
    packing_query,
    personal_query,
    quality_query,
    secrets_query,
    simhash_query,
    tokenfiles_query,
    warc_query,
    whitening_query,
)

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (
    secrets_query,
    tokenfiles_query,
    simhash_query,
    warc_query,
    decontaminate_query,
    htmltext_query,
    licenses_query,
    linededup_query,
    packing_query,
    quality_query,
    personal_query,
    negatives_query,
    whitening_query,
)


def queries() -> dict[str, Query]:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if m.SQL is not None}
