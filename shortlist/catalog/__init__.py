"""Registered queries.

Every entry is a callable ``(spark, folder) -> DataFrame`` with, where plain SQL
can say the same over the whole tables, a SQL twin used as its oracle.
"""

from __future__ import annotations

from .registry import entries


def load() -> dict:
    from . import corpus, curves, features, files, judged, ledgers, retrieved, streams  # noqa: F401

    return entries()
