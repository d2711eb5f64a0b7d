"""Size bands and run arms: parsing of the short specs and band membership."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The band lists the reports are made with.
DEFAULT_BANDS = "0-24,25-29,30-34,35-39,40-49,50+,30-39,35+,all"
VALIDITY_BANDS = "30-34,35-39,40-49,50-54,55-59,60-64,50+,35+,all"
SIZE_BIAS_BANDS = "0-24,25-29,30-34,35-39,40-49,50+,35+,all"
ELEMENTARY_BANDS = "0-24,25-29,30-34,35-39,40-49,50+"


_BAND = re.compile(r"(?P<lo>\d+)(?:\+|-(?P<hi>\d+))")


@dataclass(frozen=True)
class Band:
    """Sizes from ``lo`` to ``hi``, both included; a bound of None is not tested."""

    label: str
    lo: int | None = None
    hi: int | None = None

    def holds(self, size: Column) -> Column:
        tests = [size >= self.lo] if self.lo is not None else []
        tests += [size <= self.hi] if self.hi is not None else []
        inside = reduce(Column.__and__, tests) if tests else F.lit(True)
        return F.coalesce(inside, F.lit(False))


def parse_band(spec: str) -> Band:
    """``30-39`` (inclusive), ``35+`` or ``all``; ``all`` holds null sizes too."""
    label = spec.strip()
    if label == "all":
        return Band(label)
    match = _BAND.fullmatch(label)
    if match is None:
        raise ValueError(f"not a band: {label!r}")
    return Band(label, *(None if x is None else int(x) for x in match.group("lo", "hi")))


def parse_bands(specs: str | Sequence[Band]) -> list[Band]:
    if isinstance(specs, str):
        return [parse_band(s) for s in specs.split(",") if s.strip()]
    return list(specs)


def band_labels(size: Column, bands: str | Sequence[Band]) -> Column:
    """Labels of every band that holds ``size``; bands may overlap."""
    marks = [F.when(b.holds(size), F.lit(b.label)) for b in parse_bands(bands)]
    return F.array_compact(F.array(*marks))


def explode_bands(
    df: DataFrame, size: str, bands: str | Sequence[Band], out: str = "band"
) -> DataFrame:
    """One row per band a row belongs to.

    The bounds are a handful of literals, so membership is an expression inside
    the scan stage rather than a range join.
    """
    return df.withColumn(out, F.explode(band_labels(F.col(size), bands)))


@dataclass(frozen=True)
class Arm:
    name: str
    runs: tuple[str, ...]
    record: str | None = None


_ARM = re.compile(r"(?P<name>[^=]*)=(?P<runs>[^@]*[^@,][^@]*)(?:@(?P<record>.*))?")


def parse_arm(spec: str) -> Arm:
    """``name=run1,run2`` with an optional ``@record``."""
    match = _ARM.fullmatch(spec)
    if match is None:
        raise ValueError(f"not an arm: {spec!r}; expected name=run1,run2")
    return Arm(match["name"], tuple(filter(None, match["runs"].split(","))), match["record"] or None)


def half_open_bin(value: Column, edges: Sequence[int]) -> Column:
    """Label ``lo-(hi-1)`` of the half-open bin holding ``value``; null outside."""
    label = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        label = F.when((value >= lo) & (value < hi), F.lit(f"{lo}-{hi - 1}")).otherwise(label)
    return label
