"""Binary files in folders that all executors share, written and read inside tasks.

A folder is named as Spark names it, with or without a scheme.  Each attempt of a task writes a
file of its own name; only names that a finished attempt reports enter a manifest, so files of
lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..session import shared_dir

#: Schemes that Spark's file systems and Arrow's spell differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder."""
    scheme, mark, rest = folder.partition("://")
    if not mark:
        scheme, mark, rest = folder.partition(":")
        if not mark or "/" in scheme:
            return pafs.LocalFileSystem(), folder
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def attempt_name(part: int, ending: str) -> str:
    return f"part-{part:06d}-{uuid.uuid4().hex}{ending}"


def create(folder: str, name: str):
    """A new file, to be written from front to back."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)  # else the name decides


def read(folder: str, name: str):
    """The file for random access."""
    system, path = opened(folder)
    return system.open_input_file(f"{path}/{name}")
