"""op2: ids of all ``documents`` in Huffman-coded files, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import tokenfiles
from .files import new_folder
from .packing import public_vocabulary
from .rows import table

NAME = "op2_token_id_files"
SQL = None


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "token-files")
    manifest = tokenfiles.save(table(spark, folder, "documents"), public_vocabulary(tokenfiles.VOCABULARY), out)
    return tokenfiles.read(manifest, out)
