"""What several operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.session import shared_folder
from joblattice.sources.files import Files

# Word separators of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module_name: str) -> None:
    """Let Python workers get this module's functions by value.

    Executors then need no copy of the package on their own disks.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def kept_by_worker(key: str, make: Callable):
    """``make()``, made once in the life of a Python worker and kept for its later tasks."""
    state = sys.modules.setdefault("worker_state", types.ModuleType("worker_state"))
    if not hasattr(state, key):
        setattr(state, key, make())
    return getattr(state, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove ``stored`` tables; whatever was made from them must be stored itself by now."""
    for table in tables:
        folder, name = table.stored_at.rsplit("/", 1)
        Files(table.sparkSession, folder).remove(name)


def broadcast_if_small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``df``, a stored table of one or two numbers a row, marked for broadcast if it has at
    most ``most_rows`` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= most_rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; no word or a null text gives an empty one."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of a row: its id and text. Rows equal in both get equal results."""
    text = F.col(text_col)
    return F.struct(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("h"),
        F.octet_length(text).alias("n"),
    )


ship(__name__)
