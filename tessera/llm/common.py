"""What the corpus operators share: the shared folder, lineage cuts and the hold-out rule."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> pa.Table:
    """The rows of a bounded sample on the driver; what Arrow holds beyond them is given back."""
    table = df.toArrow()
    pa.default_memory_pool().release_unused()
    return table


_HELD: dict[str, Any] = {}


def held(token: str, make: Callable[[], Any]) -> Any:
    """A Python worker's own copy of a model, made once. It takes the place of the one that the worker held before, as workers outlive stages."""
    if token not in _HELD:
        forget()
        _HELD[token] = make()
    return _HELD[token]


def forget() -> None:
    """Give back what the worker holds of other stages' models, to the system too where its allocator can."""
    had = bool(_HELD)
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    if had and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the rule that holds documents out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
