"""Helpers shared by the training-data operators: shared storage, input normalisation, tokenizer paths."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_unset_root: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary folder serves as long as all runs on one machine (a ``local`` master); on a
    cluster that is an error, since executors don't see each other's folders.
    """
    global _unset_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _unset_root is None:
        _unset_root = "file://" + tempfile.mkdtemp(prefix="veridex-")
    return _unset_root


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/veridex-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)


def clean(spark: SparkSession) -> None:
    """Deletes the tables that operators have written for this application, once no result is read any more."""
    _delete(spark, _own_folder(spark))


#: Paths of the tables that are written within the innermost ``alone``.
_within: ContextVar[list[str] | None] = ContextVar("within", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing.

    A table has a name of its own in the application's folder; ``alone`` deletes what isn't needed any more, and
    ``clean`` all of them."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _within.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, written; the tables that were written on the way are deleted."""
    paths: list[str] = []
    outer = _within.set(paths)
    try:
        out = written(make(), name)
    finally:
        _within.reset(outer)
    for path in paths[:-1]:
        _delete(spark, path)
    if (before := _within.get()) is not None:
        before.append(paths[-1])
    return out


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns ``doc_id, text``; a null text is empty. Other columns, whatever their names, are left behind."""
    return df.select(_quoted(id_col).cast("long").alias("doc_id"), F.coalesce(_quoted(text_col), F.lit("")).alias("text"))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """``name`` may be a path of its own or the name of one of the public tokenizer files."""
    return name if os.path.sep in name else public_tokenizers.path(name)
