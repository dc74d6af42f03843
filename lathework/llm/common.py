"""Helpers shared by the corpus operators: bound values in lambdas, and tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, although a lambda inside `use` reads it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: `spark.checkpoint.dir`, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lathework-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_runs: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder, which is deleted when the driver's Python ends in good order."""
    folder = f"{shared_folder(spark)}/lathework-{spark.sparkContext.applicationId}"
    if folder not in _runs:
        _runs.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, and no later use computes it anew or loses it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


#: Elements of an array that `running` folds at once.
_FOLD = 64


def running(values: Column, kind: str, zero: int, add: Callable[[Column, Column], Column]) -> Column:
    """What each element of an array of numbers has before it: `add` of all earlier ones, `zero` for the first.

    Folds append to short arrays only, first within stretches and then over the stretches' totals, as an append copies.
    """

    def fold(some: Column) -> Column:
        first = F.struct(F.lit(zero).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("before"))
        step = lambda a, x: F.struct(add(a["at"], x).cast(kind).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before"))
        return F.aggregate(some, first, step)

    def stretches(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _FOLD).cast("int")), lambda c: fold(F.slice(v, c * _FOLD + 1, _FOLD)))

    def joined(parts: Column) -> Column:
        above = lambda bases: F.flatten(F.transform(parts, lambda p, c: F.transform(p["before"], lambda b: add(F.get(bases, c), b).cast(kind))))
        return let(fold(F.transform(parts, lambda p: p["at"]))["before"], above)

    def whole(v: Column) -> Column:
        return F.when(F.size(v) <= _FOLD, fold(v)["before"]).otherwise(let(stretches(v), joined))

    return let(values, whole)


#: Code points in a block of `in_pieces`.
_PIECE = 512


def in_pieces(text: Column) -> Column:
    """A text as an array of blocks, so that `cut_out` reads a stretch without walking there from the text's beginning."""
    return F.when(F.octet_length(text) <= _PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))


def cut_out(pieces: Column, start: Column, size: Column) -> Column:
    """`size` code points from `start`, counted from 0, of a text that `in_pieces` has cut."""
    first = F.floor(start / _PIECE).cast("int")
    many = F.floor((start + F.greatest(size, F.lit(1)) - 1) / _PIECE).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(pieces, first + 1, many), ""), (start - first * _PIECE + 1).cast("int"), size)
