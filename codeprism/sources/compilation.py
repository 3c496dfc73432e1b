"""Compilation databases: loading, shell splitting and compiler arguments."""

from __future__ import annotations

import os
import shlex

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import stable_id

SCHEMA = "directory string, file string, arguments array<string>, command string, output string"
#: Options that are dropped with, or without, the value after them.
DROPPED_WITH_VALUE = ("-o", "--output", "-MF", "-MT", "-MQ")
DROPPED = ("-c", "-M", "-MM", "-MD", "-MMD", "-MG", "-MP")
#: Options whose value is a path.
PATH_OPTIONS = ("-I", "-isystem", "-iquote", "-idirafter", "-include", "-imacros", "-isysroot", "--sysroot")


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_split(command: pd.Series) -> pd.Series:
    """Words of a POSIX shell command; null for null. There is no built-in for quoting rules."""
    return command.map(lambda c: None if c is None else shlex.split(c, posix=True))


def absolute(directory: str, path: str) -> str:
    parts: list[str] = []
    for p in (path if path.startswith("/") else f"{directory}/{path}").split("/"):
        if p == "..":
            parts[-1:] = []
        elif p not in ("", "."):
            parts.append(p)
    return "/" + "/".join(parts)


def normalise(arguments: list[str], directory: str, source: str) -> list[str]:
    """Arguments without the compiler, output, dependency and source words; paths made absolute."""
    out, words = [], iter(arguments[1:])
    for w in words:
        if w in DROPPED_WITH_VALUE:
            next(words, None)
        elif w in DROPPED or w.startswith(("-o", "--output=")):
            continue
        elif w in PATH_OPTIONS:
            value = next(words, None)
            out += [w] if value is None else [w, absolute(directory, value)]
        elif not w.startswith("-") and absolute(directory, w) == source:
            continue
        else:
            option = next((p for p in PATH_OPTIONS if w.startswith(p + "=")), None)
            joined = option + "=" if option else next((p for p in PATH_OPTIONS if p[:2] != "--" and w.startswith(p)), None)
            out.append(joined + absolute(directory, w[len(joined) :]) if joined else w)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def compiler_arguments(arguments: pd.Series, directory: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else normalise(list(a), d, s) for a, d, s in zip(arguments, directory, source)], dtype=object)


@F.pandas_udf(T.StringType())
def missing_path(directory: pd.Series, source: pd.Series) -> pd.Series:
    """Which of directory and file is not there, for the file systems that executors have; null if both are."""
    return pd.Series([None if os.path.isdir(d) and os.path.isfile(absolute(d, s)) else "file" if os.path.isdir(d) else "directory" for d, s in zip(directory, source)], dtype=object)


def load(spark: SparkSession, path: str, build_variant: str, check_paths: bool = False) -> DataFrame:
    """Build configurations of a JSON array of entries.

    Each entry has exactly one of arguments and command, a directory and a file; others are an
    error, as is an empty database, and with check_paths a directory or file that is not there. Of entries with one id the first stays. `position` is the
    place in the file: a database is one JSON value, so it is read as one row.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"array<struct<{SCHEMA.replace(' string', ':string').replace(' array', ':array')}>>", {"mode": "FAILFAST"}).alias("entries"))
    rows = parsed.select(F.posexplode("entries").alias("position", "e")).select("position", "e.*")
    words = F.coalesce("arguments", shell_split(F.col("command")))
    checked = rows.withColumn("problem", F.when(F.col("directory").isNull() | F.col("file").isNull(), "directory and file are needed").when(F.col("arguments").isNull() == F.col("command").isNull(), "exactly one of arguments and command is needed"))
    bad = checked.where("problem IS NOT NULL").select("position", "problem").orderBy("position").limit(1).collect()
    if bad:
        raise ValueError(f"entry {bad[0]['position']}: {bad[0]['problem']}")
    if check_paths:
        lost = checked.withColumn("problem", missing_path(F.col("directory"), F.col("file"))).where("problem IS NOT NULL").orderBy("position").limit(1).collect()
        if lost:
            raise ValueError(f"entry {lost[0]['position']}: the {lost[0]['problem']} does not exist")
    source = F.when(F.startswith("file", F.lit("/")), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    named = checked.select("position", "directory", source.alias("source_path"), words.alias("arguments"), "output")
    joined = F.array_join("arguments", "\u001f")
    named = named.withColumn("command_hash", F.sha2(F.concat_ws("\u001e", "directory", joined), 256)).withColumn("build_variant", F.lit(build_variant))
    named = named.withColumn("id", stable_id("config", F.col("build_variant"), F.col("directory"), F.col("source_path"), joined, F.coalesce("output", F.lit(""))))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("position"))).where("n = 1").drop("n")
    if first.isEmpty():
        raise ValueError("the compilation database is empty")
    return first.withColumn("clang_arguments", compiler_arguments(F.col("arguments"), F.col("directory"), F.col("source_path")))
