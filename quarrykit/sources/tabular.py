"""Readers, writers and the named-dataset registry."""

from __future__ import annotations

import copy
import gzip
import logging
import os
import shutil
import tarfile
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NULL_TEXT = "\\N"


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None, target: str | None = None):
    r"""Tab-separated text with a header and ``\N`` for null; with ``target`` a pair (features, label).

    Without a schema one extra pass infers types. Partitions take the place of chunks.
    """
    reader = spark.read.options(sep="\t", header=True, nullValue=NULL_TEXT, emptyValue="")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return (df.drop(target), df.select(target)) if target else df


def ingest_tsv(spark: SparkSession, path: str, out: str | None = None, schema=None, narrow: bool = True, **options) -> DataFrame:
    """Read, narrow column types by one profiling pass, and optionally keep as Parquet. Never deletes other folders."""
    from ..operators.columns import narrow_types

    df = read_tsv(spark, path, schema)
    df = narrow_types(df, **options)[0] if narrow else df
    if out:
        df.write.mode("overwrite").parquet(out)
        df = spark.read.parquet(out)
    return df


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    r"""Tab-separated text, null as ``\N``; ``mode`` overwrite or append. An empty frame is refused."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.mode(mode).options(sep="\t", nullValue=NULL_TEXT, emptyValue="", header=header).csv(path)


def write_sheets(path: str, most_rows: int = 1_000_000, **sheets: DataFrame) -> None:
    """Several frames under one folder, a CSV folder a sheet; an ``.xlsx`` path needs openpyxl and at most ``most_rows`` rows a sheet."""
    if not sheets:
        raise ValueError("no sheets given")
    if str(path).endswith(".xlsx"):
        import openpyxl

        book = openpyxl.Workbook(write_only=True)
        for name, df in sheets.items():
            rows = df.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{name} has over {most_rows} rows")
            page = book.create_sheet(name)
            page.append(df.columns)
            for r in rows:
                page.append(list(r))
        book.save(path)
        return
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def load_file(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """``txt`` (one row a file), ``csv``, ``parquet``, ``json`` or ``orc``; pickles are refused as unsafe."""
    if kind == "txt":
        return spark.read.text(path, wholetext=True)
    if kind in ("csv", "parquet", "json", "orc"):
        return spark.read.options(**options).format(kind).load(path)
    if kind == "xlsx":
        return read_sheet(spark, path, **options)
    raise NotImplementedError(f"files of type {kind}")


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, most_rows: int = 1_048_576) -> DataFrame:
    """One sheet of an ``.xlsx`` book, its first row the names; needs openpyxl. A sheet has at most 1,048,576 rows by its format."""
    import openpyxl

    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    page = book[sheet] if isinstance(sheet, str) else book.worksheets[sheet]
    rows = page.iter_rows(values_only=True)
    names = [str(x) if x is not None else f"column_{k}" for k, x in enumerate(next(rows, ()))]
    held = list(rows)
    if len(held) > most_rows:
        raise ValueError(f"over {most_rows} rows")
    return spark.createDataFrame(pd.DataFrame(held, columns=names)) if held else spark.createDataFrame([], StructType([StructField(x, StringType()) for x in names]))


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """A frequency list ``word count``, blank-separated without header; words such as null stay text."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).cast("bigint").alias("count"))


class Catalogue:
    """Named datasets: name -> {path, kind, options}; local or cluster paths, no downloads."""

    def __init__(self, entries: dict[str, dict] | None = None):
        self._entries = copy.deepcopy(entries or {})

    def entries(self) -> dict[str, dict]:
        return copy.deepcopy(self._entries)

    def register(self, name: str, path: str, kind: str, **options) -> None:
        self._entries[name] = {"path": path, "kind": kind, "options": options}

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._entries:
            raise KeyError(name)
        e = self._entries[name]
        if e["kind"] == "word_counts":
            return read_word_counts(spark, e["path"])
        return load_file(spark, e["path"], e["kind"], **e.get("options", {}))

    def load_kept(self, spark: SparkSession, name: str, folder: str) -> DataFrame:
        """:meth:`load`, kept as Parquet under ``folder`` the first time and read from there after."""
        path = f"{folder.rstrip('/')}/{name}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            self.load(spark, name).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def as_views(self, spark: SparkSession) -> None:
        for name in self._entries:
            self.load(spark, name).createOrReplaceTempView(name)


def logger(name: str = "quarrykit", folder: str | None = None, file: str | None = None) -> logging.Logger:
    """A logger with time, place and level; with ``folder`` and ``file`` it writes there too, one handler a file."""
    own = logging.getLogger(name)
    own.setLevel(logging.INFO)
    if folder and file:
        path = str(Path(folder, file).resolve())
        if not any(getattr(h, "baseFilename", None) == path for h in own.handlers):
            handler = logging.FileHandler(path)
            handler.setFormatter(logging.Formatter("{asctime} {filename}:{lineno} {levelname} {message}", "%Y-%m-%d %H:%M:%S", style="{"))
            own.addHandler(handler)
    return own


def empty_frame(spark: SparkSession) -> DataFrame:
    """No columns, no rows."""
    return spark.createDataFrame([], StructType([]))


def cache_folder(path: str | None = None) -> Path:
    """The folder for kept files: ``path``, the variable QUARRYKIT_HOME, or ``~/.quarrykit``."""
    p = Path(path or os.environ.get("QUARRYKIT_HOME", "~/.quarrykit")).expanduser()
    p.mkdir(parents=True, exist_ok=True)
    return p


def clear_cache(path: str | None = None) -> int:
    """Remove the files directly in the cache folder; returns how many."""
    files = [p for p in cache_folder(path).iterdir() if p.is_file()]
    for p in files:
        p.unlink()
    return len(files)


def extract_missing(archive: str, target: str) -> list[str]:
    """Unpack from a zip, tar, tar.gz or a single file's .gz only the members that ``target`` lacks; names that lead outside are refused."""
    base, out = Path(target).resolve(), []
    if not zipfile.is_zipfile(archive) and not tarfile.is_tarfile(archive) and str(archive).endswith(".gz"):
        to = base / Path(archive).name[:-3]
        if not to.exists():
            base.mkdir(parents=True, exist_ok=True)
            with gzip.open(archive, "rb") as a, open(to, "wb") as f:
                shutil.copyfileobj(a, f)
            out.append(to.name)
        return out
    opened = zipfile.ZipFile(archive) if zipfile.is_zipfile(archive) else tarfile.open(archive)
    with opened as a:
        for name in a.namelist() if isinstance(a, zipfile.ZipFile) else a.getnames():
            to = (base / name).resolve()
            if not to.is_relative_to(base):
                raise ValueError(f"{name} leads outside")
            if not to.exists():
                if isinstance(a, zipfile.ZipFile):
                    a.extract(name, base)
                else:
                    a.extract(name, base, filter="data")
                out.append(name)
    return out


def make_archive(name: str, source: str, folder: str, overwrite: bool = False) -> str:
    """Pack a folder; the suffix of ``name`` gives the kind (.zip, .tar, .tar.gz)."""
    for suffix, kind in ((".tar.gz", "gztar"), (".zip", "zip"), (".tar", "tar")):
        if name.endswith(suffix):
            to = Path(folder) / name
            if to.exists() and not overwrite:
                raise FileExistsError(to)
            return shutil.make_archive(str(to)[: -len(suffix)], kind, source)
    raise ValueError("name must end in .zip, .tar or .tar.gz")
