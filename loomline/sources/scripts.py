"""Script files as rows, for batch and streaming."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "*.[sS][qQ][lL]"
#: Folders of the engine's own side files, right below the one that is read.
OWN_FOLDERS = ("remain", "analysis")
SCHEMA = "filename_path string, filename string, script string"


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _named(files: DataFrame, root: str) -> DataFrame:
    """Bytes that are no UTF-8 are left out of the text."""
    name = F.element_at(F.split("path", "/"), -1)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    own = F.lit(False)
    for folder in OWN_FOLDERS:
        own |= F.startswith(F.col("path"), F.lit(f"{root}/{folder}/"))
    return files.where(~own).select(F.regexp_replace("path", "/[^/]*$", "").alias("filename_path"), name.alias("filename"), text.alias("script"))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(filename_path, filename, script) of one file, or of all .sql files below a folder; an unknown path gives no rows."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        logging.getLogger("loomline").error("no such file or folder: %s", path)
        return spark.createDataFrame([], SCHEMA)
    reader = spark.read.format("binaryFile")
    if files.getFileStatus(at).isDirectory():
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN)
    return _named(reader.load(path), _qualified(spark, path))


def stream_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as a stream: a file counts when it appears in the folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _named(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PATTERN).load(folder), _qualified(spark, folder))


def find_folder(parent: str, name: str) -> str | None:
    """The folder of this name in any case."""
    return next((e.path for e in sorted(os.scandir(parent), key=lambda e: e.name) if e.is_dir() and e.name.lower() == name.lower()), None)
