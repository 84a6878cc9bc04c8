"""Code files: folder listing and line scans of text and gzip."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import drop_suffix

#: Longer lines are skipped whole.
MAX_LINE = 1 << 20


def list_files(folder: str, spark: SparkSession | None = None) -> dict[str, tuple[int, int]]:
    """Regular files of a folder, without hidden ones: path to (size, modification time in ns).

    A folder named by a URL is listed through Spark's own file system layer, whose times
    are in milliseconds.
    """
    found = {}
    if spark is not None and "://" in folder:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        for info in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target):
            if info.isFile() and not info.getPath().getName().startswith("."):
                found[f"{folder.rstrip('/')}/{info.getPath().getName()}"] = (info.getLen(), info.getModificationTime() * 1_000_000)
        return found
    with os.scandir(folder) as entries:
        for e in entries:
            if e.name.startswith(".") or not e.is_file(follow_symlinks=False):
                continue
            try:
                info = e.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue
            found[os.path.join(folder, e.name)] = (info.st_size, info.st_mtime_ns)
    return found


def _checked(paths: list[str]) -> None:
    for path in paths:
        if os.path.basename(path).startswith("_"):
            raise ValueError(f"{path}: Spark's readers skip names that start with an underscore")


def _codes(lines: DataFrame, *more: str) -> DataFrame:
    kept = lines.where(F.octet_length("value") < MAX_LINE)
    return kept.select(drop_suffix(F.col("value"), "\r").alias("code"), *more)


def write_lines(codes: DataFrame, path: str, gzip: bool = False, line_end: str = "\n") -> None:
    """The column ``code`` as lines of text files below ``path``."""
    writer = codes.select(F.col("code").alias("value")).write.option("lineSep", line_end)
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``code``: the lines of a text or gzip file.

    Lines end at a line feed; one carriage return before it is dropped.  A file whose
    name starts with an underscore is invisible to Spark's readers and is refused
    here rather than read as empty.
    """
    _checked([path])
    return _codes(spark.read.option("lineSep", "\n").text(path))


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(code, src)``: the lines of all files.

    Files are numbered by position, so a path listed twice is two sources.  Beyond
    the sources that fit a bit mask, distinct paths are one scan, and a line's source
    is its file's path.  A missing or damaged file fails the scan as a whole.
    """
    _checked(paths)
    if len(paths) > 63 and len(set(paths)) == len(paths):
        lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("src"))
        return _codes(lines, "src")
    out = spark.createDataFrame([], "code string, src int")
    for i, path in enumerate(paths):
        out = out.unionByName(read_lines(spark, path).withColumn("src", F.lit(i)))
    return out
