"""Which databases there are."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".2cbh", ".cbh", ".pgn")
MAX_FOLDERS = 10_000


def expand(spark: SparkSession, path: str, most: int = MAX_FOLDERS) -> tuple[list[str], bool]:
    """(database files by path, whether folders were left out). A path that is no folder stands
    for itself. Folders are read breadth first and by name, at most `most` read and waiting, so
    those near the top come first; hidden ones and links to folders are not followed, and one
    that is gone or closed is passed over. Only names are read, on the driver."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
        return [path], False
    link = lambda p: p.toUri().getPath() if fs.getScheme() == "file" else None
    found, waiting, read, cut = [], deque([top]), 0, False
    while waiting:
        folder = waiting.popleft()
        read += 1
        try:
            entries = sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName())
        except Exception as e:
            if read > 1 and any(n in str(e) for n in ("FileNotFoundException", "AccessControlException", "AccessDenied")):
                continue
            raise
        for s in entries:
            name, at = s.getPath().getName(), s.getPath()
            if s.isDirectory():
                local = link(at)
                if name.startswith(".") or local and jvm.java.nio.file.Files.isSymbolicLink(jvm.java.io.File(local).toPath()):
                    continue
                if read + len(waiting) < most:
                    waiting.append(at)
                else:
                    cut = True
            elif s.isFile() and name.lower().endswith(SUFFIXES):
                found.append(at.toUri().getPath() if link(at) else at.toString())
    return sorted(found), cut


def first_of(*lists: DataFrame) -> DataFrame:
    """(path, name, list, pos) of lists (path, name, pos): each path once, as the first list that
    has it gives it, at its first place there."""
    every = None
    for i, entries in enumerate(lists):
        part = entries.select("path", F.struct(F.lit(i).alias("list"), "pos", "name").alias("_e"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("path").agg(F.min("_e").alias("_e")).select("path", "_e.name", "_e.list", "_e.pos")


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """The databases of configured paths, each once, in the order to show them."""
    lists = []
    for p in paths:
        rows = [(f, f.rsplit("/", 1)[-1].rsplit(".", 1)[0], i) for i, f in enumerate(expand(spark, p)[0])]
        lists.append(spark.createDataFrame(rows, "path string, name string, pos int"))
    return first_of(*lists).orderBy("list", "pos")
