"""Edits of a game collection as new snapshots.

A collection is a folder of numbered generations, each a Parquet table of games (number, tags,
movetext). An edit names the generation it was made against and is refused if that is no longer
the newest. It writes the whole next generation to a folder of its own and then renames that to
the next number, which fails if another writer was there first: readers see the old generation or
the new one, and a job that dies halfway leaves a folder that nobody looks at.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GenerationChanged(ValueError):
    """The collection was changed since it was read."""


class NoSuchGame(ValueError):
    """There is no game of that number."""


def _versions(spark: SparkSession, path: str) -> tuple[object, object]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def generation(spark: SparkSession, path: str) -> int:
    """The newest complete generation; 0 if there is none. A generation is complete once its
    writer has left the _SUCCESS mark."""
    fs, new = _versions(spark, path)
    found = fs.globStatus(new(f"{path}/g*/_SUCCESS")) if fs.exists(new(path)) else []
    return max((int(x.getPath().getParent().getName()[1:]) for x in found), default=0)


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/g{generation(spark, path) if at is None else at:09d}")


def _write(games: DataFrame, path: str, base: int) -> int:
    spark = games.sparkSession
    if generation(spark, path) != base:
        raise GenerationChanged(path)
    draft = f"{path}/draft-{uuid.uuid4().hex}"
    games.write.mode("error").parquet(draft)
    fs, new = _versions(spark, path)
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    plain = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(new(draft), new(f"{path}/g{base + 1:09d}"), plain)
    except Py4JJavaError as e:
        fs.delete(new(draft), True)
        if "FileAlreadyExists" in str(e.java_exception):
            raise GenerationChanged(path) from e
        raise
    return base + 1


def create(games: DataFrame, path: str) -> int:
    return _write(games, path, 0)


def append(spark: SparkSession, path: str, base: int, games: DataFrame) -> int:
    """games (tags, movetext, pos: order among them) get the next numbers."""
    from pyspark.sql import Window

    old = read(spark, path, base)
    top = old.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    more = games.withColumn("number", (F.row_number().over(Window.orderBy("pos")) + top).cast("int"))
    return _write(old.unionByName(more.select(*old.columns)), path, base)


def replace(spark: SparkSession, path: str, base: int, number: int, tags: dict[str, str], movetext: str) -> int:
    old = read(spark, path, base)
    if not old.where(F.col("number") == number).limit(1).count():
        raise NoSuchGame(number)
    here = F.col("number") == number
    new_tags = F.create_map(*(F.lit(x) for kv in tags.items() for x in kv)).cast("map<string,string>")
    return _write(old.select("number", F.when(here, new_tags).otherwise(F.col("tags")).alias("tags"), F.when(here, movetext).otherwise(F.col("movetext")).alias("movetext")), path, base)


def delete(spark: SparkSession, path: str, base: int, number: int) -> int:
    """The game goes and later ones move up by one, as they would in a file."""
    old = read(spark, path, base)
    if not old.where(F.col("number") == number).limit(1).count():
        raise NoSuchGame(number)
    left = old.where(F.col("number") != number)
    return _write(left.withColumn("number", F.when(F.col("number") > number, F.col("number") - 1).otherwise(F.col("number")).cast("int")), path, base)
