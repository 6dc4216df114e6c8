"""Materialised books and topic models.

A library's relations are written once as Parquet, partitioned by book, under a key of the
files' times and sizes; the same files are read back from there, changed ones are parsed
again.  A topic model is a folder with its tables and a description."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .annotated import Corpus

RELATIONS = ("token", "mention", "quote", "supersense", "character")


def signature(corpus: Corpus) -> str:
    """A hash over the paths, times and lengths of all files of the books."""
    paths = [f"{place}/{book}.{kind}" for kind, books in sorted(corpus.kinds.items()) for book, place in books]
    files = corpus.spark.read.format("binaryFile").load(paths).select(F.xxhash64("path", "modificationTime", "length").alias("h"))
    total = files.agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return f"{total['n']}-{int(total['s']) & (1 << 64) - 1:016x}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialise(corpus: Corpus, root: str) -> Corpus:
    """The same books with their relations read from Parquet, written first if they are not there."""
    place = f"{root}/{signature(corpus)}"
    for name in RELATIONS:
        path = f"{place}/{name}"
        if not _exists(corpus.spark, f"{path}/_SUCCESS"):
            getattr(corpus, name).write.mode("overwrite").partitionBy("book").parquet(path)
    out = Corpus(corpus.spark, corpus.books, corpus.kinds)
    for name in RELATIONS:
        df = getattr(corpus, name)
        out.__dict__[name] = corpus.spark.read.schema(df.schema).parquet(f"{place}/{name}").select(*df.columns)
    return out


class ModelError(ValueError):
    pass


def _folder(root: str, model: str) -> str:
    if not re.fullmatch(r"[a-z0-9-]+", model):
        raise ModelError(f"bad model id {model!r}")
    return f"{root}/{model}"


def save_model(spark: SparkSession, root: str, model: str, theta: DataFrame, phi: DataFrame, about: dict) -> None:
    place = _folder(root, model)
    theta.write.mode("overwrite").parquet(f"{place}/theta")
    phi.write.mode("overwrite").parquet(f"{place}/phi")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/about")


def load_model(spark: SparkSession, root: str, model: str) -> tuple[DataFrame, DataFrame, dict]:
    place = _folder(root, model)
    if not _exists(spark, f"{place}/about/_SUCCESS"):
        raise ModelError(f"no model {model!r}")
    about = json.loads(spark.read.text(f"{place}/about").first()["value"])
    return spark.read.parquet(f"{place}/theta"), spark.read.parquet(f"{place}/phi"), about


def list_models(spark: SparkSession, root: str) -> list[str]:
    if not _exists(spark, root):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(x.getPath().getName() for x in found if _exists(spark, f"{root}/{x.getPath().getName()}/about/_SUCCESS"))


def delete_model(spark: SparkSession, root: str, model: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(root, model))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
