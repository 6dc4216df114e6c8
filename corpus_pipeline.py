"""The corpus pipeline: language, near-duplicates, mix, packing.

Each stage takes the documents that the one before it left, and its decisions take
effect; all but the last give the columns of ``documents``.  Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import dartminhash, language, mixing, packing
from codexflow.llm.queries import tokenizer_path
from codexflow.llm.storage import Scratch, quoted, unused


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or far from every language go."""
    model = language.fit(docs, Scratch(spark, "language"))
    columns, said = [F.col(quoted(c)) for c in docs.columns], unused("said", docs.columns)
    found = language.verdicts(docs, model, columns, said)
    return found.where(~F.col(said)["rejected"] & (F.col(said)["lang_pred"] != language.UNDETERMINED)).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id.  Rows that share an
    id are one document, of which the row with the smallest hash of its text, then of the
    other columns, stays."""
    scratch, columns = Scratch(spark, "duplicates"), docs.columns
    found = scratch.keep(dartminhash.classes(docs, scratch).select("doc_id", "kept"), "classes")
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    # rows travel as one column, so that no name of theirs can meet another
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    left = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    if not again.isEmpty():
        hashed = [F.col("row")[f.name] for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        order = F.struct(F.xxhash64(F.col("row")["text"]), F.xxhash64(*hashed))
        repeated = left.join(again, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min_by("row", order).alias("row"))
        left = left.join(again, F.col("id") == F.col("again"), "left_anti").select("row").unionByName(repeated.select("row"))
    return left.select(*[F.col("row")[c].alias(c) for c in columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken, those at a run's ends in part."""
    return mixing.mixed_documents(docs, Scratch(spark, "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack(docs, Scratch(spark, "pack"), tokenizer_path())


STAGES = [
    ("language ID", keep_identified),
    ("MinHash near-dedup", drop_near_duplicates),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Language prediction, signatures and tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
