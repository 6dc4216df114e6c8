"""Tables and files that every executor can read again.

All intermediate results go below ``spark.checkpoint.dir``.  A run that is
local to one machine (tests) may leave that setting out; then a temporary
folder is made.  On a cluster a missing setting is an error, since a folder of
one machine is not seen by the others.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codexflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = "file://" + posixpath.abspath(root) if root.startswith("/") else root
    return root.rstrip("/")


class Scratch:
    """A folder of one run.  ``keep`` writes a table there and reads it back, which
    cuts the lineage; ``drop`` removes what is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/codexflow/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for table in tables:
            path = table if isinstance(table, str) else table._scratch_path
            jvm = self.spark.sparkContext._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def open_out(uri: str):
    """A binary output stream at a URI, from an executor."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_in(uri: str):
    """A binary input file at a URI, from an executor."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
