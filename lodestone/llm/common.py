"""Helpers that the corpus operators share: scratch tables, sampling, row hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as code points.
WORD_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor sees, as `spark.checkpoint.dir` names it.

    Only where the setting is absent in a local session (tests) a folder of our own is set;
    on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written intermediate tables of one operator call, kept in the shared folder.

    `save` writes a frame as Parquet and reads it again, which cuts its lineage in a
    way that survives lost executors. `drop` removes a table no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string")), F.lit(mod))


def sampled_rows(df: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """A sample of about `per_label` rows of each label, chosen by a hash of the id.

    A count per label fixes the rate; a row stays if its hash lies under the rate, so
    no label's rows meet in one task. The expected sample is `per_label` rows a label
    (all rows of a rarer one); the actual size varies by its square root.
    """
    counts = df.groupBy(F.col(label_col).alias("__label")).agg(F.count(F.lit(1)).alias("__n")).collect()
    keep = F.lit(False)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(20177)), F.lit(1 << 30))
    for row in counts:
        rate = min(1.0, per_label / max(1, row["__n"]))
        keep = keep | (F.col(label_col).eqNullSafe(F.lit(row["__label"])) & (draw < F.lit(int(rate * (1 << 30)))))
    return df.where(keep)
