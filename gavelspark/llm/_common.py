"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Exactly the named columns, cast to their kinds; missing ones are null.

    Columns go by position, so further columns whose names differ only by case, or repeat, do no harm: an exact name wins, then the first that matches without case.
    """
    names = df.columns
    out = df.toDF(*(f"c{i}" for i in range(len(names))))
    lower = [n.lower() for n in names]
    cols = []
    for name, kind in kinds.items():
        at = names.index(name) if name in names else lower.index(name) if name in lower else None
        cols.append((F.lit(None) if at is None else F.col(f"c{at}")).cast(kind).alias(name))
    return out.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session whose executors are threads of the driver (local[...]) may do without the setting: its own folder is then shared."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints/gavelspark").rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, and survives lost executors. The table goes when the application ends, as results may be read from it until then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
