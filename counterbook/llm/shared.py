"""Where the operators keep intermediate tables.

Intermediate results that several jobs read are written as Parquet into the
folder named by ``spark.checkpoint.dir``, which the driver and every executor
share; an executor that is lost takes nothing with it. Each call takes a
folder of its own, so a replayed job never overwrites files that are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return folder.rstrip("/")


#: Spark then removes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """``df`` written to a fresh folder of the shared place and read again: the
    lineage is cut by files, not by blocks of one executor. ``by``: a column with a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        out = df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame, part: str = "") -> None:
    """Removes tables that ``written`` made, or one folder of each, once all that was built on them is written itself."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{t.written_path}/{part}" if part else t.written_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column of ``taken`` has it (names differ only by case count as equal)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
