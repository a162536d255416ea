"""Changes to a table that is stored in partition folders: only the folders that hold changed rows are read as a whole and rewritten.

Finding them reads the key column (and the partition columns, which cost nothing). The new rows are staged in the checkpoint folder, then replace their
folders by Spark's dynamic partition overwrite, which swaps finished folders in when the job commits; a folder that is left without rows is
removed after that. The driver sees the touched folders' values, part of the file listing that it holds anyway, and no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .changes import apply_patches


def _folder() -> F.Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")


def _values(df: DataFrame, by: list[str]) -> set[Row]:
    return set(df.select(*by).distinct().collect())


def _within(df: DataFrame, by: list[str], parts: set[Row]) -> DataFrame:
    """The rows of some partitions; plain predicates on partition columns, so that the listing alone is pruned."""
    if not parts:
        return df.filter(F.lit(False))
    if len(by) == 1:
        values = [p[0] for p in parts if p[0] is not None]
        test = F.col(by[0]).isin(values) if values else F.lit(False)
        return df.filter(test | F.col(by[0]).isNull() if len(values) < len(parts) else test)
    one = [reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in zip(by, p, strict=True)]) for p in parts]
    return df.filter(reduce(lambda a, b: a | b, one))


def _replace(spark: SparkSession, path: str, by: list[str], rows: DataFrame, folders: dict[Row, list[str]]) -> None:
    """The folders now hold ``rows`` (staged: nothing of ``path`` is read any more)."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    kept = _values(rows, by)
    sc = spark.sparkContext
    for gone in (f for part, names in folders.items() if part not in kept for f in names):
        folder = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(gone))
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def _homes(target: DataFrame, by: list[str], keys: DataFrame, key: str) -> dict[Row, list[str]]:
    """The partitions that hold one of ``keys``, with their folders."""
    k = keys.select(F.col(key).alias("__k")).distinct()
    found = target.select(F.col(key).alias("__tk"), *by, _folder().alias("__folder")).join(k, F.col("__tk") == F.col("__k"), "left_semi")
    out: dict[Row, list[str]] = {}
    for r in found.select(F.struct(*by).alias("part"), "__folder").distinct().collect():
        out.setdefault(r["part"], []).append(r["__folder"])
    return out


def patch_partitions(spark: SparkSession, path: str, partition_by: list[str], patches: DataFrame, key: str = "id",
                     seq: str | None = None, table: str | None = None) -> DataFrame:
    """``apply_patches`` to the table stored at ``path``: the folders that hold a patched key are rewritten, and those that a
    patch of a partition column moves a row to. Returns the outcome (patches with ``errors`` and ``matched``)."""
    target = spark.read.parquet(path)
    patches = cut_lineage(patches)
    homes = _homes(target, partition_by, patches, key)
    touched = set(homes)
    outcome, new = apply_patches(_within(target, partition_by, touched), patches, key, seq, table)
    if set(partition_by) & set(patches.columns):
        touched |= _values(new.join(patches.select(key).distinct(), key, "left_semi"), partition_by)
        _, new = apply_patches(_within(target, partition_by, touched), patches, key, seq, table)
    outcome, staged = cut_lineage(outcome), cut_lineage(new)
    if touched:
        _replace(spark, path, partition_by, staged, homes)
    return outcome


def delete_from_partitions(spark: SparkSession, path: str, partition_by: list[str], keys: DataFrame, key: str = "id") -> DataFrame:
    """DELETE ... RETURNING on the table stored at ``path``: the folders that hold a deleted key are rewritten without it. Returns the deleted rows."""
    target = spark.read.parquet(path)
    keys = cut_lineage(keys.select(key).distinct())
    homes = _homes(target, partition_by, keys, key)
    rows = _within(target, partition_by, set(homes))
    gone, staged = cut_lineage(rows.join(keys, key, "left_semi").select(*target.columns)), cut_lineage(rows.join(keys, key, "left_anti").select(*target.columns))
    if homes:
        _replace(spark, path, partition_by, staged, homes)
    return gone
