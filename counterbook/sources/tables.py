"""Sources and sinks: table reads by name, JSON request envelopes, writes
of new table versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of its own file system (the cluster's default one without a scheme)."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Full scan of one table by name (``root/name`` or ``root/name.parquet``).
    With a schema only those columns are read (projection reaches the scan)."""
    path = f"{root.rstrip('/')}/{name}"
    if fmt == "parquet" and not name.endswith(".parquet") and not _exists(spark, path) and _exists(spark, path + ".parquet"):
        path = path + ".parquet"  # single-file tables
    reader = spark.read.format(fmt)
    df = reader.load(path)
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """The same table read from a PostgreSQL database over JDBC (the driver
    jar must be on the classpath); partitioned reads when bounds are given."""
    opts = dict(properties or {})
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=opts)
    return spark.read.jdbc(url, table, properties=opts)


def read_envelopes(spark: SparkSession, path: str, resource: str, schema: T.StructType,
                   wrappers: list[str] | None = None) -> DataFrame:
    """JSON request bodies, one per line, either bare (``{...fields}``) or
    wrapped under one of ``wrappers`` (default ``[resource, resource + "s"]``;
    the reversal endpoint uses ``["bank_deposit_reversal", "bank_deposit"]``).
    The first wrapper holding an object wins, else the bare fields. Returns
    rows with ``schema``'s columns."""
    names = wrappers or [resource, resource + "s"]
    raw = spark.read.schema(envelope_schema(resource, schema, names)).json(path)
    return envelope_body(raw, resource, schema, names)


def read_envelopes_checked(spark: SparkSession, path: str, resource: str, schema: T.StructType,
                           wrappers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Like ``read_envelopes``, with malformed bodies set aside: (rows, malformed). A line is malformed if it is no JSON object, or if a field cannot be read as
    its declared type; it comes out once in ``malformed`` (body, reason: 'not a JSON object' or 'a field has another type') and not
    as a row. Blank lines are no bodies."""
    names = wrappers or [resource, resource + "s"]
    kept = envelope_schema(resource, schema, names)
    bad = "__malformed"
    wide = T.StructType([*kept.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": bad}).alias("__body"))
    broken = F.col("__body").isNull() | F.col(f"__body.{bad}").isNotNull() | ~F.ltrim("value").startswith("{")
    whole = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    rows = envelope_body(parsed.filter(~broken).select("__body.*").drop(bad), resource, schema, names)
    return rows, parsed.filter(broken).select(F.col("value").alias("body"), F.when(whole, F.lit("a field has another type")).otherwise(F.lit("not a JSON object")).alias("reason"))


def envelope_schema(resource: str, schema: T.StructType, wrappers: list[str] | None = None) -> T.StructType:
    """Read schema covering the bare and the wrapped shapes of a body."""
    names = wrappers or [resource, resource + "s"]
    return T.StructType(list(schema.fields) + [T.StructField(w, schema) for w in names])


def envelope_body(raw: DataFrame, resource: str, schema: T.StructType, wrappers: list[str] | None = None) -> DataFrame:
    """Unwrap bodies read with ``envelope_schema`` (batch or streaming frame):
    a wrapped object wins whenever its key holds an object, even an empty one
    (any object is truthy); a missing or null wrapper falls through."""
    names = wrappers or [resource, resource + "s"]
    bare = F.struct(*[F.col(f.name) for f in schema.fields])
    body = F.coalesce(*[F.col(w) for w in names], bare)
    return raw.select(body.alias("__b")).select("__b.*")


def write_version(df: DataFrame, root: str, name: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None, cluster_by: list[str] | None = None,
                  max_records_per_file: int | None = None) -> str:
    """Write a new table version to a fresh path (``root/name/v=<uuid>``);
    never over a path that is being read. ``partition_by`` lays the version out
    in folders (e.g. ledgers by ``business_date``, so daily closing runs and
    registers prune to the days they read); ``cluster_by`` sorts rows within
    each output task by the given keys (min/max statistics then skip row
    groups for point and range probes on those keys)."""
    path = f"{root.rstrip('/')}/{name}/v={uuid.uuid4().hex}"
    out = df
    if cluster_by:
        out = out.sortWithinPartitions(*(list(partition_by or []) + list(cluster_by)))
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, bucket_by: list[str], num_buckets: int,
                   mode: str = "overwrite") -> None:
    """Save a catalog table bucketed (and sorted) by ``bucket_by``. Tables
    bucketed the same way on their join key -- orders, order items and
    payments on the order id -- are joined and aggregated on that key without
    shuffling either side."""
    (df.write.mode(mode).format("parquet")
     .bucketBy(num_buckets, *bucket_by).sortBy(*bucket_by)
     .saveAsTable(table))
