"""Sources: table scans with pushed filters and the crawled-page corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "jdbc")


def scan(spark: SparkSession, path: str, predicate: Column | str | None = None, columns: list[str] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Read a table; the filter and the column list reach the scan."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt).options(**options)
    df = reader.load() if fmt == "jdbc" else reader.load(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Crawled pages (page_id, url, html)."""
    return scan(spark, f"{sf}/pages.parquet", columns=["page_id", "url", "html"])


#: Texts that one task of pattern-heavy work takes at most, but for the chance of their hashes.
TASK_TEXTS = 2048


def spread(df: DataFrame, *key: str) -> DataFrame:
    """A table dealt over all cores before per-row work that costs far more than moving it, few rows to a task.

    Rows are counted (of Parquet tables that reads no column), so that tasks grow in number and not in length. A table
    whose scan has as many splits stays as it is. The key must be unique per row (a page or document id, not a host), so
    that no source can fill one task.
    """
    if df.isStreaming:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_TEXTS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *key)


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own under the folder that driver and executors share.

    That is `spark.checkpoint.dir`; without it a local session takes its warehouse. Elsewhere it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/streams"
    run = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{base.rstrip('/')}/{name}-{run}"


#: Lets shuffle files go when the execution that wrote them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Written once below the shared work folder and read back, for rows that several branches of a query read.

    The branches then don't compute the rows again, and no plan carries their whole history. The shuffle files behind
    the rows go as soon as they are written. settings: of the session while it plans and writes them.
    """
    spark = df.sparkSession
    path, wanted = work_dir(spark, name), {CLEANUP: "true", **(settings or {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Parquet timestamps without zone as instants, which watermarks need."""
    return df.withColumn(col, F.col(col).cast("timestamp"))
