"""Session helpers shared by every operator: scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "/tmp/checkpoints"
_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write.

    The cluster names it in ``spark.checkpoint.dir``; only where that setting is
    absent (single-machine tests) is a folder of our own used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and every executor share")
    spark.sparkContext.setCheckpointDir(_OWN_DIR)
    return _OWN_DIR


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs nothing: the files are the result. Call :func:`discard`
    on tables that no later plan reads; the rest go when the driver exits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def bucketed(df: DataFrame, key: str, tag: str, *, in_place: bool = False) -> DataFrame:
    """Write ``df`` as a table of the shared warehouse in as many buckets of ``key`` as a shuffle has partitions, and read it back.

    Joins and aggregations by the key then find its rows where they are. ``in_place``: the rows are partitioned by the key already. The table goes
    with :func:`discard` or when the driver exits.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tessera_{tag}_{uuid.uuid4().hex}"
    _tables.append((spark, name))
    (df if in_place else df.repartition(n, key)).write.bucketBy(n, key).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._tessera_table = name
    return out


def discard(df: DataFrame) -> None:
    """Delete what is behind a table made by :func:`materialise` or :func:`bucketed`."""
    table = getattr(df, "_tessera_table", None)
    if table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage, so that shuffle files of finished jobs go; else they stay until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)]


@atexit.register
def _delete_all() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
