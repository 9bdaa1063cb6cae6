"""Session helpers: table access, durable intermediates in the shared folder, bounded driver reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once in an application: their Python workers need not have it installed, nor start in its folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="larkspur-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := f"{folder}/larkspur-code.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; whatever queries do with it, executors have the code."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset in local mode (tests), a temporary one is set, on a cluster it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def durable(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The result has no lineage to recompute, survives lost executors and is read column by column.
    The table goes away with the application. compression is the session's unless one is named, for tables as large as the texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def workers(df: DataFrame) -> int:
    """Partitions that keep all cores busy: the shuffle partitions, which grow with the input, and at least the cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores, for costly maps over few files; a larger scan stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size has a fixed bound; an error, never a cut, when the bound does not hold."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows, too many for the driver")
    return rows


def latest(df: DataFrame, keys: list[str], by: str, wide: bool = False) -> DataFrame:
    """One row per key, the one delivered last; equal deliveries give one row. Partial maxima are formed before the shuffle, so a key delivered any number of times stays small.

    wide: the rows left are spread over all cores whatever their size, for costly maps that follow.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [by, *[c for c in rest if c != by]]
    types = dict(df.dtypes)
    plain = [c for c in order if not types[c].startswith("map")]
    picked = F.max_by(F.struct(*rest), F.struct(*plain)).alias("_row")
    once = df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    # by a hash of the keys: by the keys themselves, the shuffle of the maxima would be taken for it and made small again
    return once.repartition(workers(df), F.xxhash64(*keys)) if wide else once


def latest_of_few(df: DataFrame, key: str, by: str, most: int = 2_000_000) -> DataFrame:
    """latest for wide rows of which few come again: only these are shuffled, all others stay where they were read.

    The keys that come again are found from the key alone and go to the executors; if there are more than `most`, which is counted, it is latest.
    """
    again = durable(df.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again"))
    if again.count() > most:
        return latest(df, [key], by)
    known, same = F.broadcast(again), F.col(key).eqNullSafe(F.col("_again"))
    return df.join(known, same, "left_anti").unionByName(latest(df.join(known, same, "left_semi"), [key], by).select(df.columns))
