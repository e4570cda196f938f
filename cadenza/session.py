"""Session helpers: table access, lineage cuts in the shared checkpoint folder, distributed prefix sums."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Python workers of this session find the package where the driver found it (on a cluster: a folder all see, or --py-files)."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_cuts: dict[str, str] = {}  # per application, its folder of cuts


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset (tests, local runs) is a temporary one used.

    The application's part of it is deleted when its driver ends; drop_cuts deletes it before.
    """
    sc = spark.sparkContext
    if (app := sc.applicationId) not in _cuts:
        named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if named is None:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="cadenza-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        _cuts[app] = f"{named.rstrip('/')}/cadenza-{app}"
        path = sc._jvm.org.apache.hadoop.fs.Path(_cuts[app])
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)  # with the driver's JVM
    return _cuts[app]


def cut(df: DataFrame) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it from there: no lineage, plan or broadcast stays behind.

    The table survives the loss of executors. Tables of an application are dropped by drop_cuts, or when its driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes the application's tables; results that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash_bucket(h: Column, buckets: int) -> Column:
    """Which of ``buckets`` equal ranges of the bigint hashes h lies in; rises with h."""
    return F.floor((F.shiftright(h, 32) + F.lit(float(1 << 31))) * F.lit(buckets / float(1 << 32))).cast("int")


def with_running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows before the row, per ``keys`` (none: over all), in the order of bucket, order.

    No window over a whole key: ``bucket`` (an int of a bounded range that rises with the order) cuts each key
    into ranges, the ranges' sums are accumulated, and a window runs inside each range only. ``order`` should be
    unique; a null weight counts as 0.
    """
    df = df.withColumns({"__b": bucket, "__w": F.coalesce(weight, F.lit(0)).cast("bigint")})
    sums = df.groupBy(*keys, "__b").agg(F.sum("__w").alias("__s"))
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ahead = sums.select(*keys, "__b", (F.sum("__s").over(over.orderBy("__b")) - F.col("__s")).alias("__ahead"))
    inside = F.sum("__w").over(W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("__w")
    return df.withColumn("__in", inside).join(ahead, [*keys, "__b"]).withColumn(out, F.col("__ahead") + F.col("__in")).drop("__b", "__w", "__in", "__ahead")


def in_ranges(df: DataFrame, keys: list[str], value: str, ranges: int = 32) -> DataFrame:
    """Adds __b, which of about ``ranges`` ranges of ``value`` (cut at approximate quantiles per ``keys``) a row is in; equal values share one, null keys are keys."""
    c = df.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("__cuts")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__cuts")
    x = df.crossJoin(F.broadcast(c)) if not keys else df.join(c, [df[k].eqNullSafe(c[f"__k{i}"]) for i, k in enumerate(keys)])  # without keys: one row
    return x.withColumn("__b", F.size(F.filter(F.coalesce("__cuts", F.array().cast(dict(c.dtypes)["__cuts"])), lambda q: q < F.col(value)))).drop("__cuts", *[f"__k{i}" for i in range(len(keys))])


def with_sums_below(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Adds for each of ``sums`` its sum over the rows of lower ``value``, per ``keys``; one row per keys and value is expected.

    As with_running_total, but over ranges of a number and with sums of any kind: no window runs over a whole key.
    """
    names = list(sums)
    x = in_ranges(df, keys, value).withColumns({f"__v_{n}": c for n, c in sums.items()})
    t = x.groupBy(*keys, "__b").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # over ranges
    ahead = t.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__c"), *[F.coalesce(F.sum(f"__s_{n}").over(part.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__a_{n}") for n in names])
    inside = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({f"__i_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in names})
    x = x.join(ahead, [*[x[k].eqNullSafe(ahead[f"__k{i}"]) for i, k in enumerate(keys)], x["__b"] == ahead["__c"]])
    return x.select(*df.columns, *[(F.col(f"__a_{n}") + F.col(f"__i_{n}")).alias(n) for n in names])
