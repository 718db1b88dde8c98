"""What the operators share: the scratch folder, staged tables, and salted orders."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the functions themselves, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

_STAGED: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests), and an error on a cluster."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stage(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the scratch folder and returns the table read back.

    This cuts the lineage: a lost executor costs a read, no recomputation, and values that
    depend on how rows were dealt (row numbers) stay as they were written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_staged() -> None:
    for spark, path in _STAGED:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        except Exception:  # the session has ended
            return


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle; sets into how many slices an order is cut."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, one for each stem."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def worker_cache(key: tuple, make):
    """What make() gives, kept for key as long as this Python worker lives (functions travel by value, modules' globals don't stay)."""
    kept = sys.modules.setdefault("_sparkloom_worker", types.ModuleType("_sparkloom_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be cogrouped with what it stems from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
