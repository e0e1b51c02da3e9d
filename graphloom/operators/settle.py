"""Cutting the lineage of iterative plans in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a settled side that may be broadcast, about 100 bytes each; a larger one is shuffled.
SMALL = 50_000


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir, which all executors share.

    Where neither is set, a folder of this machine will do in local mode only; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc.applicationId not in _own else None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _own[sc.applicationId]


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder of scratch tables when the driver ends."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
        forget_at_exit(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A settled frame with a broadcast hint if it has no more rows than most, so that what it meets stays in place."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Keys of a frontier that reach the scan of what it meets.
FEW = 256


def met(front: DataFrame, key: str, rows: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """A settled front and rows, ready to be joined on key = at.

    Of a front of few rows the keys are told to the scan, so that files in the order of `at` are read in part; one of
    more rows than SMALL is shuffled with the rows.
    """
    first = [r[0] for r in front.select(key).limit(FEW + 1).collect()]
    if len(first) > FEW:
        return narrow(front), rows
    tests = [F.col(at) == F.lit(k) for k in sorted({k for k in first if k is not None})]
    while len(tests) > 1:  # a balanced tree of alternatives, all of which are pushed down
        tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + (tests[-1:] if len(tests) % 2 else [])
    return F.broadcast(front), rows.where(tests[0] if tests else F.lit(False))
