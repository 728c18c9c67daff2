"""Session helpers: shared work folder, lineage cuts, skew-safe joins.

Everything written here goes below the folder named by ``spark.checkpoint.dir``,
so that any executor can read it again after another one is lost.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space as trimmed everywhere: ASCII, vertical tab, separators, NEL, all Unicode space characters.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

#: Keys that hold more than this share of the rows are heavy; there are at most ``1 / HEAVY_SHARE`` of them.
HEAVY_SHARE = 0.002

#: A side is broadcast only if it was counted and measured to stay below both bounds.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

_made: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that all executors share. A local one is set only where the session names none and runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("the session names no shared folder: set spark.checkpoint.dir")
    local = "file://" + tempfile.mkdtemp(prefix="strandworks-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end all tables written inside of it: results must be written or collected by then.

    Without it, tables stay until the interpreter ends, as later plans may read them.
    """
    before = len(_made)
    try:
        yield
    finally:
        for spark, path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


class Workspace:
    """Tables written below the shared folder; a write computes its plan once and cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _made.append((spark, self.root))

    def cut(self, df: DataFrame, **observed: Column) -> DataFrame:
        """The table, written. Aggregates named in ``observed`` are taken in passing, into ``_observed`` of the result."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        seen = Observation(f"{uuid.uuid4().hex}")
        (df.observe(seen, *[c.alias(n) for n, c in observed.items()]) if observed else df).write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._work_path = path
        kept._observed = seen.get if observed else {}
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for t in tables:
            if path := getattr(t, "_work_path", None):
                _delete(self.spark, path)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size must not exceed ``limit``; raises instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the limit or use the sharded form")
    return rows


def trim_all(c: Column) -> Column:
    """Trims every kind of white space at both ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys with more than ``share`` of all rows: at most ``1 / share`` rows whatever the input."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg((F.count(F.lit(1)) * F.lit(float(share))).alias("_least"))
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_least")).select(key)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table was measured to be within the broadcast bounds: its rows are counted, its texts' bytes summed."""
    seen = getattr(df, "_observed", None) or {}
    if "_rows" not in seen:
        seen = df.agg(*[c.alias(n) for n, c in sizes_of(df).items()]).first().asDict()
    return seen["_rows"] <= rows and (seen["_bytes"] or 0) <= size


def sizes_of(df: DataFrame) -> dict[str, Column]:
    """Aggregates by which ``fits_broadcast`` judges a table: rows and bytes. ``cut`` takes them in passing."""
    width = F.lit(0).cast("bigint")
    for f in df.schema:
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(16))
    return {"_rows": F.count(F.lit(1)), "_bytes": F.sum(width)}


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """The columns of a written table under other names, with what was observed of it."""
    out = df.toDF(*names)
    out._observed = getattr(df, "_observed", {})
    return out


def spread(df: DataFrame) -> DataFrame:
    """Rows spread over all cores before a costly Python pass, where the scan has fewer partitions than these.

    Plans with a shuffle are left as they are: their partitions follow from it, and asking for
    their number would run it.
    """
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.toRdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def skew_lookup(big: DataFrame, key: str, small: DataFrame, small_key: str, how: str = "left", share: float = HEAVY_SHARE) -> DataFrame:
    """Joins ``big`` to ``small`` (unique in ``small_key``) without gathering a hot key in one task.

    A small side that was measured to fit is broadcast whole. Beyond that bound, heavy keys are
    found by a pre-aggregated count; their few entries are broadcast and their rows stay where
    they are, all others are shuffled. ``how`` is ``left`` or ``inner``. Both inputs are read
    twice, so pass written tables or scans.
    """
    spark = big.sparkSession
    if fits_broadcast(small):
        return big.join(F.broadcast(small), big[key] == small[small_key], how).drop(small[small_key])
    hot = [r[0] for r in collect_bounded(heavy_keys(big.filter(F.col(key).isNotNull()), key, share), int(1 / share) + 1, "heavy keys")]
    if not hot:
        return big.join(small, big[key] == small[small_key], how).drop(small[small_key])
    keys = F.broadcast(spark.createDataFrame([(h,) for h in hot], f"_hot {big.schema[key].dataType.simpleString()}"))
    hot_small = F.broadcast(small.join(keys, small[small_key] == F.col("_hot"), "left_semi"))
    hot_big = big.join(keys, big[key] == F.col("_hot"), "left_semi")
    rest = big.join(keys, big[key] == F.col("_hot"), "left_anti")
    return rest.join(small, rest[key] == small[small_key], how).drop(small[small_key]).unionByName(hot_big.join(hot_small, hot_big[key] == hot_small[small_key], how).drop(hot_small[small_key]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
