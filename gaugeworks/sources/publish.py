"""Tables that are published whole, behind gates that cost no pass of their own.

A version is a folder of Parquet files that nothing changes once it is written.  The name
of the current one is in a small file that is replaced by a rename, last of all; readers
take the name and read that folder, so they see the old version whole or the new one,
and keep it while others publish.  Gates are aggregates observed while the version is
written: if one doesn't hold, the name isn't changed and the version stays unseen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.gates import GateError

CURRENT, STAGED = "_current", "_staged"


@dataclass(frozen=True)
class Gate:
    """A named aggregate of the rows written, and what must hold of its value."""

    name: str
    metric: Column
    holds: Callable[[object], bool]


def every_row(name: str, condition: Column) -> Gate:
    """Every row satisfies the condition; NULL does not."""
    return Gate(name, F.count_if(~F.coalesce(condition, F.lit(False))), lambda n: n == 0)


def share_between(name: str, flag: Column, low: float, high: float) -> Gate:
    """The share of rows with the flag; no rows hold no share."""
    return Gate(name, F.avg(F.coalesce(flag, F.lit(False)).cast("double")), lambda x: x is not None and low <= x <= high)


def rows_between(name: str, low: int, high: int) -> Gate:
    return Gate(name, F.count(F.lit(1)), lambda n: low <= n <= high)


def equal_sums(name: str, a: Column, b: Column, tolerance: float = 0.0) -> Gate:
    """Two columns add up to the same."""
    return Gate(name, F.coalesce(F.sum(a), F.lit(0)) - F.coalesce(F.sum(b), F.lit(0)), lambda x: abs(x) <= tolerance)


def largest_share_at_most(name: str, column: Column, values: Sequence[str], most: float, least_values: int = 1) -> Gate:
    """Of the stated values at least so many occur, and none on more than a share of the rows."""
    each = F.array(*(F.count_if(column == F.lit(v)) for v in values), F.count(F.lit(1)))

    def holds(counts) -> bool:
        *found, n = counts
        return sum(x > 0 for x in found) >= least_values and max(found) <= most * n

    return Gate(name, each, holds)


def file_system(spark: SparkSession, root: str):
    """Hadoop's file system of a folder, and its class of paths: whatever Spark can write to."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, at = file_system(spark, path)
    out = files.create(at(path), True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    files, at = file_system(spark, path)
    if not files.exists(at(path)):
        return None
    stream = files.open(at(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the published version; None before the first."""
    return read_text(spark, f"{root.rstrip('/')}/{CURRENT}")


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Replaces the name of the current version by a rename over it, which readers see done or not done."""
    root = root.rstrip("/")
    staged = f"{root}/{STAGED}-{uuid.uuid4().hex}"
    write_text(spark, staged, version)
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(hadoop.Path(root).toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(hadoop.Path(staged), hadoop.Path(f"{root}/{CURRENT}"), overwrite)


def publish(rows: DataFrame, root: str, gates: Sequence[Gate] = (), partition_by: Sequence[str] = ()) -> str:
    """Writes a new version, checks the gates on what was written, and makes it the current one; returns its name.

    One pass over ``rows``: the gates' aggregates are observed by the write itself.  Raises
    ``GateError`` with all gates that don't hold; the current version is then what it was,
    and the folder of the refused one is removed.  An empty table is a version too.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    observation = Observation(version)
    observed = rows.observe(observation, *(g.metric.alias(f"m{k}") for k, g in enumerate(gates))) if gates else rows
    observed.write.partitionBy(*partition_by).parquet(f"{root}/{version}")
    if gates:
        found = observation.get
        broken = [f"{g.name}: {found[f'm{k}']}" for k, g in enumerate(gates) if not g.holds(found[f"m{k}"])]
        if broken:
            files, at = file_system(spark, root)
            files.delete(at(f"{root}/{version}"), True)
            raise GateError("; ".join(broken))
    point_to(spark, root, version)
    return version


def published(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current version, or a named one, as it was published."""
    name = version or current_version(spark, root)
    if name is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def drop_versions(spark: SparkSession, root: str, keep: Sequence[str] = ()) -> list[str]:
    """Removes versions other than the current one and those to keep; returns the names of the removed."""
    root = root.rstrip("/")
    files, at = file_system(spark, root)
    stays = {current_version(spark, root), *keep}
    found = sorted(s.getPath().getName() for s in files.listStatus(at(root)) if s.isDirectory())
    gone = [name for name in found if name.startswith("v-") and name not in stays]
    for name in gone:
        files.delete(at(f"{root}/{name}"), True)
    return gone
