"""Helpers shared by the corpus operators: shared folder, written tables, text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Sides of at most so many rows may be broadcast by hand; callers count them first.
BROADCAST_ROWS = 500_000

_own_dir: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; an own one only where that is unset, and only in
    local mode, where driver and executors share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="lodestitch-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestitch/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut there,
    lost executors cost nothing that was written, and later readers see real sizes."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)  # with the application, whose results alone read it
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lodestitch/" in folder:
                system, at = _file_system(df.sparkSession, folder)
                system.delete(at, True)


def clear(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all tables of ``materialize`` that are still there but those of ``keep``."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in keep for f in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[1] not in kept]:
        system, at = _file_system(spark, path)
        system.delete(at, True)
        _written.remove(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if a written table has at most ``limit`` rows (counts from its footers)."""
    return df.count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow written table within ``limit`` rows; beyond that the
    join shuffles, and adaptive execution splits what is skewed."""
    return F.broadcast(df) if small(df, limit) else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name, i = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
