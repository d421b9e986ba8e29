"""Session helpers: table access and lineage cuts in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset (tests, one machine) a new folder is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = _own_dir(spark)
    return where.rstrip("/")


_OWN: dict[str, str] = {}
#: Local folders of this process that go away with it; on a cluster `drop_staged` removes what was staged.
_LOCAL: set[str] = set()
_STAGED: dict[str, list[str]] = {}


@atexit.register
def _forget() -> None:
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


def _own_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codeweft-")
        _LOCAL.add(folder)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a session; needed before any mapInArrow or UDF of ours."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="codeweft-")
    _LOCAL.add(folder)
    target = Path(folder) / "codeweft.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    if spark.sparkContext.master.startswith("local["):
        _LOCAL.add(path.removeprefix("file://"))
    return path


def drop_staged(spark: SparkSession) -> None:
    """Remove every table this session staged; results that still read them are void afterwards."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` into the shared folder and read it back: the lineage ends there, so a lost executor costs nothing
    before it, and the planner knows the real size of what follows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def stage_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`stage`, and how many rows that wrote: counted on the way, so that a loop needs no second job to see its end."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def is_blank(c: Column) -> Column:
    """True for null and for texts without a visible character."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears whole or not at all (written beside, then renamed)."""
    fs, target, jvm = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, target):
        fs.delete(beside, False)
        if not fs.exists(target):
            raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none when it is missing."""
    fs, p, _ = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def plain_path(c: Column) -> Column:
    """A path in plain spelling: relative, single forward slashes, no leading or inner `./`, no blanks around."""
    p = F.regexp_replace(F.trim(c), r"[/\\]+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"^/+", "")


def plain_hash(c: Column) -> Column:
    """A hex digest in lower case without its algorithm's name; null when blank."""
    h = F.lower(F.regexp_replace(F.trim(c), r"^(?i)sha-?256:", ""))
    return F.when(F.trim(h) != "", F.trim(h))


