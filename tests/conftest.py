import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("CODEWEFT_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("codeweft-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def smallest():
    d = DATA / "sf0.001"
    if not d.exists():
        pytest.skip("no test tables here")
    return str(d)


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def dirty_tables(folder, target, kind):
    """The tables of `folder` written to `target`: `empty`, with a row of nulls (`nulls`), every row twice (`twice`), or
    with further columns whose names operators use themselves (`wide`)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for p in Path(folder).glob("*.parquet"):
        t = pq.read_table(p)
        if kind == "empty":
            t = t.slice(0, 0)
        elif kind == "nulls":
            t = pa.concat_tables([t, pa.table({f.name: pa.nulls(1, f.type) for f in t.schema}, schema=t.schema)])
        elif kind == "twice":
            t = pa.concat_tables([t, t])
        else:
            for c in "v seq path id level chunk n h1 h2 side root depth block exit up why share kind word pair key tokens copy position begin source text size hit all dir gap line name params telling grp label last began".split():
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["clash"] * len(t)))
        pq.write_table(t, f"{target}/{p.name}")
    return str(target)


def check_dirty(spark, folder, tmp_path, kind, queries):
    """Queries give the same rows over dirty tables as over clean ones, and none over empty ones."""
    where = dirty_tables(folder, tmp_path, kind)
    for name, f in queries.items():
        got = [tuple(r) for r in f(spark, where).collect()]
        if kind == "empty":
            assert not got, name
        else:
            want = {tuple(str(x) for x in r) for r in f(spark, folder).collect()}
            assert {tuple(str(x) for x in r) for r in got} == want, name
