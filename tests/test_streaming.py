from codeweft.operators.incremental import Manifest
from codeweft.streaming.listing import consume

from .conftest import rows

FILES = "repo_id string, path string, sha256 string, size_bytes long, indexed_at timestamp"


def test_micro_batches(spark, tmp_path):
    put = lambda name, *data: spark.createDataFrame(list(data), "repo_id string, path string, sha256 string, size_bytes long").selectExpr("*", "timestamp '2025-01-01' as indexed_at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put("1", ("r", "a.py", "1", 3), ("r", "./b.py", "2", 3))
    taken = []

    def run():
        q = consume(spark.readStream.schema(FILES).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/m", f"file://{tmp_path}/c", lambda df, k: taken.append(sorted(r.path for r in df.collect())))
        q.awaitTermination()

    run()
    put("2", ("r", "a.py", "1", 3), ("r", "b.py", "9", 3))
    run()
    run()
    assert taken == [["a.py", "b.py"], ["b.py"]]
    assert rows(Manifest(spark, f"file://{tmp_path}/m").last_taken(), "path", "sha256") == [("a.py", "1"), ("b.py", "9")]
