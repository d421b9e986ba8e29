from datetime import datetime, timedelta

import pytest

from codeweft.operators.incremental import Manifest, latest_rows, replay_runs

from .conftest import rows

FILES = "repo_id string, path string, sha256 string, size_bytes long, indexed_at timestamp_ntz, first_run int, seq int, run_id long"
RUNS = "run_id long, started_at timestamp_ntz, status string, path string"
T = datetime(2025, 1, 1)
D = timedelta(days=1)


def files(spark, data):
    return spark.createDataFrame([(*r, 5, 5, 5) for r in data], FILES)


def runs(spark, data):
    return spark.createDataFrame([(*r, "p") for r in data], RUNS)


def test_replay(spark):
    f = files(spark, [
        ("r", "a.py", "1", 1, T), ("r", "./a.py", "1", 1, T + D), ("r", "a.py", "2", 1, T + 3 * D), ("r", "a.py", "1", 1, T + 5 * D), ("r", "a.py", "1", 1, T + 5 * D),
        ("r", "b.py", "x", 1, T + 2 * D), ("r", "b.py", "y", 1, T + 2 * D), ("r", "late.py", "z", 1, T + 50 * D), ("r", None, "q", 1, T), ("r", "n.py", None, None, T), ("r", "t.py", "t", None, None), (None, "u", "u", 1, T),
    ])
    r = runs(spark, [(10, T + D, "succeeded"), (11, T + 2 * D, "failed"), (12, T + 4 * D, " Succeeded"), (13, T + 6 * D, "succeeded"), (13, T + 6 * D, "succeeded"), (14, None, "succeeded"), (15, T + 7 * D, None), (9, T - D, "succeeded")])
    assert rows(replay_runs(f, r), "run_id", "path", "sha256") == [(10, "a.py", "1"), (12, "a.py", "2"), (12, "b.py", "y"), (13, "a.py", "1")]


def test_failure_before_commit_loses_and_repeats_nothing(spark, tmp_path):
    f = files(spark, [("r", "a", "1", 1, T), ("r", "b", "1", 1, T)])
    m = Manifest(spark, f"file://{tmp_path}/m")
    listing = latest_rows(f)
    m.write_batch(1, listing)  # dies here
    assert m.batches().count() == 0
    m.write_batch(1, listing)  # tried again, dies again
    assert m.process(2, listing) and m.batches().count() == 2
    assert not m.process(2, listing)
    assert m.process(3, listing)
    assert rows(m.batches(), "run_id", "path") == [(2, "a"), (2, "b")]
    changed = latest_rows(files(spark, [("r", "a", "9", 1, T)]))
    m.process(4, changed)
    assert rows(m.last_taken(), "path", "sha256") == [("a", "9"), ("b", "1")]


def test_commit_order_and_retry_after_partial_state(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    m.process(7, latest_rows(files(spark, [("r", "a", "1", 1, T)])))
    m.process(3, latest_rows(files(spark, [("r", "a", "2", 1, T)])))
    assert m.committed() == [(1, 7), (2, 3)]
    assert rows(m.last_taken(), "sha256") == [("2",)]


@pytest.mark.parametrize("some", [False, True])
def test_empty(spark, some):
    f = files(spark, [("r", "a", "1", 1, T)] if some else [])
    assert replay_runs(f, runs(spark, [])).count() == 0
    assert replay_runs(f, runs(spark, [(1, T + D, "succeeded")])).count() == int(some)


def test_states_stand_for_the_batches_before(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    for k in range(4):
        m.process(k, latest_rows(files(spark, [("r", "a", str(k), 1, T), ("r", f"p{k}", "x", 1, T)])))
    want = rows(m.last_taken(), "path", "sha256")
    m.compact()
    assert m.state_seq() == 4 and rows(m.last_taken(), "path", "sha256") == want
    m.process(9, latest_rows(files(spark, [("r", "a", "3", 1, T), ("r", "p1", "y", 1, T)])))
    assert rows(m.batches().where("run_id = 9"), "path", "sha256") == [("p1", "y")]
    assert ("p1", "y") in rows(m.last_taken(), "path", "sha256") and len(rows(m.last_taken())) == 5


def test_thousands_of_runs(spark):
    import random

    rnd = random.Random(4)
    n, hour = 5_000, timedelta(hours=1)
    r = runs(spark, [(k, T + k * hour, rnd.choice(["succeeded", "succeeded", "failed"])) for k in range(n)])
    data = [("r", f"p{rnd.randrange(40)}", str(rnd.randrange(3)), 1, T + timedelta(minutes=rnd.randrange(60 * n))) for _ in range(2_000)]
    want, at = [], {}
    ok = [(x.run_id, x.started_at) for x in r.where("status = 'succeeded'").orderBy("started_at").collect()]
    rest = sorted(data, key=lambda x: (x[4], x[2]))
    i = 0
    for run, began in ok:
        newest = {}
        while i < len(rest) and rest[i][4] <= began:
            newest[rest[i][1]] = rest[i][2]
            i += 1
        for p, sha in newest.items():
            if at.get(p) != sha:
                want.append((run, p, sha))
            at[p] = sha
    assert rows(replay_runs(files(spark, data), r, at_once=1_000), "run_id", "path", "sha256") == sorted(want, key=repr)


def test_runs_caught_up_together_take_what_each_would_alone(spark, tmp_path):
    data = [("r", "a", "1", 1, T), ("r", "a", "2", 1, T + D), ("r", "a", "2", 1, T + 2 * D), ("r", "a", "1", 1, T + 3 * D), ("r", "b", "1", 1, T + 2 * D)]
    log = runs(spark, [(k, T + k * D, "succeeded") for k in (1, 2, 3, 4)])
    alone, both = (rows(replay_runs(files(spark, data), log, f"file://{tmp_path}/m{k}", k), "run_id", "path", "sha256") for k in (1, 3))
    assert alone == both == [(1, "a", "2"), (2, "b", "1"), (3, "a", "1")]
    # Tried again over the same folder nothing is taken twice; a run that is new takes its part alone.
    m = Manifest(spark, f"file://{tmp_path}/m3")
    assert [r for _, r in m.committed()] == [1, 2, 3, 4]
    listing = files(spark, [("r", "a", "9", 1, T)]).select("repo_id", "path", "sha256", "size_bytes")
    from pyspark.sql import functions as F

    assert not m.process([3, 4], listing.withColumn("run_id", F.lit(4).cast("long")))
    assert m.process([4, 5], listing.withColumn("run_id", F.explode(F.array(F.lit(4).cast("long"), F.lit(5).cast("long")))))
    assert rows(m.batches().where("seq = 5"), "run_id", "path", "sha256") == [(5, "a", "9")]
