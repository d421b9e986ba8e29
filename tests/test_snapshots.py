import random
from datetime import datetime, timedelta

from codeweft.operators.snapshots import snapshot_changes, snapshot_order

from .conftest import rows

META = "repo_id string, snapshot_id long, git_commit string, last_indexed_at timestamp_ntz, seq string, label string"
FILES = "repo_id string, snapshot_id long, path string, sha256 string, indexed_at timestamp_ntz, chunk string, side int"
T = datetime(2025, 1, 1)


def meta(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], META)


def files(spark, data):
    return spark.createDataFrame([(*r, "c", 1) for r in data], FILES)


def test_spellings_and_deliveries(spark):
    m = meta(spark, [("r", 9, "AB", T), ("r", 5, "ab ", T + timedelta(days=3)), ("r", 2, None, T + timedelta(days=1)), ("r", 2, None, T + timedelta(days=1)), ("r", 7, "", T + timedelta(days=2)), (None, 1, "x", T), ("r", None, "x", T)])
    order = {(r.snapshot_id, r.seq, r.label) for r in snapshot_order(m).collect()}
    assert order == {(9, 1, 5), (5, 1, 5), (2, 2, 2), (7, 3, 7)}
    f = files(spark, [
        ("r", 9, "a/x.py", "AA", T), ("r", 5, "a/y.py", "bb", T), ("r", 9, "z", None, T),
        ("r", 2, "./a//x.py", "sha256:aa ", T), ("r", 2, "a\\y.py", "cc", T), ("r", 2, "a\\y.py", "dd", T - timedelta(1)), ("r", 2, "z", "zz", T), ("r", 2, None, "q", T), ("r", 2, " ", "q", T), ("r", 99, "n", "q", T),
    ])
    out = rows(snapshot_changes(f, m), "snapshot_id", "path", "change_kind")
    # Snapshot 7 has no files: everything of 2 is removed. A null hash is no change.
    assert out == sorted([(2, "a/y.py", "changed"), (7, "a/x.py", "removed"), (7, "a/y.py", "removed"), (7, "z", "removed")], key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    m, f, state = [], [], {}
    want = set()
    for s in range(6):
        m.append(("r", 100 - s, f"c{s}", T + timedelta(days=s)))
        old = dict(state)
        for k in range(40):
            p = f"d{rnd.randrange(9)}/f{rnd.randrange(30)}.py"
            if rnd.random() < 0.3:
                state.pop(p, None)
            else:
                state[p] = f"h{rnd.randrange(1000)}"
        f += [("r", 100 - s, p, h, T) for p, h in state.items()]
        if s:
            for p in old.keys() | state.keys():
                if p not in old:
                    want.add((100 - s, p, "added"))
                elif p not in state:
                    want.add((100 - s, p, "removed"))
                elif old[p] != state[p]:
                    want.add((100 - s, p, "changed"))
    for mean in (1, 3, 1000):
        got = {tuple(r) for r in snapshot_changes(files(spark, f), meta(spark, m), mean).select("snapshot_id", "path", "change_kind").collect()}
        assert got == want


def test_empty(spark):
    assert snapshot_changes(files(spark, []), meta(spark, [])).count() == 0
    assert snapshot_changes(files(spark, []), meta(spark, [("r", 1, "a", T), ("r", 2, "b", T)])).count() == 0
    assert snapshot_changes(files(spark, [(None, None, None, None, None)]), meta(spark, [("r", 1, "a", None)])).count() == 0
