import random

import pytest

from codeweft.operators.hierarchy import circle_links, current_links, descendants, resolve_hierarchy

from .conftest import rows

LINK = "id string, parent string, block long, exit string, dist int"
NODE = "id string, ord long, parent_id string, children array<string>, deleted_at timestamp_ntz, repo_id string, file_path string, start_line int, v string, by string"


def brute(par):
    out = {}
    for n in par:
        seen, y = [], n
        while True:
            if y in seen:
                ring = seen[seen.index(y) :]
                out[n] = (min(ring), -1 if n in ring else -2)
                break
            seen.append(y)
            p = par[y]
            if p is None or p not in par:
                out[n] = (y, len(seen) - 1)
                break
            y = p
    return out


@pytest.mark.parametrize("one_task", [0, 10_000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_forests(spark, seed, one_task):
    rnd = random.Random(seed)
    n = 400
    par = {f"n{i:03d}": rnd.choice([None, "gone", *[f"n{rnd.randrange(max(0, i - 25), n if rnd.random() < 0.02 else max(1, i)):03d}" for _ in range(8)]]) for i in range(n)}
    df = spark.createDataFrame([(k, v, rnd.randrange(30), "x", 3) for k, v in par.items()], LINK)
    got = resolve_hierarchy(df, with_paths=True, one_task=one_task, partitions=7)
    got.cache()
    want = brute(par)
    assert {r.node_id: (r.root_id, r.depth) for r in got.collect()} == want
    for r in got.collect():
        if r.depth >= 0:
            assert r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.depth + 1
            assert all(par[b] == a for a, b in zip(r.path, r.path[1:]))
        else:
            assert r.path is None
    assert descendants(got).count() == sum(d for _, d in want.values() if d > 0)
    assert circle_links(df, got).count() == sum(d == -1 for _, d in want.values())


def test_long_chain_over_many_partitions(spark):
    n = 3000
    df = spark.createDataFrame([(f"{i:05d}", f"{i - 1:05d}" if i else None, i % 13, "", 0) for i in range(n)], LINK)
    got = {r.node_id: r.depth for r in resolve_hierarchy(df, one_task=0, partitions=5).collect()}
    assert got == {f"{i:05d}": i for i in range(n)}


def test_current_links(spark):
    from datetime import datetime

    t = datetime(2025, 1, 1)
    data = [
        ("a", 1, None, ["b", "b", None, "zz", "d"], None), ("a", 1, None, ["b", "b", None, "zz", "d"], None), ("b", 1, None, None, None), ("c", 1, "a", [], t), ("c", 2, "b", [], None),
        ("d", 1, "x", None, None), ("e", 3, None, None, None), ("e", 3, None, None, t), ("f", 1, "", None, None), ("g", 1, "g", None, None), (None, 1, None, ["b"], None), ("A", 0, None, ["c", "b"], None), ("A", 1, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "r", "f.py", None, "v", "by") for r in data], NODE)
    links = current_links(df)
    assert rows(links, "id", "parent") == sorted([("a", None), ("b", "a"), ("c", "b"), ("d", "x"), ("f", ""), ("g", "g"), ("A", None)], key=repr)
    out = {r.node_id: (r.root_id, r.depth) for r in resolve_hierarchy(links).collect()}
    assert out == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "f": ("f", 0), "g": ("g", -1), "A": ("A", 0)}


def test_empty(spark):
    df = spark.createDataFrame([], NODE)
    assert resolve_hierarchy(current_links(df), with_paths=True).count() == 0


def test_blocks_larger_than_a_task_are_split(spark):
    """One block holds all nodes, one node a third of them as children; circles run over many tasks."""
    n = 1500
    par = {f"{i:05d}": "00000" if i % 3 == 0 and i else (f"{i - 1:05d}" if i % 50 else None) for i in range(n)}
    par |= {f"r{i}": f"r{(i + 1) % 700}" for i in range(700)} | {f"u{i}": f"r{i}" for i in range(0, 700, 70)}
    df = spark.createDataFrame([(k, v, 0, "", 0) for k, v in par.items()], LINK)
    assert {r.node_id: (r.root_id, r.depth) for r in resolve_hierarchy(df, one_task=200).collect()} == brute(par)
