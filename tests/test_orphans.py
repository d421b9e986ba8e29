from datetime import datetime

import pytest

from codeweft.operators.orphans import find_orphans, orphan_report

from .conftest import rows

NODE = "id string, ord long, parsed_at timestamp_ntz, deleted_at timestamp_ntz, parent_id string, state string, level int, v string"
CALL = "id long, caller_id string, callee_id string, recorded_at timestamp_ntz, table_name string, origin string"
INH = "id long, parent_id string, recorded_at timestamp_ntz"
REF = "id long, target_id string, recorded_at timestamp_ntz"
T = [datetime(2025, m, 1) for m in range(1, 10)]


def edges(spark, calls=(), inh=(), ref=()):
    pad = lambda r: (*r, "x", "y")
    return {
        "ir_call_edges": spark.createDataFrame([pad(r) for r in calls], CALL),
        "ir_inheritance_edges": spark.createDataFrame(list(inh), INH),
        "ir_reference_edges": spark.createDataFrame(list(ref), REF),
    }


def nodes(spark, data):
    return spark.createDataFrame([(*r, "s", 7, "v") for r in data], NODE)


def test_states_and_cascade(spark):
    n = nodes(spark, [
        ("a", 1, T[0], None, None), ("b", 1, T[0], None, None), ("b", 2, T[1], T[2], None), ("c", 5, T[4], None, None), ("c", 4, T[3], None, None),
        ("d", 1, T[0], None, "gone"), ("e", 1, T[0], None, "d"), ("f", 1, T[0], None, "e"), ("g", 1, T[0], None, " "), (None, 1, T[0], None, "gone"), ("h", 3, T[0], T[1], "x"), ("h", 3, T[0], T[1], "x"),
    ])
    e = edges(
        spark,
        [(1, "a", "b", T[5]), (1, "a", "b", T[5]), (2, "c", None, T[1]), (3, "c", "", T[5]), (4, "zz", "\t ", T[5]), (5, "f", "d", T[5]), (6, "c", "c", None), (7, None, "h", T[0])],
        [(1, "g", T[3]), (2, "nope", T[3])],
        [(1, None, None), (2, "e", T[2])],
    )
    out = find_orphans(n, e)
    direct = rows(out.where("origin = 'direct'"), "table_name", "field_name", "edge_id", "state")
    assert direct == sorted([
        ("ir_call_edges", "callee_id", 1, "deleted"), ("ir_call_edges", "callee_id", 1, "deleted"), ("ir_call_edges", "caller_id", 2, "late"), ("ir_call_edges", "caller_id", 4, "missing"),
        ("ir_call_edges", "callee_id", 7, "deleted"), ("ir_inheritance_edges", "parent_id", 2, "missing"),
    ], key=repr)
    below = rows(out.where("origin = 'inherited'"), "table_name", "edge_id", "ref_id", "level")
    assert below == [("ir_call_edges", 5, "d", 1), ("ir_call_edges", 5, "f", 3), ("ir_reference_edges", 2, "e", 2)]
    report = {(r.table_name, r.month, r.origin, r.state): r.n for r in orphan_report(out).collect()}
    assert report[("ir_call_edges", "2025-06", "direct", "deleted")] == 1


def test_circles_end(spark):
    n = nodes(spark, [("a", 1, T[0], None, "b"), ("b", 1, T[0], None, "a"), ("c", 1, T[0], None, "c")])
    assert find_orphans(n, edges(spark, [(1, "a", "c", T[1])])).count() == 0


@pytest.mark.parametrize("full", [False, True])
def test_empty(spark, full):
    n = nodes(spark, [("a", 1, T[0], None, None)] if full else [])
    assert find_orphans(n, edges(spark)).count() == 0
    assert find_orphans(nodes(spark, []), edges(spark, [(1, "a", None, T[1])])).count() == 1
    assert find_orphans(n, edges(spark, [(None, None, None, None)])).count() == 0


def test_hot_id(spark):
    e = edges(spark, [(i, "hot" if i % 3 else f"x{i}", None, T[1]) for i in range(3000)])
    assert find_orphans(nodes(spark, [("a", 1, T[0], None, None)]), e).count() == 3000
