from pyspark.sql import functions as F

from codeweft.operators import graph as G
from codeweft.operators import resolve as R
from codeweft.render import html

from .conftest import rows

NODE = "repo_id string, id string, name string, kind string, file_path string, start_line int, end_line int, language string, is_exported boolean, parent_id string, parent_class string, calls array<string>, imports array<string>, ord long, dst string, target string"


def node(id_, name, kind="function", file="a.py", line=1, calls=(), parent=None, exported=True, imports=(), language="python", repo="r"):
    return (repo, id_, name, kind, file, line, line, language, exported, parent, None, list(calls), list(imports), 1, "clash", "clash")


def frame(spark, *data):
    return spark.createDataFrame(list(data), NODE)


def calls(spark, *data):
    return spark.createDataFrame([("r", *d) for d in data], "repo_id string, caller_id string, callee_id string, callee_name string")


def inh(spark, *data):
    return spark.createDataFrame([("r", *d) for d in data], "repo_id string, child_id string, parent_id string, parent_name string")


def test_listed_call_only(spark):
    n = frame(spark, node("n1", "foo", file="foo.py"), node("n2", "bar", file="bar.py", calls=["foo"]), node("n3", "MyClass", "class"), node("n4", "method", "method"))
    e = G.merge_edges(G.all_edges(n, calls(spark), inh(spark)))
    assert rows(e, "src", "dst", "type") == [("n2", "n1", "calls")]


def test_legacy_lists(spark):
    n = frame(spark, node("n1", "foo", file="foo.py"), node("n2", "bar", file="bar.py", calls=["foo"]), node("n3", "MyClass", "class", imports=["foo"]), ("r", "n4", "method", "method", "a.py", 2, 2, "python", True, None, "MyClass", [], [], 1, "x", "y"))
    assert rows(R.legacy_edges(n), "src", "dst", "type") == [("n2", "n1", "calls"), ("n3", "n1", "imports"), ("n3", "n4", "defines")]


def test_full_name_beats_leaf_and_stale_callers(spark):
    n = frame(spark, node("a", "m.go"), node("b", "go"), node("c", "go"), node("d", "x"), node("o", "go", repo="other"))
    e = calls(spark, ("d", None, "m.go"), ("d", "", "q.go"), ("gone", None, "go"), ("d", "zz", "go"), ("d", "a", "ignored"), ("d", None, None), (None, None, "go"), ("b", "b", "go"), ("d", None, "m.go"))
    assert rows(R.typed_calls(e, n), "src", "dst") == [("b", "b"), ("d", "a")]
    assert rows(R.named_calls(e, n), "src", "dst") == [("d", "a"), ("d", "b"), ("d", "c")]


def test_imports_by_path_stem_and_name(spark):
    n = frame(spark, node("s", "s.py", "module", "s.py"), node("s2", "f", file="s.py"), node("u", "u.py", "module", "lib/util.py"), node("u2", "g", file="lib/util.py"), node("w", "named", file="zz.py"))
    i = spark.createDataFrame([("r", "s.py", "util"), ("r", "s.py", "lib/util.py"), ("r", "s.py", "x/named.js"), ("r", "s.py", "s"), ("r", "nofile.py", "util"), ("r", "s.py", "nothing")], "repo_id string, source_file string, target_module string")
    assert rows(R.import_edges(i, n), "src", "dst") == [("s", "s2"), ("s", "u"), ("s", "u2"), ("s", "w"), ("s2", "s"), ("s2", "u"), ("s2", "u2"), ("s2", "w")]


def test_inheritance_last_name_wins(spark):
    n = frame(spark, node("c", "C", "class"), node("p1", "P", "class", "a.py", 5), node("p2", "P", "class", "b.py", 1), node("q", "Q", "class"))
    e = inh(spark, ("c", None, "P"), ("c", "q", "P"), ("c", "gone", "P"), ("c", None, "m.P"), ("nochild", None, "P"), ("c", None, None))
    assert rows(R.inheritance_edges(e, n), "src", "dst") == [("c", "p2"), ("c", "q")]


def test_merge_precedence_and_children(spark):
    n = frame(spark, node("a", "A", "class", calls=["b"]), node("b", "b", "method", parent="a"), node("z", "z", parent="missing"))
    e = G.merge_edges(G.all_edges(n, calls(spark), inh(spark)))
    assert rows(e, "src", "dst", "type") == [("a", "b", "defines")]
    assert rows(R.link_children(n).select("id", F.concat_ws(" ", "children").alias("c"))) == [("a", "b")]
    assert rows(G.orphans(n, e), "id") == [("z",)]


def test_entries_and_dead(spark):
    n = frame(
        spark, node("m", "m.py", "module", exported=False), node("x", "main", exported=False), node("C", "Cap", exported=False), node("k", "Klass", "class", exported=False), node("e", "e"),
        node("l1", "l1", exported=False), node("l2", "l2", "method", exported=False), node("r", "r", exported=False, calls=["r"]), node("t", "t", exported=False),
    )
    assert rows(G.entry_points(n), "id") == [("C",), ("e",), ("m",), ("x",)]
    edges = spark.createDataFrame([("r", "l1", "l2", "calls"), ("r", "l2", "l1", "calls"), ("r", "r", "r", "calls"), ("r", "x", "t", "imports")], "repo_id string, src string, dst string, type string")
    assert rows(G.dead_functions(n, edges), "id") == [("l1",), ("l2",), ("r",)]
    assert rows(G.dead_functions(n, edges, ("calls",)), "id") == [("l1",), ("l2",), ("r",), ("t",)]
    assert rows(G.graph_stats(n, edges), "nodes", "edges", "orphans") == [(9, 4, 4)]
    assert rows(G.most_called(edges, n, 2), "id", "callers") == [("l1", 1), ("l2", 1)]
    page = html(n, edges)
    assert '"title": "module : a.py"' in page and "#FFD166" in page


def test_empty(spark):
    n = frame(spark)
    e = G.merge_edges(G.all_edges(n, calls(spark), inh(spark)))
    assert e.count() == 0 and G.dead_functions(n, e).count() == 0 and G.graph_stats(n, e).count() == 0
