import os

from pyspark.sql import functions as F

from codeweft import cli, pipeline
from codeweft.extract import generic
from codeweft.extract import table as xt
from codeweft.sources import git
from codeweft.sources.ignore import Ignore
from codeweft.sources.store import Store, from_json_columns, to_json_columns
from codeweft.sources.tree import read_tree, suffix, walk

from .conftest import rows


def tree(root):
    for path, text in {
        "src/main.py": "def main():\n    pass\n", "src/utils.py": "def helper():\n    return 42\n", "src/__init__.py": "", "src/auth/login.py": "class LoginView:\n    pass\n", "tests/test_main.py": "def test_main():\n    assert True\n",
        "README.md": "# My Repo\n", "node_modules/something.js": "module.exports = {}", "build/output.js": "var x = 1;", ".hidden/a.py": "x", "skip.py": "x", "deep/skip/a.py": "x", "keep/b.py": "x = 1\n", "data.json": "{}",
        ".gitignore": "skip.py\n/deep/\n*.log\n!keep/b.py\n",
    }.items():
        os.makedirs(os.path.dirname(root / path) or root, exist_ok=True)
        (root / path).write_text(text)
    (root / "bin.py").write_bytes(b"\0\1")
    return root


def test_walk_and_read(spark, tmp_path):
    root = tree(tmp_path / "repo")
    want = ["data.json", "keep/b.py", "src/__init__.py", "src/auth/login.py", "src/main.py", "src/utils.py", "tests/test_main.py"]
    assert sorted(p for p, _ in walk(str(root))) == [".gitignore", *want] or sorted(p for p, _ in walk(str(root))) == want
    df = pipeline.listing(read_tree(spark, str(root), "r"))
    assert rows(df, "path", "line_count", "language")[-3:] == [("src/main.py", 2, "python"), ("src/utils.py", 2, "python"), ("tests/test_main.py", 2, "python")]
    assert rows(df.where("path = 'data.json'"), "language", "size_bytes") == [("json", 2)]


def test_suffix():
    assert [suffix(x) for x in ("a.py", ".bashrc", "a.tar.GZ", "Makefile", "x.", "..y")] == [".py", "", ".gz", "", "", ""]


def test_ignore():
    i = Ignore(["# c", "", "*.log", "/top", "dir/", "a/**/z", "!b.log", "x[0-9].py", "sp\\ ", "q?"])
    assert i("k/a.log") and not i("b.log") and i("top") and not i("k/top") and i("dir", True) and not i("dir") and i("k/dir/f") and i("a/z") and i("a/b/c/z") and i("x1.py") and not i("xa.py") and i("qa") and not i("qab")


def test_git(tmp_path):
    g = tmp_path / "r" / ".git"
    (g / "refs/heads").mkdir(parents=True)
    (g / "HEAD").write_text("ref: refs/heads/dev\n")
    (g / "refs/heads/dev").write_text("abc\n")
    (g / "config").write_text('[remote "origin"]\n\turl = git@h.x:me/p.git\n')
    info = git.resolve(str(tmp_path / "r"))
    assert (info.git_branch, info.git_commit, info.repo_id, info.source_type) == ("dev", "abc", "h_x-me-p", "local_path")
    (g / "HEAD").unlink()
    assert git.head(str(tmp_path / "r"))[:2] == (None, None)
    assert git.is_url("HTTPS://x/y") and not git.is_url("/tmp/x")
    for bad, error in ((tmp_path / "no", FileNotFoundError), (g / "config", NotADirectoryError)):
        try:
            git.resolve(str(bad))
        except error:
            pass
        else:
            raise AssertionError(bad)


def test_incremental_phases(spark, tmp_path):
    root, store = tree(tmp_path / "repo"), Store(spark, f"file://{tmp_path}/store")
    first = pipeline.ingest(spark, store, str(root))
    assert {r.status for r in first.files.collect()} == {"new"}
    pipeline.parse(store, first)
    first.commit(store)
    before = store.version("nodes", "repo")
    assert before and rows(store.find_by_name("repo", "LOGINVIEW"), "name") == [("LoginView",)]
    again = pipeline.ingest(spark, store, str(root))
    assert {r.status for r in again.files.collect()} == {"unchanged"} and again.texts.count() == 0
    again.commit(store)
    assert rows(store.read("files").where("path = 'src/main.py'"), "line_count") == [(2,)]
    (root / "src/main.py").write_text("def renamed():\n    other()\n")
    (root / "src/utils.py").unlink()
    third = pipeline.ingest(spark, store, str(root))
    assert rows(third.files.where("status != 'unchanged'"), "path", "status") == [("src/main.py", "modified"), ("src/utils.py", "deleted")]
    pipeline.parse(store, third)
    third.commit(store)
    assert store.nodes_of_file("repo", "src/utils.py").count() == 0
    assert rows(store.nodes_of_file("repo", "src/main.py").where("kind = 'function'"), "name") == [("renamed",)]
    assert store.nodes_of_kind("repo", "class").count() == 1 and store.snapshot("repo").where("path = 'src/utils.py'").count() == 0
    nodes, edges = pipeline.build_graph(store, "repo")
    assert edges.where("type = 'defines'").count() == 4 and store.load_graph("repo")[0].count() == nodes.count()
    store.prune("nodes", "repo", 1)
    assert store.read("nodes").count() == nodes.count()
    forced = pipeline.ingest(spark, store, str(root), force=True)
    assert {r.status for r in forced.files.collect()} == {"new"}


def test_store_rules(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("nodes").count() == 0 and store.load_graph("r") is None
    one = lambda name, ord_: spark.createDataFrame([("r", ord_, "i", name, "f.py", ["k"])], "repo_id string, ord long, id string, name string, file_path string, calls array<string>")
    store.upsert_nodes("r", one("foo", 1).union(one("foo_later", 2)))
    assert rows(store.read("nodes"), "id", "name") == [("i", "foo_later")]
    store.upsert_nodes("r", one("foo_updated", 1))
    assert rows(store.read("nodes"), "id", "name") == [("i", "foo_updated")]
    store.append("inheritance_edges", "r", spark.createDataFrame([("r", 1, "i", "P", None, "inherits")], "repo_id string, ord long, child_id string, parent_name string, parent_id string, kind string"))
    store.delete_files("r", spark.createDataFrame([("f.py",)], "file_path string"))
    assert store.read("nodes").count() == 0 and store.read("inheritance_edges").count() == 0
    other = one("x", 1).withColumn("repo_id", F.lit("o/ther"))
    store.upsert_nodes("o/ther", other.union(one("not mine", 1)))
    assert store.repos("nodes") == ["o/ther", "r"] and rows(store.read("nodes"), "repo_id", "name") == [("o/ther", "x")]


def test_json(spark):
    n = spark.createDataFrame([("a", ["x"], [("p", "int")], None), ("b", None, None, ["q", None])], "id string, calls array<string>, typed_parameters array<struct<name:string,type:string>>, bases array<string>")
    full = n.withColumns({c: F.array().cast("array<string>") for c in ("children", "parameters", "imports", "decorators", "ref_names")})
    back = from_json_columns(to_json_columns(full))
    assert rows(back, "id", "calls", "typed_parameters", "bases") == [("a", ["x"], [("p", "int")], []), ("b", [], [], ["q", None])]
    assert from_json_columns(to_json_columns(full).withColumn("typed_parameters", F.lit("{bad"))).first().typed_parameters == []


def test_failed_files(spark):
    df = spark.createDataFrame([("r", "a.py", "python", None), ("r", "b.py", "python", "def f(:\n"), ("r", "p.json", "json", "{}"), ("r", "x.py", "python", ""), ("r", "big.py", "python", "x = 1\n" * 50_000), (None, "n.py", "python", "y = 2\n"), ("r", None, "python", "z")], "repo_id string, path string, language string, content string")
    got = rows(xt.results(xt.extract(df)), "file_path", "success")
    assert got == [("a.py", False), ("b.py", True), ("big.py", True), ("n.py", True), ("x.py", True)]
    xt.EXTRACTORS["broken"] = lambda *a: 1 / 0
    assert xt.extract_file("x", "p", "r", "broken").success is False
    del xt.EXTRACTORS["broken"]


def test_patterns(spark):
    text = "import a\r\nx = 1\nexport class K {\n  // import a\n}\nfunction f(p: int,\n  q=2) {}\nlet g = async (\n) => 1; const h = (z) => 2\nimport\n  b\n\x01 def é(ñ):\n"
    df = spark.createDataFrame([("r", "d/t.x", None, text), ("r", "e.x", "lua", ""), ("r", "n.x", None, None), (None, "noext", None, "class A")], "repo_id string, path string, language string, content string")
    out = generic.by_patterns(df.withColumn("nodes", F.lit("clash")).drop("nodes"))
    assert rows(out.where("tag = 'file'"), "file_path", "language", "success") == [("d/t.x", "x", True), ("e.x", "x", True), ("n.x", "unknown", False), ("noext", "unknown", True)]
    n = out.where("tag = 'node' and file_path = 'd/t.x'").select("ord", "node.*")
    assert [tuple(r) for r in n.orderBy("ord").select("kind", "name", "start_line", "start_col", "parameters").collect()] == [
        ("module", "d/t.x", 1, 0, []), ("import", "import a", 1, 0, []), ("import", "import\n  b", 1, 0, []), ("class", "K", 3, 0, []), ("function", "é", 12, 0, ["ñ"]),
        ("function", "f", 5, 1, ["p", "q"]), ("function", "g", 8, 0, []), ("function", "h", 9, 8, ["z"]),
    ]
    module = n.where("kind = 'module'").first()
    assert module.end_line == 12 and len(module.children) == 7 and module.imports == ["import a", "import\n  b"]
    assert rows(out.where("node.kind = 'module' and file_path = 'e.x'"), "node.end_line", "node.children") == [(0, [])]
    assert out.limit(0).count() == 0 and generic.by_patterns(df.limit(0)).count() == 0
    assert xt.languages() == ["go", "javascript", "python", "typescript"] and xt.extractor("Python") is not None and xt.extractor("cobol") is None and xt.extractor(None) is None


def test_cli(spark, tmp_path, capsys, monkeypatch):
    import pytest

    with pytest.raises(SystemExit):
        cli.main(["graph", "--help"])
    assert "Generate an HTML visualization" in capsys.readouterr().out
    monkeypatch.setattr(cli, "_session", lambda: spark)
    root = tree(tmp_path / "repo")
    assert cli.main([str(tmp_path / "none"), "--store", f"file://{tmp_path}/s"]) == 1
    assert cli.main([str(root), "--store", f"file://{tmp_path}/s0"]) == 0
    assert cli.main(["graph", str(root), "--store", f"file://{tmp_path}/s", "-z", "-o", str(tmp_path / "g.html")]) == 0
    out = capsys.readouterr().out
    assert "Unreachable functions" in out and (tmp_path / "g.html").exists()
    assert cli.main(["parse", str(root), "--store", f"file://{tmp_path}/s"]) == 0
    assert "nothing to parse" in capsys.readouterr().out
    assert cli.main(["visualize", "repo", "--skip-ingest", "--store", f"file://{tmp_path}/s", "-o", str(tmp_path / "v.html")]) == 0
    assert (tmp_path / "v.html").exists() and cli.main(["visualize", "unknown", "--skip-ingest", "--store", f"file://{tmp_path}/s"]) == 1
    (root / "src/main.py").unlink()
    assert cli.main(["parse", str(root), "-f", "--store", f"file://{tmp_path}/s"]) == 0
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("nodes", "repo").where("file_path = 'src/main.py'").count() == 0 and store.read("files", "repo").where("path = 'src/main.py'").count() == 0


def test_appending_and_deleting_write_only_what_they_are_about(spark, tmp_path):
    from codeweft.sources import store as module

    store = Store(spark, f"file://{tmp_path}/s")
    edge = lambda k, file: spark.createDataFrame([("r", k, f"c{k}", "f", None, file, k, 0, False)], "repo_id string, ord long, caller_id string, callee_name string, callee_id string, file_path string, line_number int, col_number int, is_method_call boolean")
    part = tmp_path / "s/call_edges/r"
    for k in range(4):
        store.append("call_edges", "r", edge(k, f"{k % 2}.py"))
    assert sorted(p.name for p in part.iterdir() if p.name[0] == "v") == [f"v{k:09d}" for k in range(1, 5)]
    assert [spark.read.parquet(f"file://{part}/v{k:09d}").count() for k in range(1, 5)] == [1, 1, 1, 1]
    store.delete_files("r", spark.createDataFrame([("1.py",)], "file_path string"))
    store.append("call_edges", "r", edge(9, "1.py"))
    assert rows(store.read("call_edges", "r"), "line_number") == rows(store.read("call_edges"), "line_number") == [(0,), (2,), (9,)]
    store.prune("call_edges", "r", 1)
    for k in range(20, 20 + module.MOST_STEPS):
        store.append("call_edges", "r", edge(k, "k.py"))
    assert store.read("call_edges").count() == 3 + module.MOST_STEPS and len(store._steps("call_edges", "r")) < module.MOST_STEPS
    store.prune("call_edges", "r", 1)
    assert store.read("call_edges").count() == 3 + module.MOST_STEPS
    store.drop("r", "call_edges")
    assert store.read("call_edges").count() == 0
