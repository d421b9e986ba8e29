from datetime import datetime

from pyspark.sql import functions as F

from codeweft.functions import lexical as L
from codeweft.operators import manifest as M

from .conftest import rows

FILE = "repo_id string, path string, language string, sha256 string, size_bytes long, line_count int, old_sha string, v string"
T = datetime(2025, 1, 1)


def files(spark, data):
    return spark.createDataFrame([("r", p, "python", h, 9, n, "x", "y") for p, h, n in data], FILE)


def test_change_set(spark):
    cur = files(spark, [("a", "abc", 1), ("b", "def", 1)])
    assert rows(M.change_set(cur, files(spark, [])), "path") == [("a",), ("b",)]
    assert rows(M.change_set(files(spark, [("a", "new", 1)]), files(spark, [("a", "old", 1)])), "path") == [("a",)]
    assert M.change_set(files(spark, [("a", "same", 1)]), files(spark, [("a", "same", 1)])).count() == 0


def test_status_and_upsert(spark):
    stored = files(spark, [("same", "1", 7), ("mod", "1", 2), ("gone", "1", 3), ("kept", "5", 5)])
    cur = files(spark, [("same", "1", 0), ("mod", "2", 4), ("new", "9", 1), ("kept", "5", 5)])
    s = M.file_status(cur, stored)
    assert rows(s, "path", "status", "language") == [("gone", "deleted", "unknown"), ("kept", "unchanged", "python"), ("mod", "modified", "python"), ("new", "new", "python"), ("same", "unchanged", "python")]
    assert rows(M.upsert_snapshot(stored, s), "path", "sha256", "line_count") == [("kept", "5", 5), ("mod", "2", 4), ("new", "9", 1), ("same", "1", 7)]
    assert [tuple(r) for r in M.language_breakdown(s).select("language", "files").collect()] == [("python", 4)]
    assert rows(M.summary(s), "files", "new_files", "modified_files", "unchanged_files", "deleted_files") == [(4, 1, 1, 2, 1)]
    text = M.summary_text(s, spark.createDataFrame([("r", "src", "local_path", None)], "repo_id string, source string, source_type string, git_commit string")).first().report
    assert "Commit    : N/A" in text and "Languages : {'python': 4}" in text


def test_meta_upsert_keeps_source(spark):
    schema = "repo_id string, source string, source_type string, git_branch string, git_commit string, last_indexed_at timestamp_ntz"
    old = spark.createDataFrame([("a", "s1", "git_url", "m", "c1", T), ("b", "s", "local_path", None, None, T)], schema)
    new = spark.createDataFrame([("a", "s2", "local_path", None, "c2", T), ("n", "s3", "git_url", "d", None, T)], schema)
    assert rows(M.upsert_meta(old, new), "repo_id", "source", "git_branch", "git_commit") == [("a", "s1", None, "c2"), ("b", "s", None, None), ("n", "s3", "d", None)]


def test_latest_ties_and_nulls(spark):
    schema = "repo_id string, path string, sha256 string, indexed_at timestamp_ntz, v string"
    df = spark.createDataFrame([("r", "a", "1", T, "x"), ("r", "a", "2", T, "x"), ("r", "a", None, None, "x"), ("r", "b", None, T, None)], schema)
    assert rows(M.latest(df), "path", "sha256") == [("a", "2"), ("b", None)]
    assert M.latest(df.limit(0)).count() == 0


def test_languages(spark):
    cases = {
        ("script.py", "x = 1"): "python", ("app.ts", ""): "typescript", ("myscript", "#!/usr/bin/env python3\nx"): "python", ("deploy", "#!/bin/bash\n"): "shell", ("data.xyz123", "some data"): None,
        ("d/Dockerfile", "FROM x"): "dockerfile", ("run", "#!/usr/bin/python -u\n"): None, (".bashrc", ""): "shell", ("a.tar.gz", ""): None, ("A.PY", ""): "python", ("x", "#!"): None, ("x", None): None, ("x", "#!/usr/bin/node\0"): None,
        ("a.JS", ""): "javascript", ("dot.", ""): None, ("y", "#! /usr/bin/env zsh\n"): "shell", ("z", "#!/usr/bin/perl5\n"): "perl",
    }
    df = spark.createDataFrame([(p, h) for p, h in cases], "path string, head string").withColumn("got", L.detect_language(F.col("path"), F.col("head")))
    assert {(r.path, r["head"]): r.got for r in df.collect()} == cases


def test_listing_rules(spark):
    cases = {"src/a.py": True, "a.md": False, "node_modules/x.js": False, "x/build/y.js": False, ".git/a.py": False, "s/.h/a.py": False, "Makefile": True, "builds/a.py": True, "build.py": True, ".x.py": True}
    df = spark.createDataFrame([(p, 1) for p in cases], "path string, size long").withColumn("ok", L.is_listed(F.col("path"), F.col("size")))
    assert {r.path: r.ok for r in df.collect()} == cases
    big = spark.createDataFrame([("a.py", 2 * 1024 * 1024), ("a.py", 2 * 1024 * 1024 + 1), ("a.py", None)], "path string, size long").select(L.is_listed(F.col("path"), F.col("size")).alias("k"))
    assert [r.k for r in big.collect()] == [True, False, True]


def test_names_and_targets(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first().y
    assert one(L.url_slug, "git@github.com:me/repo.git") == "github.com-me-repo"
    assert one(L.url_slug, "https://h/a//b@c") == "h-a-b-c"
    assert one(L.sanitise_slug, "a b/c-ü") == "a_b_c-ü"
    assert one(L.python_import_target, "from ..a.b import c") == "a" and one(L.python_import_target, "from . import x") is None and one(L.python_import_target, "import os, sys") == "os,"
    assert one(L.es_import_target, "import x from './a/b.js'") == "./a/b" and one(L.es_import_target, "import y from '@Org/p'") == "@org" and one(L.es_import_target, "import 'x'") is None
    assert one(L.go_import_target, 'import "net/http"') == "http"
    assert one(L.stem, "..\\a/b.c.d") == "b" and one(L.stem, "../..") == "" and one(L.leaf, "a.b.c") == "c"
    assert one(L.count_lines, "a") == 0 and one(L.count_lines, "a\nb\n") == 2 and one(L.count_lines, None) is None
    assert one(L.is_binary, "a\0b") is True and one(L.is_binary, None) is True and one(L.is_binary, "x") is False
    assert one(L.begins_upper, "Éa") is True and one(L.begins_upper, "1a") is False
