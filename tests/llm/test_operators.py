import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeweft.llm import docs, encoding, mixing, provenance, syntax, truncation

from ..conftest import rows

T = datetime(2025, 1, 1)
SOURCE = "repo_id string, path string, content string, language string, errors string, why string"


def sources(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], SOURCE)


# --- 1: files that do not parse


def test_parse_verdicts(spark):
    s = sources(spark, [("r", "a.py", "x = 1\n"), ("r", "b.py", "x = \n"), ("r", "b.py", "x = \n"), ("r", "c.js", ""), ("r", "d.txt", "((("), ("r", "e.go", None), ("r", None, "x"), (None, "f.py", "("), ("r", "big.py", "x = 1\n" * 200_000), ("r", "two.py", "y"), ("r", "two.py", "y (")])
    p = spark.createDataFrame(
        [("r", "a.py", T, False, "v"), ("r", "./b.py", T, False, "v"), ("r", "b.py", T + timedelta(1), True, "v"), ("r", "b.py", None, None, "v"), ("r", "c.js", T, None, "v"), ("r", "zz.py", T, True, "v"), (None, "f.py", T, True, "v"), ("r", "big.py", T, True, "v"), ("r", "two.py", T, True, "v")],
        "repo_id string, file_path string, parsed_at timestamp_ntz, success boolean, accepted string",
    )
    v = syntax.parse_verdicts(s, p)
    assert rows(v, "file_path", "language", "accepted", "claimed_success") == [("a.py", "python", True, False), ("b.py", "python", False, True), ("big.py", "python", True, True), ("c.js", "javascript", True, None), ("two.py", "python", False, True)]
    assert v.where("file_path = 'b.py'").first().first_cause.startswith("line 1")
    assert rows(syntax.parse_rates(v), "language", "files", "invalid") == [("javascript", 1, 0), ("python", 4, 2)]
    assert syntax.parse_verdicts(s.limit(0), p.limit(0)).count() == 0


# --- 4: files nobody wrote by hand

CODE = "def f(a):\n    return a\n"


@pytest.mark.parametrize(
    ("path", "text", "found"),
    [
        ("a.py", CODE, False), ("a.go", "// Code generated by x v1; DO NOT EDIT.\npackage a\n", True), ("a.py", "# Do not edit the lease order below without asking the owners.\n" + CODE, False),
        ("a.js", "/*\n * @license lib v1.0.2\n */\nf();\n", True), ("a.py", "# Copyright (c) Us. Internal use.\n" + CODE, False), ("x/vendor/lib/a.py", CODE, True), ("x/vendors/a.py", CODE, False), ("x/builders/a.py", CODE, False),
        ("generated_a.py", CODE, False), ("a_pb2.py", CODE, True), ("a.min.js", "var a=1;", True), ("x/autogen/a.py", CODE, True), ("third_party_a.py", CODE, False), ("a.js", "f(a);" * 400, True), ("a.js", "", False), ("a.js", None, False),
        ("a.py", "X = [\n" + "    1, 2, 3, 4, 5, 6,\n" * 90 + "]\n", True), ("a.py", "W = {\n" + '    "a": 1,\n' * 14 + "}\n" + CODE * 30, False), ("a.py", "# this file is generated by hand, edit as you like\n" + CODE, False), ("a.py", CODE + "# Code generated by x; DO NOT EDIT.\n", False),
        ("a.py", "# Helpers that pack the node before any graph is generated.\n" + CODE, False), ("a.java", "// Autogenerated from x.idl - changes will be overwritten\nclass A {}\n", True), ("a.py", "# Vendored copy of lib, release 1.2.\n" + CODE, True), ("a.py", "# Vendor prices, not third party code.\n" + CODE, False),
    ],
)
def test_evidence(path, text, found):
    assert (text is not None and provenance.evidence(path, text) is not None) == found


FILES = "repo_id string, path string, sha256 string, size_bytes long, indexed_at timestamp_ntz, h1 string, n int"


def files(spark, data):
    return spark.createDataFrame([(*r, "a", 1) for r in data], FILES)


def test_merkle_marks_shared_trees(spark):
    f = [("a", "x/lib1/u.py", "1", 10, T), ("a", "x/lib1/s/v.py", "2", 10, T), ("b", "deep/down/copy/u.py", "1", 10, T), ("b", "deep/down/copy/s/v.py", "2", 10, T), ("a", "own.py", "3", 900, T), ("b", "tiny.py", "9", 5, T), ("a", "t.py", "9", 5, T),
         ("c", "one.py", "7", 500, T), ("d", "else/two.py", "sha256:7 ", 500, T), ("d", "else/old.py", "3", 900, T - timedelta(1)), ("d", "else/old.py", "4", 900, T), ("a", None, "1", 1, T), ("a", "q.py", None, 1, T)]
    got = rows(provenance.shared_files(files(spark, f)), "repo_id", "path")
    assert got == [("a", "x/lib1/s/v.py"), ("a", "x/lib1/u.py"), ("b", "deep/down/copy/s/v.py"), ("b", "deep/down/copy/u.py"), ("c", "one.py"), ("d", "else/two.py")]
    # A locally changed file in a directory that is otherwise a copy.
    part = [("a", f"v/{k}.py", str(k), 900, T) for k in range(3)] + [("b", f"w/{k}.py", str(k), 900, T) for k in range(2)] + [("b", "w/2.py", "changed", 900, T)]
    assert ("b", "w/2.py") in rows(provenance.shared_files(files(spark, part)), "repo_id", "path")
    s = sources(spark, [("b", "w/./2.py", CODE), ("b", "w/2.py", CODE), ("z", "w/2.py", CODE), ("b", None, CODE), ("b", "n.py", None)])
    assert rows(provenance.not_handwritten(files(spark, part), s), "repo_id", "path", "why") == [("b", "w/2.py", "shared between repositories")]
    assert provenance.not_handwritten(files(spark, []), sources(spark, [])).count() == 0


def test_related_repositories_are_no_evidence(spark):
    meta = spark.createDataFrame(
        [("a", "x.git", "1"), ("a", "x.git", None), ("b", "y.git", " 1 "), ("c", "y.git", "3"), ("d", "z.git", "4"), ("e", None, ""), ("f", None, ""), (None, "x.git", "1")], "repo_id string, source string, git_commit string"
    )
    assert rows(provenance.repo_families(meta)) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert provenance.repo_families(meta.limit(0)).count() == 0
    f = files(spark, [(r, "lib/u.py", "1", 900, T) for r in "ac"] + [(r, "own/v.py", "2", 900, T) for r in "cd"])
    assert rows(provenance.shared_files(f, None, meta), "repo_id", "path") == [("c", "own/v.py"), ("d", "own/v.py")]


@pytest.mark.parametrize(("path", "found"), [("a/bucket_pack.py", False), ("a/bucket.pack.js", True), ("a/bucket-min.js", True), ("a/bucket_min.js", True), ("a/unpack.py", False)])
def test_ordinary_words_in_names(path, found):
    assert (provenance.evidence(path, CODE) is not None) == found


# --- 7: functions with their documentation


@pytest.mark.parametrize(
    ("doc", "telling"),
    [
        (None, False), ("", False), ("  \n", False), ("Load config.", False), ("The load_config method.", False), ("load config load config", False), ("TODO: document", False), ("n/a", False), ("-----", False), ("noqa", False), (":param path:\n:return:", False), ("Args:\n    path:\nReturns:", False),
        ("return path", False), ("x = load(path);", False), ("eslint-disable-next-line no-shadow", False), ("Never null.", True), ("TODO: make this faster. Reads the cache first.", True), (":param path: where the journal lives", True), ("Args:\n    path: must exist", True), ("/** Blocks until closed. */", True),
        ("Parameters\n----------\npath : str\n\nReturns\n-------\nNone", False), ("@param {string} path\n@returns {void}", False), ("Inverse of dump.", True), ("Entscheidet, ob geladen wird.", True), ("load_config:\n    Keeps old entries.", True), ("読み込みは一度だけ。", True), ("def load_config(path: str) -> dict", False), ("{@inheritDoc}", False),
    ],
)
def test_telling(doc, telling):
    assert docs.is_telling(doc, "load_config", "def load_config(path: str) -> dict:", ["path"]) == telling


def test_assignment_is_optimal():
    from itertools import permutations

    rnd = random.Random(1)
    for _ in range(60):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        w = [[rnd.choice([0, 0, 1, 2, 3.5, 5]) for _ in range(m)] for _ in range(n)]
        got = docs.assign(w)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) and all(w[i][j] > 0 for i, j in enumerate(got) if j >= 0)
        slots = list(range(m)) + [-1] * n
        best = max(sum(w[i][j] for i, j in enumerate(p) if j >= 0) for p in set(permutations(slots, n)))
        assert sum(w[i][j] for i, j in enumerate(got) if j >= 0) == best


NODE = "id string, name string, kind string, signature string, docstring string, parameters array<string>, repo_id string, file_path string, start_line int, ord long, deleted_at timestamp_ntz, telling string, gap int"


def test_function_docs(spark):
    py = 'def a():\n    """Reads it twice."""\n\n\n# Far away.\n\ndef b():\n    pass\n\n# noqa\ndef c():\n    pass\n\n@deco(1)\ndef d(\n    x,\n):\n    """Drops x when full."""\n\nclass K:\n    # Not safe across threads.\n    @property\n    def e(self): pass\n'
    js = "/**\n * Keeps at most 4.\n */\nexport function f(a) {}\r\n// May be retried.\nconst g = () => {};\n/* Never null. */\n\nfunction h() {}\n// ok\ng(1);\nclass Q { \n  // Closes it too.\n  m() {}\n}\n"
    s = sources(spark, [("r", "a.py", py), ("r", "a.py", py), ("r", "./a.js", js), ("r", "n.py", None), ("r", "e.py", "")])
    n = lambda i, name, line, file="a.py", doc=None, kind="function", ord_=1, gone=None: (i, name, kind, f"def {name}", doc, ["x"], "r", file, line, ord_, gone, "t", 1)
    data = [
        n("a", "a", 1), n("b", "b", 7), n("c", "c", 11), n("d", "d", 15), n("e", "e", 23, kind="method"), n("f", "f", 4, "a.js"), n("g", "g", 6, "a.js"), n("h", "h", 9, "a.js"), n("m", "m", 14, "a.js", kind="method"),
        n("own", "own", 1, doc="Explains much."), n("own", "own", 1, doc="Explains much."), n("empty", "empty", 1, doc=""), n("cls", "K", 20, kind="class", doc="Holds much."), n("dead", "dead", 1, doc="Tells much.", gone=T), n("later", "later", 1, doc="Old words here."), n("later", "later", 1, doc="-", ord_=2),
        n("nofile", "z", None, None), n("elsewhere", "z", 99), (None, *n("x", "x", 1)[1:]), n("off", "a", 3),
    ]
    out = docs.function_docs(spark.createDataFrame(data, NODE), s)
    assert [r[0] for r in rows(out.where("telling"), "node_id")] == ["a", "d", "e", "f", "g", "m", "own"]
    assert rows(out.where("node_id = 'd'"), "documentation") == [("Drops x when full.",)]
    assert docs.function_docs(spark.createDataFrame([], NODE), sources(spark, [])).count() == 0


# --- 8: tokenizer

needs_vocabulary = pytest.mark.skipif(not encoding.available(None), reason="no vocabulary files here")


@needs_vocabulary
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rnd = random.Random(3)
    texts = ["", " ", "Hello world", "don't we'll", "<|endoftext|>", "a" * 3000, "ab" * 700, "=-" * 300, "é漢字🏽‍", "\n\n  \t x", "x" * 50 + "\u00a0" + "1" * 400, "aaaab" * 90, "\u0000\u0001"]
    texts += ["".join(rnd.choice("abcde rnst ABé漢\n\t'.,0123🏽") for _ in range(rnd.randrange(200))) for _ in range(400)]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate([*texts, None])], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encoding.encode_column(df).collect()}
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] + [[]]
    assert got == dict(enumerate(want))
    assert encoding.encode_column(df.limit(0)).count() == 0
    assert sorted(r.tokens for r in encoding.token_counts(df.where("doc_id < 3")).collect()) == [0, 1, 2]


# --- 9: mixing

DOCS = "doc_id long, text string, source string, tokens string, copy string, share string"


@needs_vocabulary
def test_mix(spark):
    rnd = random.Random(5)
    data = [(i, " a" * rnd.randrange(1, 30), "big" if i % 3 else "small", "x", "y", "z") for i in range(600)]
    data += [(9000, None, "big", "", "", ""), (9001, "", "big", "", "", ""), (9002, "a", None, "", "", ""), (9003, "a", "other", "", "", ""), data[0]]
    d = spark.createDataFrame(data, DOCS)
    goals = spark.createDataFrame([("big", 0.4, 2), ("small", 0.6, 4), ("none", 0.2, 1), (None, 0.1, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(d, goals).cache()
    shares = {r.source: r for r in mixing.mix_shares(out, goals).collect()}
    assert abs(shares["big"].share - 0.4) < 0.01 and abs(shares["small"].share - 0.6) < 0.01 and shares["none"].tokens == 0
    assert shares["small"].most_used > 1 and all(shares[s].most_used <= shares[s].max_repeats for s in ("big", "small"))
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    positions = [r.position for r in out.collect()]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    early = {r.source: r.t for r in out.where("position < 0.1").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    late = {r.source: r.t for r in out.where("position > 0.9").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert early["small"] / early["big"] != pytest.approx(late["small"] / late["big"], rel=0.1)
    small = mixing.mix(d, goals, total=300)
    assert 280 <= small.agg(F.sum("tokens")).first()[0] <= 400
    assert mixing.mix(d.limit(0), goals).count() == 0 and mixing.mix(d, goals.limit(0)).count() == 0


def test_schedule_of_the_caller(spark):
    sized = spark.createDataFrame([(k, s, 10) for k, s in enumerate("aaaabbbbcccc")], "doc_id long, source string, tokens long")
    goals = spark.createDataFrame([("a", 0.5, 3), ("b", 0.25, 3), ("c", 0.25, 3)], "source string, target_share double, max_repeats int")
    slope = lambda **s: {r.source: r.slope for r in mixing.source_plan(sized, goals, slopes=s).collect()}
    assert slope() == {"a": 0.0, "b": 0.0, "c": 0.0}
    assert slope(b=0.4, c=-0.4) == pytest.approx({"a": 0.0, "b": 0.4, "c": -0.4})
    steep = slope(a=2.0)
    assert max(map(abs, steep.values())) == pytest.approx(1.0) and sum(steep[r.source] * r.target_share for r in goals.collect()) == pytest.approx(0.0)


# --- 10: truncated texts

SENTENCES = ["The cache holds one node per graph.", "We should collect every batch before the file is written.", "Nobody knows why it returns a stale edge here.", "Each worker waits for the lock of its own ledger.", "Run the scan again to see the open rows."]


def test_truncation(spark):
    rnd = random.Random(2)
    whole = [" ".join(rnd.choice(SENTENCES) for _ in range(rnd.randrange(2, 30))) for _ in range(500)]
    data = [(i, t, "a", len(t), "v") for i, t in enumerate(whole)]
    long = [" ".join(rnd.choice(SENTENCES) for _ in range(30)) for _ in range(60)]
    cut = {1000 + i: t[:400] for i, t in enumerate(long) if not t[:400].rstrip().endswith(".")}
    data += [(k, t, "a", None, "v") for k, t in cut.items()]
    data += [
        (2000, "Each worker waits for the lo", "b", None, "v"), (2001, "The cache holds one node per graph", "b", None, "v"), (2002, "Run the scan again to [truncated]", "b", None, "v"), (2003, "Run the scan ag�", "b", 99, "v"), (2004, None, "b", 5, "v"), (2005, "", "b", 5, "v"),
        (2006, "The cache holds one node per graph. And more...", "b", None, "v"), (2007, "Nobody knows why it ret...", "b", None, "v"), (2008, "See:\n\n```\nx = 1\n", "b", None, "v"), (2009, "Done.\n\n-- the bot", "b", None, "v"), (2010, "🚀", "b", 1, "v"), (2011, "Nobody knows (see docs/le", "b", None, "v"), (2012, ("x " * 40_000) + "end.", None, None, "v"),
    ]
    # An unusual end is known to be one by its repetition only.
    data += [(3000 + i, f"{rnd.choice(SENTENCES)} And more...", "a", None, "v") for i in range(8)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, kind string")
    ev = truncation.truncation_evidence(d).cache()
    found = {r.doc_id for r in ev.where("truncated").collect()}
    assert found & set(range(500)) == set()
    assert set(cut) <= found
    assert found - set(cut) == {2000, 2002, 2003, 2007, 2008, 2011}
    limits = truncation.length_limits(spark.createDataFrame([("a", n, n, n) for n in [*range(100, 900), *[400] * 40]], "source string, chars long, bytes long, units long"))
    assert {r.length for r in limits.collect()} == {400}
    assert rows(truncation.truncation_rates(ev).where("source = 'b'"), "truncated") == [(6,)]
    assert truncation.truncation_evidence(d.limit(0)).count() == 0


def test_beginnings_against_brute_force(spark):
    rnd = random.Random(5)
    words = lambda n: {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7))) for _ in range(n)}
    asked, known = words(300) | {"a" * 9_999}, words(60) | {"a" * 10_000, "b"}
    frame = lambda ws, name: spark.createDataFrame([(w,) for w in ws], f"{name} string").repartition(5)
    got = [r.word for r in truncation.beginnings(frame(asked, "word"), frame(known, "key")).collect()]
    assert len(got) == len(set(got)) and set(got) == {a for a in asked if any(k != a and k.startswith(a) for k in known)}
    none = frame(set(), "word")
    assert truncation.beginnings(none, frame(known, "key")).count() == 0 and truncation.beginnings(frame(asked, "word"), none.withColumnRenamed("word", "key")).count() == 0


def test_usual_lengths_are_no_limits(spark):
    """A length twice as frequent as its neighbours is significant in a large corpus and still no limit."""
    lengths = [(n, 100 if n != 60 else 180) for n in range(30, 120)] + [(200, 900)]
    df = spark.createDataFrame([("s", n, n, n) for n, k in lengths for _ in range(k)], "source string, chars long, bytes long, units long")
    assert {r.length for r in truncation.length_limits(df).collect()} == {200}


def test_queries_run(spark, smallest):
    from codeweft.llm import queries

    for name, f in queries.QUERIES.items():
        df = f(spark, smallest)
        assert df.count() >= 0 and len(df.columns) == len(set(df.columns)), name


def test_sparse_matching_equals_the_dense_one_and_is_quick():
    rnd = random.Random(9)
    for _ in range(40):
        n, m = rnd.randrange(1, 30), rnd.randrange(1, 30)
        links = [{j: rnd.random() for j in range(m) if rnd.random() < 0.15} for _ in range(n)]
        got = docs.match(links)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used))
        import numpy as np

        # Brute force by dynamic programming over the columns used, feasible for few rows only.
        if n <= 8:
            best = {frozenset(): 0.0}
            for r in links:
                nxt = dict(best)
                for s, w in best.items():
                    for j, x in r.items():
                        if j not in s:
                            key = s | {j}
                            nxt[key] = max(nxt.get(key, 0.0), w + x)
                best = nxt
            assert np.isclose(sum(links[i][j] for i, j in enumerate(got) if j >= 0), max(best.values()))
    chain = [{k: 1.0 + rnd.random(), k + 1: 1.0 + rnd.random()} for k in range(5_000)]
    assert sum(j >= 0 for j in docs.match(chain)) > 4_500


def test_comments_close_together_go_to_the_function_they_fit():
    f = lambda name, line, params=(), own=False: {"name": name, "line": line, "signature": name, "params": list(params), "own": own}
    js = "// Opens it.\nconst a = (x) => 1;\n// Closes it.\nconst b = (y) => 2;\n\n// Far from c.\n\nconst c = () => 3;\n// @param {string} z what to keep\nconst d = (z) => 4;\n"
    comments = [dict(zip(("line", "gap", "name", "text"), c)) for c in docs.candidates(js, False)]
    assert [(c["line"], c["gap"], c["name"]) for c in comments] == [(2, 0, "a"), (4, 0, "b"), (8, 1, "c"), (10, 0, "d")]
    functions = [f("a", 2, "x"), f("b", 4, "y"), f("c", 8), f("d", 10, "z")]
    assert any(len(p) > 1 for p in docs.parts_of(functions, comments))
    assert [(a["name"], b["name"]) for a, b in docs.match_file(functions, comments)] == [("a", "a"), ("b", "b"), ("d", "d")]
    # Lines that moved: overloads take the comments in the order that fits all of them; one with a docstring only competes.
    over = [f("m", 1, ["p"]), f("m", 3, ["q"], own=True)]
    two = [{"line": 2, "gap": 0, "name": "m", "text": "@param p the first"}, {"line": 3, "gap": 0, "name": "m", "text": "@param q the second"}]
    assert [(a["line"], b["line"]) for a, b in docs.match_file(over, two)] == [(1, 2)]


@pytest.mark.parametrize("doc", ["Function load_config with the parameters path.", "load_config - load config\n\nFIXME describe parameters and result", "loadConfig - load config\n\nFIXME describe parameters and result"])
def test_what_only_repeats_the_signature_is_not_telling(doc):
    name = doc.split()[1] if doc.startswith("Function") else doc.split()[0]
    assert not docs.is_telling(doc, name, f"def {name}(path)", ["path"])
    assert docs.is_telling(doc + "\n\nReads the cache first.", name, f"def {name}(path)", ["path"])
