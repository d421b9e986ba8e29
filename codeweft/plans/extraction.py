"""Queries of the extractors: small sources whose rows are known by hand, and every source file of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.extract import generic
from codeweft.extract import table as xt
from codeweft.functions import lexical as L
from codeweft.operators import graph, manifest, reports, resolve
from codeweft.plans import codegraph
from codeweft.session import stage, table
from codeweft.sources import store

PYTHON = {
    "limit.py": "ceiling = 40\n",
    "weigh.py": "def weigh(parcel, *labels, unit: str = 'kg') -> float:\n    scale = Balance(unit)\n    return scale.measure(parcel) + OFFSET\n",
    "crane.py": 'class Crane(Machine, metaclass=Registry):\n    """Lifts what a forklift leaves."""\n\n    def lift(self, load: Load) -> bool:\n        return self.motor.pull(load)\n',
    "needs.py": "import shutil\nfrom .depot import shelf as place\n",
    "calls.py": "def tidy():\n    os.path.split('a')\n    print('swept')\n    yard.gate.close(1)\n",
    "marks.py": "@cached\n@route('/yard', methods=ALL)\nasync def yard_state():\n    return None\n",
    "hidden.py": "def _rehang(door):\n    return door\n",
    "layers.py": "class Yard:\n    class Gate:\n        def swing(self):\n            return lambda angle: angle\n",
    "kinds.py": "class Colour(enum.Enum):\n    AMBER = 1\nclass Movable(Protocol):\n    def __init__(self): ...\n",
    "torn.py": "import depot\ndef intact(a):\n    return a\ndef torn(:\n",
}
JAVASCRIPT = {
    "weigh.js": "function weigh(parcel) { return parcel; }\n",
    "join.js": "const join = (left, right) => glue(left, right);\n",
    "crane.js": "class Crane extends Machine { lift(load) { return this.motor.pull(load); } constructor() { wire(this); } }\n",
    "needs.js": "import Yard from 'yard-kit';\nconst zlib = require('zlib');\n",
    "given.js": "export function opened() { return 'open'; }\nexport const closed = () => {};\n",
    "plain.js": "const ceiling = 40;\n",
    "card.jsx": "export const Card = memo(forwardRef((props) => draw(props)));\nboot(1);\n",
    "shape.ts": "export interface Plot<T> extends Ground { area(): number; }\nenum Tint { Amber }\ntype Key = string | number;\nfunction rate(a: Map<string, number>, ...r: string[]): Key { return calc(a); }\n",
}
GO = {
    "yard.go": """package main
import "net/http"
type Depot struct { n int }
type Mover interface { Move(p string) error }
func NewDepot() *Depot { return &Depot{} }
func (s *Depot) Find(k string) string { return seek(k) }
func seek(k string) string { return k }
""",
    "vars.go": 'package v\n\nimport (\n\tf "fmt"\n\t. "os"\n)\n\nvar Limit = 10\ntype Keys []string\nfunc total(a, b int, rest ...int) (int, error) {\n\tf.Println(a)\n\tc.put(b)\n\treturn 0, nil\n}\n',
}
GENERIC = {
    "one.rb": "ceiling = 40\n",
    "odd.rb": "}{ ~~ in no language ~~ }{",
    "Main.java": "import java.util.List;\n\npublic class Main {\n}\nabstract class Ground {\n}\n",
    "mix.lua": "class Depot extends Ground {}\nfunction weigh(parcel, unit=2) { return parcel; } function weigh(again) {}\n  def seek(\n    key: str,\n  ):\nconst late = async (p) => 1\nfrom yard import gate\n",
}
PYTHON_ROWS = [
    ('limit.py', 'module', 'limit.py', 1, 2, '', '', '', '', '', '', True),
    ('limit.py', 'assignment', 'ceiling', 1, 1, '', '', '', '40', '', 'ceiling = 40', True),
    ('weigh.py', 'module', 'weigh.py', 1, 4, '', '', '', '', '', '', True),
    ('weigh.py', 'function', 'weigh', 1, 3, 'parcel labels unit:str', 'Balance scale.measure', '', 'float', '', "def weigh(parcel, *labels, unit: str = 'kg') -> float:", True),
    ('weigh.py', 'assignment', 'scale', 2, 2, '', '', '', 'Balance(unit)', '', 'scale = Balance(unit)', True),
    ('crane.py', 'module', 'crane.py', 1, 6, '', '', '', '', '', '', True),
    ('crane.py', 'class', 'Crane', 1, 5, '', '', 'Machine', 'Lifts what a forklift leaves.', '', 'class Crane(Machine, metaclass=Registry):', True),
    ('crane.py', 'method', 'lift', 4, 5, 'load:Load', 'self.motor.pull', '', 'bool', '', 'def lift(self, load: Load) -> bool:', True),
    ('needs.py', 'import', 'import shutil', 1, 1, '', '', '', '', '', '', True),
    ('needs.py', 'import', 'from .depot import shelf as place', 2, 2, '', '', '', '', '', '', True),
    ('needs.py', 'module', 'needs.py', 1, 3, '', '', '', '', '', '', True),
    ('calls.py', 'module', 'calls.py', 1, 5, '', '', '', '', '', '', True),
    ('calls.py', 'function', 'tidy', 1, 4, '', '', '', '', '', 'def tidy():', True),
    ('marks.py', 'module', 'marks.py', 1, 5, '', '', '', '', '', '', True),
    ('marks.py', 'function', 'yard_state', 3, 4, '', '', "@cached @route('/yard', methods=ALL)", '', '', 'async def yard_state():', True),
    ('hidden.py', 'module', 'hidden.py', 1, 3, '', '', '', '', '', '', True),
    ('hidden.py', 'function', '_rehang', 1, 2, 'door', '', '', '', 'door', 'def _rehang(door):', False),
    ('layers.py', 'module', 'layers.py', 1, 5, '', '', '', '', '', '', True),
    ('layers.py', 'class', 'Yard', 1, 4, '', '', '', '', '', 'class Yard:', True),
    ('layers.py', 'class', 'Gate', 2, 4, '', '', '', '', '', 'class Gate:', True),
    ('layers.py', 'method', 'swing', 3, 4, '', '', '', '', '', 'def swing(self):', True),
    ('layers.py', 'lambda', '<lambda>', 4, 4, 'angle', '', '', '', '', 'lambda angle: angle', True),
    ('kinds.py', 'module', 'kinds.py', 1, 5, '', '', '', '', '', '', True),
    ('kinds.py', 'enum', 'Colour', 1, 2, '', '', 'enum.Enum', '', '', 'class Colour(enum.Enum):', True),
    ('kinds.py', 'assignment', 'AMBER', 2, 2, '', '', '', '1', '', 'AMBER = 1', True),
    ('kinds.py', 'interface', 'Movable', 3, 4, '', '', 'Protocol', '', '', 'class Movable(Protocol):', True),
    ('kinds.py', 'constructor', '__init__', 4, 4, '', '', '', '', '', 'def __init__(self): ...', False),
    ('torn.py', 'module', 'torn.py', 1, 4, '', '', '', '', '', '', True),
    ('torn.py', 'import', 'import depot', 1, 1, '', '', '', '', '', '', True),
    ('torn.py', 'function', 'intact', 2, 2, 'a', '', '', '', '', 'def intact(a):', True),
]
JAVASCRIPT_ROWS = [
    ('weigh.js', 'module', 'weigh.js', 1, 2, '', '', '', '', '', '', True),
    ('weigh.js', 'function', 'weigh', 1, 1, 'parcel', '', '', '', 'parcel', 'function weigh(parcel) { return parcel; }', False),
    ('join.js', 'module', 'join.js', 1, 2, '', 'glue', '', '', 'join', '', True),
    ('join.js', 'function', 'join', 1, 1, 'left right', 'glue', '', '', 'left right', '(left, right) => glue(left, right)', False),
    ('crane.js', 'module', 'crane.js', 1, 2, '', 'this.motor.pull wire', '', '', 'load', '', True),
    ('crane.js', 'class', 'Crane', 1, 1, '', '', 'Machine', '', '', 'class Crane extends Machine', False),
    ('crane.js', 'method', 'lift', 1, 1, 'load', 'this.motor.pull', '', '', '', 'lift(load) { return this.motor.pull(load); }', True),
    ('crane.js', 'constructor', 'constructor', 1, 1, '', 'wire', '', '', '', 'constructor() { wire(this); }', True),
    ('needs.js', 'module', 'needs.js', 1, 3, '', '', '', '', 'require zlib', '', True),
    ('needs.js', 'import', "import Yard from 'yard-kit';", 1, 1, '', '', '', '', '', '', True),
    ('needs.js', 'require', 'zlib', 2, 2, '', '', '', '', '', '', True),
    ('given.js', 'module', 'given.js', 1, 3, '', '', '', '', 'closed', '', True),
    ('given.js', 'function', 'opened', 1, 1, '', '', '', '', '', "function opened() { return 'open'; }", True),
    ('given.js', 'function', 'closed', 2, 2, '', '', '', '', '', '() => {}', True),
    ('plain.js', 'module', 'plain.js', 1, 2, '', '', '', '', 'ceiling', '', True),
    ('card.jsx', 'module', 'card.jsx', 1, 3, '', 'memo forwardRef draw boot', '', '', 'Card forwardRef memo', '', True),
    ('card.jsx', 'function', 'Card', 1, 1, 'props', 'draw', '', '', 'props', '(props) => draw(props)', True),
    ('shape.ts', 'module', 'shape.ts', 1, 5, '', 'calc', '', '', '', '', True),
    ('shape.ts', 'interface', 'Plot', 1, 1, '', '', 'Ground', '', '', 'interface Plot<T> extends Ground', True),
    ('shape.ts', 'enum', 'Tint', 2, 2, '', '', '', '', '', 'enum Tint { Amber }', True),
    ('shape.ts', 'type_annotation', 'Key', 3, 3, '', '', '', 'string | number', '', 'type Key = string | number', True),
    ('shape.ts', 'function', 'rate', 4, 4, 'a:Map<string, number> r:string[]', 'calc', '', 'Key', 'calc', 'function rate(a: Map<string, number>, ...r: string[]): Key { return calc(a); }', False),
]
GO_ROWS = [
    ('yard.go', 'module', 'yard.go', 1, 8, '', '', '', '', '', '', True),
    ('yard.go', 'struct', 'Depot', 3, 3, '', '', '', '', '', 'type Depot struct', True),
    ('yard.go', 'method', 'Move', 4, 4, 'p:string', '', '', 'error', '', 'Move(p string) error', True),
    ('yard.go', 'interface', 'Mover', 4, 4, '', '', '', '', '', 'type Mover interface', True),
    ('yard.go', 'constructor', 'NewDepot', 5, 5, '', '', '', '*Depot', '', 'func NewDepot() *Depot', True),
    ('yard.go', 'method', 'Find', 6, 6, 'k:string', 'seek', '', 'string', '', 'func (s *Depot) Find(k string) string', True),
    ('yard.go', 'function', 'seek', 7, 7, 'k:string', '', '', 'string', '', 'func seek(k string) string', False),
    ('vars.go', 'module', 'vars.go', 1, 15, '', '', '', '', '', '', True),
    ('vars.go', 'assignment', 'Limit', 8, 8, '', '', '', '10', '', 'Limit = 10', True),
    ('vars.go', 'type_annotation', 'Keys', 9, 9, '', '', '', '[]string', '', 'type Keys = []string', True),
    ('vars.go', 'function', 'total', 10, 14, 'a:int b:int rest:...int', 'c.put', '', '(int, error)', '', 'func total(a int, b int, rest ...int) (int, error)', False),
]
GENERIC_ROWS = [
    ('one.rb', 'module', 'one.rb', 1, 1, '', '', '', '', '', '', True),
    ('odd.rb', 'module', 'odd.rb', 1, 1, '', '', '', '', '', '', True),
    ('Main.java', 'module', 'Main.java', 1, 6, '', '', '', '', '', '', True),
    ('Main.java', 'import', 'import java.util.List;', 1, 1, '', '', '', '', '', '', True),
    ('Main.java', 'class', 'Ground', 5, 5, '', '', '', '', '', 'abstract class Ground {', True),
    ('mix.lua', 'module', 'mix.lua', 1, 7, '', '', '', '', '', '', True),
    ('mix.lua', 'import', 'from yard', 7, 7, '', '', '', '', '', '', True),
    ('mix.lua', 'class', 'Depot', 1, 1, '', '', '', '', '', 'class Depot extends Ground {}', True),
    ('mix.lua', 'function', 'seek', 3, 3, 'key', '', '', '', '', 'def seek(', True),
    ('mix.lua', 'function', 'weigh', 1, 1, 'parcel unit', '', '', '', '', 'class Depot extends Ground {}', True),
    ('mix.lua', 'function', 'weigh', 2, 2, 'again', '', '', '', '', 'function weigh(parcel, unit=2) { return parcel; } function weigh(again) {}', True),
    ('mix.lua', 'function', 'late', 6, 6, 'p', '', '', '', '', 'const late = async (p) => 1', True),
]
COLUMNS = "file_path, kind, name, start_line, end_line, parameters, calls, bases, value, refs, signature, exported"


def _files(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    rows = [("demo", p, c) for p, c in sources.items()]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string")
    return df.withColumn("language", L.detect_language(F.col("path"), F.col("content")))


def _shown(rows: DataFrame) -> DataFrame:
    """The elements in the columns of the tables above: `parameters` with their types, `bases` and decorators together, and
    as `value` also return types and documentation."""
    n = xt.nodes(rows)
    joined = lambda c: F.array_join(c, " ")
    typed = F.transform("typed_parameters", lambda p: F.concat_ws(":", p["name"], p["type"]))
    return n.select(
        "file_path", "kind", "name", "start_line", "end_line", joined(typed).alias("parameters"), joined("calls").alias("calls"), joined(F.concat("bases", "decorators")).alias("bases"),
        F.concat_ws(" ", "value", "return_type", "docstring").alias("value"), joined("ref_names").alias("refs"), F.coalesce("signature", F.lit("")).alias("signature"), F.col("is_exported").alias("exported"),
    )


def _values(rows: list[tuple]) -> str:
    shown = ", ".join("(" + ", ".join(str(v).upper() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) AS t({COLUMNS})"


def extract_python(spark, d):
    return _shown(xt.extract(_files(spark, PYTHON)))


def extract_javascript(spark, d):
    return _shown(xt.extract(_files(spark, JAVASCRIPT)))


def extract_go(spark, d):
    return _shown(xt.extract(_files(spark, GO)))


def extract_generic(spark, d):
    return _shown(xt.extract(_files(spark, GENERIC)))


#: First lines of texts and the language each asks for: no text of the tables has such a line.
SHEBANGS = [
    ("#!/usr/bin/env python3\nx\n", "python"), ("#!/usr/bin/python2.7", "python"), ("#!/usr/bin/env node\n", "javascript"), ("#!/usr/local/bin/ruby\n", "ruby"), ("#!/bin/bash\necho\n", "shell"), ("#!/bin/sh\n", "shell"),
    ("#! /usr/bin/zsh\n", "shell"), ("#!/usr/bin/perl\n", "perl"), ("#!/usr/bin/php\n", "php"), ("#!/usr/bin/tclsh\n", None), ("x = 1\n#!/bin/sh\n", None), (" #!/bin/sh\n", "shell"), ("", None),
]


def shebang_samples(spark, d):
    """What the first lines of small texts ask for."""
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(SHEBANGS)], "nr int, content string")
    return df.select("nr", L.shebang_language(F.col("content")).alias("interpreter"))


def extracted_edges(spark, d):
    """Call, import and inheritance edges of the small sources."""
    rows = stage(xt.extract(_files(spark, {**PYTHON, **JAVASCRIPT, **GO})), "small")
    name = lambda c: F.substring_index(F.substring_index(c, ":", 3), ":", -1)
    calls = xt.edges(rows, "call").select(F.lit("call").alias("what"), "file_path", name("caller_id").alias("source"), F.col("callee_name").alias("target"))
    imports = xt.edges(rows, "import").select(F.lit("import").alias("what"), F.col("source_file").alias("file_path"), F.coalesce("alias", F.lit("")).alias("source"), F.col("target_module").alias("target"))
    inherits = xt.edges(rows, "inherit").select(F.col("kind").alias("what"), F.element_at(F.split("child_id", ":"), 2).alias("file_path"), name("child_id").alias("source"), F.col("parent_name").alias("target"))
    return calls.union(imports).union(inherits)


_EDGE_ROWS = [
    ('call', 'card.jsx', 'Card', 'draw'),
    ('call', 'card.jsx', '__module__', 'boot'),
    ('call', 'shape.ts', 'rate', 'calc'),
    ('call', 'yard.go', 'Depot.Find', 'seek'),
    ('call', 'vars.go', 'total', 'c.put'),
    ('call', 'crane.py', 'Crane.lift', 'self.motor.pull'),
    ('call', 'crane.js', 'Crane.lift', 'this.motor.pull'),
    ('call', 'crane.js', 'Crane.constructor', 'wire'),
    ('call', 'weigh.py', 'weigh', 'Balance'),
    ('call', 'weigh.py', 'weigh', 'scale.measure'),
    ('call', 'join.js', 'join', 'glue'),
    ('import', 'yard.go', '', 'http'),
    ('import', 'vars.go', 'f', 'fmt'),
    ('import', 'vars.go', '', 'os'),
    ('import', 'needs.py', '', 'shutil'),
    ('import', 'needs.py', '', 'depot'),
    ('import', 'needs.js', '', 'yard-kit'),
    ('import', 'needs.js', '', 'zlib'),
    ('inherits', 'shape.ts', 'Plot', 'Ground'),
    ('inherits', 'crane.py', 'Crane', 'Machine'),
    ('inherits', 'crane.js', 'Crane', 'Machine'),
    ('inherits', 'kinds.py', 'Colour', 'enum.Enum'),
    ('implements', 'kinds.py', 'Movable', 'Protocol'),
]


def _sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_files").where("content is not null").select("repo_id", "path", "content").distinct()
    return s.select("repo_id", "path", L.detect_language(F.col("path"), F.col("content")).alias("language"), "content")


def pattern_elements(spark, d):
    """Every element that patterns find in every source file, whatever its language."""
    n = generic.by_patterns(_sources(spark, d)).where("tag = 'node'").select("repo_id", "node.*")
    return n.select("repo_id", "file_path", "kind", "name", "start_line", "end_line", F.array_join("parameters", ",").alias("parameters"), F.coalesce("signature", F.lit("")).alias("signature"))


def source_definitions(spark, d):
    """Functions, methods and classes of the Python and Go files: names and lines, by the line that defines them."""
    n = xt.nodes(xt.extract(_sources(spark, d).where("language in ('python', 'go')")))
    kinds = ("function", "method", "constructor", "class", "enum", "interface", "struct")
    return n.where(F.col("kind").isin(*kinds)).select("repo_id", "file_path", F.element_at(F.split("name", r"\."), -1).alias("name"), "start_line").distinct()


def extract_all(spark, d):
    """Elements per repository, language and kind of every source file, through the whole phase: extract, last writes."""
    s = table(spark, d, "source_files").dropDuplicates(["repo_id", "path"])
    rows = xt.extract(s.select("repo_id", "path", L.detect_language(F.col("path"), F.col("content")).alias("language"), "content"))
    return xt.last_writes(xt.nodes(rows)).groupBy("repo_id", "language", "kind").agg(F.count("*").alias("n"))


def sources_graph(spark, d):
    """From source text to the merged graph: edges by type of everything that can be read from source_files."""
    s = table(spark, d, "source_files").dropDuplicates(["repo_id", "path"])
    rows = stage(xt.extract(s.select("repo_id", "path", L.detect_language(F.col("path"), F.col("content")).alias("language"), "content")), "rows")
    nodes = stage(xt.last_writes(xt.nodes(rows)), "nodes")
    parts = {
        "calls": resolve.call_edges(xt.edges(rows, "call"), nodes),
        "imports": resolve.import_edges(xt.edges(rows, "import").select("repo_id", "source_file", "target_module").distinct(), nodes),
        "inherits": resolve.inheritance_edges(xt.edges(rows, "inherit"), nodes),
        "defines": resolve.defines_edges(nodes),
    }
    every = None
    for t, df in parts.items():
        every = df.withColumn("type", F.lit(t)) if every is None else every.unionByName(df.withColumn("type", F.lit(t)))
    return graph.merge_edges(every).groupBy("repo_id", "type").agg(F.count("*").alias("n"))


def json_lists(spark, d):
    """Lists of nodes as JSON text and back."""
    n = graph.current_nodes(table(spark, d, "ir_nodes"), *store.LISTS)
    back = store.from_json_columns(store.to_json_columns(n))
    text = lambda c: (lambda x: F.concat_ws(":", x["name"], F.coalesce(x["type"], F.lit("?")))) if c == "typed_parameters" else (lambda x: F.coalesce(x, F.lit("?")))
    return back.select("id", *[F.size(c).cast("long").alias(f"n_{c}") for c in store.LISTS], *[F.array_join(F.transform(c, text(c)), "|").alias(c) for c in store.LISTS])


def manifest_report(spark, d):
    """The text report per repository, of all files as new ones."""
    f = manifest.latest(table(spark, d, "files")).withColumn("status", F.lit("new"))
    meta = manifest.newest_per(table(spark, d, "repo_meta").dropDuplicates(), ["repo_id"], ["last_indexed_at", "snapshot_id"])
    return manifest.summary_text(f, meta.select("repo_id", "source", "source_type", "git_commit"))


def parse_totals(spark, d):
    """Totals of the parsing report per repository."""
    edges = {"calls": table(spark, d, "ir_call_edges").select("repo_id", "id").distinct(), "inherits": table(spark, d, "ir_inheritance_edges").select("repo_id", "id").distinct()}
    return reports.parse_totals(table(spark, d, "parse_results"), graph.current_nodes(table(spark, d, "ir_nodes")), edges)


def parse_report(spark, d):
    edges = {"Call edges": table(spark, d, "ir_call_edges"), "Inherit edges": table(spark, d, "ir_inheritance_edges")}
    return reports.parse_report(table(spark, d, "parse_results"), graph.current_nodes(table(spark, d, "ir_nodes")), edges)


def graph_report(spark, d):
    n = stage(graph.current_nodes(table(spark, d, "ir_nodes"), "calls", "imports"), "nodes")
    return reports.graph_report(n, stage(graph.merge_edges(graph.all_edges(n, table(spark, d, "ir_call_edges"), table(spark, d, "ir_inheritance_edges"))), "merged"))


def legacy_edges(spark, d):
    return resolve.legacy_edges(stage(graph.current_nodes(table(spark, d, "ir_nodes"), "calls", "imports"), "nodes"))


QUERIES = {f.__name__: f for f in (extract_python, extract_javascript, extract_go, extract_generic, extracted_edges, shebang_samples, pattern_elements, source_definitions, extract_all, sources_graph, json_lists, manifest_report, parse_totals, parse_report, graph_report, legacy_edges)}
_CUR = "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, deleted_at NULLS LAST) AS rn FROM ir_nodes) WHERE rn = 1 AND deleted_at IS NULL)"
_LINES = r"""s AS (SELECT DISTINCT repo_id, path, content FROM source_files WHERE content IS NOT NULL),
  l AS (SELECT *, lag(line) OVER (PARTITION BY repo_id, path, content ORDER BY i) AS before FROM (SELECT *, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM s)),
  w AS (SELECT *, array_to_string(string_split(content, chr(10))[i:i + 40], chr(10)) AS ahead FROM l)"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQL = {
    "shebang_samples": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if want is None else repr(want)})" for k, (_, want) in enumerate(SHEBANGS)) + ") AS t(nr, interpreter)",
    # Definitions may span lines: those that begin a line are looked for from there, functions also where a line breaks off in one.
    "pattern_elements": rf"""WITH {_LINES},
  py AS (SELECT *, max(i + len(m) - len(replace(m, chr(10), ''))) OVER (PARTITION BY repo_id, path, content ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken
    FROM (SELECT *, regexp_extract(ahead, '^[ \t]*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)') AS m FROM w) WHERE m <> ''),
  f AS (SELECT repo_id, path, content, 1 AS p, i AS nr, line AS shown, regexp_extract(m, 'def\s+(\w+)\s*\(([^)]*)\)', 1) AS name, regexp_extract(m, 'def\s+(\w+)\s*\(([^)]*)\)', 2) AS given FROM py WHERE i > coalesce(taken, 0)
    UNION ALL SELECT repo_id, path, content, 2, i, line, regexp_extract(ahead, '^[^\n]*\sfunction\s+(\w+)\s*\(([^)]*)\)', 1), regexp_extract(ahead, '^[^\n]*\sfunction\s+(\w+)\s*\(([^)]*)\)', 2) FROM w
      WHERE regexp_matches(line, '\sfunction(?:\s+\w+\s*(?:\([^)]*)?|\s*)$') AND regexp_matches(ahead, '^[^\n]*\sfunction\s+(\w+)\s*\(([^)]*)\)')
    UNION ALL SELECT repo_id, path, content, 2, CASE WHEN i > 1 AND k = 1 AND regexp_matches(line, '^function') THEN i - 1 ELSE i END, CASE WHEN i > 1 AND k = 1 AND regexp_matches(line, '^function') THEN before ELSE line END, name, given
      FROM (SELECT *, unnest(regexp_extract_all(line, '(?:^|\s)function\s+(\w+)\s*\(([^)]*)\)', 1)) AS name, unnest(regexp_extract_all(line, '(?:^|\s)function\s+(\w+)\s*\(([^)]*)\)', 2)) AS given, generate_subscripts(regexp_extract_all(line, '(?:^|\s)function\s+(\w+)\s*\(([^)]*)\)', 2), 1) AS k FROM l)
    UNION ALL SELECT repo_id, path, content, 3, i, line, unnest(regexp_extract_all(line, '(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>', 1)), unnest(regexp_extract_all(line, '(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>', 2)) FROM l),
  fn AS (SELECT repo_id, path, content, nr, name, arg_min(given, p) AS given, arg_min(shown, p) AS shown FROM f GROUP BY ALL),
  st AS (SELECT DISTINCT repo_id, path, content, {_STRIP.format("m")} AS m FROM (SELECT repo_id, path, content, unnest(regexp_extract_all(line, '^[ \t]*(?:import|from)\s+\S+')) AS m FROM l UNION ALL SELECT repo_id, path, content, unnest(regexp_extract_all(line, '^[ \t]*import\s+.+\s+from\s+[''"]')) FROM l
    UNION ALL SELECT repo_id, path, content, unnest(regexp_extract_all(line, '^[ \t]*import\s+[\w.]+;')) FROM l UNION ALL SELECT repo_id, path, content, unnest(regexp_extract_all(line, '^[ \t]*import\s+"[\w./]+"')) FROM l))
  SELECT repo_id, path AS file_path, 'module' AS kind, path AS name, 1 AS start_line, CAST(len(string_split(content, chr(10))) - CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS end_line, '' AS parameters, '' AS signature FROM s
  UNION ALL SELECT st.repo_id, st.path, 'import', m, CAST(min(i) AS INTEGER), CAST(min(i) AS INTEGER), '', '' FROM st JOIN l ON l.repo_id = st.repo_id AND l.path = st.path AND l.content = st.content AND contains(line, m) GROUP BY st.repo_id, st.path, st.content, m
  UNION ALL SELECT repo_id, path, 'class', regexp_extract(line, 'class\s+(\w+)', 1), CAST(i AS INTEGER), CAST(i AS INTEGER), '', {_STRIP.format("line")} FROM l WHERE regexp_matches(line, '^[ \t]*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)')
  UNION ALL SELECT repo_id, path, CASE WHEN name IN ('__init__', 'constructor') THEN 'constructor' ELSE 'function' END, name, CAST(nr AS INTEGER), CAST(nr AS INTEGER),
    array_to_string(list_transform(list_filter(list_transform(string_split(given, ','), lambda x: {_STRIP.format("x")}), lambda x: x <> ''), lambda x: {_STRIP.format("split_part(split_part(x, ':', 1), '=', 1)")}), ','), {_STRIP.format("shown")} FROM fn""",
    # One definition a line, at its begin: so the files of the tables are written. Within broken blocks the extractors may find less.
    "source_definitions": rf"""WITH {_LINES} SELECT DISTINCT repo_id, path AS file_path, regexp_extract(line, '^[ \t]*(?:async\s+)?(?:def|class)\s+(\w+)', 1) AS name, CAST(i AS INTEGER) AS start_line FROM l WHERE regexp_matches(path, '\.pyi?$') AND regexp_matches(line, '^[ \t]*(?:async\s+)?(?:def|class)\s+\w')
  UNION SELECT DISTINCT repo_id, path, regexp_extract(line, '^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)', 1), CAST(i AS INTEGER) FROM l WHERE ends_with(path, '.go') AND regexp_matches(line, '^func\s+(?:\([^)]*\)\s*)?\w|^type\s+\w+\s+(?:struct|interface)')""",
    "parse_totals": f"""{_CUR}, r AS (SELECT repo_id, file_path, bool_and(coalesce(success, FALSE)) AS fine FROM parse_results GROUP BY ALL), f AS (SELECT repo_id, count(*) AS files, count(*) FILTER (NOT fine) AS failed FROM r GROUP BY ALL),
  n AS (SELECT repo_id, count(*) AS nodes FROM cur GROUP BY ALL), c AS (SELECT repo_id, count(DISTINCT id) AS calls FROM ir_call_edges GROUP BY ALL), i AS (SELECT repo_id, count(DISTINCT id) AS inherits FROM ir_inheritance_edges GROUP BY ALL)
  SELECT repo_id, CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(failed, 0) AS BIGINT) AS failed, CAST(coalesce(nodes, 0) AS BIGINT) AS nodes, CAST(coalesce(calls, 0) AS BIGINT) AS calls, CAST(coalesce(inherits, 0) AS BIGINT) AS inherits
  FROM f FULL JOIN n USING (repo_id) FULL JOIN c USING (repo_id) FULL JOIN i USING (repo_id)""",
    "manifest_report": r"""WITH f AS (SELECT repo_id, path, v.language AS language, v.line_count AS line_count FROM (SELECT repo_id, path, arg_max({'language': language, 'line_count': line_count}, (indexed_at, coalesce(sha256, ''))) AS v FROM files GROUP BY ALL)),
  t AS (SELECT repo_id, count(*) AS n, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS lines FROM f GROUP BY repo_id), p AS (SELECT repo_id, language, count(*) AS k FROM f GROUP BY ALL),
  g AS (SELECT repo_id, string_agg(chr(39) || coalesce(language, 'null') || chr(39) || ': ' || k, ', ' ORDER BY k DESC, language NULLS FIRST) AS langs FROM p GROUP BY repo_id),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY last_indexed_at DESC NULLS LAST, snapshot_id DESC NULLS LAST) AS k FROM (SELECT DISTINCT * FROM repo_meta)) WHERE k = 1)
  SELECT t.repo_id, concat('Repo      : ', t.repo_id, chr(10), 'Source    : ', source, ' (', source_type, ')', chr(10), 'Commit    : ', coalesce(git_commit, 'N/A'), chr(10), 'Files     : ', n, ' (', format('{:,}', lines), ' lines)', chr(10),
    'New       : ', n, chr(10), 'Modified  : 0', chr(10), 'Unchanged : 0', chr(10), 'Deleted   : 0', chr(10), 'Languages : {', coalesce(langs, ''), '}') AS report FROM t LEFT JOIN m USING (repo_id) LEFT JOIN g USING (repo_id)""",
    "parse_report": f"""{_CUR}, r AS (SELECT repo_id, file_path, bool_and(coalesce(success, FALSE)) AS fine FROM parse_results GROUP BY ALL), f AS (SELECT repo_id, count(*) AS files, count(*) FILTER (NOT fine) AS failed FROM r GROUP BY ALL),
  n AS (SELECT repo_id, count(*) AS nodes FROM cur GROUP BY ALL), c AS (SELECT repo_id, count(*) AS calls FROM ir_call_edges GROUP BY ALL), i AS (SELECT repo_id, count(*) AS inherits FROM ir_inheritance_edges GROUP BY ALL),
  bad AS (SELECT repo_id, string_agg(chr(10) || '  x ' || file_path, '' ORDER BY file_path) AS names FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS k FROM (SELECT DISTINCT repo_id, file_path FROM parse_results WHERE NOT coalesce(success, FALSE))) WHERE k <= 5 GROUP BY repo_id)
  SELECT repo_id, concat('Repo         : ', repo_id, chr(10), 'Files parsed : ', coalesce(files, 0), chr(10), 'Total nodes  : ', coalesce(nodes, 0), chr(10), 'Call edges   : ', coalesce(calls, 0), chr(10), 'Inherit edges: ', coalesce(inherits, 0), chr(10), 'Failed files : ', coalesce(failed, 0), names) AS report
  FROM f FULL JOIN n USING (repo_id) FULL JOIN c USING (repo_id) FULL JOIN i USING (repo_id) LEFT JOIN bad USING (repo_id)""",
    "graph_report": f"WITH {codegraph._EDGES}, " + """n AS (SELECT repo_id, count(*) AS nodes FROM cur GROUP BY ALL), e AS (SELECT repo_id, count(*) AS edges FROM merged GROUP BY ALL),
  o AS (SELECT repo_id, count(*) AS orphans FROM cur WHERE (repo_id, id) NOT IN (SELECT (repo_id, src) FROM merged) AND (repo_id, id) NOT IN (SELECT (repo_id, dst) FROM merged) GROUP BY ALL),
  nk AS (SELECT repo_id, string_agg(x, ', ' ORDER BY x) AS kinds FROM (SELECT repo_id, concat_ws(' ', kind, count(*)) AS x FROM cur GROUP BY repo_id, kind) GROUP BY repo_id),
  ek AS (SELECT repo_id, string_agg(x, ', ' ORDER BY x) AS types FROM (SELECT repo_id, concat_ws(' ', type, count(*)) AS x FROM merged GROUP BY repo_id, type) GROUP BY repo_id)
  SELECT n.repo_id, concat('Repo         : ', n.repo_id, chr(10), 'Nodes        : ', nodes, chr(10), 'Edges        : ', coalesce(edges, 0), chr(10), 'Orphans      : ', coalesce(orphans, 0), chr(10), 'Nodes/kind   : ', coalesce(kinds, ''), chr(10), 'Edges/kind   : ', coalesce(types, '')) AS report
  FROM n LEFT JOIN e USING (repo_id) LEFT JOIN o USING (repo_id) LEFT JOIN nk USING (repo_id) LEFT JOIN ek USING (repo_id)""",
    "legacy_edges": f"""{_CUR}, lastn AS (SELECT repo_id, name, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY file_path DESC, start_line DESC, id DESC) AS k FROM cur) WHERE k = 1),
  lists AS (SELECT DISTINCT repo_id, id AS src, unnest(calls) AS name FROM cur)
  SELECT DISTINCT w.repo_id, w.src, n.id AS dst, 'calls' AS type FROM lists w JOIN cur n ON n.repo_id = w.repo_id AND n.name = w.name
  UNION SELECT w.repo_id, w.src, n.id, 'calls' FROM lists w JOIN cur n ON n.repo_id = w.repo_id AND n.name = split_part(w.name, '.', -1) WHERE (w.repo_id, w.name) NOT IN (SELECT (repo_id, name) FROM cur)
  UNION SELECT i.repo_id, i.src, l.id, 'imports' FROM (SELECT repo_id, id AS src, unnest(imports) AS name FROM cur) i JOIN lastn l ON l.repo_id = i.repo_id AND l.name = i.name
  UNION SELECT c.repo_id, l.id, c.id, 'defines' FROM cur c JOIN lastn l ON l.repo_id = c.repo_id AND l.name = c.parent_class""",
    "extract_python": _values(PYTHON_ROWS),
    "extract_javascript": _values(JAVASCRIPT_ROWS),
    "extract_go": _values(GO_ROWS),
    "extract_generic": _values(GENERIC_ROWS),
    "extracted_edges": "SELECT * FROM (VALUES " + ", ".join(str(r) for r in _EDGE_ROWS) + ") AS t(what, file_path, source, target)",
    "json_lists": "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, deleted_at NULLS LAST) AS rn FROM ir_nodes) WHERE rn = 1 AND deleted_at IS NULL) SELECT id, "
    + ", ".join(f"coalesce(len({c}), 0) AS n_{c}" for c in store.LISTS)
    + ", "
    + ", ".join(f"coalesce(array_to_string(list_transform({c}, lambda x: {"concat_ws(':', x.name, coalesce(x.type, '?'))" if c == 'typed_parameters' else "coalesce(x, '?')"}), '|'), '') AS {c}" for c in store.LISTS)
    + " FROM cur",
}
