"""Functions paired with their documentation.

The documentation of a function is its `docstring`, or where that is null the docstring in its body or the comment
right right above it in the source text. Candidate comments of a file and all its functions are matched as a bipartite
assignment that maximises the sum of scores from names, parameter tags and distance: each comment has a link to every
function within a few lines, above or below it, across blank lines too, so that of several comments and functions close
together each comment goes to the function it fits best. Of the pairs so found the implausible ones are rejected (across
a blank line, or without a sign of belonging together), then those whose documentation says nothing.

Functions with null id or deleted ones are left out; of rows with the same `ord` the deleted one holds. A function
without file or start line can only have its `docstring`. Repeated source rows count once. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import plain_path, ship

KINDS = ("function", "method", "constructor")

# --- what documentation says

# Instructions to tools.
_TOOL = re.compile(
    r"(?i)^\W*(?:noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|ruff:|pyright:|fmt:\s*(?:on|off|skip)|yapf:|isort:|pragma[: ]|nosec\b|coding[:=]|eslint\b|eslint-|tslint:|jshint\b|jslint\b|prettier-ignore|biome-ignore|istanbul ignore|c8 ignore|v8 ignore|webpack\w+:|"
    r"@ts-\w+|@flow\b|@jsx\b|nosonar\b|noinspection\b|nolint\b|lint:|go:\w+|\+build\b|line \S+:\d+|export \w+$|@suppress\w*|checkstyle:|@formatter:|spotless:|pmd\b|clang-format|clang-tidy|coverage:|region\b|endregion\b|sourcemappingurl|@override\b|@inherit-?doc\b|\{@inheritdoc\}|@generated\b|@ignore\b|@internal\s*$|@private\s*$|@public\s*$|@deprecated\s*$)"
)
_LICENCE = re.compile(r"(?i)copyright|\(c\)\s|©|spdx-|@licen[sc]e|all rights reserved|licen[sc]ed under|distributed under")
# Words of which texts that only stand in for documentation consist.
_STAND_IN = frozenset(
    "todo fixme tbd tba xxx hack wip na n/a none nothing empty placeholder document documents documentation documented undocumented doc docs docstring docstrings description descriptions describe described comment comments summary text "
    "missing add added write written fill filled insert put needs need needed available auto generated autogenerated auto-generated stub stubs self explanatory self-explanatory obvious see code source name later soon here please yet no not next release before after "
    "once its interface has have settled down whoever implements implement implemented implementation fix me change lorem ipsum parameters params parameter result results returns return purpose function method constructor class this that the a an of to be by in is it one for and or so with "
    "beschreibung fehlt ergänzen kommentar description manquante documenter ajouter pendiente documentar falta descripción".split()
)
#: Of these at least one must be among them.
_CORE = frozenset(
    "todo fixme tbd tba xxx wip na n/a none placeholder document documentation undocumented doc docs docstring description describe comment comments summary missing stub auto-generated autogenerated self-explanatory obvious code lorem later beschreibung fehlt manquante pendiente falta".split()
)
_SMALL = frozenset("the a an of this that function method constructor class for to is does it its and or with from in on by as at be func def fn routine procedure helper returns return get gets set sets parameter parameters param params argument arguments args named called takes".split())
_NOTE = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack)\b")
_SECTION = re.compile(r"(?i)^\s*(?:args?|arguments?|param(?:eter)?s?|returns?|raises?|yields?|throws|attributes?|notes?|examples?|see also|keyword args)\s*:?\s*$")
_TAG = re.compile(r"^\s*(?::(?:param|parameter|arg|argument|type|raises?|returns?|rtype|yields?|var|ivar|key)\b([^:]*):|[@\\](?:param|arg|argument|returns?|throws|exception|raises?|type|rtype|typedef|template|tparam|yields?|see|since|author|version|name|memberof|class|constructor|function|method|this|callback)\b\s*(?:\{[^}]*\})?\s*(\[?[\w.$]*\]?)?\s*[-:]?)(.*)$")
_TYPE_WORDS = frozenset("str int bool float dict list bytes none object string number boolean map any void null array tuple optional undefined long double char integer".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")


def strip_marks(text: str) -> list[str]:
    """The lines of a comment or docstring without what marks them as one."""
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = re.sub(r"\*+/\s*$", "", re.sub(r"^\s*(?:/\*+!?|\*+(?!/)|//+!?|#+!?|\"\"\"|''')", "", line))
        out.append(re.sub(r"(?:\"\"\"|''')\s*$", "", s).rstrip())
    return out


def _split_names(text: str) -> set[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    return {_stem(w.lower()) for w in _WORD.findall(spaced.replace("_", " "))}


def _stem(w: str) -> str:
    for end in ("ing", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def _is_code(line: str) -> bool:
    """A statement that was commented out: it parses, and has more of code than of prose."""
    s = line.strip()
    if not s or not re.search(r"[=(){};\[\]]|^(?:return|break|continue|pass|raise|throw|import|del|yield|goto)\b|^@\w+$", s):
        return False
    if re.search(r"[;{}]\s*$", s) and re.search(r"[=()]|^(?:return|break|continue|\})", s):
        return True
    from codeweft.llm.parsing import check

    probes = ("x.py", "x.js", "x.go", "x.java")
    body = s if not s.endswith(":") else s + " pass"
    words = re.findall(r"(?<![\w.])[a-z]{2,}(?= [a-z])", s)
    return len(words) < 4 and any(
        not check(p, body if p == "x.py" else f"async function* f() {{ {s} }}" if p == "x.js" else f"package p\nfunc f() {{ {s} }}\n" if p == "x.go" else f"class A {{ void f() {{ {s} }} }}")[1] for p in probes
    )


def is_telling(doc: str | None, name: str | None, signature: str | None, params: list[str] | None) -> bool:
    """Does the documentation say more than the code does?"""
    if not doc or not doc.strip():
        return False
    known = _split_names(f"{name or ''} {signature or ''} {' '.join(p for p in params or [] if p)}")
    prose: list[str] = []
    told = False
    section = False
    for line in strip_marks(doc):
        s = line.strip()
        if not s:
            section = False
            prose.append("")
            continue
        if _TOOL.match(s) or _LICENCE.search(s) or not re.search(r"[^\W_]", s) or re.match(r"^([-=*~#_/])\1{2,}.*\1{3,}$", s):
            continue
        if _SECTION.match(s):
            section = True
            continue
        if tag := _TAG.match(s):
            told |= _adds(tag[3] or "", known | _split_names(tag[1] or "") | _split_names(tag[2] or ""))
            continue
        entry = re.match(r"^([\w*.\[\]]+)\s*(?:\([^)]*\))?\s*:\s*(.*)$", s)
        if section and entry:
            told |= _adds(entry[2], known | _split_names(entry[1]))
            continue
        if section and re.fullmatch(r"[\w.\[\], ]+", s) and all(w.lower() in _TYPE_WORDS for w in _WORD.findall(s)):
            continue
        if _is_code(s):
            continue
        prose.append(s)
    if told:
        return True
    # A sentence ends at its stop, or with its paragraph.
    paragraphs = " ".join(x or "\0" for x in prose).split("\0")
    return any(_adds(x, known) for text in paragraphs for x in re.split(r"(?<=[.!?。！？])\s+|(?<=[。！？])", text) if x)


def _adds(sentence: str, known: set[str]) -> bool:
    sentence = re.sub(r"(?i)\bn/a\b", "na", sentence)
    words = [w.lower() for w in _WORD.findall(sentence.replace("_", " "))]
    if not words:
        return False
    if _NOTE.match(sentence):
        return False
    if any(w in _CORE for w in words) and all(w in _STAND_IN or _stem(w) in known for w in words):
        return False
    if re.fullmatch(r"[\w.$]+\s*\(.*\)\s*(?:->.*|:.*)?", sentence.strip()) and all(_stem(w) in known or w in _TYPE_WORDS for w in words):
        return False
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", sentence.replace("_", " "))
    rest = [w for w in (x.lower() for x in _WORD.findall(spaced)) if w not in _SMALL and w not in _TYPE_WORDS and _stem(w) not in known]
    return bool(rest) and not all(w in _STAND_IN and w in _CORE for w in rest)


# --- candidate comments

#: Lines by which a function may be off a comment's definition, and blank lines between them, to be linked at all.
REACH = 3

_DEF = re.compile(
    r"^\s*(?:(?:export|default|public|private|protected|static|final|abstract|async|synchronized|override|declare|readonly|get|set)\s+)*(?:def\s+(?P<py>\w+)|func\s+(?:\([^)]*\)\s*)?(?P<go>\w+)|function\s*\*?\s*(?P<fn>[\w$]+)|(?:const|let|var)\s+(?P<arrow>[\w$]+)[^=]*=|(?P<short>\w+)\s*:=\s*func\b|(?:[\w<>\[\],.? ]+\s)?\*?(?P<other>[\w$]+)\s*(?:<[^>]*>)?\(|(?:[\w<>]+\s)(?P<lambda>\w+)\s*=\s*\()"
)
_DECORATOR = re.compile(r"^\s*@[\w.]+(?:\(.*\))?\s*$")
_DOCSTRING = re.compile(r"""[ \t]*[rRuU]?(\"\"\"|'''|"|')""")
_TAG_NAME = re.compile(r"(?:[:@\\]param(?:eter)?\s+(?:\{[^}]*\}\s*)?\[?|^\s*)([\w$]+)\s*(?::|\s-|\(|\s)", re.MULTILINE)

CANDIDATES = "repo_id string, path string, line int, gap int, name string, text string"


def candidates(content: str, hashes: bool) -> list[tuple[int, int, str, str]]:
    """(line of the definition that follows, blank lines between, name that is defined there, text) of each comment or
    docstring that could be a function's; a comment further than REACH blank lines from any definition is none."""
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    n, i, out = len(lines), 0, []
    block: list[str] = []
    gap = 0
    while i < n:
        s = lines[i].strip()
        if hashes and s.startswith("#") or not hashes and s.startswith("//"):
            # A blank line ends a comment: what follows is another.
            block = [s] if gap else [*block, s]
            gap = 0
            i += 1
        elif not hashes and s.startswith("/*"):
            block, gap = [], 0
            while i < n:
                block.append(lines[i].strip())
                i += 1
                if "*/" in block[-1][2 if len(block) == 1 else 0 :]:
                    break
        else:
            if block and s:
                j = i
                while j < n and _DECORATOR.match(lines[j]):
                    j += 1
                if j < n and (m := _DEF.match(lines[j])):
                    out.append((j + 1, gap, next(x for x in m.groups() if x), "\n".join(block)))
            if block and not s and gap < REACH:
                gap += 1
            else:
                block, gap = [], 0
            if hashes and (m := re.match(r"\s*(?:async\s+)?def\s+(\w+)", lines[i])):
                first = i
                depth = 0
                while i < n:
                    bare = re.sub(r"\"[^\"]*\"|'[^']*'|#.*", "", lines[i])
                    depth += sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")
                    if depth <= 0 and bare.rstrip().endswith(":"):
                        break
                    if depth <= 0:
                        break
                    i += 1
                k = i + 1
                while k < n and not lines[k].strip():
                    k += 1
                if k < n and (q := _DOCSTRING.match(lines[k])):
                    text, end = _string(lines, k, q)
                    if text is not None:
                        out.append((first + 1, 0, m[1], text))
                        i = end
            i += 1
    return out


def _string(lines: list[str], k: int, q: re.Match) -> tuple[str | None, int]:
    quote = q[1]
    if len(quote) == 1:
        m = re.match(rf"((?:[^{quote}\\]|\\.)*){quote}\s*$", lines[k][q.end() :])
        return (m[1], k) if m else (None, k)
    rest = lines[k][q.end() :]
    out = []
    while True:
        at = rest.find(quote)
        if at >= 0:
            out.append(rest[:at])
            return "\n".join(out), k
        out.append(rest)
        k += 1
        if k >= len(lines):
            return None, k
        rest = lines[k]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list = []
        for repo, path, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            rows += [(repo, path, *c) for c in candidates(text, path.endswith((".py", ".pyi", ".rb", ".sh")))]
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["repo_id", "path", "line", "gap", "name", "text"])


# --- assignment

#: Least score of a plausible link, and what a comment gets right above a function or in it.
LEAST_SCORE, ADJACENT = 4.0, 20.0


def score(f: dict, c: dict) -> float:
    """How well comment `c` fits function `f`, 0 for no link. A comment right above outweighs any two others, so the
    assignment never trades it for weaker links; below LEAST_SCORE a link only competes."""
    off = abs(c["line"] - f["line"])
    if off > REACH:
        return 0.0
    if c["gap"]:
        # Across blank lines nothing is plausible.
        return 1.0 / (1 + off + c["gap"])
    s = REACH + 1.0 - off
    name = (f["name"] or "").rpartition(".")[2]
    named = bool(name) and c["name"] == name
    tags = set(_TAG_NAME.findall(c["text"]))
    params = {p.lstrip("*.").partition(":")[0].strip() for p in f["params"] or [] if p}
    fit = len(tags & params) / len(params) if tags and params else 0.0
    if not named:
        # Of another name: plausible by tags on the very line only.
        return min(s, 2.0) + fit if off else 3.0 + 2.0 * fit
    return s + 3.0 + 2.0 * fit + (0.0 if off else ADJACENT)


def assign(weights: list[list[float]]) -> list[int]:
    """For each row the column of a maximum-weight bipartite matching, -1 for none (weights of 0 are no links)."""
    return match([{j: w for j, w in enumerate(r) if w > 0} for r in weights])


def match(links: list[dict[int, float]]) -> list[int]:
    """`assign` over each row's links only: shortest augmenting paths with potentials, each row with a free column of its
    own (-1 - row) for being left alone."""
    row_of: dict[int, int] = {}
    got = [-1] * len(links)
    top = [max(r.values(), default=0.0) for r in links]
    u, v = [-x for x in top], {}
    for first in range(len(links)):
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        i, base, end = first, 0.0, None
        while end is None:
            for j, w in (*links[i].items(), (-1 - i, 0.0)):
                d = base - w - u[i] - v.get(j, 0.0)
                if j not in done and d < dist.get(j, float("inf")):
                    dist[j], back[j] = d, i
                    heapq.heappush(heap, (d, j))
            while True:
                base, j = heapq.heappop(heap)
                if j not in done and base <= dist[j]:
                    break
            done.add(j)
            if j in row_of:
                i = row_of[j]
            else:
                end = j
        for j in done:
            if j in row_of:
                u[row_of[j]] += base - dist[j]
            v[j] = v.get(j, 0.0) + dist[j] - base
        u[first] += base
        j = end
        while True:
            i = back[j]
            j, got[i] = got[i] if i != first else None, j
            row_of[got[i]] = i
            if j is None:
                break
    return [j if j >= 0 else -1 for j in got]


def parts_of(functions: list[dict], comments: list[dict]) -> list[list[tuple[int, int, float]]]:
    """The links of a file, (function, comment, score), by connected part."""
    by_line: dict[int, list[int]] = {}
    for j, c in enumerate(comments):
        by_line.setdefault(c["line"], []).append(j)
    links = [(i, j, s) for i, f in enumerate(functions) for line in range(f["line"] - REACH, f["line"] + REACH + 1) for j in by_line.get(line, ()) if (s := score(f, comments[j])) > 0]
    group: dict[int, int] = {}

    def find(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, j, _ in links:
        group[find(i)] = find(-1 - j)
    parts: dict[int, list] = {}
    for link in links:
        parts.setdefault(find(link[0]), []).append(link)
    return list(parts.values())


def match_file(functions: list[dict], comments: list[dict]) -> list[tuple[dict, dict]]:
    """Pairs of one file, implausible ones left out; functions that need no comment (`own`) only compete."""
    pairs = []
    for part in parts_of(functions, comments):
        if len(part) > 1:
            rows = sorted({i for i, _, _ in part})
            place = {i: k for k, i in enumerate(rows)}
            several = Counter(i for i, _, s in part if s >= LEAST_SCORE)
            links: list[dict[int, float]] = [{} for _ in rows]
            for i, j, s in part:
                # Of candidates that are alike otherwise the one that says something is meant.
                f = functions[i]
                links[place[i]][j] = s + (0.5 * is_telling(comments[j]["text"], f["name"], f["signature"], f["params"]) if s >= LEAST_SCORE and several[i] > 1 else 0.0)
            got = match(links)
            part = [(i, j, links[k][j]) for k, (i, j) in enumerate(zip(rows, got)) if j >= 0]
        pairs += [(functions[i], comments[j]) for i, j, s in part if s >= LEAST_SCORE and not functions[i].get("own")]
    return pairs


PAIRS = "node_id string, name string, signature string, documentation string, telling boolean"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file: comments (node_id null) and functions without docstring."""
    key, fs, cs, out = None, [], [], []

    def flush() -> None:
        for f, c in match_file(fs, cs):
            doc = "\n".join(strip_marks(c["text"])).strip()
            out.append((f["node_id"], f["name"], f["signature"], doc, is_telling(c["text"], f["name"], f["signature"], f["params"])))

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["node_id", "name", "signature", "documentation", "telling"])

    for b in batches:
        for r in b.to_pylist():
            k = (r["repo_id"], r["path"])
            if k != key:
                flush()
                key, fs, cs = k, [], []
            (cs if r["node_id"] is None else fs).append(r)
        if len(out) > 5_000:
            yield batch()
            out.clear()
    flush()
    yield batch()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, names, signatures, docs, params = (b.column(k).to_pylist() for k in range(5))
        telling = [is_telling(*x) for x in zip(docs, names, signatures, params)]
        texts = ["\n".join(strip_marks(d)).strip() for d in docs]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array(telling, pa.bool_())], names=["node_id", "name", "signature", "documentation", "telling"])


def function_docs(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """node_id, name, signature, documentation, telling of each current function that has any documentation.

    The texts are searched where they are read; only comments before definitions and the functions
    are sorted by file, and a task holds one file's at a time. Functions with a docstring compete for the comments."""
    ship(nodes.sparkSession)
    columns = ("kind", "name", "signature", "docstring", "parameters", "repo_id", "file_path", "start_line")
    newest = F.max_by(F.struct(*columns, F.col("deleted_at").isNotNull().alias("deleted")), F.struct("ord", F.col("deleted_at").isNotNull()))
    live = (
        nodes.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("node_id"))
        .agg(newest.alias("v"))
        .select("node_id", "v.*")
        .where(~F.col("deleted") & F.col("kind").isin(*KINDS))
    )
    own = live.where(F.col("docstring").isNotNull()).select("node_id", "name", "signature", "docstring", "parameters").mapInArrow(_own, PAIRS)
    found = (
        sources.select("repo_id", plain_path(F.col("path")).alias("path"), "content")
        .where(F.col("content").isNotNull() & F.col("path").isNotNull())
        .mapInArrow(_scan, CANDIDATES)
        .distinct()
        .select("*", F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("array<string>").alias("params"), F.lit(None).cast("boolean").alias("own"))
    )
    functions = live.where(F.col("start_line").isNotNull()).select(
        "repo_id", plain_path(F.col("file_path")).alias("path"), F.col("start_line").alias("line"), F.lit(0).alias("gap"), "name", F.lit(None).cast("string").alias("text"), "node_id", "signature", F.col("parameters").alias("params"), F.col("docstring").isNotNull().alias("own")
    )
    paired = found.unionByName(functions).repartition("repo_id", "path").sortWithinPartitions("repo_id", "path", "line").mapInArrow(_pair, PAIRS)
    return own.unionByName(paired)
