"""The extractors as a table function: files in, tagged rows out, then one table per tag."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import constants as C
from codeweft import schemas
from codeweft.extract import generic, go, javascript, python
from codeweft.extract.emit import Emitted
from codeweft.session import ship

#: Language -> extractor; every other language is read by patterns, in the JVM. Add your own here before the first use of a
#: session.
EXTRACTORS: dict[str, Callable[[str, str, str], Emitted]] = {"python": python.extract, "javascript": javascript.extract, "typescript": javascript.extract, "go": go.extract}


def _ddl(fields: str) -> str:
    """`a int, b array<...>` as the inside of a struct."""
    out, depth, word = [], 0, ""
    for c in fields.replace("\n", " ") + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            word = ""
        else:
            word += c
    return ", ".join(out)


ROWS = (
    "repo_id string, file_path string, language string, ord int, tag string, "
    + ", ".join(f"{tag} struct<{_ddl(fields)}>" for tag, fields in (("node", schemas.NODE), ("call", schemas.CALL_EDGE), ("import", schemas.IMPORT_EDGE), ("inherit", schemas.INHERITANCE_EDGE)))
    + ", success boolean, errors array<string>"
)


def languages() -> list[str]:
    """The languages with an extractor of their own, sorted."""
    return sorted(EXTRACTORS)


def extractor(language: str | None) -> Callable[[str, str, str], Emitted] | None:
    """The extractor of a language, None where there is none."""
    return EXTRACTORS.get((language or "").lower())

#: What the extractors give back: `content` is set where a text is passed on to the patterns.
_READ = ROWS + ", content string"


def extract_file(text: str | None, path: str, repo: str, language: str | None) -> Emitted:
    """One file; a null text (it could not be read), a language without extractor or a failing extractor gives a failed
    result, never an exception."""
    if text is None:
        return Emitted(repo, path, language or "unknown", errors=["file could not be read"], success=False)
    run = extractor(language)
    if run is None:
        return Emitted(repo, path, language or "unknown", errors=[f"no extractor for {language or 'unknown'}"], success=False)
    try:
        return run(text, path, repo)
    except Exception as e:  # noqa: BLE001 - one file must not end the job
        return Emitted(repo, path, language or "unknown", errors=[f"extractor failed: {type(e).__name__}: {e}"], success=False)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _rows(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if r["content"] is not None and extractor(r["language"]) is None:
                said = generic.label(r["path"])
                rows.append({"repo_id": r["repo_id"], "file_path": r["path"], "language": said, "ord": 0, "tag": "text", "success": True, "errors": [said + generic.NOTE], "content": r["content"]})
                continue
            e = extract_file(r["content"], r["path"], r["repo_id"], r["language"])
            key = {"repo_id": r["repo_id"], "file_path": r["path"], "language": e.language}
            if e.by_patterns:
                rows.append(key | {"ord": 0, "tag": "text", "success": True, "errors": [e.by_patterns], "content": r["content"]})
                continue
            rows.append(key | {"ord": 0, "tag": "file", "success": e.success, "errors": e.errors})
            k = 0
            for tag, items in (("node", e.nodes), ("call", e.calls), ("import", e.imports), ("inherit", e.inherits)):
                for item in items:
                    k += 1
                    rows.append(key | {"ord": k, "tag": tag, tag: item})
            if len(rows) > 5_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def extract(files: DataFrame) -> DataFrame:
    """Tagged rows of `files` (repo_id, path, language, content): a row `file` each, then `node`, `call`, `import` and
    `inherit` rows. Read it through `stage` when more than one tag is wanted, so that texts are parsed once.

    Texts are read once: those without an extractor, or that theirs can't parse, are passed through for the patterns."""
    ship(files.sparkSession)
    wanted = files.where(F.col("path").isNotNull() & ~F.coalesce(F.col("language"), F.lit("")).isin(*C.UNPARSED_LANGUAGES)).select("repo_id", "path", "language", "content")
    read = wanted.mapInArrow(partial(_rows, _arrow(_READ)), _READ)
    columns = [c for c in read.columns if c != "content"]
    # In one pass: a text to be read by patterns becomes its rows, any other row stays one.
    read = generic.with_pattern_nodes(read, "file_path", "language", "tag = 'text'")
    kind = read.schema["node"].dataType.simpleString()
    several = F.expr(f"IF(tag = 'text', concat(array(CAST(NULL AS {kind})), transform(nodes, x -> CAST(x AS {kind}))), array(node))")
    spread = read.select(*[c for c in columns if c != "node"], F.posexplode(several).alias("pos", "node"))
    shown = {"ord": "IF(tag = 'text', pos, ord)", "tag": "CASE WHEN tag <> 'text' THEN tag WHEN pos = 0 THEN 'file' ELSE 'node' END", "success": "IF(pos = 0, success, NULL)", "errors": "IF(pos = 0, errors, NULL)"}
    return spread.selectExpr(*[f"{shown.get(c, c)} AS {c}" for c in columns])


def nodes(rows: DataFrame) -> DataFrame:
    """repo_id, ord and the columns of a node. `ord` orders the writes of a file; of nodes with one id the last holds."""
    return rows.where("tag = 'node'").select("repo_id", "ord", "node.*")


def edges(rows: DataFrame, tag: str) -> DataFrame:
    """repo_id, ord and the columns of `call`, `import` or `inherit` edges."""
    return rows.where(F.col("tag") == tag).select("repo_id", "ord", f"{tag}.*")


def results(rows: DataFrame) -> DataFrame:
    """repo_id, file_path, language, success, errors of each file."""
    return rows.where("tag = 'file'").select("repo_id", "file_path", "language", "success", "errors")


def last_writes(extracted: DataFrame) -> DataFrame:
    """Each id once: the node its file wrote last."""
    rest = [c for c in extracted.columns if c != "id"]
    return extracted.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("file_path", "ord")).alias("v")).select("id", "v.*")
