"""Extraction as tables: one pass over files in Arrow batches, sections of one nested row per file."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import symbol_id
from ..operators.relational import first_per
from .languages import extract

#: Names of the tables' columns.
SCHEMA = (
    "file_path string, language string, "
    "symbols array<struct<id string, name string, kind string, exported boolean, start_byte int, end_byte int, start_line int, end_line int, text string>>, "
    "imports array<struct<name string, source string, alias string, seq int>>, types array<struct<parent string, type string>>, "
    "flows array<struct<owner string, target string, flow string, line int>>, todos array<struct<kind string, text string, line int, symbol string>>, "
    "docs array<struct<id string, raw_text string, summary string, params_json string, returns_text string, examples_json string>>, "
    "decorators array<struct<id string, name string, arguments string, line int, type string>>, "
    "patterns array<struct<line int, column int, framework string, kind string, http_method string, path string, name string, handler string, arguments string, parent_chain string>>"
)


def row(path: str, language: str, text: str) -> dict:
    """Everything of one file; the file itself is a symbol, blank symbols are not."""
    e, raw = extract(text, language), text.encode()
    own = {"id": symbol_id(path, "FILE_ROOT", 0), "name": path, "kind": "file", "exported": True, "start_byte": 0, "end_byte": len(raw), "start_line": 1, "end_line": text.count("\n") + 1, "text": text}
    syms, by_start = [own], {}
    for s in e.symbols:
        body = raw[s.start : s.end].decode(errors="replace")
        if body.strip():
            i = symbol_id(path, s.name, 0 if s.exported else s.start)
            syms.append({"id": i, "name": s.name, "kind": s.kind, "exported": s.exported, "start_byte": s.start, "end_byte": s.end, "start_line": s.start_line, "end_line": s.end_line, "text": body})
            by_start[s.start] = i
    return {
        "file_path": path, "language": language, "symbols": syms,
        "imports": [{"name": i.name, "source": i.source, "alias": i.alias, "seq": k} for k, i in enumerate(e.imports)],
        "types": [{"parent": p, "type": t} for p, t in e.types],
        "flows": [{"owner": o, "target": t, "flow": f, "line": n} for o, t, f, n in e.flows],
        "todos": [{"kind": k, "text": t, "line": n, "symbol": s} for k, t, n, s in e.todos],
        "docs": [{"id": by_start.get(d["start"]), "raw_text": d["raw_text"], "summary": d["summary"], "params_json": d["params_json"], "returns_text": d["returns"], "examples_json": json.dumps(d["examples"])} for d in e.docs],
        "decorators": [{"id": by_start.get(s), "name": n, "arguments": a, "line": line, "type": t} for s, n, a, line, t in e.decorators],
        "patterns": e.patterns,
    }


def _run(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = [row(p, lang, t) for p, lang, t in zip(*(part.column(c).to_pylist() for c in ("file_path", "language", "text")), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def extract_files(files: DataFrame) -> DataFrame:
    """Nested rows of files (file_path, language, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    return files.select("file_path", "language", "text").mapInArrow(_run(schema), SCHEMA)


def tables(nested: DataFrame) -> dict[str, DataFrame]:
    """One table per section of nested rows."""
    part = lambda c, *more: nested.select("file_path", *more, F.inline(c))
    symbols = part("symbols", "language")
    todo = part("todos").withColumnRenamed("symbol", "associated_symbol")
    found = part("patterns")
    place = F.concat_ws(":", "file_path", "line", "column", F.monotonically_increasing_id())
    return {
        "symbols": first_per(symbols, ["id"], [F.desc("start_byte"), F.desc("end_byte")], 1),  # of one id the last
        "imports": part("imports"),
        "types": part("types"),
        "flows": part("flows"),
        "todos": todo.select(F.concat_ws(":", "file_path", "line").alias("id"), "kind", "text", "file_path", "line", "associated_symbol").dropDuplicates(["id"]),
        "docstrings": part("docs").filter("id IS NOT NULL").dropDuplicates(["id"]),
        "decorators": part("decorators").filter("id IS NOT NULL").select("file_path", "id", "name", "arguments", F.col("line").alias("target_line"), F.col("type").alias("decorator_type")).dropDuplicates(["id", "name"]),
        "framework_patterns": found.withColumn("id", place).drop("column"),
    }
