"""Source trees as tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import LANGUAGES

# Directories that hold no sources.
SKIPPED = (".git", "dist", "build", "target")


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(names, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def relative(path: Column, base: str) -> Column:
    """Path below the base; paths outside keep their full form."""
    plain = F.regexp_replace(path, r"^file:/+", "/")
    base = "/" + base.split("://")[-1].strip("/") + "/" if not base.startswith("/") else base.rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(plain)


def eligible(path: Column, node_modules: bool = False) -> Column:
    """Files of a known language outside skipped directories, tests left out."""
    parts = F.split(path, "/")
    skip = [*SKIPPED, *(() if node_modules else ("node_modules",))]
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*skip))
    return language(path).isNotNull() & ~inside & ~F.contains(path, F.lit(".test."))


def scan(spark: SparkSession, roots: list[str], base: str | None = None, node_modules: bool = False, content: bool = True, paths: list[str] | None = None, excluded: Iterable[str] = ()) -> DataFrame:
    """(file_path, path, language, mtime_ns, size_bytes[, text]) of the sources below the roots, each file
    once; ``path`` is where Spark reads it.

    Without ``content`` only listings are read, with ``paths`` only those files. ``excluded``: small globs
    of files to leave out. Files that are not UTF-8 have no text and are left out.
    """
    base = base or roots[0]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots if paths is None else paths)
    path = relative(F.col("path"), base)
    for pattern in excluded:
        raw = raw.filter(~path.rlike(glob_regex(pattern)))
    rows = raw.withColumn("file_path", path).filter(eligible(F.col("file_path"), node_modules)).dropDuplicates(["file_path"]) if len(roots) > 1 else raw.withColumn("file_path", path).filter(eligible(F.col("file_path"), node_modules))
    stamp = (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")
    cols = ["file_path", "path", language(F.col("file_path")).alias("language"), stamp, F.col("length").alias("size_bytes")]
    if not content:
        return rows.select(*cols)
    return rows.filter(F.is_valid_utf8(F.col("content"))).select(*cols, F.col("content").cast("string").alias("text"))


def glob_regex(pattern: str) -> str:
    """Regular expression of a small glob: ** for any directories, * within one, a trailing / for a
    directory and all below."""
    p = pattern.replace("\\", "/")
    out = ""
    for k, part in enumerate(re.split(r"(\*\*/?|\*|\?)", p)):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)) if k % 2 else re.escape(part)
    return ("(^|/)" if not p.startswith(("/", "*")) else "^") + out + (".*" if p.endswith("/") else "(/.*)?$")


def only(files: DataFrame, paths: list[str]) -> DataFrame:
    """Some files, and all below some directories."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | (F.col("file_path") == p) | F.col("file_path").startswith(p.rstrip("/") + "/")
    return files.filter(hit)


class PathError(ValueError):
    """A path outside the workspace, or not a path at all."""


def normalise(path: str, base: str) -> str:
    """A path relative to the base: separators, '.' and '..' resolved, nothing outside let through."""
    if not path or "\0" in path:
        raise PathError(f"not a path: {path!r}")
    base = base.replace("\\", "/").rstrip("/")
    p = path.replace("\\", "/")
    if p.startswith("/") or (len(p) > 1 and p[1] == ":"):
        if p != base and not p.startswith(base + "/"):
            raise PathError(f"outside {base}: {path}")
        p = p[len(base) :].lstrip("/")
    out: list[str] = []
    for part in p.split("/"):
        if part == "..":
            if not out:
                raise PathError(f"outside {base}: {path}")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)
