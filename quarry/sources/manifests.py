"""Package manifests and repositories of a source tree."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import longest_prefix
from .files import glob_regex, relative

# Manifest files and the kinds of package they describe.
MANIFESTS = {"package.json": "npm", "Cargo.toml": "cargo", "go.mod": "go", "pom.xml": "maven", "pyproject.toml": "python", "requirements.txt": "python"}
# Directories whose manifests are not the workspace's own.
VENDOR = "node_modules target .git dist build vendor .venv venv env .env __pycache__ .next .nuxt out .output .turbo .cache".split()


def discover(files: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """Manifests among files (file_path, text), outside vendor and hidden directories, in order."""
    parts = F.split("file_path", "/")
    folders = F.filter(parts, lambda p, i: i < F.size(parts) - 1)
    hit = files.filter(F.element_at(parts, -1).isin(*MANIFESTS) & ~F.exists(folders, lambda p: p.isin(*VENDOR) | p.startswith(".")))
    for e in excluded:
        hit = hit.filter(~F.col("file_path").rlike(glob_regex(e)))
    return hit.orderBy("file_path")


def parse(name: str, text: str) -> tuple[str | None, str | None]:
    """(name, version) that a manifest gives its package; nothing for what cannot be read."""
    try:
        if name == "package.json":
            d = json.loads(text)
            return d.get("name"), d.get("version")
        if name == "Cargo.toml":
            p = tomllib.loads(text).get("package", {})
            v = p.get("version")
            return p.get("name"), v if isinstance(v, str) else None
        if name == "pyproject.toml":
            d = tomllib.loads(text)
            p = d.get("project") or d.get("tool", {}).get("poetry", {})
            return p.get("name"), p.get("version")
        if name == "go.mod":
            module = re.search(r"(?m)^\s*module\s+\"?([^\s\"]+)", text)
            version = re.search(r"(?m)^\s*go\s+(\S+)", text)
            return (module[1].rpartition("/")[2] if module else None), (version[1] if version else None)
    except (ValueError, AttributeError):
        pass
    return None, None


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths = b.column("file_path").to_pylist()
        got = [parse(p.rpartition("/")[2], t or "") for p, t in zip(paths, b.column("text").to_pylist(), strict=True)]
        cols = [pa.array(paths, pa.string()), *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, names=["manifest_path", "name", "version"])


def packages(manifests: DataFrame) -> DataFrame:
    """(id, name, version, manifest_path, root, package_type): a row per manifest; root is its directory."""
    rows = manifests.select("file_path", "text").mapInArrow(_parse, "manifest_path string, name string, version string")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), F.element_at(F.split("manifest_path", "/"), -1))
    root = F.regexp_replace("manifest_path", r"/?[^/]*$", "")
    return rows.select(F.sha2("manifest_path", 256).alias("id"), "name", "version", "manifest_path", root.alias("root"), kind.alias("package_type"))


def repositories(configs: DataFrame) -> DataFrame:
    """(id, name, root_path, vcs_type, remote_url) of the .git/config files among files."""
    hit = configs.filter(F.col("file_path").rlike(r"(^|/)\.git/config$"))
    root = F.regexp_replace("file_path", r"/?\.git/config$", "")
    url = F.regexp_extract("text", r"\[remote \"origin\"\][^\[]*?url\s*=\s*(\S+)", 1)
    out = hit.select(root.alias("root_path"), F.when(url != "", url).alias("remote_url"))
    name = F.when(F.col("root_path") == "", "root").otherwise(F.element_at(F.split("root_path", "/"), -1))
    return out.select(F.sha2("root_path", 256).alias("id"), name.alias("name"), "root_path", F.lit("git").alias("vcs_type"), "remote_url").dropDuplicates(["id"])


def in_repositories(pkgs: DataFrame, repos: DataFrame) -> DataFrame:
    """Packages with the repository whose root is their longest prefix, or none."""
    out = longest_prefix(pkgs, repos, "manifest_path", "root_path")
    return out.withColumnRenamed("root_key", "repository_id").drop("root_path")


def of_files(files: DataFrame, pkgs: DataFrame) -> DataFrame:
    """(file_path, package): the innermost package of each file."""
    out = longest_prefix(files.select("file_path").distinct(), pkgs, "file_path", "root")
    return out.select("file_path", F.col("root_key").alias("package"))


def read(spark: SparkSession, roots: str | list[str], base: str | None = None) -> DataFrame:
    """All manifests and repository settings below roots, each once: (file_path, text)."""
    roots = [roots] if isinstance(roots, str) else roots
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).dropDuplicates(["path"])
    path = relative(F.col("path"), base or roots[0])
    name = F.element_at(F.split(path, "/"), -1)
    rows = raw.withColumn("file_path", path).filter(name.isin(*MANIFESTS) | F.col("file_path").endswith(".git/config"))
    return rows.filter(F.is_valid_utf8(F.col("content"))).select("file_path", F.col("content").cast("string").alias("text"))


def enclosing(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, text): settings of the repository that a root lies in, if it begins above the root."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own, at = jvm.org.apache.hadoop.fs.Path(path, ".git/config"), path.getParent()
    while at is not None and not fs.exists(own):  # one step a directory above the root
        config = jvm.org.apache.hadoop.fs.Path(at, ".git/config")
        if fs.exists(config):
            text = spark.read.text(config.toString(), wholetext=True)
            return text.select(F.lit(".git/config").alias("file_path"), F.col("value").alias("text"))
        at = at.getParent()
    return spark.createDataFrame([], "file_path string, text string")
