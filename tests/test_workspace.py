import os
import time

import pytest

from quarry.api import open_workspace
from quarry.sources.files import PathError

FILES = {
    "src/util.ts": """/** Adds numbers.
 * @param {number} x - one
 */
export function addNumbers(x: number, y: number): number { return x + y; }
// TODO: remove helper
function helper(a: Config) { return addNumbers(a.one, 2); }
export interface Config extends Base { one: number }
export interface Base { two: number }
""",
    "src/app.ts": """import { addNumbers } from "./util";
@Controller("/x")
export class AppService extends Base {
  run(c: Config) { return addNumbers(1, 2); }
}
export const app = new Elysia().get("/hi", hello).post("/bye", bye);
""",
    "src/geometry.rs": """pub struct Point { x: Coord }
impl Point {
    pub fn distance(&self, other: Point) -> f64 { self.norm() }
}
pub fn norm() -> f64 { 1.0 }
""",
    "tests/util_test.ts": "import { addNumbers } from '../src/util';\nfunction checkAdd() { return addNumbers(1, 1); }\n",
    "src/skip.test.ts": "export function never() {}\n",
    "node_modules/x/index.ts": "export function vendored() {}\n",
    "pkg/package.json": '{"name": "inner", "version": "1.2.3"}',
    "pkg/lib/core.py": "def core_thing():\n    return 1\n\ndef _private():\n    return core_thing()\n",
    "Cargo.toml": '[package]\nname = "outer"\nversion = "0.1.0"\n',
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    ws = open_workspace(spark, [str(root)])
    ws.store = ws.store.save(str(tmp_path_factory.mktemp("store")))
    return ws


def names(df, column="name"):
    return {r[column] for r in df.collect()}


def test_keyword_step_finds_parts_of_words(workspace):
    from quarry.search import _keyword

    ids = {r.id: r.name for r in workspace.store["symbols"].select("id", "name").collect()}
    hits = [ids[r.id] for r in _keyword(workspace.store, "elper", 5).orderBy("rank").collect()]
    assert "helper" in hits
    whole = [ids[r.id] for r in _keyword(workspace.store, "numbers", 50).orderBy("rank").collect()]
    assert "addNumbers" in whole


def test_symbols_and_stats(workspace):
    assert names(workspace.get_file_symbols("src/util.ts")) == {"addNumbers", "helper", "Config", "Base"}
    assert names(workspace.get_file_symbols("src/util.ts", exported_only=True)) == {"addNumbers", "Config", "Base"}
    stats = workspace.get_index_stats()
    assert stats["files"] == 5 and stats["symbols"] >= 13
    assert workspace.get_definition("never").count() == 0 and workspace.get_definition("vendored").count() == 0
    with pytest.raises(PathError):
        workspace.get_file_symbols("../outside.ts")


def test_edges_and_graph(workspace):
    assert "addNumbers" in names(workspace.get_call_hierarchy("helper"), "dst_name")
    assert {"helper", "run", "checkAdd"} <= names(workspace.get_call_hierarchy("addNumbers", "callers"), "src_name")
    assert names(workspace.get_type_graph("AppService"), "dst_name") == {"Base"}
    assert names(workspace.get_type_graph("Config"), "dst_name") == {"Base"}
    refs = workspace.find_references("addNumbers", reference_type="call")
    assert {"helper", "run"} <= names(refs)
    affected = workspace.find_affected_code("addNumbers")
    assert "checkAdd" not in names(affected) and "helper" in names(affected)
    assert "checkAdd" in names(workspace.find_affected_code("addNumbers", include_tests=True))
    assert workspace.trace_data_flow("helper").count() > 0
    assert workspace.explore_dependency_graph("addNumbers", "upstream").count() > 0
    kinds = {(r.src_name if "src_name" in r else None) for r in workspace.get_call_hierarchy("helper").collect()}
    assert kinds == {"helper"}
    resolutions = {r.resolution for r in workspace.store["edges"].select("resolution").distinct().collect()}
    assert "local" in resolutions and resolutions & {"package-import", "cross-package-import", "import"}


def test_search(workspace):
    top = workspace.search_code("addNumbers", 5)
    assert top.hits.orderBy("rank").first().name == "addNumbers" or "addNumbers" in names(top.hits)
    assert "addNumbers" in top.context and workspace.search_code("addNumbers", 5) is top
    assert names(workspace.search_code("who calls addNumbers", 10).hits) >= {"helper", "run"}
    only = workspace.search_code("lang:rust distance between points", 5)
    assert {r.language for r in only.hits.collect()} <= {"rust", "typescript", "python"} and "distance" in names(only.hits)
    some_id = workspace.get_definition("norm").first().id
    assert names(workspace.search_code(f"id:{some_id}").hits) == {"norm"}
    explained = workspace.explain_search("add numbers", 5)
    assert {"popularity_boost", "docstring_boost", "learning_boost", "package_boost", "score"} <= set(explained.columns)
    assert len(workspace.hydrate_symbols([some_id])) >= 1


def test_annotations(workspace):
    assert workspace.search_todos("remove").first().associated_symbol == "helper"
    assert workspace.search_decorators("Contr").first().decorator_type == "controller"
    routes = {(r.http_method, r.path) for r in workspace.search_framework_patterns(kind="route").collect()}
    assert routes == {("GET", "/hi"), ("POST", "/bye")}
    assert workspace.store["docstrings"].first().summary == "Adds numbers."
    assert "checkAdd" in names(workspace.find_tests_for_symbol("addNumbers")) or workspace.store["test_links"].count() == 1
    assert workspace.get_usage_examples("addNumbers").count() > 0
    assert {r["kind"]: r.n for r in workspace.summarize_file("src/util.ts").collect()}["interface"] == 2
    assert workspace.get_module_summary("src/util.ts").count() == 3


def test_similarity(workspace):
    hits = workspace.find_similar_code("addNumbers", threshold=0.1)
    assert "addNumbers" not in names(hits) and hits.count() > 0
    assert workspace.find_similar_code(code_snippet="return x + y", threshold=0.1).count() > 0
    assert workspace.get_similarity_cluster("addNumbers").count() >= 0


def test_packages(workspace):
    pk = {r.name: r.id for r in workspace.store["packages"].collect()}
    assert set(pk) == {"inner", "outer"}
    by = {r.name: r.package for r in workspace.store["symbol_packages"].join(workspace.store["symbols"], "id").collect()}
    assert by["core_thing"] == pk["inner"] and by["addNumbers"] == pk["outer"]


def test_feedback(workspace):
    """With default settings: the clock ages what was selected, and scores stay finite."""
    target = workspace.get_definition("helper").first().id
    workspace.report_selection(" Add numbers ", target, 0)
    workspace.report_selection("add numbers", target, 1, now=int(time.time()) + 10**6)  # a clock that runs ahead
    rows = workspace.explain_search("add numbers", 20).collect()
    boosted = {r.id: r.learning_boost for r in rows}
    assert 0 < boosted.get(target, 0) < 1 and all(r.score < 1e3 for r in rows)
    assert "affinity_boost" not in workspace.explain_search("add numbers", 20, verbose=False).columns


def test_listings_and_summaries(workspace):
    assert names(workspace.list_packages()) == {"inner", "outer"} and workspace.list_repositories().count() == 0
    assert names(workspace.similar_paths("src/utils.ts"), "file_path") >= {"src/util.ts"}
    kinds = {r.kind: r for r in workspace.summarize_file("src/util.ts").collect()}
    assert kinds["interface"].purpose == "mixed-exports | type-defs | functions" and len(kinds["function"].signatures) == 1
    assert len({r.kind: r for r in workspace.summarize_file("src/util.ts", verbose=True).collect()}["function"].signatures) == 2
    assert "**Purpose:** mixed-exports" in workspace.render_summary("src/util.ts")
    assert "No indexed symbols" in workspace.render_summary("none.ts")


def test_selections_arrive(workspace, tmp_path):
    import json

    target = workspace.get_definition("Config").first().id
    before = workspace.store["query_selections"].count()
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text(json.dumps({"query": " Settings ", "id": target, "position": k, "created_at": int(time.time())}) + "\n")
        workspace.follow_selections(str(folder), str(tmp_path / "check"))
    assert workspace.store["query_selections"].count() == before + 2
    assert workspace.store["query_selections"].filter("query = 'settings'").count() == 2
    assert "## Definitions" in workspace.show_definition("Config") and "interface Config" in workspace.show_definition("Config")


def test_refresh(workspace, spark):
    root = workspace.roots[0]
    os.remove(f"{root}/src/geometry.rs")
    with open(f"{root}/src/fresh.ts", "w") as f:
        f.write("export function freshOne() { return addNumbers(3, 4); }\n")
    with open(f"{root}/src/later.ts", "w") as f:
        f.write("export function laterOne() { return 1; }\n")
    with open(f"{root}/pkg/package.json", "w") as f:
        f.write('{"name": "renamed", "version": "2.0.0"}')
    time.sleep(0.01)
    before = {n: workspace.store[n].count() for n in ("query_selections", "embedding_cache")}
    done = workspace.refresh_index(["src/fresh.ts", "src/geometry.rs"])  # nothing else is looked at
    assert done == {"scanned": 1, "indexed": 1, "unchanged": 0, "deleted": 1}
    assert workspace.get_definition("freshOne").count() == 1 and workspace.get_definition("norm").count() == 0
    assert workspace.get_definition("laterOne").count() == 0 and workspace.get_definition("addNumbers").count() == 1
    assert workspace.store["query_selections"].count() == before["query_selections"] > 0
    assert workspace.store["search_runs"].count() > 0 and workspace.store["index_runs"].count() == 1
    assert names(workspace.list_packages()) == {"renamed", "outer"}
    assert workspace.store["embedding_cache"].count() == before["embedding_cache"] + 1  # only the new text was embedded
    done = workspace.refresh_index()
    assert done == {"scanned": 6, "indexed": 1, "unchanged": 5, "deleted": 0}
    assert "freshOne" in names(workspace.get_call_hierarchy("addNumbers", "callers"), "src_name")
    assert "laterOne" in names(workspace.search_code("laterOne", 5).hits)
    store = workspace.store
    assert store["vectors"].count() == store["vectors"].select("id").distinct().count() == store["symbols"].filter("kind <> 'file'").count()
    same = dict(store.tables)
    assert workspace.refresh_index()["indexed"] == 0
    assert all(workspace.store.tables[n] is same[n] for n in ("edges", "symbol_metrics", "postings"))  # nothing is derived again
    with pytest.raises(PathError):
        workspace.refresh_index(["../x.ts"])


def test_watch(workspace):
    with open(f"{workspace.roots[0]}/src/watched.ts", "w") as f:
        f.write("export function watchedOne() { return 1; }\n")
    done = workspace.watch(2, interval=0.05, least=0.0, sleep=lambda _: None)
    assert len(done) == 1 and workspace.get_definition("watchedOne").count() == 1


def test_repository_above_the_root(spark, tmp_path):
    from quarry.index import workspaces

    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "repo" / ".git" / "config").write_text('[remote "origin"]\n\turl = https://example.com/up.git\n')
    root = tmp_path / "repo" / "sub" / "tree"
    root.mkdir(parents=True)
    (root / "go.mod").write_text("module example.com/deep\n\ngo 1.2\n")
    packages, repositories = workspaces(spark, [str(root)])
    (repo,) = repositories.collect()
    assert repo.root_path == "" and repo.remote_url == "https://example.com/up.git"
    assert [(p.name, p.repository_id) for p in packages.collect()] == [("deep", repo.id)]


def test_embedder_of_the_caller(spark):
    from pyspark.sql import functions as F

    from quarry.index import Store, _searchable
    from quarry.plugins import Embedder

    own = Embedder("lengths", 2, lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)), lambda t: [float(len(t)), 1.0])
    ddl = "id string, name string, text string, file_path string"
    syms = spark.createDataFrame([("a", "n", "some text", "x.ts"), ("b", "m", "more", "y.ts")], ddl)
    got = Store(spark, _searchable(None, syms, None, own), own)
    assert {r.id: list(r.vector) for r in got["vectors"].collect()} == {"a": [11.0, 1.0], "b": [6.0, 1.0]}
    assert {r.model_name for r in got["embedding_cache"].collect()} == {"lengths"}
    more = spark.createDataFrame([("c", "n", "some text", "z.ts")], ddl)
    again = Store(spark, _searchable(got, more, syms.filter("id = 'b'").select("id"), own), own)
    assert {r.id for r in again["vectors"].collect()} == {"a", "c"} and again["embedding_cache"].count() == 2
    assert {r.doc for r in again["postings"].select("doc").distinct().collect()} == {"a", "c"}
