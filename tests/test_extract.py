import pytest

from quarry.extract.docs import parse_doc
from quarry.extract.languages import EXTRACTORS, extract
from quarry.extract.run import row
from quarry.sources.files import PathError, normalise
from quarry.sources.manifests import glob_regex, parse

TS = """import { a, b as c } from "./mod";
import D, * as E from "lib";
export { x as y } from './other';
/** Adds. */
export async function add(x: number, y: Foo<Bar>): Promise<Baz> { const z = x + y; return helper(z); }
// TODO: fix this
@Component({selector: "x"})
export class K extends Base implements I {
  @Get("/p")
  run(q: Query) { this.y = q; return add(1, 2); }
}
interface I { f: Foo }
export type T1 = Foo | string;
enum Z { A }
const local = "function notThis() {}";
export const app = new Elysia().get("/hi", hello).use(cors()).state('n', 1).ws("/w", () => 1).listen(3000);
"""


def found(source, language):
    return {(s.name, s.kind, s.exported) for s in extract(source, language).symbols}


def test_typescript():
    e = extract(TS, "typescript")
    assert found(TS, "typescript") == {
        ("add", "function", True), ("K", "class", True), ("run", "function", False), ("I", "interface", False), ("T1", "type_alias", True), ("Z", "enum", False), ("local", "const", False), ("app", "const", True),
    }
    assert {(i.name, i.source, i.alias) for i in e.imports} == {("a", "./mod", None), ("b", "./mod", "c"), ("D", "lib", "default"), ("*", "lib", "E"), ("x", "./other", "y")}
    assert {("add", "Foo"), ("add", "Bar"), ("add", "Baz"), ("run", "Query"), ("T1", "Foo")} <= set(e.types)
    assert {("add", "z", "writes"), ("add", "helper", "reads"), ("run", "y", "writes"), ("run", "add", "reads")} <= {f[:3] for f in e.flows}
    assert [(t[0], t[1], t[3]) for t in e.todos] == [("todo", "fix this", "K")]
    at = {s.start: s.name for s in e.symbols}
    assert [(at[d[0]], d[1], d[4]) for d in e.decorators] == [("K", "Component", "component"), ("run", "Get", "get")]
    assert [d["symbol"] for d in e.docs] == ["add"]
    assert [(p["kind"], p["http_method"], p["path"], p["name"], p["handler"], p["parent_chain"]) for p in e.patterns] == [
        ("route", "GET", "/hi", None, "hello", "Elysia"), ("plugin", None, None, "cors", None, "Elysia"), ("state", None, None, "n", None, "Elysia"),
        ("websocket", None, "/w", None, "<anonymous>", "Elysia"), ("listen", None, None, "3000", None, "Elysia"),
    ]
    for s in e.symbols:
        assert TS.encode()[s.start : s.end].decode().strip()


def test_other_languages():
    assert found("pub struct A { x: Foo }\nimpl<T> Tr for A<T> {\n  pub fn f<'a>(&'a self) -> Baz { '{'; }\n}\nfn g() {}\npub mod m;\ntrait Q {}\nenum E { B }\n", "rust") == {
        ("A", "struct", True), ("impl Tr for A<T>", "impl", False), ("f", "function", True), ("g", "function", False), ("m", "module", True), ("Q", "trait", False), ("E", "enum", False),
    }
    assert found("import os\nclass A:\n    def _x(self): pass\nasync def y(): ...\n", "python") == {("A", "class", True), ("_x", "function", False), ("y", "function", True)}
    assert found("def a(:\n  x\ndef b():\n  pass\n", "python") == {("a", "function", True), ("b", "function", True)}
    assert found('package p\nimport "fmt"\nfunc (r *R) Foo(a int) string {\n}\ntype S struct {\n}\ntype i interface{}\ntype A = B\n', "go") == {
        ("Foo", "function", True), ("S", "struct", True), ("i", "interface", False), ("A", "type_alias", True),
    }
    assert found("import a.B;\npublic class X {\n  public int f(int a) { return g(a); }\n  void h() {}\n}\nenum Q { A }\ninterface I { int z(); }", "java") == {
        ("X", "class", True), ("f", "function", True), ("h", "function", False), ("Q", "enum", False), ("I", "interface", False), ("z", "function", False),
    }
    assert {n for n, *_ in found("#include <stdio.h>\ntypedef struct { int a; } P;\nstruct S { int x; };\nint main(int c, char **v) { if (c) { f(); } return 0; }\ntypedef int I;\nenum E { A };", "c")} == {"P", "S", "main", "I", "E"}
    assert {n for n, *_ in found("namespace n {\nclass K : public B { public: void m() { } };\nvoid K::q(int a) const { }\ntemplate <class T> T mx(T a) { return a; }\nusing V = int;\n}", "cpp")} >= {"n", "K", "K::q", "mx", "V"}
    assert found("export const a = 1;\nlet b = () => {};\nfunction f(){}\nclass Q { m() { return 1 } }\n", "javascript") == {("a", "const", True), ("b", "const", False), ("f", "function", False), ("Q", "class", False), ("m", "function", False)}


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
@pytest.mark.parametrize("source", ["", "{", "}}}}", "((((", '"open', "/* open", "export class", "fn", "é" * 50, "@", "import {", "\0"])
def test_anything_reads(language, source):
    extract(source, language)
    assert row("p", language, source)["symbols"][0]["kind"] == "file"


def test_docs():
    d = parse_doc("/** Sums\n * up.\n * @param {number} a - first one\n * @param b\n * @returns the sum\n * @example\n * f(1)\n * @deprecated\n * @throws Error\n */")
    assert d["summary"] == "Sums up." and d["params"] == [{"type": "number", "name": "a", "description": "first one"}, {"type": None, "name": "b", "description": ""}]
    assert d["returns"] == "the sum" and d["examples"] == ["f(1)"] and d["deprecated"] == "yes" and d["throws"] == ["Error"]


def test_manifests():
    assert parse("package.json", '{"name": "x", "version": "1"}') == ("x", "1") and parse("package.json", "{") == (None, None)
    assert parse("Cargo.toml", '[package]\nname = "c"\nversion.workspace = true') == ("c", None)
    assert parse("pyproject.toml", '[tool.poetry]\nname = "p"\nversion = "2"') == ("p", "2") and parse("pyproject.toml", '[project]\nname = "q"') == ("q", None)
    assert parse("go.mod", "module example.com/a/b\n\ngo 1.22\n") == ("b", "1.22") and parse("pom.xml", "<x/>") == (None, None)
    import re

    assert re.search(glob_regex("**/gen/*"), "a/gen/x.ts") and re.search(glob_regex("docs/"), "docs/a/b") and not re.search(glob_regex("*.min.js"), "a/b.js")


def test_paths():
    assert normalise("a/./b/../c.ts", "/w") == "a/c.ts" and normalise("/w/x.ts", "/w") == "x.ts" and normalise("a\\b", "/w") == "a/b"
    for bad in ("", "../x", "/other/x", "a/../../x", "a\0b", "/wx/y"):
        with pytest.raises(PathError):
            normalise(bad, "/w")


def test_decorators_go_to_their_own_symbol():
    from quarry.extract.run import row

    text = "export class A {\n  @Post('/a')\n  run() { return 1 }\n}\nexport class B {\n  @Pipe()\n  run() { return 2 }\n}\n"
    got = row("x.ts", "typescript", text)
    at = {s["id"]: s["start_line"] for s in got["symbols"]}
    runs = sorted(s["start_line"] for s in got["symbols"] if s["name"] == "run")
    assert sorted((at[d["id"]], d["name"], d["type"]) for d in got["decorators"]) == [(runs[0], "Post", "get"), (runs[1], "Pipe", "directive")]


def test_grouped_anonymous_and_nested():
    assert found("package x\ntype (\n\tA struct {\n\t\tB int\n\t}\n\tc = string\n\tD interface{ M(x int) }\n)\ntype E struct{}\n", "go") == {
        ("A", "struct", True), ("c", "type_alias", False), ("D", "interface", True), ("E", "struct", True),
    }
    assert found("export default class extends X { a() { return 1 } }\n", "typescript") == set()
    members = "class Y {\n  go = async (x: number): Promise<void> => { x }\n  private n = 3;\n  run(): void { }\n}\n"
    assert found(members, "typescript") == {("Y", "class", False), ("go", "function", False), ("run", "function", False)}
    assert found('/* a /* b */ fn hidden() {} */\nfn seen() { let s = "/*"; }\nfn also() {}\n', "rust") == {("seen", "function", False), ("also", "function", False)}


def test_last_symbol_of_an_id_wins(spark):
    from quarry.extract.run import extract_files, tables

    text = "class A:\n    def run(self):\n        return 1\n\nclass B:\n    def run(self):\n        return 2\n"
    files = spark.createDataFrame([("a.py", "python", text)], "file_path string, language string, text string")
    (got,) = tables(extract_files(files))["symbols"].filter("name = 'run'").collect()
    assert "return 2" in got.text
