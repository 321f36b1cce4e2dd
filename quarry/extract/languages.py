"""Extractors by language: patterns over blanked code find the headers of definitions, brackets their ends.

Python is read through its own parser and falls back on indentation for files that do not parse.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from .docs import decorators, jsdocs, todos
from .frameworks import calls as framework_calls
from .model import Extracted, Import, Symbol
from .scan import Lines, blank, body_end, match, split_args, statement_end

_ID = r"[A-Za-z_$][\w$]*"
_BASIC = frozenset("string number boolean any void null undefined never unknown object this true false String Self self str u8 u16 u32 u64 i8 i16 i32 i64 f32 f64 usize isize bool char mut dyn impl ref fn".split())


def _add(out: Extracted, lines: Lines, base: int, name: str, kind: str, exported: bool, start: int, end: int) -> None:
    out.symbols.append(Symbol(name, kind, exported, lines.byte(start), lines.byte(end), lines.line(start) + base, lines.line(max(start, end - 1)) + base))


def _types(text: str) -> list[str]:
    return [t for t in dict.fromkeys(re.findall(_ID, text)) if t not in _BASIC and t[:1].isupper()]


# TypeScript and JavaScript.

_TS = re.compile(
    rf"(?m)^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    rf"(?:(?P<fn>function)\s*\*?\s*(?P<fname>{_ID})|(?P<cls>class)\s+(?!extends\b|implements\b)(?P<cname>{_ID})|(?P<iface>interface)\s+(?P<iname>{_ID})|(?P<type>type)\s+(?P<tname>{_ID})\s*(?:<[^=]*>)?\s*="
    rf"|(?:const\s+)?(?P<enum>enum)\s+(?P<ename>{_ID})|(?P<const>const|let|var)\s+(?P<vname>{_ID})\s*(?::[^=;]+)?=(?!=))"
)
_METHOD = re.compile(rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?P<name>#?{_ID})\s*(?:<[^>(]*>)?\((?=[^;]*\{{)")
_ARROW = re.compile(rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|readonly|override)\s+)*(?P<name>#?{_ID})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)\s*(?::[^=;]+?)?|{_ID}\s*)=>")
_NOT_METHODS = frozenset("if for while switch catch function return constructor super new await typeof".split())
_IMPORT = re.compile(r"(?m)^[ \t]*(?P<verb>import|export)\s+(?:type\s+)?(?P<what>[\w$*{}\s,]+?)\s*from\s*(?P<q>['\"])")


def typescript(source: str, script: bool = False) -> Extracted:
    """TypeScript, or JavaScript with ``script``: there const, let and var all define, and there are no
    types, documentation or data flow."""
    code, comments = blank(source, "typescript")
    lines, out, base = Lines(source), Extracted(), 0 if script else 1
    spans: list[tuple[int, int, str, str]] = []
    exported_later = {n.strip().split(" as ")[0].strip() for m in re.finditer(r"export\s*\{([^}]*)\}(?!\s*from)", code) for n in m[1].split(",")}
    for m in _TS.finditer(code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if m["const"]:
            if not script and m["const"] != "const":
                continue
            name, kind, end = m["vname"], "const", statement_end(code, m.end())
            if not m["export"] and re.match(r"[ \t]+", m[0]) and _depth(code, start):
                continue
        elif m["type"]:
            name, kind, end = m["tname"], "type_alias", statement_end(code, m.end())
        else:
            name = m["fname"] or m["cname"] or m["iname"] or m["ename"]
            kind = "function" if m["fn"] else "class" if m["cls"] else "interface" if m["iface"] else "enum"
            end = body_end(code, m.end())
        if script and kind not in ("function", "class", "const"):
            continue
        _add(out, lines, base, name, kind, bool(m["export"]) or name in exported_later, start, end)
        spans.append((start, end, name, kind))
        if not script:
            _ts_types(out, code[start:end], name, kind)
    for start, end, _, _ in [s for s in spans if s[3] == "class"]:
        opens = code.find("{", start)
        for m in _METHOD.finditer(code, opens + 1, end):
            if m["name"] in _NOT_METHODS or _depth(code, m.start(), opens + 1):
                continue
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            stop = body_end(code, match(code, m.end() - 1))
            _add(out, lines, base, m["name"], "function", False, at, stop)
            spans.append((at, stop, m["name"], "function"))
            if not script:
                _ts_types(out, code[at:stop], m["name"], "function")
        for m in _ARROW.finditer(code, opens + 1, end):  # members that hold functions
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if not _depth(code, at, opens + 1):
                stop = statement_end(code, m.end())
                _add(out, lines, base, m["name"], "function", False, at, stop)
                spans.append((at, stop, m["name"], "function"))
    _ts_imports(out, source, code)
    out.symbols.sort(key=lambda s: (s.start, -s.end))
    out.patterns = framework_calls(source, code, lines)
    if not script:
        _flows(out, code, lines, spans)
        names = sorted((s.start, s.name) for s in out.symbols)
        out.todos = todos(source, comments, lines, names)
        out.docs = jsdocs(source, comments, code, out.symbols, lines)
        out.decorators = decorators(source, code, out.symbols, lines)
    return out


def javascript(source: str) -> Extracted:
    return typescript(source, script=True)


def _depth(code: str, at: int, start: int = 0) -> int:
    part = code[start:at]
    return part.count("{") - part.count("}")


def _ts_types(out: Extracted, text: str, name: str, kind: str) -> None:
    """Types named in parameters, results, members and alias values."""
    if kind == "function":
        opens = text.find("(")
        if opens < 0:
            return
        close = match(text, opens)
        head = text[opens:close] + text[close : text.find("{", close) if "{" in text[close:] else len(text)]
        found = _types(" ".join(re.findall(r":\s*([^,)=;]+)", head)))
    elif kind == "interface":
        found = _types(" ".join(re.findall(r":\s*([^;,\n]+)", text)))
    elif kind == "type_alias":
        found = _types(text.partition("=")[2])
    else:
        return
    out.types += [(name, t) for t in found if t != name]


def _ts_imports(out: Extracted, source: str, code: str) -> None:
    for m in _IMPORT.finditer(code):
        stop = code.find(m["q"], m.end())
        path, what = source[m.end() : stop], m["what"].strip()
        named = re.search(r"\{([^}]*)\}", what)
        rest = re.sub(r"\{[^}]*\}", "", what)
        for item in (named[1].split(",") if named else []):
            name, _, alias = item.strip().removeprefix("type ").partition(" as ")
            if name.strip():
                out.imports.append(Import(name.strip(), path, alias.strip() or None))
        for item in filter(None, (x.strip() for x in rest.split(","))):
            if item.startswith("*"):
                alias = item.partition(" as ")[2].strip()
                out.imports.append(Import("*", path, alias or None))
            elif m["verb"] == "import":
                out.imports.append(Import(item, path, "default"))


def _flows(out: Extracted, code: str, lines: Lines, spans: list[tuple[int, int, str, str]]) -> None:
    """Names that functions write (left of an assignment, a constant's own name) and read (right of one,
    called, passed)."""
    for start, end, owner, kind in spans:
        if kind != "function":
            continue
        begin = code.find("{", start)
        text = code[begin:end] if begin >= 0 else ""
        for m in re.finditer(rf"(?:(?:const|let|var)\s+)?((?:{_ID}\.)*{_ID})\s*(?:[-+*/|&]?=)(?![=>])([^;\n]*)", text):
            line = lines.line(begin + m.start())
            out.flows.append((owner, m[1].rpartition(".")[2], "writes", line))
            out.flows += [(owner, x, "reads", line) for x in dict.fromkeys(re.findall(rf"(?<![\w$.'\"]){_ID}", m[2])) if x not in _WORDS]
        for m in re.finditer(rf"(?<![\w$.])({_ID})(?:\.{_ID})*\s*\(", text):
            if m[1] in _WORDS:
                continue
            line = lines.line(begin + m.start())
            out.flows.append((owner, m[1], "reads", line))
            inner = text[m.end() : match(text, m.end() - 1) - 1]
            out.flows += [(owner, x, "reads", line) for x in dict.fromkeys(re.findall(rf"(?<![\w$.'\"]){_ID}", inner)) if x not in _WORDS]
    out.flows = list(dict.fromkeys(out.flows))


_WORDS = frozenset("if for while switch catch function return new await typeof const let var class else of in this true false null undefined async instanceof throw case break continue do try finally delete void yield".split())


# Rust.

_RS = re.compile(
    rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?P<pub>pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*(?:(?P<kind>fn|struct|enum|trait|mod)\s+(?P<name>{_ID})|(?P<impl>impl)\b(?P<head>[^{{;]*))"
)
_RS_KIND = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module"}


def rust(source: str) -> Extracted:
    code, _ = blank(source, "rust")
    lines, out = Lines(source), Extracted()
    for m in _RS.finditer(code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = body_end(code, m.end())
        if m["impl"]:
            head = re.sub(r"^<[^>]*>", "", m["head"].strip()).partition(" where ")[0].strip()
            _add(out, lines, 1, f"impl {head}", "impl", False, start, end)
            continue
        _add(out, lines, 1, m["name"], _RS_KIND[m["kind"]], bool(m["pub"]), start, end)
        text = code[m.end() : end]
        if m["kind"] == "fn":
            head = text.partition("{")[0]
            out.types += [(m["name"], t) for t in _types(" ".join(re.findall(r"(?::|->)\s*([^,{;]+)", head)))]
        elif m["kind"] == "struct":
            out.types += [(m["name"], t) for t in _types(" ".join(re.findall(r":\s*([^\n]+)", text)) or text)]
    return out


# Go.

_GO = re.compile(rf"(?m)^(?:func\s+(?:(?P<recv>\([^)]*\))\s*)?(?P<fn>{_ID})|type\s+(?P<type>{_ID})\s+(?:\[[^\]]*\]\s*)?(?P<what>struct|interface|[^\s({{]+))")


_GO_TYPE = re.compile(rf"(?:(?<=\()|^|;)[ \t]*(?P<type>{_ID})[ \t]+(?:\[[^\]]*\][ \t]*)?(?:=[ \t]*)?(?P<what>struct\b|interface\b|[^\s({{]+)", re.M)


def _open(code: str, start: int, at: int, pair: str) -> bool:
    """Whether a bracket that opens after ``start`` is still open at a place."""
    part = code[start:at]
    return part.count(pair[0]) > part.count(pair[1])


def go(source: str) -> Extracted:
    code, _ = blank(source, "go")
    lines, out = Lines(source), Extracted()
    for m in _GO.finditer(code):
        name = m["fn"] or m["type"]
        if m["fn"]:
            kind, end = "function", body_end(code, m.end())
        else:
            kind = {"struct": "struct", "interface": "interface"}.get(m["what"], "type_alias")
            end = body_end(code, m.end()) if kind != "type_alias" else statement_end(code, m.end())
        _add(out, lines, 0, name, kind, name[:1].isupper(), m.start(), end)
    for group in re.finditer(r"(?m)^type\s*\(", code):  # several types in one declaration
        opens, close = group.end(), match(code, group.end() - 1)
        for m in _GO_TYPE.finditer(code, opens, close):
            if any(_open(code, opens, m.start("type"), pair) for pair in ("{}", "()")):
                continue
            kind = m["what"] if m["what"] in ("struct", "interface") else "type_alias"
            end = body_end(code, m.end()) if kind != "type_alias" else statement_end(code, m.end())
            _add(out, lines, 0, m["type"], kind, m["type"][:1].isupper(), m.start("type"), min(end, close))
    out.symbols.sort(key=lambda s: (s.start, -s.end))
    for m in re.finditer(r"(?m)^import\s*(?:\((?P<many>[^)]*)\)|(?P<alias>[\w.]+\s+)?\")", code):
        text = source[m.start("many") : m.end("many")] if m["many"] is not None else source[m.start() : source.find("\n", m.start()) if "\n" in source[m.start() :] else len(source)].removeprefix("import")
        for a, path in re.findall(r"(?m)^\s*([\w.]+\s+)?\"([^\"]+)\"", text):
            out.imports.append(Import(path.rpartition("/")[2], path, a.strip() or None))
    return out


# Java.

_JAVA = re.compile(
    rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?P<mods>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|strictfp)\s+)*)(?:(?P<kind>class|interface|enum|record)\s+(?P<name>{_ID})|(?:<[^>]+>\s*)?(?P<ret>[\w$.<>\[\],?&]+)\s+(?P<method>{_ID})\s*\((?=[^;{{}}]*\)[^;{{}}]*[{{;]))"
)


def java(source: str) -> Extracted:
    code, _ = blank(source, "java")
    lines, out = Lines(source), Extracted()
    for m in _JAVA.finditer(code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        public = "public" in m["mods"].split()
        if m["kind"]:
            kind = {"record": "class"}.get(m["kind"], m["kind"])
            _add(out, lines, 0, m["name"], kind, public, start, body_end(code, m.end()))
        elif m["ret"] not in ("return", "new", "else", "throw", "case") and m["method"] not in _WORDS:
            _add(out, lines, 0, m["method"], "function", public, start, body_end(code, match(code, m.end() - 1)))
    for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code):
        out.imports.append(Import(m[1].rpartition(".")[2], m[1]))
    return out


# C and C++.

_C_TYPE = re.compile(rf"(?m)^[ \t]*(?:typedef\s+)?(?P<kind>struct|enum(?:\s+class)?|class|namespace|union)\s+(?P<name>(?:{_ID}::)*{_ID})\s*(?:final\s*)?(?::[^;{{]*)?\{{")
_C_FN = re.compile(rf"(?m)^[ \t]*(?:template\s*<[^>]*>\s*)?(?P<ret>(?:[\w:<>,*&~]+[ \t\n*&]+)+?|)(?P<name>(?:{_ID}(?:<[^>]*>)?::)*~?{_ID})\s*\((?=[^;{{}}]*\)[^;{{}}()]*(?:\([^)]*\)[^;{{}}]*)?\{{)")
_TYPEDEF = re.compile(rf"(?m)^[ \t]*typedef\b[^;{{]*?\b(?P<name>{_ID})\s*;")
_USING = re.compile(rf"(?m)^[ \t]*using\s+(?P<name>{_ID})\s*=")


def c(source: str, plus: bool = False) -> Extracted:
    """C, or C++ with ``plus``; everything is visible."""
    code, _ = blank(source, "c")
    lines, out, seen = Lines(source), Extracted(), set()
    kinds = {"struct": "struct", "union": "struct", "enum": "enum", "class": "class", "namespace": "module"}
    for m in _C_TYPE.finditer(code):
        kind = m["kind"].split()[0]
        if not plus and kind in ("class", "namespace"):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        _add(out, lines, 0, m["name"], kinds[kind], True, start, match(code, m.end() - 1))
        if m[0].lstrip().startswith("typedef"):
            end = match(code, m.end() - 1)
            alias = re.match(rf"\s*({_ID})\s*;", code[end:])
            if alias:
                _add(out, lines, 0, alias[1], "type_alias", True, start, end + alias.end())
    for m in _C_FN.finditer(code):
        name = m["name"]
        if name in _WORDS or name in ("sizeof", "defined") or m["ret"].split()[:1] in (["return"], ["else"], ["new"]) or (not m["ret"].strip() and not plus):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if start not in seen and (plus or not _depth(code, start)):
            seen.add(start)
            _add(out, lines, 0, name, "function", True, start, body_end(code, match(code, m.end() - 1)))
    for m in re.finditer(r"(?m)^[ \t]*typedef\s+(struct|union|enum)\s*\{", code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = match(code, m.end() - 1)
        alias = re.match(rf"\s*({_ID})\s*;", code[end:])
        if alias:
            _add(out, lines, 0, alias[1], "type_alias", True, start, end + alias.end())
    for pattern in (_TYPEDEF, *((_USING,) if plus else ())):
        for m in pattern.finditer(code):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            _add(out, lines, 0, m["name"], "type_alias", True, start, statement_end(code, m.start("name")))
    for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"\n]+)[>\"]", source):
        out.imports.append(Import(m[2].rpartition("/")[2], m[2]))
    out.symbols.sort(key=lambda s: (s.start, -s.end))
    return out


def cpp(source: str) -> Extracted:
    return c(source, plus=True)


# Python.


def python(source: str) -> Extracted:
    lines, out = Lines(source), Extracted()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return _python_by_indent(source, lines)
    rows = source.split("\n")

    def at(line: int, col: int) -> int:
        return lines.starts[line - 1] + len(rows[line - 1].encode()[:col].decode(errors="ignore"))

    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            _add(out, lines, 0, node.name, kind, not node.name.startswith("_"), at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset))
        elif isinstance(node, ast.Import):
            out.imports += [Import(a.name, a.name, a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            source_ = "." * node.level + (node.module or "")
            out.imports += [Import(a.name, source_, a.asname) for a in node.names]
    out.symbols.sort(key=lambda s: (s.start, -s.end))
    return out


def _python_by_indent(source: str, lines: Lines) -> Extracted:
    out = Extracted()
    for m in re.finditer(r"(?m)^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", source):
        start, end = m.start(2) if "async" not in m[0] else m.start() + len(m[1]), len(source)
        for k in range(lines.line(m.start()) + 1, len(lines.starts)):
            row = source[lines.starts[k] :].partition("\n")[0]
            if row.strip() and len(row) - len(row.lstrip()) <= len(m[1]):
                end = lines.starts[k] - 1
                break
        _add(out, lines, 0, m[3], "class" if m[2] == "class" else "function", not m[3].startswith("_"), start, len(source[:end].rstrip()))
    for m in re.finditer(r"(?m)^\s*import\s+(.+)$", source):
        out.imports += [Import(n.strip(), n.strip(), a.strip() or None) for n, _, a in (x.partition(" as ") for x in m[1].split(","))]
    for m in re.finditer(r"(?m)^\s*from\s+(\S+)\s+import\s+\(?([^)\n]+)", source):
        out.imports += [Import(n.strip(), m[1], a.strip() or None) for n, _, a in (x.partition(" as ") for x in m[2].split(",")) if n.strip()]
    return out


EXTRACTORS: dict[str, Callable[[str], Extracted]] = {"typescript": typescript, "javascript": javascript, "rust": rust, "python": python, "go": go, "java": java, "c": c, "cpp": cpp}


def extract(source: str, language: str) -> Extracted:
    """What a file holds; a language without an extractor gives nothing."""
    f = EXTRACTORS.get(language)
    return f(source) if f else Extracted()


__all__ = ["EXTRACTORS", "extract", "split_args"]
