"""Comments and decorators: open tasks, documentation blocks, framework decorators."""

from __future__ import annotations

import json
import re

from .model import Symbol
from .scan import Lines, match

# Decorators by the type they have.
_DECORATORS = {
    "component": "Component Input Output HostListener HostBinding",
    "injectable": "Injectable Inject Optional Self",
    "module": "NgModule Module",
    "directive": "Directive Pipe",
    "controller": "Controller",
    "get": "Get Post Put Delete Patch Options Head All",
    "param": "Param Body Query Headers Session Ip Req Res",
}
DECORATORS = {n: kind for kind, names in _DECORATORS.items() for n in names.split()}


def todos(source: str, comments: list[tuple[int, int]], lines: Lines, names: list[tuple[int, str]]) -> list[tuple[str, str, int, str | None]]:
    """(kind, text, line, symbol defined next) of TODO and FIXME comments."""
    out = []
    for a, b in comments:
        for m in re.finditer(r"(?im)\b(todo|fixme)[:\s]\s*(.*?)\s*(?:\*/)?$", source[a:b]):
            at = lines.byte(b)
            out.append((m[1].lower(), m[2], lines.line(a + m.start()), next((n for s, n in names if s >= at), None)))
    return out


def jsdocs(source: str, comments: list[tuple[int, int]], code: str, symbols: list[Symbol], lines: Lines) -> list[dict]:
    """Documentation blocks, each of the symbol that begins right after it."""
    starts = {s.start: s for s in reversed(symbols)}
    out = []
    for a, b in comments:
        raw = source[a:b]
        if not raw.startswith("/**"):
            continue
        at = b + len(code[b:]) - len(code[b:].lstrip())
        while code[at : at + 1] == "@":  # decorators may stand between
            m = re.compile(r"@[\w.$]+\s*").match(code, at)
            at = match(code, m.end()) if m and code[m.end() : m.end() + 1] == "(" else m.end() if m else len(code)
            at += len(code[at:]) - len(code[at:].lstrip())
        s = starts.get(lines.byte(at))
        if s is not None:
            out.append({"symbol": s.name, "start": s.start, **parse_doc(raw)})
    return out


def parse_doc(raw: str) -> dict:
    """Summary and tags of a documentation block; the last example counts."""
    text = "\n".join(re.sub(r"^\s*\*? ?", "", row) for row in raw.removeprefix("/**").removesuffix("*/").split("\n"))
    head, *tags = re.split(r"(?m)^\s*@(?=\w)", text)
    out: dict = {"raw_text": raw, "summary": " ".join(head.split()) or None, "params": [], "returns": None, "examples": [], "deprecated": None, "throws": [], "see": [], "since": None}
    for t in tags:
        name, _, rest = t.strip().partition(" ") if " " in t.strip().split("\n")[0] else (t.strip().split("\n")[0], "", "\n".join(t.strip().split("\n")[1:]))
        rest = rest.strip()
        if name in ("param", "arg", "argument"):
            m = re.match(r"(?:\{([^}]*)\}\s*)?(\[?[\w.$=\"' ]*?\]?)(?:\s+-?\s*(.*))?$", " ".join(rest.split()))
            out["params"].append({"type": m[1], "name": m[2].strip("[]").split("=")[0], "description": m[3] or ""} if m else {"type": None, "name": rest, "description": ""})
        elif name in ("returns", "return"):
            out["returns"] = rest
        elif name == "example":
            out["examples"] = [rest]
        elif name == "deprecated":
            out["deprecated"] = rest or "yes"
        elif name in ("throws", "exception"):
            out["throws"].append(rest)
        elif name == "see":
            out["see"].append(rest)
        elif name == "since":
            out["since"] = rest
    out["params_json"], out["examples_json"] = json.dumps(out["params"]), json.dumps(out["examples"])
    return out


def decorators(source: str, code: str, symbols: list[Symbol], lines: Lines) -> list[tuple[int, str, str | None, int, str]]:
    """(start of the symbol, name, arguments, line, type) of decorators before classes and functions."""
    starts = {s.start: s for s in reversed(symbols) if s.kind in ("class", "function")}
    out, held = [], []
    for m in re.finditer(r"@([A-Za-z_$][\w.$]*)", code):
        end = m.end()
        args = None
        if code[end : end + 1] == "(":
            stop = match(code, end)
            args = source[end:stop].strip()
            end = stop
        held.append((m[1], args if args != "()" else None))
        at = end + len(code[end:]) - len(code[end:].lstrip())
        if code[at : at + 1] == "@":
            continue
        s = starts.get(lines.byte(at))
        if s is not None:
            out += [(s.start, n, a, s.start_line - 1, DECORATORS.get(n.rpartition(".")[2], "unknown")) for n, a in held]
        held = []
    return out
