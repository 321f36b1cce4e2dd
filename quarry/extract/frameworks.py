"""Routes, plugins and the like from member calls of server frameworks."""

from __future__ import annotations

import re

from .scan import Lines, match, split_args

# Methods that define routes, and what other methods define.
ROUTES = ("get", "post", "put", "delete", "patch", "options", "head", "all")
OTHERS = {
    "ws": "websocket", "macro": "macro", "use": "plugin", "state": "state", "decorate": "decorate", "derive": "derive", "resolve": "resolve", "guard": "guard", "group": "group", "listen": "listen",
}
_CALL = re.compile(r"\.\s*([A-Za-z]+)\s*\(")


def _string(text: str) -> str | None:
    t = text.strip()
    return t[1:-1] if len(t) > 1 and t[0] in "'\"`" and t[-1] == t[0] else None


def _handler(text: str) -> str | None:
    t = text.strip()
    if re.fullmatch(r"[A-Za-z_$][\w$]*", t):
        return t
    if re.match(r"(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", t):
        return "<anonymous>"
    m = re.match(r"([A-Za-z_$][\w$.]*)\s*\(", t)
    return m[1] if m else None


def chain_root(code: str, dot: int) -> str | None:
    """The variable, or the class of a new object, that a chain of member calls begins with."""
    at = dot
    while True:
        before = code[:at].rstrip()
        if before.endswith(")"):
            depth, k = 0, len(before) - 1
            while k >= 0:
                depth += (before[k] == ")") - (before[k] == "(")
                if not depth:
                    break
                k -= 1
            at = max(k, 0)
            if at == 0:
                return None
            continue
        m = re.search(r"(new\s+)?([A-Za-z_$][\w$]*)\Z", before)
        if not m:
            return None
        head = before[: m.start()].rstrip()
        if head.endswith("."):
            at = len(head) - 1
            continue
        return m[2]


def calls(source: str, code: str, lines: Lines, framework: str = "elysia") -> list[dict]:
    """Patterns in order of line and column: kind, method, path, name, handler, arguments, chain root."""
    out = []
    for m in _CALL.finditer(code):
        method = m[1].lower()
        kind = "route" if method in ROUTES else OTHERS.get(method)
        if kind is None:
            continue
        end = match(code, m.end() - 1)
        spans = [(m.end() + a, m.end() + b) for a, b in split_args(code[m.end() : end - 1])]
        args = [source[a:b].strip() for a, b in spans]
        first = args[0] if args else None
        row = {"line": lines.line(m.start()) + 1, "column": m.start(1) - lines.starts[lines.line(m.start(1))], "framework": framework, "kind": kind, "http_method": method.upper() if kind == "route" else None}
        row |= dict.fromkeys(("path", "name", "handler", "arguments"))
        if first is not None:
            if kind in ("route", "websocket", "group"):
                row["path"] = _string(first)
                row["handler"] = _handler(args[1]) if len(args) > 1 else None
            elif kind in ("state", "decorate"):
                row["name"] = _string(first)
            elif kind == "macro" and first.startswith("{"):
                row["name"] = ", ".join(re.findall(r"(?:^|[,{])\s*([A-Za-z_$][\w$]*)\s*(?=[:,}(])", first)) or None
                row["arguments"] = first
            elif kind == "plugin":
                handler = _handler(first)
                row["name"] = handler if handler != "<anonymous>" else None
            elif kind == "listen":
                row["name"] = first
            else:
                row["arguments"] = first[:200]
        out.append(row | {"parent_chain": chain_root(code, m.start())})
    return sorted(out, key=lambda r: (r["line"], r["column"]))
