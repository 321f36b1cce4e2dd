"""A lexer that tells code from comments and strings, and finds matching brackets.

``blank`` replaces the insides of comments and strings by spaces of the same length, so that patterns can
be searched in code alone while offsets stay those of the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_C = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
#: A quote in Rust may also begin a lifetime.
_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r#*\".*?\"#*|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n]+?|[^'\\\n])'", re.S)


def blank(source: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """(code with comments and strings blanked, spans of the comments)."""
    comments: list[tuple[int, int]] = []

    def hide(m: re.Match) -> str:
        s = m[0]
        if s.startswith(("//", "/*")):
            comments.append(m.span())
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s

    if language != "rust":
        return _C.sub(hide, source), comments
    out, at = [], 0
    while (m := _RUST.search(source, at)) is not None:
        end = _nested_end(source, m.start()) if m[0].startswith("/*") else m.end()
        out.append(source[at : m.start()])
        if m[0].startswith("/*"):
            comments.append((m.start(), end))
            out.append(re.sub(r"[^\n]", " ", source[m.start() : end]))
        else:
            out.append(hide(m))
        at = max(end, m.start() + 1)
    return "".join([*out, source[at:]]), comments


def _nested_end(source: str, at: int) -> int:
    """End of a block comment that may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


class Lines:
    """Line numbers (from 0) of character offsets, and byte offsets of them."""

    def __init__(self, source: str):
        self.source = source
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.ascii = source.isascii()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.source[:at].encode())


_PAIRS = {"{": "}", "(": ")", "[": "]"}


def match(code: str, at: int) -> int:
    """Offset after the bracket that closes the one at ``at``; the end if none does."""
    opens, closes, depth = code[at], _PAIRS[code[at]], 0
    for m in re.compile(f"[{re.escape(opens)}{re.escape(closes)}]").finditer(code, at):
        depth += 1 if m[0] == opens else -1
        if not depth:
            return m.end()
    return len(code)


def body_end(code: str, at: int) -> int:
    """End of a definition whose header begins before ``at``: its braces, or the next semicolon."""
    depth = 0
    for m in re.compile(r"[{}()\[\];]").finditer(code, at):
        c = m[0]
        if c == "{" and not depth:
            return match(code, m.start())
        if c == ";" and not depth:
            return m.end()
        depth += 1 if c in "([" else -1 if c in ")]" else 0
        if c == "}" and depth <= 0:
            return m.start()
    return len(code)


def statement_end(code: str, at: int) -> int:
    """End of a statement: a semicolon outside brackets, or the end of a line that ends one."""
    depth = 0
    for m in re.compile(r"[{}()\[\];\n]").finditer(code, at):
        c = m[0]
        if c in "({[":
            depth += 1
        elif c in ")}]":
            depth -= 1
            if depth < 0:
                return m.start()
        elif not depth and (c == ";" or (c == "\n" and not re.search(r"[=,(+\-*/&|?:.]\s*\Z", code[at : m.start()]))):
            return m.end() if c == ";" else m.start()
    return len(code)


def split_args(code: str) -> list[tuple[int, int]]:
    """Spans of the arguments between commas outside brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(code):
        if c in "({[<":
            depth += 1
        elif c in ")}]>":
            depth -= 1
        elif c == "," and depth <= 0:
            out.append((start, k))
            start = k + 1
    if code[start:].strip():
        out.append((start, len(code)))
    return out
