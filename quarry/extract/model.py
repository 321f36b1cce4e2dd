"""What extraction returns for a file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    exported: bool
    start: int  # byte offsets
    end: int
    start_line: int
    end_line: int


@dataclass
class Import:
    name: str
    source: str
    alias: str | None = None


@dataclass
class Extracted:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    types: list[tuple[str, str]] = field(default_factory=list)  # (parent symbol, type named)
    flows: list[tuple[str, str, str, int]] = field(default_factory=list)  # (owner, name, reads or writes, line)
    todos: list[tuple[str, str, int, str | None]] = field(default_factory=list)  # (kind, text, line, symbol)
    docs: list[dict] = field(default_factory=list)
    decorators: list[tuple[int, str, str | None, int, str]] = field(default_factory=list)  # (start of symbol, name, arguments, line, type)
    patterns: list[dict] = field(default_factory=list)
