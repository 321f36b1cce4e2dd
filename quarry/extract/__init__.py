"""Symbols, imports, types, data flow, documentation and framework calls out of source files."""
