"""What a query string asks for: controls, intent, parts, code or prose. Runs on the driver for one
string; ``intent`` and ``looks_like_code`` are also columns for tables of queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CODE_STRONG, CODE_WEAK, INTENTS


@dataclass
class Controls:
    text: str = ""
    id: str | None = None
    file: str | None = None
    path: str | None = None
    lang: str | None = None
    kind: str | None = None
    package: str | None = None
    kinds: list[str] = field(default_factory=list)


_NAMES = {"id": "id", "file": "file", "path": "path", "lang": "lang", "language": "lang", "kind": "kind", "package": "package", "pkg": "package"}
_LANGS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}


def parse_controls(query: str) -> Controls:
    """key:value words out of a query; unknown keys and empty values stay in its text."""
    out, rest = Controls(), []
    for word in query.split():
        key, colon, value = word.partition(":")
        value = value.strip().strip('"').strip("'")
        name = _NAMES.get(key.strip().lower())
        if not colon or not value or not name:
            rest.append(word)
            continue
        if name == "lang":
            value = _LANGS.get(value.lower(), value.lower())
        setattr(out, name, value)
    out.text = " ".join(rest)
    out.kinds = [k.strip().lower() for k in (out.kind or "").split(",") if k.strip()]
    return out


def controls(c: Column) -> Column:
    """``parse_controls`` as a column: struct(text, id, file, path, lang, kind, package)."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    key = lambda w: F.lower(F.trim(F.substring_index(w, ":", 1)))
    value = lambda w: F.regexp_replace(F.trim(F.substring(w, F.instr(w, ":") + 1, F.lit(1 << 20))), "^\"+|\"+$|^'+|'+$", "")
    known = lambda w: F.contains(w, F.lit(":")) & key(w).isin(*_NAMES) & (value(w) != "")
    last_of = lambda keys: value(F.get(F.reverse(F.filter(words, lambda w: known(w) & key(w).isin(*keys))), F.lit(0)))
    out = [F.array_join(F.filter(words, lambda w: ~known(w)), " ").alias("text")]
    for name in ("id", "file", "path", "lang", "kind", "package"):
        last = last_of([k for k, n in _NAMES.items() if n == name])
        if name == "lang":
            langs = F.create_map(*[F.lit(x) for kv in _LANGS.items() for x in kv])
            last = F.coalesce(F.element_at(langs, F.lower(last)), F.lower(last))
        out.append(last.alias(name))
    return F.struct(*out)


def decomposed(c: Column) -> Column:
    """``decompose`` as a column: parts between ' and ', and between ' & ' within those."""
    cut = lambda x, at: F.filter(F.transform(F.split(x, at), lambda p: F.trim(p)), lambda p: p != "")
    return F.flatten(F.transform(cut(F.trim(c), "(?i) and "), lambda p: cut(p, " & ")))


def intent(c: Column) -> Column:
    """Name of the first intent whose words a query holds, or null."""
    q = F.lower(F.trim(c))
    words = F.split(q, r"\s+")
    out = None
    for name, parts, whole, starts in INTENTS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(q, F.lit(p))
        for w in whole:
            hit = hit | F.array_contains(words, w)
        for s in starts:
            hit = hit | q.startswith(s)
        if name == "callers":
            hit = hit | (q.startswith("where is ") & q.endswith(" used"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def callers_target(query: str) -> str | None:
    """The name in a question for callers, with its letter case."""
    m = re.fullmatch(r"(?:who calls|callers of|references to|usages of)\s+(.+)|where is\s+(.+)\s+used", query.strip(), re.I)
    return (m[1] or m[2]).strip() if m else None


def intent_of(query: str, callers_first: bool = True) -> str | None:
    """Intent of one string. With ``callers_first`` a question for callers is one whatever it names."""
    q = query.strip().lower()
    if callers_first and callers_target(query):
        return "callers"
    for name, parts, whole, starts in INTENTS:
        if any(p in q for p in parts) or any(w in q.split() for w in whole) or any(q.startswith(s) for s in starts):
            return name
    return "callers" if callers_target(query) else None


def decompose(query: str, depth: int = 3) -> list[str]:
    """Parts of a compound query: at ' and ', else at ' & ', again within the parts."""
    q = query.strip()
    if not q or depth == 0:
        return [q] if depth == 0 else []
    for cut in (" and ", " & "):
        parts = [p.strip() for p in re.split(re.escape(cut), q, flags=re.I)]
        parts = [p for p in parts if p]
        if len(parts) > 1:
            return [x for p in parts for x in decompose(p, depth - 1)]
    return [q]


def looks_like_code(c: Column) -> Column:
    """A strong sign of code, three weak ones, or a single identifier in camel or snake case."""
    q = F.trim(c)
    strong = F.lit(False)
    for s in CODE_STRONG:
        strong = strong | F.contains(q, F.lit(s))
    weak = sum((F.contains(q, F.lit(s)).cast("int") for s in CODE_WEAK), F.lit(0))
    one = ~F.contains(q, F.lit(" "))
    return (q != "") & (strong | (weak >= 3) | (one & q.rlike(r"\p{Ll}\p{Lu}")) | (one & F.contains(q, F.lit("_")) & q.rlike(r"^[\p{L}\p{N}_]+$")))


def is_code(query: str) -> bool:
    q = query.strip()
    if not q:
        return False
    if any(s in q for s in CODE_STRONG) or sum(s in q for s in CODE_WEAK) >= 3:
        return True
    return " " not in q and (any(a.islower() and b.isupper() for a, b in zip(q, q[1:], strict=False)) or ("_" in q and all(x.isalnum() or x == "_" for x in q)))


def guess_language(query: str) -> str:
    """Language that hypothetical code for a query is written in."""
    q = query.lower()
    for words, lang in ((("rust", "fn ", "impl ", "cargo"), "rust"), (("python", "def ", "pip"), "python"), (("golang", " go ", "func "), "go"), (("java ", "spring"), "java")):
        if any(w in f"{q} " for w in words):
            return lang
    return "typescript"


def pool_size(query: str, limit: int, vector_limit: int = 20, parts: int = 1) -> int:
    """Candidates to fetch: more for prose and compound queries than for code."""
    if is_code(query) and parts == 1:
        return max(vector_limit, limit, 5)
    return max(vector_limit, 3 * limit, 40)


def hypothetical(query: str, write: Callable[[str, str], str] | None = None) -> str | None:
    """Code that might answer a query, from a callback (a language model, say), fences off; failures give
    none. The default stands in for a model: a stub named by the query's words."""
    try:
        lang = guess_language(query)
        out = write(query, lang) if write else f"function {'_'.join(re.findall(r'[a-z0-9]+', query.lower()))}() {{}}"
        return re.sub(r"^```\w*\n|\n?```\s*$", "", out.strip())
    except Exception:  # best effort: search goes on without it
        return None
