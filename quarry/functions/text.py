"""Text analyzers as column expressions; everything here stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ACRONYMS, CALL_STOP, NAME_STOP, SHORT_FORMS, SYNONYMS

IDENTIFIER = "[A-Za-z_$][A-Za-z0-9_$]*"


def _split_run(c: Column) -> Column:
    """Splits identifiers in text outside quotes."""
    steps = [
        (r"([()])", " $1 "),
        (r"::|->|[_./\\:\-]", " "),
        (r"(?<=[A-UW-Za-uw-z])(?=[0-9])", " "),
        (r"(?<=[0-9])(?=[A-Za-z])", " "),
        (r"(?<=\p{Ll})(?=\p{Lu})", " "),
        (r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " "),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def normalize_query(c: Column) -> Column:
    """Words of identifiers apart, parentheses spaced, quoted runs as they are, white space collapsed."""
    parts = F.split(c, '"', -1)
    done = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).otherwise(_split_run(x))), '"')
    return F.trim(F.regexp_replace(done, r"\s+", " "))


def split_identifiers(c: Column) -> Column:
    return F.replace(normalize_query(c), F.lit('"'), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case words of split identifiers, in order."""
    return F.filter(F.split(F.lower(split_identifiers(c)), r"[ \t\n\x0c\r]+"), lambda t: t != "")


def code_words(text: str) -> list[str]:
    """``tokens`` of one string."""
    out = re.sub(r"::|->|[_./\\:\-\"\s]", " ", re.sub(r"([()])", r" \1 ", text))
    out = re.sub(r"(?<=[A-UW-Za-uw-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ", out)
    for k in range(len(out) - 1, 0, -1):
        a, b, after = out[k - 1], out[k], out[k + 1 : k + 2]
        if (a.islower() and b.isupper()) or (a.isupper() and b.isupper() and after.islower()):
            out = out[:k] + " " + out[k:]
    return out.lower().split()


def plain_words(text: str) -> list[str]:
    """``plain_tokens`` of one string."""
    return re.findall(r"[^\W_]+", text.lower())


def plain_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, for prose."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ngrams(word: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams of low..high characters; shorter words whole."""
    n = F.length(word)
    runs = F.transform(
        F.sequence(F.lit(low), F.least(F.lit(high), n)),
        lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(word, i, k)),
    )
    return F.when(n < low, F.array(word)).otherwise(F.flatten(runs))


def stem(token: Column) -> Column:
    """The first of ing, ed, es, s that ends the token taken off, as often as it stands there; null if
    less than three letters would be left or no suffix fits."""
    out = F.lit(None).cast("string")
    for suffix in reversed(("ing", "ed", "es", "s")):
        bare = F.regexp_replace(token, f"({suffix})+$", "")
        fits = (F.length(token) > len(suffix) + 2) & token.endswith(suffix)
        out = F.when(fits, F.when(F.length(bare) >= 3, bare)).otherwise(out)
    return out


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c with c worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def expand_synonyms(c: Column) -> Column:
    """The text followed by synonyms of its words, and by the terms its words are synonyms of; nothing
    that it contains already. Terms in alphabetical order."""

    def more(text: Column, low: Column, words: Column) -> Column:
        out = [text]
        for term in sorted(SYNONYMS):
            has = F.array_contains(words, term)
            for s in SYNONYMS[term]:
                out.append(F.when(has & ~F.contains(low, F.lit(s)), F.lit(s)))
            called = F.arrays_overlap(words, F.array(*map(F.lit, SYNONYMS[term])))
            out.append(F.when(called & ~F.contains(low, F.lit(term)), F.lit(term)))
        return F.concat_ws(" ", *out)

    return let(c, lambda t: let(F.lower(t), lambda low: let(F.split(low, r"\s+"), lambda w: more(t, low, w))))


def expand_acronyms(c: Column) -> Column:
    def more(text: Column, low: Column, words: Column) -> Column:
        out = [F.when(F.array_contains(words, a) & ~F.contains(low, F.lit(e)), F.lit(e)) for a, e in sorted(ACRONYMS.items())]
        return F.concat_ws(" ", text, *out)

    return let(c, lambda t: let(F.lower(t), lambda low: let(F.split(low, r"\s+"), lambda w: more(t, low, w))))


def expand_query(c: Column, synonyms: bool = True, acronyms: bool = True) -> Column:
    c = normalize_query(c)
    c = expand_synonyms(c) if synonyms else c
    return expand_acronyms(c) if acronyms else c


def plain_query(c: Column) -> Column:
    """Normalised words, each followed by the long form of a short one and by its stem."""

    def more(w: Column) -> Column:
        low = F.lower(w)
        long = F.element_at(F.create_map(*[F.lit(x) for kv in SHORT_FORMS.items() for x in kv]), low)
        return F.filter(F.array(w, long, F.when(low.rlike("^[a-z]{5,}$"), stem(low))), lambda x: x.isNotNull())

    return F.array_join(F.flatten(F.transform(F.split(normalize_query(c), " "), more)), " ")


def index_text(text: Column, name: Column, path: Column) -> Column:
    """Text for the index: with the split name and the path's segments, where it lacks them."""
    stem_ = F.regexp_replace(path, r"\.[^./]+$", "")
    parts = F.filter(F.split(stem_, "/"), lambda p: (p != "") & ~p.isin("mod", "index", "lib"))
    more = F.concat(F.array(split_identifiers(name)), F.transform(parts, split_identifiers))
    return F.concat_ws(" ", text, F.filter(more, lambda m: ~F.contains(F.lower(text), F.lower(m))))


def callees(text: Column) -> Column:
    """Names before an opening parenthesis, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(rf"({IDENTIFIER})[ \t\n\x0c\r]*\("), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*CALL_STOP))


def identifiers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*NAME_STOP))


def type_relations(text: Column) -> Column:
    """struct(extends, implements, aliases): identifiers that follow each keyword, and the first '='."""
    ident = r"[\p{L}_$][\p{L}\p{N}_$]*"
    after = lambda word: F.regexp_extract_all(text, F.lit(rf"{word}[^\p{{L}}_$]*({ident})"), F.lit(1))
    alias = F.regexp_extract(text, rf"^[^=]*=[^\p{{L}}_$]*({ident})", 1)
    return F.struct(after("extends").alias("extends"), after("implements").alias("implements"), F.when(alias != "", F.array(alias)).otherwise(F.array()).alias("aliases"))


def usage_line(text: Column, needle: Column, most: int = 200) -> Column:
    """The first line that contains the needle, trimmed; null if none does."""
    return F.substring(F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(x, needle)), F.lit(0))), 1, most)


def signature(text: Column, lines: int = 3, most: int = 200) -> Column:
    """The first lines of a definition in one, cut to a length in characters."""
    head = F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.trim(x))
    return F.substring(F.array_join(F.filter(head, lambda x: x != ""), " "), 1, most)


def line_relevance(line: Column, query: str) -> Column:
    """1 for the query as a substring, 2 per query word in the line, 0.5 for a structural keyword, 0.3 for a
    result or an export."""
    low, q = F.lower(line), query.lower()
    words = F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "), " ")
    score = F.when(F.contains(low, F.lit(q)), 1.0).otherwise(0.0)
    for w in dict.fromkeys(q.split()):
        score = score + F.when(F.array_contains(words, w), 2.0).otherwise(0.0)
    score = score + F.when(low.rlike(r"\b(fn|function|class|struct|interface|impl|trait|enum|def)\b"), 0.5).otherwise(0.0)
    return score + F.when(low.rlike(r"\b(return|pub|export)\b"), 0.3).otherwise(0.0)


def is_ranked_test(path: Column) -> Column:
    """Test files as ranking sees them."""
    has = [".test.", ".spec.", "/__tests__/", "/tests/", "/test_", "/conftest"]
    ends = [f"_test.{x}" for x in ("rs", "go", "py", "ts", "tsx", "js", "jsx")]
    out = path.startswith("tests/")
    for h in has:
        out = out | F.contains(path, F.lit(h))
    for e in ends:
        out = out | path.endswith(e)
    return out


def is_linked_test(path: Column) -> Column:
    """Test files as test links see them."""
    low = F.lower(path)
    return low.rlike(r"\.(test|spec)\.|_test\.(rs|ts|tsx|js)$|/(test|tests|__tests__|spec)/")


def is_diverse_test(path: Column) -> Column:
    """Test items as kind diversification sees them."""
    out = F.lit(False)
    for part in (".test.", ".spec.", "/tests/", "/__tests__/"):
        out = out | F.contains(path, F.lit(part))
    return out


def tested_source(path: Column) -> Column:
    """The source file that a test file's path points to, or null."""
    low = F.lower(path)
    cut = lambda d: F.concat(F.substring(path, F.lit(1), F.instr(low, d) - 1), F.substring(path, F.instr(low, d) + len(d) - 1, F.lit(1 << 20)))
    out = F.when(F.contains(low, F.lit(".test.")), F.regexp_replace(path, r"\.(test|TEST)\.", "."))
    out = out.when(F.contains(low, F.lit(".spec.")), F.regexp_replace(path, r"\.spec\.", "."))
    for x in ("ts", "tsx", "js", "rs"):
        out = out.when(low.endswith(f"_test.{x}"), F.regexp_replace(path, rf"_test\.{x}$", f".{x}"))
    for d in ("/test/", "/tests/", "/__tests__/"):
        out = out.when(F.contains(low, F.lit(d)), cut(d))
    return out


def path_matches(path: Column, pattern: str) -> Column:
    """Equality or, with a leading or trailing '*', suffix, prefix or substring."""
    if pattern.startswith("*") and pattern.endswith("*") and len(pattern) > 1:
        return F.contains(path, F.lit(pattern[1:-1]))
    if pattern.startswith("*"):
        return path.endswith(pattern[1:])
    if pattern.endswith("*"):
        return path.startswith(pattern[:-1])
    return path == pattern


def token_count(text: Column) -> Column:
    """Approximate count of model tokens: words, and each other mark."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))
