"""Assembly of ranked items into a context of bounded size.

The set-oriented parts (budgets as running sums, truncation) are column expressions; the exact greedy
packing and the formatting work on the few rows of one answer, on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines that a text may keep, whole file vertices, and texts of full mode; head and tail kept.
LINES, FILE_LINES, FULL_LINES = 500, 1000, 100
SHARES = {"root": 0.7, "extra": 0.2, "expanded": 0.1}


def within_budget(items: DataFrame, budget: int, order: list, tokens: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """Items while the running sum of tokens is below the budget; the item that passes it is the last.
    ``total`` is the sum up to each. ``order``: names of columns, ascending.

    Over a whole table (no ``by``) at most ``budget`` items with tokens are of interest, so a top-k comes
    first and no task ever sorts the table.
    """
    if not by:
        place = F.struct(*order)
        some = items.filter(F.col(tokens) > 0).select(place.alias("_at"), F.col(tokens).alias("_n")).orderBy("_at").limit(budget)
        run = F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        last = some.withColumn("_sum", run).filter(F.col("_sum") >= budget).agg(F.min("_at").alias("_last"))
        items = items.join(F.broadcast(last), F.col("_last").isNull() | (place <= F.col("_last"))).drop("_last")  # one row
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("total", F.sum(tokens).over(w)).filter(F.col("total") - F.col(tokens) < budget)


def head_tail(text: Column, most: int = LINES, head: int = 50, tail: int = 5) -> Column:
    """Texts of more lines keep their first and last ones."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    note = F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines omitted ..."))
    cut = F.concat_ws("\n", F.array_join(F.slice(lines, 1, head), "\n"), note, F.array_join(F.slice(lines, -tail, tail), "\n"))
    return F.when(n <= most, text).otherwise(cut)


def ordered(roots: DataFrame, extras: DataFrame, expanded: DataFrame) -> DataFrame:
    """All items by role, each id once at its first place: tier 0, 1, 2 and rank within."""
    rows = roots.withColumn("tier", F.lit(0)).unionByName(extras.withColumn("tier", F.lit(1))).unionByName(expanded.withColumn("tier", F.lit(2)))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("tier", "rank"))).filter("_n = 1").drop("_n")


def capped_roles(items: DataFrame, group: str = "cluster_key", root_most: int = 2, other_most: int = 1) -> DataFrame:
    """At most two roots, one other item, of each group; items without one are free."""
    n = F.row_number().over(Window.partitionBy("tier", group).orderBy("rank"))
    most = F.when(F.col("tier") == 0, root_most).otherwise(other_most)
    return items.withColumn("_n", n).filter(F.col(group).isNull() | (F.col("_n") <= most)).drop("_n")


def count_tokens(text: str) -> int:
    return len(re.findall(r"\w+|[^\w\s]", text))


@dataclass
class Item:
    id: str
    name: str
    kind: str
    file_path: str
    text: str
    role: str = "root"
    reasons: list[str] = field(default_factory=list)
    docstring: str | None = None


def auto_include(related: list[tuple[Item, str]], seen: set[str], budget: int, counter: Callable[[str], int] = count_tokens) -> list[Item]:
    """Types and parents that roots lead to, as far as a budget goes: of each root, in order, what it
    refers to by type or reference, then what it extends or implements. ``related``: (item, edge type) of
    each root's edges, root by root. An item that does not fit is passed over."""
    out, seen = [], set(seen)
    for kinds in (("type", "reference"), ("extends", "implements")):
        for item, kind in related:
            n = counter(item.text)
            if kind in kinds and item.id not in seen and n <= budget:
                budget -= n
                seen.add(item.id)
                out.append(item)
    return out


def pack(items: list[Item], budget: int, counter: Callable[[str], int] = count_tokens, relevance: Callable[[str], float] | None = None) -> list[Item]:
    """Greedy packing by role: each role has its share of the budget and gets its first item whatever its
    size; the item that passes the share is the last of the role. With ``relevance`` of a line, an item
    longer than what is left keeps its first, last and most relevant lines."""
    out = []
    for role, share in SHARES.items():
        left, first = budget * share, True
        for item in (i for i in items if i.role == role):
            if not first and left <= 0:
                break
            if relevance is not None and counter(item.text) > left > 0:
                item = replace(item, text=smart_truncate(item.text, int(left), relevance, counter=counter))
            out.append(item)
            left -= counter(item.text)
            first = False
    return out


def smart_truncate(text: str, most: int, relevance: Callable[[str], float], header: int = 5, footer: int = 3, counter: Callable[[str], int] = count_tokens) -> str:
    """First and last lines, and of the others the most relevant that the budget holds, in their order."""
    lines = text.split("\n")
    if counter(text) <= most or len(lines) <= header + footer:
        return text
    keep = {*range(header), *range(len(lines) - footer, len(lines))}
    left = most - sum(counter(lines[k]) for k in keep)
    for k in sorted(range(header, len(lines) - footer), key=lambda k: (-relevance(lines[k]), k)):
        n = counter(lines[k])
        if n <= left:
            keep.add(k)
            left -= n
    out, last = [], -1
    for k in sorted(keep):
        if k != last + 1:
            out.append("...")
        out.append(lines[k])
        last = k
    return "\n".join(out)


def render(items: list[Item]) -> str:
    """Sections of definitions, examples and related items."""
    titles = {"root": "## Definitions", "extra": "## Examples", "expanded": "## Related"}
    out = []
    for role, title in titles.items():
        some = [i for i in items if i.role == role]
        if some:
            out.append(title)
        for i in some:
            out.append(f"### {i.name} ({i.kind}) {i.file_path}")
            if i.docstring:
                out.append(f"> {i.docstring}")
            out.append(f"```\n{i.text}\n```")
    return "\n\n".join(out)
