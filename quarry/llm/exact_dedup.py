"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after each run of ASCII white space is replaced by one space.

1. Within every input partition, a trie over bounded batches reduces repeated texts to one row that
   carries the text once and the identifiers that had it. A text held by a third of all rows thus
   leaves each partition a few times instead of once per row.
2. The reduced rows are dealt out by length and content hash. Each partition inserts the full byte
   strings into a compressed radix trie whose terminals hold the smallest identifier, so equality is
   decided by bytes and never by hash. A trie that outgrows its memory spills its heaviest subtrees
   and finishes each afterwards on its own. Texts that stand in very many reduced rows are first joined
   up in salted groups, so that no task meets more than a bounded part of a text's rows.
3. The owners are joined back to the identifiers by the key of the reduced row.

Nulls: a null text counts as empty; a null identifier yields to any other (a group of only nulls keeps
one of its rows). Repeated rows: one row of the repeated ones is kept. Extra columns are ignored, or
carried through whole by ``keep_rows``.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import lean, materialize, partitions, slices

_SPACE = b" \t\n\r\x0b\x0c"
#: Reduced rows of one text that are joined up by a task before its owner is sought, and texts that may be.
HOT, MANY = 64, 100_000
#: Identifiers above every real one: what a null identifier counts as.
_LAST = (1 << 63) - 1


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with every run of ASCII white space as one space; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = raw.split()
    if not parts:
        return b" " if raw else b""
    return (b" " if raw[:1] in _SPACE else b"") + b" ".join(parts) + (b" " if raw[-1:] in _SPACE else b"")


class _Node:
    __slots__ = ("kids", "label", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.value, self.kids = label, value, {}


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Compressed radix trie from byte strings to values; ``merge`` folds a further value into the one held.

    ``held`` is the number of label bytes in memory and an allowance per node. Beyond ``limit``, subtrees
    are spilled to a file of the task. The place is found by following the heaviest child from the root
    until no child holds half of all, so neither a long common prefix nor a chain of prefixes costs a file
    a byte. Later insertions below a spilled place follow it.
    """

    NODE = 200

    def __init__(self, merge, limit: int | None = None, folder: str | None = None):
        self.root, self.merge, self.limit, self.folder = _Node(b""), merge, limit, folder
        self.held, self.next = 0, limit
        self.spilled: dict[bytes, int] = {}  # beginning of a key: number of its file
        self.lengths: list[int] = []  # lengths of those beginnings, longest first
        self.files: list[tuple[bytes, object]] = []  # (what its keys lack in front, file)

    def insert(self, key: bytes, value) -> None:
        for n in self.lengths:
            at = self.spilled.get(key[:n]) if len(key) >= n else None
            if at is not None:
                cut, f = self.files[at]
                pickle.dump((key[len(cut) :], value), f, protocol=5)
                return
        node, rest = self.root, key
        while rest:
            kid = node.kids.get(rest[0])
            if kid is None:
                node.kids[rest[0]] = _Node(rest, value)
                self.held += len(rest) + self.NODE
                break
            n = _shared(kid.label, rest)
            if n < len(kid.label):
                mid = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                mid.kids[kid.label[0]] = kid
                node.kids[rest[0]] = mid
                self.held += self.NODE
                kid = mid
            node, rest = kid, rest[n:]
        else:
            if node.value is None:
                node.value = value
            else:
                self.merge(node.value, value)
        if self.next and self.held > self.next:
            self._spill()

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.value is not None:
                yield key, node.value
            stack += [(k, key) for k in node.kids.values()]

    def _weights(self) -> dict[int, int]:
        """Weight of every node with all below it, by identity."""
        order, weight = [self.root], {}
        for node in order:
            order += node.kids.values()
        for node in reversed(order):
            weight[id(node)] = len(node.label) + self.NODE + sum(weight[id(k)] for k in node.kids.values())
        return weight

    def _spill(self) -> None:
        weight = self._weights()
        node, path = self.root, b""
        whole = weight[id(node)]
        while True:
            kids = sorted(node.kids.items(), key=lambda k: -weight[id(k[1])])
            if not kids or not kids[0][1].kids or weight[id(kids[0][1])] * 2 <= whole:
                break
            node = kids[0][1]
            path += node.label
        if not kids or (len(kids) == 1 and node is self.root and not kids[0][1].kids):  # one string cannot be split
            self.next = self.held * 2
            return
        f, freed = tempfile.TemporaryFile(dir=self.folder), 0
        for byte, kid in kids[: max(1, len(kids) - 1)]:  # something stays, so that every file is smaller
            for key, value in self._walk(kid, b""):
                pickle.dump((key, value), f, protocol=5)
            del node.kids[byte]
            self.spilled[path + bytes([byte])] = len(self.files)
            freed += weight[id(kid)]
            if freed * 2 >= whole:
                break
        self.files.append((path, f))
        self.lengths = sorted({len(k) for k in self.spilled}, reverse=True)
        self.held -= freed
        self.next = max(self.limit, self.held * 5 // 4)

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every terminal; spilled subtrees come last, each as a trie of its own, which may spill again."""
        yield from self._walk(self.root, b"")
        pending = self.files
        self.root, self.held, self.files, self.spilled, self.lengths = _Node(b""), 0, [], {}, []
        while pending:
            path, f = pending.pop()
            f.seek(0)
            below = PatriciaTrie(self.merge, self.limit, self.folder)
            while True:
                try:
                    key, value = pickle.load(f)
                except EOFError:
                    break
                below.insert(key, value)
            f.close()
            for key, value in below._walk(below.root, path):
                yield key, value
            pending += [(path + cut, g) for cut, g in below.files]


class _Held:
    """What a terminal of ``_reduce`` holds: the least (identifier, row) and all identifiers."""

    __slots__ = ("ids", "low")

    def __init__(self, i: int, row: int):
        self.low, self.ids = (i, row), array("q", (i,))

    def add(self, i: int, row: int) -> None:
        self.low = min(self.low, (i, row))
        self.ids.append(i)


def _reduce(batch_bytes: int, payload: pa.Schema):
    """Rows of an input partition, repeated texts of each batch run reduced to one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        add = lambda held, new: held.add(*new.low)
        count, held, rows, size, trie = 0, [], 0, 0, PatriciaTrie(add)

        def flush():
            nonlocal count, held, rows, size, trie
            got = list(trie.items())
            whole = pa.Table.from_batches(held)
            took = whole.take(pa.array([v.low[1] for _, v in got], pa.int64()))
            ids = [np.frombuffer(v.ids, np.int64) for _, v in got]
            flat = np.concatenate(ids)
            upto = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = pa.array(flat, pa.int64(), mask=flat == _LAST)
            out = {
                "_key": pa.array(range(first + count, first + count + len(got)), pa.int64()),
                "_len": pa.array([len(k) for k, _ in got], pa.int64()),
                "_hash": pa.array([xxhash.xxh64_intdigest(k) - (1 << 63) for k, _ in got], pa.int64()),
                "_ids": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values),
                "_row": pa.StructArray.from_arrays([took.column(f.name).combine_chunks().cast(f.type) for f in payload], fields=list(payload)),
            }
            count += len(got)
            held, rows, size, trie = [], 0, 0, PatriciaTrie(add)
            t = pa.table(out)
            for at in range(0, len(got), 2000):
                yield from t.slice(at, 2000).to_batches()

        for b in slices(batches):
            b = pa.RecordBatch.from_arrays(b.column(0).flatten(), schema=payload)
            held.append(b)
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                trie.insert(normalise(t), _Held(_LAST if i is None else i, rows + k))
            rows += b.num_rows
            size += b.nbytes
            if size > batch_bytes:
                yield from flush()
        if rows:
            yield from flush()

    return run


def _gather(limit: int):
    """(text, [least (identifier or none, key), rows, keys]) for the texts of a partition."""

    def merge(a, b):
        a[0] = min(a[0], b[0])
        a[1] += b[1]
        a[2].extend(b[2])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, list]]:
        trie = PatriciaTrie(merge, limit)
        for b in slices(batches):
            for key, text, low, n in zip(*(b.column(c).to_pylist() for c in ("_key", "_text", "_low", "_n")), strict=True):
                trie.insert(normalise(text), [((low is None, low or 0), key), n, array("q", (key,))])
        return trie.items()

    return run


def _join_up(limit: int):
    """Reduced rows of one text and salt as one: its key is that of the smallest identifier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, ((low, key), n, keys) in _gather(limit)(batches):
            row = {
                "_key": [key],
                "_len": [len(text)],
                "_hash": [xxhash.xxh64_intdigest(text) - (1 << 63)],
                "_text": [text.decode("utf-8", "surrogatepass")],
                "_low": [None if low[0] else low[1]],
                "_n": [n],
                "_keys": [list(keys)],
            }
            yield pa.RecordBatch.from_pydict(row, schema=_JOINED)

    return run


_JOINED = pa.schema(
    [("_key", pa.int64()), ("_len", pa.int64()), ("_hash", pa.int64()), ("_text", pa.string()), ("_low", pa.int64()), ("_n", pa.int64()), ("_keys", pa.list_(pa.int64()))]
)


def _own(limit: int):
    """Owners of the texts of one length-and-hash partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], [], [], [], []]
        for text, ((low, key), size, keys) in _gather(limit)(batches):
            sha = hashlib.sha256(text).hexdigest()
            for k in keys:
                for col, v in zip(out, (k, None if low[0] else low[1], size, sha, k == key), strict=True):
                    col.append(v)
            if len(out[0]) >= 20_000:
                yield _owned(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield _owned(out)

    return run


def _owned(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())],
        names=["_key", "keep_id", "group_size", "text_sha256", "_wins"],
    )


def owners(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
    batch_bytes: int = 12 << 20,
    trie_bytes: int = 96 << 20,
    hot: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """(reduced rows, owner of each reduced row). The reduced rows are a table in the shared folder;
    with ``carry`` they hold the whole row of their smallest identifier."""
    spark = docs.sparkSession
    lean(spark)
    cols = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")]
    if carry:
        cols += [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    rows = docs.select(F.struct(*cols).alias("_row"))
    kind = rows.schema["_row"].dataType
    payload = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    schema = T.StructType(
        [T.StructField("_key", T.LongType()), T.StructField("_len", T.LongType()), T.StructField("_hash", T.LongType()), T.StructField("_ids", T.ArrayType(T.LongType())), T.StructField("_row", kind)]
    )
    reduced = materialize(rows.mapInArrow(_reduce(batch_bytes, payload), schema), "dedup")
    total, n = reduced.agg(F.sum("_len"), F.count(F.lit(1))).first()
    low = F.array_min("_ids")
    small = reduced.select("_key", "_len", "_hash", F.col("_row._text").alias("_text"), low.alias("_low"), F.size("_ids").cast("long").alias("_n"))
    deal = lambda rows, *by: rows.repartition(partitions(spark, total or 0, 64 << 20), *by)
    owner = "_key long, keep_id long, group_size long, text_sha256 string, _wins boolean"
    # at most MANY texts can be in more than n / MANY rows, which bounds the broadcast
    often = reduced.groupBy("_len", "_hash").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > max(hot, n // MANY))
    often = materialize(often.withColumn("_salts", F.ceil(F.col("_c") / hot)).drop("_c"), "dedup-often")
    if often.isEmpty():
        return reduced, deal(small, "_len", "_hash").mapInArrow(_own(trie_bytes), owner)
    salted = small.join(F.broadcast(often), ["_len", "_hash"]).withColumn("_salt", F.pmod(F.xxhash64("_key"), "_salts"))
    kinds = "_key long, _len long, _hash long, _text string, _low long, _n long, _keys array<long>"
    joined = materialize(deal(salted, "_len", "_hash", "_salt").mapInArrow(_join_up(trie_bytes), kinds), "dedup-joined")
    rest = small.join(F.broadcast(often), ["_len", "_hash"], "left_anti")
    owned = deal(rest, "_len", "_hash").mapInArrow(_own(trie_bytes), owner)
    hot_owned = materialize(deal(joined.drop("_keys"), "_len", "_hash").mapInArrow(_own(trie_bytes), owner), "dedup-owned")
    of = joined.select("_key", F.explode("_keys").alias("_of")).join(hot_owned, "_key")
    of = of.select(F.col("_of").alias("_key"), "keep_id", "group_size", "text_sha256", (F.col("_wins") & (F.col("_of") == F.col("_key"))).alias("_wins"))
    return reduced, owned.unionByName(of)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Of rows repeated with the same identifier and text, one is marked kept.
    """
    reduced, owned = owners(docs, id_col, text_col, **kw)
    ids = reduced.select("_key", F.posexplode(F.expr("array_sort(_ids)")).alias("_pos", id_col))
    kept = F.col("_wins") & (F.col("_pos") == 0)
    return ids.join(owned, "_key").select(id_col, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with all columns of ``docs``; dropped ones go."""
    reduced, owned = owners(docs, id_col, text_col, carry=True)
    rows = reduced.join(owned.filter("_wins").select("_key"), "_key", "left_semi")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    names = {id_col: "_id", text_col: "_text"} | {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in (id_col, text_col)}
    assert len(names) == len(rest) + 2
    return rows.select([F.col(f"_row.{names[c]}").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
