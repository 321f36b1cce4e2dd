"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles. Documents with equal sets form a class, and only
classes are compared. Every class has ``BANDS * ROWS`` minima; the hash of each band's minima is a
bucket, and of the minima the low ``BITS`` bits are packed into a signature. Classes that share a bucket
are candidates; their similarity is estimated from the number of equal signature fields, corrected for
chance collisions, and what is not clearly below the threshold is confirmed on the full sets.

Links are needed only as far as they join components, so pairs within a bucket are never listed. In each
round every class is compared with one pivot of its buckets, the least under an order that changes by
round, and confirmed links merge components. Buckets of a single component are done. After ``ROUNDS``
rounds the classes of the buckets left are compared exhaustively across components, block against block.
Signatures alone go first; only classes that stand in a pair near enough by signature and size are compared
on their full sets, in place, so that no link is lost however the rounds went and only links that join
components are returned. Rows of a common bucket are salted wherever they are joined.

Nulls and empty texts have no shingles, size 0, and link with nothing; a text of fewer words than a
shingle has one, the whole sequence. A null identifier yields to any other as component_id. Rows repeated
with one identifier get the same component. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, lean, materialize, rank_of, ranked, slices

BANDS, ROWS, BITS = 30, 5, 4
#: Words of a signature (64 bits each), and how far below the threshold an estimate may lie: five of its
#: standard deviations, so that a true link is turned away once in millions.
WORDS = -(-BANDS * ROWS * BITS // 64)
SLACK, ROUNDS = 0.15, 3
#: Classes of a bucket that one task joins, and buckets that may hold more.
HOT, MANY = 2000, 100_000
#: Classes of a block, and shingles of all of them: what bounds the memory of a comparison.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Fixed odd multipliers of the word and shingle hashes.
_P, _Q, _R = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bits of the filter that keeps rows of no interest out of the second pass.
FILTER_BITS = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_R)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_Q)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, k: int):
        self.k, self.powers = k, np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n + 1:
            size = 1 << int(n).bit_length()
            inverse = pow(_P, -1, 1 << 64)
            one = np.ones(1, np.uint64)
            self.powers = np.concatenate([one, np.cumprod(np.full(size, _P, np.uint64))])
            self.inverses = np.concatenate([one, np.cumprod(np.full(size, inverse, np.uint64))])
        return self.powers[:n], self.inverses

    def words(self, texts: list[str | None]) -> list[np.ndarray]:
        """Hashes of the words of each text, from running sums over all bytes at once."""
        raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        powers, inverses = self._powers(len(raw))
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        h = _mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
        at = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
        return [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def one(self, w: np.ndarray) -> np.ndarray:
        n, k = len(w), self.k
        if n == 0:
            return w
        m = max(1, n - k + 1)
        h = np.full(m, min(n, k), np.uint64)
        for j in range(min(n, k)):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(_Q) + w[j : j + m]
        return np.unique(_mix(h))

    def batches(self, texts: list[str | None], size: int = 1 << 20) -> Iterator[np.ndarray]:
        """Shingles per text, in order; long texts are read whole."""
        at = 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and (to == at or total + len(texts[to] or "") <= size):
                total += len(texts[to] or "")
                to += 1
            for w in self.words(texts[at:to]):
                yield self.one(w)
            at = to


class Minima:
    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64)

    def of(self, s: np.ndarray) -> np.ndarray:
        """Minima (32 bits) of all hash functions over a set."""
        low = None
        for at in range(0, len(s), 512):
            x = self.a * s[at : at + 512]
            x += self.b
            m = x.min(1)
            low = m if low is None else np.minimum(low, m)
        return (low >> np.uint64(32)).astype(np.uint64)


def bands_of(m: np.ndarray) -> np.ndarray:
    """Bucket of each band."""
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in m.reshape(BANDS, ROWS).T:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(_Q) + column
    return _mix(h).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """Signature: the low BITS bits of the minima, as WORDS integers."""
    per = 64 // BITS
    low = np.zeros(WORDS * per, np.uint64)
    low[: len(m)] = m & np.uint64((1 << BITS) - 1)
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(WORDS, per) << shifts, 1).view(np.int64)


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minima = Shingler(k), Minima(BANDS * ROWS)
        for b in slices(batches):
            cls, size, sig, bands = [], [], [], []
            for s in shingler.batches(b.column("_text").to_pylist()):
                size.append(len(s))
                if len(s):
                    m = minima.of(s)
                    cls.append(class_of(s))
                    sig.append(packed(m))
                    bands.append(bands_of(m))
                else:
                    for col in (cls, sig, bands):
                        col.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, longs), pa.array(bands, longs)],
                names=["_id", "n_shingles", "_cls", "_sig", "_bands"],
            )

    return run


def _sets(k: int, bits: bytes):
    """(class, full set) of the rows whose identifier may be wanted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, wanted = Shingler(k), np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        for b in slices(batches, 2000):
            for part in slices([b.filter(pa.array(wanted[b.column("_bit").to_numpy()]))]):
                got = [(class_of(s), s.tobytes()) for s in shingler.batches(part.column("_text").to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], pa.binary()) for j in (0, 1)], names=["_cls", "_set"])

    return run


def _confirm(share: int, of: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("_sa"), b.column("_sb"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                if of * len(s) < share * len(t):  # even a subset would fall short
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int(np.count_nonzero(t[at] == s))
                keep.append(of * both >= share * (len(s) + len(t) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def estimate(x: Column, y: Column) -> Column:
    """Similarity from the number of unequal signature fields, corrected for chance equality."""

    def unequal(p: Column, q: Column) -> Column:
        z = p.bitwiseXOR(q)
        step = 1
        while step < BITS:
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
            step *= 2
        mask = sum(1 << (BITS * k) for k in range(64 // BITS))
        return F.bit_count(z.bitwiseAND(F.lit(mask)))

    apart = F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda s, v: s + v)
    return 1 - apart / F.lit(BANDS * ROWS * (1 - 2.0**-BITS))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left[k]] and sets[right[k]]. Many pairs of few sets are counted
    by products of their incidence matrix, a slice of the shingles at a time."""
    if len(left) < 2000:
        out = np.empty(len(left), np.int64)
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            s, t = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            out[k] = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s)
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    order = order[n[at[order]] > 1]  # a shingle of one set is in no intersection
    owner, number = owner[order], np.cumsum(np.diff(at[order], prepend=-1) != 0) - 1
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        span = slice(*np.searchsorted(number, [low, low + 4096]))
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[span], number[span] - low] = 1
        total += x @ x.T
    return total[left, right].astype(np.int64)


def _candidates(rows: list[tuple], key: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (numbers of rows) across the sides and components of a run of rows whose estimate reaches
    ``least``. A pair that shares several buckets belongs to the first."""
    bk, i, j = key
    side = np.array([r[3] for r in rows])
    number = {c: n for n, c in enumerate({r[4] for r in rows})}
    comp = np.array([number[r[4]] for r in rows])
    sig, bands = np.array([r[6] for r in rows], np.int64).view(np.uint64), np.array([r[7] for r in rows], np.int64)
    left = np.flatnonzero(side == i)
    right = np.flatnonzero(side == j) if i != j else left
    mask, pairs = np.uint64(sum(1 << (BITS * k) for k in range(64 // BITS))), [np.zeros((2, 0), np.int64)]
    most = BANDS * ROWS * (1 - 2.0**-BITS) * (1 - least)
    for n, p in enumerate(left.tolist()):
        others = right[n + 1 :] if i == j else right
        others = others[comp[others] != comp[p]]
        if not len(others):
            continue
        z = sig[others] ^ sig[p]
        step = 1
        while step < BITS:
            z |= z >> np.uint64(step)
            step *= 2
        near = others[np.bitwise_count(z & mask).sum(1) <= most]
        if len(near):
            near = near[bands[p][(bands[near] == bands[p]).argmax(1)] == bk]
            pairs.append(np.stack([np.full(len(near), p), near]))
    x, y = np.concatenate(pairs, 1)
    return x, y


def _runs(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (_bk, _i, _j), which begin ``names``; batches are sorted by those."""
    rows, key = [], None
    for part in slices(batches):
        for r in zip(*(part.column(c).to_pylist() for c in names), strict=True):
            if r[:3] != key:
                if len(rows) > 1:
                    yield key, rows
                rows, key = [], r[:3]
            rows.append(r)
    if len(rows) > 1:
        yield key, rows


_ROW = ("_bk", "_i", "_j", "_side", "_comp", "_cls", "_sig", "_bands")


def _likely(least: float, share: int, of: int):
    """Of each run, the rows that stand in a candidate pair whose sizes allow a link: by signatures alone."""
    longs = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), longs, longs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, (*_ROW, "_size")):
            x, y = _candidates(rows, key, least)
            size = np.array([r[8] for r in rows])
            fits = of * np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y])
            some = [rows[k] for k in np.unique(np.concatenate([x[fits], y[fits]])).tolist()]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], kind) for c, kind in enumerate(kinds)], names=list(_ROW))

    return run


def _across(least: float, share: int, of: int):
    """Candidate pairs of each run compared on their full sets; links that join components not yet joined
    in the run are returned."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, (*_ROW, "_set")):
            x, y = _candidates(rows, key, least)
            sets = [np.frombuffer(r[8], np.uint64) for r in rows]
            size = np.array([len(s) for s in sets])
            fits = of * np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y])
            x, y = x[fits], y[fits]
            if not len(x):
                continue
            both = overlaps(sets, x, y)
            link = of * both >= share * (size[x] + size[y] - both)
            top, out = {r[4]: r[4] for r in rows}, ([], [])

            def find(c: bytes, top=top) -> bytes:
                while top[c] != c:
                    c = top[c]
                return c

            for p, q in zip(x[link].tolist(), y[link].tolist(), strict=True):
                c, d = find(rows[p][4]), find(rows[q][4])
                if c != d:
                    top[c] = d
                    out[0].append(rows[p][5])
                    out[1].append(rows[q][5])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, share: int = 85, of: int = 100) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Links documents with of * intersection >= share * union of their sets of ``k``-word shingles.
    """
    lean(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sketches = materialize(text.mapInArrow(_sketch(k), "_id long, n_shingles long, _cls binary, _sig array<long>, _bands array<long>"), "sketches")
    classes = sketches.filter("n_shingles > 0").groupBy("_cls").agg(F.min("_id").alias("_rep"), F.max("n_shingles").alias("_size"), F.any_value("_sig").alias("_sig"), F.any_value("_bands").alias("_bands"))
    classes = materialize(classes.withColumn("_key", ranked("_rep", "_cls")), "classes")
    links = _links(text, classes, k, share, of)
    roots = components(links, "links")
    of_class = classes.select("_cls", "_key").join(roots, F.col("_key") == F.col("node"), "left")
    joined = of_class.select("_cls", rank_of(F.coalesce("root", "_key")).alias("_least"))
    out = sketches.select("_id", "n_shingles", "_cls").join(joined, "_cls", "left")
    component = F.when(F.col("_cls").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _salted(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """``entries`` joined with ``buckets`` (one row per _bk, with _salts): a bucket's rows go to as many
    tasks as it has salts."""
    spread = buckets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts").cast("int") - 1))).drop("_salts")
    salted = entries.withColumn("_salt", F.pmod(F.xxhash64("_cls"), F.col("_salts")).cast("int"))
    return salted.join(spread, ["_bk", "_salt"]).drop("_salt")


def _members(classes: DataFrame) -> DataFrame:
    """(_bk, _cls, _salts) of the buckets that hold more than one class."""
    entries = classes.select(F.col("_key").alias("_cls"), F.explode("_bands").alias("_bk"))
    most = max(HOT, classes.count() * BANDS // MANY)  # so many buckets at most hold more, which bounds the broadcast
    shared = materialize(entries.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared")
    shared = shared.withColumn("_salts", F.ceil(F.col("_n") / most).cast("int"))
    hot = F.broadcast(shared.filter("_salts > 1").select("_bk", "_salts"))
    entries = entries.join(hot, "_bk", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    return materialize(_salted(entries, shared.select("_bk", "_salts")), "buckets")


def _links(text: DataFrame, classes: DataFrame, k: int, share: int, of: int) -> DataFrame:
    """Confirmed links (a, b) between keys of classes that connect every component."""
    least = share / of - SLACK
    members = _members(classes)
    wanted = materialize(members.select(F.col("_cls").alias("_key")).distinct(), "wanted")
    classes = materialize(classes.join(wanted, "_key", "left_semi"), "sigs")
    sets = _full_sets(text, classes.select("_cls", "_key", "_rep"), k)
    sigs = classes.select(F.col("_key").alias("_cls"), "_size", "_sig", "_bands")
    links = None
    for r in range(ROUNDS):
        order = F.xxhash64(F.col("_cls"), F.lit(r))
        if r == 0:
            active = members.withColumn("_comp", F.col("_cls"))
        else:
            active = _active(members, links)
            if active.isEmpty():
                return links
        lead = F.min(F.struct(order.alias("o"), F.col("_cls").alias("b"), F.col("_comp").alias("c"))).alias("_p")
        lead = active.groupBy("_bk").agg(lead, F.max("_salts").alias("_salts"))
        pairs = (
            _salted(active, lead).filter(F.col("_comp") != F.col("_p.c"))
            .groupBy(F.col("_cls").alias("a")).agg(F.min("_p").alias("_p")).select("a", F.col("_p.b").alias("b"))
        )
        sig = sigs.select("_cls", "_sig")
        near = (
            pairs.join(sig.withColumnsRenamed({"_cls": "a", "_sig": "_x"}), "a").join(sig.withColumnsRenamed({"_cls": "b", "_sig": "_y"}), "b")
            .filter(estimate(F.col("_x"), F.col("_y")) >= least).select("a", "b")
        )
        found = _confirmed(near, sets, share, of)
        links = materialize(found if links is None else links.unionByName(found), "links")
    active = _active(members, links)
    if active.isEmpty():
        return links
    sizes = active.join(sigs.select("_cls", "_size"), "_cls").groupBy("_bk").agg(F.max("_salts").alias("_salts"), F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_all"))
    n = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_all") / BLOCK_SHINGLES)).cast("int")
    sided = _salted(active, sizes.withColumn("_sides", n)).withColumn("_side", F.pmod(F.xxhash64("_cls", F.lit(7)), "_sides").cast("int"))
    sided = sided.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_sides") - 1)))
    sided = sided.select("_bk", F.least("_side", "_t").alias("_i"), F.greatest("_side", "_t").alias("_j"), "_side", "_comp", "_cls")
    block, row = ["_bk", "_i", "_j"], ["_side", "_comp", "_cls", "_sig", "_bands"]
    dealt = lambda rows: rows.repartition(*block).sortWithinPartitions(*block)
    kinds = "_bk long, _i int, _j int, _side int, _comp binary, _cls binary, _sig array<long>, _bands array<long>"
    rows = dealt(sided.join(sigs, "_cls").select(*block, *row, "_size"))
    rows = materialize(rows.mapInArrow(_likely(least, share, of), kinds), "likely")
    rows = dealt(rows.join(sets, "_cls").select(*block, *row, "_set"))
    return links.unionByName(materialize(rows.mapInArrow(_across(least, share, of), "a binary, b binary"), "across"))


def _active(members: DataFrame, links: DataFrame) -> DataFrame:
    """Buckets whose classes are not yet of one component: (_bk, _cls, _comp, _salts)."""
    roots = components(links, "round").select(F.col("node").alias("_cls"), "root")
    now = members.join(roots, "_cls", "left").select("_bk", "_cls", "_salts", F.coalesce("root", "_cls").alias("_comp"))
    open_ = now.groupBy("_bk").agg(F.min("_comp").alias("x"), F.max("_comp").alias("y"), F.max("_salts").alias("_salts")).filter("x != y")
    return materialize(_salted(now, open_.select("_bk", "_salts")), "active")


def _full_sets(text: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(_cls, _set) of the keys of classes, from a second pass over the texts. A filter of fixed size on
    the identifiers of their first documents skips most other rows; the join on the class decides."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    marks = classes.select(bit("_rep").alias("_b")).distinct().toPandas()["_b"].to_numpy(np.int64)
    bits = np.zeros(FILTER_BITS, bool)
    bits[marks] = True
    packed_bits = np.packbits(bits, bitorder="little").tobytes()
    rows = text.withColumn("_bit", bit("_id")).mapInArrow(_sets(k, packed_bits), "_cls binary, _set binary")
    rows = rows.join(classes.select("_cls", "_key"), "_cls").groupBy("_key").agg(F.any_value("_set").alias("_set"))
    return materialize(rows.withColumnRenamed("_key", "_cls"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int, of: int) -> DataFrame:
    one = pairs.join(sets.withColumnsRenamed({"_cls": "a", "_set": "_sa"}), "a")
    two = one.join(sets.withColumnsRenamed({"_cls": "b", "_set": "_sb"}), "b")
    return two.select("a", "b", "_sa", "_sb").mapInArrow(_confirm(share, of), "a binary, b binary")
