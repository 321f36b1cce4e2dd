"""Lexical retrieval packing into fixed windows.

Documents are tokenised and dealt into shards by content: each gets a sketch of four min-hashes of its
terms, rarer ones weighing more. Buckets of the first min-hash, at most as many as the vocabulary has terms,
are counted and put together in order up to a shard's share of all tokens; a bucket above that (a hot text,
a template) is split evenly by row. Documents that share many terms thus tend to share a shard, and shards
weigh alike. Every shard builds a BM25 inverted index of its own. A window starts from a seed document; the index returns the unused
documents closest to it, which fill the window greedily. The document that crosses the window's end is cut
there and its rest seeds the next window, so windows are full. What is left at the end of a shard is cut
into windows whose lengths are powers of two, which need no padding.

Nulls: a null text counts as empty and yields its end token alone; identifiers may be null. Rows
repeated with the same identifier are packed each on its own. Ties of a score go by the shard's order.
Extra columns are ignored; an empty table gives an empty one. Nothing is drawn at random: reruns over the
same files agree.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, materialize, slices

WINDOW, END = 2048, 1
#: Documents of a shard on average, and partitions at most; a task closes an index and begins the next at
#: twice as many documents, or that many tokens, should a partition hold more. Every document is indexed and packed either way.
SHARD, MOST_PARTS, MOST_TOKENS = 2048, 20_000, 16 << 20
#: Min-hashes of a sketch, 16 bits each.
SKETCH = 4
#: BM25 parameters, and the share of documents above which a term's weights are held as a dense row.
K1, B, DENSE = 1.2, 0.75, 1 / 8

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters whose normal form, case and class are settled: visible ASCII and common Latin letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ňŊ-ž]+")
_LETTERS = "a-zß-öø-ž"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_END_MARK = "\x01"


class Ids:
    """Token ids of whole texts as bytes of unsigned integers.

    The tokenizer never joins what a space or line feed separates, so ids are looked up per piece
    between those, and only pieces not seen lately are encoded. A word-end vocabulary whose ids are in
    merge order is the same as a byte-pair table in which every word ends in a mark, which tiktoken
    encodes several times faster; pieces of settled characters go that way, all others, and all pieces
    of other vocabularies, through the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.seen, self.old = {"": b""}, {}
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.fast, self.ends = self._table(path)

    @staticmethod
    def _table(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != "</w>" or "Lowercase" not in json.dumps(spec["normalizer"]):
            return None, None
        import tiktoken

        special = {t["content"] for t in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level letters of bytes that are shown as they are
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks, ends = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
        for t, i in model["vocab"].items():
            if t in special:
                continue
            end = t.endswith("</w>") and len(t) > 4
            ranks[bytes(byte[c] for c in (t[:-4] if end else t)) + (_END_MARK.encode() if end else b"")] = i
            ends[i] = end
        return tiktoken.Encoding("words", pat_str=f"[^{_END_MARK}]+{_END_MARK}", mergeable_ranks=ranks, special_tokens={}), ends

    def _encode(self, pieces: list[str]) -> None:
        words, counts, quick, slow = [], [0], [], []
        plain, find = _PLAIN.fullmatch, _WORDS.findall
        for p in pieces:
            if not self.fast or not plain(p) or "<|" in p:
                slow.append(p)
                continue
            quick.append(p)
            if p.isalpha():
                words.append(p.lower())
            else:
                words += find(p.lower())
            counts.append(len(words))
        if quick:
            ids = np.array(self.fast.encode_ordinary(_END_MARK.join(words) + _END_MARK), self.kind)
            last = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            upto = (last[counts] * ids.itemsize).tolist()
            raw = ids.tobytes()
            self.seen.update(zip(quick, map(raw.__getitem__, map(slice, upto, upto[1:])), strict=False))
        for k in range(0, len(slow), 20_000):
            some = slow[k : k + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.seen[p] = np.array(e.ids, self.kind).tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of ``kind``."""
        if len(self.seen) > self.most:
            self.old, self.seen = self.seen, {"": b""}
        seen, old, new, out = self.seen, self.old, set(), []
        for t in texts:
            pieces = (t or "").replace("\n", " ").split(" ")
            got = list(map(seen.get, pieces))
            if None in got:
                gaps = [i for i, x in enumerate(got) if x is None]
                for i in gaps:
                    p = pieces[i]
                    x = got[i] = old.get(p)
                    if x is None:
                        got[i] = p
                        new.add(p)
                    else:
                        seen[p] = x
                out.append((got, gaps))
            else:
                out.append((got, ()))
        if new:
            self._encode(list(new))
        for got, gaps in out:
            for i in gaps:
                if got[i].__class__ is str:
                    got[i] = seen[got[i]]
        return [b"".join(got) for got, _ in out]


@cache
def ids_of(path: str) -> Ids:
    """One table per worker process: what one task has seen serves the next."""
    return Ids(path)


@cache
def _draws(size: int) -> np.ndarray:
    """Exponential draws of every term for every min-hash: smaller for rarer terms (the identifiers of a
    byte-pair vocabulary rise as frequency falls), so that those win more often."""
    draws = -np.log(np.random.default_rng(17).random((SKETCH, size)))
    return (draws / np.log(np.arange(size) + 2.0)).astype(np.float32)


def sketch(ids: np.ndarray, size: int) -> int:
    """Four min-hashes of a document's terms in one number, the first in front."""
    out = 0
    for draws in _draws(size):
        out = out << 16 | int(ids[draws[ids].argmin()]) & 0xFFFF
    return out - (1 << 63)


def _tokenise(path: str | None, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path or default_tokenizer())
        size = max(ids.tokenizer.get_vocab_size(), end + 1)
        tail = np.array([end], ids.kind).tobytes()
        for part in slices(batches, 500):
            got = [x + tail for x in ids.batch(part.column("_text").to_pylist())]
            sketches = pa.array([sketch(np.frombuffer(x, ids.kind), size) for x in got], pa.int64())
            wide = pa.array([ids.kind == "<u4"] * part.num_rows)
            sizes = pa.array([len(x) // np.dtype(ids.kind).itemsize for x in got], pa.int64())
            own = [part.column(c) for c in ("_id", "_h", "_row")]
            yield pa.RecordBatch.from_arrays([*own, sketches, sizes, wide, pa.array(got, pa.binary())], names=["_id", "_h", "_row", "_sketch", "_n", "_wide", "_ids"])

    return run


class Index:
    """BM25 over the documents of a shard (arrays of token ids)."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
        each = np.fromiter((len(t) for t in terms), np.int64, n)
        length = np.fromiter((len(d) for d in docs), np.float64, n)
        term, tf, doc = np.concatenate(terms), np.concatenate(counts).astype(np.float64), np.repeat(np.arange(n), each)
        df = np.bincount(term)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        dense = df > n * DENSE
        self.row = np.cumsum(dense) - 1  # rows of the dense terms
        thick = dense[term]
        self.rows = np.zeros((dense.sum(), n), np.float32)
        self.rows[self.row[term[thick]], doc[thick]] = weight[thick]
        thin = np.flatnonzero(~thick)
        thin = thin[np.argsort(term[thin], kind="stable")]
        self.doc, self.weight = doc[thin].astype(np.int32), weight[thin].astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(np.where(dense, 0, df))])
        self.n, self.dense, self.terms = n, dense, terms

    def nearest(self, seed: int, used: np.ndarray, k: int) -> np.ndarray:
        """Up to k unused documents by falling score for all terms of the seed, ties in document order."""
        query = self.terms[seed]
        thick = self.dense[query]
        score = self.rows[self.row[query[thick]]].sum(0).astype(np.float64)
        spans = [slice(i, j) for i, j in zip(self.first[query[~thick]].tolist(), self.first[query[~thick] + 1].tolist(), strict=True)]
        if spans:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[used] = 0
        if k < self.n:
            some = np.argpartition(-score, k)[:k]
            some.sort()
        else:
            some = np.arange(self.n)
        some = some[score[some] > 0]
        return some[np.argsort(-score[some], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length); each id lies in exactly one piece."""
    index, used = Index(docs), np.zeros(len(docs), bool)
    now, room, free = [], window, 0
    seed, start = None, 0
    while True:
        if seed is None:
            while free < len(docs) and used[free]:
                free += 1
            if free == len(docs):
                break
            seed, start = free, 0
            used[seed] = True
        queue = None
        doc = seed
        while True:  # fill the window of this seed
            n = min(room, len(docs[doc]) - start)
            now.append((doc, start, n))
            room -= n
            start += n
            if not room:
                yield now
                now, room = [], window
                seed = doc if start < len(docs[doc]) else None
                break
            if queue is None:
                queue = iter(index.nearest(seed, used, 32))
            doc = next(queue, None)
            if doc is None:
                queue = iter(index.nearest(seed, used, 32))
                doc = next(queue, None)
            if doc is None:
                seed = None
                break
            used[doc] = True
            start = 0
    while now:  # the rest of the shard: powers of two
        size = 1 << (sum(n for *_, n in now).bit_length() - 1)
        out, room = [], size
        while room:
            doc, start, n = now[0]
            took = min(n, room)
            out.append((doc, start, took))
            room -= took
            now = ([(doc, start + took, n - took)] if took < n else []) + now[1:]
        yield out


def shares(buckets: list[tuple[int, int]], each: float) -> list[tuple[int, int, int]]:
    """(bucket, first shard, shards) of buckets (number, tokens) in order: small ones share a shard until it
    holds ``each`` tokens, larger ones have as many of their own as they need."""
    out, shard, held = [], 0, 0.0
    for number, n in sorted(buckets):
        if n >= each:
            if held:
                shard, held = shard + 1, 0.0
            k = int(-(-n // each))
            out.append((number, shard, k))
            shard += k
            continue
        out.append((number, shard, 1))
        held += n
        if held >= each:
            shard, held = shard + 1, 0.0
    return out


def _pack(window: int, most_docs: int, most_tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, docs, tokens, sequence = None, [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, tokens, sequence
            cols: list[list] = [[] for _ in range(7)]
            for pieces in pack_shard(docs, window) if docs else ():
                offset = 0
                for doc, start, n in pieces:
                    crc = zlib.crc32(docs[doc][start : start + n].tobytes())
                    for col, v in zip(cols, (ids[doc], start, n, crc, len(docs[doc]), (shard << 32) + sequence, offset), strict=True):
                        col.append(v)
                    offset += n
                sequence += 1
            ids, docs, tokens = [], [], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in slices(batches, 500):
            for s, i, wide, raw in zip(*(b.column(c).to_pylist() for c in ("_shard", "_id", "_wide", "_ids")), strict=True):
                if s != shard or len(docs) >= most_docs or tokens >= most_tokens:
                    yield from flush()
                    sequence = sequence if s == shard else 0
                    shard = s
                d = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                ids.append(i)
                docs.append(d)
                tokens += len(d)
        yield from flush()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end: int = END,
    shard_docs: int = SHARD,
) -> DataFrame:
    """One row per piece (SCHEMA). ``tokenizer`` is the path of a tokenizers file on every executor."""
    spark = docs.sparkSession
    lean(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(id_col, text_col).alias("_h"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    tokens = rows.mapInArrow(_tokenise(tokenizer, end), "_id long, _h long, _row long, _sketch long, _n long, _wide boolean, _ids binary")
    tokens = materialize(tokens.withColumn("_bucket", F.shiftright("_sketch", 48).cast("int")), "tokens")
    found = tokens.groupBy("_bucket").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("c")).collect()  # a row per term at most
    shards = max(1, sum(r.c for r in found) // shard_docs)
    each = max(1.0, sum(r.n for r in found) / shards)
    given = spark.createDataFrame(shares([(r._bucket, r.n) for r in found], each), "_bucket int, _first long, _of long")
    part = F.pmod(F.xxhash64("_h", "_row"), F.col("_of"))
    sharded = tokens.join(F.broadcast(given), "_bucket").withColumn("_shard", F.col("_first") + part)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, MOST_PARTS))
    by = ["_shard", "_sketch", "_h", "_row"]
    dealt = sharded.select(*by, "_id", "_wide", "_ids").repartition(n, "_shard").sortWithinPartitions(*by).select("_shard", "_id", "_wide", "_ids")
    return dealt.mapInArrow(_pack(window, 2 * shard_docs, MOST_TOKENS), SCHEMA).withColumnRenamed("doc_id", id_col)
