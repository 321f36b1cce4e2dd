"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions and labels every position with a
language; the probabilities of a document's positions are pooled by their mean logarithm. Input weights
are a table per byte value. It is trained in numpy by backpropagation through time.

The fit sees ``DRAWN`` windows of each of at most ``MOST`` documents per language (a hash sample outside
the held-out fold), of at most ``LANGUAGES`` languages, the most frequent ones; predictions cover every
position of every text. Nulls: a null text, or one without letters, is ``und`` with score 0; languages
that are null are not learned. Without labelled rows every prediction is ``und``. Repeated rows are
labelled each, and a repeated identifier counts once a language in the fit; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import crc_fold, lean, slices
from ._training import Adam, with_text

#: Bytes of a window, hidden units per direction, documents per language that the fit may see.
WINDOW, HIDDEN, MOST = 64, 8, 400
#: Windows of a document and languages that the fit may see.
DRAWN, LANGUAGES = 24, 500
STEPS, BATCH, RATE = 500, 192, 0.02
FOLDS, HELD_OUT = 4, 2
#: Windows that are read at once.
WIDTH = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Cell:
    """A gated recurrent unit over bytes, feature-major: states are (hidden, windows)."""

    table: np.ndarray  # (3H, 256): input weights and biases of update, reset and candidate, per byte
    u: np.ndarray  # (3H, H)

    @classmethod
    def new(cls, hidden: int, rng: np.random.Generator) -> Cell:
        u = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
        return cls(rng.normal(0, 0.5, (3 * hidden, 256)).astype("f4"), u.astype("f4"))

    def run(self, x: np.ndarray, order: Iterable[int], keep: list | None = None) -> np.ndarray:
        """States (L, H, N) for bytes x (L, N), visiting the positions in ``order``."""
        hidden, (length, n) = self.u.shape[1], x.shape
        out = np.empty((length, hidden, n), "f4")
        h = np.zeros((hidden, n), "f4")
        for t in order:
            a, u = self.table[:, x[t]], self.u @ h
            zr = a[: 2 * hidden]
            zr += u[: 2 * hidden]
            _sigmoid(zr)
            z, r = zr[:hidden], zr[hidden:]
            c = u[2 * hidden :]
            before, inner = h, c.copy() if keep is not None else None
            c *= r
            c += a[2 * hidden :]
            np.tanh(c, out=c)
            # h = z * c + (1 - z) * h
            h = out[t]
            np.subtract(c, before, out=h)
            h *= z
            h += before
            if keep is not None:
                keep.append((t, before, z, r, c, inner))
        return out

    def back(self, x: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u, given those of the states."""
        hidden, (length, n) = self.u.shape[1], x.shape
        da_all = np.empty((length, 3 * hidden, n), "f4")
        du = np.zeros_like(self.u)
        dh = np.zeros((hidden, n), "f4")
        for t, before, z, r, c, inner in reversed(keep):
            dh = dh + grad[t]
            dc = dh * z * (1 - c * c)
            da = da_all[t]
            da[:hidden] = dh * (c - before) * z * (1 - z)
            da[hidden : 2 * hidden] = dc * inner * r * (1 - r)
            da[2 * hidden :] = dc
            through = da.copy()
            through[2 * hidden :] = dc * r
            du += through @ before.T
            dh = dh * (1 - z) + self.u.T @ through
        flat = x.ravel()
        rows = da_all.transpose(1, 0, 2).reshape(3 * hidden, -1)
        table = np.stack([np.bincount(flat, row, 256) for row in rows]).astype("f4")
        return table, du


@dataclass
class Network:
    langs: list[str]
    forward: Cell
    backward: Cell
    w: np.ndarray  # (K, 2H)
    b: np.ndarray  # (K, 1)

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        w = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype("f4")
        return cls(langs, Cell.new(hidden, rng), Cell.new(hidden, rng), w, np.zeros((len(langs), 1), "f4"))

    def log_probs(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """(L, K, N) log-probabilities of the languages at every position."""
        length = len(x)
        f = self.forward.run(x, range(length), keep[0] if keep else None)
        b = self.backward.run(x, range(length - 1, -1, -1), keep[1] if keep else None)
        hidden = f.shape[1]
        z = np.matmul(self.w[:, :hidden], f)
        z += np.matmul(self.w[:, hidden:], b)
        z += self.b
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        if keep is not None:
            self._states = (f, b)
        return z

    def step(self, x: np.ndarray, y: np.ndarray, adam: Adam) -> float:
        """One step on windows x (L, N) with languages y (N); zero bytes are not counted."""
        keep: tuple[list, list] = ([], [])
        lp = self.log_probs(x, keep)
        f, b = self._states
        mask = (x != 0)[:, None, :].astype("f4")
        mask /= max(1.0, mask.sum())
        d = np.exp(lp)
        d[:, y, np.arange(len(y))] -= 1
        d *= mask
        hidden = f.shape[1]
        gw = np.concatenate([np.einsum("lkn,lhn->kh", d, f, optimize=True), np.einsum("lkn,lhn->kh", d, b, optimize=True)], 1)
        ft, fu = self.forward.back(x, keep[0], np.matmul(self.w[:, :hidden].T, d))
        bt, bu = self.backward.back(x, keep[1], np.matmul(self.w[:, hidden:].T, d))
        grads = [ft, fu, bt, bu, gw, d.sum((0, 2))[:, None]]
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        adam.step([g * min(1.0, 1.0 / max(norm, 1e-9)) for g in grads])
        return float(-(lp[:, y, np.arange(len(y))] * mask[:, 0]).sum())

    def params(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.u, self.backward.table, self.backward.u, self.w, self.b]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Pooled language and its probability, for whole texts."""
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(r) for r in raws])
        cuts = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), cuts)
        buf = b"".join(r.ljust(c * WINDOW, b"\0") for r, c in zip(raws, cuts.tolist(), strict=True))
        windows = np.frombuffer(buf, np.uint8).reshape(-1, WINDOW)
        for at in range(0, len(windows), WIDTH):
            x = np.ascontiguousarray(windows[at : at + WIDTH].T)
            lp = self.log_probs(x)
            if not x.all():
                lp *= (x != 0)[:, None, :]
            s = lp.sum(0)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc[at : at + WIDTH], s[k], len(texts))
        mean = total / np.maximum(1, sizes)[:, None]
        best = mean.argmax(1)
        p = np.exp(mean - mean.max(1, keepdims=True))
        p = p.max(1) / p.sum(1)
        lettered = np.array([any(map(str.isalpha, t)) if t else False for t in texts], bool)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p, 0.0)


def draw(text: str | None, n: int, seed: int) -> list[bytes]:
    """``n`` windows at random places of a text, or all of it where it is no longer than one."""
    raw = (text or "").encode("utf-8", "replace")
    if len(raw) <= WINDOW:
        return [raw] if raw else []
    return [raw[at : at + WINDOW] for at in np.random.default_rng(seed & 0xFFFFFFFF).integers(0, len(raw) - WINDOW + 1, n).tolist()]


def train(windows: list[list[bytes]], langs: list[str], steps: int = STEPS, seed: int = 4) -> Network:
    """Draws languages evenly, then a document of it, then one of the document's windows."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    net = Network.new(names)
    of: list[list[list[np.ndarray]]] = [[] for _ in names]
    at = {name: k for k, name in enumerate(names)}
    for some, s in zip(windows, langs, strict=True):
        if len(some):
            of[at[s]].append([np.frombuffer(w, np.uint8) for w in some])
    some = [k for k, r in enumerate(of) if r]
    adam = Adam(net.params(), RATE)
    for step in range(steps if some else 0):
        adam.rate = RATE * (1 - step / steps) + 1e-4
        y = np.array(some)[rng.integers(0, len(some), BATCH)]
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for row, k in zip(x, y, strict=True):
            doc = of[k][rng.integers(len(of[k]))]
            part = doc[rng.integers(len(doc))]
            row[: len(part)] = part
        net.step(np.ascontiguousarray(x.T), y, adam)
    return net


def _draw(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts = b.column("_id").to_pylist(), b.column("_text").to_pylist()
            got = [draw(t, n, zlib.crc32(str(i).encode())) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "_y")), pa.array(got, pa.list_(pa.binary()))], names=["_id", "_y", "_windows"])

    return run


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST, windows: int = DRAWN, languages: int = LANGUAGES
) -> Network | None:
    """A network from at most ``windows`` windows of each of at most ``most`` documents of each of the
    ``languages`` most frequent languages; only windows reach the driver."""
    lean(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, FOLDS) != HELD_OUT))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_y")).distinct()
    counts = rows.groupBy("_y").agg(F.count(F.lit(1)).alias("_all")).orderBy(F.desc("_all"), "_y").limit(languages)
    share = F.pmod(F.xxhash64(F.col("_id"), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(F.broadcast(counts), "_y").filter(share * F.col("_all") < 4 * most + 64).drop("_all")  # about four times what is taken
    order = Window.partitionBy("_y").orderBy(F.pmod(F.xxhash64(F.col("_id"), F.lit(9)), F.lit(1 << 30)), "_id")
    picked = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
    texts = with_text(docs, picked, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), "_y", "_text")
    got = texts.mapInArrow(_draw(windows), "_id long, _y string, _windows array<binary>").toPandas().sort_values(["_y", "_id"], kind="stable")
    if not len(got):
        return None
    return train(got._windows.tolist(), got._y.tolist())


def _label(net: Network | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                langs, p = net.predict(part.column("_text").to_pylist()) if net else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_id", "held_out")), pa.array(langs, pa.string()), pa.array(p, pa.float64())], names=["_id", "held_out", "lang_pred", "score"]
                )

    return run


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), (crc_fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_label(net), "_id long, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)
