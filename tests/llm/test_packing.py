import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.packing import Ids, Index, default_tokenizer, pack, pack_shard, shares, sketch

SCHEMA = "doc_id long, text string, start string, _h int"
TEXTS = ["The quick, brown fox. " * 400, "", None, "a", "don't <|endoftext|> stop now é é İ ΑΣ", "x" * 20_000, "fox and dog\n\n\tand 1234 ..."]


def ids(text):
    return np.array(Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZéß'sd 12.,!\n\t\x1c\x85 　́ΣİA<|>")), max_size=30))
def test_piecewise_ids_equal_the_tokenizer(text):
    test_piecewise_ids_equal_the_tokenizer.ids = getattr(test_piecewise_ids_equal_the_tokenizer, "ids", None) or Ids(default_tokenizer())
    assert test_piecewise_ids_equal_the_tokenizer.ids.batch([text])[0] == ids(text)[:-1].astype("<u2").tobytes()


def check(rows, got, most=2048):
    want = {i: ids(t) for i, t in rows}
    docs, seqs = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.length > 0
        assert r.doc_tokens == len(want[r.doc_id])
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(want)
    for spans, total in [(docs[i], len(x)) for i, x in want.items()] + [(s, None) for s in seqs.values()]:
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == total if total is not None else at <= most and at & (at - 1) == 0


def test_pack(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "none")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    check(rows, pack(docs).collect())
    check(rows, pack(docs, shard_docs=3).collect())
    assert pack(docs.limit(0)).count() == 0


def test_neighbours_are_the_closest():
    rng = np.random.default_rng(1)
    docs = [rng.integers(t * 50, t * 50 + 50, 300).astype("<u4") for t in (0, 1, 2, 0, 1, 2, 0)]
    index = Index(docs)
    used = np.zeros(7, bool)
    used[0] = True
    assert sorted(index.nearest(0, used, 4)) == [3, 6]
    windows = list(pack_shard(docs, 1024))
    assert {d for d, *_ in windows[0]} >= {0, 3, 6}
    assert sum(n for w in windows for *_, n in w) == 2100


def test_queries_hold_all_terms_of_a_seed():
    rng = np.random.default_rng(2)
    seed = np.concatenate([np.repeat(np.arange(30), 3), [30, 31]])
    docs = [d.astype("<u4") for d in (seed, np.array([30, 31]), *(rng.integers(100, 150, 40) for _ in range(20)))]
    used = np.zeros(len(docs), bool)
    used[0] = True
    assert Index(docs).nearest(0, used, 4).tolist() == [1]


def test_scores_are_bm25_over_all_terms():
    rng = np.random.default_rng(3)
    docs = [np.minimum(rng.zipf(1.4, rng.integers(5, 200)), 400).astype("<u4") for _ in range(60)]
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(401)}
    weigh = lambda t, d: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / mean))
    want = [sum(weigh(t, d) for t in np.unique(docs[5])) for d in docs]
    used = np.arange(n) == 5
    want[5] = 0
    assert Index(docs).nearest(5, used, 10).tolist() == np.argsort(-np.array(want), kind="stable")[:10].tolist()


def test_sketches_bring_like_documents_together():
    """Documents of a topic stand closer in the order of sketches than chance would have them."""
    rng = np.random.default_rng(4)
    topics = [rng.integers(300, 40_000, 150) for _ in range(16)]
    of = rng.integers(0, 16, 640)
    docs = [np.concatenate([rng.choice(topics[k], 120), rng.integers(0, 300, 80)]).astype("<u2") for k in of]
    order = np.argsort([sketch(d, 49_408) for d in docs], kind="stable")
    shard = np.empty(640, int)
    shard[order] = np.arange(640) // 80
    together = np.mean([(shard[of == k] == s).mean() for k, s in zip(of, shard, strict=True)])
    assert together > 0.3  # by chance an eighth
    assert sketch(docs[0], 49_408) == sketch(rng.permutation(docs[0]), 49_408)


def test_equal_documents_are_dealt_out(spark):
    """A text that most rows hold does not go to one partition."""
    rows = [(k % 3, "the same words " * 20) for k in range(900)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = pack(docs, shard_docs=100).collect()
    per = {}
    for r in got:
        per[r.sequence_id >> 32] = per.get(r.sequence_id >> 32, 0) + r.length
    assert len(per) >= 8 and max(per.values()) < 2 * min(per.values())
    again = pack(docs, shard_docs=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert sum(r.length for r in got) == 900 * len(ids(rows[0][1]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=30), st.integers(1, 60))
def test_shares(sizes, each):
    got = shares(list(enumerate(sizes)), each)
    assert [b for b, *_ in got] == list(range(len(sizes)))
    held = {}
    for b, first, k in got:
        for s in range(first, first + k):
            held[s] = held.get(s, 0) + sizes[b] / k
    assert sorted(held) == list(range(len(held))) and all(n < 2 * each for n in held.values())
