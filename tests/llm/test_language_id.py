import numpy as np

from quarry.llm.language_id import WINDOW, Network, draw, fit, identify, train

SCHEMA = "doc_id long, text string, lang string, lang_pred string, _id int"
WORDS = {"xx": "aba bab abba baab", "yy": "cdc dcd ccdd ddcc", "zz": "éfé féf ééf"}


def texts(lang, n, rng):
    w = WORDS[lang].split()
    return [" ".join(rng.choice(w, rng.integers(5, 60))) for _ in range(n)]


class _Still:
    """Keeps the gradients instead of stepping."""

    def step(self, grads):
        self.grads = grads


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    net = Network.new(["a", "b", "c"], hidden=3)
    x, y = rng.integers(1, 9, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    still = _Still()
    net.step(x, y, still)
    raw = [g.copy() for g in still.grads]

    def loss():
        lp = net.log_probs(x).astype(float)
        return -lp[:, y, np.arange(5)].mean()

    num, ana = [], []
    for p, g in zip(net.params(), raw, strict=True):
        for i in rng.choice(p.size, min(12, p.size), replace=False):
            at = np.unravel_index(i, p.shape)
            old = p[at]
            p[at] = old + 2e-2
            up = loss()
            p[at] = old - 2e-2
            num.append((up - loss()) / 4e-2)
            p[at] = old
            ana.append(float(g[at]))
    num, ana = np.array(num), np.array(ana)
    scale = num @ ana / (ana @ ana)  # gradients are clipped to norm 1
    assert scale > 0 and np.abs(num - scale * ana).max() < 2e-3


def test_held_out_accuracy_and_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in WORDS for t in texts(lang, 60, rng))]
    more = [(900, None, "xx"), (901, "", "xx"), (902, "123 !!", "yy"), (903, "aba bab " * 30_000, None), (903, "aba bab " * 30_000, None), (None, "cdc dcd", "yy")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows + more], SCHEMA)
    got = identify(docs, fit(docs)).collect()
    assert len(got) == len(rows) + len(more)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "xx"] and by[None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got)
    assert fit(docs.limit(0)) is None and identify(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}


def plain_pass(net, windows):
    """Log-probabilities by the equations of the network, a number at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(cell, xs):
        h, out = np.zeros(cell.u.shape[1]), []
        size = len(h)
        for x in xs:
            a = cell.table[:, x].astype(float)
            u = cell.u.astype(float) @ h
            z = sig(a[:size] + u[:size])
            r = sig(a[size : 2 * size] + u[size : 2 * size])
            c = np.tanh(a[2 * size :] + r * u[2 * size :])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    got = []
    for xs in windows:
        both = [np.concatenate(p) for p in zip(states(net.forward, xs), states(net.backward, xs[::-1])[::-1], strict=True)]
        logits = [net.w.astype(float) @ h + net.b[:, 0] for h in both]
        got.append([v - np.log(np.exp(v).sum()) for v in logits])
    return np.array(got)


def test_forward_pass_and_pooling_against_a_plain_one():
    rng = np.random.default_rng(3)
    net = Network.new(["a", "b", "c"], hidden=4)
    x = rng.integers(1, 255, (9, 6)).astype(np.uint8)
    assert np.abs(net.log_probs(x).transpose(2, 0, 1) - plain_pass(net, x.T)).max() < 1e-4
    long = "".join(rng.choice(list("abcdé "), 700))
    raw = long.encode()
    cut = [raw[at : at + WINDOW].ljust(WINDOW, b"\0") for at in range(0, len(raw), WINDOW)]
    lp = plain_pass(net, [list(w) for w in cut])
    mean = lp.reshape(-1, 3)[: len(raw)].mean(0)
    (lang,), (p,) = net.predict([long])
    assert lang == "abc"[mean.argmax()] and abs(p - (np.exp(mean) / np.exp(mean).sum()).max()) < 1e-3


def test_windows():
    text = "".join(chr(97 + k % 26) for k in range(500))
    got = draw(text, 10, 1)
    assert len(got) == 10 and all(len(w) == WINDOW and w.decode() in text for w in got) and got == draw(text, 10, 1)
    assert draw("short", 10, 1) == [b"short"] and draw("", 10, 1) == draw(None, 10, 1) == []


def test_training_is_reproducible():
    rng = np.random.default_rng(2)
    t = [draw(x, 5, 0) for x in texts("xx", 5, rng) + texts("yy", 5, rng)]
    a, b = (train(t, ["xx"] * 5 + ["yy"] * 5, steps=20) for _ in range(2))
    assert all((p == q).all() for p, q in zip(a.params(), b.params(), strict=True))
