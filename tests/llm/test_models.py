"""The learned models against plain loops: the LSTM's forward pass and gradient,
language and quality scores from the fitted weights."""

import math

import numpy as np

from colsense.llm import html_extract, language_id, quality
from colsense.llm.common import BLANKS, text_hashes

TEXTS = ["The quick brown fox. It ran!", "Größe und Ärger, 12 mal", "a", "", None, "¿Qué hora es? ¡Ya!", "12 34 -- !!", "word " * 300, "Tab\tand\nline\n\nbreaks \x0b here", "中文 text"]


def _sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_lstm_forward_pass():
    rng = np.random.default_rng(0)
    net, h = html_extract.BiLstm(), html_extract.HIDDEN
    pages = [(rng.normal(0, 1, (n, html_extract.INPUT)), rng.integers(0, 2, n).astype(float)) for n in (1, 5, 3)]
    x, mask, _ = html_extract.padded(pages)
    got, _ = net.logits(x, mask)
    for k, (page, _) in enumerate(pages):
        states = {}
        for d, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
            s, c = [0.0] * h, [0.0] * h
            for i in order:
                fed = [*page[i], *s]
                z = [sum(a * net.p["W" + d][r, j] for r, a in enumerate(fed)) + net.p["c" + d][j] for j in range(4 * h)]
                c = [_sigmoid(z[h + j]) * c[j] + _sigmoid(z[j]) * math.tanh(z[3 * h + j]) for j in range(h)]
                s = [_sigmoid(z[2 * h + j]) * math.tanh(c[j]) for j in range(h)]
                states[d, i] = s
        for i in range(len(page)):
            top = [*states["f", i], *states["b", i], *page[i]]
            assert abs(got[i, k] - sum(a * net.p["o"][r, 0] for r, a in enumerate(top)) - net.p["c"][0]) < 1e-9


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    net = html_extract.BiLstm()
    x, mask, y = html_extract.padded([(rng.normal(0, 1, (n, html_extract.INPUT)), rng.integers(0, 2, n).astype(float)) for n in (4, 2)])

    def loss():
        z, _ = net.logits(x, mask)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())
    for name, g in net.gradient(x, mask, y).items():
        p = net.p[name].reshape(-1)
        for i in rng.integers(0, len(p), 6):
            kept, step = p[i], 1e-5
            p[i] = kept + step
            up = loss()
            p[i] = kept - step
            down = loss()
            p[i] = kept
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 1e-6, name


def _ngrams(text):
    """Counts by bucket of the 1 to 3-grams of letters, runs of anything else one blank."""
    out, a = {}, ""
    for c in f" {(text or '').lower()} ":
        c = c if c.isalpha() else " "
        a += "" if c == " " and a.endswith(" ") else c
    if not a.strip():
        return out
    for n in (1, 2, 3):
        for i in range(len(a) - n + 1):
            h = 0
            for c in a[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            at = (h * 0xD6E8FEB86659FD93) % 2**64 >> 50
            out[at] = out.get(at, 0) + 1
    return out


def test_language_scores(spark):
    learn = [(f"{w} {i} und {w}", "de") for i, w in enumerate(("größe", "ärger", "haus", "baum", "stein") * 6)] + [
        (f"{w} {i} the {w}", "en") for i, w in enumerate(("house", "tree", "stone", "size", "anger") * 6)]
    model = language_id.fit(spark.createDataFrame(learn, "text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string"), model, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        counts = _ngrams(t)
        if not counts:
            assert got[i] == ("und", 0.0)
            continue
        x = {at: math.log1p(n) * model["idf"][at] for at, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(float(w[at]) * v / norm for at, v in x.items()) + float(w[language_id.BUCKETS])) / model["t"] for w in model["w"]]
        p = [math.exp(a - max(z)) for a in z]
        best = p.index(max(p))
        assert got[i][0] == model["langs"][best] and abs(got[i][1] - p[best] / sum(p)) < 1e-5


def _plain_features(text):
    raw = (text or "").encode()
    words = [tuple(w) for w in BLANKS.words(raw)]
    n, m = len(raw), len(words)
    out = [0.0] * quality.FEATURES
    if not n or not m:
        return out
    among = lambda lo, hi: sum(lo <= b < hi for b in raw)
    upper, lower, digit, other, blank = among(65, 91), among(97, 123), among(48, 58), among(128, 256), raw.count(32) + among(9, 14)
    marks = n - upper - lower - digit - other - blank
    most = max(words.count(w) for w in set(words))
    out[:16] = [1.0, math.log1p(m) / 8, math.log1p(n) / 10, upper / n, lower / n, digit / n, marks / n, other / n, blank / n, len(set(words)) / m,
                sum(a == b for a, b in zip(words, words[1:])) / m, most / m, (n - blank) / m / 10, raw.count(10) / m, math.log1p(upper) / (1 + math.log1p(lower)), marks / m]
    for b in range(128):
        out[16 + b] = math.sqrt(raw.count(b) / n)
    pairs = [0] * quality.PAIRS
    for a, b in zip(raw, raw[1:]):
        pairs[((a * 193 + b) * 40503 >> 7) % quality.PAIRS] += 1
    out[144:] = [math.sqrt(k / n) for k in pairs]
    return out


def test_quality_features_and_scores(spark):
    for t in TEXTS:
        raw = (t or "").encode()
        assert np.allclose(quality.features(np.frombuffer(raw, np.uint8), text_hashes(raw, BLANKS)), _plain_features(t), atol=1e-6)
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)], "doc_id int, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        z = sum((a - mean) / dev * w for a, mean, dev, w in zip(_plain_features(t), model["mean"], model["dev"], model["w"]))
        assert abs(got[i] - _sigmoid(z)) < 1e-4
