"""Quality classifier by positive-unlabelled learning (operator 9).

Trusted positives are training documents labelled 1; everything else to learn
from is unlabelled web text.  A logistic scorer minimises the non-negative
unbiased risk  pi * E+[l(f)] + max(0, Eu[l(-f)] - pi * E+[l(-f)]),  with the
class prior pi estimated as the share of 1 among the training labels.  Where the
bracket falls below zero its gradient is turned round, as the non-negative
estimator prescribes.

Both samples are bounded: at most POSITIVES labelled ids, and of their rows and
of all training rows at most POSITIVES and UNLABELLED distinct (id, text) pairs of
smallest hash, each weighted by its number of rows.  Their features, FEATURES
numbers a text, are all that reaches the driver.  Scoring is one scan over whole
texts without a shuffle.

Cases: null, empty and blank texts are scored like any other, from features that
are all zero; without positives every score is 0.5; null ids hash as the empty
text; labels that are null, that contradict each other for an id or that have no
document teach nothing; rows repeat as they are; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, column_bytes, crc_mod, drawn_contents, hash_words, lean, table

POSITIVES, UNLABELLED = 3000, 6000
HELD_OUT_MOD, HELD_OUT = 3, 1
PAIRS = 512
DENSE = 16
FEATURES = DENSE + 128 + PAIRS
STEPS, RATE, DECAY = 300, 0.05, 1e-4



def features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of a text's bytes and its word hashes: style statistics, frequencies of
    ASCII bytes and of hashed byte pairs."""
    out = np.zeros(FEATURES, np.float32)
    n, m = len(data), len(words)
    if not n or not m:
        return out
    hist = np.bincount(data, minlength=256).astype(np.float64)
    upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    blank = hist[32] + hist[9:14].sum()
    other = hist[128:].sum()
    marks = n - upper - lower - digit - blank - other
    ordered = np.sort(words)
    kinds = 1 + np.count_nonzero(ordered[1:] != ordered[:-1])
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out[:DENSE] = [1.0, np.log1p(m) / 8, np.log1p(n) / 10, upper / n, lower / n, digit / n, marks / n, other / n, blank / n,
                   kinds / m, np.count_nonzero(words[1:] == words[:-1]) / m, np.diff(np.append(at, m)).max() / m,
                   (n - blank) / m / 10, hist[10] / m, np.log1p(upper) / (1 + np.log1p(lower)), marks / m]
    out[DENSE : DENSE + 128] = np.sqrt(hist[:128] / n)
    pairs = np.bincount((data[:-1].astype(np.int64) * 193 + data[1:]) * 40_503 >> 7 & (PAIRS - 1), minlength=PAIRS)
    out[DENSE + 128 :] = np.sqrt(pairs / n)
    return out


def _features_of(batch: pa.RecordBatch, i: int, step: int = 256) -> Iterator[np.ndarray]:
    data, offsets = column_bytes(batch, i)
    for a in range(0, len(offsets) - 1, step):
        o = offsets[a : a + step + 1]
        words, at = hash_words(data[o[0] : o[-1]], o - o[0], BLANKS)
        for j in range(len(o) - 1):
            yield features(data[o[j] : o[j + 1]], words[at[j] : at[j + 1]])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _features_of(b, 0)], pa.binary()), b.column(1)], names=["x", "weight"])


def _matrix(rows: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights (of sum 1) of at most n rows."""
    drawn = drawn_contents(rows.select("doc_id", "text"), ["doc_id", "text"], n, seed).select("text", "_weight")
    found = sorted((r.x, r.weight) for r in drawn.mapInArrow(_feature_rows, "x binary, weight long").collect())
    weight = np.array([w for _, w in found], np.float64)
    return np.frombuffer(b"".join(x for x, _ in found), np.float32).reshape(-1, FEATURES).astype(np.float64), weight / max(weight.sum(), 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def minimise_nn_risk(pos: np.ndarray, unl: np.ndarray, prior: float, wp: np.ndarray | None = None, wu: np.ndarray | None = None) -> np.ndarray:
    """Weights of the scorer, by Adam on the non-negative risk with logistic loss;
    wp and wu weigh the rows (of sum 1; equal ones without)."""
    wp = np.full(len(pos), 1 / len(pos)) if wp is None else wp
    wu = np.full(len(unl), 1 / len(unl)) if wu is None else wu
    w, m, v = np.zeros(pos.shape[1]), 0.0, 0.0
    for step in range(1, STEPS + 1):
        zp, zu = pos @ w, unl @ w
        grad_pos = -prior * ((_sigmoid(-zp) * wp) @ pos)
        negative = np.logaddexp(0, zu) @ wu - prior * (np.logaddexp(0, zp) @ wp)
        grad_neg = (_sigmoid(zu) * wu) @ unl - prior * ((_sigmoid(zp) * wp) @ pos)
        g = (grad_pos + grad_neg if negative >= 0 else -grad_neg) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """docs: training (doc_id, text); labels: training (doc_id, quality)."""
    sure = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).where("quality = q").select("doc_id", "quality"))
    n = {r.quality: r.n for r in sure.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return {}
    drawn = sure.where("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(positives).select("doc_id")
    pos, wp = _matrix(docs.join(F.broadcast(drawn), "doc_id"), positives, 13)
    unl, wu = _matrix(docs, unlabelled, 12)
    if not len(pos) or not len(unl):
        return {}
    mean = wu @ unl
    dev = np.sqrt(np.maximum(wu @ (unl - mean) ** 2, 0)) + 1e-3
    mean[0], dev[0] = 0, 1
    prior = n[1] / sum(n.values())
    w = minimise_nn_risk((pos - mean) / dev, (unl - mean) / dev, prior, wp, wu)
    return {"mean": mean, "dev": dev, "w": w, "prior": prior}


def score(docs: DataFrame, model: dict, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """keep columns, score and predicted (under these names); docs has them and `text`."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            if m:
                x = np.array(list(_features_of(b, len(keep)))).reshape(-1, FEATURES)
                s = _sigmoid(((x - m["mean"]) / m["dev"]) @ m["w"])
            else:
                s = np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*keep, *names])

    src = docs.select(*keep, F.col("text").cast("string").alias("_q_text"))
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(lean(run), ", ".join([*(f"`{k}` {types[k]}" for k in keep), f"`{names[0]}` double, `{names[1]}` int"]))


def trained_on(docs: DataFrame, labels: DataFrame) -> dict:
    part = lambda df: df.where(crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT)
    return fit(part(docs.select("doc_id", F.col("text").cast("string").alias("text"))), part(labels.select("doc_id", "quality")))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_on(docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT), model, ["doc_id", "held_out"])
