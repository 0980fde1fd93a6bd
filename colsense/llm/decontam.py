"""Benchmark decontamination by a prefix-filtered set join (operator 3).

A benchmark item gives windows of `window` consecutive words (one shorter window
if it has fewer).  To contain a window a document must contain all of its word
shingles, so one of them is a sufficient prefix: the one that is rarest over all
documents.  Spark counts the items' shingles over the documents (first scan),
then every document is probed for prefix shingles only (second scan).  A probe
fixes where the window would start; it must begin at or after word 0 and end at
or before the last (positional and length bound), and then its words are
compared one by one.  Windows whose rarest shingle occurs nowhere are not
probed for at all.

The items are the stated query set.  They are taken in blocks of about
BLOCK_BYTES of text, each broadcast alone and probed in turn on the same
document stream, so a large benchmark costs scans, not memory.

Cases: null or wordless documents have no words and are not contaminated;
wordless items have no window; an item without an id counts under the id "";
several rows of one item_id count as one item; repeated documents are judged
each for itself; an empty benchmark or table gives no hits or no rows; other
columns of either table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, U64, column_words, lean, shingles, table, text_hashes

WINDOW = 13
SHINGLE = 3
#: Share of hit words from which a document is contaminated: 1 / 20.
HIT_SHARE = 20
BLOCK_BYTES = 16 << 20

_MASK = U64((1 << 20) - 1)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = "doc_id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_hash(words: tuple[bytes, ...]) -> np.ndarray:
    return text_hashes(b" ".join(words), ALNUM)


class _Probe:
    """Membership of hashes in a sorted set, most misses stopped by a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(int(_MASK) + 1, bool)
        self.seen[(self.keys & _MASK).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h and the places of their values in keys."""
        at = np.flatnonzero(self.seen[(h & _MASK).astype(np.int64)])
        i = np.searchsorted(self.keys, h[at])
        ok = i < len(self.keys)
        ok[ok] = self.keys[i[ok]] == h[at][ok]
        return at[ok], i[ok]


def _windows(rows: list, window: int) -> dict[tuple[bytes, ...], list[str]]:
    """Distinct windows -> ids of the items that have them."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for r in rows:
        words = ALNUM.words((r.text or "").encode())
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            found.setdefault(tuple(words[at : at + n]), set()).add(r.item_id or "")
    return {w: sorted(ids) for w, ids in found.items()}


def _shingle_counts(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How often each of the items' shingles occurs over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {k: _Probe(v) for k, v in keys.items()}
        sums = {k: np.zeros(len(p.keys), np.int64) for k, p in probes.items()}
        for b in batches:
            for w in column_words(b, 1, ALNUM):
                for k, p in probes.items():
                    _, i = p.find(shingles(w, k))
                    sums[k] += np.bincount(i, minlength=len(p.keys))
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"k": np.full(len(at), k, np.int32),
                                              "h": probes[k].keys[at].view(np.int64), "n": s[at]})

    rows = docs.mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {k: {} for k in keys}
    for r in rows:
        out[r.k][r.h & 0xFFFFFFFFFFFFFFFF] = r.n
    return out


def _prefixes(windows: dict, counts: dict[int, dict[int, int]], shingle: int) -> dict[int, dict[int, list]]:
    """k -> prefix shingle -> [(offset in the window, words, item ids)]."""
    out: dict[int, dict[int, list]] = {}
    for words, ids in windows.items():
        k = min(shingle, len(words))
        n, at, h = min((counts[k].get(int(h), 0), i, int(h)) for i, h in enumerate(shingles(words_hash(words), k)))
        if n:
            out.setdefault(k, {}).setdefault(h, []).append((at, list(words), ids))
    return out


def _matcher(prefixes, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {k: _Probe(np.fromiter(p, U64, len(p))) for k, p in prefixes.value.items()}
        for b in batches:
            n_words, spans, items = [], [], []
            before = zip(b.column(3).to_pylist(), b.column(4).to_pylist())
            for row, (w, (old_spans, old_items)) in enumerate(zip(column_words(b, 1, ALNUM), before)):
                found, hit, words = set(old_items), None, None
                for k, p in probes.items():
                    for pos, key in zip(*p.find(shingles(w, k))):
                        for at, want, ids in prefixes.value[k][int(p.keys[key])]:
                            if words is None:
                                words = ALNUM.words(b.column(1)[row].as_py().encode())
                            start = int(pos) - at
                            end = start + len(want)
                            if start >= 0 and end <= len(words) and words[start:end] == want:
                                if hit is None:
                                    hit = np.zeros(len(words) + 2, np.int8)
                                hit[start + 1 : end + 1] = 1
                                found.update(ids)
                if hit is not None:
                    for s in old_spans:
                        hit[s["start"] + 1 : s["end"] + 1] = 1
                    d = np.diff(hit)
                    old_spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist())]
                n_words.append(len(w))
                spans.append(old_spans)
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())),
                 *b.columns[5:]], names=["doc_id", "text", "n_words", "spans", "items", *kept])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Per document (doc_id, text, n_words, spans of hit words, items found), and
    under other names the columns to keep ({name: column})."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *[F.col(c).alias(name) for name, c in (keep or {}).items()])
    names = list(keep or {})
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = src.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
                     F.array().cast("array<string>").alias("items"), *names)
    schema = StructType(StructType.fromDDL(_OUT).fields + [f for f in out.schema if f.name in names])
    for i in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        windows = _windows(rows, window)
        keys = {k: np.concatenate([shingles(words_hash(w), k) for w in windows if min(shingle, len(w)) == k])
                for k in {min(shingle, len(w)) for w in windows}}
        prefixes = _prefixes(windows, _shingle_counts(src.select("doc_id", "text"), keys), shingle) if keys else {}
        out = out.mapInArrow(lean(_matcher(spark.sparkContext.broadcast(prefixes), names)), schema)
    return out


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated to contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return (found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", F.expr(f"n_hit > 0 and {HIT_SHARE} * n_hit >= n_words")))


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")
