"""Language-model scoring by context-tree weighting over bytes (operator 7).

A text is lower-cased (A-Z), its words joined by one blank, and ended by a line
feed.  Each byte is eight binary decisions; decision node (depth d, last d bytes,
bits so far) counts zeros and ones of the training texts, and its Krichevsky-
Trofimov estimate is mixed over all depths 0..DEPTH with the weights that
context-tree weighting gives them: the posterior odds of the node's own estimate
against the product of the nodes below it.

Spark's part.  Training texts become counts of (DEPTH + 1)-grams, summed per task
and then over all documents; everything after that works on distinct grams.
Grams are dealt by their last BASE context bytes, below which the tree falls
apart into independent subtrees: one pass weighs the subtrees bottom-up and sums
what the nodes above need, the driver finishes the depths above BASE (at most
256^BASE * 255 nodes whatever the input), and a second pass carries the mixture
down to every node: its decision's probability of a one when no deeper node is
known.  A decision reads its deepest known node, and all nodes of a gram deeper
than BASE stand in its subtree, so that pass gives every distinct gram of the
corpus, held-out ones too, its log probability; no node is left out.

Those numbers are a table that grows with the input.  It is dealt into as many
buckets as there are chunks of texts, by hash of the gram; a chunk asks each
bucket for its distinct grams, as one compressed row, and gets their numbers (as
32-bit floats) back the same way.

The base score needs the training count of every word of a text.  Texts are
staged in chunks of about CHUNK_BYTES; each chunk's distinct words get their
counts over all chunks, and the words that other chunks have too (a word of one
chunk only needs no telling) meet the chunk's texts in one task.

Cases: a null, empty or blank text is the end alone; repeated rows are scored
(and learned from) as often as they stand there; a null id counts as the empty
text in crc32; with no training texts every decision has probability 1/2; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, U64, crc_mod, distinct, hash_words, map_groups, mix, stage, table, texts_of

DEPTH = 5  # a gram and a text's number share 64 bits
BASE = 3
SLOTS = [1 << (8 * d + 8) for d in range(2)]  # depths whose nodes stand at their id, the others are sorted
CHUNK_BYTES = 24 << 20
SLICE_BYTES = 3 << 20
MERGE_GRAMS = 4 << 20
HELD_OUT_MOD, HELD_OUT = 7, 2
END = 10


def coded(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split()) + b"\n"


def grams(codes: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """One gram per byte: its last `depth` bytes and itself, big-endian; a
    text starts after `depth` end bytes."""
    lead = b"\n" * depth
    a = np.frombuffer(lead + lead.join(codes), np.uint8)
    n = len(a) - depth
    g = np.zeros(n, U64)
    for j in range(depth + 1):
        g = (g << U64(8)) | a[j : j + n]
    keep = np.ones(n, bool)
    ends = np.cumsum([len(c) + depth for c in codes])[:-1] - depth
    for j in range(depth):
        keep[ends + j] = False
    return g[keep]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - 2 * math.lgamma(0.5)


def _low(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


def _sum_by(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return (k[at], *(np.add.reduceat(w[order], at) if len(k) else w for w in weights))


def _decisions(g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits: node ids (context, 1 and the bits so far) and the bit."""
    sym = g & U64(255)
    for k in range(8):
        yield (g & ~U64(255)) | U64(1 << k) | (sym >> U64(8 - k)), ((sym >> U64(7 - k)) & U64(1)).astype(bool)


def _nodes(g: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node ids at a depth with their zeros and ones, from grams of that depth or more."""
    g, n = _sum_by(g & _low(8 * depth + 8), n)
    ids, ones = zip(*_decisions(g))
    ids, ones, n = np.concatenate(ids), np.concatenate(ones), np.tile(n, 8)
    return _sum_by(ids, n * ~ones, n * ones)


def _weigh(level, below) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the own estimate) of a level's
    nodes; below: ids and log probabilities of the next level, or None."""
    ids, n0, n1 = level
    kt = _kt(n0, n1)
    if below is None:
        return kt, np.ones(len(ids))
    kids = np.bincount(below[0], below[1], minlength=len(ids))
    return np.logaddexp(kt, kids) - math.log(2), 1 / (1 + np.exp(np.clip(kids - kt, -700, 700)))


def _subtrees(g: np.ndarray, n: np.ndarray):
    """Levels BASE..DEPTH of whole subtrees: nodes, log probabilities, weights."""
    levels = [_nodes(g, n, d) for d in range(BASE, DEPTH + 1)]
    logs, weights, below = [None] * len(levels), [None] * len(levels), None
    for i in range(len(levels) - 1, -1, -1):
        logs[i], weights[i] = _weigh(levels[i], below)
        if i:
            up = levels[i][0] & _low(8 * (BASE + i - 1) + 8)
            below = np.searchsorted(levels[i - 1][0], up), logs[i]
    return levels, logs, weights


def _mixed(levels, weights, start_s, start_a, first_depth: int):
    """Yields (depth, ids, probability of a one, counts) of each level, top-down."""
    s, a = start_s, start_a
    for i, (ids, n0, n1) in enumerate(levels):
        if i:
            up = np.searchsorted(levels[i - 1][0], ids & _low(8 * (first_depth + i - 1) + 8))
            s, a = s[up], a[up]
        p = (n1 + 0.5) / (n0 + n1 + 1)
        yield first_depth + i, ids, s + a * p, n0 + n1, s + a * weights[i] * p, a * (1 - weights[i])
        s, a = s + a * weights[i] * p, a * (1 - weights[i])


def _buckets(g: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(g + U64(0x51ED27)) % U64(buckets)).astype(np.int64)


def _pack(a: np.ndarray) -> bytes:
    """Numbers byte by byte (all first bytes, all second ones), compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 3)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def _pack_grams(g: np.ndarray) -> bytes:
    return _pack(np.diff(g, prepend=U64(0)))


def _unpack_grams(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, U64), dtype=U64)


def train(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gram, log): the log10 probability of each distinct gram of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, other, size, sums = [], [], 0, (np.empty(0, U64), np.empty(0, np.int64))

        def merged():
            u, c = _counts_of(learned, other)
            return _sum_by(np.concatenate([sums[0], u]), np.concatenate([sums[1], c]))

        for s in opened(batches):
            raw = s.texts()
            for held, to in ((False, learned), (True, other)):
                part = [coded(t) for t, out in zip(raw, s.held) if out == held]
                if part:
                    to.append(grams(part))
                    size += len(to[-1])
            if size >= MERGE_GRAMS:
                sums, learned, other, size = merged(), [], [], 0
        u, c = merged()
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_pydict({"gram": u[i : i + 100_000].view(np.int64), "n": c[i : i + 100_000]})

    counted = stage(texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    mask = ((1 << (8 * BASE)) - 1) << 8
    # the last BASE context bytes: all grams below one node of depth BASE
    dealt = counted.select(F.expr(f"gram & {mask}").alias("root"), "gram", "n")

    def up(g):
        levels, logs, _ = _subtrees(g["gram"].astype(np.int64).view(U64), g["n"].astype(np.float64))
        ids, n0, n1 = levels[0]
        ids, n0, n1, logs = _sum_by(ids & _low(8 * BASE), n0, n1, logs[0])
        yield {"id": ids.view(np.int64), "n0": n0, "n1": n1, "below": logs}

    top = (map_groups(dealt.where("n > 0"), ["root"], up, "id long, n0 double, n1 double, below double", together=True)
           .groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toArrow())
    ids, n0, n1, kids = (top.column(i).to_numpy() for i in range(4))
    order = np.argsort(ids.view(U64))
    levels = [(ids.view(U64)[order], n0[order], n1[order])]
    for d in range(BASE - 2, -1, -1):
        levels.insert(0, _sum_by(levels[0][0] & _low(8 * d + 8), levels[0][1], levels[0][2]))
    weights, below = [None] * BASE, (np.arange(len(order)), kids[order])
    for d in range(BASE - 1, -1, -1):
        log, weights[d] = _weigh(levels[d], below)
        if d:
            below = np.searchsorted(levels[d - 1][0], levels[d][0] & _low(8 * d)), log
    found = list(_mixed(levels, weights, np.zeros(len(levels[0][0])), np.ones(len(levels[0][0])), 0))
    last = found[-1]
    first = [np.zeros(k) for k in SLOTS]
    for d, known in enumerate(first):
        known[found[d][1].astype(np.int64)] = found[d][2]
    above = texts.sparkSession.sparkContext.broadcast((first, [(f[1], f[2]) for f in found[len(SLOTS) :]], (last[1], last[4], last[5])))

    def down(g):
        gram, n = g["gram"].astype(np.int64).view(U64), g["n"].astype(np.float64)
        levels, _, weights = _subtrees(gram[n > 0], n[n > 0])
        first, deeper, (ids, s, a) = above.value
        at = np.searchsorted(ids, levels[0][0] & _low(8 * BASE))
        deeper = deeper + [(ids_, q) for _, ids_, q, _, _, _ in _mixed(levels, weights, s[at], a[at], BASE)]
        yield {"bucket": _buckets(gram, buckets), "gram": gram.view(np.int64), "log": gram_logs(gram, first, deeper)}

    return map_groups(dealt, ["root"], down, "bucket long, gram long, log double", together=True)


def gram_logs(g: np.ndarray, model, deeper=()) -> np.ndarray:
    """log10 probability of each gram's last byte after its context.  model: for
    the first depths the probability at each node id, 0 for an unknown node;
    deeper: the sorted ids and the probabilities of the depths that follow."""
    total = np.zeros(len(g))
    for ids, ones in _decisions(g):
        p = np.full(len(g), 0.5)
        left = np.arange(len(g))
        for d in range(len(model) + len(deeper) - 1, -1, -1):
            node = ids[left] & _low(8 * d + 8)
            if d < len(model):
                v = model[d][node.astype(np.int64)]
                known = v > 0
            else:
                have, q = deeper[d - len(model)]
                if not len(have):
                    continue
                at = np.minimum(np.searchsorted(have, node), len(have) - 1)
                known, v = have[at] == node, q[at]
            p[left[known]] = v[known]
            left = left[~known]
            if not len(left):
                break
        p = np.clip(p, 1e-7, 1 - 1e-7)
        total += np.log10(np.where(ones, p, 1 - p))
    return total


def _asked(buckets: int):
    """(bucket, chunk, grams): the distinct grams of a chunk, a row per bucket;
    a chunk that two tasks read asks twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows():
            g = distinct(np.concatenate(held))
            to = _buckets(g, buckets)
            order = np.argsort(to, kind="stable")
            g, to = g[order], to[order]
            at = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
            yield pa.RecordBatch.from_pydict({"bucket": to[at[:-1]], "chunk": np.full(len(at) - 1, now, np.int64),
                                              "grams": pa.array([_pack_grams(g[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())})

        for s in opened(batches):
            if s.chunk != now:
                if now is not None:
                    yield from rows()
                now, held = s.chunk, []
            held.append(distinct(grams([coded(t) for t in s.texts()])))
        if now is not None:
            yield from rows()
    return run


REPLIES = "chunk long, word long, c long, blob binary"


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """The numbers of a bucket's grams to all that ask; c is the length of the grams in the blob."""
    g = left.column("gram").to_numpy().view(U64)
    order = np.argsort(g)
    g, log = g[order], left.column("log").to_numpy()[order].astype(np.float32)
    asked = right.column("grams").to_pylist()
    blobs = [a + _pack(log[np.searchsorted(g, _unpack_grams(a))]) for a in asked]
    return pa.table([right.column("chunk").cast(pa.int64()), pa.nulls(len(asked), pa.int64()), pa.array([len(a) for a in asked], pa.int64()),
                     pa.array(blobs, pa.binary())], names=["chunk", "word", "c", "blob"])


def text_scores(texts: list[bytes], known: np.ndarray, known_logs: np.ndarray) -> np.ndarray:
    """log10 probability of each text from those of its grams (known, sorted),
    fewer than 2^16 at a time: a gram and the number of its text are sorted as
    one number."""
    codes = [coded(t) for t in texts]
    who = np.repeat(np.arange(len(codes), dtype=U64), [len(c) for c in codes])
    both = np.sort((grams(codes) << U64(16)) | who)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    times = np.diff(np.append(at, len(both)))
    g = both[at] >> U64(16)
    new = np.append(True, g[1:] != g[:-1])
    logs = known_logs[np.searchsorted(known, g[new])][np.cumsum(new) - 1]
    return np.bincount((both[at] & U64(0xFFFF)).astype(np.int64), logs * times, minlength=len(codes))


class Slice:
    """Some documents whose texts are packed as one compressed blob."""

    def __init__(self, chunk: int, ids: list, held: list, ends: list, blob: bytes):
        self.chunk, self.ids, self.held = chunk, ids, np.array(held, bool)
        self.offsets = np.array([0, *ends], np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(self.offsets[-1]) + 1) if self.offsets[-1] else b""

    def texts(self) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return hash_words(np.frombuffer(self.raw, np.uint8), self.offsets, BLANKS)


SLICES = "chunk long, ids array<long>, held array<boolean>, ends array<long>, blob binary"


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for b in batches:
        for i in range(b.num_rows):
            yield Slice(*(b.column(j)[i].as_py() for j in range(5)))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as slices of SLICE_BYTES (or one longer text, or 2^16 - 1
    texts); chunks of CHUNK_BYTES are numbered within a task."""
    part, at, size = TaskContext.get().partitionId() << 24, 0, 0
    pack = zstandard.ZstdCompressor(level=3).compress

    def row(ids, held, texts):
        ends = np.cumsum([len(t) for t in texts]).tolist()
        return pa.RecordBatch.from_arrays([pa.array([part + at], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                                           pa.array([ends], pa.list_(pa.int64())), pa.array([pack(b"".join(texts))], pa.binary())],
                                          names=["chunk", "ids", "held", "ends", "blob"])

    ids, held, texts, n = [], [], [], 0
    for b in batches:
        for i, t, out in zip(b.column(0).to_pylist(), texts_of(b, 1), b.column(2).to_pylist()):
            t = t or b""
            if ids and (n + len(t) > SLICE_BYTES or len(ids) == (1 << 16) - 1):
                yield row(ids, held, texts)
                size += n
                if size >= CHUNK_BYTES:
                    at, size = at + 1, 0
                ids, held, texts, n = [], [], [], 0
            ids.append(i)
            held.append(out)
            texts.append(t)
            n += len(t)
    if ids:
        yield row(ids, held, texts)


def _counts_of(learned: list[np.ndarray], other: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of some texts and their numbers in the learned ones."""
    u, n = np.unique(np.concatenate([np.empty(0, U64), *learned]), return_counts=True)
    new = np.setdiff1d(distinct(np.concatenate([np.empty(0, U64), *other])), u, assume_unique=True)
    return np.concatenate([u, new]), np.concatenate([n, np.zeros(len(new), np.int64)])


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, word, times in training texts), a row per word of a chunk; a
    task reads whole chunks one after another, but for those at its ends."""
    now, learned, other = None, [], []

    def rows():
        u, n = _counts_of(learned, other)
        for a in range(0, len(u), 50_000):
            k = len(u[a : a + 50_000])
            yield pa.RecordBatch.from_pydict({"chunk": np.full(k, now, np.int64), "word": u[a : a + 50_000].view(np.int64), "n": n[a : a + 50_000]})

    for s in opened(batches):
        if s.chunk != now:
            if now is not None:
                yield from rows()
            now, learned, other = s.chunk, [], []
        h, at = s.words()
        out = np.repeat(s.held, np.diff(at))
        learned.append(h[~out])
        other.append(h[out])
    if now is not None:
        yield from rows()


def _shared_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that stand in one row only have the count their chunk finds itself;
    the others go on.  Last row, chunk -1: distinct words and words learned."""
    kinds = total = 0
    for b in batches:
        chunk, word, c, k, r = (b.column(i).to_numpy() for i in range(5))
        kinds += int(((r == 1) & (c > 0)).sum())
        total += int(c[r == 1].sum())
        at = k > 1
        yield pa.RecordBatch.from_pydict({"chunk": chunk[at], "word": word[at], "c": c[at]})
    yield pa.RecordBatch.from_pydict({"chunk": np.array([-1]), "word": np.array([kinds]), "c": np.array([total])})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      (crc_mod(id_col, HELD_OUT_MOD) == HELD_OUT).alias("held_out"))
    texts = stage(src.mapInArrow(_sliced, SLICES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.select("chunk").distinct().count())
    replies = (train(texts, buckets).groupBy("bucket").cogroup(texts.mapInArrow(_asked(buckets), "bucket long, chunk long, grams binary").groupBy("bucket"))
               .applyInArrow(_answer, REPLIES))
    by_word = Window.partitionBy("word")
    words = (texts.mapInArrow(_chunk_words, "chunk long, word long, n long")
             .select("chunk", "word", F.sum("n").over(by_word).alias("c"), F.count("*").over(by_word).alias("k"),
                     F.row_number().over(by_word.orderBy("chunk", "n")).alias("r")))
    counted = stage(words.mapInArrow(_shared_words, "chunk long, word long, c long"))
    ends = texts.select(F.explode("held").alias("out")).where("not out").count()
    sums = counted.where("chunk = -1").agg(F.sum("word").alias("v"), F.sum("c").alias("n")).first()
    n_train, kinds = (sums.n or 0) + ends, (sums.v or 0) + (ends > 0)
    low = math.log10(n_train + kinds + 1)
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
              "n_bytes long")
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        slices = list(opened(left.to_batches()))
        found = [s.words() for s in slices]
        outs = [np.repeat(s.held, np.diff(at)) for s, (_, at) in zip(slices, found)]
        u, n = _counts_of([h[~o] for (h, _), o in zip(found, outs)], [h[o] for (h, _), o in zip(found, outs)])
        order = np.argsort(u)
        u, n = u[order], n[order]
        blobs = [(a, b) for a, b in zip(right.column("c").to_pylist(), right.column("blob").to_pylist()) if b is not None]
        shared = right.filter(right.column("blob").is_null())
        n[np.searchsorted(u, shared.column("word").to_numpy().view(U64))] = shared.column("c").to_numpy()
        known = np.concatenate([np.empty(0, U64), *(_unpack_grams(b[:a]) for a, b in blobs)])
        logs_of = np.concatenate([np.empty(0), *(_unpack(b[a:], np.float32) for a, b in blobs)])
        order = np.argsort(known)
        known, logs_of = known[order], logs_of[order]
        tables = []
        for s, (h, at) in zip(slices, found):
            times = n[np.searchsorted(u, h)] if len(h) else np.empty(0, np.int64)
            logs = np.concatenate([[0.0], np.cumsum(np.log10(times + 1.0) - low)])
            seen = np.concatenate([[0], np.cumsum(times > 0)])
            raw = s.texts()
            k = len(raw)
            cols = [s.ids, s.held, np.diff(at) + 1, seen[at[1:]] - seen[at[:-1]] + (ends > 0), np.full(k, n_train),
                    logs[at[1:]] - logs[at[:-1]] + math.log10(ends + 1) - low, text_scores(raw, known, logs_of), [len(coded(t)) for t in raw]]
            tables.append(pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names))
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], t) for t in types], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    told = counted.where("chunk >= 0").withColumn("blob", F.lit(None).cast("binary")).unionByName(replies)
    out = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)
    return out.withColumn("bits_per_byte", -F.col("score") / math.log10(2) / F.col("n_bytes"))


def op7_ctw_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
