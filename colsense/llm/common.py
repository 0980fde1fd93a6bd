"""Helpers shared by the training-data operators: staged tables in the shared
folder, word and shingle hashing, grouped streaming inside tasks, connected
components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsense.session import checkpoint_dir

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared checkpoint folder and read back: cuts
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a membership filter: 8 MB, whatever the input.
FILTER_BITS = 26


def key_filter(keys: DataFrame, col: str) -> np.ndarray:
    """Bitmap of the low bits of a long column; of fixed size, made by a
    map-side combined aggregation.  It lets a scan skip most rows that a later
    exact join would drop; with very many keys it merely skips less."""
    at = F.expr(f"{col} & {(1 << FILTER_BITS) - 1}")
    words = (keys.select((at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({col} & 63 as int))").alias("v"))
             .groupBy("w").agg(F.bit_or("v").alias("v")))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for b in words.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out


def in_filter(bits: np.ndarray, key: int) -> bool:
    at = key & ((1 << FILTER_BITS) - 1)
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo m (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def drawn_contents(rows: DataFrame, key: list[str], n: int, seed: int, by: str | None = None) -> DataFrame:
    """At most n rows (of each value of `by`): of the distinct contents of the
    key columns those of smallest hash, one row for each, with its number of rows
    as _weight.  However many rows share a content, it is drawn once; counts are
    taken over 16 bytes a row, and only drawn contents meet the rows again."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)).alias("_u")
    keyed = rows.withColumn("_by", F.col(by) if by else F.lit("")).withColumn("_u", u)
    counts = stage(keyed.groupBy("_by", "_u").agg(F.count("*").alias("_weight")))
    # about 2n + 64 of the smallest, so that at least n are there to be cut exactly
    bound = counts.groupBy("_by").agg((F.lit(float(1 << 40)) * (2 * n + 64) / F.count("*")).alias("_bound"))
    near = counts.join(F.broadcast(bound), "_by").where(F.col("_u") < F.col("_bound"))
    first = F.row_number().over(Window.partitionBy("_by").orderBy("_u")) <= n
    chosen = near.withColumn("_first", first).where("_first").select("_by", "_u", "_weight")
    one = [F.first(c).alias(c) for c in rows.columns]
    return keyed.join(F.broadcast(chosen), ["_by", "_u"]).groupBy("_by", "_u", "_weight").agg(*one).select(*rows.columns, "_weight")


class Fold:
    """What makes a word: a random number for each byte (A-Z as a-z), 0 for the
    bytes that separate words."""

    def __init__(self, separators: bytes):
        rng = np.random.default_rng(20_260_101)
        self.value = rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        self.value[65:91] = self.value[97:123]
        self.value[list(separators)] = 0
        self.is_word = self.value != 0
        self.table = bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))

    def words(self, text: bytes | None) -> list[bytes]:
        return (text or b"").translate(self.table).split()


#: Words between ASCII blanks, and words of ASCII letters, digits and bytes over 0x7F.
BLANKS = Fold(b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = Fold(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))
SLICE = 1 << 19


def _powers(n: int, _kept: list = [np.ones(1, U64), np.ones(1, U64)]) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(_kept[0]) < n:
        inverse = U64(pow(int(_P), -1, 1 << 64))
        for i, base in enumerate((_P, inverse)):
            p = np.full(n, base, U64)
            p[0] = 1
            _kept[i] = np.multiply.accumulate(p)
    return _kept[0], _kept[1]


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: Fold) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts data[offsets[i]:offsets[i + 1]],
    one after another, and each text's place in them.  A word's hash is the
    difference of two prefix sums of byte * P^position, moved to position 0."""
    n = len(data)
    if not n:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    word = np.zeros(n + 2, bool)
    word[1:-1] = fold.is_word[data]
    begins = word[1:-1] & ~word[:-2]
    stops = word[1:-1] & ~word[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = word[1:-1][edges]
    stops[edges - 1] = word[1:-1][edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    out = np.empty(len(start), U64)
    a = 0
    while a < len(start):
        base = start[a]
        b = max(a + 1, int(np.searchsorted(stop, base + SLICE, side="right")))
        size = int(stop[b - 1] - base)
        power, inverse = _powers(max(size + 1, SLICE + 1))
        sums = np.zeros(size + 1, U64)
        np.cumsum(fold.value[data[base : base + size]] * power[:size], out=sums[1:])
        out[a:b] = (sums[stop[a:b] - base] - sums[start[a:b] - base]) * inverse[start[a:b] - base]
        a = b
    return mix(out), np.searchsorted(start, offsets)


def column_bytes(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets (null as empty)."""
    col = batch.column(i)
    col = pa.concat_arrays([col.cast(pa.large_binary())]) if col.offset else col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_hashes(text: bytes | None, fold: Fold) -> np.ndarray:
    data = np.frombuffer(text or b"", np.uint8)
    return hash_words(data, np.array([0, len(data)]), fold)[0]


def column_words(batch: pa.RecordBatch, i: int, fold: Fold, step: int = 512) -> Iterator[np.ndarray]:
    """The word hashes of each row's text; step rows at a time are hashed."""
    data, offsets = column_bytes(batch, i)
    for a in range(0, len(offsets) - 1, step):
        o = offsets[a : a + step + 1]
        h, at = hash_words(data[o[0] : o[-1]], o - o[0], fold)
        for x, y in zip(at[:-1], at[1:]):
            yield h[x:y]


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(h)
    if len(s) < 2:
        return s
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by position; empty below k words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * _P + w[j : j + n]
    return mix(h)


def texts_of(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return batch.column(i).cast(pa.binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], i: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `size` bytes of column i, or one longer row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), side="right")))
            yield b.slice(at, end - at)
            at = end


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives back memory when its task ends:
    Python workers serve one task after another and would keep it."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass
    return task


def map_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str, parts: int | None = None,
               together: bool = False) -> DataFrame:
    """Rows dealt by keys and sorted; fn gets the columns of one group after
    another as a dict of numpy arrays and yields dicts of columns.  Cheaper than
    applyInPandas when there are very many small groups.  The caller bounds the
    size of a group.  together: fn gets all whole groups of a batch at once."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        held: list[pa.Table] = []

        def groups(t: pa.Table, last: bool):
            if t.num_rows == 0:
                return t
            cols = {n: t.column(n).combine_chunks() for n in names}
            change = np.zeros(t.num_rows, bool)
            change[0] = True
            for k in keys:
                a = cols[k].to_numpy(zero_copy_only=False)
                change[1:] |= a[1:] != a[:-1]
            at = np.append(np.flatnonzero(change), t.num_rows)
            end = len(at) - 1 if last else len(at) - 2
            arrays = {n: c.to_numpy(zero_copy_only=False) for n, c in cols.items()}
            if together:
                if end:
                    yield {n: a[: at[end]] for n, a in arrays.items()}
            else:
                for i in range(end):
                    yield {n: a[at[i] : at[i + 1]] for n, a in arrays.items()}
            held[:] = [] if last else [t.slice(at[end])]

        def emit(found):
            acc: list[dict] = []
            n = 0
            for out in found:
                acc.append(out)
                n += len(next(iter(out.values())))
                if n >= 20_000:
                    yield to_batch(acc)
                    acc, n = [], 0
            if acc:
                yield to_batch(acc)

        def to_batch(acc: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: np.concatenate([a[k] for a in acc]) for k in acc[0]})

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            t = pa.concat_tables(held)
            yield from emit(o for g in groups(t, False) for o in fn(g))
        if held:
            t = pa.concat_tables(held)
            yield from emit(o for g in groups(t, True) for o in fn(g))

    return dealt.mapInArrow(run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not itself the smallest of its
    component; edges has (u, v).  Each round every node hooks to its smallest
    neighbour, pointers are followed to their roots and the graph is contracted,
    so the number of nodes at least halves; a hub's edges meet only in a map-side
    combined minimum or in joins that can be split."""
    cur = stage(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
                .where("a < b").distinct())
    rounds: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(cur.select("b", "a"))
        p = stage(both.groupBy("n").agg(F.min("m").alias("p")).where("p < n"))
        while True:  # follow pointers to their roots; each step squares the distance they reach
            for _ in range(2):
                up = p.select(F.col("n").alias("p"), F.col("p").alias("q"))
                p = p.join(up, "p", "left").select("n", F.coalesce("q", "p").alias("p"))
            p = stage(p)
            if p.join(p.select(F.col("n").alias("p")), "p", "left_semi").isEmpty():
                break
        rounds.append(p)
        pa_, pb = p.toDF("a", "pa"), p.toDF("b", "pb")
        nxt = (cur.join(pa_, "a", "left").join(pb, "b", "left")
               .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
               .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
        cur = stage(nxt)
    if not rounds:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1].toDF("node", "root")
    for p in reversed(rounds[:-1]):
        later = out.toDF("parent", "r")
        out = stage((p.toDF("node", "parent").join(later, "parent", "left")
                     .select("node", F.coalesce("r", "parent").alias("root"))).unionAll(out))
    return out
