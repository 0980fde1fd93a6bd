"""N-gram Jaccard join in size-banded tiles with bitmap signatures (operator 2).

A document's set is its distinct five-word shingles, as 64-bit hashes.  Equal
sets form a class (keyed by the hash of the sorted set); links are searched
between classes, and every document takes its class's component.  No link
between different sets is lost, and no group's pairs are all written out:

1. A first scan sizes the sets and counts shingles in a table of fixed size
   (SLOTS counters), summed over all documents.
2. A second scan emits each set's prefix: two sets with Jaccard >= t share one of
   their first n - ceil(t n) + 1 shingles in any common order; ordering by the
   counters keeps shared passages out of the prefixes.  Each set also gets a
   bitmap with about one bit a shingle, the parity of the shingles hashed to it:
   the number of bits in which two bitmaps differ never exceeds the sets'
   symmetric difference, which bounds their overlap from above.
3. Star step: in each prefix group every set is paired with the group's pivot, the
   set with most shared prefix shingles.  Pairs that pass the size and bitmap bounds are verified exactly, and
   their links are contracted to components.
4. Tile step: groups in which sets other than the pivot still belong to several
   components are cut into tiles of at most TILE sets; pairs of tiles are
   compared by size band, bitmap, and component, and what passes is verified
   exactly too.  Only pairs across components are left to test, so this step
   loses nothing that could change a component.

Exact verification gathers each pivot with at most CHUNK of its candidates and
intersects sorted arrays.

Cases: null, empty and blank texts have empty sets, size 0 and no links; below
five words the whole sequence is the one shingle; repeated rows and ties are
copies; null ids never name a component unless no other id is in it; an empty
table gives no rows; other columns are not read.  Sets are told apart by 64-bit
hashes of shingles and of the set together with its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BLANKS, FILTER_BITS, U64, column_words, connected_components, distinct, in_filter, key_filter, map_groups, shingles,
                     stage, table, text_hashes)

SHINGLE = 5
NUM, DEN = 80, 100
SLOTS = 1 << 20
PART = 1 << 12
BITMAP_BITS = 1024
TILE = 512
CHUNK = 256


def shingle_set(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    return distinct(shingles(words, min(k, len(words)))) if len(words) else np.empty(0, U64)


def set_id(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).view(np.int64)))


def parity_bitmap(s: np.ndarray) -> bytes:
    """As many bits as shingles, rounded up to a power of two (BITMAP_BITS at
    least); a longer bitmap folds to a shorter one's length by xor."""
    bits = max(BITMAP_BITS, 1 << (len(s) - 1).bit_length())
    counts = np.bincount(((s >> U64(24)) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _prefix_size(n: int, num: int, den: int) -> int:
    return n - (-(-num * n // den)) + 1


def _sized(num: int, den: int):
    """Scan 1: set sizes and ids; at a task's end its part of the counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
        sums = np.zeros(SLOTS, np.int64)
        for b in batches:
            n, sid, slots, held = [], [], [], 0
            for w in column_words(b, 1, BLANKS):
                s = shingle_set(w)
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                slots.append((s & U64(SLOTS - 1)).astype(np.int32))
                held += len(s)
                if held > 1 << 21:
                    sums += np.bincount(np.concatenate(slots), minlength=SLOTS)
                    slots, held = [], 0
            if slots:
                sums += np.bincount(np.concatenate(slots), minlength=SLOTS)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.nulls(k, pa.int32()),
                                              pa.nulls(k, pa.binary())], schema=schema)
        parts = [i for i in range(SLOTS // PART) if sums[i * PART : (i + 1) * PART].any()]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(parts, pa.int32()),
                                          pa.array([sums[i * PART : (i + 1) * PART].tobytes() for i in parts], pa.binary())], schema=schema)
    return run


def _counters(sized: DataFrame) -> np.ndarray:
    """The tasks' counters, summed in Spark part by part; SLOTS numbers in all."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c, np.int64)
                sums[i] = sums[i] + c if i in sums else c.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["part", "counts"])
    rows = sized.where("part is not null").select("part", "counts")
    some = rows.repartition(64, "part").mapInArrow(run, "part int, counts binary")
    out = np.zeros(SLOTS, np.int64)
    for r in some.collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, np.int64)
    return out


def _prefixes(counters, num: int, den: int):
    """Scan 2: (sid, n, bitmap, prefix), once per set and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        load = counters.value
        for b in batches:
            sid, n, bitmap, prefix = [], [], [], []
            for w in column_words(b, 0, BLANKS):
                s = shingle_set(w)
                if not len(s):
                    continue
                i = set_id(s)
                if i in seen:
                    continue
                seen.add(i)
                p = _prefix_size(len(s), num, den)
                order = np.lexsort((s, load[(s & U64(SLOTS - 1)).astype(np.int64)]))[:p]
                sid.append(i)
                n.append(len(s))
                bitmap.append(parity_bitmap(s))
                prefix.append(s[order].view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            values = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(bitmap, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["sid", "n", "bitmap", "prefix"])
    return run


def _shared_keys(known):
    """Prefix shingles that pass the filter of shared ones, with their number
    in the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = known.value, (1 << FILTER_BITS) - 1
        for b in batches:
            ends = b.column(2).offsets.to_numpy()
            keys = b.column(2).values.to_numpy()[ends[0] : ends[-1]]
            at = keys & mask
            ok = (bits[at >> 6] >> (at & 63)) & 1 == 1
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))[ok]
            degree = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(b.column(0).to_numpy()[row]), pa.array(b.column(1).to_numpy()[row]),
                                              pa.array(degree[row].astype(np.int32))], names=["key", "sid", "n", "degree"])
    return run


def _folded(w: np.ndarray, words: int) -> np.ndarray:
    while w.shape[-1] > words:
        half = w.shape[-1] // 2
        w = w[..., :half] ^ w[..., half:]
    return w


class Bitmaps:
    """Bitmaps of several lengths, compared at the shorter length."""

    def __init__(self, col):
        self.words = np.array([len(x) // 8 for x in col], np.int64)
        self.place = np.zeros(len(col), np.int64)
        self.rows = {}
        for k in np.unique(self.words):
            at = np.flatnonzero(self.words == k)
            self.place[at] = np.arange(len(at))
            self.rows[int(k)] = np.frombuffer(b"".join(col[i] for i in at), np.uint64).reshape(len(at), -1)

    def differing(self, mine: np.ndarray, other: "Bitmaps", theirs: np.ndarray) -> np.ndarray:
        """Bits that differ between pairs (mine[i], theirs[i])."""
        out = np.zeros(len(theirs), np.int64)
        pair = self.words[mine] << 32 | other.words[theirs]
        for k in np.unique(pair):
            at = np.flatnonzero(pair == k)
            a, b = int(k) >> 32, int(k) & 0xFFFFFFFF
            x = _folded(self.rows[a][self.place[mine[at]]], min(a, b)) ^ _folded(other.rows[b][other.place[theirs[at]]], min(a, b))
            out[at] = np.bitwise_count(x).sum(1, dtype=np.int64)
        return out


def _may_link(na, nb, differing, num: int, den: int):
    """Overlap bounded by (na + nb - differing) / 2; Jaccard bounded with it."""
    return den * (na + nb - differing) >= num * (na + nb + differing)


def _verify(docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (hub, sid), those whose sets link.  A hub's
    candidates are cut into chunks, each with the hub's text."""
    sized = pairs.groupBy("hub").agg(F.count("*").alias("c"))
    cut = pairs.join(sized, "hub").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.ceil(F.col("c") / CHUNK)))
    hubs = cut.select("hub", "chunk").distinct()
    wanted = cut.select("hub", "chunk", "sid").unionByName(hubs.withColumn("sid", F.col("hub")))

    known = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "sid"))

    def texts(batches):
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            sid, at = [], []
            for row, w in enumerate(column_words(b, 0, BLANKS)):
                s = shingle_set(w)
                if len(s) and (i := set_id(s)) not in seen and in_filter(known.value, i):
                    seen.add(i)
                    sid.append(i)
                    at.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array([pack(b.column(0)[i].as_py().encode()) for i in at], pa.binary())],
                                             names=["sid", "text"])

    source = docs.select(F.col("text")).mapInArrow(texts, "sid long, text binary")
    rows = source.join(wanted.hint("merge"), "sid").select("hub", "chunk", "sid", "text")

    def links(g):
        hub = int(g["hub"][0])
        sets: dict[int, np.ndarray] = {}
        for i, t in zip(g["sid"].tolist(), g["text"]):
            if i not in sets:
                sets[i] = shingle_set(text_hashes(zstandard.decompress(t), BLANKS))
        h = sets.pop(hub, None)
        if h is None:
            return
        found = []
        for i, s in sets.items():
            both = len(np.intersect1d(h, s, assume_unique=True))
            if den * both >= num * (len(h) + len(s) - both):
                found.append(i)
        if found:
            yield {"u": np.full(len(found), hub, np.int64), "v": np.array(found, np.int64)}

    return map_groups(rows, ["hub", "chunk"], links, "u long, v long")


def _across(num: int, den: int):
    """Pairs of two tiles of one group that the bounds let pass and that lie in
    different components."""
    def run(g):
        a, b = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        same = g["ti"][0] == g["tj"][0]
        if same:
            b = a
        if not len(a) or not len(b):
            return
        order = np.argsort(g["n"][b], kind="stable")
        b = b[order]
        nb, cb, sb = g["n"][b].astype(np.int64), g["comp"][b], g["sid"][b]
        maps = Bitmaps(g["bitmap"])
        for x in a:
            n = int(g["n"][x])
            lo, hi = np.searchsorted(nb, -(-num * n // den)), np.searchsorted(nb, den * n // num, side="right")
            ok = np.flatnonzero(cb[lo:hi] != g["comp"][x]) + lo
            if not len(ok):
                continue
            differing = maps.differing(np.full(len(ok), x), maps, b[ok])
            ok = ok[_may_link(n, nb[ok], differing, num, den)]
            other = sb[ok]
            if len(ok):
                me = int(g["sid"][x])
                yield {"hub": np.minimum(other, me), "sid": np.maximum(other, me)}
    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) for every row; documents link
    when den * |A & B| >= num * |A | B|."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sized = stage(src.mapInArrow(_sized(num, den), "doc_id long, n int, sid long, part int, counts binary"))
    load = spark.sparkContext.broadcast(_counters(sized))
    sets = stage(src.select("text").mapInArrow(_prefixes(load, num, den), "sid long, n int, bitmap binary, prefix array<long>"))

    posted = sets.select(F.explode("prefix").alias("key"), "sid")
    shared = posted.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("key")
    known = spark.sparkContext.broadcast(key_filter(shared, "key"))
    # a group's pivot is its set with most shared prefix shingles: the original of edited copies, whose own edits fill their prefixes
    ranked = sets.select("sid", "n", "prefix").mapInArrow(_shared_keys(known), "key long, sid long, n int, degree int")
    ranked = stage(ranked)
    hubs = (ranked.groupBy("key").agg(F.max(F.struct("degree", "sid"))["sid"].alias("hub"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
            .where("lo < hi").select("key", "hub"))
    members = stage(ranked.select("key", "sid", "n").join(hubs, "key").distinct())
    sig = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    sig = stage(sig.join(members.select("sid").distinct(), "sid", "left_semi"))

    stars = members.where("sid <> hub").select("hub", "sid", "n").distinct()
    hub_sig = sig.select(F.col("sid").alias("hub"), F.col("n").alias("hub_n"), F.col("bitmap").alias("hub_bitmap"))
    stars = (stars.where("true").join(hub_sig, "hub").where(f"{den} * least(n, hub_n) >= {num} * greatest(n, hub_n)")
             .join(sig.select("sid", "bitmap"), "sid"))

    def bounded(batches):
        for b in batches:
            hub, sid, n, hub_n = (b.column(i).to_numpy() for i in range(4))
            rows = np.arange(len(hub))
            differing = Bitmaps(b.column(4).to_pylist()).differing(rows, Bitmaps(b.column(5).to_pylist()), rows)
            ok = _may_link(n.astype(np.int64), hub_n.astype(np.int64), differing, num, den)
            yield pa.RecordBatch.from_pydict({"hub": hub[ok], "sid": sid[ok]})

    pairs = stage(stars.select("hub", "sid", "n", "hub_n", "hub_bitmap", "bitmap").mapInArrow(bounded, "hub long, sid long"))
    links = stage(_verify(src, pairs, num, den))
    comps = connected_components(links)

    # groups whose sets, the pivot aside, lie in several components
    named = comps.toDF("sid", "comp")
    left = members.where("sid <> hub").join(named, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    left = stage(left.select("key", "sid", "n", "comp"))
    open_keys = (left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
                 .where("lo < hi").select("key", F.ceil(F.col("c") / TILE).cast("int").alias("tiles")))
    tiled = (left.join(open_keys, "key").join(sig.select("sid", "bitmap"), "sid")
             .withColumn("t", F.pmod(F.xxhash64("sid", "key"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("key", F.least("t", "other").alias("ti"), F.greatest("t", "other").alias("tj"),
                     F.when(F.col("t") <= F.col("other"), 0).otherwise(1).alias("side"), "sid", "n", "comp", "bitmap"))
    more = stage(map_groups(tiled, ["key", "ti", "tj"], _across(num, den), "hub long, sid long").distinct())
    if not more.isEmpty():
        links = links.unionByName(_verify(src, more, num, den))
        comps = connected_components(links)

    docs_of = sized.where("part is null")
    named = comps.toDF("sid", "comp")
    placed = docs_of.where("sid is not null").join(named, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    first = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(first, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("sid").alias("set_id"), "component_id")
    none = docs_of.where("sid is null").select("doc_id", F.lit(0).cast("long"), F.lit(None).cast("long"), F.col("doc_id"))
    return out.unionAll(none)


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
