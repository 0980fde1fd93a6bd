"""Best-fit packing by large-item matching (operator 4).

A document becomes the token ids of its text and one end id; only documents
longer than the capacity are cut.  Packing needs the pieces' lengths alone, and
there are at most `capacity` different ones: Spark counts pieces by length, the
driver matches *runs of equal pieces* with *runs of equally full bins* (both
bounded by the capacity, whatever the input), and Spark numbers the pieces of
each length and looks up their run.

Plan: full pieces stand alone.  Lengths above a third of the capacity are
matched greedily, at most two to a bin: the longest open piece takes the longest
other that still fits.  The rest go, longest first, each into the fullest bin
that has room (best fit), and open new bins when none has.

Cases: a null text is an empty one, whose only id is the end id; an empty table
gives no pieces; repeated rows are packed as separate documents; a null id is
carried through; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, stage, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Groups in which the pieces of one length are numbered, so that no length is numbered in one task.
RANK_GROUPS = 1024
#: Text that is tokenised at once (or one longer document), and bytes of a worker's remembered chunks.
SLICE_BYTES, KEPT_BYTES = 12 << 20, 96 << 20
_ENTRY = 200  # of a dict's entry with its two objects

_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[9, 10, 13]] = 32


class ChunkIds(dict):
    """Text between ASCII blanks -> its ids as little-endian 32-bit bytes.

    The tokenizer's normaliser and pre-tokenizer never join text across blanks,
    so a text's ids are those of its chunks in a row.  A chunk of ASCII letters
    and marks is cut into the pre-tokenizer's pieces first, because words recur
    more often than words with their punctuation.  What is remembered is bounded
    in bytes and then forgotten at once."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_chars = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        # letters of Latin-1 lower-case to one letter and have no combining marks to compose with
        self.plain = regex.compile(r"[!-~\xC0-\xFF]+").fullmatch

    def encode(self, s: str) -> bytes:
        return np.asarray(self.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _hold(self, s: str, ids: bytes) -> None:
        self.held += _ENTRY + len(s) + len(ids)
        if self.held > KEPT_BYTES:
            self.clear()
            self.pieces.clear()
            self.held = 0

    def _hold(self, s: str, ids: bytes) -> None:
        self.held += _ENTRY + len(s) + len(ids)
        if self.held > KEPT_BYTES:
            self.clear()
            self.pieces.clear()
            self.held = 0

    def chunk(self, s: str) -> bytes:
        if s.isascii():
            if s.isalpha():
                return self.piece(s.lower())
            if s[:-1].isalpha() and s[-1] in ".,:;?!":
                return self.piece(s[:-1].lower()) + self.piece(s[-1])
        if not s:
            return b""
        if self.plain(s) and "<|" not in s:
            return b"".join(map(self.piece, self.cut(s.lower())))
        return self.encode(s)

    def piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            # what the byte-level pre-tokenizer hands to the model: one character per byte
            seen = p if p.isascii() else p.encode().decode("latin-1").translate(self.byte_chars)
            found = [t.id for t in self.model.tokenize(seen)]
            ids = struct.pack(f"<{len(found)}I", *found)
            self._hold(p, ids)
            self.pieces[p] = ids
        return ids

    def look_up(self, chunks: list[str], counts: np.ndarray) -> list[bytes]:
        """The ids of distinct chunks; those that recur are remembered."""
        out = list(map(self.get, chunks))
        for i, (ids, n) in enumerate(zip(out, counts.tolist())):
            if ids is None:
                s = chunks[i]
                ids = out[i] = self.chunk(s)
                if n > 1 and not (s.isascii() and s.isalpha()):  # else a piece, remembered as such
                    self._hold(s, ids)
                    self[s] = ids
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, END_ID after each, and where each text's
        begin.  Only distinct chunks are looked up; their ids are gathered by offset."""
        texts = pa.concat_arrays([texts.cast(pa.large_string())]).fill_null("")
        _, offsets, data = texts.buffers()
        data = _BLANKS[np.frombuffer(data or b"", np.uint8)]
        chunks = pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(data), offset=texts.offset), " ")
        coded = chunks.flatten().dictionary_encode()
        at = np.asarray(coded.indices)
        known = self.look_up(coded.dictionary.to_pylist(), np.bincount(at, minlength=len(coded.dictionary)))
        ids = np.frombuffer(b"".join(known), "<u4")
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(length) - length
        n = length[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        per_text = ends[np.asarray(chunks.offsets)]  # ids before each text
        starts = per_text + np.arange(len(per_text))  # an end id after each text before
        out = np.full(starts[-1], END_ID, "<u4")
        small = np.int32 if starts[-1] < 1 << 31 else np.int64
        order = np.arange(ends[-1], dtype=small)
        source = np.repeat((begin[at] - ends[:-1]).astype(small), n)
        source += order
        found = ids[source]
        del source, at, n
        order += np.repeat(np.arange(len(texts), dtype=small), np.diff(per_text))
        out[order] = found
        return out, starts


_encoders: dict[str, ChunkIds] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32); ids are little-endian
    unsigned 32-bit token ids."""
    step = capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = ChunkIds(tokenizer)
        enc = _encoders[tokenizer]
        for b in small_batches(batches, 1, SLICE_BYTES):
            ids, starts = enc.encode_all(b.column(1))
            out = []
            for doc_id, x, y in zip(b.column(0).to_pylist(), starts[:-1], starts[1:]):
                for i, at in enumerate(range(x, y, step)):
                    part = ids[at : min(at + step, y)].tobytes()
                    out.append((doc_id, i, at - x, len(part) // 4, part, zlib.crc32(part)))
            yield _pieces_batch(out)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"])


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): the pieces of
    a length with these ranks go, one each, into consecutive sequences, at the
    same offset.  Work and size depend on the number of lengths only."""
    left = {k: v for k, v in counts.items() if v > 0}
    next_rank = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # room left -> runs of bins [first, how many]
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        plan.append((length, next_rank[length], n, first, offset))
        next_rank[length] += n
        left[length] -= n

    def open_bins(n: int) -> int:
        nonlocal bins
        bins += n
        return bins - n

    def room(first: int, n: int, gap: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append([first, n])

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= a and x + a <= capacity and left[x] >= 1 + (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            first = open_bins(n)
            put(a, n, first, 0)
            if b is not None:
                put(b, n, first, a)
            room(first, n, capacity - a - (b or 0))
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            g = min((x for x in gaps if x >= s), default=None)
            if g is None:
                first = open_bins(n := max(1, left[s] // (capacity // s)))
                room(first, n, capacity)
                g = capacity
            run = gaps[g][-1]
            n = min(left[s], run[1])
            put(s, n, run[0] + run[1] - n, capacity - g)
            run[1] -= n
            room(run[0] + run[1], n, g - s)
            if not run[1]:
                gaps[g].remove(run)
            if not gaps[g]:
                del gaps[g]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to staged pieces (with a `length`)."""
    spark = pieces.sparkSession
    counts = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = packing_plan(counts, capacity)
    by_length: dict[int, list[tuple]] = {length: [] for length in counts}
    for length, *run in plan:
        by_length[length].append(tuple(run))
    arrays = {k: np.array(sorted(v), np.int64).reshape(-1, 4) for k, v in by_length.items()}
    known = spark.sparkContext.broadcast(arrays)

    # the rank of a piece among those of its length: groups are numbered apart and shifted by the groups before
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_GROUPS)).alias("g")
    keyed = pieces.select("*", group)
    before = (keyed.groupBy("length", "g").agg(F.count("*").alias("n"))
              .withColumn("shift", F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n"))
              .select("length", "g", "shift"))
    w = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("r", F.row_number().over(w) - 1).join(before, ["length", "g"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd
        seq = np.empty(len(length), np.int64)
        off = np.empty(len(length), np.int64)
        ls, rs = length.to_numpy(), rank.to_numpy()
        for k in np.unique(ls):
            at = np.flatnonzero(ls == k)
            runs = known.value[int(k)]
            i = np.searchsorted(runs[:, 0], rs[at], side="right") - 1
            seq[at] = runs[i, 2] + rs[at] - runs[i, 0]
            off[at] = runs[i, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return (ranked.withColumn("at", place(F.col("length"), (F.col("r") + F.col("shift")).cast("long")))
            .select(*pieces.columns, "at.sequence_id", "at.offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Packed pieces with their token ids: (doc_id, piece, start, length, ids,
    ids_crc32, sequence_id, offset)."""
    return pack(stage(token_pieces(docs, tokenizer or tokenizer_path(), capacity, id_col, text_col)), capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")
