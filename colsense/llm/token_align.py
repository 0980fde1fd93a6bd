"""Cross-tokenizer alignment in Arrow (operator 12).

Texts are cut into tokens by two tokenizers, A (byte-level BPE, a space put
before the text) and B (pieces, which puts that space itself).  Inside a task a
slice of documents is a handful of Arrow columns: id lists are flattened with
their parent indices, byte lengths summed up and restarted at each document, and
a full outer Acero join on (document, byte end) brings the ends of A and B
together.  Sorted by that key, a row is one stretch of bytes between neighbouring
ends, so it is one link, an overlapping pair of an A and a B token: the missing
id of a row is the next one of its column.  Rows with both ends are the groups'
borders.

Documents are read in chunks (CHUNK_BYTES of text, or one longer document).
Table.group_by counts each chunk's id pairs, Spark merges the counts of all
chunks, and every chunk gets back the counts of its own distinct pairs only, so
a task never holds the pairs of the corpus.  The highest count of each B id is a
table of at most B's vocabulary, the only broadcast.  Pairs that all chunks hold
make one short row a chunk; no key gathers links.

Cases: null and empty texts, and those whose joined A or B bytes differ from
space + text (B normalises some, or writes its blank mark as a space), have no
tokens: zeros and an empty digest.  Specials' names inside texts are plain text.
A null id is carried through, repeated rows count each, an empty table gives no
rows, other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a chunk, and of a slice that is tokenised at once (or one longer document).
CHUNK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
CHUNK_ROWS = 20_000
#: Pairs in one row of a chunk's counts.
PAIRS_A_ROW = 1 << 15

_LINKED = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "links array<long>, cuts array<int>, pairs array<long>, counts array<long>")
_NAMES = [c.split()[0] for c in _LINKED.split(", ")]


def _path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _ranked(path: str, ids: dict[bytes, int]):
    """The same byte-level BPE by ranks, which is faster and gives the same ids;
    None unless the file's merges stand in the order of their results' ids."""
    import json

    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec["added_tokens"]}
    merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or merged != sorted(merged) or len(merged) + 256 + len(special) != len(ids):
        return None
    ranks = {x: i for x, i in ids.items() if x.decode("utf-8", "replace") not in special}
    return tiktoken.Encoding("by-ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Both tokenizers, their tokens' bytes and the texts of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their names in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # byte-level alphabet: the byte itself where it is a visible Latin-1 character, else the next unused one from U+0100
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [x for x in range(256) if x not in shown]
        byte_of = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(hidden)}
        a_size = max(self.a.get_vocab().values()) + 1
        a_bytes = [b""] * a_size
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        b_size = self.b.get_piece_size()
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                   for i in range(b_size)]
        self.ranked = _ranked(a_path, {x: i for i, x in enumerate(a_bytes) if x})
        self.sizes = a_size, b_size
        self.bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.lengths = tuple(pc.binary_length(x).cast(pa.int64()) for x in self.bytes)
        #: "<id>," and, for a group's last token, "<id>|" of A and "<id>;" of B
        self.shown = pa.array([f"{i}{end}" for n, last in ((a_size, "|"), (b_size, ";")) for end in (",", last) for i in range(n)], pa.large_string())

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        spaced = [" " + t for t in texts]
        if self.ranked:
            a = [self.ranked.encode_ordinary(t) for t in spaced]
        else:
            a = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        kind = pa.large_list(pa.int64())
        return pa.array(a, kind), pa.array(b, kind)


def _matching(lists: pa.LargeListArray, token_bytes: pa.Array, want: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each list's tokens are the wanted ones."""
    flat = pc.take(token_bytes, lists.flatten())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[np.asarray(lists.offsets)]
    data = data.to_pybytes() if data else b""
    return np.fromiter((data[x:y] == w for x, y, w in zip(at[:-1], at[1:], want)), bool, len(want))


def _ends(lists: pa.LargeListArray, lengths: pa.Array, name: str) -> pa.Table:
    """(key, id) of each token; key is its document's index and its byte end there."""
    ids = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(lengths, ids))
    first = np.asarray(lists.offsets)[:-1]
    before = np.where(first > 0, np.asarray(total)[np.maximum(first, 1) - 1], 0) if len(ids) else np.zeros(len(first), np.int64)
    end = pc.subtract(total, pc.take(pa.array(before), parent))
    return pa.table({"key": pc.bit_wise_or(pc.shift_left(parent, 32), end), name: ids})


def aligned(texts: list[str], tok: Tokenizers) -> tuple[np.ndarray, dict, pa.Table]:
    """Which texts have tokens; for those n_a, n_b, n_groups, n_links, the digest
    and the groups' byte ends; and their links (doc, pair) in order, where pair
    is A's id times B's size plus B's id and doc counts texts with tokens."""
    a, b = tok.encode(texts)
    want = [b" " + t.encode() for t in texts]
    ok = _matching(a, tok.bytes[0], want) & _matching(b, tok.bytes[1], want)
    a, b = a.filter(pa.array(ok)), b.filter(pa.array(ok))
    n = int(ok.sum())
    both = (_ends(a, tok.lengths[0], "a").join(_ends(b, tok.lengths[1], "b"), "key", join_type="full outer", use_threads=False)
            .sort_by("key").combine_chunks())
    key = both["key"].combine_chunks() if both.num_rows else pa.array([], pa.int64())
    ids_a, ids_b = (both[c].combine_chunks() if both.num_rows else pa.array([], pa.int64()) for c in ("a", "b"))
    doc = np.asarray(pc.shift_right(key, 32))
    has_a, has_b = np.asarray(pc.is_valid(ids_a)).astype(bool), np.asarray(pc.is_valid(ids_b)).astype(bool)
    border = has_a & has_b
    pair = pc.add(pc.multiply(pc.fill_null_backward(ids_a), tok.sizes[1]), pc.fill_null_backward(ids_b))

    # ids of each group, A's before B's: a token moves behind the other column's tokens that go first
    group = np.cumsum(border) - border
    group_a, group_b = group[has_a], group[has_b]
    place_a = np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")
    order = np.empty(len(place_a) + len(place_b), np.int64)
    order[place_a] = np.asarray(pc.drop_null(ids_a)) + border[has_a] * tok.sizes[0]
    order[place_b] = np.asarray(pc.drop_null(ids_b)) + border[has_b] * tok.sizes[1] + 2 * tok.sizes[0]
    shown = pc.take(tok.shown, pa.array(order))
    _, offsets, data = shown.buffers()
    n_a, n_b, n_groups, n_links = (np.bincount(doc, w, minlength=n).astype(np.int64) for w in (has_a, has_b, border, np.ones(len(doc))))
    at = np.frombuffer(offsets, np.int64)[np.concatenate([[0], np.cumsum(n_a + n_b)])] if n else np.zeros(1, np.int64)
    data = memoryview(data or b"")
    digest = [hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip(at[:-1], at[1:])]
    cuts = (doc[border], (np.asarray(key) & 0xFFFFFFFF)[border])
    return ok, {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "digest": digest, "cuts": cuts}, pa.table({"doc": doc, "pair": pair})


def _batch(n: int, **cols) -> pa.RecordBatch:
    """Rows of _LINKED with the given columns, others null."""
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, k) for c, k in zip(_NAMES, kinds)], names=_NAMES)


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def _align_partition(paths: tuple[str, str], spans: bool):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                if texts and held + len(t) > SLICE_BYTES:
                    yield ids, texts
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield ids, texts

    def lists(parts: np.ndarray, values: pa.Array, n: int, kind: pa.DataType) -> pa.ListArray:
        at = np.concatenate([[0], np.cumsum(np.bincount(parts, minlength=n))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values.cast(kind))

    def counted(chunk: int, partial: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(partial).group_by("pair", use_threads=False).aggregate([("n", "sum")]) if partial else None
        for i in range(0, t.num_rows if t else 0, PAIRS_A_ROW):
            part = t.slice(i, PAIRS_A_ROW).combine_chunks()
            at = pa.array([0, part.num_rows], pa.int32())
            yield _batch(1, chunk=pa.array([chunk]), pairs=pa.ListArray.from_arrays(at, part["pair"].combine_chunks()),
                         counts=pa.ListArray.from_arrays(at, part["n_sum"].combine_chunks().cast(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _tokenizers:
            _tokenizers[paths] = Tokenizers(*paths)
        tok = _tokenizers[paths]
        chunk = TaskContext.get().partitionId() << 33
        partial: list[pa.Table] = []
        size = rows = 0
        for ids, texts in slices(batches):
            length = sum(map(len, texts))
            if rows and (size + length > CHUNK_BYTES or rows + len(texts) > CHUNK_ROWS):
                yield from counted(chunk, partial)
                chunk, partial, size, rows = chunk + 1, [], 0, 0
            size, rows = size + length, rows + len(texts)
            filled = [i for i, t in enumerate(texts) if t]
            ok, found, links = aligned([texts[i] for i in filled], tok) if filled else (np.empty(0, bool), None, None)
            n = len(texts)
            if found is not None:
                at = np.array(filled, np.int64)[ok]
                spread = lambda x: pa.array(np.bincount(at, x, minlength=n).astype(np.int64))  # noqa: B023, E731
                digest = np.full(n, "", object)
                digest[at] = found["digest"]
                cols = {c: spread(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")}
                cols["links"] = lists(at[np.asarray(links["doc"])], links["pair"].combine_chunks(), n, pa.int64())
                if spans:
                    doc, end = found["cuts"]
                    cols["cuts"] = lists(at[doc], pa.array(end), n, pa.int32())
                partial.append(links.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]))
            else:
                cols = {c: pa.array(np.zeros(n, np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")}
                digest = [""] * n
            yield _batch(n, chunk=pa.array(np.full(n, chunk)), doc_id=pa.array(ids, pa.int64()), groups_sha256=pa.array(digest, pa.string()), **cols)
        yield from counted(chunk, partial)

    return run


@dataclass
class Alignment:
    """documents: a row for each, with its links (A's id times b_size plus B's)
    and, where asked for, the byte ends of its groups.  pairs: (pair, n) over all
    documents, with `best` where no pair of that B id has more links."""

    documents: DataFrame
    asked: DataFrame
    pairs: DataFrame
    b_size: int

    def scored(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
        replies = self.asked.select("chunk", "pair").join(self.pairs, "pair").select(F.col("chunk").alias("asking"), "pair", "n", "best")

        def look_up(docs: pa.Table, known: pa.Table) -> pa.Table:
            lists = pa.concat_arrays([x.cast(pa.large_list(pa.int64())) for x in docs["links"].chunks])
            parent, at = pc.list_parent_indices(lists), pc.index_in(pc.list_flatten(lists), value_set=known["pair"])
            links = pa.table({"doc": parent, "n": pc.take(known["n"], at), "best": pc.take(known["best"], at).cast(pa.int64())})
            sums = links.group_by("doc", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
            out = {c: np.zeros(docs.num_rows, np.int64) for c in ("best", "n")}
            for c, x in out.items():
                x[np.asarray(sums["doc"])] = np.asarray(sums[f"{c}_sum"])
            return pa.table({c: docs[c] for c in _NAMES[1:6]} | {"n_best": out["best"], "count_sum": out["n"], "groups_sha256": docs["groups_sha256"]})

        return (self.documents.select(*_NAMES[:8]).groupBy("chunk").cogroup(replies.groupBy("asking"))
                .applyInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                    spans: bool = False) -> Alignment:
    """Aligns the texts of all rows; spans keeps the byte ends of the groups."""
    paths = a_path or _path(A_FILE), b_path or _path(B_FILE)
    import sentencepiece
    b_size = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(src.mapInArrow(_align_partition(paths, spans), _LINKED))
    asked = (rows.where("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
             .select("chunk", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n")))
    counts = stage(asked.groupBy("pair").agg(F.sum("n").alias("n")))
    b_id = F.expr(f"pair % {b_size}")
    top = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))  # at most B's vocabulary
    pairs = counts.withColumn("b", b_id).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return Alignment(rows.where("pairs IS NULL").drop("pairs", "counts"), asked, pairs, b_size)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents")).scored()
