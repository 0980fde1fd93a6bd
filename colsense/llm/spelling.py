"""Spelling variant grouping by a bit-sliced position index (operator 11).

Words are counted over whole texts (in a task by document, then by Spark).  Two
words are near if one inserted, deleted or replaced letter apart.  Around that
letter they agree, so with a shorter length of m they share their first m // 2
letters or their last m - m // 2: each word goes to the buckets of these two
affixes, for m its own length and one less.  A pair is found in the bucket of
its first letters if it shares them, else in the other one, so once.

A task reads a block of buckets and indexes its words bit by bit: for every
position and letter a bitset says which words have that letter there.  Queries
walk their letters, many at a time, and carry bitsets over all words of the
block: Z those that agree so far, and the one-error sets S (a letter replaced),
I (one inserted, index shifted on) and D (one deleted, index shifted back), each
fed from Z:

    S = S & B[i] | Z & ~B[i]     I = I & B[i+1] | Z & B[i]     D = D & B[i-1] | Z

Words stand in order of (count, word), so the first set bit is the form.

Blocks hold about BLOCK_LETTERS letters.  A bucket over TILE_LETTERS is cut into
tiles by a hash of the word, and every two tiles meet in a block of their own, so
no task holds a whole large bucket; such a bucket's words are copied once for
each of its tiles.  Forms are followed to the root by squaring the pointers; a
form has RATIO times its word's count, so the number of rounds is known.

Cases: null and empty texts have no words; a null id counts as the empty text;
repeated rows count each; words of any length; no words give no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_groups, stage, table, texts_of

RUN = r"[a-zÀ-ÿ]"
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One of so many (document, run) pairs, by crc32, loses a letter before it counts.
DROP_MOD = 199
BLOCK_LETTERS, TILE_LETTERS = 1 << 16, 1 << 16
#: Words of a task's partial counts, and queries that walk together.
HELD_WORDS, TOGETHER = 200_000, 512

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT, drop_mod: int | None = DROP_MOD) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased, after the dropping rule."""
    find = re.compile(f"{RUN}{{{min_letters},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(texts_of(b, 0), texts_of(b, 1)):
                if not text:
                    continue
                start = zlib.crc32((doc_id or b"") + b":")
                for w, n in Counter(find(text.translate(_LOWER).decode())).items():
                    if drop_mod and not (h := zlib.crc32(w.encode(), start)) % drop_mod:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < min_letters:
                            continue
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield out()
                    held = {}
        yield out()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _blocks(words: DataFrame, min_letters: int) -> DataFrame:
    """(block, own, seek, side, m, word, n): each word in its buckets; a word
    looks for those whose `own` is its `seek`."""
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= min_letters)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("left(word, cast(m div 2 as int))").alias("affix")),
                    F.struct(F.lit(1).alias("side"), F.expr("right(word, cast(m - m div 2 as int))").alias("affix")))
    members = (words.select("word", "n", F.explode(lengths).alias("m")).withColumn("b", F.explode(sides))
               .select("word", "n", "m", "b.side", F.concat_ws(":", "b.side", "m", "b.affix").alias("bucket")))
    large = (members.groupBy("bucket").agg(F.sum(F.length("word")).alias("letters")).where(F.col("letters") > TILE_LETTERS)
             .select("bucket", F.ceil(F.col("letters") / TILE_LETTERS).cast("int").alias("tiles")))
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    n_blocks = 4 * letters // BLOCK_LETTERS + 1
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    small = F.concat(F.lit("b"), F.pmod(F.xxhash64("bucket"), F.lit(n_blocks)).cast("string"))
    pair = F.concat_ws("#", "bucket", F.least("tile", "other"), F.greatest("tile", "other"))
    name = lambda c: F.when(F.col("tiles").isNull(), F.col("bucket")).otherwise(F.concat_ws("#", "bucket", c))
    return (members.join(large, "bucket", "left").withColumn("tile", tile)
            .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
            .select(F.when(F.col("tiles").isNull(), small).otherwise(pair).alias("block"), name("tile").alias("own"), name("other").alias("seek"),
                    "side", "m", "word", "n"))


def _bits(mask: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, lowest bit first."""
    packed = np.packbits(mask, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class PositionIndex:
    """Bitsets over words (a fixed-width array of code points, 0 behind the
    end): for a position, which words have a letter there."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.width = (len(codes) + 63) // 64
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """A bitset for each letter."""
        if not 0 <= position < self.codes.shape[1]:
            return np.zeros((len(letters), self.width), np.uint64)
        if position not in self.kept:
            here = self.codes[:, position]
            known = np.unique(here)
            self.kept[position] = known, np.vstack([_bits(known[:, None] == here), np.zeros((1, self.width), np.uint64)])
            self.kept.pop(position - 3, None)
        known, sets = self.kept[position]
        i = np.searchsorted(known, letters)
        i[(i == len(known)) | (known[np.minimum(i, len(known) - 1)] != letters)] = len(known)
        return sets[i]


def near_sets(codes: np.ndarray, m: int, own: np.ndarray, seek: np.ndarray, last_half: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) index pairs of near words of lengths m and m + 1 whose own
    is the query's seek, in order; last_half: without those that share their
    first m // 2 letters."""
    longer = codes[:, m] != 0 if codes.shape[1] > m else np.zeros(len(codes), bool)
    short, long = _bits(~longer[None])[0], _bits(longer[None])[0]
    for is_long, length in ((False, m), (True, m + 1)):
        queries = np.flatnonzero(longer == is_long)
        for x in range(0, len(queries), TOGETHER):
            q = queries[x : x + TOGETHER]
            index = PositionIndex(codes)
            zero = _bits(seek[q][:, None] == own)
            one, inserted, deleted = np.zeros_like(zero), zero, np.zeros_like(zero)
            for i in range(length):
                letters = codes[q, i]
                here = index.at(i, letters)
                if is_long:
                    deleted = deleted & index.at(i - 1, letters) | zero
                else:
                    one = one & here | zero & ~here
                zero = zero & here
                if not is_long:
                    inserted = inserted & index.at(i + 1, letters) | zero
                if i + 1 == m // 2:
                    same_start = zero
            near = deleted & short if is_long else one & short | inserted & long
            if last_half:
                near &= ~same_start
            row, word = np.nonzero(near)
            if len(row):
                hit, bit = np.nonzero(np.unpackbits(near[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield q[row[hit]], word[hit] * 64 + bit


def _near_in_block(g: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """For the words of a block that have near ones there: how many, and the
    first by count and word."""
    kind = g["m"].astype(np.int64) * 2 + g["side"]
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        m, side = divmod(int(k), 2)
        words = g["word"][at].astype(str)
        order = np.lexsort((words, -g["n"][at]))
        at, words = at[order], np.ascontiguousarray(words[order])
        codes = words.view(np.uint32).reshape(len(words), -1)
        _, name = np.unique(np.concatenate([g["own"][at], g["seek"][at]]).astype(str), return_inverse=True)
        own, seek = name[: len(at)], name[len(at) :]
        for query, found in near_sets(codes, m, own, seek, side == 1):
            asked, first, count = np.unique(query, return_index=True, return_counts=True)
            best = at[found[first]]
            yield {"word": g["word"][at[asked]], "n_near": count.astype(np.int64), "best_n": g["n"][best], "best": g["word"][best]}


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n, n_near, best, best_n): how many near words each word has, and
    the one of largest n, ties by code points."""
    found = map_groups(_blocks(words, min_letters), ["block"], _near_in_block, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.col("b.word").alias("best"), (-F.col("b.minus")).alias("best_n"))


def spelling_forms(words: DataFrame, min_letters: int = MIN_LETTERS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n)."""
    if ratio < 2:
        raise ValueError("a form must have at least twice its word's count")
    words = stage(words)
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = stage(near_words(words, min_letters).select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"),
                                                       F.when(is_form, F.col("best_n")).alias("form_n")))
    up = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    span = rows.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = math.log(max((span.most or 1) / max(span.least or 1, 1), 1), ratio) + 1  # forms that can follow each other
    for _ in range(math.ceil(math.log2(steps + 1))):
        nxt = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stage(up.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_forms(word_counts(table(spark, sf_dir, "documents")))


#: crc32 by table, byte by byte; near words by the texts that a deletion leaves (the same place for a replaced letter).
OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT range AS i FROM range(256))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per_document AS (
  SELECT doc_id, run, COUNT(*) AS n, hex(encode(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM runs WHERE length(run) >= {MIN_LETTERS} GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
           lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) AS h
  FROM per_document, crc_table),
words AS (
  SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {DROP_MOD} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {MIN_LETTERS} GROUP BY 1 HAVING SUM(n) >= {MIN_COUNT}),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cuts a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word, a.n FROM cuts a JOIN words w ON a.rest = w.word),
ranked AS (
  SELECT word, other, other_n, COUNT(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM near),
forms AS (
  SELECT w.word, w.n, CAST(COALESCE(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form,
         CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked ON ranked.word = w.word AND r = 1),
followed AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT f.word, f.next, g.form FROM followed f JOIN forms g ON g.word = f.next)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM followed WHERE next IS NULL) USING (word)
"""
