"""Line dedup by a log-template tree (operator 6).

Each line goes down a tree of fixed depth: its number of tokens, then its first
LEADING tokens, tokens with a digit standing as <*>.  In a leaf that MIN_DOCS
documents reach, the lines with a token at its position are counted.  Of a
line's tokens after the leading ones, the most frequent FIXED_SHARE, ties
included, are *fixed*, the others variable; its template is the leaf and its
fixed tokens with <*> for the rest.  As frequencies are only compared within a
line, a variable field stays one however many lines there are and however often
its values repeat.  Templates that stand in at least MIN_DOCS documents are
recurring ones, and their lines are dropped; equal lines have equal templates.

A template speaks for lines that differ only if at least two of its tokens, and
LITERAL_SHARE of the line's, are words that stand (not <*>): rows of numbers,
dates or prices are not copies of each other.  Other lines count as they stand,
digits included.  The leading tokens are the tree's path, so a field among them
that varies by words is never generalised: "by <name> for the city desk" recurs
once for each name that recurs (of 30 such lines with 30 names none goes, with
the same field behind the third token all do).

Recurring lines go from every document, however little it has besides.  Copies
must not erase each other: documents with the same set of lines (white space
around and within lines evened out) count as one,
and of the documents of which more than COPY_SHARE of the words stand on
recurring lines, one (the smallest hash of its set) keeps a template's lines.

Lines are counted as small hash rows; the texts are read twice for them (leaves,
then the tokens of lines in leaves that recur, found by a filter of fixed size)
and shuffled once, to meet the numbers of their dropped lines.  Every count is
a map-side combined sum or a count of distinct (key, document) pairs, so a line
that a third of all documents share never comes together in one task.

Cases: a null text stays null, an empty one empty; blank lines and lines below
MIN_TOKENS tokens stay and never count; rows with equal texts count as one
document and share its fate, whatever their ids, null ids too; an empty table gives no rows; other columns pass
through (names beginning with _ld_ are reserved).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, key_filter, lean, small_batches, stage, table, texts_of

LEADING = 3
MIN_DOCS = 3
FIXED_SHARE = 0.7
LITERAL_SHARE = 0.5
COPY_SHARE = 0.5
MIN_TOKENS = 3
VARIABLE = b"<*>"
_has_digit = re.compile(rb"[0-9]").search
_hash = xxhash.xxh3_64_intdigest
#: Distinct lines whose tokens a task holds at once.
HELD_LINES = 50_000


def _longs(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def _masked(tokens: list[bytes]) -> list[bytes]:
    return [VARIABLE if _has_digit(w) else w for w in tokens]


def _leaf(tokens: list[bytes]) -> int:
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:LEADING]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    # 128 bits: rows that fall together would lose each other's lines
    return docs.withColumn("_ld_row", F.unhex(F.md5(F.to_json(F.struct(F.col(id_col).cast("string").alias("i"), text.alias("t"))).cast("binary"))))


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 1, 8 << 20):
        row, body, total, no, leaf, line, raw, words = [], [], [], [], [], [], [], []
        for r, t in zip(b.column(0).to_pylist(), texts_of(b, 1)):
            standing = set()  # of the text's lines, white space evened out
            before = len(no)
            for n, x in enumerate(t.split(b"\n") if t else ()):
                tokens = x.split()
                if not tokens:
                    continue
                h = _hash(b" ".join(tokens))
                standing.add(h)
                if len(tokens) < MIN_TOKENS:
                    continue
                raw.append(h)
                if _has_digit(x):
                    tokens = _masked(tokens)
                    h = _hash(b" ".join(tokens))
                no.append(n)
                leaf.append(_leaf(tokens))
                line.append(h)
                words.append(len(tokens))
            if k := len(no) - before:
                row += [r] * k
                body += [_hash(sum(standing).to_bytes(16, "little"))] * k
                total += [sum(words[before:])] * k
        yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.binary()), "body": _longs(body), "total": pa.array(total, pa.int64()),
                                          "no": pa.array(no, pa.int32()), "leaf": _longs(leaf), "line": _longs(line),
                                          "raw": _longs(raw), "words": pa.array(words, pa.int32())})


def _token_rows(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        found: dict[tuple[int, int], list] = {}

        def out() -> pa.RecordBatch:
            lists = [tokens for _, tokens in found.values()]
            ends = np.cumsum([0, *map(len, lists)])
            return pa.RecordBatch.from_pydict({
                "leaf": _longs([k[0] for k in found]), "line": _longs([k[1] for k in found]), "n": pa.array([n for n, _ in found.values()], pa.int64()),
                "tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs([_hash(w) for tokens in lists for w in tokens]))})

        for b in small_batches(batches, 0, 8 << 20):
            for t in texts_of(b, 0):
                lines = [(x, w) for x in (t.split(b"\n") if t else ()) if len(w := x.split()) >= MIN_TOKENS]
                masked = [_masked(w) if _has_digit(x) else w for x, w in lines]
                leaves = list(map(_leaf, masked))
                at = np.array(leaves, np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                passes = (bits.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                seen = set()
                for i in np.flatnonzero(passes).tolist():
                    key = leaves[i], _hash(b" ".join(masked[i]))
                    if key not in seen:
                        seen.add(key)
                        found.setdefault(key, [0, masked[i]])[0] += 1
            if len(found) > HELD_LINES:
                yield out()
                found = {}
        yield out()
    return run


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, nos): line numbers to drop from each row that loses any; row is the
    md5 of id and text."""
    spark = docs.sparkSession
    src = _keyed(docs, id_col, text_col).select("_ld_row", F.col(text_col).cast("string").alias("text"))
    lines = stage(src.mapInArrow(lean(_line_rows), "row binary, body long, total long, no int, leaf long, line long, raw long, words int"))
    leaves = stage(lines.select("leaf", "body").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"))
    known = spark.sparkContext.broadcast(key_filter(leaves, "leaf"))
    kinds = (src.select("text").mapInArrow(lean(_token_rows(known)), "leaf long, line long, n long, tokens array<long>")
             .groupBy("leaf", "line").agg(F.sum("n").alias("n"), F.first("tokens").alias("tokens"))
             .join(leaves, "leaf", "left_semi"))
    kinds = stage(kinds)
    at = kinds.select("leaf", "line", "n", F.posexplode("tokens").alias("pos", "token")).where(F.col("pos") >= LEADING)
    # a token of fewer than min_docs lines fixes no recurring template
    often = at.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("often")).where(F.col("often") >= min_docs)
    fixed = F.expr("element_at(sort_array(transform(tokens, x -> x.often), false), greatest(least_fixed, 1))")
    counted = (at.join(often, ["leaf", "pos", "token"]).groupBy("leaf", "line").agg(F.collect_list(F.struct("often", "pos", "token")).alias("tokens")))
    variable = _longs([_hash(VARIABLE)])[0].as_py()
    template = "coalesce(aggregate(filter(tokens, x -> x.often >= fixed), 0L, (s, x) -> s ^ xxhash64(x.pos, x.token)), 0L)"
    literal = f"literal + coalesce(size(filter(tokens, x -> x.often >= fixed AND x.token <> {variable}L)), 0)"
    templates = (kinds.select("leaf", "line", F.expr("size(tokens)").alias("length"),
                              F.expr(f"cast(ceil({FIXED_SHARE} * (size(tokens) - {LEADING})) as int)").alias("least_fixed"),
                              F.expr(f"size(filter(slice(tokens, 1, {LEADING}), x -> x <> {variable}L))").alias("literal"))
                 .join(counted, ["leaf", "line"], "left").where("least_fixed <= 0 or size(tokens) >= least_fixed")
                 .withColumn("fixed", F.when(F.col("least_fixed") > 0, fixed))
                 .select("leaf", "line", F.expr(template).alias("template"), F.expr(f"{literal} >= greatest(2, {LITERAL_SHARE} * length)").alias("speaks")))
    own = F.when(F.col("speaks"), F.col("template")).otherwise(F.col("raw")).alias("template")
    placed = stage(lines.join(templates, ["leaf", "line"]).select("row", "body", "total", "no", "words", "leaf", own))
    recurring = (placed.select("leaf", "template", "body").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs"))
                 .where(F.col("docs") >= min_docs).select("leaf", "template"))
    # rows of equal texts repeat (row, no)
    hits = stage(placed.join(recurring, ["leaf", "template"], "left_semi").distinct())
    heavy = (hits.groupBy("row").agg(F.sum("words").alias("hit_words"), F.first("total").alias("total"))
             .where(F.col("hit_words") > COPY_SHARE * F.col("total")).select("row"))
    kept_by = hits.join(heavy, "row", "left_semi").groupBy("leaf", "template").agg(F.min("body").alias("keeper"))
    return (hits.join(kept_by, ["leaf", "template"], "left").where("keeper is null or keeper <> body")
            .groupBy("row").agg(F.sort_array(F.collect_list("no")).alias("nos")))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their remaining lines as text, and _ld_dropped, the
    number of lines dropped."""
    lost = recurring_lines(docs, id_col, text_col, min_docs).toDF("_ld_row", "_ld_nos")
    kept = F.expr("array_join(transform(filter(transform(_ld_lines, (x, i) -> struct(x as x, i as i)), "
                  "s -> not array_contains(_ld_nos, s.i)), s -> s.x), '\n')")
    return (_keyed(docs, id_col, text_col).join(lost, "_ld_row", "left")
            .withColumn("_ld_lines", F.when(F.col("_ld_nos").isNotNull(), F.split(F.col(text_col).cast("string"), "\n", -1)))
            .withColumn(text_col, F.when(F.col("_ld_nos").isNull(), F.col(text_col)).otherwise(kept))
            .withColumn("_ld_dropped", F.coalesce(F.size("_ld_nos"), F.lit(0)))
            .drop("_ld_row", "_ld_lines", "_ld_nos"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_dropped): every document without its recurring lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "text", F.col("_ld_dropped").alias("n_dropped"))
