"""Aligning predicted label lists with the truth.

Two modes:

* ``padded``: the shorter list is padded with ``MISSING``.
* ``adjusted``: up to ``cap`` gaps (``MISSING``) are inserted into the shorter
  list at the positions that maximise the number of matches (a null truth
  always matches); ties go to the smallest index combination; the rest is
  padded.

Inserting gaps at ascending positions ``i_1 < ... < i_k`` makes position ``j``
of the long list face ``short[j - #{i < j}]``, or ``MISSING`` when ``j`` is a
gap or past the end.  With ``M_h[j]`` = match of ``long[j]`` against the short
list shifted by ``h`` and ``G[j]`` = match against a gap, the score separates
into ``P_k[n] + sum_h C_h[i_h]`` with ``C_h[j] = P_{h-1}[j] + G[j] - P_h[j+1]``
(``P_h`` prefix sums of ``M_h``).  One left-to-right pass keeps, per layer,
the best partial sum and its first index tuple, so the whole search is
O(n * cap) per table and runs as higher-order-function expressions on the
row that already holds both lists: no explode, no shuffle, no candidate pairs.

The work is staged in separate projections (match table, then gaps, then
pairs) so no array expression is re-evaluated inside a lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.constants import ADJUST_UP_TO, MISSING

_NEG = -(10 ** 9)
_EMPTY_INTS = "array<int>"


def _at(arr: Column, x: Column, size: Column) -> Column:
    """``arr[x]`` when ``0 <= x < size``, else ``MISSING`` (a null item stays null)."""
    return F.when((x >= 0) & (x < size), F.get(arr, x)).otherwise(F.lit(MISSING))


def _match(truth: Column, a: Column, b: Column) -> Column:
    return F.when(truth.isNull() | a.eqNullSafe(b), 1).otherwise(0)


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(_EMPTY_INTS))


def with_gaps(df: DataFrame, truth: str = "true_types", pred: str = "pred_types",
              cap: int = ADJUST_UP_TO, out: str = "gaps") -> DataFrame:
    """Add ``out`` = best gap positions (ascending ARRAY<INT>) for the shorter list;
    empty when the lengths are equal or ``cap`` is 0."""
    if cap <= 0:
        return df.withColumn(out, F.array().cast(_EMPTY_INTS))
    t, p = F.col(truth), F.col(pred)
    nt, np_ = F.size(t), F.size(p)
    def cells(long: Column, short: Column, size: Column, truth_long: bool) -> Column:
        def cell(lv: Column, j: Column) -> Column:
            at = [_at(short, j - h if h else j, size) for h in range(cap + 1)] + [F.lit(MISSING)]
            names = [f"m{h}" for h in range(cap + 1)] + ["g"]
            return F.struct(*[_match(lv if truth_long else sv, lv, sv).alias(c) for c, sv in zip(names, at)])
        return F.transform(long, cell)

    staged = df.withColumn("__k", F.least(F.abs(nt - np_), F.lit(cap)))
    staged = staged.withColumn("__cells", F.when(F.col("__k") > 0, F.when(nt >= np_, cells(t, p, np_, True)).otherwise(cells(p, t, nt, False))))

    init = F.struct(*([F.lit(0).alias("j")]
                      + [F.lit(0).alias(f"p{h}") for h in range(cap + 1)]
                      + [F.lit(_NEG).alias(f"b{h}") for h in range(1, cap + 1)]
                      + [F.array().cast(_EMPTY_INTS).alias(f"i{h}") for h in range(1, cap + 1)]))

    def step(acc: Column, x: Column) -> Column:
        j = acc["j"]
        fields = [(j + 1).alias("j")] + [(acc[f"p{h}"] + x[f"m{h}"]).alias(f"p{h}") for h in range(cap + 1)]
        bests, tuples = [], []
        for h in range(1, cap + 1):
            cand = ((F.lit(0) if h == 1 else acc[f"b{h - 1}"])
                    + acc[f"p{h - 1}"] + x["g"] - acc[f"p{h}"] - x[f"m{h}"])
            better = cand > acc[f"b{h}"]
            if h > 1:
                better = better & (acc[f"b{h - 1}"] > F.lit(_NEG))
            prev = F.array().cast(_EMPTY_INTS) if h == 1 else acc[f"i{h - 1}"]
            bests.append(F.when(better, cand).otherwise(acc[f"b{h}"]).alias(f"b{h}"))
            tuples.append(F.when(better, F.concat(prev, F.array(j))).otherwise(acc[f"i{h}"]).alias(f"i{h}"))
        return F.struct(*(fields + bests + tuples))

    staged = staged.withColumn("__best", F.aggregate(F.col("__cells"), init, step))
    pick = F.array().cast(_EMPTY_INTS)
    for h in range(cap, 0, -1):
        pick = F.when(F.col("__k") == h, F.col("__best")[f"i{h}"]).otherwise(pick)
    return staged.withColumn(out, pick).drop("__k", "__cells", "__best")


def with_pairs(df: DataFrame, truth: str = "true_types", pred: str = "pred_types",
               data_types: str = "data_types", gaps: str | None = "gaps", out: str = "pairs") -> DataFrame:
    """Add ``out`` = ARRAY<STRUCT<idx, true_type, pred_type, data_type>> after
    inserting ``gaps`` into the shorter list and padding both to the longer
    length (``gaps=None`` pads only)."""
    t, p, d = F.col(truth), F.col(pred), F.col(data_types)
    nt, np_ = F.size(t), F.size(p)
    n = F.greatest(nt, np_)

    def item(j: Column, true: Column, pred: Column, data: Column) -> Column:
        return F.struct(j.alias("idx"), true.alias("true_type"), pred.alias("pred_type"), data.alias("data_type"))

    padded = F.transform(_positions(n), lambda j: item(j, _at(t, j, nt), _at(p, j, np_), _at(d, j, nt)))
    if gaps is None:
        return df.withColumn(out, padded)
    g = F.col(gaps)
    # the short list's position at each place, once for all its columns; the long list stands as it is
    at = F.transform(_positions(n), lambda j: F.when(F.array_contains(g, j), F.lit(-1)).otherwise(j - F.size(F.filter(g, lambda x: x < j))))
    gapped = F.when(nt < np_, F.transform(at, lambda s, j: item(j, _at(t, s, nt), F.get(p, j), _at(d, s, nt)))) \
              .otherwise(F.transform(at, lambda s, j: item(j, F.get(t, j), _at(p, s, np_), F.get(d, j))))
    return df.withColumn(out, F.when(F.size(g) > 0, gapped).otherwise(padded))


def align(df: DataFrame, mode: str = "padded", cap: int = ADJUST_UP_TO, out: str = "pairs") -> DataFrame:
    """Add ``out``, the pairs for ``mode`` in (``padded``, ``adjusted``)."""
    if mode == "padded":
        return with_pairs(df, gaps=None, out=out)
    return with_pairs(with_gaps(df, cap=cap), out=out)
