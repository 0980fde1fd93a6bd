"""Scoring: scored pairs, label counts, classification reports and their slices.

Per-label counts come from one pass over the pairs: equal (truth, prediction)
pairs are counted for every slice value at once (grouping sets, combined on the
map side), and each count emits its truth-side and its prediction-side row, which
``groupBy(mode, slice, slice_value, label)`` turns into ``(support, predicted,
tp)``.  The key space is pairs of labels x slice values, whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.constants import ADJUST_UP_TO, MISSING
from colsense.functions.numeric import decimal_text
from colsense.operators.align import align, with_gaps, with_pairs
from colsense.operators.annotate import vocabulary_array

SLICES = ("idx", "data_type", "sparsity", "num_columns")
ALL = "all"
MODES = ("padded", "adjusted")


def scored_pairs(evaluated: DataFrame, mode: str = "padded", cap: int = ADJUST_UP_TO) -> DataFrame:
    """Flatten to ``(mode, table_id, idx, true_type, pred_type, data_type, sparsity_tenths, num_columns)``.

    ``evaluated`` has ``table_id, true_types, data_types, pred_types, sparsity``.
    Positions with a null truth do not score and are dropped.
    """
    return (align(evaluated, mode, cap).select(
                F.lit(mode).alias("mode"), "table_id",
                F.size("true_types").alias("num_columns"),
                F.rint(F.col("sparsity") * 10).cast("int").alias("sparsity_tenths"),
                F.explode("pairs").alias("pair"))
            .select("mode", "table_id", "pair.idx", "pair.true_type", "pair.pred_type",
                    "pair.data_type", "sparsity_tenths", "num_columns")
            .where(F.col("true_type").isNotNull()))


def both_modes(evaluated: DataFrame, cap: int = ADJUST_UP_TO, keep: list[str] | None = None,
               modes: tuple[str, ...] = MODES) -> DataFrame:
    """Scored pairs of the wanted modes from a single pass over ``evaluated``;
    the gap search runs only when the adjusted mode is wanted."""
    staged, wanted = evaluated, []
    if "padded" in modes:
        staged = with_pairs(staged, gaps=None, out="pp")
        wanted.append(F.struct(F.lit("padded").alias("mode"), F.col("pp").alias("pairs")))
    if "adjusted" in modes:
        staged = with_pairs(with_gaps(staged, cap=cap), gaps="gaps", out="pa")
        wanted.append(F.struct(F.lit("adjusted").alias("mode"), F.col("pa").alias("pairs")))
    k = list(keep or [])
    return (staged.select("table_id", *k, F.size("true_types").alias("num_columns"),
                          F.rint(F.col("sparsity") * 10).cast("int").alias("sparsity_tenths"),
                          F.inline(F.array(*wanted)))
                  .select("mode", "table_id", *k, F.explode("pairs").alias("pair"), "sparsity_tenths",
                          "num_columns")
                  .select("mode", "table_id", *k, "pair.idx", "pair.true_type", "pair.pred_type",
                          "pair.data_type", "sparsity_tenths", "num_columns")
                  .where(F.col("true_type").isNotNull()))


_SLICE_COLUMN = {"idx": "idx", "data_type": "data_type", "sparsity": "sparsity_tenths", "num_columns": "num_columns"}


def _slice_value(name: str) -> Column:
    if name == ALL:
        return F.lit("")
    c = F.col(_SLICE_COLUMN[name])
    return decimal_text(c) if name == "sparsity" else c.cast("string")


def label_counts(pairs: DataFrame, slices: tuple[str, ...] = (ALL, *SLICES),
                 group_cols: list[str] | None = None) -> DataFrame:
    """``(mode, *group_cols, slice, slice_value, label, support, predicted, tp)`` over every label seen.

    Equal (truth, prediction) pairs of a slice value are counted first, all
    slices in one pass over the pairs as grouping sets; only these counts, not
    the pairs, are split into their two labels.
    """
    g = list(group_cols or [])
    base = ["mode", *g, "true_type", "pred_type"]
    cols = [_SLICE_COLUMN[s] for s in slices if s != ALL]
    sets = [base if s == ALL else [*base, _SLICE_COLUMN[s]] for s in slices]
    flags = [F.grouping(c).alias(f"__{c}") for c in cols]
    counts = pairs.groupingSets(sets, *base, *cols).agg(F.count(F.lit(1)).alias("w"), *flags)
    name, value = F.lit(ALL), F.lit("")
    for s in slices:
        if s != ALL:
            at = F.col(f"__{_SLICE_COLUMN[s]}") == 0
            name, value = F.when(at, s).otherwise(name), F.when(at, _slice_value(s)).otherwise(value)
    keyed = counts.select("mode", *g, name.alias("slice"), value.alias("slice_value"), "true_type", "pred_type", "w") \
                  .where((F.col("slice") == ALL) | (F.col("true_type") != F.lit(MISSING)))
    t, p, w, none = F.col("true_type"), F.col("pred_type"), F.col("w"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(t.alias("label"), w.alias("s"), none.alias("q"), F.when(t == p, w).otherwise(none).alias("tp")),
        F.struct(p.alias("label"), none.alias("s"), w.alias("q"), none.alias("tp")))
    return (keyed.select("mode", *g, "slice", "slice_value", F.inline(sides))
                 .groupBy("mode", *g, "slice", "slice_value", "label")
                 .agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("tp").alias("tp")))


def _metrics(tp: Column, pred: Column, sup: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [F.coalesce(F.try_divide(tp.cast("double"), pred), zero).alias("precision"),
            F.coalesce(F.try_divide(tp.cast("double"), sup), zero).alias("recall"),
            F.coalesce(F.try_divide(2.0 * tp, pred + sup), zero).alias("f1")]


_ROW = "array<struct<label:string,precision:double,recall:double,f1:double,support:bigint>>"


def classification_report(pairs: DataFrame, vocabulary: DataFrame, slices: tuple[str, ...] = (ALL, *SLICES),
                          group_cols: list[str] | None = None) -> DataFrame:
    """``(mode, *group_cols, slice, slice_value, label, precision, recall, f1, support)``.

    Every slice value lists the whole vocabulary (zeros included) and the
    macro / weighted / micro averages over it, and the accuracy over all pairs.
    One pass over the label counts: a slice value gathers its vocabulary labels
    (bounded by the vocabulary; labels outside it are only summed) and emits
    its rows from there, so nothing is joined back, re-read or checkpointed.
    """
    keys = ["mode", *(group_cols or []), "slice", "slice_value"]
    vocab = F.coalesce(vocabulary_array(vocabulary), F.array().cast("array<string>"))
    counts = label_counts(pairs, slices, group_cols).withColumn("known", F.array_contains(vocab, F.col("label")))
    counts = counts.select(*keys, "label", "support", "predicted", "tp", "known",
                           *_metrics(F.col("tp"), F.col("predicted"), F.col("support")))
    known = F.col("known")

    def total(c) -> Column:
        return F.coalesce(F.sum(F.when(known, c)), F.lit(0))

    per_key = counts.groupBy(*keys).agg(
        F.collect_list(F.when(known, F.struct("label", "precision", "recall", "f1", "support"))).alias("seen"),
        *[total(F.col(c)).alias(f"s_{c}") for c in ("precision", "recall", "f1", "support", "predicted", "tp")],
        *[total(F.col(c) * F.col("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("n_pairs"), F.sum("tp").alias("n_correct"))
    zero, n_labels = F.lit(0.0), F.size(vocab)

    def row(label: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    metrics = ("precision", "recall", "f1")
    averages = F.array(
        row("macro avg", *[F.coalesce(F.try_divide(F.col(f"s_{c}"), n_labels), zero) for c in metrics], F.col("s_support")),
        row("weighted avg", *[F.coalesce(F.try_divide(F.col(f"w_{c}"), F.col("s_support")), zero) for c in metrics],
            F.col("s_support")),
        row("micro avg", *_metrics(F.col("s_tp"), F.col("s_predicted"), F.col("s_support")), F.col("s_support")),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"),
            F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_pairs")), zero), F.col("n_pairs")))
    per_key = per_key.withColumn("unseen", F.array_except(vocab, F.col("seen.label")))
    unseen = F.transform("unseen",
                         lambda v: F.struct(v.alias("label"), zero.alias("precision"), zero.alias("recall"),
                                            zero.alias("f1"), F.lit(0).cast("bigint").alias("support")))
    return per_key.select(*keys, F.inline(F.concat(F.col("seen").cast(_ROW), unseen.cast(_ROW), averages.cast(_ROW))))


def not_a_column_type(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(pred_type, n)``: predictions outside the vocabulary (padded mode, truth
    not null); counted first, so a frequent label meets the join as one row."""
    vocab = vocabulary.select(F.col("column_type").alias("pred_type"))
    counts = pairs.where(F.col("mode") == "padded").groupBy("pred_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(vocab, "pred_type", "left_anti")


def num_tables_with_column_at_idx(pairs: DataFrame) -> DataFrame:
    """``(idx, n_tables)``: tables with a scored, real truth column at each position."""
    return (pairs.where((F.col("mode") == "padded") & (F.col("true_type") != MISSING))
                 .groupBy("idx").agg(F.count(F.lit(1)).alias("n_tables")))


def column_count_deviation(evaluated: DataFrame) -> DataFrame:
    """``(table_id, deviation)`` = predicted length - true length."""
    return evaluated.select("table_id", (F.size("pred_types") - F.size("true_types")).alias("deviation"))


def deviation_histogram(deviations: DataFrame) -> DataFrame:
    """``(deviation, n)`` with unit bins from min to max; empty bins are 0."""
    counts = deviations.where(F.col("deviation").isNotNull()).groupBy("deviation").agg(F.count(F.lit(1)).alias("n"))
    # each bin brings the empty ones up to the next; the window holds one row for each distinct deviation
    after = F.coalesce(F.lead("deviation").over(Window.orderBy("deviation")) - 1, F.col("deviation"))
    bins = counts.select(F.col("deviation").alias("d"), "n", after.alias("after"))
    bins = bins.select("d", "n", F.explode(F.sequence("d", "after")).alias("deviation"))
    return bins.select("deviation", F.when(F.col("deviation") == F.col("d"), F.col("n")).otherwise(0).alias("n"))


def accuracy_state(evaluated: DataFrame, modes: str | tuple[str, ...] = "adjusted", cap: int = ADJUST_UP_TO) -> DataFrame:
    """``(mode, correct, incorrect)`` over every aligned position, a counter that
    can be stored and merged; a null truth counts as correct (the rule used to
    choose alignments).  All modes come from one pass, and positions are counted
    inside their row: exploding them would let Spark infer a filter on the size
    of the pairs and evaluate the whole alignment again in it, many times over.
    """
    modes = (modes,) if isinstance(modes, str) else modes
    aligned = evaluated
    for m in modes:
        aligned = align(aligned, m, cap, out=f"__{m}")
    ok = lambda x: x["true_type"].isNull() | (x["true_type"] == x["pred_type"])
    counts = aligned.select(*[c for m in modes for c in (F.size(F.filter(f"__{m}", ok)).alias(f"{m}_ok"),
                                                         F.size(F.filter(f"__{m}", lambda x: ~ok(x))).alias(f"{m}_no"))])
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts.columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_ok").alias("correct"), F.col(f"{m}_no").alias("incorrect"))
                                          for m in modes])))


def accuracy_report(states: DataFrame) -> DataFrame:
    """``(mode, correct, incorrect, total, accuracy)`` of merged counters; the
    accuracy of an empty counter is null."""
    merged = states.groupBy("mode").agg(F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect"))
    total = F.col("correct") + F.col("incorrect")
    return merged.select("mode", "correct", "incorrect", total.alias("total"), F.round(F.try_divide(F.col("correct"), total), 6).alias("accuracy"))


def accuracy_counter(evaluated: DataFrame, modes: str | tuple[str, ...] = "adjusted", cap: int = ADJUST_UP_TO) -> DataFrame:
    """The report of one counter for each mode over all evaluated tables."""
    return accuracy_report(accuracy_state(evaluated, modes, cap))
