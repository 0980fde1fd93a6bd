"""Seeded sampling, ordering and indexing.

Random orders are ``md5(seed || key)`` orders, reproducible in any engine.
Nothing ranks a whole corpus in one task:

* ``prefix_sums`` (``dense_index``, ``running_sum``) stages the rows in ranges
  of the whole order, sums inside each range and adds what the ranges before
  hold (one row per range);
* ``top_k_per_group`` first keeps the top k of salted sub-groups, then of
  the (at most k x salts) survivors per group, so a hot group never sorts in
  one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.operators.contracts import ensure
from colsense.session import staged

_SALTS = 16


def hash_key(seed: int | str, *parts: Column | str) -> Column:
    """A 32-bit unsigned integer from ``md5(seed|part|...)`` (same in DuckDB)."""
    cols = [F.lit(str(seed))] + [F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                                  for p in parts]
    digest = F.md5(F.concat_ws("|", *cols))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None, **values: Column) -> DataFrame:
    """Staged rows cut into ranges of the whole order: adds ``__p``, the range's
    number, ``__o0``, ``__o1``.. (the keys) and the given values.

    Ranges are cut on all keys, so rows with equal leading keys part as well,
    and are written once; everything that follows reads the same cut.
    """
    spark = df.sparkSession
    keyed = df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in values.items()])
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, *[f"__o{i}" for i in range(len(order))])
    return staged(dealt.withColumn("__p", F.spark_partition_id()), "ranged")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], inclusive: bool = False,
                ranges: int | None = None) -> DataFrame:
    """Add for each name the sum of its column over all rows before (or up to)
    each row in ``order``, several in one pass: a sum inside the row's range
    plus what the ranges before hold (a table of one row for each range)."""
    rows = ranged(df, order, ranges, **{f"__v{i}": c for i, c in enumerate(sums.values())})
    names = [f"__v{i}" for i in range(len(sums))]
    totals = rows.groupBy("__p").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in names])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}b") for v in names])
    frame = (Window.partitionBy("__p").orderBy(*[f"__o{i}" for i in range(len(order))])
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    inside = rows.select("*", *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"{v}i") for v in names])
    return (inside.join(F.broadcast(before), "__p")
                  .select(*df.columns, *[(F.col(f"{v}b") + F.col(f"{v}i")).alias(n) for v, n in zip(names, sums)]))


def dense_index(df: DataFrame, order: list[Column], out: str = "ix", ranges: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order`` (a total order)."""
    return prefix_sums(df, order, {out: F.lit(1).cast("bigint")}, ranges=ranges)


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str, inclusive: bool = False,
                ranges: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows before (or up to) each row in ``order``."""
    return prefix_sums(df, order, {out: value}, inclusive, ranges)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt: Column | None = None, out: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group in ``order`` and add their 1-based rank.

    Two rounds: top k inside ``(group, salt)`` sub-groups, then top k of the
    survivors.  Exact, and a group holding most rows is split ``_SALTS`` ways.
    """
    s = salt if salt is not None else F.pmod(F.xxhash64(*[o for o in order]), F.lit(_SALTS))
    first = (df.withColumn("__s", s)
               .withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__s").orderBy(*order)))
               .where(F.col("__r") <= k).drop("__r", "__s"))
    return (first.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
                 .where(F.col(out) <= k))


def shuffle_limit_reindex(tables: DataFrame, seed: int, limit: int | None, key: str = "table_id") -> DataFrame:
    """Seeded shuffle, optional limit, contiguous index ``ix`` in shuffled order."""
    order = [hash_key(seed, key), F.col(key)]
    if limit is None:
        return dense_index(tables, order)
    top = tables.orderBy(*order).limit(limit)          # TakeOrderedAndProject: bounded by the limit
    return top.withColumn("ix", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))


def aligned_shuffle(df: DataFrame, seed: int, key: str, lists: list[str]) -> DataFrame:
    """Shuffle several lists of each row by one seeded permutation; lists of
    different lengths are an error."""
    sizes = [F.coalesce(F.array_size(c), F.lit(-1)) for c in lists]
    same = F.lit(True)
    for n in sizes[1:]:
        same = same & (n == sizes[0])
    df = ensure(df, same, F.concat(F.lit(f"{', '.join(lists)} must have the same length in row "), F.col(key).cast("string")))
    zipped = F.arrays_zip(*[F.col(c) for c in lists])
    keyed = F.transform(zipped, lambda z, i: F.struct(
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))),
                           1, 8), 16, 10).cast("bigint").alias("h"), i.alias("i"), z.alias("z")))
    ordered = F.array_sort(keyed)
    out = df.withColumn("__o", ordered)
    for c in lists:
        out = out.withColumn(c, F.transform("__o", _field_of_z(c)))
    return out.drop("__o")


def _field_of_z(name: str):
    return lambda e: e["z"][name]


def _pick(name: str):
    return lambda i: F.get(F.col(name), i)


def sample_rows(rows: DataFrame, k: int, seed: int, key: str = "table_id", row: str = "row_idx") -> DataFrame:
    """``min(k, n)`` random rows per table; ``sample_rank`` is the order they come out in."""
    order = [hash_key(seed, key, row), F.col(row)]
    return top_k_per_group(rows, [key], order, k, out="sample_rank")


def sample_rows_aligned(sampled_ids: DataFrame, *tables: DataFrame, keys: tuple[str, str] = ("table_id", "row_idx")):
    """The same sampled row ids taken from several tables (left-semi joins)."""
    ids = sampled_ids.select(*keys)
    return tuple(t.join(ids, list(keys), "left_semi") for t in tables)


def sample_examples(indexed: DataFrame, k: int, seed: int, key: str = "table_id") -> DataFrame:
    """For each instance ``k`` distinct other instances: partner index
    ``(ix + 1 + (h + j) mod (n - 1)) mod n`` for ``j < k`` never equals ``ix``;
    an equi join on the index replaces a cross join.  Fewer than ``k`` other
    instances are an error when the plan runs."""
    if k < 1:
        return indexed.select(F.col(key), F.lit(0).alias("j"), F.col(key).alias("example_id")).where(F.lit(False))
    n = indexed.select(F.count(F.lit(1))).scalar()
    src = indexed.select(F.col(key), "ix", hash_key(seed, key).alias("h"), n.alias("n")) \
                 .select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    few = F.raise_error(F.concat(F.lit(f"{k} examples wanted, other instances: "), F.col("n") - 1)).cast("bigint")
    partner = F.when(F.col("n") > k, F.pmod(F.col("ix") + 1 + F.pmod(F.col("h") + F.col("j"), F.col("n") - 1), F.col("n")))
    src = src.withColumn("partner_ix", partner.otherwise(few))
    partners = indexed.select(F.col("ix").alias("partner_ix"), F.col(key).alias("example_id"))
    return src.join(partners, "partner_ix").select(key, "j", "example_id")


def sample_columns(instances: DataFrame, k: int | None, seed: int, key: str = "table_id",
                   lists: tuple[str, ...] = ("true_types",)) -> DataFrame:
    """Keep ``k`` random positions of each table's lists in original order
    (``kept_cols``); no-op when ``k`` is null or not below the width."""
    width = F.size(F.col(lists[0]))
    if k is None:
        return instances.withColumn("kept_cols", F.sequence(F.lit(0), width - 1))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))),
                           1, 8), 16, 10).cast("bigint").alias("h"), i.alias("i"))))
    kept = F.when(width > k, F.array_sort(F.transform(F.slice(ranked, 1, k), lambda e: e["i"]))) \
            .otherwise(F.sequence(F.lit(0), width - 1))
    out = instances.withColumn("kept_cols", kept)
    for c in lists:
        out = out.withColumn(c, F.transform("kept_cols", _pick(c)))
    return out


def candidate_vocabulary(inst_labels: DataFrame, vocab_array: Column, size: int, seed: int,
                         key: str = "table_id", labels: str = "labels") -> DataFrame:
    """Per instance: its labels plus random vocabulary entries up to ``size``; sorted.

    The draw ranks every entry that isn't the instance's own by its seeded hash,
    so that each subset of them is as likely as any other."""
    own = F.array_distinct(F.filter(F.col(labels), lambda x: x.isNotNull()))
    t = inst_labels.withColumn("__vocab", vocab_array).withColumn("__own", own)
    need = F.greatest(F.lit(size) - F.size("__own"), F.lit(0))
    ranked = F.array_sort(F.transform(F.array_except("__vocab", "__own"), lambda x: F.struct(hash_key(seed, F.col(key), x).alias("h"), x.alias("x"))))
    drawn = F.coalesce(F.transform(F.slice(ranked, F.lit(1), need), lambda e: e["x"]), F.array().cast("array<string>"))
    return t.withColumn("candidates", F.array_sort(F.array_union("__own", drawn))).drop("__vocab", "__own")


# the primes that follow 2^31: above any array's length, so none shares a factor with it
STEPS = [2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857]


def walked_vocabulary(inst_labels: DataFrame, vocab_array: Column, size: int, seed: int,
                      key: str = "table_id", labels: str = "labels") -> DataFrame:
    """Like :func:`candidate_vocabulary` with another draw, for requests.

    The vocabulary (distinct labels) isn't ranked: a row walks the positions
    ``(start + i * step) mod n``, a permutation as the step is a prime above n,
    and takes the first entries that aren't its own, after at most as many
    probes as it wants entries and has own ones."""
    own = F.array_distinct(F.filter(F.col(labels), lambda x: x.isNotNull()))
    t = inst_labels.withColumn("__vocab", vocab_array).withColumn("__own", own)
    n = F.size("__vocab")
    t = (t.withColumn("__need", F.greatest(F.lit(size) - F.size("__own"), F.lit(0)))
          .withColumn("__start", hash_key(seed, F.lit("start"), key))
          .withColumn("__step", F.element_at(F.array(*[F.lit(x) for x in STEPS]), (hash_key(seed, F.lit("step"), key) % len(STEPS) + 1).cast("int"))))
    probes = F.least(F.size("__own") + F.col("__need"), n)
    walk = F.when((probes > 0) & (F.col("__need") > 0), F.sequence(F.lit(0), probes - 1)).otherwise(F.array().cast("array<int>"))
    seen = F.transform(walk, lambda i: F.get(F.col("__vocab"), F.pmod(F.col("__start") + i * F.col("__step"), n).cast("int")))
    drawn = F.slice(F.filter(seen, lambda x: ~F.array_contains("__own", x)), F.lit(1), F.col("__need"))
    return (t.withColumn("candidates", F.array_sort(F.array_union("__own", drawn)))
             .drop("__vocab", "__own", "__need", "__start", "__step"))
