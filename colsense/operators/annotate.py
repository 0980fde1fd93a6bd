"""Label joins, lookups, schema shaping, vocabularies and set operations.

Joins are equi joins on table/column keys (sort-merge at scale, broadcast only
for sides whose size is bounded by the label vocabulary).  The one theta join
(substring match of metadata keys in file names) is an exact equi join on the
file-name substrings of each key length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.constants import UNSPECIFIED, WITH_HEADERS, WITHOUT_HEADERS
from colsense.functions.numeric import is_na_token, is_numeric_token
from colsense.operators.contracts import ensure
from colsense.session import staged


# --- schema shaping -------------------------------------------------------------------

def drop_index_column(rows: DataFrame, has_index: Column) -> DataFrame:
    """Drop the leading cell of every row where the corpus has an index column."""
    return rows.withColumn("cells", F.when(has_index, F.slice("cells", F.lit(2), F.size("cells"))).otherwise(F.col("cells")))


def anonymize_headers(columns: DataFrame) -> DataFrame:
    return columns.withColumn("header", F.lit("empty"))


def drop_unannotated_tables(columns: DataFrame) -> DataFrame:
    """Keep the columns of tables with at least one label (aggregate, then left-semi)."""
    keep = columns.groupBy("table_id").agg(F.count("column_type").alias("n")).where(F.col("n") > 0)
    return columns.join(keep.select("table_id"), "table_id", "left_semi")


def drop_unspecified_columns(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Keep only labelled cells of each row (labels travel with the table)."""
    j = rows.join(instances.select("table_id", "true_types"), "table_id")
    return j.select("table_id", "row_idx",
                    F.filter("cells", lambda x, i: F.get(F.col("true_types"), i).isNotNull()).alias("cells"),
                    F.filter("true_types", lambda x: x.isNotNull()).alias("labels"))


def stringify_unspecified(labels: Column, text: str = UNSPECIFIED) -> Column:
    return F.transform(labels, lambda x: F.coalesce(x, F.lit(text)))


def strip_header_flag(experiments: DataFrame, col: str = "exp_name") -> DataFrame:
    """``base_name`` without the header flag and ``headers`` in (with, w/out, error)."""
    e = F.col(col)
    return experiments.withColumn(
        "base_name", F.replace(F.replace(e, F.lit(WITH_HEADERS), F.lit("")), F.lit(WITHOUT_HEADERS), F.lit(""))
    ).withColumn(
        "headers", F.when(e.contains("with-headers"), F.lit("with"))
                    .when(e.contains("without-headers"), F.lit("w/out"))
                    .otherwise(F.lit("error")))


# --- joins --------------------------------------------------------------------------

def annotation_conflicts(gt: DataFrame) -> DataFrame:
    """Columns with more than one annotation."""
    return (gt.groupBy("table_id", "target_column").agg(F.count(F.lit(1)).alias("n_labels"))
              .where(F.col("n_labels") > 1))


def annotate_columns(columns: DataFrame, gt: DataFrame, table_name: Column, strict: bool = False) -> DataFrame:
    """Left equi join of the ground truth to every column; no match -> null.

    The truth is aggregated per column first, so a conflicting column still
    yields one row (with ``n_labels`` > 1 for the audit); ``strict`` makes it an
    error.
    """
    per_col = gt.groupBy("table_id", "target_column").agg(
        F.min("annotation_label").alias("label"), F.count(F.lit(1)).alias("n_labels"))
    keyed = columns.withColumn("__name", table_name)
    out = (keyed.join(per_col, (keyed["__name"] == per_col["table_id"])
                      & (keyed["col_idx"] == per_col["target_column"]), "left")
                .select(keyed["table_id"], keyed["col_idx"], keyed["header"],
                        F.col("label").alias("column_type"),
                        F.coalesce(F.col("n_labels"), F.lit(0)).alias("n_labels")))
    if not strict:
        return out
    return ensure(out, F.col("n_labels") <= 1, F.concat_ws(" ", F.lit("several annotations of column"), "col_idx", F.lit("of table"), "table_id"))


def metadata_substring_match(files: DataFrame, keys: DataFrame, file_col: str = "file_name",
                             key_col: str = "file_key") -> DataFrame:
    """Every (file, key) with ``key`` a substring of the file name: an equi join
    of the distinct keys on the file-name substrings of every distinct key
    length (a scalar subquery), so no cartesian product is ever planned and
    nothing runs when the query is defined.
    """
    keys = keys.select(key_col).where(F.length(key_col) > 0).distinct()
    lengths = F.coalesce(keys.select(F.collect_set(F.length(key_col))).scalar(), F.array().cast("array<int>"))
    f = files.withColumn("__len", F.explode(lengths)).where(F.length(file_col) >= F.col("__len"))
    subs = f.select(*files.columns, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(file_col) - F.col("__len") + 1),
        lambda p: F.substring(F.col(file_col), p, F.col("__len"))))).alias(key_col))
    return subs.join(keys, key_col).select(*files.columns, key_col)


def match_audit(files: DataFrame, matches: DataFrame, file_col: str = "file_name", key_col: str = "file_key",
                strict: bool = False) -> DataFrame:
    """Every file with ``n_matches``, its key if there is exactly one, and a
    ``status``; ``strict``: a file with none or several is an error."""
    counts = matches.groupBy(*files.columns).agg(F.count(F.lit(1)).alias("n_matches"), F.min(key_col).alias(key_col))
    n = F.coalesce("n_matches", F.lit(0))
    out = files.join(counts, files.columns, "left").select(
        *files.columns, n.alias("n_matches"), F.when(n == 1, F.col(key_col)).alias(key_col),
        F.when(n == 1, "ok").when(n == 0, "no match").otherwise("ambiguous").alias("status"))
    return ensure(out, F.col("status") == "ok", F.concat_ws(": ", "status", file_col)) if strict else out


def header_type_lookup(metadata: DataFrame, columns: DataFrame) -> DataFrame:
    """Merge the textual and numerical header maps of each key (numerical wins)
    and look up every column header; a missing header gives null.

    ``metadata(file_key, kind, header, column_type)`` is the exploded document.
    """
    prio = metadata.withColumn("__p", F.when(F.col("kind") == "numerical_cols", 1).otherwise(0))
    merged = prio.groupBy("file_key", "header").agg(
        F.max_by("column_type", "__p").alias("column_type"),
        F.max_by("kind", "__p").alias("kind"))
    return columns.join(merged, ["file_key", "header"], "left")


def type_to_datatype_lookup(metadata: DataFrame) -> DataFrame:
    """Label -> data type: numerical if any key lists it as numerical; the null
    label always is."""
    numerical = (F.col("kind") == "numerical_cols") | F.col("column_type").isNull()
    listed = metadata.select("column_type", numerical.alias("n"))
    null = metadata.sparkSession.range(1).select(F.lit(None).cast("string").alias("column_type"), F.lit(True).alias("n"))
    return listed.unionByName(null).groupBy("column_type").agg(
        F.when(F.coalesce(F.max("n"), F.lit(False)), "numerical").otherwise("non-numerical").alias("data_type"))


def cached_response_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join requests to the earliest cache entry of their hash (of equally
    old ones the least by content); a hit needs the cached request to equal the
    request."""
    first = cache.groupBy("request_hash").agg(
        F.min(F.struct("cached_at", "request_json", "response_json")).alias("e"))
    j = requests.join(first, "request_hash", "left")
    hit = F.col("e").isNotNull() & (F.col("e.request_json") == F.col("request_json"))
    return j.select(*requests.columns, hit.alias("cached"),
                    F.when(hit, F.col("e.response_json")).alias("cached_response"))


def pending_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a valid cached response (left-anti on the hits)."""
    hits = cached_response_lookup(requests, cache).where("cached").select("request_id")
    return requests.join(hits, "request_id", "left_anti")


def pair_request_response(requests: DataFrame, responses: DataFrame, key: str = "request_id", strict: bool = False) -> DataFrame:
    """Full outer completeness audit: ``status`` in (paired, no response, no
    request); ``strict``: anything but a pair is an error."""
    r = requests.select(key, F.lit(True).alias("__q"))
    s = responses.select(key, F.lit(True).alias("__s"))
    out = (r.join(s, key, "full_outer")
            .select(key, F.when(F.col("__q") & F.col("__s"), F.lit("paired"))
                           .when(F.col("__q"), F.lit("no response"))
                           .otherwise(F.lit("no request")).alias("status")))
    return ensure(out, F.col("status") == "paired", F.concat_ws(": ", "status", F.col(key).cast("string"))) if strict else out


def table_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``(table_id, block, rows, kinds)``: the rows ``(row_idx, cells)`` of a table
    (``copy_id`` and ``path``) in blocks of ``block`` rows, and of each column the
    kind: 0 if all its cells in the block are whole numbers, 1 if all present
    ones are numbers, else 2.  Rows that lie together by ``copy_id`` aren't moved."""
    def kind(x: Column) -> Column:
        # plain short numbers, most of the cells there are, need no other test
        return (F.when(x.rlike(r"^[+-]?\d{1,18}$"), 0).when(is_na_token(x), 1)
                 .when(is_numeric_token(x), F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), 0).otherwise(1)).otherwise(2))

    at = F.coalesce(F.floor(F.col("row_idx") / block), F.lit(-1)).cast("bigint")
    blocks = rows.groupBy("copy_id", "path", at.alias("block")).agg(F.collect_list(F.struct("row_idx", "cells")).alias("rows"))
    kinds = F.aggregate("rows", F.array().cast("array<int>"), lambda acc, r: F.zip_with(
        acc, F.transform(F.coalesce(r["cells"], F.array().cast("array<string>")), kind), lambda a, b: F.greatest(a, b)))
    return blocks.select(F.struct("copy_id", "path").alias("table_id"), "block", "rows", kinds.alias("kinds"))


def canonical_texts(blocks: DataFrame) -> DataFrame:
    """Adds ``content``, one text for the rows of a block, the same for two blocks
    exactly if their column kinds and, row by row, their cells as typed values
    are: missing-value words null, whole numbers without signs and zeros that
    don't count, other numbers as doubles, text as it stands.

    Cells come first, each ended by ``;`` and a row by a line break (in cells
    these and the backslash are escaped), then kinds, then the row indexes if
    they aren't 0, 1, 2.."""
    def typed(x: Column, i: Column) -> Column:
        t = F.trim(x)
        body = F.regexp_replace(t, "^[+-]?0*", "")
        number = F.when(F.substring(t, 1, 1).between("1", "9"), t).when(body == "", "0").otherwise(
            F.concat(F.when(t.startswith("-"), "-").otherwise(""), body))
        kind = F.get(F.col("kinds"), i)
        # 0.0 is added so that -0.0 becomes 0.0
        value = (F.when(is_na_token(x), F.lit(None)).when(kind == 0, number)
                  .when(kind == 1, (t.try_cast("double") + F.lit(0.0)).cast("string")).otherwise(x))
        for char, escaped in (("\\", "\\\\"), (";", "\\;"), ("\n", "\\n")):
            value = F.replace(value, F.lit(char), F.lit(escaped))
        return F.concat(F.coalesce(value, F.lit("\\N")), F.lit(";"))

    row = lambda r: F.struct(r["row_idx"].alias("i"), F.coalesce(F.array_join(F.transform(r["cells"], typed), ""), F.lit("\\-")).alias("x"))
    lines = blocks.select("*", F.sort_array(F.transform("rows", row)).alias("lines"))
    idx = F.col("lines.i")
    dense = idx == F.sequence(F.lit(0), F.size("lines") - 1)
    tail = F.concat(F.array_join("kinds", ""), F.lit("/"), F.when(dense, "").otherwise(F.array_join(idx, ",", "?")))
    # never null, so that a join on it infers no filter that makes it again
    return lines.select(*blocks.columns, F.coalesce(F.concat(F.array_join("lines.x", "\n"), F.lit("\n"), tail), F.lit("")).alias("content"))


def table_fingerprints(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """``(key, n_rows, n_cols, fp)``: a content hash of canonical rows.

    Each row hashes its index and length-prefixed cells (null as a sentinel);
    rows combine with order-free sums over the four 60-bit parts of the hash, so
    large tables never gather in one task.
    """
    def cell(x):
        return F.when(x.isNull(), F.lit("∅")).otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x))
    row_h = F.sha2(F.concat_ws("|", F.col("row_idx").cast("string"),
                               F.array_join(F.transform("cells", cell), ";")), 256)
    parts = [F.conv(F.substring(F.col("__r"), i, 15), 16, 10).cast("decimal(20,0)") for i in (1, 16, 31, 46)]
    per_table = rows.withColumn("__r", row_h).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max(F.size("cells")) - 1).alias("n_cols"),
        *[F.sum(p).alias(f"__h{i}") for i, p in enumerate(parts)])
    return per_table.select(key, "n_rows", "n_cols", F.sha2(F.concat_ws("|", *[F.col(f"__h{i}").cast("string") for i in range(4)]), 256).alias("fp"))


def match_tables_by_content(targets: DataFrame, sources: DataFrame, fp_digits: int = 64, block: int = 64) -> DataFrame:
    """``(target_id, source_id, source_path)``: each target table gets the first
    source (by path) with equal cells, names ignored; targets without one are left out.

    targets and sources are row arrays with ``copy_id``, sources with ``path``.
    A table of one block of rows is one text, and equal texts meet in a join, so
    its rows move once.  Larger tables are told by fingerprints and compared
    block by block (``_match_large``).
    """
    columns = ["copy_id", F.coalesce("path", F.lit("")).alias("path"), "row_idx", "cells"]
    both = targets.withColumn("path", F.lit(None).cast("string")).select(*columns).unionByName(sources.select(*columns))
    blocks = staged(table_blocks(both, block), "blocks", "zstd")
    large = staged(blocks.where("block <> 0").select("table_id").distinct(), "large")
    # tables without cells in any row have no content to match
    some = F.exists("rows", lambda r: r["cells"].isNotNull())
    small = canonical_texts(blocks.where("block = 0").where(some).join(large, "table_id", "left_anti")).select("table_id", "content")
    is_source = F.col("table_id.path") != ""
    first = small.where(is_source).groupBy("content").agg(F.min(F.struct("table_id.path", "table_id.copy_id")).alias("first"))
    found = small.where(~is_source).join(first, "content").select(
        F.col("table_id.copy_id").alias("target_id"), F.col("first.copy_id").alias("source_id"), F.col("first.path").alias("source_path"))
    if large.isEmpty():
        return found
    return found.unionByName(_match_large(blocks.join(large, "table_id", "left_semi"), fp_digits))


def _match_large(blocks: DataFrame, fp_digits: int) -> DataFrame:
    """The matches of tables of several blocks.

    Tables of one shape and fingerprint are compared with the first source among
    them, block by block, and equal ones settled; what differs (a collision, or
    targets of several kinds) goes on to the next round with the sources left, so
    the answer doesn't rest on the hash (``fp_digits`` of it, for tests) and no
    two copies of a popular table are paired with each other.
    """
    # a column's kind is that of all its blocks
    kinds = (blocks.select("table_id", F.posexplode("kinds").alias("col_idx", "kind")).groupBy("table_id", "col_idx").agg(F.max("kind").alias("kind"))
             .groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "kind"))), lambda k: k["kind"]).alias("kinds")))
    texts = canonical_texts(blocks.drop("kinds").join(kinds, "table_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<int>"))))
    some = F.exists("rows", lambda r: r["cells"].isNotNull())
    rows = staged(texts.select("table_id", F.col("block").alias("row_idx"), F.array("content").alias("cells"), some.alias("some")), "canonical", "zstd")
    open_ = staged(table_fingerprints(rows).withColumn("fp", F.substring("fp", 1, fp_digits))
                   .join(rows.where("some").select("table_id"), "table_id", "left_semi"), "fingerprints")
    shape = ["n_rows", "n_cols", "fp"]
    is_source = F.col("table_id.path") != ""
    settled = open_.where(F.lit(False)).select(F.col("table_id.copy_id").alias("target_id"), F.col("table_id.copy_id").alias("source_id"), F.col("table_id.path").alias("source_path"))
    while True:
        # groups that still have a source and a target, with the first source
        heads = open_.groupBy(*shape).agg(
            F.min_by("table_id", F.when(is_source, F.struct("table_id.path", "table_id.copy_id"))).alias("head"),
            F.count_if(~is_source).alias("n")).where(F.col("head").isNotNull() & (F.col("n") > 0)).select(*shape, "head")
        members = staged(open_.join(heads, shape), "members")
        if members.isEmpty():
            return settled
        theirs = rows.select(F.col("table_id").alias("head"), "row_idx", F.col("cells").alias("theirs"))
        others = members.where(F.col("table_id") != F.col("head"))
        equal = (others.select("table_id", "head").join(rows, "table_id").join(theirs, ["head", "row_idx"])
                 .where(F.col("cells") == F.col("theirs")).groupBy("table_id").agg(F.count(F.lit(1)).alias("same")))
        judged = staged(others.join(equal, "table_id", "left").withColumn("equal", F.coalesce(F.col("same") == F.col("n_rows"), F.lit(False))), "judged")
        settled = settled.unionByName(judged.where(F.col("equal") & ~is_source).select(
            F.col("table_id.copy_id").alias("target_id"), F.col("head.copy_id").alias("source_id"), F.col("head.path").alias("source_path")))
        open_ = judged.where("NOT equal").select("table_id", *shape)


# --- vocabularies and sets ------------------------------------------------------------

def label_vocabulary(columns: DataFrame, col: str = "column_type") -> DataFrame:
    return columns.where(F.col(col).isNotNull()).select(col).distinct()


def vocabulary_array(vocabulary: DataFrame, col: str = "column_type") -> Column:
    """The (bounded) vocabulary as one sorted array, as a scalar subquery."""
    return vocabulary.select(F.array_sort(F.collect_set(col))).scalar()


def vocabulary_by_data_type(columns: DataFrame) -> DataFrame:
    return (columns.where(F.col("column_type").isNotNull())
                   .groupBy("data_type").agg(F.array_sort(F.collect_set("column_type")).alias("labels")))


def vocabulary_union(*label_sets: DataFrame, col: str = "column_type") -> DataFrame:
    out = label_sets[0].select(col)
    for s in label_sets[1:]:
        out = out.unionByName(s.select(col))
    return out.where(F.col(col).isNotNull()).distinct()


def vocabulary_difference(vocab_array: Column, labels: Column) -> Column:
    return F.array_except(vocab_array, F.filter(labels, lambda x: x.isNotNull()))


def corpus_concat(*tagged: tuple[str, DataFrame], tag_col: str = "tag") -> DataFrame:
    out = None
    for tag, df in tagged:
        d = df.withColumn(tag_col, F.lit(tag))
        out = d if out is None else out.unionByName(d)
    return out
