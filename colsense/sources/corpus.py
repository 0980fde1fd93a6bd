"""Corpus sources: many small tables in many files, nested metadata, sparse cells.

A corpus is read into the row-array form ``(table_id, row_idx, cells)`` in one
DataFrame, never one DataFrame per file.  CSV corpora of differing headers go
through Spark's CSV reader with positional columns: a file is one stream in one
task, and no file is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsense.functions.numeric import is_na_token
from colsense.operators import sample
from colsense.session import staged


def _reader(spark: SparkSession, pattern: str):
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")


def _fields(record: Column, sep: str) -> Column:
    """The fields of one CSV record: quoted ones without their quotes, others as they stand."""
    out = "\\" + sep
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'{out}(?:(?:"[^"]*+")++[^{out}]*+|[^{out}]*+)'), 0)
    inner = lambda x: F.replace(F.regexp_extract(x, '^"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"'))
    plain = lambda f: F.substring(f, F.lit(2), F.length(f))
    return F.transform(found, lambda f: F.when(plain(f).startswith('"'), inner(plain(f))).otherwise(plain(f)))


def scan_csv_corpus(spark: SparkSession, root: str, pattern: str = "*.csv", sep: str = ",") -> DataFrame:
    """``(path, row_idx, headers, cells, parse_error)`` of all rows of all files;
    missing-value words are null, short rows end in nulls.

    A header-only table yields one row with ``row_idx = -1`` and null cells; a
    file that can't be read as a table one with ``parse_error``: no record at
    all, a row with more fields than the header, a quote that is never closed,
    or text that isn't UTF-8.  Header names stay as written.

    Spark's CSV reader cuts the records (line breaks may stand in quotes) into
    its corrupt-record column, because no table has the schema asked for; so
    files of any headers and widths go through one scan, each a stream in one
    task.  Records are staged, cut into fields; a file's first one is its header.
    """
    # the driver lists the files for any read; scans alone would leave out empty ones
    listed = _reader(spark, pattern).format("binaryFile").load(root).inputFiles()
    files = spark.createDataFrame([(x.replace(":///", ":/", 1),) for x in listed], "path string")
    path = F.regexp_replace("_metadata.file_path", "^([^/:]+):///", "$1:/").alias("path")
    never = (_reader(spark, pattern).schema("c0 date, record string")
             .options(header=False, multiLine=True, sep=sep, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="record",
                      dateFormat="'no date'", enableDateTimeParsingFallback=False, maxColumns=1 << 20).csv(root))
    record = F.coalesce("record", F.col("c0").cast("string"))
    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    records = staged(never.select(path, F.monotonically_increasing_id().alias("id"), _fields(record, sep).alias("fields"),
                                  ((quotes % 2 == 1) | record.contains("\ufffd")).alias("broken")), "csv-records")
    # only values of fixed width are aggregated (a text among them would take a sort of all
    # records), and what is known of a file is staged, so that its size chooses the joins
    per_file = staged(records.groupBy("path").agg(
        F.min("id").alias("first"), F.max(F.size("fields")).alias("widest"), F.count(F.lit(1)).alias("n"), F.bool_or("broken").alias("broken")), "csv-files")
    heads = records.join(per_file.select("path", F.col("first").alias("id")), ["path", "id"]).select("path", F.col("fields").alias("headers"))
    tables = staged(files.join(per_file, "path", "left").join(heads, "path", "left")
                    .select("path", "first", "headers", (F.col("n") == 1).alias("bare"),
                            F.coalesce((F.col("widest") > F.size("headers")) | F.col("broken"), F.lit(True)).alias("parse_error")), "csv-tables")
    rows = (records.join(tables.where("NOT parse_error"), "path").where(F.col("id") > F.col("first"))
            .select("path", (F.col("id") - F.col("first") - 1).cast("int").alias("row_idx"), "headers", "fields", "parse_error"))
    values = F.transform("headers", lambda _, i: F.when(~is_na_token(F.get(F.col("fields"), i)), F.get(F.col("fields"), i)))
    rows = rows.select("path", "row_idx", "headers", values.alias("cells"), "parse_error")
    others = tables.where("parse_error OR bare").select(
        "path", F.lit(-1).alias("row_idx"), F.when(~F.col("parse_error"), F.col("headers")).alias("headers"),
        F.lit(None).cast("array<string>").alias("cells"), "parse_error")
    return rows.unionByName(others)


def scan_stats_documents(spark: SparkSession, root: str) -> DataFrame:
    """Statistics documents, one JSON object a line: parallel lists ``num_cols``,
    ``num_rows`` (JSON text) and ``sparsity`` with an item for each table, and the
    totals ``num_numerical_cols`` and ``num_non_numerical_cols``, which stand in
    the row of a document's first table."""
    schema = ("dataset string, num_cols array<bigint>, num_rows array<string>, sparsity array<double>, "
              "num_numerical_cols bigint, num_non_numerical_cols bigint")
    docs = spark.read.schema(schema).json(root)
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).otherwise(F.lit(0)).alias(c)
    return (docs.select("dataset", "num_numerical_cols", "num_non_numerical_cols",
                        F.posexplode(F.arrays_zip("num_cols", "num_rows", "sparsity")).alias("pos", "t"))
                .select("dataset", "t.num_cols", F.col("t.num_rows").alias("num_rows_json"), "t.sparsity",
                        first("num_numerical_cols"), first("num_non_numerical_cols")))


def scan_jsonl_gz_corpus(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON-lines tables (one table per file, gzip decoded by the reader);
    absent keys read as null."""
    lines = spark.read.text(root, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), "value")
    return lines.select("path", F.from_json("value", schema).alias("r")).select("path", "r.*")


def _block_walk(cut: str, totals: bool):
    """A function for mapInArrow that walks the pieces of each block (``path``,
    ``start``) in the order read and counts quotes and the depth of brackets
    outside strings; a piece counts with ``cut`` behind it, escaped characters
    don't count.

    ``totals``: a row a block with its number of pieces and quotes and the steps
    of depth for both cases, that it starts outside a string or inside.  Else
    each piece comes with its number ``id`` and whether outside strings, with
    only the brackets of an array and an item open, it ``begins`` or ends
    (``item``); the block's case (``odd``) and depth (``above``) are given.
    """
    opened = cut.count('"')

    def walk(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        depth_of = np.zeros(256, np.int8)
        depth_of[[ord("["), ord("{")]], depth_of[[ord("]"), ord("}")]] = 1, -1

        def counted(values):
            """Of each piece: quotes, the parity of the quotes before it, its steps where that parity is even, and all."""
            whole = pc.binary_join_element_wise(values.cast(pa.large_string()), pa.scalar(cut, pa.large_string()), pa.scalar("", pa.large_string()))
            ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
            data, at = np.frombuffer(whole.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]
            quote, step = (data == ord('"')).view(np.uint8), depth_of[data]
            slashes = np.flatnonzero(data == ord("\\"))
            if len(slashes):  # the character after an odd number of them is escaped
                runs = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
                length = np.diff(runs, append=len(slashes))
                escaped = (slashes[runs] + length)[length % 2 == 1]
                quote[escaped] = step[escaped] = 0
            odd = np.cumsum(quote, dtype=np.uint8) & 1
            each = lambda x: np.add.reduceat(x, at[:-1], dtype=np.int64)
            return each(quote), np.append(np.zeros(1, np.uint8), odd[at[1:-1] - 1]), each(step * (1 - odd).view(np.int8)), each(step)

        block, n, quotes, depth, other = None, 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path, start = batch.column("path"), batch.column("start").to_numpy()
            code = path.dictionary_encode().indices.to_numpy()
            runs = np.append(np.flatnonzero(np.append(True, (np.diff(start) != 0) | (np.diff(code) != 0))), len(start))
            q, parity, even, every = counted(batch.column("value"))
            done, flags = [], []
            for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
                now = (path[a].as_py(), int(start[a]))
                if now != block:
                    if totals and block:
                        done.append((*block, n, quotes, depth, other))
                    block, n, quotes, depth, other = now, 0, 0, 0, 0
                    if not totals:
                        quotes, depth = batch.column("odd")[a].as_py(), batch.column("above")[a].as_py()
                outside, inside = even[a:b], every[a:b] - even[a:b]
                if (quotes + int(parity[a])) % 2:
                    outside, inside = inside, outside
                if totals:
                    other += int(inside.sum())
                else:
                    odd, deep = quotes + np.cumsum(q[a:b]), depth + np.cumsum(outside)
                    behind = lambda x, y: ((x - opened) % 2 == 0) & (y == 2)
                    flags.append((n + np.arange(b - a), behind(odd - q[a:b], deep - outside), behind(odd, deep)))
                n, quotes, depth = n + b - a, quotes + int(q[a:b].sum()), depth + int(outside.sum())
            if totals:
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), *[pa.int64()] * 5))], ["path", "start", "n", "q", "t0", "t1"])
            else:
                added = [pa.array(np.concatenate(x)) for x in zip(*flags)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("path", "start", "value", "n", "file_head", "file_tail")], *added],
                                                 ["path", "start", "value", "n", "file_head", "file_tail", "id", "begins", "item"])
        if totals and block:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*block, n, quotes, depth, other), (pa.string(), *[pa.int64()] * 5))], ["path", "start", "n", "q", "t0", "t1"])

    return walk


def _array_records(spark: SparkSession, root: str, cut: str, parse: Callable[[DataFrame], DataFrame] = lambda texts: texts) -> DataFrame:
    """``(value)``: texts of one or more items each of the JSON arrays that the
    files hold, one array a file, split without parsing a file as a whole; with
    ``parse``, what it makes of them, staged (``part`` must stay, null values too).

    Files are read in pieces that end at ``cut`` (close + blank or comma + open).
    Quotes and brackets are summed in the order read, by block of a file (one
    split of the read), so no text is shuffled or sorted: a first read sums each
    block for both cases, that it starts outside a string or inside; what the
    blocks before hold (one row a block) tells which case it is, and a second
    read tells of every piece whether it starts behind an item and ends with
    one.  Most do both and are texts as they stand, so that only what they are
    parsed to is staged.  Others are joined with their neighbours, so a cut that
    never fits costs memory, not results.
    """
    m = re.fullmatch(r"([\]}]+)([\s,]+)([\[{]\"?)", cut)
    if not m:
        raise ValueError("cut must be closing brackets, a comma and an opening bracket")
    close, between, opening = m.groups()
    block = ["path", "start"]
    read = spark.read.option("recursiveFileLookup", "true").option("lineSep", cut).text(root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    w = Window.partitionBy("path").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = read.mapInArrow(_block_walk(cut, True), "path string, start bigint, n bigint, q bigint, t0 bigint, t1 bigint")
    blocks = blocks.select(*block, "n", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).alias("odd"), "t0", "t1",
                           (F.row_number().over(w) == 1).alias("file_head"), F.lead("start").over(w).isNull().alias("file_tail"))
    step = F.when(F.col("odd") == 1, F.col("t1")).otherwise(F.col("t0"))
    blocks = blocks.select(*block, "n", "odd", "file_head", "file_tail", F.coalesce(F.sum(step).over(before), F.lit(0)).alias("above"))
    walked = read.join(F.broadcast(blocks), block).mapInArrow(
        _block_walk(cut, False), "path string, start bigint, value string, n bigint, file_head boolean, file_tail boolean, id bigint, begins boolean, item boolean")
    first, last = F.col("file_head") & (F.col("id") == 0), F.col("file_tail") & (F.col("id") == F.col("n") - 1)
    t = walked.select(*block, "id", "value", first.alias("first"), last.alias("last"), (first | F.col("begins")).alias("begins"), (~last & F.col("item")).alias("item"))

    def text(x: Column) -> Column:
        # a piece after an item's end begins with the opening bracket of the cut
        x = F.when(F.col("first"), F.regexp_replace(x, r"^\s*\[", "")).otherwise(F.concat(F.lit(opening), x))
        return F.when(F.col("last"), F.regexp_replace(x, r"\]\s*$", "")).otherwise(x).alias("value")

    x = F.concat("value", F.when(F.col("last"), "").when(F.col("item"), close).otherwise(cut))
    alone = F.col("begins") & (F.col("item") | F.col("last"))
    part = F.struct(*block, "id", x.alias("x"), "first", "last", F.col("begins").cast("int").alias("begins"))
    done = staged(parse(t.select(F.when(alone, text(x)).alias("value"), F.when(~alone, part).alias("part"))), "records", "zstd")
    texts, parts = done.where("part IS NULL").drop("part"), done.where("part IS NOT NULL").select("part.*")
    if parts.isEmpty():
        return texts
    parts = sample.prefix_sums(parts, [F.col(c) for c in (*block, "id")], {"text": F.col("begins")}, inclusive=True)
    joined = parts.groupBy("path", "text").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "id", "x"))), lambda p: p["x"]), "").alias("x"),
        F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
    joined = joined.select(text(F.col("x")), F.lit(None).cast(done.schema["part"].dataType).alias("part"))
    return texts.unionByName(staged(parse(joined), "joined", "zstd").drop("part"))


@dataclass(frozen=True)
class SparseTables:
    """``headers(table_id, col_idx, header)``, ``cells(table_id, col_idx, row_idx,
    text)`` and ``annotations(table_id, col_idx, column_type)``, a row for each
    type of a column."""

    headers: DataFrame
    cells: DataFrame
    annotations: DataFrame


def scan_sparse_cell_json(spark: SparkSession, root: str, cut: str | None = None) -> SparseTables:
    """Positional table records (``[0]`` id, ``[5]`` headers, ``[6]`` cells per
    column as ``[[row, col], [entity, text]]``, ``[7]`` types per column): one
    record a line, or with ``cut`` (the text between two records, like
    ``']], ["'``) one array of records a file.  Records are staged; the three
    tables read them."""
    of = lambda at, kind: F.variant_get("v", at, kind)
    cell = lambda c: F.struct(F.variant_get(c, "$[0][0]", "int").alias("row_idx"), F.variant_get(c, "$[1][1]", "string").alias("text"))
    fields = [of("$[0]", "string").alias("table_id"), of("$[5]", "array<string>").alias("headers"),
              F.transform(of("$[6]", "array<array<variant>>"), lambda cs: F.transform(cs, cell)).alias("cells"), of("$[7]", "array<array<string>>").alias("types")]

    def parse(texts: DataFrame) -> DataFrame:
        # outer: no filter on the array's size, which would parse every text twice
        items = F.variant_get(F.parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))), "$", "array<variant>")
        return texts.select("part", F.explode_outer(items).alias("v")).where("v IS NOT NULL OR part IS NOT NULL").select("part", *fields)

    if cut is None:
        records = spark.read.option("recursiveFileLookup", "true").text(root).where(F.length(F.trim("value")) > 0).select(F.parse_json("value").alias("v"))
        tables = staged(records.select(*fields), "tables", "zstd")
    else:
        tables = _array_records(spark, root, cut, parse)
    column = F.col("col_idx").cast("int")
    cells = (tables.select("table_id", F.posexplode("cells").alias("col_idx", "cs")).select("table_id", "col_idx", F.explode("cs").alias("c"))
             .select("table_id", column, "c.row_idx", "c.text"))
    headers = tables.select("table_id", F.posexplode("headers").alias("col_idx", "header")).select("table_id", column, "header")
    types = (tables.select("table_id", F.posexplode("types").alias("col_idx", "ts"))
             .select("table_id", column, F.explode("ts").alias("column_type")))
    return SparseTables(headers, cells, types)


def densify_sparse_cells(cells: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Coordinate cells to full columns up to the table's largest row index; gaps
    are null.  A column's cells meet in blocks of ``block`` rows, where the rows
    without one are added, so no array grows with a table and the grid isn't
    built beside the cells.  Blocks without any cell are looked for in tables of
    several blocks only (their number of rows is staged)."""
    n = staged(cells.where("table_id IS NOT NULL").groupBy("table_id").agg((F.max("row_idx") + 1).cast("bigint").alias("n_rows"))
               .where("n_rows > 0"), "row-counts")
    # a cell without a place still names its column
    placed = F.col("col_idx").isNotNull() & (F.col("row_idx") >= 0)
    at = F.when(placed, F.floor(F.col("row_idx") / block)).otherwise(F.lit(0)).cast("bigint")
    blocks = (cells.where("table_id IS NOT NULL").groupBy("table_id", "col_idx", at.alias("block"))
              .agg(F.collect_list(F.when(placed, F.struct("row_idx", "text"))).alias("present")).join(n, "table_id"))
    many = n.where(F.col("n_rows") > block)
    if not many.isEmpty():
        found = cells.join(many.select("table_id"), "table_id", "left_semi").select("table_id", "col_idx", at.alias("block")).distinct()
        grid = (found.select("table_id", "col_idx").distinct().join(many, "table_id")
                .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_rows") - 1) / block)))))
        same = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("table_id", "col_idx", "block")]
        empty = grid.alias("g").join(found.alias("f"), same, "left_anti").repartition("table_id", "col_idx", "block")
        blocks = blocks.unionByName(empty.withColumn("present", F.array().cast(blocks.schema["present"].dataType)))
    start = F.col("block") * block
    rows = F.sequence(start.cast("int"), (F.least(start + block, F.col("n_rows")) - 1).cast("int"))
    missing = F.transform(F.array_except(rows, F.col("present.row_idx")), lambda r: F.struct(r.alias("row_idx"), F.lit(None).cast("string").alias("text")))
    filled = blocks.select("table_id", "col_idx", F.explode_outer(F.concat("present", missing)).alias("c"))
    return filled.where(F.col("c").isNotNull()).select("table_id", "col_idx", "c.row_idx", "c.text")


def scan_nested_metadata(doc: DataFrame, col: str = "document") -> DataFrame:
    """``key -> {textual_cols|numerical_cols -> {header -> type}}`` to
    ``(file_key, kind, header, column_type)``; entries that are not objects
    are skipped."""
    entries = doc.select(F.explode(F.from_json(col, "map<string,variant>")).alias("file_key", "v"))
    objs = entries.where(F.schema_of_variant("v").startswith("OBJECT"))
    kinds = objs.select("file_key", F.explode(F.variant_get("v", "$", "map<string,map<string,string>>"))
                        .alias("kind", "m"))
    return kinds.select("file_key", "kind", F.explode("m").alias("header", "column_type"))


def scan_label_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(
        "table_id string, target_column int, annotation_label string").csv(path)


def scan_json_text(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One small JSON document per file (whole-file text), parsed with a schema."""
    docs = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), "value")
    return docs.select("path", F.from_json("value", schema).alias("doc"))
