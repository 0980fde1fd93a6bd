"""Table and list linearization, templates and chat requests.

Tables are linearized from their *sampled* rows only (``k`` per table, 3 by
default), so the per-table ``collect_list`` is bounded by ``k`` whatever the
table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.constants import EXAMPLE_TEMPLATE, PROMPT_TEMPLATE, TABLE_TEMPLATE
from colsense.functions.text import csv_field, json_list

NAN_TEXT = "nan"


def replace_na(cells: Column, value: str) -> Column:
    return F.transform(cells, lambda x: F.coalesce(x, F.lit(value)))


def csv_line(cells: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(cells, lambda x: csv_field(x, sep)), sep)


def with_table_text(df: DataFrame, mode: str, headers: str, rows: str, out: str) -> DataFrame:
    """Adds the text of a table from its header list (null: no header line) and
    its list of rows; modes ``csv``, ``key_value`` and ``markdown``."""
    if mode == "csv":
        head = F.when(F.col(headers).isNotNull(), F.array(csv_line(F.col(headers)))).otherwise(F.array().cast("array<string>"))
        return df.withColumn(out, F.concat(F.array_join(F.concat(head, F.transform(rows, lambda r: csv_line(r))), "\n"), F.lit("\n")))
    if mode == "key_value":
        pair = lambda h, v: F.concat(h, F.lit(": "), F.coalesce(v, F.lit(NAN_TEXT)))
        return df.withColumn(out, F.array_join(F.transform(rows, lambda r: F.array_join(F.zip_with(headers, r, pair), ", ")), "\n"))
    if mode != "markdown":
        raise ValueError(f"unknown table mode {mode!r}")
    shown = F.transform(rows, lambda r: replace_na(r, NAN_TEXT))
    widths = F.transform(headers, lambda h, i: F.greatest(
        F.length(h), F.coalesce(F.array_max(F.transform("__rows", lambda r: F.length(F.get(r, i)))), F.lit(0))))

    def render(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.zip_with(cells, "__w", lambda c, w: F.rpad(c, w, " ")), " | "),
                        F.lit(" |"))

    sep = F.concat(F.lit("|"), F.array_join(F.transform("__w", lambda w: F.concat(
        F.lit(":"), F.repeat(F.lit("-"), w + 1))), "|"), F.lit("|"))
    lines = F.concat(F.array(render(F.col(headers)), sep), F.transform("__rows", render))
    return (df.withColumn("__rows", shown).withColumn("__w", widths)
              .withColumn(out, F.array_join(lines, "\n")).drop("__rows", "__w"))


def _linearize(sampled: DataFrame, headers: DataFrame | None, mode: str, key: str) -> DataFrame:
    rows = sampled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "cells"))),
                                                lambda r: r["cells"]).alias("rows"))
    if headers is None:
        tables = rows.withColumn("headers", F.lit(None).cast("array<string>"))
    else:
        tables = rows.join(headers.select(key, "headers"), key, "left" if mode == "csv" else "inner")
    return with_table_text(tables, mode, "headers", "rows", "table_text").select(key, "table_text")


def linearize_csv(sampled: DataFrame, headers: DataFrame | None, key: str = "table_id") -> DataFrame:
    """``(table_id, table_text)``: optional header line, one line per sampled
    row, every line ending in a newline."""
    return _linearize(sampled, headers, "csv", key)


def linearize_key_value(sampled: DataFrame, headers: DataFrame, key: str = "table_id") -> DataFrame:
    """``k: v, k: v`` per row, rows separated by newlines; missing cells read ``nan``."""
    return _linearize(sampled, headers, "key_value", key)


def linearize_markdown(sampled: DataFrame, headers: DataFrame, key: str = "table_id") -> DataFrame:
    """Pipe table, every column left aligned and padded to its widest cell."""
    return _linearize(sampled, headers, "markdown", key)


def fill_table_template(template: str, table_name: Column, table_text: Column) -> Column:
    """``{{newline}}``, then ``{{table_name}}`` only when the name is non-empty, then ``{{table}}``."""
    t = F.lit(template.replace("{{newline}}", "\n"))
    named = F.when(F.coalesce(F.length(table_name), F.lit(0)) > 0,
                   F.replace(t, F.lit("{{table_name}}"), table_name)).otherwise(t)
    return F.replace(named, F.lit("{{table}}"), table_text)


def linearize_list_json(labels: Column) -> Column:
    return json_list(labels)


def linearize_list_csv(labels: Column, sep: str = ",") -> Column:
    return F.array_join(labels, sep)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _fill(content: str, values: dict[str, Column]) -> Column:
    out = F.lit(content)
    for k, v in values.items():
        if "{{" + k + "}}" in content:
            out = F.replace(out, F.lit("{{" + k + "}}"), v)
    return out


def fill_chat_template(template: list, text_vars: dict[str, Column], message_vars: dict[str, Column]) -> Column:
    """Fill ``{{var}}`` in message contents; a bare ``"{{var}}"`` item is replaced
    by the message list in ``message_vars`` (spliced)."""
    parts = []
    for item in template:
        if isinstance(item, str):
            name = item.strip("{}")
            if name not in message_vars:
                raise AssertionError(f"missing value for template message variable {item!r}")
            parts.append(message_vars[name])
        else:
            parts.append(F.array(_message(item["role"], _fill(item["content"], text_vars))))
    return F.flatten(F.array(*parts))


def example_messages(example_table: Column, example_types: Column) -> Column:
    return fill_chat_template(EXAMPLE_TEMPLATE, {"table": example_table, "column_types": example_types}, {})


def prompt_messages(all_types: Column, examples: Column, table: Column) -> Column:
    return fill_chat_template(PROMPT_TEMPLATE, {"all_column_types": all_types, "table": table},
                              {"examples": examples})


def unfilled_variables(messages: Column) -> Column:
    """Names left as ``{{...}}`` in any message (greedy, like the published check)."""
    return F.flatten(F.transform(messages, lambda m: F.regexp_extract_all(m["content"],
                                                                          F.lit(r"\{\{(.*)\}\}"), 1)))


DEFAULT_TABLE_TEMPLATE = TABLE_TEMPLATE
