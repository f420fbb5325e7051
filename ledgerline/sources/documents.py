"""Results as nested documents and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(rows: DataFrame, key: str, name: str, rename: dict[str, str] | None = None) -> DataFrame:
    """(key, name): each key's rows as an array of structs, in the order of their fields; the key is not repeated."""
    fields = [F.col(c).alias((rename or {}).get(c, c)) for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def by_account(spine: DataFrame, sections: dict[str, DataFrame], key: str = "account") -> DataFrame:
    """One row per account with each section nested under its name; accounts without rows get empty arrays."""
    out = spine
    for name, rows in sections.items():
        out = out.join(grouped(rows, key, name), key, "left")
    return out.select(*spine.columns, *[F.coalesce(n, F.array()).alias(n) for n in sections])


def chosen(rows: DataFrame, verbosity: str | list[str], summary: list[str]) -> DataFrame:
    """Columns by verbosity: "true" all, "false" the summary without lists, "summary" the summary, or a list of names."""
    if isinstance(verbosity, list):
        return rows.select(*[c for c in rows.columns if c in verbosity or c == rows.columns[0]])
    if verbosity == "true":
        return rows
    flat = [c for c, t in rows.dtypes if verbosity == "summary" or not t.startswith("array")]
    return rows.select(*[c for c in flat if c in summary or c == rows.columns[0]])


def as_json(row_columns: list[str]) -> Column:
    return F.to_json(F.struct(*row_columns), {"ignoreNullFields": "true"})


def keyed(rows: DataFrame, key: str = "account", by: str = "request_id") -> DataFrame:
    """One row per request (``by``): a map from each of its keys to the key's struct."""
    rest = F.struct(*[c for c in rows.columns if c not in (key, by)])
    return rows.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), rest.alias("value"))))).alias("by_key"))


def write(rows: DataFrame, path: str, format: str = "parquet", mode: str = "error", **options) -> None:
    """Rows to files of any of Spark's formats (parquet, csv, json, orc ...) or a table by JDBC."""
    rows.write.format(format).mode(mode).options(**options).save(path)


def nested_by_account(accounts: DataFrame, sections: dict[str, DataFrame], windows: dict[str, DataFrame], renames: dict[str, str] | None = None, key: str = "account") -> DataFrame:
    """One document per account: lists of each section, flat columns of each windowed table, names as given.

    A windowed table has one row per account; its columns stand in the document itself."""
    out = by_account(accounts, sections, key)
    for table in windows.values():
        out = out.join(table, key, "left")
    return out.withColumnsRenamed(renames or {})
