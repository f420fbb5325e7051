"""Output contracts: nested schemas that rows are checked against, a table of what breaks them, and documents that
come back from JSON as they went.

A contract is a ``StructType``: names, types, what may be null, and for a field with ``values`` in its metadata the
values it may have.  The check is one expression on each row, so it needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from .documents import nested_by_account

#: Fields of a violation: where, what ("missing", "type" or "value"), and the value as text.
PROBLEM = "array<struct<field:string,problem:string,value:string>>"


def _none() -> Column:
    return F.array().cast(PROBLEM)


def _one(path: str, problem: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(path).alias("field"), F.lit(problem).alias("problem"), value.cast("string").alias("value"))).cast(PROBLEM)


def _problems(col: Column | None, have: Y.DataType | None, field: Y.StructField, path: str) -> Column:
    """What a value of type ``have`` (None: not there) breaks of ``field``."""
    want, null = field.dataType, _none() if field.nullable else _one(path, "missing", F.lit(None))
    if col is None:
        return null
    if isinstance(want, (Y.StructType, Y.ArrayType)) and type(want) is not type(have):
        return F.when(col.isNull(), null).otherwise(_one(path, "type", F.to_json(F.struct(col.alias("v")))))
    if isinstance(want, Y.StructType):
        inner = [_problems(*_member(col, have, f.name), f, f"{path}.{f.name}") for f in want.fields]
        return F.when(col.isNull(), null).otherwise(reduce(lambda a, b: F.concat(a, b), inner, _none()))
    if isinstance(want, Y.ArrayType):
        element = Y.StructField("x", want.elementType, want.containsNull)
        return F.when(col.isNull(), null).otherwise(F.flatten(F.transform(col, lambda x: _problems(x, have.elementType, element, f"{path}[]"))))
    if isinstance(have, (Y.StructType, Y.ArrayType, Y.MapType)) and not isinstance(want, type(have)):
        return F.when(col.isNull(), null).otherwise(_one(path, "type", F.to_json(F.struct(col.alias("v")))))
    cast = col.try_cast(want)
    rule = F.when(col.isNull(), null).when(cast.isNull(), _one(path, "type", col))
    if values := field.metadata.get("values"):
        rule = rule.when(~cast.isin(*values), _one(path, "value", col))
    return rule.otherwise(_none())


def _member(col: Column, have: Y.StructType, name: str) -> tuple[Column | None, Y.DataType | None]:
    return (col.getField(name), have[name].dataType) if name in have.names else (None, None)


def _fitted(col: Column | None, have: Y.DataType | None, want: Y.DataType) -> Column:
    """The value under the contract's type: its fields in its order, others gone, those not there null."""
    if col is None:
        return F.lit(None).cast(want)
    if isinstance(want, Y.StructType) and isinstance(have, Y.StructType):
        parts = [_fitted(*_member(col, have, f.name), f.dataType).alias(f.name) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(want, Y.ArrayType) and isinstance(have, Y.ArrayType):
        return F.transform(col, lambda x: _fitted(x, have.elementType, want.elementType))
    if isinstance(want, (Y.StructType, Y.ArrayType)) or isinstance(have, (Y.StructType, Y.ArrayType, Y.MapType)) and not isinstance(want, type(have)):
        return F.lit(None).cast(want)
    return col.try_cast(want)


def checked(rows: DataFrame, contract: Y.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, under its schema; errors: ``key``, field, problem, value).

    A row with any violation is left out of the first and has a row for each in the second.  Values are cast where
    that loses none; columns that the contract does not name go.  ``key`` is a column of ``rows``."""
    have = rows.schema
    at = lambda f: (F.col(f"`{f.name}`"), have[f.name].dataType) if f.name in have.names else (None, None)
    problems = reduce(lambda a, b: F.concat(a, b), [_problems(*at(f), f, f.name) for f in contract.fields], _none())
    fitted = F.struct(*[_fitted(*at(f), f.dataType).alias(f.name) for f in contract.fields])
    seen = rows.select(F.col(f"`{key}`").alias("_key"), problems.alias("_problems"), fitted.alias("_row"))
    errors = seen.select("_key", F.explode("_problems").alias("p")).select(F.col("_key").alias(key), "p.field", "p.problem", "p.value")
    return seen.where(F.size("_problems") == 0).select("_row.*"), errors


def without_fields(rows: DataFrame, names: set[str]) -> DataFrame:
    """Rows without the columns ``names`` and without the fields of these names at any depth of structs, arrays and maps."""
    return rows.select(*[_stripped(F.col(f"`{f.name}`"), f.dataType, names).alias(f.name) for f in rows.schema.fields if f.name not in names])


def _stripped(col: Column, have: Y.DataType, names: set[str]) -> Column:
    if isinstance(have, Y.StructType):
        parts = [_stripped(col.getField(f.name), f.dataType, names).alias(f.name) for f in have.fields if f.name not in names]
        return F.when(col.isNotNull(), F.struct(*parts)) if parts else F.lit(None).cast("struct<>")
    if isinstance(have, Y.ArrayType):
        return F.transform(col, lambda x: _stripped(x, have.elementType, names))
    if isinstance(have, Y.MapType):
        return F.transform_values(col, lambda _, v: _stripped(v, have.valueType, names))
    return col


TYPES = {"string": Y.StringType(), "bigint": Y.LongType(), "int": Y.IntegerType(), "double": Y.DoubleType(), "date": Y.DateType()}


def _struct(text: str) -> Y.StructType:
    """Flat fields as ``name type`` or ``name type not null``; needs no session, as ``fromDDL`` does."""
    parts = [field.split(" ") for field in text.split(", ")]
    return Y.StructType([Y.StructField(name, TYPES[kind], not rest) for name, kind, *rest in parts])


#: Sections of an account's report: one list each.
SECTIONS = {
    "income_sources": _struct("cluster string, source_id string, income_type string not null, pays bigint not null, frequency string not null, pay double, monthly_income double, last date, active_score int, recurring_score int, stability_score int, error_code int not null"),
    "loan_sources": _struct("cluster string, source_id string, origination double not null, payment double not null, n_originations bigint not null, n_payments bigint not null, last date, error_code int not null"),
}
#: Tables of one row per account, whose columns stand in the report itself.
FLAT = {"cashflow": _struct("credit double not null, debit double not null, net_cash_flow double not null, spending double not null"), "balances": _struct("balance_3m double, balance_6m double, balance_all double")}
REPORT = Y.StructType([Y.StructField("account", Y.StringType(), False), *[Y.StructField(n, Y.ArrayType(s, False), False) for n, s in SECTIONS.items()], *[f for s in FLAT.values() for f in s.fields]])


def reports(tables: dict[str, DataFrame], accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the tables of ``analyze``, one per account of ``accounts``, checked against REPORT; and the errors."""
    document = nested_by_account(accounts.select("account").distinct(), {n: tables[n] for n in SECTIONS}, {n: tables[n] for n in FLAT})
    return checked(document, REPORT, "account")


def to_text(documents: DataFrame) -> DataFrame:
    """(account, document): JSON that ``from_text`` turns back; fields that are null are left out."""
    return documents.select("account", F.to_json(F.struct(*documents.columns)).alias("document"))


def from_text(texts: DataFrame, contract: Y.StructType = REPORT, key: str = "account") -> tuple[DataFrame, DataFrame]:
    """Documents of JSON texts (key, document) and the errors: texts that cannot be read, and what breaks the contract."""
    # read with every field open to null, so that the check can say what is missing
    parsed = texts.select(F.col(key).alias("_text_key"), "document", F.from_json("document", contract.simpleString(), {"mode": "PERMISSIVE"}).alias("d"))
    unread = parsed.where("d is null").select(F.col("_text_key").alias(key), F.lit("document").alias("field"), F.lit("type").alias("problem"), F.col("document").alias("value"))
    good, errors = checked(parsed.where("d is not null").select("_text_key", "d.*"), contract, "_text_key")
    return good, errors.withColumnRenamed("_text_key", key).union(unread)
