"""Schema growth: stored tables get what the declared schema has and they lack.

Columns and nested fields are matched by name and added as null, types are widened where
every stored value stays what it is, and nothing is dropped. A change that could lose values
is refused unless the caller keeps the stored type.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole numbers by their decimal digits, and the digits a floating type holds exactly.
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_EXACT = {T.FloatType: 7, T.DoubleType: 15}


def _plain_widening(stored: T.DataType, declared: T.DataType) -> bool:
    a, b = type(stored), type(declared)
    if a is T.NullType:
        return True
    if isinstance(declared, T.DecimalType):
        room = declared.precision - declared.scale
        if isinstance(stored, T.DecimalType):
            return room >= stored.precision - stored.scale and declared.scale >= stored.scale
        return a in _WHOLE and room >= _WHOLE[a]
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE[b] > _WHOLE[a]
    if a in _WHOLE and b in _EXACT:
        return _EXACT[b] >= _WHOLE[a]
    return (a, b) in {(T.FloatType, T.DoubleType), (T.DateType, T.TimestampNTZType)}


def _inner(kind: T.DataType) -> dict[str, T.DataType]:
    """The parts of a nested type by name."""
    if isinstance(kind, T.StructType):
        return {f.name: f.dataType for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return {"element": kind.elementType}
    if isinstance(kind, T.MapType):
        return {"key": kind.keyType, "value": kind.valueType}
    return {}


def _changes(stored: T.StructType, declared: T.StructType) -> Iterator[tuple[str, str | None, str, str]]:
    """(property, stored type, declared type, change) for all that differ, outermost first."""

    def visit(path: str, old: T.DataType | None, new: T.DataType) -> Iterator[tuple[str, str | None, str, str]]:
        if old is None:
            yield path, None, new.simpleString(), "added"
        elif _inner(new) and type(old) is type(new):
            parts = _inner(old)
            for name, kind in _inner(new).items():
                yield from visit(f"{path}.{name}", parts.get(name), kind)
        elif old != new:
            change = "widened" if _plain_widening(old, new) else "refused"
            yield path, old.simpleString(), new.simpleString(), change

    parts = _inner(stored)
    for field in declared.fields:
        yield from visit(field.name, parts.get(field.name), field.dataType)


def _grown(value: Column, stored: T.DataType, declared: T.DataType) -> Column:
    """``value`` as the declared type where that is a widening; other parts stay."""
    if isinstance(stored, T.StructType) and isinstance(declared, T.StructType):
        old, new = _inner(stored), _inner(declared)
        fields = [
            (_grown(value.getField(name), kind, new[name]) if name in new else value.getField(name)).alias(name)
            for name, kind in old.items()
        ]
        fields += [F.lit(None).cast(kind).alias(name) for name, kind in new.items() if name not in old]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(stored, T.ArrayType) and isinstance(declared, T.ArrayType):
        return F.transform(value, lambda x: _grown(x, stored.elementType, declared.elementType))
    if isinstance(stored, T.MapType) and isinstance(declared, T.MapType):
        keys = F.transform_keys(value, lambda k, _: _grown(k, stored.keyType, declared.keyType))
        return F.transform_values(keys, lambda _, x: _grown(x, stored.valueType, declared.valueType))
    return value.cast(declared) if _plain_widening(stored, declared) else value


def reconcile(df: DataFrame, declared: T.StructType, refuse: bool = False) -> DataFrame:
    """``df`` with missing declared columns and nested fields added as null, and narrower
    types widened; nothing is dropped.

    A stored type that the declared one cannot hold (long for int, text for a number) keeps
    its column as it is, or with ``refuse`` raises a ``TypeError`` that names all of them.
    Widened are whole numbers to longer ones, to decimals with room for them and to floating
    types that hold them exactly, float to double, decimals to wider ones, dates to timestamps
    without zone, and columns without a type to any. Null structs, arrays and maps stay null.
    """
    changes = list(_changes(df.schema, declared))
    refused = [f"{path}: {old} to {new}" for path, old, new, change in changes if change == "refused"]
    if refuse and refused:
        raise TypeError("not a widening: " + ", ".join(refused))
    differs = [path for path, *_ in changes]
    columns = {}
    for field in declared.fields:
        if field.name not in df.columns:
            columns[field.name] = F.lit(None).cast(field.dataType)
        elif any(path == field.name or path.startswith(f"{field.name}.") for path in differs):
            columns[field.name] = _grown(df[f"`{field.name}`"], df.schema[field.name].dataType, field.dataType)
    return df.withColumns(columns) if columns else df


def reconcile_tables(
    spark: SparkSession, stored: dict[str, DataFrame], declared: dict[str, T.StructType], refuse: bool = False
) -> dict[str, DataFrame]:
    """Every stored and declared table: stored ones reconciled, missing ones empty."""
    grown = {name: reconcile(df, declared[name], refuse) if name in declared else df for name, df in stored.items()}
    return grown | {name: spark.createDataFrame([], kind) for name, kind in declared.items() if name not in stored}


def _pairs(spark: SparkSession, tables: dict[str, T.StructType]) -> DataFrame:
    rows = [(name, field.name) for name, schema in tables.items() for field in schema.fields]
    return spark.createDataFrame(rows, "table string, property string")


def schema_difference(
    spark: SparkSession, declared: dict[str, T.StructType], stored: dict[str, T.StructType]
) -> DataFrame:
    """(table, property) pairs that are declared but not stored."""
    return _pairs(spark, declared).exceptAll(_pairs(spark, stored))


def schema_changes(
    spark: SparkSession, declared: dict[str, T.StructType], stored: dict[str, T.StructType]
) -> DataFrame:
    """(table, property, stored, declared, change) for all that differs, nested parts by path.

    ``change`` is added, widened or refused. A table that is not stored has all its columns added.
    """
    rows = [
        (table, *change)
        for table, schema in declared.items()
        for change in _changes(stored.get(table, T.StructType()), schema)
    ]
    return spark.createDataFrame(rows, "table string, property string, stored string, declared string, change string")
