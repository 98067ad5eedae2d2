"""Values that JSON can hold: nulls for what is not finite, at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def holds_fractions(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(holds_fractions(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return holds_fractions(kind.elementType)
    if isinstance(kind, MapType):
        return holds_fractions(kind.valueType)
    return isinstance(kind, (DoubleType, FloatType))


def finite_values(c: Column, kind: DataType) -> Column:
    """``c`` of the type ``kind`` with null for each NaN and infinity in it: in fields of structs, elements of arrays and values of
    maps, however deep. Types without fractions stay as they are, null structs, arrays and maps stay null."""
    if not holds_fractions(kind):
        return c
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[finite_values(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite_values(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, x: finite_values(x, kind.valueType))
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def sanitised(rows: DataFrame) -> DataFrame:
    """All columns by ``finite_values``."""
    return rows.select(*[finite_values(rows[f"`{f.name}`"], f.dataType).alias(f.name) for f in rows.schema])


def sidecar(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., json, fingerprint): each row without its key as JSON, nulls written, and the SHA-256 of that text."""
    rest = [c for c in rows.columns if c not in key]
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"})
    return sanitised(rows).select(*key, text.alias("json")).withColumn("fingerprint", F.sha2("json", 256))
