"""Newline-delimited JSON without a fixed schema, kept as VARIANT so that an absent attribute
stays apart from a null one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

VARIANT = "_variant"


def concrete(kind: T.DataType) -> T.DataType:
    """A type that can be grouped and compared: fractions as double, mixed values as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, concrete(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(concrete(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def step(name: str) -> str:
    return f".{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else "['" + name.replace("'", "\\'") + "']"


def get(variant: Column, path: str, kind: T.DataType | str) -> Column:
    return F.try_variant_get(variant, path, kind if isinstance(kind, str) else kind.simpleString())


def spread(df: DataFrame, schema: str | None = None, variant: str = VARIANT) -> DataFrame:
    """df, which has one VARIANT column of objects, with a typed column for each attribute
    that any row has; the VARIANT column stays. The types come from one pass over the rows,
    or without one from a schema such as `a long, e struct<f: string>`."""
    if schema:
        kind = T._parse_datatype_string(schema)
    else:
        found = df.agg(F.schema_of_variant_agg(F.col(variant))).first()[0] or "VOID"
        if not found.startswith("OBJECT<"):
            return df
        kind = concrete(T._parse_datatype_string(re.sub(r"\bOBJECT<", "STRUCT<", found)))
    return df.select(*(get(F.col(variant), "$" + step(f.name), f.dataType).alias(f.name) for f in kind.fields), variant)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files of one JSON object per line."""
    return spread(spark.read.option("singleVariantColumn", VARIANT).json(path), schema)


def parse(lines: DataFrame, line_col: str = "value", schema: str | None = None) -> DataFrame:
    return spread(lines.where(F.length(F.trim(F.col(line_col))) > 0).select(F.parse_json(F.col(line_col)).alias(VARIANT)), schema)
