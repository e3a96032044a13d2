"""Canonical JSON as column expressions: keys sorted, no blanks, letters as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(text: Column) -> Column:
    """A text in quotes; quotes, backslashes and control characters escaped."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(0x20):
        full = F.replace(full, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The value as canonical JSON; nulls are written out.

    Decimals, dates and timestamps are written as texts, as they print; floating-point
    numbers are refused, since engines print them differently.
    """
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}":'), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.IntegralType | T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, T.DecimalType | T.DateType | T.TimestampType):
        text = json_string(value.cast("string"))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))
