"""Canonical JSON as a column: sorted keys, no spaces, UTF-8, and digests of it.

Strings keep their characters; only quotation marks, backslashes and control characters are escaped, the latter as
\\b \\t \\n \\f \\r or \\u00xx in lower case. A null is `null` wherever it stands. Floating-point numbers have no spelling that
engines share, so a type that holds them is refused; decimals keep their scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of control characters that have a short form; the others are written as \\u00xx.
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def quoted(text: Column) -> Column:
    """A JSON string."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(_SHORT.get(k, f"\\u{k:04x}"))), range(32), plain)
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), controls).otherwise(plain), F.lit('"'))


def canonical(value: Column, kind: T.DataType) -> Column:
    """value, which is of the type `kind`, as canonical JSON; keys of structs and of maps in the order of their bytes."""
    if isinstance(kind, T.StringType):
        out = quoted(value)
    elif isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        out = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: canonical(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pair = lambda k: F.concat(quoted(k), F.lit(":"), canonical(F.element_at(value, k), kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), pair), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        pairs = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.coalesce(F.when(value.isNotNull(), out), F.lit("null"))


def canonical_row(schema: T.StructType, *names: str) -> Column:
    """The columns named (default: all) as one canonical object."""
    kind = T.StructType([f for f in schema.fields if not names or f.name in names])
    return canonical(F.struct(*kind.names), kind)


def namespaced_digest(namespace: str, json: Column) -> Column:
    """sha256:<hex> of the namespace, a line end and the JSON's bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(namespace + "\n"), json), 256))
