"""Hashed vectors, dot products and 8-bit compression as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import let


def hash_number(token: Column, at: int, length: int) -> Column:
    """Hex digits of the token's SHA-1, from a place on, as a number."""
    return F.conv(F.substring(F.sha1(token.cast("binary")), at, length), 16, 10).cast("bigint")


def term_weight(token: Column) -> Column:
    """0.75 plus the first byte of the hash over 255. [D5]"""
    return F.lit(0.75) + hash_number(token, 1, 2) / F.lit(255.0)


def dense_bucket(token: Column, dimensions: int) -> Column:
    return F.pmod(hash_number(token, 1, 8), F.lit(dimensions))


def dense_value(token: Column) -> Column:
    """The signed weight of one occurrence. [D6]"""
    return F.when(hash_number(token, 9, 2) % 2 == 0, term_weight(token)).otherwise(-term_weight(token))


def token_entries(token: Column, dimensions: int) -> Column:
    """The three signed buckets of a token's own vector, before collisions add up. [D8]"""
    return F.array(*[F.struct(F.pmod(hash_number(token, at, 8), F.lit(dimensions)).alias("bucket"), F.when(hash_number(token, at, 2) % 2 == 0, 1.0).otherwise(-1.0).alias("value")) for at in (1, 9, 17)])


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length. [D7, D9]"""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quantize(values: Column) -> Column:
    """struct<compression, scale, values>: bytes of at most 127 and their scale; halves go to even. [D20]"""
    top = F.coalesce(F.array_max(F.transform(values, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    scale = F.when(top > 0, top / F.lit(127.0)).otherwise(F.lit(1.0))
    whole = lambda scale: F.transform(values, lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(x.cast("double") / scale))).cast("tinyint"))
    return let(scale, lambda s: F.struct(F.lit("int8").alias("compression"), s.alias("scale"), whole(s).alias("values")))


def quantize_rows(rows: Column) -> Column:
    """The same of an array of arrays, under one scale."""
    top = F.coalesce(F.array_max(F.transform(F.flatten(rows), lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    whole = lambda s: F.transform(rows, lambda r: F.transform(r, lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(x.cast("double") / s))).cast("tinyint")))
    return let(F.when(top > 0, top / F.lit(127.0)).otherwise(F.lit(1.0)), lambda s: F.struct(F.lit("int8").alias("compression"), s.alias("scale"), whole(s).alias("values")))


def dequantize_rows(packed: Column) -> Column:
    numbers = F.transform(packed["values"], lambda r: F.transform(r, lambda x: x.cast("double") * packed["scale"]))
    return F.when(packed["compression"] == "int8", numbers).otherwise(F.raise_error(F.concat(F.lit("Unsupported embedding compression: "), packed["compression"])))


def dequantize(packed: Column) -> Column:
    """The numbers again; a compression of another kind is an error."""
    fine = packed["compression"] == "int8"
    return F.when(fine, F.transform(packed["values"], lambda x: x.cast("double") * packed["scale"])).otherwise(F.raise_error(F.concat(F.lit("Unsupported embedding compression: "), packed["compression"])))


def maybe_compress(values: Column, compression: str, rows: bool = False) -> Column:
    if compression in ("none", ""):
        return values
    if compression != "int8":
        raise ValueError(f"Unsupported embedding compression: {compression}")
    return quantize_rows(values) if rows else quantize(values)


def maybe_dequantize(df: DataFrame, name: str, rows: bool = False) -> Column:
    """A column of df as numbers, whether it is compressed or not."""
    packed = df.schema[name].dataType.typeName() == "struct"
    return (dequantize_rows if rows else dequantize)(F.col(name)) if packed else F.col(name)
