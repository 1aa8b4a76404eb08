"""Row hashes, frame fingerprints and keyed pseudonyms."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F, types as T

HMAC_BLOCK = 64  # bytes in one SHA-256 block


def _stable(field: T.StructField) -> Column:
    """One spelling per value, so an int and a long column with equal content hash alike."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.IntegralType):
        return column.cast("long")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return column.cast("double") + F.lit(0.0)
    if isinstance(field.dataType, (T.StringType, T.BooleanType, T.DecimalType, T.BinaryType)):
        return column
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("string")
    return F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})


def row_hash(df: DataFrame, salt: int = 0) -> Column:
    """64-bit hash of a whole row.

    ``xxhash64`` skips nulls, so each value is preceded by its position: a null then
    still moves the hash and ("a", null) differs from (null, "a").
    """
    parts = [F.lit(salt)]
    for position, field in enumerate(df.schema.fields):
        parts += [F.lit(position), _stable(field)]
    return F.xxhash64(*parts)


def _hash_sum(df: DataFrame, salt: int) -> Column:
    """Sum of the row hashes as four sums of 16-bit pieces: exact beyond 10^14 rows."""
    pieces = [F.shiftrightunsigned(row_hash(df, salt), 16 * part).bitwiseAND(F.lit(0xFFFF)) for part in range(4)]
    return F.concat_ws("-", *[F.coalesce(F.sum(piece), F.lit(0)).cast("string") for piece in pieces])


def fingerprint_columns(df: DataFrame) -> list[Column]:
    """Aggregates that describe the content of ``df`` whatever the row order."""
    return [F.count(F.lit(1)).alias("row_count"), _hash_sum(df, 0).alias("hash_a"), _hash_sum(df, 1).alias("hash_b")]


def fingerprint_text(columns: list[str], row_count: int, hash_a: str, hash_b: str) -> str:
    material = "\x1f".join([*columns, str(row_count), hash_a, hash_b])
    return hashlib.sha256(material.encode("utf-8")).hexdigest()


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex as two nested ``sha2`` calls around constant pads (RFC 2104)."""
    secret = key.encode("utf-8")
    if len(secret) > HMAC_BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(HMAC_BLOCK, b"\0")
    inner = F.lit(bytearray(byte ^ 0x36 for byte in secret))
    outer = F.lit(bytearray(byte ^ 0x5C for byte in secret))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)
