"""Hashes and seeded orders (H1, H2, H5, H6)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def priority(seed: int | str, key: Column) -> Column:
    """H1: the first 128 bits of SHA-256 of seed, a zero character and the key, as 32 hex digits, whose order is
    that of the number."""
    return F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}\0"), key.cast("string")), "UTF-8"), 256), 1, 32)


def blake2b_hex(seed: int | str, size: int = 16):
    """H2: an Arrow function, as Spark has no BLAKE2b."""

    @F.pandas_udf(StringType())
    def ranked(key: pd.Series) -> pd.Series:
        return key.map(lambda k: None if k is None else hashlib.blake2b(f"{seed}\0{k}".encode(), digest_size=size).hexdigest())

    return ranked


def content_sha256(content: Column) -> Column:
    """H5."""
    return F.sha2(content, 256)


def content_crc32(content: Column) -> Column:
    """H5."""
    return F.crc32(content)


def is_digest(text: Column) -> Column:
    """F11."""
    return text.rlike("^[0-9a-f]{64}$")


def pixels_sha256(width: Column, height: Column, rgb: Column) -> Column:
    """H5: digest of decoded pixels, a header of the size before the RGB bytes."""
    return F.sha2(F.concat(F.encode(F.format_string("RGB:%dx%d:", width, height), "UTF-8"), rgb), 256)


def tensor_sha256(dtype: Column, shape: Column, data: Column) -> Column:
    """H6: digest of a tensor (type name, array of sizes, bytes): the length of its description as eight bytes, the
    description as compact JSON, and the bytes."""
    header = F.concat(F.lit('{"dtype":"'), dtype, F.lit('","shape":['), F.array_join(shape.cast("array<string>"), ","), F.lit("]}")).cast("binary")
    size = F.unhex(F.lpad(F.hex(F.length(header).cast("bigint")), 16, F.lit("0")))
    return F.sha2(F.concat(size, header, data), 256)


def state_fingerprint(names: Column, digests: Column) -> Column:
    """H6: one digest of the named parts' digests, in the order of the names."""
    parts = F.array_sort(F.zip_with(names, digests, lambda n, d: F.concat(n, F.lit("="), d)))
    return F.sha2(F.encode(F.array_join(parts, "\n"), "UTF-8"), 256)
