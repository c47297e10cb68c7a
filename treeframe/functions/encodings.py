"""Names in old character sets, identifiers in mixed byte order, and binary number fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

# What an archive's names are tried as, in this order.
NAME_CHARSETS = ("utf-8", "shift_jis", "euc_jp", "iso8859_15")


def _decoder(charset: str, errors: str = "replace"):
    @pandas_udf(StringType())
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(charset, errors))

    return run


mac_roman = _decoder("mac_roman")
korean = _decoder("cp949")


@pandas_udf(BinaryType())
def to_korean(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s.encode("cp949", "replace"))


def decode_name(raw: bytes) -> str:
    """The first of NAME_CHARSETS that takes every byte."""
    for charset in NAME_CHARSETS:
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


@pandas_udf(StringType())
def archive_name(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode_name(bytes(b)))


def little(value: Column, at: int, n: int) -> Column:
    """n bytes from offset at, the least first, as a long."""
    h = F.hex(F.substring(value, at + 1, n))
    return F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(n - 1, -1, -1)]), 16, 10).cast("decimal(20,0)").cast("long")


def big(value: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(value, at + 1, n)), 16, 10).cast("decimal(20,0)").cast("long")


def mixed_uuid(raw: Column) -> Column:
    """Sixteen bytes whose first three groups are little-endian, as a UUID."""
    h = F.upper(F.hex(raw))
    pick = lambda *at: F.concat(*[F.substring(h, 2 * k + 1, 2) for k in at])
    return F.concat_ws("-", pick(3, 2, 1, 0), pick(5, 4), pick(7, 6), pick(8, 9), pick(10, 11, 12, 13, 14, 15))


def ucs2_big(raw: Column) -> Column:
    return F.decode(raw, "UTF-16BE")


def c_string(raw: Column) -> Column:
    """Bytes up to the first NUL as text."""
    return F.regexp_extract(F.decode(raw, "UTF-8"), "^([^\\x00]*)", 1)
