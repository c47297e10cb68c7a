"""Whole-number and bit arithmetic on long columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def ceil_div(x: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.call_function("div", x + n - F.lit(1), n)


def ceil_to(x: Column, n: Column | int) -> Column:
    """The least multiple of n that is not less than x."""
    return ceil_div(x, n) * (F.lit(n) if isinstance(n, int) else n)


def encode_device(major: Column, minor: Column) -> Column:
    """Major and minor numbers in one: 12 bits of major between the low 8 and the next 12 of minor."""
    low, high = minor.bitwiseAND(F.lit(0xFF)), F.shiftleft(minor.bitwiseAND(F.lit(0xFFF00)), 12)
    return low.bitwiseOR(F.shiftleft(major.bitwiseAND(F.lit(0xFFF)), 8)).bitwiseOR(high)


def device_major(device: Column) -> Column:
    return F.shiftrightunsigned(device, 8).bitwiseAND(F.lit(0xFFF))


def device_minor(device: Column) -> Column:
    return device.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftrightunsigned(device, 12).bitwiseAND(F.lit(0xFFF00)))


def parse_octal(field: Column) -> Column:
    """A numeric header field: up to the first NUL or space; empty is 0; another digit is an error."""
    digits = F.regexp_extract(F.ltrim(field), "^([^\\x00 ]*)", 1)
    bad = F.raise_error(F.concat(F.lit("not an octal number: "), digits)).cast("long")
    return F.when(digits == "", F.lit(0).cast("long")).when(digits.rlike("^[0-7]{1,21}$"), F.conv(digits, 8, 10).try_cast("long")).when(digits.isNotNull(), bad)


def parse_number(field: Column) -> Column:
    """A binary numeric header field: octal digits, or, if the top bit is set, 256 to each byte."""
    first = F.conv(F.hex(F.substring(field, 1, 1)), 16, 10).cast("int")
    rest = F.conv(F.hex(F.substring(field, 2, 255)), 16, 10).cast("decimal(38,0)")
    size = F.octet_length(field) - 1
    large = (first.bitwiseAND(F.lit(0x7F)).cast("decimal(38,0)") * F.pow(F.lit(256.0), size).cast("decimal(38,0)") + rest).try_cast("long")
    return F.when(first >= 128, large).otherwise(parse_octal(F.decode(field, "ISO-8859-1")))


def dos_time(seconds: Column) -> Column:
    """Epoch seconds as (date, time) words of two-second resolution; before 1980 is 1980-01-01."""
    s = F.greatest(seconds, F.lit(315532800).cast("long"))
    t = F.timestamp_seconds(s)
    date = F.shiftleft(F.year(t) - 1980, 9).bitwiseOR(F.shiftleft(F.month(t), 5)).bitwiseOR(F.dayofmonth(t))
    time = F.shiftleft(F.hour(t), 11).bitwiseOR(F.shiftleft(F.minute(t), 5)).bitwiseOR(F.call_function("div", F.second(t), F.lit(2)).cast("int"))
    return F.struct(date.alias("date"), time.alias("time"))


def from_dos_time(date: Column, time: Column) -> Column:
    """The words of dos_time as epoch seconds."""
    day = F.make_date(F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(F.lit(15)), date.bitwiseAND(F.lit(31)))
    h, m, s = F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(F.lit(63)), time.bitwiseAND(F.lit(31)) * 2
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + h * 3600 + m * 60 + s


def hash_buckets(level: Column, dir_level: Column) -> Column:
    """Buckets of a directory level: doubling, up to half of 63 levels."""
    n = level + dir_level
    return F.when(n < 31, F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))).otherwise(F.lit(1 << 30))


def bucket_blocks(level: Column) -> Column:
    return F.when(level < 31, 2).otherwise(4)


def saturating_add(a: Column, b: Column) -> Column:
    """Sum of non-negative longs that stops at the greatest long."""
    return F.coalesce(F.try_add(a, b), F.lit(2**63 - 1))
