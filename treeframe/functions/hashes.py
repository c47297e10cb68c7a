"""Checksums and name hashes.

Folds of shifts and adds over names and headers are higher-order functions over the bytes of
a column and stay in the JVM; those over whole data, and those that need unsigned products or
tables, run in Python over Arrow batches.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType, LongType

_MASK32 = 0xFFFFFFFF


def bytes_of(value: Column) -> Column:
    """The bytes of a binary or string column as an array of longs."""
    h = F.hex(value)
    n = F.octet_length(value)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _fold(value: Column, start: int, step) -> Column:
    return F.aggregate(bytes_of(value), F.lit(start).cast("long"), step)


def _rotate_right_add(bits: int):
    mask = (1 << bits) - 1
    return lambda s, b: (F.shiftright(s, 1).bitwiseOR(F.shiftleft(s.bitwiseAND(F.lit(1)), bits - 1)) + b).bitwiseAND(F.lit(mask).cast("long"))


def crc32(value: Column) -> Column:
    return F.crc32(value.cast("binary"))


def header_sum(block: Column) -> Column:
    """Sum of a 512-byte archive header's bytes, those of the checksum field taken as spaces."""
    return F.aggregate(bytes_of(F.concat(F.substring(block, 1, 148), F.lit(b" " * 8), F.substring(block, 157, 512))), F.lit(0).cast("long"), lambda s, b: s + b)


def short_name_checksum(name: Column) -> Column:
    """Eight bits, rotated right and added, over an 11-byte short name."""
    return _fold(name, 0, _rotate_right_add(8))


def _data_fold(f):
    """A fold over a whole text's or file's bytes, linear in them; null counts as empty."""

    @pandas_udf(LongType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: 0 if b is None else f(b.encode() if isinstance(b, str) else bytes(b))).astype("int64")

    return run


def rotate_add16_bytes(data: bytes) -> int:
    s = 0
    for b in data:
        s = ((s >> 1 | (s & 1) << 15) + b) & 0xFFFF
    return s


def rotate_add32_bytes(data: bytes) -> int:
    s = 0
    for b in data:
        s = ((s >> 1 | (s & 1) << 31) + b) & _MASK32
    return s


def descriptor_hash_bytes(data: bytes) -> int:
    """Rotate left by 3 and add, over little-endian 32-bit words."""
    s = 0
    for w in np.frombuffer(data, "<u4", len(data) // 4).tolist():
        s = ((s << 3 & _MASK32 | s >> 29) + w) & _MASK32
    return s


rotate_add16 = _data_fold(rotate_add16_bytes)
rotate_add32 = _data_fold(rotate_add32_bytes)
descriptor_hash = _data_fold(descriptor_hash_bytes)


def boot_checksum(data: Column) -> Column:
    """rotate_add32 over boot sectors without the bytes 106, 107 and 112, which change."""
    kept = F.filter(bytes_of(data), lambda b, i: ~i.isin(106, 107, 112))
    return F.aggregate(kept, F.lit(0).cast("long"), _rotate_right_add(32))


def directory_name_hash(name: Column) -> Column:
    """Rotate left by 7 and exclusive-or, a byte at a time, in 32 bits."""

    def step(h: Column, b: Column) -> Column:
        return b.bitwiseXOR(F.shiftleft(h, 7).bitwiseAND(F.lit(_MASK32)).bitwiseOR(F.shiftright(h, 25)))

    return _fold(name, 0, step)


def attribute_name_hash(name: Column) -> Column:
    """Rotate left by 5 and exclusive-or, in 32 bits."""

    def step(h: Column, b: Column) -> Column:
        return b.bitwiseXOR(F.shiftleft(h, 5).bitwiseAND(F.lit(_MASK32)).bitwiseOR(F.shiftright(h, 27)))

    return _fold(name, 0, step)


def _crc32c_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0x82F63B78 if n & 1 else n >> 1
        table.append(n)
    return table


_CRC32C = np.array(_crc32c_table(), np.uint32)
_CHUNK = 64


def _advanced(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that tables stand for."""
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def _chunk_tables(doublings: int) -> list[np.ndarray]:
    """For each k, what 2**k chunks of zero bytes make of a register, by its four bytes."""
    crc = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
    for _ in range(_CHUNK):
        crc = _CRC32C[crc & 0xFF] ^ crc >> 8
    out = [crc]
    while len(out) < doublings:
        out.append(_advanced(out[-1], out[-1]))
    return out


_ADVANCE = _chunk_tables(26)  # 2**32 bytes


def crc32c_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C, started and ended with all ones, of each of the byte strings raw[offsets[i]:offsets[i + 1]].

    A register is linear in its bytes, so all strings are cut into chunks counted from their ends,
    filled up with zeros in front, and advanced a byte at a time together; each chunk's register is
    then moved to its string's end by doublings. Starting with all ones is the same as the
    register of four bytes of ones, as long as the string, in front.
    """
    size = np.diff(offsets)
    count = np.maximum(-(-(size + 4) // _CHUNK), 1)
    last = np.cumsum(count)
    rows = np.zeros((int(last[-1]) if len(last) else 0, _CHUNK), np.uint8)
    # The register's ones go over the first four bytes; four zeros in front of a string change nothing.
    flat = rows.reshape(-1)
    begin = last * _CHUNK - size
    flat[np.arange(len(raw)) + np.repeat(begin - offsets[:-1], size)] = raw
    for k in range(4):
        at = begin + k
        held = size > k
        flat[at[held]] ^= 0xFF
    crc = np.zeros(len(rows), np.uint32)
    for column in rows.T:
        crc = _CRC32C[(crc ^ column) & 0xFF] ^ crc >> 8
    back = np.repeat(last, count) - 1 - np.arange(len(rows))
    for k in range(int(back.max(initial=0)).bit_length()):
        far = (back >> k & 1).astype(bool)
        crc[far] = _advanced(crc[far], _ADVANCE[k])
    out = np.bitwise_xor.reduceat(crc, last - count) if len(rows) else crc
    # Of a string of n < 4 bytes, 4 - n bytes of the ones are still in the register.
    short = np.maximum(4 - size, 0)
    return out ^ (_MASK32 >> (8 * (4 - short)).astype(np.uint64)).astype(np.uint32) * (short > 0) ^ np.uint32(_MASK32)


def _strings(values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, which are not null) of a column of bytes."""
    there = values.notna().to_numpy()
    held = [bytes(b) for b in values[there]]
    return np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in held])]).astype(np.int64), there


def _column(out: np.ndarray, there: np.ndarray) -> pd.Series:
    whole = pd.array(np.zeros(len(there), np.int64), "Int64")
    whole[there] = out.astype(np.int64)
    whole[~there] = pd.NA
    return pd.Series(whole)


@pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C, started and ended with all ones."""
    raw, offsets, there = _strings(data)
    return _column(crc32c_rows(raw, offsets), there)


def fletcher64_rows(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Fletcher's checksum of 32-bit little-endian words, the last filled up with zeros, of each byte string."""
    m, out = np.uint64(_MASK32), []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        w = np.zeros(-(-(b - a) // 4), "<u4")
        w.view(np.uint8)[: b - a] = raw[a:b]
        w = w.astype(np.uint64) % m
        # Products are below 2**61 for strings of 2 GB, and are reduced before they are added.
        first = int(w.sum() % m)
        second = int((w * np.arange(len(w), 0, -1, dtype=np.uint64) % m).sum() % m)
        low = _MASK32 - (first + second) % _MASK32
        out.append((_MASK32 - (first + low) % _MASK32) << 32 | low)
    return out


@pandas_udf(DecimalType(20, 0))
def fletcher64(data: pd.Series) -> pd.Series:
    """Fletcher's checksum of 32-bit words modulo 2**32 - 1, in the form that makes block and checksum sum to zero."""
    from decimal import Decimal

    raw, offsets, there = _strings(data)
    out = pd.Series([None] * len(data), dtype=object)
    out[there] = [Decimal(x) for x in fletcher64_rows(raw, offsets)]
    return out


def _blocks(raw: np.ndarray, offsets: np.ndarray, words: int, signed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit words by string, block and place; blocks of each string).

    A word is four bytes, the first the highest, added (as signed numbers, if so) with carries; a
    block that a string does not fill is filled up with words of the string's remaining length in
    every byte, and a word cut short has that length before its bytes.
    """
    size = np.diff(offsets)
    width = 4 * words
    count = np.maximum(-(-size // width), 1)
    most = int(count.max(initial=1))
    byte = np.zeros((len(size), most * width), np.int64)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
    byte[np.repeat(np.arange(len(size)), size), place] = raw.astype(np.int8) if signed else raw
    byte = byte.reshape(len(size), most, words, 4)
    left = np.maximum(size[:, None] - np.arange(most) * width, 0)  # from each block's start
    pad = (left & 0xFF) * 0x01010101
    held = np.clip(left[:, :, None] - np.arange(words) * 4, 0, 4)  # bytes of each word
    value = np.repeat(pad[:, :, None], words, 2)
    for k in range(4):
        value = np.where(held > k, byte[:, :, :, k] + (value << 8) & _MASK32, value)
    return value.astype(np.uint32), count


def _in_groups(rows):
    """rows over strings of like lengths together, so that a long one does not widen the others' table."""

    @functools.wraps(rows)
    def run(raw: np.ndarray, offsets: np.ndarray, **options) -> np.ndarray:
        size = np.diff(offsets)
        out, group = np.zeros(len(size), np.uint32), np.ceil(np.log2(size + 1))
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            own = np.concatenate([[0], np.cumsum(size[at])])
            out[at] = rows(raw[np.arange(own[-1]) + np.repeat(offsets[:-1][at] - own[:-1], size[at])], own, **options)
        return out

    return run


@_in_groups
def tea_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sixteen rounds of the tiny encryption algorithm over blocks of 16 bytes; ``.`` and ``..`` give 0."""
    words, count = _blocks(raw, offsets, 4, False)
    state = np.tile(np.array([0x67452301, 0xEFCDAB89], np.uint32), (len(count), 1))
    for at in range(words.shape[1]):
        k, (x, y), s = words[:, at].T, state.T.copy(), 0
        for _ in range(16):
            s = s + 0x9E3779B9 & _MASK32
            t = np.uint32(s)
            x = x + ((y << 4) + k[0] ^ y + t ^ (y >> 5) + k[1])
            y = y + ((x << 4) + k[2] ^ x + t ^ (x >> 5) + k[3])
        on = count > at
        state[on] += np.stack([x, y], 1)[on]
    size = np.diff(offsets)
    first, second = (raw[np.minimum(offsets[:-1] + k, max(len(raw) - 1, 0))] if len(raw) else np.zeros(len(size), np.uint8) for k in (0, 1))
    dots = (size > 0) & (size <= 2) & (first == 0x2E) & ((size == 1) | (second == 0x2E))
    return np.where(dots, 0, state[:, 0])


@_in_groups
def half_md4_rows(raw: np.ndarray, offsets: np.ndarray, seed: tuple[int, int, int, int] = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476), signed: bool = True) -> np.ndarray:
    """Three rounds of MD4's functions, eight steps each, over blocks of 32 bytes; the low bit is cleared."""
    rounds = (
        (lambda x, y, z: z ^ (x & (y ^ z)), 0, (3, 7, 11, 19), (0, 1, 2, 3, 4, 5, 6, 7)),
        (lambda x, y, z: (x & y) + ((x ^ y) & z), 0x5A827999, (3, 5, 9, 13), (1, 3, 5, 7, 0, 2, 4, 6)),
        (lambda x, y, z: x ^ y ^ z, 0x6ED9EBA1, (3, 9, 11, 15), (3, 7, 2, 6, 1, 5, 0, 4)),
    )
    words, count = _blocks(raw, offsets, 8, signed)
    state = np.tile(np.array(seed, np.uint32), (len(count), 1))
    for at in range(words.shape[1]):
        w, v = words[:, at].T, list(state.T.copy())
        for f, add, shifts, order in rounds:
            for i, k in enumerate(order):
                p, q, r, s = ((4 - i) % 4, (5 - i) % 4, (6 - i) % 4, (7 - i) % 4)
                x, n = v[p] + f(v[q], v[r], v[s]) + w[k] + np.uint32(add), shifts[i % 4]
                v[p] = x << n | x >> 32 - n
        on = count > at
        state[on] += np.stack(v, 1)[on]
    return state[:, 1] & np.uint32(_MASK32 - 1)


def _folded(name: str) -> bytes:
    """A name's case-folded canonical decomposition in UTF-32."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", name).casefold()).encode("utf-32-le")


def drec_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The low 22 bits of the register of CRC-32C over each folded name, started with all ones and not inverted."""
    return (crc32c_rows(raw, offsets) ^ np.uint32(_MASK32)) & np.uint32(0x3FFFFF)


def _name_hash(rows, as_bytes=str.encode):
    @pandas_udf(LongType())
    def run(name: pd.Series) -> pd.Series:
        raw, offsets, there = _strings(name.map(as_bytes, na_action="ignore"))
        return _column(rows(raw, offsets), there)

    return run


tea_hash = _name_hash(tea_rows)
half_md4_hash = _name_hash(half_md4_rows)
drec_hash = _name_hash(drec_rows, _folded)
