"""Archives as entry relations.

Archives at local or mounted paths are mapped by the task that scans them, and bodies are read by
many tasks, each at its own offsets, so neither has to hold an archive. In other stores an archive
is a whole row of Spark's own reader, of at most 2 GB. A task turns each into entries with a few
lines of Python; bodies stay where they are, as offsets, until ``bodies`` reads them.
"""

from __future__ import annotations

import calendar
import gzip
import io
import lzma
import mmap
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from ..entries import ENTRIES, InvalidImage, Unsupported
from ..functions.encodings import decode_name

# Kinds by a tar header's type.
_TAR_KINDS = {b"\0": "Regular", b"0": "Regular", b"1": "HardLink", b"2": "Symlink", b"3": "Char", b"4": "Block", b"5": "Dir", b"6": "Fifo", b"7": "Regular"}
_MODE_KINDS = {0x1000: "Fifo", 0x2000: "Char", 0x4000: "Dir", 0x6000: "Block", 0x8000: "Regular", 0xA000: "Symlink", 0xC000: "Socket"}
_METHODS = {0: "stored", 8: "deflate", 93: "zstd"}
MOST_TARGET = 1 << 16  # bytes of a link's target
_ROWS, _BYTES = 5000, 1 << 24  # rows of a batch of entries; bytes of a batch of bodies, before its last one
_STRETCH = 20  # bits of an archive's offsets that one task reads together
_OPEN = 64  # archives that a task holds open


def _path(name: str) -> str:
    return "/" + "/".join(p for p in name.split("/") if p not in ("", "."))


def _entry(path: str, kind: str, size: int, offset: int, clen: int, method: str = "stored", **more) -> dict:
    return {"path": _path(path), "kind": kind, "size": size, "nlink": 1, "body": {"tag": "range", "offset": offset, "clen": clen, "ulen": size, "method": method}, **more}


def tar_number(field: bytes) -> int:
    """A numeric header field: octal up to a NUL or space, or binary if its top bit is set."""
    if field[:1] >= b"\x80":
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = re.split(rb"[\0 ]", field, maxsplit=1)[0]
    if digits.strip(b"01234567"):
        raise InvalidImage(f"not an octal number: {digits!r}")
    return int(digits or b"0", 8)


def _text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def tar_records(body: bytes) -> dict[str, bytes]:
    """The records of an extended header, each ``length key=value`` and a line end."""
    out = {}
    while body:
        m = re.match(rb"([0-9]+) ", body)
        record = body[m.end() : int(m[1])] if m else b""
        key, equals, value = record.partition(b"=")
        if not equals or value[-1:] != b"\n" or int(m[1]) > len(body):
            raise InvalidImage("a broken extended header record")
        out[key.decode("utf-8", "replace")] = value[:-1]
        body = body[int(m[1]) :]
    return out


def _resolved(name: str) -> str:
    """The path of a tar member: ``..`` takes the component before it away, and stops at the root."""
    kept: list[str] = []
    for part in name.split("/"):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return "/" + "/".join(kept)


def tar_entries(data: bytes) -> Iterator[dict]:
    """Members of a plain tar, in order.

    A header whose checksum is wrong is an error; two empty blocks, or the end of the data, end
    the archive. Extended and long-name headers hold for the next member; global ones do not
    count, and members of unknown types are left out with their bodies.
    """
    at, empty, more = 0, 0, {}
    while at + 512 <= len(data):
        h, at = data[at : at + 512], at + 512
        if not h.strip(b"\0"):
            empty += 1
            if empty == 2:
                return
            continue
        empty = 0
        if sum(h) - sum(h[148:156]) + 8 * 32 != tar_number(h[148:156].lstrip()):
            raise InvalidImage(f"a wrong header checksum at {at - 512}")
        flag, size = h[156:157], tar_number(h[124:136])
        if flag in b"xgLK" or flag not in _TAR_KINDS:
            body = data[at : at + size]
            at += -(-size // 512) * 512
            if flag == b"x":
                more |= tar_records(body)
            elif flag in (b"L", b"K"):
                more["path" if flag == b"L" else "linkpath"] = body.rstrip(b"\0")
            continue
        kind = _TAR_KINDS[flag]
        size = int(more.get("size", size))
        mtime = int(float(more["mtime"])) if "mtime" in more else tar_number(h[136:148])
        prefix, name = _text(h[345:500]), _text(h[:100])
        name = more["path"].decode("utf-8", "replace") if "path" in more else f"{prefix}/{name}" if prefix else name
        target = more["linkpath"].decode("utf-8", "replace") if "linkpath" in more else _text(h[157:257]) if kind in ("HardLink", "Symlink") else None
        xattrs = [{"name": k.removeprefix("SCHILY.xattr."), "value": v} for k, v in more.items() if k.startswith("SCHILY.xattr.")]
        length = size if kind == "Regular" else 0
        uid, gid, major, minor = (tar_number(h[a : a + 8]) for a in (108, 116, 329, 337))
        yield _entry(_resolved(name), kind, length, at, length, mode=tar_number(h[100:108]) & 0o7777, uid=uid, gid=gid, mtime=mtime & 0xFFFFFFFF, dev_major=major, dev_minor=minor, link_target=target, xattrs=xattrs)
        at += -(-length // 512) * 512
        more = {}


def _directory(data: bytes) -> tuple[int, int]:
    """(place, length) of a zip's central directory, whose end record stands last, before a comment of a stated length."""
    for at in range(len(data) - 22, max(-1, len(data) - 22 - 0xFFFF - 1), -1):
        if data[at : at + 4] == b"PK\5\6" and at + 22 + int.from_bytes(data[at + 20 : at + 22], "little") == len(data):
            break
    else:
        raise InvalidImage("no end record of a zip archive")
    length, place = struct.unpack_from("<II", data, at + 12)
    if at >= 20 and data[at - 20 : at - 16] == b"PK\6\7":
        (end,) = struct.unpack_from("<Q", data, at - 12)
        if data[end : end + 4] != b"PK\6\6" or end + 56 > len(data):
            raise InvalidImage("a locator without its 64-bit end record")
        length, place = struct.unpack_from("<QQ", data, end + 40)
    if place + length > len(data):
        raise InvalidImage("a central directory beyond the archive's end")
    return place, length


def _extras(field: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, value) of an extra field's parts; a part that is cut short ends it."""
    at = 0
    while at + 4 <= len(field):
        tag, n = struct.unpack_from("<HH", field, at)
        if at + 4 + n > len(field):
            return
        yield tag, field[at + 4 : at + 4 + n]
        at += 4 + n


def _dos_seconds(date: int, time: int) -> int:
    month, day = max(date >> 5 & 15, 1), max(date & 31, 1)
    return calendar.timegm(((date >> 9) + 1980, min(month, 12), day, time >> 11, time >> 5 & 63, (time & 31) * 2, 0, 0, 0))


def zip_entries(data: bytes) -> Iterator[dict]:
    """Members in the order of the central directory; bodies stand after their local headers.

    Sizes and places of 32 ones are in the 64-bit extra field, a time stamp there goes before the
    DOS one, and names without the UTF-8 flag are decoded by trial. The end record's count of
    members is not checked.
    """
    place, length = _directory(data)
    at, end = place, place + length
    while at + 46 <= end and data[at : at + 4] == b"PK\1\2":
        made, _, flags, method, time, date, _, clen, ulen, n, m, c, _, _, attributes, local = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
        at += 46
        raw, extra = data[at : at + n], data[at + n : at + n + m]
        at += n + m + c
        if at > end:
            raise InvalidImage("a member's record goes beyond the central directory")
        mtime = _dos_seconds(date, time)
        for tag, value in _extras(extra):
            if tag == 1:
                wide = iter(struct.unpack(f"<{len(value) // 8}Q", value[: len(value) // 8 * 8]))
                ulen, clen, local = (next(wide, x) if x == 0xFFFFFFFF else x for x in (ulen, clen, local))
            elif tag == 0x5455 and len(value) >= 5 and value[0] & 1:
                (mtime,) = struct.unpack_from("<I", value, 1)
        if data[local : local + 4] != b"PK\3\4" or local + 30 > len(data):
            raise InvalidImage(f"no local header at {local}")
        body = local + 30 + sum(struct.unpack_from("<HH", data, local + 26))
        if body + clen > len(data):
            raise InvalidImage(f"a member at {local} goes beyond the archive's end")
        name = raw.decode("utf-8", "replace") if flags & 0x800 else decode_name(raw)
        unix = attributes >> 16 if made >> 8 == 3 else 0
        kind = "Dir" if name.endswith("/") else "Symlink" if unix & 0xF000 == 0xA000 else "Regular"
        how = _METHODS.get(method, f"unsupported:{method}")
        target = inflated(data[body : body + clen], how, MOST_TARGET).decode("utf-8", "replace") if kind == "Symlink" else None
        yield _entry(name, kind, ulen if kind == "Regular" else 0, body, clen, how, mode=unix & 0o7777 or (0o755 if kind == "Dir" else 0o644), uid=0, gid=0, mtime=mtime, link_target=target)


def inflated(raw: bytes, method: str, most: int) -> bytes:
    """A member's body in the clear; an error if it is longer than ``most``, cut short or of another method."""
    if method == "stored":
        return raw
    if method == "zstd":
        return decompress(raw, "zstd", most)
    if method != "deflate":
        raise Unsupported(method)
    stream = zlib.decompressobj(-15)
    out = stream.decompress(raw, most)
    if stream.unconsumed_tail or not stream.eof:
        raise InvalidImage(f"a member of more than {most} bytes in the clear, or one cut short")
    return out


def cpio_entries(data: bytes) -> Iterator[dict]:
    """newc (with or without checksum) and odc; a trailer ends it."""
    at = 0
    while at + 6 <= len(data):
        magic = data[at : at + 6]
        if magic in (b"070701", b"070702"):
            f = [int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13)]
            mode, uid, gid, mtime, size, major, minor, n, head, align = f[1], f[2], f[3], f[5], f[6], f[9], f[10], f[11], 110, 4
        elif magic == b"070707":
            o = lambda a, n: int(data[at + a : at + a + n], 8)
            mode, uid, gid, mtime, size, n, head, align = o(18, 6), o(24, 6), o(30, 6), o(48, 11), o(65, 11), o(59, 6), 76, 1
            major, minor = o(36, 6) >> 8, o(36, 6) & 0xFF
        else:
            raise InvalidImage("not a cpio header")
        name = data[at + head : at + head + n - 1].decode("utf-8", "replace")
        body = at + -(-(head + n) // align) * align
        if name == "TRAILER!!!":
            return
        kind = _MODE_KINDS.get(mode & 0xF000, "Regular")
        target = data[body : body + size].decode("utf-8", "replace") if kind == "Symlink" else None
        yield _entry(name, kind, size if kind == "Regular" else 0, body, size, mode=mode & 0o7777, uid=uid, gid=gid, mtime=mtime, dev_major=major, dev_minor=minor, link_target=target)
        at = body + -(-size // align) * align


def ar_entries(data: bytes) -> Iterator[dict]:
    """Flat members with short, table or in-body names; symbol tables are left out."""
    if data[:8] != b"!<arch>\n":
        raise InvalidImage("not an ar archive")
    at, long_names = 8, b""
    while at + 60 <= len(data) and data[at + 58 : at + 60] == b"`\n":
        h = data[at : at + 60]
        number = lambda a, n, base=10: int(h[a : a + n].split()[0], base) if h[a : a + n].strip() else 0
        name, size, body = h[:16].decode("latin-1").rstrip(), number(48, 10), at + 60
        at = body + size + size % 2
        if name == "//":
            long_names = data[body : body + size]
            continue
        if name in ("/", "/SYM64/") or name.startswith("__.SYMDEF"):
            continue
        if name.startswith("#1/"):
            n = int(name[3:])
            name, body, size = data[body : body + n].rstrip(b"\0").decode("utf-8", "replace"), body + n, size - n
        elif name[:1] == "/" and name[1:].isdigit():
            name = long_names[int(name[1:]) :].split(b"\n")[0].decode("utf-8", "replace").removesuffix("/")
        yield _entry(name.removesuffix("/"), "Regular", size, body, size, mode=number(40, 8, 8) & 0o7777, uid=number(28, 6), gid=number(34, 6), mtime=number(16, 12))


READERS = {"tar": tar_entries, "zip": zip_entries, "cpio": cpio_entries, "ar": ar_entries}


def decompress(data: bytes, codec: str | None, most: int) -> bytes:
    """Whole data in the clear; an error if there is more than ``most`` bytes of it."""
    if not codec:
        return data
    if codec == "zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read(most + 1)
    elif codec in ("gzip", "xz", "lzma"):
        stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if codec == "gzip" else lzma.LZMAFile(io.BytesIO(data))
        out = stream.read(most + 1)
    else:
        raise Unsupported(f"codec {codec}")
    if len(out) > most:
        raise InvalidImage(f"more than {most} bytes in the clear")
    return out


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def at_hand(spark: SparkSession, path: str) -> bool:
    """Whether path is in a file system that tasks open by themselves; other stores only Spark reads."""
    named = re.match("([A-Za-z][A-Za-z0-9+.-]*):", path)
    store = named[1] if named else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").partition(":")[0]
    return store == "file"


def _mapped(source: str):
    """A file's bytes, of which the task holds what it reads."""
    with open(re.sub("^file:(//)?(?=/)", "", source), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.seek(0, 2) else b""


def scan(spark: SparkSession, path: str, kind: str = "tar", codec: str | None = None, most: int = 1 << 30) -> DataFrame:
    """Entries of every archive under path, in stream order (seq), later members of one name included."""
    from pyspark.sql.pandas.types import to_arrow_schema

    read, names, here = READERS[kind], ENTRIES.fieldNames(), at_hand(spark, path)

    def run(batches):
        schema = to_arrow_schema(ENTRIES)
        for batch in batches:
            for k, source in enumerate(batch.column(0).to_pylist()):
                found = enumerate(read(decompress(_mapped(source) if here else batch.column(1)[k].as_py(), codec, most)))
                while rows := [{**dict.fromkeys(names), "source": source, "layer": 0, "seq": n, **e} for n, e in islice(found, _ROWS)]:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _listed(spark, path).select("path", *[] if here else ["content"]).mapInArrow(run, ENTRIES)


def _cut(data, body: dict, most: int) -> bytes:
    raw = data[body["offset"] : body["offset"] + body["clen"]]
    if len(raw) != body["clen"]:
        raise InvalidImage(f"a member at {body['offset']} goes beyond the archive's end")
    return inflated(raw, body["method"], most)


def with_data(entries: DataFrame, codec: str | None = None, most: int = 1 << 30) -> DataFrame:
    """entries of archives at hand with ``data``, the bytes of regular files, in the order in which they are."""
    entries = entries.drop("data")
    schema = StructType([*entries.schema.fields]).add("data", BinaryType())

    def run(batches):
        opened = lru_cache(1 if codec else _OPEN)(lambda source: decompress(_mapped(source), codec, most))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("kind", "source", "body")]
            held, size, start = [], 0, 0
            for kind, source, body in zip(*columns, strict=True):
                held.append(_cut(opened(source), body, most) if kind == "Regular" and body else None)
                size += len(held[-1] or b"")
                if size >= _BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], names)
                    held, size, start = [], 0, start + len(held)
            if held:
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], names)

    names = schema.fieldNames()
    return entries.mapInArrow(run, schema)


def bodies(spark: SparkSession, entries: DataFrame, path: str, codec: str | None = None, most: int = 1 << 30) -> DataFrame:
    """entries with ``data``, their bytes; deflated and zstd members are opened, other methods are an error.

    Archives at hand are read in stretches dealt out to all tasks, compressed ones by one task
    each. Of other stores' archives a task cuts the bodies that are asked for out of a row, and
    these meet their entries; no entry meets a whole archive.
    """
    wanted, n = entries.where("kind = 'Regular'"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if at_hand(spark, path):
        return with_data(wanted.repartition(n, "source").sortWithinPartitions("source") if codec else wanted.repartition(n, "source", F.shiftright("body.offset", _STRETCH)), codec, most)

    def run(batches):
        for batch in batches:
            for k, source in enumerate(batch.column(0).to_pylist()):
                data = decompress(batch.column(1)[k].as_py(), codec, most)
                held, size = [], 0
                for body in batch.column(2)[k].as_py():
                    held.append({"_source": source, "_place": body, "data": _cut(data, body, most)})
                    size += len(held[-1]["data"])
                    if size >= _BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    places = wanted.groupBy("source").agg(F.collect_set(F.struct("body.offset", "body.clen", "body.method")).alias("places"))
    files = _listed(spark, path).join(places.withColumnRenamed("source", "path"), "path").select("path", "content", "places")
    cut = StructType().add("_source", "string").add("_place", files.schema["places"].dataType.elementType).add("data", BinaryType())
    schema = to_arrow_schema(cut)
    found = files.mapInArrow(run, cut)
    same = (F.col("source") == F.col("_source")) & (F.struct("body.offset", "body.clen", "body.method") == F.col("_place"))
    return wanted.drop("data").join(found, same).drop("_source", "_place")
