"""Entries written as archives, one shard for each partition.

The writer is a Python data source, so tasks write their own shards at once and the driver
only commits; no archive is larger than its partition. The path must be one that every
executor can open.
"""

from __future__ import annotations

import io
import os
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..entries import XATTRS, InvalidArgument, Unsupported

COLUMNS = ("path", "kind", "mode", "uid", "gid", "mtime", "link_target", "dev_major", "dev_minor", "xattrs", "data")
# A tar header's type by kind.
_TYPES = {"Regular": b"0", "HardLink": b"1", "Symlink": b"2", "Char": b"3", "Block": b"4", "Dir": b"5", "Fifo": b"6"}


def _tar_header(name: bytes, prefix: bytes, flag: bytes, mode: int, uid: int, gid: int, size: int, mtime: int, target: bytes, major: int, minor: int) -> bytes:
    octal = lambda n, width: b"%0*o\0" % (width - 1, n)
    fields = ((name, 100), (octal(mode, 8), 8), (octal(uid, 8), 8), (octal(gid, 8), 8), (octal(size, 12), 12), (octal(mtime, 12), 12), (b" " * 8, 8), (flag, 1), (target, 100), (b"ustar\00000", 8), (b"", 64), (octal(major, 8), 8), (octal(minor, 8), 8), (prefix, 155), (b"", 12))
    h = b"".join(value.ljust(width, b"\0") for value, width in fields)
    return h[:148] + b"%06o\0 " % sum(h) + h[156:]


def _tar_name(raw: bytes) -> tuple[bytes, bytes] | None:
    """(prefix, name) of a member's name, parted at a slash if it is over 100 bytes; null if no parting fits."""
    if len(raw) <= 100:
        return b"", raw
    cuts = [i for i, c in enumerate(raw) if c == 0x2F and 0 < i <= 155 and 0 < len(raw) - i - 1 <= 100]
    return (raw[: cuts[0]], raw[cuts[0] + 1 :]) if cuts else None


def _tar(rows: Iterator, out: io.RawIOBase) -> int:
    """Members with an extended header for what a plain one can't hold: long names and targets, large numbers, attributes."""

    def member(header: bytes, body: bytes) -> None:
        out.write(header + body + b"\0" * (-len(body) % 512))

    n = 0
    for r in rows:
        if r.kind not in _TYPES:
            raise InvalidArgument(f"a tar holds no {r.kind}: {r.path}")
        raw, target = (r.path.lstrip("/") + "/" * (r.kind == "Dir")).encode(), (r.link_target or "").encode()
        if r.kind == "HardLink":
            target = target.lstrip(b"/")  # a member's name
        body = bytes(r.data or b"") if r.kind == "Regular" else b""
        numbers = {"uid": r.uid or 0, "gid": r.gid or 0, "mtime": max(r.mtime or 0, 0), "size": len(body)}
        more = {b"SCHILY.xattr." + x.name.encode(): bytes(x.value) for x in r.xattrs or ()}
        name = _tar_name(raw)
        if name is None:
            more[b"path"], name = raw, (b"", raw[:100])
        if len(target) > 100:
            more[b"linkpath"], target = target, target[:100]
        for key, width in (("uid", 7), ("gid", 7), ("mtime", 11), ("size", 11)):
            if numbers[key] >= 8**width:
                more[key.encode()], numbers[key] = b"%d" % numbers[key], 0
        if more:
            extended = b"".join(_tar_record(k, v) for k, v in more.items())
            member(_tar_header(b"PaxHeader/" + raw[-80:], b"", b"x", 0o644, 0, 0, len(extended), 0, b"", 0, 0), extended)
        member(_tar_header(name[1], name[0], _TYPES[r.kind], (r.mode or 0) & 0o7777, numbers["uid"], numbers["gid"], numbers["size"], numbers["mtime"], target, r.dev_major or 0, r.dev_minor or 0), body)
        n += 1
    out.write(b"\0" * 1024)
    return n


def _tar_record(key: bytes, value: bytes) -> bytes:
    """``length key=value`` and a line end; the length counts its own digits."""
    rest = len(key) + len(value) + 3
    size = rest + len(str(rest))
    size = rest + len(str(size))
    return b"%d %s=%s\n" % (size, key, value)


def _dos_words(seconds: int) -> tuple[int, int]:
    """(time, date) words of two-second resolution; none before 1980."""
    y, m, d, hour, minute, second = time.gmtime(min(max(seconds, 315532800), 4354819198))[:6]
    return hour << 11 | minute << 5 | second // 2, (y - 1980) << 9 | m << 5 | d


def _zip(rows: Iterator, out: io.RawIOBase) -> int:
    """Deflated members (empty ones stored), then their records; 64-bit fields stand only where 32 bits are too few.

    A body is a row's value of at most 2 GB, so only places need more than 32 bits.
    """
    records, at = [], 0
    for r in rows:
        if r.kind not in ("Regular", "Dir", "Symlink"):
            raise Unsupported(f"a zip holds no {r.kind}: {r.path}")
        name = (r.path.strip("/") + "/" * (r.kind == "Dir")).encode()
        if name in (b"", b"/"):
            if r.kind == "Dir":
                continue  # the root is implied
            raise InvalidArgument("a member without a name")
        if len(name) > 0xFFFF:
            raise InvalidArgument(f"a name of more than 65535 bytes: {r.path[:80]}")
        body = (r.link_target or "").encode() if r.kind == "Symlink" else bytes(r.data or b"") if r.kind == "Regular" else b""
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = deflate.compress(body) + deflate.flush() if body else b""
        unix = {"Dir": 0x4000, "Symlink": 0xA000}.get(r.kind, 0x8000) | (r.mode or 0) & 0o7777
        shared = struct.pack("<HHHHIIIHH", 0 if name.isascii() else 0x800, 8 if body else 0, *_dos_words(r.mtime or 0), zlib.crc32(body), len(packed), len(body), len(name), 0)
        out.write(b"PK\3\4" + struct.pack("<H", 20) + shared + name + packed)
        far = at >= 0xFFFFFFFF
        extra = struct.pack("<HHQ", 1, 8, at) if far else b""
        shared = shared[:-2] + struct.pack("<H", len(extra))
        records.append(b"PK\1\2" + struct.pack("<HH", 3 << 8 | 45, 45 if far else 20) + shared + struct.pack("<HHHII", 0, 0, 0, unix << 16 | (0x10 if r.kind == "Dir" else 0), min(at, 0xFFFFFFFF)) + name + extra)
        at += 30 + len(name) + len(packed)
    length = sum(map(len, records))
    for record in records:
        out.write(record)
    n = len(records)
    if n > 0xFFFF or at + length > 0xFFFFFFFF:
        out.write(b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 3 << 8 | 45, 45, 0, 0, n, n, length, at))
        out.write(b"PK\6\7" + struct.pack("<IQI", 0, at + length, 1))
    out.write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))
    return n


def _cpio(rows: Iterator, out: io.RawIOBase) -> int:
    def member(name: bytes, mode: int, uid: int, gid: int, mtime: int, body: bytes, ino: int) -> None:
        fields = (ino, mode, uid, gid, 1, mtime, len(body), 0, 0, 0, 0, len(name) + 1, 0)
        head = b"070701" + b"".join(b"%08X" % f for f in fields) + name + b"\0"
        out.write(head + b"\0" * (-len(head) % 4) + body + b"\0" * (-len(body) % 4))

    kinds, n = {"Dir": 0x4000, "Symlink": 0xA000, "Char": 0x2000, "Block": 0x6000, "Fifo": 0x1000}, 0
    for r in rows:
        n += 1
        body = (r.link_target or "").encode() if r.kind == "Symlink" else bytes(r.data or b"") if r.kind == "Regular" else b""
        member(r.path.lstrip("/").encode(), kinds.get(r.kind, 0x8000) | (r.mode or 0), r.uid or 0, r.gid or 0, max(r.mtime or 0, 0), body, n)
    member(b"TRAILER!!!", 0, 0, 0, 0, b"", 0)
    return n


def _ar(rows: Iterator, out: io.RawIOBase) -> int:
    n = 0
    out.write(b"!<arch>\n")
    for r in rows:
        name = r.path.lstrip("/")
        if "/" in name:
            raise InvalidArgument(f"an ar archive is flat: {r.path}")
        raw, body = name.encode(), bytes(r.data or b"")
        # Names that don't fit a field stand before the body.
        field, lead = (raw + b"/", b"") if len(raw) < 16 and b" " not in raw else (b"#1/%d" % len(raw), raw)
        out.write(b"%-16s%-12d%-6d%-6d%-8o%-10d`\n" % (field, max(r.mtime or 0, 0), r.uid or 0, r.gid or 0, 0o100000 | (r.mode or 0), len(lead) + len(body)) + lead + body + b"\n" * ((len(lead) + len(body)) % 2))
        n += 1
    return n


WRITERS: dict[str, Callable] = {"tar": _tar, "zip": _zip, "cpio": _cpio, "ar": _ar}


@dataclass
class _Shard(WriterCommitMessage):
    name: str
    members: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def write(self, rows: Iterator) -> _Shard:
        from pyspark import TaskContext

        c = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = f"shard-{c.partitionId():05d}.{self.kind}"
        part = f"{self.path}/.{name}.{c.taskAttemptId()}"
        with open(part, "wb") as out:
            n = WRITERS[self.kind](rows, out)
        if n:
            os.replace(part, f"{self.path}/{name}")
        else:
            os.remove(part)
        return _Shard(name, n)


class ArchiveShards(DataSource):
    """``df.write.format("archive_shards").option("kind", "tar").save(path)``"""

    @classmethod
    def name(cls) -> str:
        return "archive_shards"

    def writer(self, schema, overwrite: bool) -> _Writer:
        kind = self.options.get("kind", "tar")
        if kind not in WRITERS:
            raise InvalidArgument(f"kind {kind}")
        return _Writer(self.options["path"].removeprefix("file://").removeprefix("file:"), kind)


def spread(entries: DataFrame, path: str) -> None:
    """Regular files of entries (path, data) as files under a folder that every executor can open; a task run again replaces them."""
    import pyarrow as pa

    top = path.removeprefix("file://").removeprefix("file:")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ".." in name.split("/"):
                    raise InvalidArgument(f"a path that leaves its folder: {name}")
                at = f"{top}/{name.lstrip('/')}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(data or b"")
                os.replace(part, at)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    entries.where("kind = 'Regular'").select("path", "data").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def write(entries: DataFrame, path: str, kind: str = "tar", shards: int | None = None, filled: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """entries (with ``data``) as shards under path.

    Shards are ranges of paths, or without a number the partitions of entries; within each, entries
    stand in the order of ``rank`` and ``place`` if they have those columns (see merge.emission),
    else in path order: parents before children. filled adds ``data`` to entries that stand in
    their shards already, without moving them, so that no body is dealt out or sorted.
    """
    entries.sparkSession.dataSource.register(ArchiveShards)
    kinds = {"data": "binary", "path": "string", "kind": "string", "link_target": "string", "xattrs": XATTRS}
    missing = {c: F.lit(None).cast(kinds.get(c, "long")) for c in COLUMNS if c not in entries.columns}
    path_order = F.split("path", "/")
    order = ["rank", "place"] if {"rank", "place"} <= set(entries.columns) else [path_order]
    rows = entries.withColumns(missing) if missing else entries
    rows = (rows.repartitionByRange(shards, path_order) if shards else rows).sortWithinPartitions(*order)
    rows = filled(rows) if filled else rows
    rows.select(*COLUMNS).write.format("archive_shards").option("kind", kind).mode("append").save(path)
