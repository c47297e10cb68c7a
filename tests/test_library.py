"""The library's own operators: literal expectations, a replayed merge, and archives made here."""

import io
import os
import random
import struct
import sys
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from treeframe import api
from treeframe.functions import bits, display, encodings, hashes, paths
from treeframe.operators import analyze, links, listing, lookups, merge, mutate
from treeframe.sinks import archives as sinks
from treeframe.sources import archives, detect, partitions
from treeframe.streaming import layers


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_analyze_literal(spark):
    e = spark.createDataFrame([("/d", "Dir", 0), ("/d/a", "Regular", 4096), ("/d/b", "Regular", 100), ("/d/l", "Symlink", 0), ("/d/c", "Char", 0), ("/d/h", "HardLink", 0)], "path string, kind string, size long")
    r = analyze.analyze(e).first()
    assert (r.files, r.dirs, r.symlinks, r.devices, r.hardlinks, r.bytes, r.inodes) == (2, 1, 1, 1, 1, 4196, 24)
    assert r.fat32_size == -(-max(2 * 4196, 65525 * 1024) // 512) * 512
    empty = analyze.analyze(e.limit(0), 1024).first()
    assert empty.inodes == 16 and empty.ext2_blocks >= 64 and empty.ext4_size > empty.ext2_size


def test_paths(spark):
    p = spark.createDataFrame([("",), ("/",), ("a",), ("/a/",), ("a/b/",), ("./a//b/./c",), ("///",)], "path string")
    assert [r[0] for r in p.select(paths.normalise_keeping(F.col("path"))).collect()] == ["/", "/", "/a", "/a", "/a/b", "/a/b/c", "/"]
    got = spark.range(1).select(paths.parent(F.lit("/a")), paths.parent(F.lit("/")), paths.ancestors(F.lit("/a/b/c")), paths.fits_header(F.lit("x" * 101)), paths.fits_header(F.lit("d/" + "x" * 99)), paths.truncate_left(F.lit("abcdef"), 3)).first()
    assert tuple(got) == ("/", None, ["/a", "/a/b"], False, True, "…ef")


def test_display(spark):
    got = spark.range(1).select(
        display.mode_string(F.lit("Dir"), F.lit(0o1777)), display.human_size(F.lit(1536).cast("long")), display.unix_iso(F.lit(4294967295)), display.attribute_value(F.lit(b"a\"b\n")), display.attribute_value(F.lit(bytes(range(20)))), display.parse_bool(F.lit("Yes")), bits.parse_octal(F.lit("0000644 ")), bits.parse_octal(F.lit(""))
    ).first()
    assert tuple(got)[:4] == ("drwxrwxrwt", "1.50 KiB", "2106-02-07T06:28:15Z", '"a\\"b"')
    assert got[4] == "<20 bytes> " + " ".join(f"{b:02x}" for b in range(16)) + "…" and tuple(got)[5:] == (True, 420, 0)


M32 = 0xFFFFFFFF


def plain_words(name, count, signed):
    pad = (len(name) & 0xFF) * 0x01010101
    out, value = [], pad
    for i, b in enumerate(name[: count * 4]):
        value = ((b - 256 if signed and b > 127 else b) + (value << 8)) & M32
        if i % 4 == 3:
            out.append(value)
            value = pad
    return (out + [value] + [pad] * count)[:count]


def plain_tea(name):
    a, b = 0x67452301, 0xEFCDAB89
    for at in range(0, max(len(name), 1), 16):
        k, x, y, s = plain_words(name[at:], 4, False), a, b, 0
        for _ in range(16):
            s = (s + 0x9E3779B9) & M32
            x = (x + (((y << 4) + k[0]) ^ (y + s) ^ ((y >> 5) + k[1]))) & M32
            y = (y + (((x << 4) + k[2]) ^ (x + s) ^ ((x >> 5) + k[3]))) & M32
        a, b = (a + x) & M32, (b + y) & M32
    return 0 if name in (b".", b"..") else a


def plain_half_md4(name, signed=True):
    state = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    for at in range(0, max(len(name), 1), 32):
        w, (a, b, c, d) = plain_words(name[at:], 8, signed), state
        for f, add, shifts, order in (
            (lambda x, y, z: (x & y) | (~x & z), 0, (3, 7, 11, 19), range(8)),
            (lambda x, y, z: (x & y) | (x & z) | (y & z), 0x5A827999, (3, 5, 9, 13), (1, 3, 5, 7, 0, 2, 4, 6)),
            (lambda x, y, z: x ^ y ^ z, 0x6ED9EBA1, (3, 9, 11, 15), (3, 7, 2, 6, 1, 5, 0, 4)),
        ):
            for i, k in enumerate(order):
                x = (a + (f(b, c, d) & M32) + w[k] + add) & M32
                x = (x << shifts[i % 4] | x >> 32 - shifts[i % 4]) & M32
                a, b, c, d = d, x, b, c
        state = [(s + v) & M32 for s, v in zip(state, (a, b, c, d), strict=True)]
    return state[1] & ~1


def plain_fletcher(data):
    w = struct.unpack(f"<{-(-len(data) // 4)}I", data + b"\0" * (-len(data) % 4))
    first = second = 0
    for x in w:
        first = (first + x) % M32
        second = (second + first) % M32
    low = M32 - (first + second) % M32
    return (M32 - (first + low) % M32) << 32 | low


def plain_crc32c(data):
    crc = M32
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ M32


def test_hashes_like_plain_ones():
    """Strings of all lengths about the words, blocks and chunks, with all bytes."""
    import random

    import numpy as np

    pick = random.Random(3)
    names = [b".", b"..", b"", b".a", *(bytes(pick.randrange(256) for _ in range(n)) for n in [*range(70), 127, 128, 129, 255, 256, 257, 4095, 4096, 9000] for _ in range(3))]
    raw, offsets = np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(n) for n in names])])
    for rows, plain in ((hashes.crc32c_rows, plain_crc32c), (hashes.tea_rows, plain_tea), (hashes.half_md4_rows, plain_half_md4), (hashes.fletcher64_rows, plain_fletcher)):
        assert [int(x) for x in rows(raw, offsets)] == [plain(n) for n in names], rows
        assert len(rows(raw[:0], offsets[:1])) == 0
    assert [int(x) for x in hashes.half_md4_rows(raw, offsets, signed=False)] == [plain_half_md4(n, False) for n in names]


def test_hashes(spark):
    d = spark.createDataFrame([(b"123456789",)], "b binary")
    r = d.select(hashes.crc32(F.col("b")), hashes.crc32c("b")).first()
    assert tuple(r) == (zlib.crc32(b"123456789"), 0xE3069283)
    names = spark.createDataFrame([(".",), ("..",), (None,), ("abc",), ("",)], "n string")
    got = names.select(hashes.tea_hash("n"), hashes.half_md4_hash("n"), hashes.drec_hash("n"), hashes.fletcher64(F.col("n").cast("binary"))).collect()
    assert [r[0] for r in got[:3]] == [0, 0, None] and tuple(got[2]) == (None,) * 4 and got[3][1] == plain_half_md4(b"abc") and got[3][0] == plain_tea(b"abc")

    def rotated(data, width):
        s = 0
        for b in data:
            s = ((s >> 1 | (s & 1) << (width - 1)) + b) & ((1 << width) - 1)
        return s

    got = d.select(hashes.short_name_checksum(F.col("b")), hashes.rotate_add16(F.col("b")), hashes.rotate_add32(F.col("b"))).first()
    assert tuple(got) == tuple(rotated(b"123456789", n) for n in (8, 16, 32))


def replayed(events):
    tree = {}
    for event, path, kind, t in events:
        if event == "I":
            if tree.get(path, (None,))[0] == "Dir" and kind != "Dir":
                tree = {p: v for p, v in tree.items() if not p.startswith(path + "/")}
            tree[path] = (kind, t)
        else:
            tree = {p: v for p, v in tree.items() if not p.startswith(path + "/") and (event == "O" or p != path)}
    return sorted((p, k, t) for p, (k, t) in tree.items())


@pytest.mark.parametrize("seed", range(3))
def test_merge_like_a_replay(spark, seed):
    rng = random.Random(seed)
    names = ["/a", "/a/b", "/a/b/c", "/a/d", "/e", "/a-b"]
    events = [(rng.choice("IIIIXO"), rng.choice(names), rng.choice(["Dir", "Dir", "Regular"]), t) for t in range(60)]
    df = spark.createDataFrame([(t // 20, t, e, p, k if e == "I" else None) for e, p, k, t in events], "layer int, seq long, event string, path string, kind string")
    assert rows(merge.merge(df).select("path", "kind", "seq")) == replayed(events)


def test_merge_needs_the_live_directory(spark):
    e = [("I", "/a", "Dir", 0), ("X", "/a", None, 1), ("I", "/a/b", "Regular", 2), ("I", "/a", "Regular", 3)]
    df = spark.createDataFrame([(0, t, x, p, k) for x, p, k, t in e], "layer int, seq long, event string, path string, kind string")
    assert rows(merge.merge(df).select("path", "kind")) == [("/a", "Regular"), ("/a/b", "Regular")]


def tar_of(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, body in members:
            m = tarfile.TarInfo(name)
            if body is None:
                m.type = tarfile.DIRTYPE
            else:
                m.size = len(body)
            t.addfile(m, io.BytesIO(body or b""))
    return out.getvalue()


def test_layered_archives_and_round_trip(spark, tmp_path):
    base = tar_of([("etc", None), ("etc/conf", b"v1"), ("etc/keep", b"k"), ("etc/sub/x", b"x1")])
    top = tar_of([("etc/conf", b"v2"), ("etc/.wh.keep", b""), ("etc/new", b"n"), ("etc/new", b"n2")])
    (tmp_path / "base.tar").write_bytes(base)
    (tmp_path / "top.tar").write_bytes(top)
    out = f"{tmp_path}/out"
    api.repack(spark, [f"{tmp_path}/base.tar", f"{tmp_path}/top.tar"], out, shards=1)
    with tarfile.open(f"{out}/{os.listdir(out)[0]}") as t:
        got = {m.name: (t.extractfile(m).read() if m.isreg() else None) for m in t}
    assert got == {"etc": None, "etc/conf": b"v2", "etc/new": b"n2", "etc/sub": None, "etc/sub/x": b"x1"}
    for kind in ("zip", "cpio"):
        e = archives.bodies(spark, archives.scan(spark, out), out).select("path", "kind", "mode", "uid", "gid", "mtime", "link_target", "data")
        sinks.write(e, f"{tmp_path}/{kind}", kind)
        back = archives.scan(spark, f"{tmp_path}/{kind}", kind)
        assert rows(archives.bodies(spark, back, f"{tmp_path}/{kind}").select("path", "data")) == [("/etc/conf", b"v2"), ("/etc/new", b"n2"), ("/etc/sub/x", b"x1")]
    flat = spark.createDataFrame([("/a.o", b"123"), ("/a very long member name", b"45")], "path string, data binary").withColumn("kind", F.lit("Regular"))
    sinks.write(flat, f"{tmp_path}/ar", "ar", shards=1)
    back = archives.scan(spark, f"{tmp_path}/ar", "ar")
    assert rows(archives.bodies(spark, back, f"{tmp_path}/ar").select("path", "data")) == [("/a very long member name", b"45"), ("/a.o", b"123")]
    found = {r.path.rsplit("/", 1)[1].rsplit(".", 1)[1]: r.format for k in ("zip", "cpio", "ar", "out") for r in detect.detected(spark, f"{tmp_path}/{k}").collect()}
    assert found == {"zip": "zip", "cpio": "cpio", "ar": "ar", "tar": "tar"}
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("x/y", b"hi")
    assert rows(archives.bodies(spark, archives.scan(spark, f"{tmp_path}/z", "zip"), f"{tmp_path}/z").select("path", "data")) == [("/x/y", b"hi")]


def test_partition_tables(spark):
    mbr = bytearray(512)
    mbr[446:462] = struct.pack("<B3sB3sII", 128, b"", 0x83, b"", 2048, 4096)
    mbr[510:] = b"\x55\xaa"
    entry = bytes.fromhex("28732AC11FF8D211BA4B00A0C93EC93B") + bytes(range(16)) + struct.pack("<QQQ", 2048, 4095, 0) + "EFI".encode("utf-16-le").ljust(72, b"\0")
    table = entry.ljust(128 * 4, b"\0")
    head = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, 1, 99, 34, 90, bytes(16), 2, 4, 128, zlib.crc32(table)))
    head[16:20] = struct.pack("<I", zlib.crc32(bytes(head)))
    disk = bytes(512) + bytes(head).ljust(512, b"\0") + table
    d = spark.createDataFrame([(1, bytes(mbr)), (2, disk)], "id int, content binary")
    assert rows(partitions.mbr(d)) == [(1, 0, "LinuxFilesystem", 2048, 4096, True)]
    assert rows(partitions.gpt(d).select("id", "number", "kind", "start_lba", "size_lba", "name")) == [(2, 0, "EfiSystem", 2048, 2048, "EFI")]
    assert rows(d.select("id", partitions.table_kind(F.col("content")))) == [(1, "mbr"), (2, "gpt")]


def test_links_and_changes(spark):
    e = spark.createDataFrame([("/a", 1, 2), ("/a-b", 1, 2), ("/a/b", 1, 2), ("/z", 5, 1)], "path string, inode long, nlink long").withColumns({"kind": F.lit("Regular"), "size": F.lit(3).cast("long")})
    assert rows(links.link_groups(e).select("path", F.coalesce("link_to", F.lit("")))) == [("/a", ""), ("/a-b", "/a"), ("/a/b", "/a"), ("/z", "")]
    with pytest.raises(Exception, match="not empty"):
        mutate.remove(e, "/a").collect()
    assert rows(mutate.remove(e, "/z").select("path")) == [("/a",), ("/a-b",), ("/a/b",)]
    assert rows(mutate.rename(e, "/a", "/q").select("path")) == [("/a-b",), ("/q",), ("/q/b",), ("/z",)]
    assert rows(mutate.clone(e, "/z", "/y").where("path = '/y'").select("inode")) == [(6,)]
    assert mutate.devices(spark).count() == 71 and mutate.devices(spark, "minimal").count() == 8
    with pytest.raises(Exception, match="taken|exists"):
        mutate.create(e, e.limit(1)).collect()
    with pytest.raises(Exception, match="cycle|large"):
        listing.checked(spark.createDataFrame([("s", "/d", "Dir", 4), ("s", "/d/e", "Dir", 4)], "source string, path string, kind string, inode long")).collect()


def test_chains(spark):
    t = spark.createDataFrame([(1, 2), (2, 7), (7, None), (9, None)], "cluster long, next long")
    assert rows(lookups.chains(t, spark.createDataFrame([(1,), (9,)], "cluster long"))) == [(1, 0, 1), (1, 1, 2), (1, 2, 7), (9, 0, 9)]
    with pytest.raises(ValueError):
        lookups.chains(spark.createDataFrame([(1, 2), (2, 1)], "cluster long, next long"), spark.createDataFrame([(1,)], "cluster long")).collect()


def test_tar_headers(spark, tmp_path):
    """Damaged, hostile and unusual members."""
    plain = tar_of([("a", b"1"), ("../../etc/passwd", b"2"), ("x/../b", b"3")])
    assert [e["path"] for e in archives.tar_entries(plain)] == ["/a", "/etc/passwd", "/b"]
    broken = bytearray(plain)
    broken[1024] ^= 1
    with pytest.raises(Exception, match="checksum"):
        list(archives.tar_entries(bytes(broken)))
    (tmp_path / "broken.tar").write_bytes(bytes(broken))
    with pytest.raises(Exception, match="checksum"):
        archives.scan(spark, f"{tmp_path}/broken.tar").collect()
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT, pax_headers={"comment": "global", "path": "ignored"}) as t:
        for name, kind, size in (("v", b"V", 600), ("f", tarfile.CONTTYPE, 600), ("deep/" * 60 + "f", tarfile.REGTYPE, 3)):
            m = tarfile.TarInfo(name)
            m.type, m.size, m.mtime = kind, size, 2**34
            t.addfile(m, io.BytesIO(b"z" * size))
    got = list(archives.tar_entries(out.getvalue()))
    assert [(e["path"], e["size"], e["mtime"]) for e in got] == [("/f", 600, 2**34 % 2**32), ("/" + "deep/" * 60 + "f", 3, 2**34 % 2**32)]
    gnu = io.BytesIO()
    with tarfile.open(fileobj=gnu, mode="w", format=tarfile.GNU_FORMAT) as t:
        m = tarfile.TarInfo("n" * 150)
        m.type, m.linkname, m.uid = tarfile.SYMTYPE, "t" * 150, 2**40
        t.addfile(m)
    (e,) = archives.tar_entries(gnu.getvalue())
    assert (e["path"], e["link_target"], e["uid"]) == ("/" + "n" * 150, "t" * 150, 2**40)
    assert archives.tar_number(b"\x80\0\0\0\x01\0\0\0\0") == 2**32 and archives.tar_number(b"0000644 ") == 0o644
    with pytest.raises(Exception, match="octal"):
        archives.tar_number(b"00x9\0")
    assert list(archives.tar_entries(b"")) == [] == list(archives.tar_entries(bytes(5000)))


def test_tar_written_for_others(spark, tmp_path):
    """What the sink writes, as another reader sees it."""
    long = "d" * 90 + "/" + "e" * 90 + "/f"
    rows_ = [("/a", "Dir", None, None, None, 3), ("/a/f", "Regular", b"body", None, [("user.k", b"\x00v=\n")], 2**40), ("/a/l", "Symlink", None, "t" * 120, None, 0), ("/a/h", "HardLink", None, "a/f", None, 0), ("/" + long, "Regular", b"x" * 513, None, None, 0), ("/" + "q" * 130, "Regular", b"", None, None, 0), ("/dev", "Char", None, None, None, 0)]
    df = spark.createDataFrame(rows_, "path string, kind string, data binary, link_target string, xattrs array<struct<name:string,value:binary>>, mtime long").withColumns({"dev_major": F.lit(5).cast("long"), "dev_minor": F.lit(1).cast("long")})
    sinks.write(df, f"{tmp_path}/o", shards=1)
    with tarfile.open(f"{tmp_path}/o/{os.listdir(f'{tmp_path}/o')[0]}") as t:
        got = {m.name: m for m in t}
        assert t.extractfile(long).read() == b"x" * 513 and t.extractfile("a/f").read() == b"body" and t.extractfile("a/h").read() == b"body"
    assert set(got) == {r[0].lstrip("/") for r in rows_} and got["a"].isdir() and got["a/l"].linkname == "t" * 120 and got["a/f"].mtime == 2**40 and (got["dev"].devmajor, got["dev"].devminor) == (5, 1)
    back = {r.path: r for r in archives.scan(spark, f"{tmp_path}/o").collect()}
    assert [(x.name, bytes(x.value)) for x in back["/a/f"].xattrs] == [("user.k", b"\x00v=\n")] and len(back) == len(rows_)
    with pytest.raises(Exception, match="holds no Socket"):
        sinks.write(df.limit(1).withColumn("kind", F.lit("Socket")), f"{tmp_path}/s")


def test_repack_drops_dead_links(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, target in (("f", None), ("g", None), ("z", "f"), ("y", "g")):
            m = tarfile.TarInfo(name)
            if target:
                m.type, m.linkname = tarfile.LNKTYPE, target
            t.addfile(m)
    (tmp_path / "one.tar").write_bytes(out.getvalue())
    (tmp_path / "two.tar").write_bytes(tar_of([(".wh.f", b"")]))
    api.repack(spark, [f"{tmp_path}/one.tar", f"{tmp_path}/two.tar"], f"{tmp_path}/out", shards=1)
    assert rows(archives.scan(spark, f"{tmp_path}/out").select("path", "kind")) == [("/g", "Regular"), ("/y", "HardLink")]


def test_numbers_in_headers(spark):
    d = spark.createDataFrame([(b"0000644 ",), (b"\x80\x00\x00\x00\x00\x00\x01\x00",)], "b binary")
    assert rows(d.select(bits.parse_number(F.col("b")))) == [(256,), (420,)]
    with pytest.raises(Exception, match="octal"):
        d.select(bits.parse_octal(F.lit("9"))).collect()


def test_as_of_over_buckets(spark):
    v = spark.createDataFrame([(1, x, f"v{x}") for x in (5, 17, 18, 40)] + [(2, 3, "w")], "oid long, xid long, val string")
    p = spark.createDataFrame([(o, a) for o in (1, 2, 3) for a in (2, 5, 17, 39, 40, 99)], "oid long, at long")
    want = [(o, a, *max(((x, y) for i, x, y in v.collect() if i == o and x <= a), default=(None, None))) for o, a in p.collect()]
    assert sorted(map(repr, map(tuple, links.as_of(v, p, bucket=10).collect()))) == sorted(map(repr, want))


def test_replay_and_arrival(spark, tmp_path):
    j = [(1, 0, 10, "a", False), (1, 1, None, None, True), (2, 0, 10, "b", False), (2, 1, 11, "c", False), (2, 2, None, None, True), (3, 0, 10, "torn", False), (4, 0, 12, "late", False), (4, 1, None, None, True)]
    df = spark.createDataFrame(j, "tid long, seq long, block long, payload string, commit boolean")
    assert rows(layers.replay(df, 1)) == [(10, "b"), (11, "c")]
    folder, log = f"{tmp_path}/in", f"{tmp_path}/log"
    for n, e in enumerate([[(0, "I", "/d", "Dir", 0), (1, "I", "/d/a", "Regular", 1)], [(0, "X", "/d/a", None, None), (1, "I", "/d/b/c", "Regular", 2)]]):
        spark.createDataFrame(e, layers.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        layers.arriving(spark, folder, log, f"{tmp_path}/cp").awaitTermination()
    assert rows(layers.merged(spark, log).select("path", "kind")) == [("/d", "Dir"), ("/d/b", "Dir"), ("/d/b/c", "Regular")]


def test_encodings(spark):
    raw = spark.createDataFrame([("é".encode("mac_roman"), "한글".encode("cp949"), "日本".encode("shift_jis"), "naïve".encode(), "ab".encode("utf-16-be"))], "m binary, k binary, j binary, u binary, w binary")
    r = raw.select(encodings.mac_roman("m"), encodings.korean("k"), encodings.archive_name("j"), encodings.archive_name("u"), encodings.ucs2_big(F.col("w")), encodings.to_korean(encodings.korean("k"))).first()
    assert tuple(r) == ("é", "한글", "日本", "naïve", "ab", "한글".encode("cp949"))
    data = spark.createDataFrame([("STR ", b"\x02hi!"), ("TEXT", b"some"), ("TEXT", b"a\nb" + b"c" * 60), ("vers", b"\x07\x51\x80\x00\x00\x00\x037.5\x0a7.5, \xa9 Me!"), ("vers", b"\x07\x51\x80\x00\x00\x00\x037.5"), ("vers", b"\x07\x51"), ("STR#", b"\x00\x06\x01a\x02bc\x00\x01d\x01e\x01f"), ("STR#", b"\x00\x01\x01a"), ("STR#", b"\x00\x02\x01a\x09x"), ("ICN#", b""), ("DITL", b"\x00\x04"), ("DITL", b"\xff\xff"), ("snd ", b"12345")], "kind string, data binary")
    got = [x[0] for x in data.select(lookups.resource_summary(F.col("kind"), F.col("data"))).collect()]
    assert got == ['"hi"', '"some" (4 bytes)', '"a b' + "c" * 45 + '…" (63 bytes)', '"7.5, © Me!"', '"7.5"', None, '6 strings: "a", "bc", "", "d", …', '1 strings: "a"', '2 strings: "a", …', "32×32 1-bit icon (+ mask)", "5 items", "0 items", None]
    attributes = F.array(F.struct(F.lit("user.a").alias("name"), F.lit(b"1").alias("value")))
    x = spark.range(1).select(mutate.set_attribute(attributes, "user.a", b"2").alias("s"), mutate.set_attribute(attributes, "user.b", b"3").alias("t"), mutate.remove_attribute(attributes, "user.a").alias("u")).first()
    assert [bytes(i.value) for i in x.s] == [b"2"] and [i.name for i in x.t] == ["user.a", "user.b"] and x.u == []


def test_zip_records(spark, tmp_path):
    """Zip archives both ways against Python's own library; large places, stamps, comments and damage."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"PK\5\6 in a comment"
        z.writestr(zipfile.ZipInfo("d/", (1999, 12, 31, 23, 59, 58)), b"")
        link = zipfile.ZipInfo("d/l")
        link.create_system, link.external_attr = 3, 0o120777 << 16
        z.writestr(link, b"../t")
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"w" * 1000)
        stamped = zipfile.ZipInfo("stamped")
        stamped.extra = struct.pack("<HHBI", 0x5455, 5, 1, 77)
        z.writestr(stamped, b"s")
        z.writestr("ü", b"u", zipfile.ZIP_STORED)
    data = out.getvalue()
    got = {e["path"]: e for e in archives.zip_entries(data)}
    assert {p: (e["kind"], e["size"], e["link_target"]) for p, e in got.items()} == {"/d": ("Dir", 0, None), "/d/l": ("Symlink", 0, "../t"), "/wide": ("Regular", 1000, None), "/stamped": ("Regular", 1, None), "/ü": ("Regular", 1, None)}
    assert got["/stamped"]["mtime"] == 77 and got["/d"]["mtime"] == 946684798 and got["/d/l"]["mode"] == 0o777
    b = got["/wide"]["body"]
    assert archives.inflated(data[b["offset"] : b["offset"] + b["clen"]], b["method"], 1000) == b"w" * 1000
    for most, end in ((999, None), (1000, -1)):
        with pytest.raises(Exception, match="more than"):
            archives.inflated(data[b["offset"] : b["offset"] + b["clen"]][:end], b["method"], most)
    # Sizes and place in the 64-bit field.
    wide = bytearray(data)
    at = wide.index(b"PK\1\2", wide.index(b"PK\1\2", wide.index(b"PK\1\2") + 1) + 1)
    assert wide[at + 46 : at + 50] == b"wide"
    real = [struct.unpack_from("<I", wide, at + k)[0] for k in (24, 20, 42)]
    for k in (24, 20, 42):
        struct.pack_into("<I", wide, at + k, 0xFFFFFFFF)
    struct.pack_into("<H", wide, at + 30, 28)
    wide[at + 50 : at + 50] = struct.pack("<HHQQQ", 1, 24, *real)
    end = wide.rindex(b"PK\5\6", 0, len(wide) - 22)
    struct.pack_into("<I", wide, end + 12, struct.unpack_from("<I", wide, end + 12)[0] + 28)
    assert list(archives.zip_entries(bytes(wide))) == list(archives.zip_entries(data))
    for bad in (data[:-1], data[:40], b"", data.replace(b"PK\3\4", b"PK\3\5")):
        with pytest.raises(Exception, match="end record|local header"):
            list(archives.zip_entries(bad))
    rows_in = [("/", "Dir", None, None), ("/d", "Dir", None, None), ("/d/e", "Regular", None, b""), ("/d/l", "Symlink", "../t", None), ("/ü", "Regular", None, b"x" * 5000)]
    e = spark.createDataFrame([(*r, 0o4711, 946684799) for r in rows_in], "path string, kind string, link_target string, data binary, mode long, mtime long")
    sinks.write(e, f"{tmp_path}/z", "zip", 1)
    with zipfile.ZipFile(f"{tmp_path}/z/{os.listdir(tmp_path / 'z')[0]}") as z:
        assert z.testzip() is None
        assert [(m.filename, z.read(m), m.external_attr >> 16, m.date_time) for m in z.infolist()] == [
            ("d/", b"", 0o44711, (1999, 12, 31, 23, 59, 58)), ("d/e", b"", 0o104711, (1999, 12, 31, 23, 59, 58)), ("d/l", b"../t", 0o124711, (1999, 12, 31, 23, 59, 58)), ("ü", b"x" * 5000, 0o104711, (1999, 12, 31, 23, 59, 58)),
        ]
    assert rows(archives.scan(spark, f"{tmp_path}/z", "zip").select("path", "link_target")) == [("/d", None), ("/d/e", None), ("/d/l", "../t"), ("/ü", None)]
    many = io.BytesIO()
    row = type("Row", (), {"kind": "Regular", "data": b"", "mode": 0o644, "mtime": 0})
    names = []
    for k in range(70_000):
        r = row()
        r.path = f"/{k}"
        names.append(r)
    assert sinks._zip(iter(names), many) == 70_000
    with zipfile.ZipFile(many) as z:
        assert len(z.infolist()) == 70_000
    assert sum(1 for _ in archives.zip_entries(many.getvalue())) == 70_000
    device = spark.createDataFrame([("/n", "Char")], "path string, kind string")
    with pytest.raises(Exception, match="holds no Char"):
        sinks.write(device, f"{tmp_path}/dev", "zip", 1)


def test_folder_trees_and_layers(spark, tmp_path):
    """A folder with links, a device-like node and odd names; folders as layers among archives."""
    from treeframe.sources import files

    base = tmp_path / "base"
    (base / "d/sub").mkdir(parents=True)
    (base / "d/f").write_bytes(b"body")
    os.chmod(base / "d/f", 0o640)
    os.utime(base / "d/f", (77, 77))
    os.link(base / "d/f", base / "d/sub/again")
    (base / "empty").write_bytes(b"")
    os.link(base / "empty", base / "empty2")
    os.symlink("../no/where", base / "d/l")
    os.mkfifo(base / "pipe")
    found = files.tree(spark, str(base))
    assert rows(found.select("path", "kind", "size", "link_target")) == sorted([("/d", "Dir", 0, None), ("/d/f", "Regular", 4, None), ("/d/l", "Symlink", 0, "../no/where"), ("/d/sub", "Dir", 0, None), ("/d/sub/again", "Regular", 4, None), ("/empty", "Regular", 0, None), ("/empty2", "Regular", 0, None), ("/pipe", "Fifo", 0, None)], key=repr)
    assert rows(found.where("path = '/d/f'").select("mode", "mtime", "nlink", "body.tag")) == [(0o640, 77, 2, "host")]
    # Empty files are never links; the further names of others are.
    assert rows(files.layer(found).where("kind = 'HardLink'").select("path", "link_target")) == [("/d/sub/again", "/d/f")]
    assert rows(files.bodies(found).select("path", "data")) == [("/d/f", b"body"), ("/d/sub/again", b"body"), ("/empty", b""), ("/empty2", b"")]
    (tmp_path / "none").mkdir()
    assert rows(files.tree(spark, str(tmp_path / "none"))) == []
    with pytest.raises(Exception, match="deeper"):
        files.tree(spark, str(base), deepest=2)
    top = tmp_path / "top"
    (top / "x/.wh.gone").mkdir(parents=True)
    (top / "x/.wh.gone/inner").write_bytes(b"no")
    (top / "x/.wh..wh..opq").write_bytes(b"")
    (top / "x/new").write_bytes(b"n")
    (top / "d").mkdir()
    (top / "d/.wh.l").write_bytes(b"")
    (tmp_path / "mid.tar").write_bytes(tar_of([("x/old", b"o"), ("x/gone/a", b"g"), ("d/f", b"second")]))
    api.repack(spark, [str(base), f"{tmp_path}/mid.tar", str(top)], f"{tmp_path}/out", source_kind=["dir", "tar", "dir"], shards=1)
    with tarfile.open(f"{tmp_path}/out/{os.listdir(tmp_path / 'out')[0]}") as t:
        got = {m.name: (m.linkname or None) if not m.isreg() else t.extractfile(m).read() for m in t}
    assert got == {"d": None, "d/sub": None, "x": None, "d/f": b"second", "empty": b"", "empty2": b"", "x/new": b"n", "d/sub/again": "d/f"}
    with pytest.raises(Exception, match="kind for each"):
        api.repack(spark, [str(base)], f"{tmp_path}/out2", source_kind=["dir", "tar"])
    os.mkdir(os.fsencode(tmp_path / "odd") )
    os.close(os.open(os.fsencode(tmp_path / "odd") + b"/\xff", os.O_CREAT))
    with pytest.raises(Exception, match="not UTF-8"):
        files.tree(spark, str(tmp_path / "odd")).collect()


def test_guards_and_changes(spark, tmp_path):
    from treeframe.operators import listing

    for kind, codec, what in (("tar", None, "from its start"), ("iso9660", None, "not changed"), ("unheard-of", None, "not changed"), ("ext", "gzip", "gzip")):
        with pytest.raises(Exception, match=what):
            listing.require_mutable(kind, "add", codec)
    e = spark.createDataFrame([("/a", "Dir", 0, 1), ("/a/f", "Regular", 3, 2)], "path string, kind string, size long, inode long").withColumn("nlink", F.lit(1).cast("long"))
    one = api.mkdir(spark, e, "/a/n", "ext")
    assert rows(one.select("path", "kind")) == [("/a", "Dir"), ("/a/f", "Regular"), ("/a/n", "Dir")]
    for bad in (lambda: api.mkdir(spark, e, "/b/n", "ext"), lambda: api.mkdir(spark, e, "/a", "ext"), lambda: api.mkdir(spark, e, "/a/f/n", "ext"), lambda: mutate.clone(e, "/a/f", "/a"), lambda: mutate.clone(e, "/a", "/z"), lambda: api.rm(e, "/a", "ext"), lambda: api.rm(e, "/a/f", "tar"), lambda: mutate.clone_range("xfs")):
        with pytest.raises(Exception, match="no such folder|exists|not a file|not empty|from its start|does not share"):
            bad().collect()
    assert rows(api.rm(e, "/a/f", "ext").select("path")) == [("/a",)]
    (tmp_path / "t/s").mkdir(parents=True)
    (tmp_path / "t/s/f").write_bytes(b"12")
    assert rows(api.add_tree(spark, e, str(tmp_path / "t"), "/a/t", "ext").select("path", "size")) == [("/a", 0), ("/a/f", 3), ("/a/t", 0), ("/a/t/s", 0), ("/a/t/s/f", 2)]
    lists = "path string, xattrs array<struct<name:string,value:binary>>"
    x = spark.createDataFrame([("/a", [("u", b"1"), ("v", b"2")]), ("/b", [("w", b"3")]), ("/c", None)], lists)
    new = spark.createDataFrame([("/a", [("z", b"9")]), ("/b", [])], lists)
    assert [(r.path, r.xattrs and [y.name for y in r.xattrs]) for r in mutate.replace_attributes(x, new).orderBy("path").collect()] == [("/a", ["z"]), ("/b", []), ("/c", None)]
    ask = spark.createDataFrame([(0,), (1,), (2,)], "page long")
    first = spark.createDataFrame([(0, 512)], "index long, value long")
    second = spark.createDataFrame([(512, 0, 4096), (512, 1, 0)], "table long, index long, value long")
    mapped = lookups.page_map(ask, first, second, 64)
    store = spark.createDataFrame([(4096, b"abcd")], "offset long, data binary")
    assert rows(lookups.page_bytes(mapped, store, 4).select("page", "data")) == [(0, b"abcd"), (1, bytes(4)), (2, bytes(4))]
    for table, what in ((second.withColumn("value", F.lit(1 << 62 | 5)), "compressed"), (second.withColumn("value", F.lit(8).cast("long")), "no bytes")):
        with pytest.raises(Exception, match=what):
            lookups.page_bytes(lookups.page_map(ask, first, table, 64), store, 4).collect()
    how = listing.mutability(spark.createDataFrame([("xfs",), ("ext",)], "kind string"))
    assert rows(how.select("kind", "clone", "shares_extents", "supports_range")) == [("ext", "None", False, False), ("xfs", "WholeFile", True, False)]


def test_sizes_and_integers(spark):
    sizes = {"10": 10, "4 KiB": 4096, "2MB": 2000000, "7k": 7168, "1TiB": 1 << 40, "9x": None, "": None, "99999999999GiB": None}
    d = spark.createDataFrame([(x,) for x in sizes], "t string")
    assert {r[0]: r[1] for r in d.select("t", display.parse_size(F.col("t"))).collect()} == sizes
    numbers = {"12": 12, "0xff": 255, "0b101": 5, "z": None, "": None}
    d = spark.createDataFrame([(x,) for x in numbers], "t string")
    assert {r[0]: r[1] for r in d.select("t", display.parse_integer(F.col("t"))).collect()} == numbers
