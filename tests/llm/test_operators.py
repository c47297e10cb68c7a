"""Each training-data operator against a brute-force version, an exact round trip or held-out rows, and on odd tables."""

import collections
import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from treeframe.llm import decontam, licenses, near_join, norm_topk, packing, pii, quality, suffix_dedup, tokens, toxicity
from treeframe.llm.common import components, word_slices

SCHEMA = "doc_id long, text string, lang string, score string, predicted string, d long, k long, n long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def prose(rng, n):
    return " ".join(rng.choice("the of and thon ering nd ouble tion ha é ünd ea st reth an").capitalize() if rng.random() < 0.1 else "".join(rng.choice(["th", "er", "on", "an", "ou", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, repeats, and columns whose names clash with the operators' own."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    texts = [base, base, base.replace("th", "ht", 1), None, "", " \n\t", "one two", "one two", long, long + " tail", "x" * 3000, "a b " * 400, "é" * 500, prose(rng, 60)]
    out = [(i, t) for i, t in enumerate(texts)] + [(0, base), (None, "null id"), (None, None), (-7, base)]
    return [(i, t, None, "s", None, 1, 2, 3) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_like_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ0 .é-_ñ\n") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    seen = {}
    for a, b, w in word_slices(pa.array(texts)):
        h = w.hashes()
        for r in range(a, b):
            mine = h[w.bounds[r - a] : w.bounds[r - a + 1]]
            assert len(mine) == len(words_of(texts[r]))
            for x, y in zip(words_of(texts[r]), mine, strict=True):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_op1_round_trip(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "A\x1cb Don't <|endoftext|> ½ x²,.! İS ΑΣ. é́ \xa0"), (51, "Äpfel, ÜBER! naïve")], "doc_id long, text string"))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokens.round_trip(odd).collect()), key=lambda r: r[2])
    at, want = 0, []
    rows = sorted(odd.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id is not None, r.doc_id or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.round_trip(nothing).count() == 0
    path = f"file://{tmp_path}/t"
    tokens.write_tokens(odd, path)
    assert {r.doc_id for r in tokens.read_tokens(spark, path, 2, 5).collect()} == {2, 3, 4, 5}
    assert tokens.read_metadata(spark, path).agg(F.sum("n_tokens")).first()[0] == at


def test_op1_table_forgets():
    e = tokens.Encoder(tokens.default_tokenizer(), most=50)
    rng = random.Random(3)
    texts = [prose(rng, 40) for _ in range(30)]
    for t in texts * 2:
        ids, at = e.encode([t, ""])
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids and at.tolist() == [0, len(ids), len(ids)]


def same_as_library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    e = tokens.Encoder(path)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for parts in ([e.encode(texts)], [p[2:] for p in tokens.encoded(pa.array(texts), e)]):
        assert [ids[a:b].tolist() for ids, at in parts for a, b in itertools.pairwise(at)] == want


def test_op1_every_letter_with_stops():
    letters = [chr(c) for c in range(0x250) if c != 0x1C]
    texts = [x for c in letters for stop in ("", ".", "!?", ";:,", "'s") for x in (f"1 {c}{stop} cups", f"a{c}b{stop}", f"{c}{c.upper()}{stop}x")]
    for a in range(0, len(texts), 1000):  # a new table each time
        same_as_library(tokens.default_tokenizer(), texts[a : a + 1000])
    same_as_library(tokens.default_tokenizer(), [" ".join(texts)])


def test_op1_random_texts():
    rng = random.Random(12)
    some = [*map(chr, range(0x20, 0x250)), *(chr(rng.randrange(0x250, 0xD800)) for _ in range(600)), *(chr(rng.randrange(0xE000, 0x20000)) for _ in range(200)), *"\u0301\u0345\u00a0\u2028\u0085\t\n", "<|endoftext|>", "e\u0301", " ", "'ll ", "...", "The", "ENDS"]
    same_as_library(tokens.default_tokenizer(), ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(4000)])


def test_op1_other_tokenizer():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokens.Encoder(path).by_words
    same_as_library(path, ["A  tab\tand ½ cups. ", "", "ÜBER\n"])


def test_op1_files(spark, tmp_path):
    """Encodings, row groups and page indexes of the files, and pages left out when a range is read."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(13)
    docs = spark.createDataFrame([(i, prose(rng, 300)) for i in range(3000)], "doc_id long, text string").coalesce(1)
    tokens.write_tokens(docs, f"file://{tmp_path}/t")
    ids_bytes = 0
    for f in sorted(glob.glob(f"{tmp_path}/t/*.parquet")):
        footer = pq.read_metadata(f)
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            assert group.total_byte_size <= 2 * tokens.ROW_GROUP_BYTES
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_offset_index and (column.has_column_index or column.path_in_schema.startswith("ids"))
                assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
                ids_bytes += column.total_compressed_size * column.path_in_schema.startswith("ids")
    assert ids_bytes > 4 * tokens.PAGE_BYTES  # several pages, so that some can be left out

    # Vectored reads are not counted by Hadoop.
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = bytes_read()
    assert tokens.read_tokens(spark, f"file://{tmp_path}/t").agg(F.sum(F.size("ids"))).first()[0] > 0
    whole, before = bytes_read() - before, bytes_read()
    assert [r.doc_id for r in tokens.read_tokens(spark, f"file://{tmp_path}/t", 1500, 1501).collect()] == [1500, 1501]
    read = bytes_read() - before
    assert read < whole / 2
    before = bytes_read()
    assert tokens.read_metadata(spark, f"file://{tmp_path}/t").count() == 3000
    assert bytes_read() - before < whole / 2


def test_op2_like_all_products(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 3])).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(460, None), (461, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (462, [float("nan")] * 6), (463, [float("inf")] * 6), (None, [1.0] * 6), (480, [0.0] * 6), (500, [1.0, 2.0]), (501, [1.0, 1.0]), (520, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for options in ({}, {"bucket_rows": 16, "seed_rows": 30, "block_rows": 7}, {"every": 2, "bucket_rows": 16, "block_rows": 5}):
        want = set()
        for q, v in good:
            if q % options.get("every", 20) == 0:
                best = sorted(((-int(v @ w), c) for c, w in good if c != q and len(w) == len(v)))[:20]
                want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
        assert {tuple(r) for r in norm_topk.top_k(df, **options).collect()} == want
        monkeypatch.setattr(norm_topk, "SHARE_BUCKETS", 3)
        monkeypatch.setattr(norm_topk, "GROUP_BLOCKS", 2)
    assert norm_topk.top_k(df.limit(0)).count() == 0


def test_op2_prunes_by_coordinates():
    rng = np.random.default_rng(6)
    v = np.floor(rng.normal(size=(300, 8)) * 50).astype(np.int64)
    q = v[:40]
    best = norm_topk.Best(40, 3, np.array([float(x @ x) * 0.9 for x in q]))
    how = norm_topk.search_bucket(best, np.arange(40), np.arange(1000, 1040), q, np.arange(300), v)
    assert how["coordinate"] > 0
    for k in range(40):
        s = v @ q[k]
        assert best.ids[k].tolist() == [i for i in np.lexsort((np.arange(300), -s)) if s[i] >= 0.9 * (q[k] @ q[k])][:3]


def test_op3_like_plain_python(spark, docs, nothing):
    notices = [t for ts in licenses.NOTICES.values() for t in ts if len(licenses.words(t)) <= licenses.PIECE]
    more = spark.createDataFrame([(900 + i, f"{prose(random.Random(i), 20)}\n{t}\nend") for i, t in enumerate(notices)] + [(990, "GNU\nall of the rights\nthe Apache tribe")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    model = licenses.train(docs)
    got = {(r.doc_id, r.n_lines): r for r in licenses.scan(every, model).collect()}
    for r in every.collect():
        lines = (r.text or "").split("\n")
        p = [x for x in (licenses.predict(model, line) for line in lines) if x]
        sure = [x[0] for x in p if x[2]]
        g = got[r.doc_id, len(lines)]
        assert (g.n_predicted, g.n_confirmed, g.families, g.license) == (len(p), len(sure), ",".join(sorted(set(sure))), sure[0] if sure else "unknown")
    family = {t: f for f, ts in licenses.NOTICES.items() for t in ts}
    assert sum(got[900 + i, 3].license == family[t] for i, t in enumerate(notices)) >= len(notices) - 1
    assert got[990, 3].license == "unknown"
    plan = licenses.scan(every, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan(nothing, model).count() == 0


def test_op3_wrapped_notices(spark, docs):
    import textwrap

    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    rng = random.Random(8)
    texts = [gpl, f"{prose(rng, 30)}\n\n{gpl}\n\n{prose(rng, 30)}", "\n".join(textwrap.wrap(prose(rng, 400) + " " + gpl + " " + prose(rng, 400), 70)), gpl + "\n\nAll rights reserved.", gpl.replace("\n", "\n \n")]
    model = licenses.train(docs)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i].license for i in range(5)] == ["gpl"] * 4 + ["unknown"]
    assert [got[i].families for i in range(5)] == ["gpl"] * 3 + ["all-rights-reserved,gpl", ""]
    assert [got[i].n_confirmed for i in range(5)] == [1, 1, 1, 2, 0]


def test_op3_notices_that_are_no_templates(spark, docs):
    """Whole texts wrapped at a column, other wordings, and licences and prose that no family stands for."""
    import textwrap

    model = licenses.train(docs)
    rng = random.Random(21)
    known = [(f, "\n".join(textwrap.wrap(t, width))) for f, ts in licenses.NOTICES.items() for t in ts if len(licenses.words(t)) > licenses.PIECE for width in (50, 72)]
    known += [
        ("mit", "This project is licensed under the MIT License - see the LICENSE file for details."), ("bsd", "You may use it under the BSD 3-Clause License"), ("mit", " * SPDX-License-Identifier: MIT"), ("apache", "// SPDX-License-Identifier: Apache-2.0"),
        ("gpl", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
        ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not\nuse this file except in compliance with the License."), ("cc-by", "Text is licensed under a Creative Commons Attribution 4.0 International License"), ("all-rights-reserved", "Copyright 2019 by the authors. All rights reserved."),
    ]
    other = ["Licensed under the Academic Free License", "WTFPL license applies", "Published under the zlib license", "Licence plates of the public road", "The library is open to the public under certain terms", "the copyright notice hung above the door"] + [prose(rng, 80) for _ in range(30)]
    rows = [(i, f"{prose(rng, 40)}\n\n{t}\n\n{prose(rng, 40)}") for i, (_, t) in enumerate(known)] + [(1000 + i, t) for i, t in enumerate(other)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    found = sum(got[i] == f for i, (f, _) in enumerate(known))
    assert found >= 0.95 * len(known), [(f, got[i], t) for i, (f, t) in enumerate(known) if got[i] != f]
    assert all(got[1000 + i] == "unknown" for i in range(len(other)))


def near_by_brute_force(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for a, b in itertools.combinations(range(len(rows)), 2):
        s, t = sets[a], sets[b]
        if s and t and None not in (rows[a][0], rows[b][0]) and len(s & t) >= similarity * len(s | t):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((str(r[0]), None if r[0] is None else min(x for x in groups[find(i)] if x is not None), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [256, 3])
def test_op4_like_all_pairs(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(near_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_join, "PAIR_ROWS", 4 * block)
    rng = random.Random(7)
    base = prose(rng, 150).split()
    rows = [(r[0], r[1]) for r in odd_rows()]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(9)
        rows.append((200 + i, " ".join(w)))
    rows += [(5, " ".join(base) + " tail"), (5, prose(rng, 90)), (6, prose(rng, 90) + " x")]  # one id, two texts
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash"))
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in near_join.classes(df).collect()) == near_by_brute_force(rows)
    assert near_join.classes(nothing).count() == 0


def test_op4_recall(spark):
    """Links found of all pairs at 0.8 or more, among families of texts with ever more edits."""
    rng = random.Random(17)
    rows = []
    for f in range(60):
        base = prose(rng, 120).split()
        for k in range(12):
            w = list(base)
            for at in rng.sample(range(len(w)), k // 2):
                w[at] = "edit%d" % rng.randrange(10**6)
            rows.append((100 * f + k, " ".join(w)))
    got = {r.doc_id: r.n_links for r in near_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {int(d): n for d, _, n in near_by_brute_force(rows)}
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0 and all(got[d] <= want[d] for d in want)


def test_op4_one_id_two_texts(spark):
    rng = random.Random(18)
    a, b = prose(rng, 100), prose(rng, 100)
    docs = spark.createDataFrame([(1, a + " tail", "x"), (5, a, "x"), (5, b, "x")], "doc_id long, text string, _drop_text string")
    assert sorted((r.doc_id, r.text == b, r._drop_text) for r in near_join.keep_one(docs).collect()) == [(1, False, "x"), (5, True, "x")]
    with pytest.raises(ValueError):
        near_join.stop_depth(0.05, 0.9999)


def test_op4_keeps_one(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "other words stand here now"), (None, "a b c d e f g h"), (4, None)]
    kept = near_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "None"] and near_join.stop_depth(0.8, 0.9999) == 5


def test_op5_batches(spark, docs, nothing):
    rng = np.random.default_rng(8)
    for _ in range(15):
        sizes = sorted((rng.choice(40, 8, False) + 1).tolist())
        counts = rng.integers(1, 9, 8).tolist()

        def cost(cuts, sizes=sizes, counts=counts):
            return sum(min(c for c in cuts if c >= s) * n for s, n in zip(sizes, counts, strict=True))

        best = min(cost((*c, sizes[-1])) for k in range(3) for c in itertools.combinations(sizes[:-1], k))
        assert cost(packing.boundaries(sizes, counts, 3)) == best
    rows = packing.pack(docs, buckets=3, budget=2048).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(r[0]), len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in odd_rows())
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_tokens
        batches[r.bucket, r.batch].append(r)
    full = {b: max(1, 2048 // v[0].padded_tokens) for (b, _), v in batches.items()}
    for b in full:
        sizes = [len(batches[b, i]) for i in range(sum(x == b for x, _ in batches))]
        assert all(n == full[b] for n in sizes[:-1]) and 0 < sizes[-1] <= full[b]
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in batches.values())
    assert packing.pack(nothing).count() == 0


def removed_by_brute_force(rows):
    order = sorted(range(len(rows)), key=lambda i: -(1 << 63) if rows[i][0] is None else rows[i][0])
    first = {}
    for i in order:
        s, d = (rows[i][1] or "").encode(), -(1 << 63) if rows[i][0] is None else rows[i][0]
        for p in range(len(s) - 99):
            key = (d, p)
            first[s[p : p + 100]] = min(first.get(s[p : p + 100], key), key)
    out = []
    for d, t in rows:
        s, i = (t or "").encode(), -(1 << 63) if d is None else d
        mask = np.zeros(len(s), bool)
        for p in range(len(s) - 99):
            if first[s[p : p + 100]] < (i, p):
                mask[p : p + 100] = True
        kept = np.frombuffer(s, np.uint8)[~mask].tobytes()
        out.append((str(d), len(s), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 19, 1500])
def test_op6_like_every_window(spark, nothing, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", most)
    rng = random.Random(9)
    line = prose(rng, 20)
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(300 + i, prose(rng, rng.randint(5, 40)) + line + prose(rng, 10)) for i in range(40)] + [(400, "ab" * 300), (401, "abc" * 100 + line[:99])]
    rows += [(None, prose(rng, 25) + line[i:]) for i in range(30)] + [(-(1 << 63), line + prose(rng, 30)), (-(1 << 63), line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash"))
    assert sorted((str(r[0]), *r[1:]) for r in suffix_dedup.dedup(df).collect()) == removed_by_brute_force(rows)
    assert suffix_dedup.dedup(nothing).count() == 0


def test_op6_long_texts_in_slices(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "PASS_BYTES", 500)
    rng = random.Random(10)
    t = prose(rng, 600)
    rows = [(1, t), (2, t[:1500] + "X" + t[1500:]), (3, "q" * 2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r[0]), *r[1:]) for r in suffix_dedup.dedup(docs).collect()) == removed_by_brute_force(rows)


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = prose(rng, rng.randint(10, 60)).split()
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        if rng.random() < (0.8 if toxic else 0.2):
            w.insert(rng.randrange(len(w)), rng.choice(["women", "men"]) if not toxic else "women")
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_op7_held_out_and_swaps():
    train, test = labelled(600, 1), labelled(300, 2)
    model = toxicity.fit([t for _, t, _ in train], [y for _, _, y in train])
    s = toxicity.score_texts(pa.array([t for _, t, _ in test]), model) >= 0.3
    assert (s == np.array([y for _, _, y in test])).mean() > 0.97
    plain = toxicity.fit([t for _, t, _ in train], [y for _, _, y in train], swap_weight=0.0)
    neutral = pa.array(["the women went there", "the men went there"])

    def gap(m):
        s = toxicity.score_texts(neutral, m)
        return abs(np.log(s[0] / (1 - s[0])) - np.log(s[1] / (1 - s[1])))

    assert gap(model) < 0.5 * gap(plain)


def test_op7_odd_tables(spark, docs, nothing):
    rows = labelled(200, 3)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.below(docs, model, 2.0).columns == docs.columns and toxicity.below(docs, model, 2.0).count() == docs.count()
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (0, None), (999, 1)], "doc_id long, toxic int")
    assert toxicity.score(nothing, toxicity.train(docs, labels)).count() == 0
    assert toxicity.train(docs, labels.limit(0)).intercept == pytest.approx(0.0)


def plain_hash(raw):
    """The hash of a word, in plain numbers."""
    from treeframe.llm import common

    m = 2**64 - 1
    x = sum(int(common.BYTE_VALUE[b]) * pow(common._MULTIPLIERS[0], i, 2**64) for i, b in enumerate(raw)) & m
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & m
    x = (x ^ x >> 29) * 0xC4CEB9FE1A85EC53 & m
    return x ^ x >> 32


def test_op7_like_a_plain_scorer():
    train = labelled(200, 5)
    model = toxicity.fit([t for _, t, _ in train], [y for _, _, y in train])
    rng = random.Random(6)
    texts = [t for _, t, _ in labelled(40, 7)] + ["", None, "É-idiot IDIOT idiots' x", prose(rng, 3000)]
    got = toxicity.score_texts(pa.array(texts), model)
    for t, s in zip(texts, got, strict=True):
        found = set()
        for w in words_of(t):
            raw = w.encode()
            found.add(plain_hash(raw) >> 46)
            found |= {plain_hash(raw[:n]) * (2 * n + 1) % 2**64 >> 46 for n in toxicity.PREFIXES if len(raw) > n}
        z = model.intercept + sum(float(model.weights[f]) for f in found)
        assert s == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def loss_of(model, texts, labels, swap_weight, l1):
    """What fit minimises, from scores alone."""
    s = np.clip(toxicity.score_texts(pa.array(texts), model), 1e-12, 1 - 1e-12)
    y = np.array(labels)
    pairs = toxicity._swaps(texts, 200)
    a, b = (toxicity.score_texts(pa.array([p[k] for p in pairs]), model) for k in (0, 1))
    gap = np.log(a / (1 - a)) - np.log(b / (1 - b))
    return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean() + swap_weight * (gap**2).mean() + l1 * np.abs(model.weights).sum())


def test_op7_fit_is_a_minimum():
    rows = labelled(150, 9)
    texts, labels = [t for _, t, _ in rows], [y for _, _, y in rows]
    model = toxicity.fit(texts, labels, steps=2000)
    best = loss_of(model, texts, labels, 5.0, 5e-5)
    rng = np.random.default_rng(3)
    on = np.flatnonzero(model.weights)
    for k in rng.choice(on, 12):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += step
            assert loss_of(toxicity.ToxicityModel(w, model.intercept), texts, labels, 5.0, 5e-5) > best - 1e-6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_op7_false_positives_by_group(spark):
    """Held-out rows without the label that name a group are marked no more often than others."""
    from treeframe.llm import queries

    sf = "/root/testdata/sf0.1"
    s = queries.op7_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").select("predicted", "text").collect()
    for group in toxicity.IDENTITY_GROUPS:
        named = [r.predicted for r in s if set(group) & set(words_of(r.text))]
        assert sum(named) <= max(1, 0.02 * len(named))
    assert sum(r.predicted for r in s) <= 0.02 * len(s) and len(s) > 200


def test_op9_like_a_plain_scorer():
    """Grades from frequencies counted in plain Python, and thresholds that no small change makes likelier."""
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(5, 80)) if k else " ".join(["spam"] * rng.randint(3, 30)) for k in (0, 1, 2) for _ in range(40)]
    ratings = [min(k, 1) + (k == 1 and i % 2) for k in (0, 1, 2) for i in range(40)]
    model = quality.fit(texts, ratings, 1)
    expected, tail = quality.score_texts(pa.array(texts), model)
    words = np.zeros((len(texts), quality.WORDS))
    for i, t in enumerate(texts):
        for w in words_of(t):
            words[i, plain_hash(w.encode()) >> 55] += 1 / len(words_of(t))
    x = np.concatenate([f for _, _, f in quality._features(pa.array(texts))])
    assert np.allclose(x[:, : quality.WORDS], np.log2(1 + 1000 * words) / 10, atol=1e-5)
    z = x @ model.weights
    sure = lambda v: 1 / (1 + np.exp(-v))

    def likelihood(theta):
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        y = np.searchsorted(model.grades, ratings)
        return float(np.log(sure(edges[y + 1] - z) - sure(edges[y] - z)).sum())

    for i in range(len(texts)):
        p = np.diff([0.0, *(sure(t - z[i]) for t in model.thresholds), 1.0])
        assert expected[i] == pytest.approx(float(p @ model.grades), abs=1e-5) and tail[i] == pytest.approx(float(p[np.array(model.grades) >= 1].sum()), abs=1e-5)
    for k in range(len(model.thresholds)):
        for step in (-0.3, 0.3):
            moved = model.thresholds.copy()
            moved[k] += step
            assert likelihood(moved) < likelihood(model.thresholds) + 0.05


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_pattern(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            bad = k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 10 <= len(d) <= 15
            if not bad:
                out.append((m.start(), list(PATTERNS).index(k), m.end()))
    return [(list(PATTERNS)[k], a, b) for a, k, b in sorted(out)]


def test_op8_base_patterns():
    rng = random.Random(11)
    parts = ["1", "23", "4.", ".", "@", "a", "+", "-", " ", "(", "é", "a.b", "x@y.z", "1.2.3", "4111111111111111", "+1 (017) 555-7713", "%", "0" * 30]
    for _ in range(5000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(s) == base_by_pattern(s)


def test_op8_field(spark, docs, nothing):
    field = pii.trained()
    table = pii.labelled_table(300, 77)
    found = pii.field_spans([t for t, _ in table], field)
    right = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, table, strict=True))
    assert right > 0.8 * sum(len(s) for _, s in table) and right > 0.8 * sum(map(len, found))
    # Viterbi against every path of a short sequence.
    rng = np.random.default_rng(12)
    u, t = rng.normal(size=(3, pii.LABELS)), field.transition

    def total(path):
        return t[0, path[0]] + sum(u[i, c] for i, c in enumerate(path)) + t[path[0], path[1]] + t[path[1], path[2]] + t[path[2], 0]

    assert tuple(pii.viterbi([u], t)[0]) == max(itertools.product(range(pii.LABELS), repeat=3), key=total)
    # Leaving out what is far from every trigger changes nothing.
    text = prose(random.Random(1), 50) + " call (212) 555-0147 or x@y.org " + prose(random.Random(2), 50)
    places, shapes, space = pii.tokenized(text)
    scores = field.unary(shapes, space)
    scores[~pii.near_trigger(shapes), 1:] = -1e4
    whole = pii.viterbi([scores], t)[0]
    assert sum(whole % 2 == 1) == len(pii.field_spans([text], field)[0])
    more = spark.createDataFrame([(70, "mail é.x@y.org, call (212) 555-0147"), (71, "4111 1111 1111 1111 and 8.8.8.8")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs.select("doc_id", "text").unionByName(more)).collect()}
    assert (got[70].n_email, got[70].spans, got[70].n_added) == (1, "email:6:13,phone:20:34", 1) or got[70].spans.startswith("email:")
    assert got[71].base_sha256 == hashlib.sha256(b"card:0:19,ip:24:31").hexdigest() and got[3].spans == ""
    red = {r.doc_id: r.text for r in pii.redact(docs.select("doc_id", "text").unionByName(more)).collect()}
    assert red[71] == "[CARD] and [IP]" and red[3] is None and pii.find(nothing).count() == 0


def test_op9_held_out(spark, docs, nothing):
    rng = random.Random(13)
    rows = []
    for _ in range(700):
        g = rng.randrange(3)
        w = prose(rng, rng.randint(20, 60)).split()
        rows.append((" ".join(w) if g == 2 else " ".join(x + rng.choice(["###", ""]) for x in w) if g == 1 else "!!! ".join(x.upper() for x in w[:9] * 5), g))
    model = quality.fit([t for t, _ in rows[:500]], [g for _, g in rows[:500]], keep_from=1)
    assert (np.diff(model.thresholds) > 0).all()
    expected, keep = quality.score_texts(pa.array([t for t, _ in rows[500:]]), model)
    grades = np.array([g for _, g in rows[500:]])
    assert np.abs(expected - grades).mean() < 0.3 and ((keep >= 0.5) == (grades >= 1)).mean() > 0.95
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.where("p_keep is null or isnan(p_keep)").count() == 0 and quality.score(nothing, model).count() == 0
    assert quality.fit(["a"], [1], 1).grades == [1]


def contaminated_by_brute_force(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for g in [tuple(w[k : k + 10]) for k in range(len(w) - 9)] if len(w) > 9 else [tuple(w)] if w else []:
            windows[g].add(i)
    out = []
    for d, t in rows:
        w = words_of(t)
        hit, found = np.zeros(len(w), bool), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in windows:
                    hit[k : k + n] = True
                    found |= windows[g]
        names = sorted(str(i) for i in found if i is not None)
        out.append((str(d), len(w), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit.any())))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 5000}, {"block_bytes": 900}])
def test_op10_like_every_window(spark, docs, nothing, options):
    rng = random.Random(14)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 10, 30]))) for i in range(12)] + [(90, None), (None, prose(rng, 12)), (3, prose(rng, 15))]
    rows = [(r[0], r[1]) for r in odd_rows()] + [(500 + i, f"{prose(rng, 30)}. {rng.choice(items)[1] or ''} {prose(rng, 9)} {(rng.choice(items)[1] or '')[:80].upper()}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((str(r[0]), *r[1:]) for r in decontam.report(df, bench, **options).collect()) == contaminated_by_brute_force(rows, items)
    assert decontam.report(nothing, bench).count() == 0 and decontam.report(df, bench.limit(0)).where("contaminated").count() == 0
    cleaned = decontam.clean(df.where("doc_id is not null"), bench.where("text is null or length(text) > 60"))
    left = decontam.report(cleaned, bench.where("length(text) > 60"))
    assert left.agg(F.sum("n_hit")).first()[0] == 0 and cleaned.where("doc_id = 3").first().text is None


def test_op10_cuts_alike_by_blocks(spark):
    """Windows of two blocks overlap in a text, or would meet only after another block's cut."""
    rows, items = [(None, None), (None, "null id"), (90, ""), (91, None)], []
    for k in range(8):
        w = [f"w{k}x{i}" for i in range(15)]
        items += [(f"a{k}", " ".join(w[:10])), (f"b{k}", " ".join(w[5:]))]
        rows += [(k, "before " + " ".join(w) + " after"), (k, "before " + " ".join(w) + " after")]
        side = [f"s{k}x{i}" for i in range(10)]
        items.append((f"c{k}", " ".join(side)))
        rows.append((10 + k, " ".join(side[:5] + w[:10] + side[5:])))
        rows.append((None, " ".join(w[:10]) + f" {k}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    total = sum(len(t) for _, t in items)
    got = [sorted(map(repr, decontam.clean(df, bench, block_bytes=b, mark="cut").collect())) for b in (8 << 20, total // 2 + 1)]
    assert got[0] == got[1]
    assert sum("text='before after'" in r and "cut=True" in r for r in got[1]) == 16
    assert sum("s" in r and "x4 s" in r for r in got[1]) == 8
    plain = decontam.clean(df, bench, block_bytes=total // 2 + 1)
    assert plain.schema == df.schema and plain.count() == len(rows)
