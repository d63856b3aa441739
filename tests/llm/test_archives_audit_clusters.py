"""WARC archives, the divergence audit and clustering over approximations, against brute force and round trips."""

import base64
import collections
import gzip
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import divergence, vafile, warc
from tidemark.llm.perfecthash import PerfectHash

PAGES = "page_id long, url string, html string, payload string, record_type int"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 7}.example/{i}", rng.choice(["same page", f"page {i} " * rng.randint(1, 200), "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"]), "clash", 1) for i in range(200)]
    rows += [(900, None, None, None, None), (901, "http://x/\r\nInjected: 1", "", None, None), (902, "http://漢/ a", "z" * 3_000_000, None, None), (903, "u", "twice", None, None), (903, "u", "twice", None, None), (904, "u", "twice", None, None), (None, "n", "only null", None, None), (None, "n", "same page", None, None)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(3)


def expected(rows, min_bytes):
    key = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in sorted(rows, key=key):
        first.setdefault((r[2] or "").encode(), r[0])
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        revisit = len(b) >= min_bytes and first[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_pages_come_back(spark, pages, min_bytes):
    rows, df = pages
    path = warc.archive_pages(df, min_bytes=min_bytes, fileBytes="5000")
    got = warc.read_pages(spark, path)
    assert sorted((tuple(r) for r in got.drop("payload", "url").collect()), key=str) == expected(rows, min_bytes)
    texts = {i: (h or "").encode() for i, _, h, *_ in rows if i is not None}
    for r in got.filter("record_type = 'response' and page_id is not null").collect():
        assert bytes(r["payload"]) == texts[r["page_id"]]
    assert got.filter("record_type = 'revisit' and payload is not null").count() == 0
    # ranges of any size read each record once
    for split in ("700", "4099"):
        ranges = warc.read_archives(spark, path, payload=False, splitBytes=split)
        assert ranges.filter("record_type <> 'warcinfo'").count() == len(rows)


def test_empty_table_gives_an_empty_archive(spark, pages):
    path = warc.archive_pages(pages[1].limit(0))
    assert warc.read_pages(spark, path).count() == 0


def test_filters_are_pushed_and_rejected_payloads_stay_packed(spark, pages, tmp_path):
    path = warc.archive_pages(pages[1], fileBytes="1000000000")
    read = warc.read_archives(spark, path)
    some = read.filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h3") & ~F.col("record_id").isin("urn:page:3"))
    assert "Filter " not in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == len([r for r in warc.read_archives(spark, path).collect() if r["record_type"] == "response" and (r["target_uri"] or "").startswith("http://h3") and r["record_id"] != "urn:page:3"]) > 0
    # payloads broken behind their headers hurt only those who read them
    folder, broken = path.removeprefix("file://"), tmp_path / "broken"
    broken.mkdir()
    for name in os.listdir(folder):
        if not name.endswith(".gz"):
            continue
        data, at = bytearray(open(f"{folder}/{name}", "rb").read()), 0
        while at < len(data):
            size = int.from_bytes(data[at + 16 : at + 20], "little")
            if size > 2500:
                data[at + 1500 : at + size - 20] = b"\xa5" * (size - 1520)
            at += size
        (broken / name).write_bytes(data)
    assert warc.read_archives(spark, str(broken), payload=False).filter("record_type = 'revisit'").count() == read.filter("record_type = 'revisit'").count()
    with pytest.raises(PythonException):
        warc.read_archives(spark, str(broken)).collect()


def test_foreign_archives(spark, tmp_path):
    def record(kind, i, block, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://a/{i}\r\nX-Crawl: c{i}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nWARC/1.0\r\n\r\nbody"
    parts = [record("response", 1, body), record("request", 2, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), record("response", 3, body * 500)]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    for name in ("plain.warc", "each.warc.gz", "one.warc.gz"):
        got = warc.read_archives(spark, f"{tmp_path}/{name}", headerColumns="X-Crawl")
        rows = {r["record_id"]: r for r in got.collect()}
        assert len(rows) == 3, name
        assert bytes(rows["urn:x:1"]["payload"]) == b"WARC/1.0\r\n\r\nbody"
        assert len(rows["urn:x:3"]["payload"]) == len(body * 500) - len(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")
        assert [r["record_id"] for r in got.filter("x_crawl = 'c2'").collect()] == ["urn:x:2"]
        assert rows["urn:x:2"]["headers"]["warc-type"] == "request"
    assert warc.read_archives(spark, str(tmp_path)).count() == 9
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(parts[2])[:-200])
    with pytest.raises(PythonException):
        warc.read_archives(spark, f"{tmp_path}/cut.warc.gz").collect()


def test_commits_decide_what_counts(spark, pages, tmp_path):
    path = f"{tmp_path}/kept"
    rows = warc.archive_pages(pages[1].filter("page_id < 10"), path)
    (tmp_path / "kept" / "part-lost.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_pages(spark, rows).count() == 10
    warc.archive_pages(pages[1].filter("page_id between 10 and 14"), path)
    assert warc.read_pages(spark, path).count() == 15
    frame = warc.read_archives(spark, path).filter("record_type = 'response'").limit(1).select(*warc.WRITTEN.names)
    frame.write.format("warc").mode("overwrite").save(path)
    assert warc.read_pages(spark, path).count() == 1


# -- divergence


def test_perfect_hash():
    rng = random.Random(1)
    keys = sorted({f"k{rng.randrange(10**9)}".encode() for _ in range(5000)})
    hashes = divergence._hashes(keys)
    sizes, bits, order = PerfectHash.build(keys, hashes)
    table = PerfectHash(sizes, bits, pa.array([keys[i] for i in order], pa.binary()))
    assert sorted(table.slots(pa.array(keys, pa.binary()), hashes)) == list(range(len(keys)))
    assert len(bits) < len(keys)  # under 8 bits a key
    strange = [f"s{i}".encode() for i in range(3000)]
    assert (table.slots(pa.array(strange, pa.binary()), divergence._hashes(strange)) == -1).all()
    # other keys with a stored key's hash are told apart, and equal hashes still get slots of their own
    forged = PerfectHash.build([b"a", b"b", b"c"], np.array([7, 7, 9], np.uint64))
    table = PerfectHash(forged[0], forged[1], pa.array([[b"a", b"b", b"c"][i] for i in forged[2]], pa.binary()))
    assert sorted(table.slots(pa.array([b"a", b"b", b"c", b"d"], pa.binary()), np.array([7, 7, 9, 9], np.uint64))) == [-1, 0, 1, 2]


def audit_rows(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_docs]
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(count.values(), collections.Counter())
        total, all_ = {s: sum(c.values()) for s, c in count.items()}, sum(whole.values())
        for s in count:
            pairs = [(-sum((share(count[s][t], total[s]) - share(count[o][t], total[o])) ** 2 // share(count[o][t], total[o]) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(p, share(whole[t], all_), t) for t in kept if count[s][t] and (p := share(count[s][t], total[s])) > share(whole[t], all_)]
            terms = sorted((-((p - q) ** 2 // q), t.encode(), t) for p, q, t in terms)[:top]
            for part, xs in (("pair", sorted(pairs)), ("term", terms)):
                out += [(lang, s, part, t, -v, k) for k, (v, _, t) in enumerate(xs, 1)]
    return sorted(out)


def audit_documents():
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "漢字", "straße", "K"]
    rows = [(i, " ".join(rng.choice(words[: 20 + i % 45]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "é", ""])) for i in range(150)]
    return rows + [(200, "common " * 50_000, "en", "hot"), (201, None, "en", "bare"), (202, "", "fr", "x"), (203, "one", "fr", "y"), (204, "solo", "xx", "only"), (1, "wa wb", "en", "a"), (1, "wa wb", "en", "a"), (None, "wa  1wa2wb", "en", None)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("bounds", [{}, {"shard_keys": 7, "block_bytes": 300, "dense_bytes": 100, "range_cells": 20}, {"top_terms": 3}])
def test_audit(spark, bounds):
    rows = audit_documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "slot": F.lit("x"), "n": F.lit(2)}).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, **bounds).collect())
    assert got == audit_rows(rows, top=bounds.get("top_terms", 200))


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(1, "a b", "en", "s"), (2, "b", "en", "t")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(few, SCHEMA)).collect())) == audit_rows(few)


def test_shares_are_exact_beyond_longs(spark):
    df = spark.createDataFrame([(9 * 10**17, 9 * 10**17 + 5)], "n long, total long").select(divergence._share("n", "total").alias("p"))
    assert df.first()[0] == 1 + 10**9 * (9 * 10**17 + 1) // (9 * 10**17 + 5)


# -- clustering


def clusters(rows, k, rounds, dimensions=64, seed=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for n in range(rounds + 1):
        place = [min((far(v, c), j) for j, c in enumerate(cs)) for _, v in kept]
        if n < rounds:
            for j in range(len(cs)):
                mine = [v for (_, v), p in zip(kept, place, strict=True) if p[1] == j]
                if mine:
                    cs[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = sum(d for d, _ in place)
    return sorted(((i, j, d, sum(e for e, m in place if m == j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, place, strict=True)), key=str)


def vectors():
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((6, 64))
    rows = [(i, [float(x) for x in (middle[i % 6] + rng.standard_normal(64) * 0.4)]) for i in range(220)]
    rows += [(300 + i, rows[0][1]) for i in range(80)] + [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1])]
    nan = [*rows[0][1][:-1], float("nan")]
    return rows + [(400, None), (401, []), (402, [1.0]), (403, nan), (404, [float("inf"), *nan[:-1]]), (405, [None, *nan[:-1]]), (406, rows[1][1] + [0.0])]


@pytest.mark.parametrize(("k", "bits"), [(9, 6), (9, 1), (40, 4)])
def test_clusters(spark, k, bits):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "row": F.lit(1)}).repartition(3)
    got = vafile.cluster(df, k=k, rounds=3, bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == clusters(rows, k, 3)


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert vafile.cluster(spark.createDataFrame([(1, None)], kind)).count() == 0
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)]
    assert sorted((tuple(r) for r in vafile.cluster(spark.createDataFrame(rows, kind)).collect()), key=str) == clusters(rows, 40, 5)
    large = [(1, [1e30] * 64), (2, [0.25] * 64)]
    assert [r["vec_id"] for r in vafile.cluster(spark.createDataFrame(large, kind)).collect()] == [2]


def test_intervals_hold_distances_and_spare_vectors(spark):
    rng = np.random.default_rng(0)
    middle = rng.standard_normal((20, 64)) * 60
    whole = (middle[np.arange(500) % 20] + rng.standard_normal((500, 64)) * 15).astype(np.int64)
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(whole)], T.StructType().add("vec_id", "long").add("v", T.ArrayType(T.LongType()))).withColumn("row", F.monotonically_increasing_id())
    file = vafile.VectorFile(df, 64, 6)
    centroids = whole[:20]
    cells = np.stack([np.searchsorted(file.edges[d, 1:-1], whole[:, d], side="right") for d in range(64)], axis=1)
    assert (vafile.unpack(vafile.pack(cells, 6), 64, 6) == cells).all()
    low, high = vafile.intervals(cells, *vafile.distance_tables(file.edges, centroids))
    exact = ((whole[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    file.assign(centroids)
    first = file.fetched
    file.assign(centroids)
    again = file.fetched - first
    file.close()
    assert first == 500 and again < 100  # settled rows are told by their cells alone


def test_scores_of_any_ids(spark):
    from tidemark.llm import lm

    rows = [("b7", "one two three one"), ("a1", "two two"), (None, "three"), ("a1", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("held_out", F.lit(False))
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in lm.score(docs, lm.train(docs)).collect()), key=str)
    assert got == sorted([("b7", 5), ("a1", 3), (None, 2), ("a1", 1)], key=str)


def test_tasks_send_packed_counts():
    """One row a group and shard leaves a task, not one a term; sums come array by array."""
    counts = divergence._Counts({}, 1, 1 << 20)
    counts.dense = {("en", "a", 0): np.array([0, 3, 0, 2]), ("en", "b", 0): np.zeros(4, np.int64), ("fr", "a", 1): np.array([5])}
    rows = list(counts.flush())
    assert sum(b.num_rows for b in rows) == 2
    got = [tuple(r.values()) for b in divergence._add_packed(iter([rows[0], rows[0], rows[1]])) for r in b.to_pylist()]
    assert got == [("en", "a", 0, 1, 6), ("en", "a", 0, 3, 4), ("fr", "a", 1, 0, 5)]


def test_terms_of_a_batch_are_counted_as_by_a_plain_loop():
    texts = ["B\u00e9b\u00e9 a-a A1a", None, "", "zz a \u6f22z", "a zz"]
    t = divergence.Terms(pa.array(texts))
    group = np.array([0, 0, 1, 1, 0])
    plain = [re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) for x in texts]
    for documents in (False, True):
        want = {}
        for g, words in zip(group.tolist(), plain, strict=True):
            for w in set(words) if documents else words:
                want[g, w] = want.get((g, w), 0) + 1
        got = {(g, w.decode()): n for g, which, times in t.counts(group, documents) for w, n in zip(t.array(which).to_pylist(), times.tolist(), strict=True)}
        assert got == want
