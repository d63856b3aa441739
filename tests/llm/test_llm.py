"""The training-data operators against brute force, on texts with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fmindex, jaccard, linededup, lm, quality, repeats, sharding, suffixes, tokenfiles

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"
ODD = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "x"), (9004, "X"), (9005, "one two three"), (9005, "one two three"), (9006, "wörd " * 3000), (None, "a null id"), (9007, "漢字 é🙂\x1c\x85 '' <|endoftext|> IT'S  end \n")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)] + ["the", "De", "é,"]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (8, 25, 45, 90)]
    out = []
    for i in range(120):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), "ab" * rng.randint(1, 90)]) for _ in range(rng.randint(1, 5))]
        out.append((i, rng.choice([" ", "\n"]).join(parts)))
    for i in range(40):
        base = out[i % 5][1].split(" ")
        if i % 3:
            base[rng.randrange(len(base))] = "changed"
        out.append((200 + i, " ".join(base)))
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def none_first(i):
    return -1 if i is None else i


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize(("chunk", "mass"), [(jaccard.CHUNK, jaccard.CHUNK_SHINGLES), (3, jaccard.CHUNK_SHINGLES), (jaccard.CHUNK, 150)])
def test_jaccard(docs, rows, chunk, mass):
    def shingles(t):
        w = lower(t).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(none_first(i), shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, u in sets[:k]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = sorted((i, len(s), find(i)) for i, s in sets)
    assert sorted((none_first(r.doc_id), r.n_shingles, none_first(r.component_id)) for r in jaccard.near_duplicates(docs, chunk=chunk, chunk_shingles=mass).collect()) == want


def test_jaccard_lanes_are_split_by_key(docs):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 90).astype(np.uint64)) for _ in range(400)]
    sets += [np.append(x[1:], np.uint64(k)) for k, x in enumerate(sets[:50])]
    h, offs = np.concatenate([np.sort(x) for x in sets]), np.cumsum([0, *map(len, sets)])
    t, lanes, none = jaccard.THRESHOLD, 6, np.zeros(0, np.uint64)
    most = jaccard.most_keys(np.diff(offs), t)
    keys, owner, lane = jaccard.block_keys(h, offs, none, t, lanes)
    assert len(keys) <= most.sum()
    assert np.bincount(lane).max() > 1000
    split_keys, split_owner, group = jaccard.block_keys(h, offs, none, t, lanes, jaccard.lane_splits(most, lanes, t, 500))
    assert np.array_equal(keys, split_keys) and np.array_equal(owner, split_owner)
    assert np.bincount(group).max() <= 550
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    assert same.any() and (group[order][1:] == group[order][:-1])[same].all()
    assert all(len(np.unique(lane[group == g])) == 1 for g in np.unique(group))
    want = sorted(map(str, jaccard.near_duplicates(docs).collect()))
    assert sorted(map(str, jaccard.near_duplicates(docs, lane_keys=50).collect())) == want


def test_common_keys_are_counted_for_each_pair():
    rng = np.random.default_rng(11)
    for _ in range(60):
        nodes, least, pairs = int(rng.integers(1, 30)), int(rng.integers(1, 6)), int(rng.choice([0, 5, 50, 10**6]))
        keys, node = np.unique(np.stack([rng.integers(0, rng.integers(1, 80), 150), rng.integers(0, nodes, 150)]), axis=1)
        root, a, b, n = jaccard.shared_keys(keys.astype(np.uint64), node, nodes, lambda a, b, least=least: np.full(len(a), least), pairs)
        got = {(min(x), max(x)): k for *x, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)}
        for x in range(nodes):
            for y in range(x + 1, nodes):
                both = len(np.intersect1d(keys[node == x], keys[node == y]))
                assert root[x] == root[y] or (both < least and got.get((x, y), 0) == both)


def test_texts_that_share_a_little_form_no_group(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, tail = [], some(80)
    for i in range(30):  # each shares a passage with the next: a chain of texts, none linked
        body, head, tail = some(700 + 10 * i), tail, some(80)
        rows.append((i, " ".join(head + body + tail)))
    for i in range(5):
        rows.append((100 + i, rows[i * 6][1].replace(" ", " new ", 20)))
    seen, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda docs, groups, *a: (seen.extend(r.node for r in groups.collect()), links(docs, groups, *a))[1])
    found = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(i, i % 100 * 6 if i >= 100 else i) for i, _ in rows}
    assert sorted(seen) == [0, 6, 12, 18, 24, 100, 101, 102, 103, 104]


def test_signature_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 60)).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.append(s[1:], np.uint64(7))) for s in sets]
    sets.sort(key=len)
    i, j = jaccard.SignatureTree(sets).pairs(jaccard.THRESHOLD)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found


def test_tree_links_span_all_links():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(8, 80)).astype(np.uint64))
        for _ in range(rng.integers(1, 12)):  # chains: each differs a little from the one before
            base = np.unique(np.append(np.delete(base, rng.integers(0, len(base), 2)), rng.integers(0, 1 << 62, 2).astype(np.uint64)))
            sets.append(base)
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def groups(edges):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(sets))]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])]
    found = jaccard.tree_links(sets, list(range(len(sets))))
    assert all(linked(sets[a], sets[b]) for a, b in found)
    assert groups(found) == groups(every)
    assert len(found) == len(sets) - len(set(groups(every)))
    labels = groups(every[::2])
    assert groups([*every[::2], *jaccard.tree_links(sets, labels)]) == groups(every)


def test_big_groups_are_cut_by_size(spark):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 15, 90, 100, 112, 113, 125, 126, 5000, 6249, 6250, 6251, 20000]
    groups = spark.createDataFrame([(k, 0, n, 0) for k, n in enumerate(sizes)], "node long, component long, n long, head long")
    cuts = {}
    for r in jaccard._by_size(groups, jaccard.THRESHOLD).collect():
        cuts.setdefault(r.component, set()).add((r.node, r.head))
    assert all(len(c) > 1 and {h for _, h in c} == {min(n for n, _ in c)} for c in cuts.values())
    together = {(a, b) for c in cuts.values() for a, _ in c for b, _ in c if a < b}
    for a, n in enumerate(sizes):
        for b in range(a + 1, len(sizes)):
            assert n * 5 < sizes[b] * 4 or (a, b) in together
    assert (0, 21) not in together and (11, 17) not in together


def test_keep_one_tells_rows_apart(spark):
    t, u = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, t), (7, t), (None, t), (5, t + " more"), (5, u), (6, None), (8, ""), (9, u.upper())]
    kept = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((none_first(r.doc_id), r.text or "") for r in kept) == [(-1, t), (5, u), (6, ""), (8, "")]
    named = spark.createDataFrame([(f"d{i}", x) for i, x in rows if i] + [(None, t)], "doc_id string, text string")
    found = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(named).collect()}
    assert found == {("d1", None), ("d7", None), (None, None), ("d5", None), ("d6", "d6"), ("d8", "d8"), ("d9", None)}  # d5's two texts are one document here


def brute_removal(rows, size, split, join):
    seen = {}
    units = sorted((none_first(i), k, split(t or "")) for k, (i, t) in enumerate(rows))
    for i, _, u in units:
        for s in range(len(u) - size + 1):
            w = tuple(u[s : s + size])
            seen[w] = min(seen.get(w, (i, s)), (i, s))
    out = []
    for i, _, u in units:
        gone = [False] * len(u)
        for s in range(len(u) - size + 1):
            if seen[tuple(u[s : s + size])] < (i, s):
                gone[s : s + size] = [True] * size
        runs = sum(g and (x == 0 or not gone[x - 1]) for x, g in enumerate(gone))
        out.append((i, len(u), sum(gone), runs, join([c for c, g in zip(u, gone, strict=True) if not g])))
    return sorted(out)


@pytest.mark.parametrize(("shard", "crowded"), [(1 << 20, 40), (1500, 1)])
def test_substring_dedup(docs, rows, shard, crowded):
    want = [x[:3] + x[4:] for x in brute_removal(rows, 20, lambda t: t.encode().split(), b" ".join)]
    got = sorted((none_first(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in fmindex.dedup_substrings(docs, shard, crowded).collect())
    assert got == want


@pytest.mark.parametrize(("shard", "crowded"), [(1 << 20, 40), (1500, 1)])
def test_suffix_array_dedup(docs, rows, shard, crowded):
    got = sorted((none_first(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup_bytes(docs, shard, crowded).collect())
    assert got == brute_removal(rows, 100, lambda t: list(t.encode()), bytes)


def test_minimisers_with_many_segments_go_by_windows(docs, rows):
    posts = []
    for k in range(5):  # 30 different segments of minimiser 7 in each batch, none of them crowded; 2 of minimiser 8 in all, one of 9
        v, h = np.full(30, 7, np.uint64), np.arange(100 + 30 * k, 130 + 30 * k).astype(np.uint64)
        if k < 2:
            v, h = np.append(v, np.uint64(8)), np.append(h, np.uint64(k))
        if k == 4:
            v, h = np.append(v, np.uint64(9)), np.append(h, np.uint64(1))
        at = np.arange(len(v))
        posts.append(repeats._post(0, 1, v, h, at + 1000 * k, at, np.full(len(v), 2)))
    batch = repeats._batch([*zip(*posts, strict=True)], repeats._POST)
    kinds = collections.Counter((kind, key) for b in repeats._match_posts(100)([batch]) for kind, key in zip(b.column("kind").to_pylist(), b.column("key").to_pylist(), strict=True))
    assert kinds == {(2, 7): 150, (1, 8): 2}
    want = [x[:3] + x[4:] for x in brute_removal(rows, 20, lambda t: t.encode().split(), b" ".join)]
    got = sorted((none_first(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in fmindex.dedup_substrings(docs, together=3).collect())
    assert got == want
    got = sorted((none_first(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup_bytes(docs, together=3).collect())
    assert got == brute_removal(rows, 100, lambda t: list(t.encode()), bytes)


@pytest.mark.parametrize("crowded", [40, 1])
def test_nothing_is_removed_without_the_index(docs, crowded):
    class Blind:
        """An index that finds nothing."""

        def __init__(self, contents, ids, starts):
            assert len(set(contents)) == len(contents)

        def early(self, windows):
            return np.zeros(int(windows.sum()), bool)

        def find(self, contents, ids, starts):
            return np.zeros(len(contents), np.int64), np.full(len(contents), -1)

    for make, length, gram in ((repeats.word_units, 20, 6), (repeats.byte_units, 100, 32)):
        ids = docs.select(F.coalesce("doc_id", F.lit(-5)).alias("doc_id"), "text")
        assert repeats.repeated_windows(ids, make, Blind, length, gram, 1 << 20, crowded).count() == 0


@pytest.mark.parametrize(("make", "shard", "length"), [(repeats.word_units, fmindex.Shard, 20), (repeats.byte_units, suffixes.Shard, 100)])
def test_forged_hashes_remove_nothing(spark, make, shard, length):
    word = lambda k, n=60: " ".join(f"{k}word{i:03}" for i in range(n))
    texts = [(1, word("a")), (2, word("b")), (3, word("a")), (4, word("c", 10) + " " + word("a"))]
    docs = spark.createDataFrame(texts, SCHEMA)
    claims = [(repeats.LOOK, 7, 7, 1, 0, 5), (0, 7, 7, 2, 0, 5), (0, 7, 7, 3, 0, 5), (0, 7, 7, 4, 0, 5)]  # all begin with one segment, as forged hashes say
    found = repeats.early_places(docs, spark.createDataFrame(claims, repeats._FOUND), make, shard, length, 1 << 20)
    gone = {(r.doc_id, r.start + k) for r in found.collect() for k in range(r.windows)}
    assert gone == {(3, k) for k in range(5)}
    # the second look at doc 4's place finds what stands earlier in it, at another place than the claim says
    claims[-1] = (0, 7, 7, 4, 8 if length == 20 else 8 * 9, 5 if length == 20 else 25)
    found = repeats.early_places(docs, spark.createDataFrame(claims, repeats._FOUND), make, shard, length, 1 << 20)
    gone = {(r.doc_id, r.start + k) for r in found.collect() for k in range(r.windows)}
    tail = {(4, k) for k in range(10, 13)} if length == 20 else {(4, k) for k in range(90, 95)}
    assert gone == {(3, k) for k in range(5)} | tail


def test_common_segments_are_dealt_among_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "SPREAD", 2)
    want = [x[:3] for x in brute_removal(rows, 20, lambda t: t.encode().split(), b" ".join)]
    assert sorted((none_first(r.doc_id), r.n_words, r.n_removed) for r in fmindex.dedup_substrings(docs, 500).collect()) == want


@pytest.mark.parametrize("shard", [fmindex.Shard, suffixes.Shard])
def test_lookups_in_a_shard(shard):
    rng = random.Random(5)
    text = lambda n: b" ".join(b"%03d" % rng.randrange(40) for _ in range(n))
    heads = sorted({text(rng.randint(3, 6)) for _ in range(300)})
    index = shard(heads, np.arange(300)[: len(heads)], np.zeros(len(heads), np.int64), 3)
    asked = heads[::3] + [text(4) for _ in range(100)] + [h + b" 041" for h in heads[:50]]
    ids, starts = index.find(asked, np.full(len(asked), 1000), np.arange(len(asked)))
    for c, i, s in zip(asked, ids.tolist(), starts.tolist(), strict=True):
        there = c in heads
        if s < 0:
            assert not there
        else:
            source = heads[i] if i < 1000 else asked[s]
            assert c in source


def test_ids_of_any_type(spark, docs, rows):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))).withColumn("hits", F.lit(1))
    back = lambda i: -1 if i is None else int(i[1:])
    want = [x[:3] for x in brute_removal(rows, 20, lambda t: t.encode().split(), b" ".join)]
    assert sorted((back(r.doc_id), r.n_words, r.n_removed) for r in fmindex.dedup_substrings(named).collect()) == sorted(want)


def test_fm_index():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(60)]
    pieces += pieces[:20]
    text = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.int64)
    index = fmindex.FMIndex(text, rate=4)
    order = fmindex.suffix_order(text)
    assert index.positions(np.arange(len(text))).tolist() == order.tolist()
    raw = bytes(text.astype(np.uint8))
    start = np.array([i for i in range(len(raw) - 12) if 0 not in raw[i : i + 12]])
    stat, low, high = index.matching_statistics(text, start, 12)
    least = index.least_positions(low[stat == 12], high[stat == 12])
    places = lambda p: [i for i in range(len(raw)) if raw.startswith(p, i)]
    for i, n in zip(start.tolist(), stat.tolist(), strict=True):
        best = next((k for k in range(12, 0, -1) if len(places(raw[i + 12 - k : i + 12])) > 1), 0)
        assert n == best
    assert least.tolist() == [places(raw[i : i + 12])[0] for i in start[stat == 12].tolist()]
    big = np.append(rng.integers(1, 1000, 400_000), 0)
    assert fmindex.FMIndex(big).nbytes() < 3 * len(big)  # less than the symbols alone take as 32-bit numbers


def test_longest_previous_factor():
    rng = np.random.default_rng(9)
    for text in (np.frombuffer(b"abracadabra abracadabra cad", np.uint8), rng.integers(97, 99, 300).astype(np.uint8), np.tile(rng.integers(97, 123, 70).astype(np.uint8), 4)):
        for depth in (8, 20, 100):
            at = np.arange(len(text))
            length, source = suffixes.longest_previous_factor(text, at, depth)
            raw = text.tobytes()
            for i in range(len(raw)):
                best = max((next((n for n in range(min(depth, len(raw) - i), 0, -1) if raw[j : j + n] == raw[i : i + n]), 0) for j in range(i)), default=0)
                assert length[i] == best
                assert best == 0 or (source[i] < i and raw[source[i] : source[i] + best] == raw[i : i + best])


def test_line_dedup(docs, rows):
    strip = " \t\n\x0b\x0c\r"
    keys = collections.Counter(k for _, t in rows for k in {lower(x.strip(strip)) for x in (t or "").split("\n")})
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (lower(x.strip(strip)) and keys[lower(x.strip(strip))] >= 3)]
        want.append((none_first(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    frequent = linededup.frequent_keys(docs, 3)
    for limit in (linededup.BROADCAST_KEYS, 0):
        got = [(none_first(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in linededup.drop_lines(docs, frequent, limit).collect()]
        assert sorted(got) == sorted(want)


def test_line_runs_are_compacted(spark):
    runs = linededup.LineRuns(spark, 3, fanout=2)
    batch = lambda *rows: spark.createDataFrame(rows, "h long, g long, n long")
    for k in range(5):
        runs.add(batch((1, 1, 1), (2, 2, 2), (10 + k, 0, 1)))
        full = {tuple(r) for r in runs.frequent().collect()}
        assert full == ({(2, 2)} if k == 1 else {(1, 1), (2, 2)} if k > 1 else set())
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    counts = {(r.h, r.n) for r in runs.runs()[-1].collect()}
    assert (1, 3) in counts and (2, 4) in counts  # full keys take no more part
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = runs.met(batch((1, 1, 1), (20, 0, 1)))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("SortMergeJoin") == 4 and plan.count("Exchange hashpartitioning") == 1  # the batch moves, the runs don't
    names = list(runs.names)
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination(spark, docs, rows, block):
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(lower(t).encode())
    items = [(1, " ".join(rows[0][1].split()[:30])), (2, "One, TWO three"), (10, rows[3][1]), (3, None), (4, "!!"), (5, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for name, t in items:
        w = split(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(name))
    want = []
    for i, t in rows:
        w = split(t)
        hit, names = set(), set()
        for g, owners in windows.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= {*range(s, s + len(g))}
                    names |= owners
        want.append((none_first(i), len(w), len(hit), sorted(names)))
    found = decontaminate.find_hits(docs, bench, block_bytes=block).collect()
    assert sorted((none_first(r.doc_id), r.n_words, r.n_hit, r.items) for r in found) == sorted(want)
    assert all(not r.n_hit or len(split(r.kept_text)) <= r.n_words - r.n_hit + 1 for r in found)


def test_sharding(docs, rows):
    got = sharding.assign(docs, 7).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == [*range(sizes[s])]
    assert {(none_first(r.doc_id), r.size, r.text_crc32) for r in got} == {(none_first(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    for total in (1, 2, 5, 1000):
        assert sorted(sharding.permute(np.arange(total), total, 3).tolist()) == [*range(total)]


def tokenizer_files(folder):
    """The given tokenizer, the same without lower-casing, and one that keeps white space."""
    import json

    path = P.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        cased = json.load(f)
    cased["normalizer"]["normalizers"] = [x for x in cased["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    (folder / "cased.json").write_text(json.dumps(cased), encoding="utf-8")
    return [path, str(folder / "cased.json"), P.path("byte_bpe_50k.json")]


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    kinds = []
    for path in tokenizer_files(tmp_path):
        t = Tokenizer.from_file(path)
        start, want = 0, []
        for i, x in sorted(rows, key=lambda r: (none_first(r[0]), r[1] or "")):
            ids = t.encode(x or "", add_special_tokens=False).ids + [1]
            want.append((none_first(i), start, len(ids), np.array(ids, "<u4").tobytes()))
            start += len(ids)
        with open(path, encoding="utf-8") as f:
            coder = tokenfiles.WordCoder(f.read())
        kinds.append((coder.by_word, coder.lowers, coder.parts))
        for tokens in (tokenfiles.SHARD_TOKENS, 700):
            files = tokenfiles.write_tokens(docs, path, shard_tokens=tokens)
            got = sorted((none_first(r.doc_id), r.start, r.n_tokens, bytes(r.ids)) for r in tokenfiles.read_tokens(docs, files).collect())
            assert got == sorted(want)
        assert spark.read.parquet(files).count() > 8
    assert kinds == [(True, True, True), (True, False, False), (False, False, False)]


def test_word_coder_equals_the_library():
    import pyarrow as pa

    rng = random.Random(8)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = tokenfiles.WordCoder(f.read())
    pieces = ["Stone", "r\u00edo", "E\u0301t\u00e9", "it's", "IT'S.", ".", ",,", "a.b", "x,.", "<|endoftext|>", "<|EndOfText|>.", "\u6f22\u5b57\u3002", "9,5", "\u00a0", "\u2003", "\x1c", "\U0001f642.", "ab" * 300 + ".", "x\u2019.", "ci\u00f3n,", "r\u00edo###", "a<|b.", "tz&&&", "it's-", "\u00aa.", "x\u0301!"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(pieces) + rng.choice(["", " ", "\t\r\n", "."]) for _ in range(40)) for _ in range(60)] + [None, "", " "]
    texts += ["\u00e9 ###", "\u6f22\n...", "\u00e9t\u00e9 .,;!"]
    ids, at, n, which, words = coder(pa.array(texts))
    flat = np.concatenate([ids[at[w] : at[w] + n[w]] for w in which])
    ends = np.cumsum(words)
    sizes = [int(n[which[e - w : e]].sum()) for e, w in zip(ends, words, strict=True)]
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes == [len(x) for x in want]
    assert flat.tolist() == [y for x in want for y in x]


def test_words_of_letters_skip_the_steps_before_the_model(tmp_path):
    """Words of a-z and of Latin-1 letters go to the model in lines, other words through the whole tokenizer; ids are the library's."""
    rng = random.Random(4)
    low, latin = "abcdefghijklmnopqrstuvwxyz", [chr(k) for k in range(0xDF, 0x100) if k != 0xF7]
    upper = [chr(k) for k in range(0xC0, 0xDF) if k != 0xD7]
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    easy = {word(low) for _ in range(101)} | {word([*low, *latin]) for _ in range(200)} | {*latin, *low, "x" * 500}
    cased = {word([*low, *low.upper(), *latin, *upper]) for _ in range(200)} | {*upper}
    hard = {"\u00d7a", "a\u00f7", "\u0178", "\u0131", "e\u0301", "\u00e9\u0301", "\u03a3\u03c3", "\u0143a", "\ud55c", "a0b", "0", "it's", "\u00c3\u00b7", "\u01c3"}
    as_arrays = lambda words: (np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w.encode()) for w in words], np.int64))
    for path, lowers in zip(tokenizer_files(tmp_path)[:2], (True, False), strict=True):
        with open(path, encoding="utf-8") as f:
            coder = tokenfiles.WordCoder(f.read())
        whole, seen = coder.ids, []
        coder.ids = lambda lines, whole=whole, seen=seen: seen.extend(lines) or whole(lines)
        for words in (sorted(easy | cased) if lowers else sorted(easy), sorted(easy | cased | hard), ["a"], ["\u00e9"], []):
            seen.clear()
            ids, n = coder.learn_stems(*as_arrays(words))
            if not {*words} & hard and (lowers or not {*words} & cased):
                assert not seen
            want = whole(words)
            assert n.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]

    class NoMarks:
        def encode_batch_fast(self, lines, **_):
            return coder.tokenizer.encode_batch_fast([x.replace("0", " ") for x in lines], add_special_tokens=False)

    coder.bare = [NoMarks(), NoMarks()]  # a digit's id that isn't where it must be: the whole tokenizer again
    ids, n = coder.learn_stems(*as_arrays(sorted(easy)))
    assert ids.tolist() == [y for x in whole(sorted(easy)) for y in x] and n.tolist() == [len(x) for x in whole(sorted(easy))]


def test_distinct_is_unique():
    from tidemark.llm.arrays import distinct

    rng = np.random.default_rng(3)
    for keys, bits in (
        (rng.integers(0, 2**63, 5000, dtype=np.uint64)[rng.integers(0, 5000, 9000)], 64), (rng.integers(0, 50, 4000, dtype=np.uint64), 64), (rng.integers(0, 2**34, 3000), 34),
        (np.uint64(7 << 50) + rng.integers(0, 9, 4000, dtype=np.uint64), 64), (np.zeros(0, np.uint64), 64), (np.array([5], np.uint64), 64), (np.full(9, 2**64 - 1, np.uint64), 64),
    ):
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        got = distinct(keys, bits)
        assert got[0].tolist() == first.tolist() and got[1].tolist() == which.tolist()


def as_words(documents):
    """Documents of ids as write_shard takes them, each id a word."""
    flat = np.concatenate(documents)
    ids, which = np.unique(flat, return_inverse=True)
    return ids.astype(np.uint32), np.arange(len(ids)), np.ones(len(ids), np.int64), which, np.array([len(x) for x in documents])


def test_shard_gives_single_documents():
    rng = np.random.default_rng(2)
    ids = [rng.integers(2, 9, n) for n in (50, 0, 400, 7)] + [np.full(300, 5), np.zeros(0, np.int64)]
    shard = tokenfiles.write_shard(*as_words(ids), 10)
    assert tokenfiles.document_lengths(shard).tolist() == [len(x) + 1 for x in ids]
    for k, x in enumerate(ids):
        assert tokenfiles.decode_document(shard, k).tolist() == [*x.tolist(), 1]
    stream, starts = tokenfiles._unpack(shard["stream"]), tokenfiles._unpack(shard["starts"]).tolist()
    assert len(stream) < sum(map(len, ids)) / 2
    pairs = collections.Counter()
    for a, b in zip(starts, [*starts[1:], len(stream)], strict=True):
        k = a
        while k + 1 < b:  # places that overlap count once
            pair = tuple(stream[k : k + 2].tolist())
            pairs[pair] += 1
            k += 2 if k + 2 < b and tuple(stream[k + 1 : k + 3].tolist()) == pair else 1
    assert max(pairs.values()) < tokenfiles.LEAST


def test_book_forgets_and_learns_again():
    from tidemark.llm.wordbook import Book, distinct_spans, ids_of_spans

    rng, book = np.random.default_rng(5), Book(4000)

    def learn(raw, size):
        cuts = np.append(0, np.cumsum(size))
        return np.array([int(raw[a:b].sum()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a], np.uint32), (size > 0).astype(np.int64)

    for _ in range(30):
        size = rng.integers(0, 20, 100)
        data = rng.integers(97, 100, int(size.sum())).astype(np.uint8)
        end = np.cumsum(size)
        ids, at, n, which = ids_of_spans(book, data, end - size, end, learn)
        got = [ids[at[w] : at[w] + n[w]].tolist() for w in which]
        assert got == [[int(data[a:b].sum())] if b > a else [] for a, b in zip(end - size, end, strict=True)]
        assert book.nbytes() < 12000
    data = np.frombuffer(b"abcabd", np.uint8)
    first, which = distinct_spans(data, np.array([0, 3, 0]), np.array([3, 6, 3]), np.zeros(3, np.uint64))  # one hash for all
    assert first.tolist() == [0, 1] and which.tolist() == [0, 1, 0]


def test_byte_bpe(docs, rows):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.encode(docs, path, P.PATTERN)
    want = [(none_first(i), len(x := enc.encode_ordinary(t or "")), np.array(x, "<u4").tobytes(), (t or "").encode()) for i, t in rows]
    for out in (coded, bpe.decode(coded, path, P.PATTERN)):
        assert sorted((none_first(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect()) == sorted(want)
    other = F.concat(F.substring("ids", 1, 4), F.unhex(F.lit("2a000000")), F.expr("substring(ids, 9)"))
    spoilt = bpe.decode(coded.filter("n_tokens > 1").withColumn("ids", other), path, P.PATTERN).collect()
    assert spoilt and all(bytes(r.decoded) == enc.decode_bytes(np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in spoilt)
    assert sum(bytes(r.decoded) != (r.text or "").encode() for r in spoilt) > 100


def test_byte_bpe_pieces():
    import pyarrow as pa
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, bpe.merge_table(ranks), P.PATTERN)
    rng = random.Random(4)
    gaps = [" ", "  ", "\n", "\u00a0", "\u2003 ", " \u3000", "\x85", "\t \u2028  ", "\x1c", "\u1680  "]
    texts = ["".join(rng.choice(["it's", "\u00e0", "\u00e9t\u00e9", "\u6f22\u5b57", "x9!", "\u0100b"]) + rng.choice(gaps) for _ in range(30)) for _ in range(200)]
    texts += ["ab" * 450, "".join(rng.choice("etaoin") for _ in range(3000)), None, "", " ", "\u00a0", "\u00a0  b"]
    ids, offs = codec.encode(pa.array(texts))
    want = [enc.encode_ordinary(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == want
    raw, at = codec.decode(ids, offs)
    assert [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == [t or "" for t in texts]
    ids = ids.copy()
    ids[5] = 300
    assert codec.decode(ids, offs)[0].tobytes() != raw.tobytes()
    with pytest.raises(ValueError):
        codec.decode(np.array([1 << 20], np.uint32), np.array([0, 1]))


def test_language_model(docs, rows):
    d = docs.withColumn("held_out", lm.held_out())
    got = lm.score(d, lm.train(d.filter("not held_out"))).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = [(i, lower(t).encode().split() + [None]) for i, t in rows]
    c = collections.Counter(x for i, t in toks if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)
    want = sorted((none_first(i), held(i), len(t), sum(c[x] > 0 for x in t), n, base(t)) for i, t in toks)
    assert sorted((none_first(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_language_model_is_a_distribution_and_learns(spark):
    import pyarrow as pa

    rng = random.Random(12)
    heads, tails = [f"a{i}" for i in range(30)], [f"zz{i}" for i in range(30)]
    texts = [(i, " ".join(x for _ in range(20) for x in (rng.choice(heads), rng.choice(tails)))) for i in range(300)]
    frame = spark.createDataFrame(texts, SCHEMA).withColumn("held_out", lm.held_out())
    model = lm.train(frame.filter("not held_out"))
    held = {r.doc_id for r in frame.filter("held_out").select("doc_id").collect()}
    counts = collections.Counter(w for i, t in texts if i not in held for w in t.split())
    words = sorted(counts)
    t = lm.tokens(pa.array([" ".join(words)]))
    classes = model.counts.classes(t)[:-1]
    groups = collections.Counter()
    for w, c in zip(words, classes.tolist(), strict=True):
        if c > lm.SINGLES:
            groups[c - lm.SINGLES - 1] += counts[w] + 1
    for g in range(lm.GROUPS):  # the words of a group and one place for all unseen ones share it
        assert groups[g] + 1 == model.counts.sums[g]
    singles = [w for w, c in zip(words, classes.tolist(), strict=True) if c < lm.SINGLES]
    assert len(singles) == lm.SINGLES and len(set(classes[classes < lm.SINGLES].tolist())) == lm.SINGLES
    p = np.exp(lm._softmax(model.weights, model.bias, t.features(), slice(0, len(words))))
    assert p.shape[1] == lm.CLASSES and np.allclose(p.sum(axis=1), 1, atol=1e-4)
    rows = lm.score(frame.filter("held_out"), model).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.05 * sum(r.n_tokens for r in rows)  # the word before tells


def test_history_tells_words_of_one_class_apart(spark):
    import pyarrow as pa

    rng = random.Random(13)
    words = [(f"aa{i}", f"zz{i}") for i in range(40)]  # two groups of words by their first two bytes
    texts = [(i, " ".join(x for _ in range(30) for x in rng.choice(words))) for i in range(400)]
    frame = spark.createDataFrame(texts, SCHEMA).withColumn("held_out", lm.held_out())
    model = lm.train(frame.filter("not held_out"))
    rows = lm.score(frame.filter("held_out"), model).collect()
    gain = (sum(r.score for r in rows) - sum(r.base_score for r in rows)) / sum(r.n_tokens for r in rows)
    assert gain > 0.75, gain  # log10 a token; 0.3 is to be had from the alternation alone, log10(40) / 2 more from the word before
    # from any history the leaves of a group share all of it
    leaf = np.arange(lm.LEAVES)
    past = [np.full(lm.LEAVES, x[7]) for x in lm.tokens(pa.array([texts[0][1]])).histories()]
    log, shares = np.zeros(lm.LEAVES), model.counts.log_shares()
    for level, node, branch, places in lm.choices(leaf, past):
        log += lm._chosen(shares[level], node, model.inner[level], lm.inner_rows(level, node, places), branch)
    assert np.allclose(np.exp(log).reshape(lm.GROUPS, -1).sum(axis=1), 1, atol=1e-3)
    assert model.counts.leaves.reshape(lm.GROUPS, -1).sum(axis=1).tolist() == [x - 1 + lm.LEAVES // lm.GROUPS for x in model.counts.sums]


def quality_counts(text):
    import re

    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    under = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(under), len(words) < 50 or 100 * len(under) > 50 * len(words)


def test_quality_counts(spark, rows):
    odd = ["a b c a b c\na b c a b c\n", "x\n x\nx \nx\n\n \n", "#*$%&|<>@ \U0001f642\U0001f642 \u00e9\u0301\x1c\x85\u00a0z", "a a a", "a a a a", "\x0bq\x0c\r\n" * 30]
    every = rows + [(10_000 + k, t) for k, t in enumerate(odd)]
    got = quality.judge(spark.createDataFrame(every, SCHEMA)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((none_first(r.doc_id), *(r[x] for x in names)) for r in got) == sorted((none_first(i), *quality_counts(t)) for i, t in every)
    assert not any(r.kept and r.base_failed for r in got)


def plain_em(patterns, rules, rounds):
    prior, good, bad = quality.START_GOOD, [list(quality.ON_GOOD)] * rules, [list(quality.ON_BAD)] * rules
    for _ in range(rounds):
        post = {}
        for v in patterns:
            p = prior * math.prod(good[x][v[x] + 1] for x in range(rules))
            q = (1 - prior) * math.prod(bad[x][v[x] + 1] for x in range(rules))
            post[v] = p / (p + q)
        total = sum(patterns.values())
        mass = sum(n * post[v] for v, n in patterns.items())
        rate = lambda x, k, w, m, s: (sum(n * w(v) for v, n in patterns.items() if v[x] == k - 1) + quality.PSEUDO * s[k]) / (m + quality.PSEUDO)
        good = [[rate(x, k, lambda v: post[v], mass, quality.ON_GOOD) for k in range(3)] for x in range(rules)]
        bad = [[rate(x, k, lambda v: 1 - post[v], total - mass, quality.ON_BAD) for k in range(3)] for x in range(rules)]
        prior = (mass + 1) / (total + 2)
    return prior, good, bad


def test_quality_model_equals_plain_em(spark):
    rng = random.Random(6)
    names = ["a", "b", "c", "d", "e"]
    truth = {True: [(0.05, 0.15, 0.8), (0.3, 0.1, 0.6), (0.1, 0.5, 0.4), (0.02, 0.08, 0.9), (0.3, 0.4, 0.3)], False: [(0.8, 0.1, 0.1), (0.5, 0.3, 0.2), (0.5, 0.3, 0.2), (0.6, 0.2, 0.2), (0.3, 0.4, 0.3)]}
    kinds = [rng.random() < 0.8 for _ in range(4000)]
    votes = [tuple(rng.choices((-1, 0, 1), p)[0] for p in truth[k]) for k in kinds]
    counts = collections.Counter(votes)
    table = spark.createDataFrame([(*v, n) for v, n in counts.items()], ", ".join(f"vote_{x} int" for x in names) + ", n long")
    model = quality.fit(table, names, rounds=12)
    prior, good, bad = plain_em(counts, len(names), 12)
    assert abs(model.prior - prior) < 1e-6
    assert np.allclose(model.good, good, atol=1e-6) and np.allclose(model.bad, bad, atol=1e-6)
    settled = quality.fit(table, names)
    assert abs(settled.prior - 0.8) < 0.05 and settled.bad[0][0] > 0.6 and settled.good[3][2] > 0.8  # the rates come from the votes
    post = {tuple(r[:5]): r[5] for r in table.select(*(f"vote_{x}" for x in names), settled.posterior().alias("p")).collect()}
    right = sum((post[v] >= 0.5) == k for v, k in zip(votes, kinds, strict=True)) / len(votes)
    assert right > 0.93
    one_bad = [p for v, p in post.items() if v.count(-1) == 1]
    assert min(one_bad) < 0.5 < max(one_bad)  # neither all must pass nor a majority


def test_quality_verdicts(spark):
    rng = random.Random(1)
    words = "stone river light under morning quiet garden window paper letter bright travel".split()
    sentences = lambda i, end=".": [" ".join(rng.choice(words) + rng.choice(["", "s", "er"]) + str(i % 3 or "") for _ in range(20)) + end for _ in range(5)]
    good = [(i, "\n".join(sentences(i))) for i in range(60)] + [(70 + i, "\n".join(sentences(i, ""))) for i in range(3)]  # no full stops: one bad vote
    bad = [(100 + i, " ".join(f"{rng.choice(words)}{rng.choice(words)}{rng.choice(words)}###" for _ in range(80))) for i in range(10)] + [(200 + i, "BUY NOW!! " * 60) for i in range(10)]
    judged = quality.judge(spark.createDataFrame(good + bad + [(300, None), (301, "")], SCHEMA))
    out = {r.doc_id: r for r in judged.collect()}
    assert sum(out[i].kept for i, _ in good) >= 60
    assert all(out[70 + i].kept and out[70 + i].vote_sentences_end == -1 for i in range(3))
    assert not any(out[i].kept for i, _ in bad)
    assert out[300].n_words == 0 and not out[300].kept
    shares = {r.n_bad: r.kept_share for r in quality.votes_against_verdicts(judged).collect()}
    assert shares[0] > 0.9 and 0 < shares[1] <= 1 and min(shares.values()) == 0


def test_quality_counts_no_repeats_in_long_texts_of_different_words(spark):
    n = (1 << 20) + 10
    words = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("w"))
    text = lambda w: F.array_join(w, " ")
    docs = words.select(F.lit(1).alias("doc_id"), text(F.col("w")).alias("text")).unionAll(words.select(F.lit(2), text(F.concat(F.col("w"), F.slice("w", 5, 4)))))
    out = {r.doc_id: (r._q_n_words, r._q_n_repeat_words) for r in quality.with_measures(docs).select("doc_id", "_q_n_words", "_q_n_repeat_words").collect()}
    assert out == {1: (n, 0), 2: (n + 4, 8)}


def test_quality_runs_no_python(spark, docs):
    plan = quality.with_measures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_duplicates(empty).count() == 0
    assert fmindex.dedup_substrings(empty).count() == suffixes.dedup_bytes(empty).count() == 0
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == 0
    assert sharding.assign(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b c", "x", 5, "h")], "doc_id long, text string, hits string, n_words int, kept_text string").withColumn("label", F.lit("q"))
    assert decontaminate.find_hits(clash, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).first().n_hit == 3
    for limit in (linededup.BROADCAST_KEYS, 0):
        odd = clash.withColumns({"_line": F.lit(1), "_row": F.lit(2), "_h": F.lit(3), "_k": F.lit(4), "h": F.lit(5)})
        assert linededup.drop_lines(odd, linededup.frequent_keys(odd, 1), limit).first().kept_text == ""
        assert linededup.drop_lines(empty, linededup.frequent_keys(empty, 1), limit).count() == 0
    two = spark.createDataFrame([(1, "a b c"), (2, "c x " * 9), (3, "zz")], "item_id long, text string")
    blocky = decontaminate.find_hits(clash.withColumns({"_text_hash": F.lit(1), "_block_hits": F.lit(2)}), two, block_bytes=3).first()
    assert (blocky.n_hit, blocky["items"], blocky._text_hash) == (3, ["1"], 1)
    assert decontaminate.find_hits(empty, two).count() == decontaminate.find_hits(empty, two, block_bytes=3).count() == 0
    assert lm.score(empty.withColumn("held_out", F.lit(True)), lm.train(empty)).count() == 0
    path = P.path("word_bpe_49k.json")
    assert tokenfiles.read_tokens(empty, tokenfiles.write_tokens(empty, path)).count() == 0
    tokens = tokenfiles.read_tokens(clash, tokenfiles.write_tokens(clash, path)).first()
    assert (tokens.doc_id, tokens.start, tokens.n_tokens) == (1, 0, 4)
    ranks = P.path("byte_bpe_50k.tiktoken")
    assert bpe.encode(empty, ranks, P.PATTERN).count() == 0
    coded = bpe.encode(clash.withColumn("ids", F.lit("x")), ranks, P.PATTERN).first()
    assert (coded.n_tokens, bytes(coded.decoded), coded.hits) == (3, b"a b c", "x")
    assert fmindex.dedup_substrings(clash.withColumn("gone", F.lit(1))).first().n_words == 3
    assert suffixes.dedup_bytes(clash.withColumn("want", F.lit(1))).first().n_bytes == 5
    assert sharding.assign(clash.withColumn("slot", F.lit(9))).first().slot == 0
    assert quality.keep_good(clash).columns == clash.columns
    assert jaccard.keep_one(clash).columns == clash.columns


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    words = "stone river light under morning quiet garden window paper letter bright travel".split()
    sentence = lambda: " ".join(rng.choice(words) + rng.choice("aeioubcdl") + rng.choice("aeionst") for _ in range(14)).capitalize() + "."
    texts = ["\n".join(["Shared line in every text.", *(sentence() for _ in range(8))]) for _ in range(12)]
    leak = texts[2].split("\n")[3]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(50, texts[4], "en", "s", 1), (51, "spam### " * 90, "en", "s", 1), (52, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(12)]
    kept = texts[5].split("\n", 1)[1]
    assert got[5].decoded_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert got[2].decoded_sha256 != hashlib.sha256(texts[2].split("\n", 1)[1].encode()).hexdigest()


def test_a_lean_codec_codes_alike_and_holds_less(spark, docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    codec = bpe.Codec(ranks, bpe.merge_table(ranks), P.PATTERN, lean=True)
    assert codec.chunks.most_bytes + codec.pieces.most_bytes <= 28 << 20 and codec.query_rows <= 400_000
    rows = [sorted(map(str, bpe.encode(docs, path, P.PATTERN, keep_text=False, lean=x).collect())) for x in (False, True)]
    assert rows[0] == rows[1]
    odd = ["ab" * 500, "z" * 1000 + " q" * 400, "é" * 500]
    import pyarrow as pa

    ids, offs = codec.encode(pa.array(odd))
    raw, at = codec.decode(ids, offs)
    assert [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == odd
