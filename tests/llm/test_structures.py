"""The prefix trie, the clustering and the SimHash join against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.llm import centroids, prefix_trie, scan, simhash
from ordertide.llm.common import looked_up
from ordertide.session import written
from tests.conftest import SF


def _digest(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def _sequences(rows):
    """conv to its turns (role, text) in order."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, _digest(role, text), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t, key=lambda x: x[:3])] for c, t in by.items()}


def _trie(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: [r for r in nodes if len(r) == len(q) + 1 and r[: len(q)] == q]
        ends = sorted(c for c in members if len(seqs[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids(p)), sum(not kids(q) for q in under),
            sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out)


CONV = "conv_id bigint, turn bigint, role string, text string, depth string"


def test_prefix_trie_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(("user", "tool", None)), rng.choice(("a", "b", "", None, "üx")), "clash") for c in range(60) for t in range(rng.randrange(9))]
    rows += rows[:7]  # repeated rows, and so ties
    rows += [(7, None, "user", "first", ""), (8, None, None, None, ""), (None, 1, "user", "nobody's", ""), (70, 3, "user", "x" * 200_000, "")]
    rows += [(c, t, "user", "same", "") for c in range(80, 120) for t in range(4)]  # copies
    rows += [(130, t, "user", "same", "") for t in range(300)]  # a long one that shares its start with them
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(5)).collect()
    assert sorted(map(tuple, got)) == _trie(_sequences([r[:4] for r in rows]))
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, None, None, None, None)], CONV)).count() == 0


def test_rebuilt_conversations_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(("user", "assistant")), rng.choice("ab"), "") for c in (*range(100, 125), 205, 207, 300, 301, 302, 305, 399) for t in range(rng.randrange(1, 8))]
    rows = [r for r in rows if r[0] != 300 or r[1] < 2]  # a giver with few turns
    seqs = _sequences([r[:4] for r in rows])
    new = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = seqs.get(c - c % 100, [])[:h] + own[h:]
    got = prefix_trie.op11(spark.createDataFrame(rows, CONV)).collect()
    assert sorted(map(tuple, got)) == _trie(new)
    assert any(not s for s in new.values())  # turnless ones are members of the root


def test_running_sums_cross_runs(spark):
    rows = [(g, i, 1) for g in range(3) for i in range(400 if g == 1 else 5)]
    lying = written(spark.createDataFrame(rows, "g int, i int, v int").repartitionByRange(7, "g", "i").withColumn("_run", F.spark_partition_id()), "t")
    assert lying.select("_run").distinct().count() > 3
    got = scan.running(lying, "g", ["i"], {"s": F.col("v")}).collect()
    assert len(got) == len(rows) and all(r.s == r.i + 1 for r in got)


def test_looked_up_joins_frequent_keys_apart(spark):
    left = written(spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(100)], "k int, v int"), "t")
    right = spark.createDataFrame([(k, 30 if k < 3 else 1) for k in range(95)], "k int, n int")
    got = sorted(map(tuple, looked_up(left, right, ["k"], F.col("n") > 5).select("k", "v", "n").collect()))
    assert got == sorted(map(tuple, left.join(right, "k", "left").select("k", "v", "n").collect())) and len(got) == 100


def _lloyd(rows, dims, k=8, rounds=10):
    kept = [(i, np.floor(np.array(e, np.float32).astype(np.float64) * 1024).astype(np.int64)) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    c = [x for _, x in sorted(kept, key=lambda r: (*name(r[0]), r[1].tolist()))[:k]]
    near = lambda x: min((int(((x - y) ** 2).sum()), j) for j, y in enumerate(c))[::-1]
    for _ in range(rounds):
        of = [near(x)[0] for _, x in kept]
        c = [np.array([int(sum(int(x[d]) for (_, x), o in zip(kept, of, strict=True) if o == j)) // of.count(j) for d in range(dims)]) if j in of else c[j] for j in range(len(c))]
    last = [(i, *near(x)) for i, x in kept]
    inertia = {j: sum(d for _, o, d in last if o == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, y.tolist())).encode()).hexdigest() for y in c]
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), sha[o]) for i, o, d in last), key=str)


@pytest.mark.parametrize("case", ["ties", "spread", "few", "none", "odd"])
def test_clusters_against_lloyd(spark, case):
    rng = np.random.default_rng(4)
    dims = 4
    if case == "ties":  # a coarse grid: many equal distances, repeated vectors and ids
        rows = [(int(i // 2), (rng.integers(0, 3, dims) / 4).tolist()) for i in range(150)]
    elif case == "spread":
        rows = [(i, (rng.normal(0, 1, dims) + 30 * (i % 5)).tolist()) for i in range(200)]
    elif case == "few":
        rows = [(1, [0.5] * dims), (2, [-0.3] * dims), (3, [0.5] * dims)]
    elif case == "none":
        rows = [(1, None), (2, [])]
    else:
        rows = [(i, rng.normal(0, 1, dims).tolist()) for i in range(40)]
        rows += [(90, None), (91, [1.0] * (dims + 1)), (92, [float("nan")] * dims), (93, [float("inf")] + [0.0] * (dims - 1)), (94, [None] + [0.0] * (dims - 1)), (None, [0.1] * dims)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cluster", F.lit("clash")).repartition(3)
    progress = []
    got = centroids.cluster(centroids.vectors(df, dims), dims=dims, progress=progress)
    want = _lloyd(rows, dims)
    assert sorted(map(tuple, got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str) == want
    if case == "spread":  # bounds spare distances
        assert progress[-1] < 0.8 * len(rows) * 8


def test_a_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(centroids.vectors(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id bigint, embedding array<float>"), 2), dims=2).collect()


def test_bounds_never_rule_out_the_nearest():
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (400, 3)) * rng.choice([1, 10**6], (400, 1))
    n, k = len(x), 6
    own, upper, lower, moved = np.full(n, -1), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32), np.zeros(k)
    c = x[:k].copy()
    for _ in range(8):
        own, upper, lower, _ = centroids.assign(x, own, upper, lower, c, moved)
        d2 = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert own.tolist() == [min(range(k), key=lambda j: (row[j], j)) for row in d2]
        assert all(float(upper[i]) ** 2 >= float(d2[i][own[i]]) * (1 - 1e-12) for i in range(n))
        assert all(float(lower[i, j]) ** 2 <= float(d2[i][j]) * (1 + 1e-12) for i in range(n) for j in range(k))
        after = c + rng.integers(-2, 3, c.shape)
        moved, c = centroids._root_above(centroids.squared(c, after)), after


def _plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(ids, fps, most=2):
    of = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    return {i: min((x for x, p in zip(ids, of, strict=True) if p == o), default=None) for i, o in zip(ids, of, strict=True)}


def test_fingerprints(spark):
    for t in (None, "", " \t", "One", "one two", "One two THREE four\nfive ÄÖ \x00 ", "a b c " * 40_000, "\x1f x \x85 y z"):
        assert simhash.fingerprint(t) % 2**64 == _plain(t), t
        assert simhash.fingerprint(t, chunk=7) == simhash.fingerprint(t)
    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("One  two three") == got  # the engine's own hash, of one shingle


@pytest.mark.parametrize("page", [4, 4096])
def test_simhash_groups_against_brute_force(spark, page):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(100_000, None), (100_001, ""), (100_002, "\n"), (100_003, "one"), (100_004, "One"), (100_004, "One"), (100_005, "w " * 100_000)]
    near = [(200_000 + i, " ".join(f"w{j}" if (j * 7 + i) % 400 else "zz" for j in range(300))) for i in range(40)]  # one word in some hundred differs
    rows = [tuple(r) for r in docs.collect()] + odd + near
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit(1)).repartition(4)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(df, page=page).collect()}
    fps = [_plain(t) for _, t in rows]
    want = _groups([i for i, _ in rows], fps)
    assert got == {(i, f"{f:016x}"): want[i] for (i, _), f in zip(rows, fps, strict=True)}
    assert len({want[i] for i, _ in near}) < len(near)


def test_trie_finds_dense_groups(spark):
    """Thousands of fingerprints within a few bits of each other, which no prefix divides evenly, beside spread ones."""
    rng = random.Random(3)
    dense = {sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) ^ 0x5555 for _ in range(1500)}
    fps = sorted(dense | {rng.getrandbits(64) for _ in range(500)})
    arr = np.array(fps, np.uint64)
    df = written(spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp bigint"), "t")
    pages = simhash.page_pairs(df, 2, 64)
    assert pages.groupBy("level", "a").count().count() > 20
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, 2, page=64).collect()]
    label = simhash.forest(len(fps), iter([tuple(np.searchsorted(arr, np.array(x, np.uint64)) for x in zip(*found, strict=True))]))
    want = simhash.forest(len(fps), ((np.full(len(j := np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 2) + i + 1), i), j) for i in range(len(fps))))
    assert label.tolist() == want.tolist() and len(set(want.tolist())) < len(fps) - 500


def test_traverse_lists_each_pair_once():
    rng = random.Random(8)
    a = np.array(sorted({rng.getrandbits(10) for _ in range(400)}), np.uint64)
    pairs = [(int(i), int(j)) for x, y in simhash.traverse(a, a, 0, 2, True) for i, j in zip(x, y, strict=True)]
    want = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= 2]
    assert sorted(pairs) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert simhash.simhash_groups(empty).count() == 0
    got = simhash.simhash_groups(spark.createDataFrame([(None, "a b"), (None, "A b"), (3, "a b"), (None, "else")], "doc_id bigint, text string")).collect()
    assert sorted((r.component_id for r in got), key=str) == [3, 3, 3, None]


def test_mixture_of_very_many_sources():
    from ordertide.llm import packing

    rng = random.Random(4)
    totals = [rng.randrange(1, 10**7) for _ in range(50_000)]
    began = __import__("time").monotonic()
    mix = packing.Mixture(totals, [max(1, round(x**0.5 * 1000)) for x in totals])
    assert __import__("time").monotonic() - began < 10
    for w in (0, 1, mix.windows // 2, mix.windows - 1, mix.windows):
        given, g = mix.given(w), min(w * mix.window, mix.all)
        assert g - len(totals) <= sum(given) <= g and all(0 <= c <= n for c, n in zip(given, totals, strict=True))
        assert [mix._of(w, q) for q in range(0, 50_000, 997)] == given[::997]
    w, place, left = mix.place(7, totals[7] - 1)
    assert left == 1 and mix.given(w)[7] < totals[7] == mix.given(w + 1)[7] and 0 <= place < mix.all


def test_fuzzy_lines_with_a_common_passage(spark):
    """Pairs of lines that begin with the same words, each copy with letters of its own part changed up to the limit: hubs alone miss many, the exact way none that share a block."""
    from ordertide.llm.lines import FuzzyLines, removed_lines

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    head, rows = " ".join(word() for _ in range(12)), []
    for i in range(120):
        own = list(" ".join(word() for _ in range(20)))
        rows.append((2 * i, f"{head} {''.join(own)}"))
        at = [j for j, c in enumerate(own) if c != " "]
        for j in rng.sample(at, (len(head) + 1 + len(own)) // 20):
            own[j] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        rows.append((2 * i + 1, f"{head} {''.join(own)}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = {r.doc_id for r in removed_lines(docs, FuzzyLines(linear=False)).collect()}
    assert all(i % 2 for i in gone) and len(gone) >= 0.97 * 120
    assert {r.doc_id for r in removed_lines(docs).collect()} <= gone


def test_no_link_is_left_out_by_default(spark):
    """op8, without parameters, compares all lines of a bucket: letters are changed all over the own part of each copy, and 240 lines share a passage."""
    from ordertide.llm.lines import op8

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    head, rows = " ".join(word() for _ in range(12)), []
    for i in range(120):
        own = list(" ".join(word() for _ in range(20)))
        rows.append((2 * i, f"{head} {''.join(own)}"))
        for j in rng.sample([j for j, c in enumerate(own) if c != " "], (len(head) + 1 + len(own)) // 20):
            own[j] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        rows.append((2 * i + 1, f"{head} {''.join(own)}"))
    gone = {r.doc_id for r in op8(spark.createDataFrame(rows, "doc_id bigint, text string")).where("n_removed > 0").collect()}
    assert all(i % 2 for i in gone) and len(gone) >= 0.97 * 120
