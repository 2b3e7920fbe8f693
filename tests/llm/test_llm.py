"""Each operator against brute force, an exact round trip or SQL, and on nulls, empty and long texts, repeats, and clashing columns."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ordertide.llm import chat, decontam, html_text, lines, lm, minhash, packing, quality, queries, sharding, suffix
from ordertide.llm.common import components, extended

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return [r.text for r in rows][:60]


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Nulls everywhere, empty, blank and long texts, copies, repeated rows, and columns whose names clash with the operators' own."""
    all_texts = [*texts[:25], None, "", " \n\t ", "one", "two words", texts[0], texts[1] + " tail", "long " * 30_000, "x" * 70_000]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "k", 1, True) for i, t in enumerate(all_texts)]
    rows += [(None, texts[2], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, DOC + ", text_key string, shard int, kept boolean").repartition(3)


OPS = {
    "op1": minhash.op1, "op3": packing.op3, "op4": lm.op4, "op5": suffix.op5, "op6": quality.op6,
    "op7": lambda d: decontam.op7(d, d.sparkSession.createDataFrame([(7, "two words"), (8, None)], "item_id bigint, text string")), "op8": lines.op8, "op9": sharding.op9,
}


@pytest.fixture(scope="module")
def of_odd(odd):
    """Rows of each operator by doc_id."""
    out = {}
    for name, op in OPS.items():
        out[name] = defaultdict(list)
        for r in op(odd).collect():
            out[name][r.doc_id].append(r)
    return out


def test_odd_rows_and_empty_tables(spark, odd, of_odd):
    n = odd.count()
    for name, op in OPS.items():
        assert sum(map(len, of_odd[name].values())) == n or name == "op3", name
        assert op(odd.limit(0)).count() == 0, name
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.op7(odd, bench.limit(0)).where("contaminated").count() == 0


def test_values_of_odd_rows(odd, of_odd):
    """What null, blank, long and repeated rows get, by each operator."""
    rows = odd.collect()
    blank = [r.doc_id for r in rows if not (r.text or "").split() and r.doc_id is not None]
    long = next(r.doc_id for r in rows if r.text == "x" * 70_000)

    got = of_odd["op1"]
    assert all(r.n_shingles == 0 and r.kept and r.component_id == i for i in blank for r in got[i]) and got[long][0].n_shingles == 1
    assert [r.kept for r in got[25]] == [True] and not got[30][0].kept and got[30][0].component_id == 0 and len(got[3]) == 3 and all(r.kept for r in got[3])
    got = of_odd["op5"]
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_bytes, r.n_removed, r.n_spans) == (len((r0.text or "").encode()), 0, 0) for r0 in rows if r0.doc_id in blank for r in got[r0.doc_id] if not r.n_bytes)
    assert (got[long][0].n_removed, got[long][0].kept_sha256) == (70_000, empty) and all(r.n_removed == r.n_bytes for r in got[3] if r.n_bytes >= 400)
    got = of_odd["op6"]
    assert all(r.n_words == 0 and r.base_failed and not r.kept for i in blank for r in got[i]) and got[32][0].n_repeat_words == 30_000 and len(set(got[3])) == 1
    got = of_odd["op8"]
    counts = {r.doc_id: 0 if r.text is None else r.text.count("\n") + 1 for r in rows if r.doc_id is not None}
    assert all(r.n_lines == counts[i] for i in counts for r in got[i]) and all(r.n_removed == 0 for i in blank for r in got[i])
    got = of_odd["op9"]
    assert all(r.size == len((r0.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r0.text or "").encode()) for r0 in rows if r0.doc_id not in (None, 3) for r in got[r0.doc_id])
    assert len({r.shard for r in got[3]}) == 1 and len({r.slot for r in got[3]}) == 3
    got = of_odd["op4"]
    assert all(r.n_tokens == 1 for i in blank for r in got[i]) and len({round(r.score, 6) for r in got[3]}) == 1 and got[32][0].n_tokens == 30_001
    got = of_odd["op7"]
    assert all(r.n_words == 0 and not r.contaminated for i in (25, 26) for r in got[i]) and (got[29][0].n_hit, got[29][0].n_items) == (2, 1)
    files = packing.public_files()
    kept = packing.Tokens(files["tokenizer"])
    totals = {r.doc_id: r.doc_tokens for rs in of_odd["op3"].values() for r in rs if r.doc_id not in (None, 3)}
    assert all(totals[r.doc_id] == len(kept(r.text)) + 1 for r in rows if r.doc_id in totals)


def test_near_dedup_keeps_one_of_repeated_rows(spark, texts):
    rows = [(1, texts[0], "a"), (1, texts[0], "b"), (2, texts[0], "c"), (None, texts[1], "d"), (None, texts[1], "e"), (None, texts[1] + " x", "f"), (3, None, "g"), (3, None, "h"), (4, " ", "i")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, text_key string")
    got = sorted((r.doc_id or 0, r.text_key) for r in minhash.dedup(df).collect())
    assert len(got) == 5 and [x for x in got if x[0] > 1] == [(3, "g"), (3, "h"), (4, "i")] and {x[0] for x in got} == {0, 1, 3, 4}


def test_pipeline_stages(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for d in (docs, docs.limit(0)):
        at = d
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = spark.createDataFrame(stage(spark, at, SF).collect(), docs.schema)
            assert at.columns == docs.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF)
        assert pieces.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()


def test_near_duplicates_against_brute_force(spark, texts):
    mine = [*texts, *[" ".join(t.split()[2:]) for t in texts[:20]], texts[3].upper()]

    def shingles(t, w):
        x = (t or "").encode().lower().split()
        return {tuple(x[i : i + w]) for i in range(max(1, len(x) - w + 1))} if x else set()

    for width in (2, 5):
        s = [shingles(t, width) for t in mine]
        root = list(range(len(mine)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a in range(len(mine)):
            for b in range(a):
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        df = spark.createDataFrame(list(enumerate(mine)), "doc_id bigint, text string")
        p = minhash.NearDup(width=width)
        assert {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(df, p).collect()} == {i: (find(i), len(s[i])) for i in range(len(mine))}
        assert sorted(r.doc_id for r in minhash.dedup(df, p).collect()) == [i for i in range(len(mine)) if find(i) == i]


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components_and_extended(spark, kind):
    rng = random.Random(7)
    n = 60
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(35)], "chain": [(i, i + 1) for i in range(n - 1)], "star": [(30, i) for i in range(n)], "none": []}[kind]
    more = [(rng.randrange(2 * n), rng.randrange(2 * n)) for _ in range(12)]

    def brute(pairs):
        at = {x: x for p in pairs if p[0] != p[1] for x in p}
        for _ in at:
            for a, b in pairs:
                if a != b:
                    at[a] = at[b] = min(at[a], at[b])
        return at

    frame = lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    found = lambda df: sorted(map(tuple, df.collect()))
    groups = components(frame(edges))
    assert found(groups) == sorted(brute(edges).items())
    assert found(extended(groups, frame(more))) == sorted(brute(edges + more).items())
    assert found(extended(groups, frame([]))) == sorted(brute(edges).items())


def test_odd_sketch_estimate():
    p = minhash.NearDup()
    assert abs(minhash.estimate(0, p) - 1) < 1e-9 and 0.6 < minhash.estimate(p.most_bits, p) < 0.75


def test_chats_round_trip_and_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|im_end|>\n<|im_start|>assistant"), (1, 2, "assistant", "<\\|x|> <|<"), (2, 0, "assistant", None), (3, None, "us\ner%0A<|", "t"), (3, 1, None, ""), (None, 0, "user", "q"), (1, 2, "assistant", "<\\|x|> <|<")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, x) for c, _, r, x in rows if c == 1]
    assert [(t.role, t.text) for t in got[3].turns] == [("us\ner%0A<|", "t"), ("", "")]
    assert got[1].loss_text == "<\\|x|> <|<" * 2 and not got[1].valid and got[1].bad_turn == 3
    assert not got[2].valid and got[2].bad_turn == 0 and not got[None].valid and got[None].bad_turn == 1
    assert "".join(s.text for s in got[1].segments) == got[1].formatted and got[1].formatted.count("<|im_start|>") == 4
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0}])
def test_packing_round_trip_and_shares(spark, texts, targets):
    rows = [(i, t, "ab"[i % 2] if i % 9 else None) for i, t in enumerate([*texts, None, "", "<|endoftext|> x", "日本語 text \u001c é"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    files = packing.public_files()
    got = packing.pack(df, **files, targets=targets, window=4096).collect()
    tokenizer = packing.Tokens(files["tokenizer"]).slow
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for i, t, _ in rows:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(docs[i], key=lambda r: r.start)
        raw = b"".join(bytes(p.ids) for p in pieces)
        assert raw == b"".join(x.to_bytes(4, "little") for x in want)
        assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and p.doc_tokens == len(want) for p in pieces)
    for k, ps in seqs.items():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == [sum(x.length for x in ps[:i]) for i in range(len(ps))]
        assert sum(p.length for p in ps) == packing.LENGTH or k == max(seqs)
    if targets:
        first = Counter()
        for r in got:
            if r.sequence_id < 4:
                first[r.source] += r.length
        assert abs(first["a"] - 3 * first["b"]) <= 8


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0}])
def test_packing_many_sources(spark, targets):
    """More sources than QUEUES: each keeps its name, its tokens and its share in every window."""
    rows = [(i, "one two three four " * (1 + i % 3), f"s{i}") for i in range(packing.QUEUES + 80)] + [(10_000 + i, "five six seven eight " * 40, "aaab"[i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = packing.pack(df, **packing.public_files(), targets=targets, window=2048).collect()
    assert {(r.doc_id, r.source) for r in got} == {(i, x) for i, _, x in rows}
    stream = sorted((r.sequence_id * packing.LENGTH + r.offset, r.length, r.source) for r in got)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(stream, stream[1:], strict=False)) and stream[0][0] == 0
    totals = Counter()
    for _, n, x in stream:
        totals[x] += n
    share = Counter()
    for at, n, x in stream:
        share[x] += max(0, min(n, 4096 - at))
    if targets:
        assert abs(share["a"] - 3072) <= 8 and abs(share["b"] - 1024) <= 8 and set(share) - {x for x in share if not share[x]} == {"a", "b"}
    else:
        assert abs(share["a"] - 4096 * totals["a"] / sum(totals.values())) < 1200


@pytest.mark.parametrize(("totals", "targets"), [([500, 70, 0, 331], None), ([500, 70, 0, 331], [1, 1, 1, 2]), ([40, 900, 77], [3, 1, 7]), ([10, 10, 1000], [1, 0, 1])])
def test_mixture_is_deficit_round_robin(totals, targets):
    """Literally: in each window every queue's deficit grows by its share, whole tokens of it are given, and the rest is carried."""
    from fractions import Fraction

    window, mix = 32, packing.Mixture(totals, targets, 32)
    weight = targets or totals
    left, deficit, given = [Fraction(x) for x in totals], [Fraction(0)] * len(totals), [0] * len(totals)
    for w in range(mix.windows):
        assert mix.given(w) == given
        budget = Fraction(window)
        while budget and any(left):
            live = [weight[s] if left[s] else 0 for s in range(len(left))]
            if not any(live):
                live = [1 if x else 0 for x in left]
            span = min([budget, *(left[s] * sum(live) / x for s, x in enumerate(live) if x)])
            for s, x in enumerate(live):
                deficit[s] += span * x / sum(live)
                left[s] -= span * x / sum(live)
            budget -= span
        for s in range(len(totals)):
            n = int(deficit[s])
            given[s] += n
            deficit[s] -= n
    assert mix.given(mix.windows) == totals


def test_op3_deals_small_sources_sooner(spark):
    rows = [(i, f"word{i} " * 40, "big") for i in range(900)] + [(1000 + i, f"term{i} " * 40, "small") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.op3(df).collect()
    totals = Counter()
    for r in got:
        totals[r.source] += r.length
    first = Counter()
    for r in got:
        if r.sequence_id < 10:
            first[r.source] += r.length
    share = totals["small"] ** 0.5 / (totals["small"] ** 0.5 + totals["big"] ** 0.5)
    end = min(10 * packing.LENGTH * share, totals["small"])
    assert sum(first.values()) == 10 * packing.LENGTH and sum(totals.values()) > packing.MIX_WINDOW
    window = Counter()
    for r in got:
        if r.sequence_id < 64:
            window[r.source] += r.length
    assert window["small"] == min(totals["small"], int(packing.MIX_WINDOW * share)) and end > 0


def test_mixture_of_many_queues_as_of_few(monkeypatch):
    """Counts of one queue and of all agree, and queues without target share alike until they run out."""
    totals, targets = [50, 7, 0, 31, 400, 12, 90], [0, 3, 1, 0, 1, 0, 0]
    few = packing.Mixture(totals, targets, 16)
    monkeypatch.setattr(packing, "QUEUES", 2)
    many = packing.Mixture(totals, targets, 16)
    spots = lambda m: [m.place(q, at) for q, n in enumerate(totals) for at in range(n)]
    assert spots(few) == spots(many) and sorted(x[1] for x in spots(few)) == list(range(sum(totals)))
    assert all(few.given(w)[q] == many._of(w, q) for w in range(few.windows + 1) for q in range(len(totals)))
    w = -(-(7 + 400) // 16) + 4
    level = next(x for x in range(500) if sum(min(n, x + 1) for n in (50, 31, 12, 90)) > w * 16 - 407)
    assert [few.given(w)[q] for q in (0, 3, 5, 6)] == [min(n, level) for n in (50, 31, 12, 90)]


def test_lattice_sums_all_segmentations():
    import numpy as np

    p = lm._pieces(packing.public_files()["ranks"])
    number = {int(h): i for i, h in enumerate(p.h)}

    def brute(w):
        def rest(at):
            if at == len(w):
                return math.exp(p.stop)
            go = 1 if at == 0 else 1 - math.exp(p.stop)
            return sum(go * math.exp(p.logp[int(at > 0), number[h]]) * rest(e) for e in range(at + 1, len(w) + 1) if (h := p._hash(w[at:e])) in number)

        return math.log(rest(0))

    for w in (b"a", b"the", b"tisherou", "é9x".encode()):
        got = lm.forward(np.frombuffer(w, np.uint8)[None], p, p.logp, p.stop)[0]
        assert abs(got - brute(w)) < 1e-9
    assert abs(np.exp(p.logp).sum(1) - 1).max() < 1e-9


def test_lm_scores(spark, texts):
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.op4(df).collect()}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate([*texts, None])}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6
        assert r.score < 0
    # both models, from their definitions: counts with the lattice as their prior, and the lattice alone
    ranks = packing.public_files()["ranks"]
    types = spark.createDataFrame([(bytearray(w),) for w in c if w is not None], "word binary")
    logp, stop = lm._fit(types, ranks, 2)
    p = lm._pieces(ranks)

    def new(w):
        return -math.log(v + 1) if w is None else lm.forward(__import__("numpy").frombuffer(w, "u1")[None], p, logp, stop)[0] + math.log1p(-1 / (v + 1))

    for i in (0, 7, len(texts)):
        want = sum(math.log10((c[w] + v * math.exp(new(w))) / (n + v)) for w in words[i])
        assert abs(got[i].score - want) < 1e-6 * max(1, abs(want)) and abs(got[i].lattice_score - sum(map(new, words[i])) / math.log(10)) < 1e-6 * max(1, abs(want))
    held = [r for r in got.values() if r.held_out]
    # better than spelling every word in bytes
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -8


def test_deep_shallow_and_repeats_against_brute_force(spark, texts):
    strings = [b"ab" * 40, b"ab" * 40, b"ab" * 39 + b"ac", b"", b"a", b"ab" * 20, b"b" * 100, b"b" * 50, *(t.encode()[:90] for t in texts)]
    order, lcp = suffix.deep_shallow(strings, 16)
    assert [strings[i] for i in order] == sorted(strings)
    assert lcp[1:] == [len(os.path.commonprefix([strings[a], strings[b]])) for a, b in zip(order, order[1:], strict=False)]
    p = texts[3][:900]
    mine = [*texts[:20], texts[0], None, "", "a" * 3000, "b" * 450 + "c", "b" * 450 + "d", p + "XX", "Z" + p[100:], p[:399], p[:400], *[texts[i][:30] + p[200 : 580 + i * 9] + texts[i][50:90] for i in range(25)]]
    data = [(t or "").encode() for t in mine]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    want = {}
    for k, d in enumerate(data):
        hit = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                hit[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, h in zip(d, hit, strict=True) if not h)
        want[k] = (len(d), sum(hit), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(list(enumerate(mine)), "doc_id bigint, text string").repartition(3)
    for most, split in ((suffix.MOST, suffix.SPLIT), (6, 1)):  # the second splits groups, and places of equal surroundings
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, most=most, split=split).collect()} == want


def test_frequent_lines_and_depleted(spark):
    own = " ".join(f"w{j}" for j in range(40))
    rows = [(i, f"{own} {i}\nshared footer of the host\n" + ("tail\n" if i < 3 else ""), "h") for i in range(30)]
    rows += [(100 + i, "shared footer of the host\n" * 5 + f"x{i}", "h") for i in range(3)] + [(200, f"{own}\nshared footer of the host", "other")] + [(300 + i, f"{own} copy\nonly in copies", "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(got[i].kept and got[i].removed == [1] for i in range(30)) and not any(got[100 + i].kept for i in range(3))
    assert got[200].removed is None and all(got[300 + i].kept and got[300 + i].removed is None for i in range(40))
    texts = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert texts[5] == f"{own} 5\n" and texts[200].endswith("host") and 100 not in texts


def test_fuzzy_lines(spark):
    base = " ".join(f"word{j}" for j in range(60))
    near = base.replace("word7 ", "word7! ").upper()  # equal when normalised
    rows = [(1, f"alpha line\n{base}"), (2, near), (3, f"ALPHA  line.\nother words here\n\n\n---"), (4, None), (5, ""), (6, base), (6, base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_lines, tuple(r.removed)) for r in lines.op8(df).collect())
    assert got == [(1, 2, ()), (2, 1, (0,)), (3, 5, (0,)), (4, 0, ()), (5, 1, ()), (6, 1, (0,)), (6, 1, (0,))]
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}[3] == "other words here\n\n\n---"


def test_planes_cover_three_bits():
    """Whichever three bits differ, some mask has none of them."""
    from itertools import combinations

    masks = lines.FuzzyLines().masks()
    assert {m.bit_count() for m in masks} == {32} and len(masks) == 14
    assert all(any(not m & bits for m in masks) for c in combinations(range(64), 3) for bits in [sum(1 << b for b in c)])


@pytest.mark.parametrize("n", [1, 2, 254, 255, 256, 257, 3000])
def test_simhash_of_any_length(spark, n):
    rng = random.Random(n)
    h = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    df = spark.createDataFrame([(h,)], "h array<bigint>")
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)
    got = [df.select(c.alias("x")).first().x & (1 << 64) - 1 for c in [lines.simhash(F.col("h")), *[lines._majority(F.col("h"), w) for w in lines.LANES if n < 1 << w - 1]]]
    assert set(got) == {want}


def test_fuzzy_lines_within_simhash_bits(spark, texts):
    """With a SimHash distance, the planes of blocks find every pair within it: links are those of all pairs by both conditions."""
    p = lines.FuzzyLines(distance=3)
    mine = [x for x in _edited_lines(texts[:20], 3) if len(x) > 60][:90]
    df = spark.createDataFrame(list(enumerate(mine)), "doc_id bigint, text string")
    sims = []
    for t in mine:
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(t.split())]
        sims.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = _line_groups(dict(enumerate(mine)), also=lambda a, b: (sims[a] ^ sims[b]).bit_count() <= p.distance)
    got = {r.doc_id for r in lines.removed_lines(df, p).collect()}
    assert got == {i for i, r in root.items() if r != i} and got


def _line_groups(norm, similarity=0.9, also=lambda a, b: True):
    """Of each id, the least id reachable over pairs of edit similarity alone; nothing else is asked of a pair but ``also``."""
    root = {i: i for i in norm}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def edit(a, b, most):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            if min(row) > most:
                break
        return row[-1]

    ids = sorted(norm)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            most = math.floor(max(len(norm[a]), len(norm[b])) * (1 - similarity) + 1e-9)
            if abs(len(norm[a]) - len(norm[b])) <= most and also(a, b) and edit(norm[a], norm[b], most) <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in norm}


def _edited_lines(texts, seed, limit=False):
    """Lines of 2 to 60 words, then copies of each with one letter and with one word changed, or with as many edits as a similarity of 0.9 allows."""
    rng = random.Random(seed)
    full = [" ".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", x.lower())) for t in texts for x in (t or "").split("\n")]
    base = [" ".join(x.split()[: rng.choice((2, 3, 4, 6, 8, 10, 15, 25, 60))]) for x in dict.fromkeys(full) if x][:70]
    base += ["漢字仮名交文章" * 12, "word " * 20 + "end"]
    out = list(base)
    for x in base:
        for n in [(len(x) - len(x) // 10) // 10] if limit else [min(1, len(x) // 10)]:
            y = list(x)
            for at in rng.sample([i for i, c in enumerate(x) if c != " "], n):
                y[at] = rng.choice([rng.choice("qzjxkv"), y[at] + rng.choice("qzjxkv")])
            out.append("".join(y))
        words = x.split()
        words[rng.randrange(len(words))] = "".join(rng.choice("qzjxkv") for _ in range(5))
        if not limit:
            out.append(" ".join(words))
    return out


def test_fuzzy_lines_by_edit_similarity_alone(spark, texts):
    mine = _edited_lines(texts, 5)
    root = _line_groups(dict(enumerate(mine)))
    assert sum(i != r for i, r in root.items()) > 80
    df = spark.createDataFrame(list(enumerate(mine)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in lines.op8(df).collect()} == {i: int(r != i) for i, r in root.items()}


def test_fuzzy_lines_at_the_limit(spark, texts):
    """Letters changed all over, as many as the similarity allows: nine in ten copies are found, and no other line goes."""
    mine = _edited_lines([t.replace("e", "o") + "\n" + t for t in texts if t], 11, limit=True)
    root = _line_groups(dict(enumerate(mine)))
    df = spark.createDataFrame(list(enumerate(mine)), "doc_id bigint, text string")
    got, want = {r.doc_id for r in lines.op8(df).where("n_removed > 0").collect()}, {i for i, r in root.items() if r != i}
    assert got <= want and len(got) >= 0.9 * len(want) > 50


@pytest.mark.parametrize("similarity", [0.9, 0.8])
def test_line_bounds_are_exact(spark, texts, similarity):
    """The bounds that spare the edit distance never contradict it, and linked_lines is the edit similarity."""
    rng, p = random.Random(4), lines.FuzzyLines(similarity=similarity)
    rows = []
    for x in _edited_lines(texts[20:], 8)[:60]:
        for rate in (0, 0.05, 0.1, 0.15, 0.25, 0.4):
            y = list(x)
            for at in rng.sample(range(len(y)), int(len(y) * rate)):
                y[at] = rng.choice(["", "q", " ", y[at] + "z"])
            words = "".join(y).split()
            if rng.random() < 0.5 and len(words) > 2:
                del words[rng.randrange(len(words))]
            rows.append((x, " ".join(words) or "q"))
    full = F.levenshtein("x", "y")
    most = F.floor(F.greatest(F.char_length("x"), F.char_length("y")) * (1 - similarity) + 1e-9)
    sketch = lambda c: lines._sketch(F.col(c), p)
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", sketch("x").alias("sx"), sketch("y").alias("sy"), full.alias("d"), most.alias("most"))
    got = df.select("d", "most", lines.linked_lines(F.col("x"), F.col("y"), p).alias("is"), lines._near_letters(p, F.col("sx"), F.col("sy")).alias("near"), lines._pieces_found(F.col("x"), F.col("y"), p).alias("found"), lines._words_apart(F.col("x"), F.col("y")).alias("up")).collect()
    for r in got:
        assert r["is"] == (r.d <= r.most) and r.up >= r.d
        assert r.d > r.most or (r.near and r.found)
    assert 50 < sum(r["is"] for r in got) < len(got) - 50


@pytest.mark.parametrize("similarity", [0.9, 0.8])
def test_segments_miss_no_short_line(similarity):
    p, rng = lines.FuzzyLines(similarity=similarity), random.Random(2)
    plan = defaultdict(list)
    for n, tag, start, size in p.segments():
        plan[n].append((tag, start - 1, size))
    parts = lambda x: {(tag, x[at : at + size]) for tag, at, size in plan[len(x)]}
    for _ in range(4000):
        x = [rng.choice("abcd") for _ in range(rng.randrange(5, lines.SHORT))]
        y = list(x)
        for _ in range(p.most(len(x))):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        assert x == y or parts("".join(x)) & parts("".join(y))


def test_line_dedup_stage_by_edit_similarity_alone(spark, texts):
    """The pipeline's stage: of each group one line stays, and documents left empty go."""
    mine = _edited_lines(texts[20:], 9)
    root = _line_groups(dict(enumerate(mine)))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(mine)]
    got = dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, DOC), SF).collect()
    assert {r.doc_id: r.text for r in got} == {i: mine[i] for i, r in root.items() if i == r} and len(got) < len(mine) - 70


def test_decontaminate_spans(spark):
    item = " ".join(f"q{j}" for j in range(12))
    docs = [(1, f"Before it. {item.upper()}, after it and more words so that most of it stays clean here now"), (2, item), (3, "clean text"), (4, None), (5, "short one")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([("i", item), ("s", "Short, one"), ("n", None), ("e", "...")], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(df, bench).collect()}
    assert got == {1: "Before it. , after it and more words so that most of it stays clean here now", 3: "clean text", 4: None}
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench, mode="documents").collect()) == [3, 4]


def test_more_windows_than_are_broadcast(spark, texts):
    """The same hits, whichever way the windows meet the texts; items of several lengths."""
    words = [" ".join(t.split()[5 : 5 + n]) for t, n in zip(texts, (3, 30, 10, 7, 12, 1, 25), strict=False)]
    bench = spark.createDataFrame([(str(i), w) for i, w in enumerate([*words, "nothing like it", None])], "item_id string, text string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:30], texts[0], None, ""])], "doc_id bigint, text string")
    plain = lambda most: sorted((bytes(r.text_key), sorted(map(tuple, r.starts)), r["items"]) for r in decontam.find(df, bench, most_windows=most).collect())
    assert plain(10**6) == plain(0) and len(plain(0)) >= 7


def test_rendezvous_winners(spark):
    """Every score anew: -ln(u) / weight of the key's hash with each shard; the least wins."""
    weights = [1.0, 0.5, 0.0, 2.5]
    df = spark.range(400).select("id", sharding.rendezvous(F.col("id"), weights, 3).alias("shard"), *[F.xxhash64(F.col("id").cast("string"), F.lit(s), F.lit(3)).alias(f"h{s}") for s in range(4)])
    for r in df.collect():
        scores = [(-math.log((((r[f"h{s}"] & (1 << 64) - 1) >> 12) + 0.5) / (1 << 52)) / w, s) for s, w in enumerate(weights) if w]
        assert r.shard == min(scores)[1]


def test_shards(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    got = sharding.op9(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.size == len(f"t{r.doc_id}") + 1 and r.text_crc32 == zlib.crc32(f"t{r.doc_id}".encode())
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 8 and max(map(len, by.values())) < 2800
    n = Counter(r.shard for r in sharding.shard_rows(df, "doc_id", [1.0, 3.0, 0.0], order=["text"]).collect())
    assert set(n) == {0, 1} and 2.8 < n[1] / n[0] < 3.2
    assert sharding.moved(df, "doc_id", [1.0] * 4, [1.0, 1.0, 0.0, 1.0]).where("shard_before != 2").count() == 0


HTML = [
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"), ("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>z", "- x\n- y\n  3. 1\n  4. 2\n\nz"), ("a<br>b &amp; c&eacute;", "a\nb & cé"),
    ("<table><tr><th>A<th>Long<tr><td>wide cell<td>2</table>", "A          Long\nwide cell  2"), ("<div hidden>n</div><p style='Display : none'>n<p>y<script>x<p></script><!-- c --><noscript>n</noscript>", "y"),
    ("<pre>  k\n\n  j</pre>t", "  k\n\n  j\n\nt"), ("", ""), ("<", "<"), ("x<a href=\"q>y</a> z", "xy z"), ("</b>t</i>", "t"), ("<title>n</title><select><option>a<option>b</select>", "a\nb"),
    ("<div>" * 300 + "<div hidden>SECRET</div>x", "x"), ("<dialog open>d</dialog><dialog>e</dialog>", "d"), ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
    ("a<svg><title>t</title><text>drawn</text><g>g<text>two</text></g></svg>b", "a drawn two b"), ("<div style='visibility:hidden'>h<b style='visibility:visible'>seen</b></div>", "seen"),
    ("<p hidden style='display:block'>shown", "shown"), ("<xmp><b></xmp>", "<b>"), ("<plaintext><b>", "<b>"), ("<pre>\nx</pre>", "x"), ("a <b", "a"), ("1 < 2 </ 3> 4", "1 < 2 4"),
    ("<input value=v><input type=password value=p>", "v"), ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab     c\n1   2  3"), ("<a b='>' c=\"d>e", "e"), ("x<!-->y<!-- > -->z<!-- w", "xyz"),
    ("<details><summary>s</summary>in</details><details open>out</details>", "s\nout"), ("<ruby>a<rp>(</rp><rt>b</rt></ruby>", "ab"), ("<ul><li style='visibility:hidden'>n<li>y</ul>", "- y"),
]


@pytest.mark.parametrize(("page", "text"), HTML)
def test_html(page, text):
    assert html_text.render(page) == text


N = 200_000


_SPANS = [
    ("<td rowspan=2>tea<td>1<tr><td>2<tr><td>x<td>3", "tea  1\n     2\nx    3"), ("<td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g", "a  b  c\nd     e\nf     g"),
    ("<td rowspan=2 colspan=2>ab<td>c<tr><td>d<tr><td>1<td>2<td>3", "ab     c\n       d\n1   2  3"), ("<td rowspan=0>a<td>b<tr><td>c<tr><td>d", "a  b\n   c\n   d"),
    ("<tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d", "a  b\nc  d"), ("<td rowspan=2>a<td>b<tr hidden><td>x<tr><td>c<tr><td>d", "a  b\n   c\nd"),
    ("<td rowspan=2>a<td rowspan=3>b<td>c<tr><td>d<tr><td>e<td>f", "a  b  c\n      d\ne     f"), ("<td>a<td rowspan=2>b<tr><td colspan=2>cd<td>e", "a   b\ncd     e"),
    ("<td rowspan=-1>a<td rowspan=x>b<tr><td>c<td>d", "a  b\nc  d"), ("<td rowspan=2><td>a<tr><td>b", "a\nb"),
]


@pytest.mark.parametrize(("rows", "text"), _SPANS)
def test_cells_make_room_for_those_that_reach_down(rows, text):
    assert html_text.render(f"<table>{rows}</table>") == text


def test_more_cells_that_reach_down_than_rows_make_room_for():
    page = "<table>" + "<td rowspan=9>a" * (html_text.MOST_SPANS + 5) + "<tr><td>b"
    assert html_text.render(page).split() == ["a"] * (html_text.MOST_SPANS + 5) + ["b"]


@pytest.mark.parametrize("part", ["<a x", "<a x=\"'", "<b>", "<b><p>x", "<table><tr><td>", "<table><tr><td>a<td>", "<ul><li>a", "<dl><dd>a", "<!--", "<script>", "<", "<a b='>' ", "<i><table></i>", "<tr><td colspan=1000>x", "<tr><td rowspan=65534>x<td>y", "&amp;"])
def test_html_takes_time_in_proportion(part):
    import time

    began = time.process_time()
    html_text.render("<table>" + part * (N // len(part)) + "\"'>end")
    assert time.process_time() - began < 5


class _Words(HTMLParser):
    """The visible words of well-nested pages, by the standard library's parser and a stack of hidden elements."""

    def __init__(self):
        super().__init__()
        self.stack, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        gone = tag in html_text.INVISIBLE or "hidden" in a or "display:none" in style or "visibility:hidden" in style or (tag == "dialog" and "open" not in a)
        if tag not in html_text.VOID:
            self.stack.append((tag, gone))
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.stack) and self.stack.pop()[0] != tag:
            pass
        if tag in html_text.BLOCK or tag in ("td", "th"):
            self.words.append(" ")

    def handle_data(self, data):
        if not any(gone for _, gone in self.stack):
            self.words.append(data)


def test_html_words_by_another_parser(spark):
    """Of all pages that close what they open: the letters of the words, in order, and their number where no list or table adds marks."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    seen = 0
    for page in pages:
        other = _Words()
        other.feed(page or "")
        want = "".join("".join(other.words).split())
        got = "".join(html_text.render(page).split())
        plain = "".join(regex.findall(r"\p{L}+", got)) == "".join(regex.findall(r"\p{L}+", want))
        seen += plain
    assert seen >= 0.9 * len(pages) > 200


def test_html_deep_and_null(spark):
    assert html_text.render("<div>" * 5000 + "x") == "x" and html_text.render(None) == ""
    df = spark.createDataFrame([(1, "u", None, "old"), (2, None, "<b>t</b>", None), (2, None, "<b>t</b>", None)], "page_id bigint, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.op10(df).collect()) == [(1, ""), (2, "t"), (2, "t")] and html_text.op10(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_buckets_by_class_against_brute_force(spark):
    from itertools import combinations

    from ordertide.llm.linking import shared_buckets

    rng = random.Random(8)
    rows = [(rng.randrange(12), i, rng.randrange(6)) for i in range(80)]
    met = shared_buckets(spark.createDataFrame(rows, "bucket bigint, id bigint, class int")).collect()
    of = {}
    for r in met:
        of.setdefault(r.bucket, set()).add(r.id)
    got = {pair for ids in of.values() for pair in combinations(sorted(ids), 2)}
    assert got == {(a[1], b[1]) for a, b in combinations(rows, 2) if a[0] == b[0] and abs(a[2] - b[2]) <= 1}
    assert all(r.n == len(of[r.bucket]) > 1 and r.hub == min(of[r.bucket]) for r in met)
    assert shared_buckets(spark.createDataFrame([], "bucket bigint, id bigint, class int")).count() == 0


def test_members_bring_their_content_in_turns(spark, monkeypatch):
    """Ids that lie in many mixed buckets each: no more members than there are contents move at once, and links are those of all pairs that share a bucket."""
    from itertools import combinations

    from ordertide.llm import linking

    rng = random.Random(6)
    value = {i: rng.randrange(400) for i in range(60)}
    rows = [(bucket, i) for bucket in range(9) for i in rng.sample(sorted(value), 30)]
    share = {pair for bucket in range(9) for pair in combinations(sorted(i for b, i in rows if b == bucket), 2)}
    root = {i: i for i in value}
    for a, b in sorted(share):
        if abs(value[a] - value[b]) <= 2:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    names, write = [], linking.written
    monkeypatch.setattr(linking, "written", lambda df, what, **more: names.append(what) or write(df, what, **more))
    values = spark.createDataFrame(list(value.items()), "id bigint, content bigint")
    met = linking.shared_buckets(spark.createDataFrame(rows + rows[::2], "bucket bigint, id bigint").distinct())
    near = lambda x, y: F.abs(x - y) < 100
    got = linking.connect(met, values.select("id", F.col("content").alias("sketch")), near, lambda ids: values.join(ids, "id"), lambda x, y: F.abs(x - y) <= 2)
    assert {r.id: r.component for r in got.collect()} == {i: r for i, r in root.items() if list(root.values()).count(r) > 1}
    assert names.count("linked") > 3


def test_members_that_repeat_count_once(spark):
    from ordertide.llm.linking import shared_buckets

    rng = random.Random(3)
    rows = [(rng.randrange(9), i, i % 5) for i in range(60)]
    once, twice = [sorted(map(tuple, shared_buckets(spark.createDataFrame(x, "bucket bigint, id bigint, class int"), repeated=True).collect())) for x in (rows, rows * 3)]
    assert once == twice and once


def test_lines_in_tasks_as_in_columns(spark, texts):
    """Normalising, counts of windows and the bounded edit distance of the tasks, against DataFrame functions and definitions."""
    odd = ["", " ", "a_b", "_ a", "a  b", "a- B!", "é̀a b̀_c", "ΑΣ ΟΣ.", "İx", "a b\x85c\x1cd", "x² ½ª", "漢字 漢_字"]
    rows = odd + [x for t in texts[:10] if t for x in t.split("\n")]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", lines.normal_line(F.col("x")).alias("want")).collect()
    assert [lines._normal(r.x) for r in got] == [r.want for r in got]
    norm = [r.want for r in got if r.want] + ["a" * 13 + " " + "b" * 80]

    def windows(x):
        words = [x[m.start() :][: lines.WINDOW] for m in regex.finditer(r"(?<![^ ])[^ ]", x)]
        at_words = {w for w in words if len(w) == lines.WINDOW} if len(x) >= 72 else ()
        anywhere = {x[i : i + lines.GRAM] for i in range(len(x) - lines.GRAM + 1)} if len(x) >= lines.SHORT and (len(x) < lines.TO_GRAMS or len(x.split()) <= lines.FEW_WORDS) else ()
        return min(len(at_words), lines.BLOCKS_KEPT) + min(len(anywhere), lines.BLOCKS_KEPT)

    counts = [n for chunk in lines._chunks(norm) for n in lines._windows(chunk, 72)[0]]
    assert counts == [windows(x) for x in norm]
    keys = [r.k for r in spark.createDataFrame([(x,) for x in norm[-3:] * 2], "x string").coalesce(1).select(lines._blocks(F.col("x"), lines.FuzzyLines()).alias("k")).collect()]
    assert keys[3:] == [None] * 3 and all(k is not None for k in keys[:3])
    pairs = [(x[:60], y[:60]) for x, y in zip(norm, norm[1:])] + [(x[:60], x[3:20] + "q" + x[22:60]) for x in norm]
    for r in spark.createDataFrame(pairs, "x string, y string").select("x", "y", F.levenshtein("x", "y").alias("d")).collect():
        assert [lines._within(r.x, r.y, most) for most in (r.d - 1, r.d)] == [False, True] and lines._pieces(r.x, r.y, 7, r.d)


def test_line_dedup_runs_no_python_on_executors(spark, texts, monkeypatch):
    """op8 and the pipeline's stage are DataFrame functions alone, and remove what the ways over Arrow batches remove."""
    from ordertide.llm import linking

    plans, keep = [], lines.written

    def watched(df, what, **more):
        plans.append(df._jdf.queryExecution().toString())
        return keep(df, what, **more)

    mine = _edited_lines(texts[5:], 7)
    df = spark.createDataFrame(list(enumerate(mine)), "doc_id bigint, text string").localCheckpoint()
    with monkeypatch.context() as m:
        m.setattr(lines, "written", watched), m.setattr(linking, "written", watched)
        got = {r.doc_id for r in lines.op8(df).where("n_removed > 0").collect()}
    assert len(plans) > 8 and not any(x in plan for plan in plans for x in ("Python", "Arrow", "Pandas"))
    assert got == {r.doc_id for r in lines.removed_lines(df, lines.FuzzyLines(arrow=True)).collect()} and got


def test_lines_with_a_passage_in_other_places_do_not_meet(spark):
    """Lines that share a passage in other places than a link can have it are not compared; those that have it in place are, and links are found."""
    from ordertide.llm import linking

    rng, passage = random.Random(12), "the passage that all these lines share word by word"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [" ".join([word() for _ in range(at)] + [passage] + [word() for _ in range(40 - at)]) for at in range(0, 41, 4)]
    copies = [x.replace(" word by ", " wordx by ")[:-3] + "zzz" for x in rows]
    df = spark.createDataFrame(list(enumerate(rows + copies)), "doc_id bigint, text string")
    p = lines.FuzzyLines()
    nodes = lines._lines(df, p, "doc_id", "text")
    met = linking.shared_buckets(lines._members(nodes, p), repeated=True)
    off = {(r.id, r.hub): r.d for r in met.select("id", "hub", (F.col("at") - F.col("hub_at")).alias("d")).where("id > hub").collect()}
    assert any(abs(d) > 40 for d in off.values())
    held = nodes.select("id", F.col("line").alias("content"), lines._sketch(F.col("line"), p).alias("sketch"))
    links = lambda x, y: lines.linked_lines(x, y, p)
    groups = linking.connect(met, held.select("id", "sketch"), lambda x, y: F.lit(True), lambda ids: held.select("id", "content").join(ids, "id"), links, placed=lambda o, x, y: lines._placed(p, o, x, y))
    assert groups.select("component").distinct().count() == len(rows)
    got = {r.doc_id for r in lines.op8(df).where("n_removed > 0").collect()}
    assert got == set(range(len(rows), 2 * len(rows)))


def test_places_of_repeated_blocks_are_not_held_against_a_link(spark):
    """A line that says one thing over and over has no places; with a word less in front it stays a link."""
    x = "over and over again " * 12 + "the end of it"
    y = x.replace("over and over again ", "over and over agxin ", 1)
    df = spark.createDataFrame([(1, x), (2, y)], "doc_id bigint, text string")
    assert [r.doc_id for r in lines.op8(df).where("n_removed > 0").collect()] == [2]


def test_members_move_once_and_blocks_are_made_once(spark, texts, monkeypatch):
    """What lines are dealt by is computed by one stage, and moved by one exchange; no member brings the list of its buckets to the search for near ones."""
    from ordertide.llm import linking

    plans, keep = [], lines.written

    def watched(df, what, **more):
        plans.append((what, df._jdf.queryExecution().optimizedPlan().toString(), df.columns))
        return keep(df, what, **more)

    texts = [" ".join(t.split()[:30]) + f" shared by all of the lines here, and {t[:150]}" for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").localCheckpoint()
    monkeypatch.setattr(lines, "written", watched), monkeypatch.setattr(linking, "written", watched)
    lines.removed_lines(df)
    members = next(plan for what, plan, _ in plans if what == "members")
    assert members.count("Window [") == 1 and members.count("Generate explode") == 1 and "Join" not in members.replace("Join LeftOuter", "", 1)
    near = [cols for what, _, cols in plans if what == "near"]
    assert near and "all" not in near[0]


def test_contents_are_compared_after_sketches(spark):
    """Of two members that meet, contents are looked at only if their sketches are near: the comparison fails on others."""
    from ordertide.llm import linking

    rng = random.Random(16)
    value = {i: rng.randrange(400) for i in range(60)}
    values = spark.createDataFrame(list(value.items()), "id bigint, content bigint")
    met = linking.shared_buckets(spark.createDataFrame([(bucket, i) for bucket in range(3) for i in value], "bucket bigint, id bigint"))
    near = lambda x, y: F.abs(x - y) < 20
    linked = lambda x, y: F.lit(1) / F.when(near(x, y), 1).otherwise(0) * F.abs(x - y) <= 2
    got = linking.connect(met, values.select("id", F.col("content").alias("sketch")), near, lambda ids: values.join(ids, "id"), linked)
    of = {r.id: r.component for r in got.collect()}
    assert all(of[a] == of[b] for a in value for b in value if a != b and abs(value[a] - value[b]) <= 2) and of


def test_a_blocks_place_is_at_a_word(spark):
    """The letters of a block that stand inside a word before it are not its place."""
    line = "the cat sat on extraordinarily understandable he cat sat on incomprehensibilities notwithstanding"
    df = spark.createDataFrame([(line,)], "line string")
    got = {r.at for r in df.select(F.explode(lines._block_columns(F.col("line"), lines.FuzzyLines())).alias("k")).select("k.at").collect()}
    starts = [m.start() for m in regex.finditer(r"(?<![^ ])[^ ]", line)]
    assert got == {at + 1 for at in starts if at + lines.WINDOW <= len(line)}


def test_parity_of_whole_sets_stops_no_link(spark):
    """Sets at the threshold pass, of any size and across sizes of bitmap, and most sets that differ more are stopped."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, want = [], []
    for n in (1, 5, 31, 33, 120, 250, 260, 500, 515, 1000, 1030, 3000):
        for share in (0.6, 0.7, 0.79, 0.8, 0.9, 1.0):
            for grown in (0.0, 0.5, 1.0):  # how much of what differs is y's own
                x = rng.integers(0, 1 << 63, n, np.uint64)
                apart = round(n * (1 - share) * 2 / (1 + share))
                y = np.concatenate([x[: n - round(apart * (1 - grown))], rng.integers(0, 1 << 63, round(apart * grown), np.uint64)])
                both = len(set(x.tolist()) & set(y.tolist()))
                want.append(100 * both >= 80 * (len(x) + len(y) - both))
                rows.append((len(rows), *[(m.tolist(), len(s)) for s in (x, y) for m in [minhash._parity(s)]]))
    df = spark.createDataFrame(rows, "i int, x struct<odd: array<bigint>, n: bigint>, y struct<odd: array<bigint>, n: bigint>")
    got = [r.ok for r in df.select("i", minhash._may_link(F.col("x"), F.col("y"), 80).alias("ok")).orderBy("i").collect()]
    assert all(g for g, w in zip(got, want) if w) and sum(not g for g, w in zip(got, want) if not w) > 0.6 * want.count(False)
