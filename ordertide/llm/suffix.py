"""Repeated byte strings across texts: sampled suffixes are sorted deep-shallow, and neighbours give what repeats.

A string of LENGTH bytes is found by one suffix: that at its anchor, the position whose next GRAM bytes hash least within it.
Equal strings have their anchors at equal offsets, so suffixes and (reversed) prefixes at anchors are all that must be sorted:
about two in every LENGTH - GRAM bytes. Hashes only deal anchors to groups; what repeats is read off sorted bytes.

1. Anchors of all texts; those whose hash stands at one place alone can't repeat and go.
2. For the others, the bytes around the anchor; equal surroundings merge before they are dealt, so that copies cost nothing.
3. Each group sorts its suffixes by multikey quicksort to a shallow depth, and by blind tries below it. Every run of suffixes
   that agree to a depth r, and inside it the longest agreement l to the left, repeats the strings that start between
   LENGTH - r and l bytes before the anchor.
4. Groups of more than MOST surroundings are dealt again by longer parts of the strings, until they are small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import small, text_key
from ordertide.session import discard, written

LENGTH, GRAM = 400, 64
#: Surroundings in a group that one task sorts at once; parts that a larger group is split into.
MOST, PARTS = 16_384, 8
#: Places with equal surroundings that one task takes.
SPLIT = 4096
_CHUNK = 1 << 22
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) bytes from each position on."""
    h, step, mult = _TABLE[b], 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(mult) + h[step:]
        mult, step = mult * mult % (1 << 64), step * 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by least from and to the edges of blocks."""
    n = len(x)
    if w == 1:
        return x
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, 1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of ``length`` bytes; the first of equal hashes is the anchor."""
    at, keys, start = [], [], 0
    while len(data) - start >= length:
        h = gram_hashes(np.frombuffer(data, np.uint8, min(_CHUNK, len(data) - start), start), gram)
        least = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        i = (least & _LOW).astype(np.int64)
        i = i[np.flatnonzero(np.diff(i, prepend=-1))]
        at.append(i + start)
        keys.append(h[i])
        start += _CHUNK - length + 1
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, first = np.unique(np.concatenate(at), return_index=True)
    return p, np.concatenate(keys)[first].view(np.int64)


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be ``at`` or more."""
    end, step = min(len(a), len(b)), 16
    while at < end:
        if a[at : at + step] == b[at : at + step]:
            at += min(step, end - at)
            step *= 2
        elif step == 1:
            return at
        else:
            step = max(1, step // 4)
            if a[at : at + step] != b[at : at + step] and step > 1:
                step = 1
    return at


class _Trie:
    """Blind trie: inner nodes keep a depth and the byte after it for each branch, never the bytes skipped."""

    def __init__(self, strings: list[bytes], members: list[int], depth: int):
        self.s, self.depth = strings, depth
        self.root: list = [None, [members[0]]]  # leaf: [None, equal strings]; inner: [depth, {byte: node}]
        for i in members[1:]:
            self._put(i)

    def _at(self, i: int, d: int) -> int:
        s = self.s[i]
        return s[d] if d < len(s) else -1

    def _put(self, i: int) -> None:
        path, node = [], self.root
        while node[0] is not None:  # down blindly, by the branching bytes alone
            path.append(node)
            node = node[1].get(self._at(i, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        lcp = common(self.s[i], self.s[other], self.depth)
        if lcp == len(self.s[i]) == len(self.s[other]):
            node[1].append(i)
            return
        for k, inner in enumerate(path):
            if inner[0] == lcp:
                inner[1][self._at(i, lcp)] = [None, [i]]
                return
            if inner[0] > lcp:
                path = path[:k]
                node = inner
                break
        old = [node[0], node[1]]
        node[0], node[1] = lcp, {self._at(other, lcp): old, self._at(i, lcp): [None, [i]]}

    def walk(self) -> Iterator[tuple[int, int]]:
        """Strings in order, each with its agreement with the one before; the first with -1."""
        stack: list[tuple[list, int]] = [(self.root, -1)]
        while stack:
            node, lcp = stack.pop()
            if node[0] is None:
                for k, i in enumerate(node[1]):
                    yield i, lcp if k == 0 else len(self.s[i])
            else:
                branches = sorted(node[1].items())
                for k in range(len(branches) - 1, -1, -1):
                    stack.append((branches[k][1], lcp if k == 0 else node[0]))


def deep_shallow(strings: list[bytes], shallow: int = 32) -> tuple[list[int], list[int]]:
    """Order of the strings, and the agreement of each with the one before it (0 for the first).

    Multikey quicksort splits by eight bytes at a time, three ways, to the depth ``shallow``; groups that agree so far and the
    rest of their order are left to a blind trie.
    """
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1 or depth < 0:
            order.extend(group)
            continue
        if depth >= shallow:
            order.extend(i for i, _ in _Trie(strings, group, depth).walk())
            continue
        key = lambda i: (strings[i][depth : depth + 8], len(strings[i]) > depth + 8)  # noqa: B023, E731
        pivot = key(group[len(group) // 2])
        less, same, more = [], [], []
        for i in group:
            k = key(i)
            (less if k < pivot else more if k > pivot else same).append(i)
        if more:
            stack.append((more, depth))
        stack.append((same, depth + 8 if pivot[1] else -1))  # those that end here are alike
        if less:
            stack.append((less, depth))
    lcp = [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))]
    return order, lcp


class _Least:
    """Least of any run of numbers."""

    def __init__(self, x: np.ndarray):
        self.t, w = [x], 1
        while 2 * w <= len(x):
            self.t.append(np.minimum(self.t[-1][:-w], self.t[-1][w:]))
            w *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Over [i, j), not empty."""
        k = np.frexp(j - i)[1] - 1
        out = np.empty(len(i), self.t[0].dtype)
        for level in np.unique(k):
            m = k == level
            t = self.t[level]
            out[m] = np.minimum(t[i[m]], t[j[m] - (1 << level)])
        return out


def repeats(lefts: list[bytes], rights: list[bytes], lo: int, hi: int, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each surroundings, ranges of d in [lo, hi]: the string that starts d bytes before the anchor stands in another as well.

    ``lefts`` are reversed and end where their document begins, as ``rights`` end where it ends.
    """
    n = len(lefts)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order, lcp = deep_shallow(rights)
    left_order, left_lcp = deep_shallow(lefts)
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    least = _Least(np.array(left_lcp, np.int64))

    def node(members: list[int], depth: int) -> None:
        by = np.sort(rank[members])
        near = least(by[:-1] + 1, by[1:] + 1)
        best = np.maximum(np.concatenate(([0], near)), np.concatenate((near, [0])))
        first = max(lo, length - depth)
        for r, l in zip(by[best >= first], best[best >= first], strict=True):
            found[left_order[r]].append((first, min(int(l), hi)))

    # every maximal run of suffixes that agree to some depth, innermost first
    open_runs: list[tuple[int, int]] = []
    for k in range(1, n + 1):
        here = min(lcp[k], length - lo) if k < n else -1
        start = k - 1
        while open_runs and open_runs[-1][0] > here:
            depth, start = open_runs.pop()
            node(order[start:k], depth)
        if here >= max(length - hi, 1) and (not open_runs or open_runs[-1][0] < here):
            open_runs.append((here, start))
    return [_union(x) if len(x) > 1 else x for x in found]


def _union(x: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(x):
        if b < a:
            continue
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _sort_groups(parts: DataFrame, length: int) -> DataFrame:
    """group, ctx, first, last for rows (group, ctx, lo, hi, left, right, many), a group in one task and after each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: list[tuple]) -> list[tuple]:
            lo, hi = rows[0][2], rows[0][3]
            out = []
            got = repeats([r[4] for r in rows], [r[5] for r in rows], lo, hi, length) if len(rows) > 1 else [[]]
            for r, ranges in zip(rows, got, strict=True):
                if r[6]:  # the same surroundings stand elsewhere too
                    ranges = [(max(lo, length - len(r[5])), min(hi, len(r[4])))]
                # a string must lie inside the document
                out.extend((r[0], r[1], max(a, length - len(r[5])), min(b, len(r[4]))) for a, b in ranges)
            return [x for x in out if x[2] <= x[3]]

        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False, name=None):
                if held and held[0][0] != r[0]:
                    out += solve(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=["group", "ctx", "first", "last"])
        if held:
            yield pd.DataFrame(solve(held), columns=["group", "ctx", "first", "last"])

    rows = parts.repartition("group").sortWithinPartitions("group").select("group", "ctx", "lo", "hi", "left", "right", "many")
    return rows.mapInPandas(run, "group bigint, ctx bigint, first int, last int")


def _ranges(contexts: DataFrame, length: int, most: int) -> DataFrame:
    """anchor, ctx, first, last: repeated strings of each surroundings in a written table (anchor, ctx, left, right, many)."""
    level = contexts.select("anchor", F.col("ctx").alias("whole"), F.col("anchor").alias("group"), F.col("ctx"), F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"), "left", "right", "many")
    out = None
    while True:
        large = written(level.groupBy("group").agg(F.count_distinct("ctx").alias("n")).where(F.col("n") > most), "large")
        some = not large.isEmpty()
        fit = level.join(small(large.select("group")), "group", "left_anti") if some else level
        # one row for each (group, surroundings); a later level has them once for each whole that they were cut from
        once = fit.groupBy("group", "ctx").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("left").alias("left"), F.first("right").alias("right"), (F.max("many") | (F.count(F.lit(1)) > 1)).alias("many")) if out is not None else fit
        got = fit.select("group", "ctx", "anchor", "whole").join(_sort_groups(once, length), ["group", "ctx"]).select("anchor", F.col("whole").alias("ctx"), "first", "last")
        out = got if out is None else out.unionByName(got)
        if not some:
            return out
        # split [lo, hi] in parts: strings of a part share the bytes from lo before the anchor to length - hi after it
        over = level.join(small(large.select("group")), "group", "left_semi")
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / PARTS).cast("int")
        cut = over.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("_lo", F.col("lo") + F.col("_k") * step).withColumn("_hi", F.least(F.col("_lo") + step - 1, F.col("hi"))).where("_lo <= _hi")
        cut = cut.where((F.octet_length("left") >= F.col("_lo")) & (F.octet_length("right") >= F.lit(length) - F.col("_hi")))
        left, right = F.substring("left", F.lit(1), F.col("_hi")), F.substring("right", F.lit(1), F.lit(length) - F.col("_lo"))
        core = F.xxhash64("group", "_lo", F.substring("left", F.lit(1), F.col("_lo")), F.substring("right", F.lit(1), F.lit(length) - F.col("_hi")))
        level = written(cut.select("anchor", "whole", core.alias("group"), F.xxhash64(left, F.lit(0), right).alias("ctx"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), left.alias("left"), right.alias("right"), "many"), "level")


def repeated_spans(docs: DataFrame, *, text: str = "text", length: int = LENGTH, most: int = MOST, split: int = SPLIT) -> DataFrame:
    """text_key, spans (start, end): bytes of each text covered by a string of ``length`` bytes that also starts elsewhere.

    Copies of a text repeat each other's strings. Texts of fewer bytes, null and empty ones give no row, nor does an empty table.
    """
    rows = docs.where(F.octet_length(text) >= length).select(text_key(text).alias("text_key"), F.col(text).alias("_t"))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [anchors(t.encode(), length) for t in b["_t"]]
            yield pd.DataFrame({"text_key": b["text_key"], "at": [g[0] for g in got], "anchor": [g[1] for g in got]})

    found = written(rows.mapInPandas(sample, "text_key binary, at array<bigint>, anchor array<bigint>"), "anchors")
    each = found.select("text_key", F.explode(F.arrays_zip("at", "anchor")).alias("x")).select("text_key", "x.at", "x.anchor")
    place = F.xxhash64("text_key", "at")
    twice = each.select("anchor", place.alias("p")).groupBy("anchor").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a != b").select("anchor")
    twice = written(twice, "twice")
    wanted = each.join(small(twice, 1_000_000), "anchor").groupBy("text_key").agg(F.collect_set(F.struct("at", "anchor")).alias("want"))
    # copies of a text are one before it is moved
    once = rows.groupBy("text_key").agg(F.first("_t").alias("_t"))

    def surround(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t, want in zip(b["text_key"], b["_t"], b["want"], strict=True):
                data = t.encode()
                for w in want:
                    p = w["at"]
                    left, right = data[max(0, p - length + GRAM) : p][::-1], data[p : p + length]
                    out.append((key, p, w["anchor"], xxhash.xxh3_64_intdigest(left + b"|" + right, len(left)) - (1 << 63), left, right))
            yield pd.DataFrame(out, columns=["text_key", "at", "anchor", "ctx", "left", "right"])

    texts = once.join(wanted, "text_key").mapInPandas(surround, "text_key binary, at bigint, anchor bigint, ctx bigint, left binary, right binary")
    around = written(texts, "around")
    discard(found, twice)
    distinct = around.groupBy("anchor", "ctx").agg(F.first("left").alias("left"), F.first("right").alias("right"), (F.min(place) != F.max(place)).alias("many"), F.count(F.lit(1)).alias("n"))
    contexts = written(distinct, "contexts")
    ranges = written(_ranges(contexts, length, most), "ranges")
    per = ranges.groupBy("anchor", "ctx").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    # places of surroundings that are very many are dealt to several tasks, and their ranges go to each of these
    hot = small(written(contexts.where(F.col("n") > split).select("anchor", "ctx", F.ceil(F.col("n") / split).cast("bigint").alias("parts")), "hot"))
    discard(contexts)
    part = F.coalesce("parts", F.lit(1).cast("bigint"))
    dealt = around.select("text_key", "at", "anchor", "ctx").join(hot, ["anchor", "ctx"], "left").withColumn("part", F.pmod(F.xxhash64("text_key", "at"), part)).drop("parts")
    per = per.join(hot, ["anchor", "ctx"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), part - 1))).drop("parts")
    at = F.col("at")
    spans = dealt.join(per, ["anchor", "ctx", "part"]).select("text_key", F.transform("ranges", lambda r: F.struct((at - r["last"]).alias("start"), (at - r["first"] + length).alias("end"))).alias("spans"))
    copies = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("_t")).alias("size")).where("n > 1")
    whole = copies.select("text_key", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("end"))).alias("spans"))
    return spans.unionByName(whole).groupBy("text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of bytes in sorted spans."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = MOST, split: int = SPLIT, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, kept (the bytes that are left) of every row.

    Null text is empty. Rows that repeat are copies: each repeats the other. A null doc_id is kept as it is; other columns don't matter.
    """
    spans = written(repeated_spans(docs, text=text, length=length, most=most, split=split), "spans")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.coalesce(text, F.lit("")).alias("_t")).join(spans, "text_key", "left").select("doc_id", "_t", "spans")
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, t, s in zip(b["doc_id"], b["_t"], b["spans"], strict=True):
                data, runs, at, left = t.encode(), merged(s) if s is not None else [], 0, []
                for x, y in runs:
                    left.append(data[at:x])
                    at = y
                kept = b"".join([*left, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in runs], *([kept] if with_bytes else [])))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if with_bytes else [])])

    return rows.mapInPandas(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>" + ", kept binary" * with_bytes)


def op5(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_bytes=False)
