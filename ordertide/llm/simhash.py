"""SimHash near-duplicates: a binary trie of fingerprints is joined with itself.

Pairs of nodes go down the trie together. A pair carries the number of bits in which its two prefixes differ, and is pruned as soon
as that is beyond the budget. The upper levels are DataFrame joins, a few bits a round: a pair whose nodes hold few fingerprints
is set aside, the others are divided further, so pages are bounded however fingerprints are spread. Below, each pair of pages is
traversed in one task over sorted fingerprints, where a node is a range. What leaves a task is a forest of the links found there,
not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import components, looked_up
from ordertide.session import written

#: Fingerprints of a page, bits that a round of joins goes down, pairs of nodes that one step traverses, and of fingerprints that it compares at once.
PAGE, STEP, CHUNK, LEAF = 4096, 3, 1 << 17, 32


def fingerprint(text: str | None, width: int = 3, seed: int = 42, chunk: int = 1 << 15) -> int:
    """Bits that over half the shingles' hashes have, as a signed 64-bit integer; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z alone, \x20 and \x09-\x0D alone
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    ends = ends[min(width, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, chunk):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : min(i + chunk, n)], ends[i : i + chunk], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t.as_py(), width, seed) for t in b.column("_t")], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp bigint")


def _prefix(fp: Column, bits: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - bits) if bits else F.lit(0).cast("bigint")


def page_pairs(fps: DataFrame, most: int, page: int = PAGE) -> DataFrame | None:
    """level, a, b: pairs of trie nodes, a <= b, that may hold a link and have ``page`` fingerprints each at most. None without fingerprints."""
    n = fps.count()
    spark, level, pages = fps.sparkSession, 0, []
    open_ = spark.createDataFrame([(0, 0, n, n, 0)] if n else [], "a bigint, b bigint, na bigint, nb bigint, bits int")
    while True:
        done = (F.greatest("na", "nb") <= page) | F.lit(level == 64)
        pages.append(open_.where(done).select(F.lit(level).alias("level"), "a", "b"))
        more = open_.where(~done)
        if more.isEmpty():
            break
        after = min(level + STEP, 64)
        step = after - level
        children = fps.groupBy(_prefix(F.col("fp"), after).alias("p")).agg(F.count(F.lit(1)).alias("n")).withColumn("parent", F.shiftrightunsigned("p", step))
        of = lambda x: children.select(F.col("parent").alias(x), F.col("p").alias(f"_{x}"), F.col("n").alias(f"_n{x}"))
        down = more.select("a", "b", "bits").join(of("a"), "a").join(of("b"), "b").where("a <> b OR _a <= _b")
        bits = F.col("bits") + F.bit_count(F.col("_a").bitwiseXOR(F.col("_b")).bitwiseAND(F.lit((1 << step) - 1)))
        open_ = written(down.withColumn("bits", bits).where(F.col("bits") <= most).select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_na").alias("na"), F.col("_nb").alias("nb"), "bits"), "nodes")
        level = after
    return reduce(DataFrame.unionByName, pages)


def traverse(a: np.ndarray, b: np.ndarray, level: int, most: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted unsigned ``a`` and ``b``, of nodes at ``level``, that differ in ``most`` bits at most; of ``same`` arrays each pair once."""
    above = (int(a[0]) ^ int(b[0])) >> (64 - level) if level else 0
    stack = [(63 - level, np.array([[0, len(a), 0, len(b), above.bit_count()]], np.int64))]
    while stack:
        bit, f = stack.pop()
        if len(f) > CHUNK:
            stack += [(bit, f[:CHUNK]), (bit, f[CHUNK:])]
            continue
        alo, ahi, blo, bhi, e = f.T
        size = (ahi - alo) * (bhi - blo)
        few = size <= LEAF if bit >= 0 else np.ones(len(f), bool)
        if few.any():  # ranges this short are compared in full
            lo_a, lo_b, wide, s = alo[few], blo[few], (bhi - blo)[few], size[few]
            of = np.repeat(np.arange(len(s)), s)
            k = np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s)
            i, j = lo_a[of] + k // wide[of], lo_b[of] + k % wide[of]
            if same:
                once = i < j
                i, j = i[once], j[once]
            near = np.bitwise_count(a[i] ^ b[j]) <= most
            if near.any():
                yield i[near], j[near]
        f = f[~few]
        if not len(f):
            continue
        alo, ahi, blo, bhi, e = f.T
        one = np.uint64(1 << bit)
        head = ~np.uint64((1 << (bit + 1)) - 1)
        am = np.clip(np.searchsorted(a, (a[alo] & head) | one), alo, ahi)
        bm = np.clip(np.searchsorted(b, (b[blo] & head) | one), blo, bhi)
        own = np.logical_and(same, alo == blo)  # a node with itself: its halves meet once
        down = np.concatenate([np.stack(x, 1) for x in ((alo, am, blo, bm, e), (am, ahi, bm, bhi, e), (alo, am, bm, bhi, e + 1), (am, np.where(own, am, ahi), blo, bm, e + 1))])
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= most)]
        if len(down):
            stack.append((bit - 1, down))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` nodes the least one that the links connect it to."""
    least = np.arange(n)
    for i, j in links:
        while True:
            x, y = least[i], least[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while (up := least[least])[least != up].size:
                least = up
    return least


def links(fps: DataFrame, most: int = 2, *, page: int = PAGE) -> DataFrame:
    """a, b: links between fingerprints (``fp``, each once) that connect just those that pairs within ``most`` bits connect."""
    pairs = written(page_pairs(fps, most, page), "pages")
    levels = [r[0] for r in pairs.select("level").distinct().collect()]  # 23 at most
    node = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), _prefix(F.col("fp"), x).alias("p")) for x in levels] or [F.struct(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("p"))])).alias("_n")
    sides = F.explode(F.array(F.struct(F.col("a").alias("p"), F.lit(0).alias("side")), F.struct(F.when(F.col("a") != F.col("b"), F.col("b")).alias("p"), F.lit(1).alias("side")))).alias("_s")
    wanted = pairs.select("level", "a", "b", sides).select("level", "a", "b", "_s.p", "_s.side").where("p IS NOT NULL")
    held = fps.select("fp", node).select("fp", "_n.level", "_n.p").join(wanted, ["level", "p"]).select("level", "a", "b", "side", "fp")

    def run(table: pa.Table) -> pa.Table:
        fp, side, level = np.array(table.column("fp"), np.int64).view(np.uint64), np.array(table.column("side")), table.column("level")[0].as_py()
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        if len(b):
            found = ((i, j + len(a)) for i, j in traverse(a, b, level, most, False))
        else:
            found = traverse(a, a, level, most, True)
        both = np.concatenate([a, b])
        least = forest(len(both), found)
        tied = np.flatnonzero(least != np.arange(len(both)))
        return pa.table({"a": both[tied].view(np.int64), "b": both[least[tied]].view(np.int64)})

    return held.groupBy("level", "a", "b").applyInArrow(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, *, width: int = 3, most: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text", page: int = PAGE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links of ``most`` differing bits or fewer.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Fewer words than ``width`` are
    one shingle. Rows that repeat are rows each, with one result. A null doc_id is never the least where its group has another;
    else its component is null. Texts are hashed whole. An empty table gives an empty result. Other columns don't matter.
    """
    of = written(fingerprints(docs, width=width, seed=seed, doc_id=doc_id, text=text), "fingerprints")
    fps = written(of.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    groups = components(written(links(fps.select("fp"), most, page=page), "links", few=False)).withColumnRenamed("id", "fp")
    named = written(fps.join(groups, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("g")), "named")
    whole = named.groupBy("g").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_m"))
    total = named.count()
    least = written(looked_up(named, whole, ["g"], F.col("_m") > max(total // 1000, 1), "inner").select("fp", "n", "component_id"), "least")
    rows = of.count()
    out = looked_up(of, least, ["fp"], F.col("n") > max(rows // 1000, 1), "inner")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs)
