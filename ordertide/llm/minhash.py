"""Near-duplicate documents: banded MinHash gives candidates, odd sketches filter them, full shingle sets decide.

The MinHash samples of a document are folded into a bitmap by parity: sample i flips the bit that (i, value) hashes to. The
XOR of two bitmaps has the parity of the samples that differ, so its population count estimates their number, and with it the
similarity, most precisely where it is high. Candidates whose estimate is far below the threshold go without their sets being
read. So do those whose sets are shown to differ in too many shingles by a bitmap of the whole set, also by parity: each odd bit of the XOR of two is
a shingle that one of them lacks. The others are compared on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import small, text_key
from ordertide.llm.linking import connect, shared_buckets
from ordertide.session import discard, written


@dataclass(frozen=True)
class NearDup:
    """At similarity 0.8 a pair shares no band with a probability of 3e-6, and the sketch stops it with one of 3e-6 (of 3 million simulated pairs)."""

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 512
    slack: float = 0.176

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Odd bits of the XOR that a pair at the threshold less the slack has on average."""
        differ = 2 * self.samples * (1 - self.percent / 100 + self.slack)
        return math.ceil(self.bits * (1 - math.exp(-2 * differ / self.bits)) / 2)


def estimate(odd: int, p: NearDup) -> float:
    """Similarity by the population count of two sketches' XOR."""
    share = min(2 * odd / p.bits, 1 - 1e-9)
    return 1 + p.bits / (4 * p.samples) * math.log(1 - share)


_P = np.uint64(0x9DDFEA08EB382D69)
_words: dict[bytes, int] = {}
#: Bits of the bitmap of a whole set.
LEAST_BITS, MOST_BITS = 64, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``width`` consecutive words, lower-cased A-Z; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z alone, \x20 and \x09-\x0D alone
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 300_000:
        _words.clear()
    ids = []
    get = _words.get
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    h = np.array(ids, np.uint64)
    n = min(width, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = _mix(out) * _P + h[j : len(h) - n + 1 + j]
    return np.unique(_mix(out + np.uint64(n)))


def _samples(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (h >> np.uint64(32)).astype(np.uint32)[:, None]
    least = (x[:1024] * a + b).min(axis=0)
    for i in range(1024, len(x), 1024):
        np.minimum(least, (x[i : i + 1024] * a + b).min(axis=0), out=least)
    return least


def _parity(h: np.ndarray) -> np.ndarray:
    """A bitmap of a set by parity, of a power of two bits: twice its members at least, within LEAST_BITS and MOST_BITS."""
    bits = min(max(1 << (2 * len(h) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """False if sizes or ``_parity`` of two sets prove them less similar than ``percent``. Of a link, bitmaps are of one size, or one is of twice the other's."""

    def differ(pair: Column) -> Column:
        half = lambda a: F.zip_with(F.slice(a, 1, (F.size(a) / 2).cast("int")), F.slice(a, (F.size(a) / 2).cast("int") + 1, F.size(a)), lambda u, v: u.bitwiseXOR(v))
        a, b = pair["x"], pair["y"]
        odd = lambda u, v: F.aggregate(F.zip_with(u, v, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda n, k: n + k)
        return F.when(F.size(a) == F.size(b), odd(a, b)).when(F.size(a) > F.size(b), odd(half(a), b)).otherwise(odd(a, half(b)))

    most = (x["n"] + y["n"]) * (100 - percent)
    fewer = F.abs(x["n"] - y["n"]) * (100 + percent) <= most
    apart = F.get(F.transform(F.array(F.struct(x["odd"].alias("x"), y["odd"].alias("y"))), differ), F.lit(0))
    return F.when(~fewer, F.lit(False)).when(F.greatest(F.size(x["odd"]), F.size(y["odd"])) > 2 * F.least(F.size(x["odd"]), F.size(y["odd"])), F.lit(True)).otherwise(apart * (100 + percent) <= most)


def signatures(docs: DataFrame, p: NearDup, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (equal sets share it), bands, sketch and odd (of ``_parity``); the last four null without words."""
    rng = np.random.default_rng(20240101)
    a = rng.integers(0, 1 << 32, p.samples, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, p.samples, np.uint32)
    index = np.arange(p.samples, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, bands, sketch, parity = [], [], [], [], []
            for text in batch.column("_t"):
                h = shingles(text.as_py(), p.width)
                n.append(len(h))
                if not len(h):
                    ids.append(None), bands.append(None), sketch.append(None), parity.append(None)
                    continue
                ids.append(np.frombuffer(xxhash.xxh3_64_digest(h.tobytes()), ">i8")[0])
                s = _samples(h, a, b).astype(np.uint64) | (index << np.uint64(32))
                m = _mix(s)
                band = m.reshape(p.bands, p.rows)
                key = band[:, 0]
                for j in range(1, p.rows):
                    key = _mix(key) * _P + band[:, j]
                bands.append(_mix(key).view(np.int64))
                odd = np.bincount((m % np.uint64(p.bits)).astype(np.int64), minlength=p.bits) & 1
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                parity.append(_parity(h))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, longs), pa.array(sketch, longs), pa.array(parity, longs)], names=["doc_id", "text_key", "n_shingles", "set_id", "bands", "sketch", "odd"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key binary, n_shingles bigint, set_id bigint, bands array<bigint>, sketch array<bigint>, odd array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, text: str) -> DataFrame:
    """id and content, the sorted shingle hashes, of the texts in ``wanted`` (id, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in batch.column("_t")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "content"])

    rows = docs.select(text_key(text).alias("text_key"), F.col(text).alias("_t")).join(small(written(wanted, "wanted")), "text_key")
    return rows.dropDuplicates(["id"]).select("id", "_t").mapInArrow(run, "id bigint, content array<bigint>")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (least doc_id reachable over links, its own included), kept, text_key and group (null without words).

    Texts with equal shingle sets are one node, so copies are never paired. Null and empty texts, and texts without words, have
    no shingle, no link, and are kept. Rows that repeat under one doc_id share a result, and all are kept if that id is the
    component's least. A null doc_id is never the least where its group has another; else its component is null and it is kept.
    Very long texts are hashed whole. An empty table gives an empty result. Other columns don't matter.
    """
    sig = written(signatures(docs, p, doc_id=doc_id, text=text), "signatures")
    nodes = written(sig.where("set_id IS NOT NULL").groupBy("set_id").agg(F.first("text_key").alias("text_key"), F.first("bands").alias("bands"), F.first(F.struct(F.col("sketch").alias("s"), "odd", F.col("n_shingles").alias("n"))).alias("sketch")).withColumnRenamed("set_id", "id"), "nodes")

    def near(x: Column, y: Column) -> Column:
        odd = F.lit(0)
        for i in range(p.bits // 64):
            odd = odd + F.bit_count(x["s"][i].bitwiseXOR(y["s"][i]))
        return F.when(odd <= p.most_bits, _may_link(x, y, p.percent)).otherwise(F.lit(False))

    def contents(ids: DataFrame) -> DataFrame:
        return _sets(docs, ids.join(nodes.select("id", "text_key"), "id"), p.width, text)

    def linked(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return both * 100 >= (F.size(x) + F.size(y) - both) * p.percent

    groups = connect(shared_buckets(nodes.select("id", F.explode("bands").alias("bucket"))), nodes.select("id", "sketch"), near, contents, linked)
    ids = sig.select("doc_id", "text_key", "n_shingles", "set_id")
    least = ids.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    whole = least.join(groups.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("g", F.coalesce("component", "set_id"))
    of_group = whole.where("component IS NOT NULL").groupBy("g").agg(F.min("least").alias("_group"))
    named = whole.join(of_group, "g", "left").select("set_id", F.coalesce("_group", "least").alias("_least"), F.col("g").alias("group"))
    out = ids.join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", "group")


def dedup(docs: DataFrame, p: NearDup = NearDup(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all columns of ``docs``: that of the least (doc_id, text_key), null ids last, and of rows that repeat there any one. Rows without words stay."""
    rows = written(near_duplicates(docs, p, doc_id=doc_id, text=text).where("group IS NOT NULL").select("doc_id", "text_key", "group"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")
    best = rows.groupBy("group").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = written(rows.join(best, "group").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), place.eqNullSafe(F.col("best")).alias("_best")).groupBy("_id", "_key", "_best").agg(F.count(F.lit(1)).alias("_n")), "many")
    discard(rows)
    keyed = docs.withColumn("_text_key", text_key(text))

    def of(which: DataFrame, how: str) -> DataFrame:
        return keyed.join(which, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), how)

    left = of(many.where("NOT _best OR _n > 1"), "left_anti")
    again = many.where("_best AND _n > 1")
    if not again.isEmpty():  # the same id and text stand there more than once, and only those rows are dealt out
        left = left.unionByName(of(again, "left_semi").dropDuplicates([doc_id, "_text_key"]))
    return left.drop("_text_key")


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, NearDup(width=2)).select("doc_id", "n_shingles", "component_id", "kept")
