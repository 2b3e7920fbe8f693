"""Likelihood of documents: words known from the corpus, and a subword lattice that weights all segmentations of any word.

The lattice of a word has an arc for each vocabulary piece that stands in its bytes. A forward recursion in log space sums the
products of piece scores over all segmentations, and a stop after the last piece makes it a distribution over words. Scores
start from the existing vocabulary's ranks (score of rank r in proportion to 1 / (r + 1)), and rounds of expectation
maximisation over the training words' types fits them to the corpus. A document's probability is the product over its tokens
of (count + V * lattice) / (N + V): words seen in training weigh by their counts, and the mass of new words goes to the lattice.

No text and no word list is gathered in one place: tasks number the words of a bounded block of documents, the blocks' word
lists meet the corpus counts in a join, and come back to their blocks with scores.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.session import written

#: A block ends with the document after which it holds so many tokens or different words.
BLOCK_TOKENS, BLOCK_WORDS = 8_000_000, 500_000
#: Characters that no word holds, and capitals, which are lower-cased: pieces with them are never used.
_NEVER = frozenset(b" \t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ")
_B = np.uint64(0x9E3779B97F4A7C15)
NONE = -np.inf


class Pieces:
    """Vocabulary pieces by hash, with natural-log scores and the log probability of stopping after a piece."""

    def __init__(self, ranks: str):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # a piece that begins with a space begins words, the others go on; every byte can do both, so every word has a segmentation
        roles: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for piece, rank in table.items():
            begins = piece[:1] == b" "
            if piece[begins:] and not _NEVER & set(piece[begins:]):
                roles[not begins][piece[begins:]] = rank
        for role in roles:
            for x in range(256):
                role.setdefault(bytes([x]), len(table))
        kept = sorted({*roles[0], *roles[1]})
        h = np.array([self._hash(p) for p in kept], np.uint64)
        order = np.argsort(h)
        self.h = h[order]
        if len(np.unique(self.h)) < len(self.h):
            raise ValueError("two pieces share a hash")
        self.longest = max(map(len, kept))
        weight = np.array([[1 / (role[p] + 1) if p in role else 0.0 for p in kept] for role in roles])[:, order]
        #: Row 0: scores of pieces that begin a word, row 1: of those that go on.
        with np.errstate(divide="ignore"):
            self.logp = np.log(weight / weight.sum(1, keepdims=True))
        self.stop = math.log(0.4)

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * int(_B) + b + 1) % (1 << 64)
        return h


@lru_cache(2)
def _pieces(ranks: str) -> Pieces:
    return Pieces(ranks)


def _arcs(w: np.ndarray, p: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For words of one length, the rows of ``w``: (piece length, piece number at each start, whether there is one)."""
    h = np.zeros(w.shape, np.uint64)
    n = w.shape[1]
    for size in range(1, min(n, p.longest) + 1):
        h = h[:, : n - size + 1] * _B + (w[:, size - 1 :].astype(np.uint64) + np.uint64(1))
        i = np.searchsorted(p.h, h)
        i[i == len(p.h)] = 0
        yield size, i, p.h[i] == h


def forward(w: np.ndarray, p: Pieces, logp: np.ndarray, stop: float, counts: np.ndarray | None = None) -> np.ndarray:
    """Natural-log probability of each word. With ``counts``, adds the pieces' expected uses, and at its end those of the stop."""
    m, n = w.shape
    go = math.log1p(-math.exp(stop))
    arcs = []
    for size, i, ok in _arcs(w, p):
        if ok.any():
            lp = np.where(ok, logp[1][i] + go, NONE)
            lp[:, 0] = np.where(ok[:, 0], logp[0][i[:, 0]], NONE)
            arcs.append((size, i, lp))
    a = np.full((n + 1, m), NONE)
    a[0] = 0
    with np.errstate(invalid="ignore"):
        for end in range(1, n + 1):
            for size, _, lp in arcs:
                if size <= end:
                    a[end] = np.logaddexp(a[end], a[end - size] + lp[:, end - size])
        if counts is not None:
            b = np.full((n + 1, m), NONE)
            b[n] = 0
            for start in range(n - 1, -1, -1):
                for size, _, lp in arcs:
                    if start + size <= n:
                        b[start] = np.logaddexp(b[start], b[start + size] + lp[:, start])
            for size, i, lp in arcs:
                use = np.exp(a[: n - size + 1].T + lp + b[size:].T - a[n][:, None])
                k = logp.shape[1]
                counts[:k] += np.bincount(i[:, 0], use[:, 0], k)
                counts[k:-1] += np.bincount(i[:, 1:].ravel(), use[:, 1:].ravel(), k)
            counts[-1] += m
    return a[n] + stop


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct numbers, as differences, and their counts."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
    return np.cumsum(x[: len(x) // 2]), x[len(x) // 2 :]


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes of words of equal length, in blocks of bounded size."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for x, y in zip(edges, edges[1:], strict=False):
        n = int(size[order[x]])
        step = max(1, 1_000_000 // max(1, n * min(n, 64)))
        for k in range(x, y, step):
            at = order[k : min(k + step, y)]
            yield at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)


def _blocks(docs: DataFrame) -> DataFrame:
    """A written table of two kinds of rows: documents (block, doc_id, held_out, ids) and words (block, word, id, train)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, seen, tokens = TaskContext.get().partitionId(), 0, {}, 0
        train: list[int] = []

        def lists() -> pd.DataFrame:
            return pd.DataFrame({"block": np.int64((part << 32) + k), "is_doc": False, "doc_id": None, "held_out": None, "ids": None, "word": list(seen), "id": np.arange(len(seen), dtype=np.int32), "train": train})

        for b in batches:
            rows: list[tuple] = []
            for doc, text, held in zip(b["doc_id"], b["text"], b["held_out"], strict=True):
                ids = np.array([seen.setdefault(w, len(seen)) for w in text.encode("utf-8", "surrogatepass").lower().split()], "<u4")
                train.extend([0] * (len(seen) - len(train)))
                u, c = np.unique(ids, return_counts=True)
                if not held:
                    for i, n in zip(u.tolist(), c.tolist(), strict=True):
                        train[i] += n
                rows.append(((part << 32) + k, doc, held, packed(u, c)))
                tokens += len(ids)
                if tokens > BLOCK_TOKENS or len(seen) > BLOCK_WORDS:
                    yield lists()
                    k, seen, train, tokens = k + 1, {}, [], 0
            yield pd.DataFrame(rows, columns=["block", "doc_id", "held_out", "ids"]).assign(is_doc=True, word=None, id=None, train=None)
        if seen:
            yield lists()

    return written(docs.mapInPandas(run, f"block bigint, is_doc boolean, doc_id {kind}, held_out boolean, ids binary, word binary, id int, train bigint"), "blocks")


def _fit(types: DataFrame, ranks: str, rounds: int) -> tuple[np.ndarray, float]:
    """Piece scores and stop after rounds of expectation maximisation over the words of ``types``, one use each."""
    p = _pieces(ranks)
    logp, stop = p.logp, p.stop
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp, stop: float = stop) -> Iterator[pa.RecordBatch]:
            p, counts = _pieces(ranks), np.zeros(logp.size + 1)
            for b in batches:
                for _, w in _by_length(b.column("word").to_pylist()):
                    forward(w, p, logp, stop, counts)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["piece", "n"])

        # two rows for each vocabulary piece at most
        got = types.select("word").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(logp.size + 1)
        for r in got:
            counts[r["piece"]] = r["n"]
        uses = counts[:-1].reshape(p.logp.shape) + np.where(np.isfinite(p.logp), 0.01, 0.0)
        with np.errstate(divide="ignore"):
            logp = np.log(uses / uses.sum(1, keepdims=True))
        stop = math.log((counts[-1] + 1) / (uses[1].sum() + counts[-1] + 2))
    return logp, stop


def score(docs: DataFrame, *, ranks: str, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score for every row.

    ``lattice_score`` is the lattice's marginal alone: words by all their segmentations, the end as one of V + 1 types.

    Learns from rows whose crc32(doc_id as text) modulo ``folds`` isn't ``held_fold``; a null id counts as an empty text. Tokens are
    the words, then one end. Null and empty texts are the end alone. Rows that repeat count as often as they stand there, and
    get the same scores. Without a training row, the base score is 0 and the lattice alone gives the score. Words of any
    length are summed whole. An empty table gives an empty result.
    """
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), (fold == held_fold).alias("held_out"))
    blocks = _blocks(rows)
    lists = blocks.where("NOT is_doc").select("block", "id", "word", "train")
    words = written(lists.groupBy("word").agg(F.sum("train").alias("c")), "words")
    seen = words.where("c > 0").agg(F.count(F.lit(1)), F.sum("c")).first()
    ends = blocks.where("is_doc AND NOT held_out").count()
    types, total = seen[0] + (ends > 0), (seen[1] or 0) + ends
    logp, stop = _fit(words.where("c > 0"), ranks, rounds)

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(ranks)
        for b in batches:
            w = b.column("word").to_pylist()
            out = np.empty(len(w))
            for at, same in _by_length(w):
                out[at] = forward(same, p, logp, stop)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(out)], names=["word", "c", "lattice"])

    scored = words.mapInArrow(lattice, "word binary, c bigint, lattice double")
    known = lists.join(scored, "word").select(F.col("block").alias("of_block"), "id", "c", "lattice")
    kind = docs.schema[doc_id].dataType.simpleString()
    v = max(types, 1)

    def tokens(c: np.ndarray, log_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.log10((c + 0.5) / (total + 0.5 * (types + 1)))
        with np.errstate(divide="ignore"):
            return base, (np.logaddexp(np.log(c), math.log(v) + log_new) - math.log(total + v)) / math.log(10)

    new_end = -math.log(v + 1)
    end = [float(x[0]) for x in tokens(np.array([float(ends)]), np.array([new_end]))]

    def add(key: tuple, d: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        c, lat = np.zeros(len(w)), np.zeros(len(w))
        c[w["id"]], lat[w["id"]] = w["c"], w["lattice"]
        alone = lat + math.log1p(-1 / (v + 1))
        base, mine = tokens(c, alone)
        out = []
        for doc, held, raw in zip(d["doc_id"], d["held_out"], d["ids"], strict=True):
            i, n = unpacked(raw)
            out.append((doc, held, int(n.sum()) + 1, int(n[c[i] > 0].sum()) + (ends > 0), total, float(base[i] @ n) + end[0], float(mine[i] @ n) + end[1], (float(alone[i] @ n) + new_end) / math.log(10)))
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    return (
        blocks.where("is_doc").select("block", "doc_id", "held_out", "ids").groupBy("block").cogroup(known.groupBy("of_block"))
        .applyInPandas(add, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double")
    )


def op4(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return score(docs, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))
