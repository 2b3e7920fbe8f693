"""Mixture-controlled packing: every window takes its target share of tokens from each source's queue.

Deficit round-robin in closed form. After window ``w`` a source is owed F(w), its target share of all tokens dealt so far,
and has been given C(w) = floor(F(w)); the deficit F(w) - C(w), below one token, carries over to the next window. As C is a
function of ``w`` alone, any task can deal any window: deficits carry across windows and partitions without passing state.
Windows follow each other in one stream of tokens, sources in order inside a window, and the stream is cut into sequences, so
only the last sequence has padding. Where targets differ from what the queues hold, a queue that runs out leaves its share
to the others, in proportion.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordertide.llm.common import small
from ordertide.session import written

LENGTH = 1024
#: Tokens of a mixture window: the proportions hold in every 64 sequences.
MIX_WINDOW = 64 * LENGTH
#: With more distinct sources than this, rows are ordered by their place in the stream first, so that a task needs the shares of few windows.
QUEUES = 1024
END = 0

# Only letters on which both tokenizer libraries' Unicode tables have long agreed.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏͰ-ͷ΄-ΊΌΎ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€]")


class Tokens:
    """Token ids by the tokenizer file, in which the string of a special token is that token; the same vocabulary's rank file, where there is one, is faster on plain texts."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or _PLAIN.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(2)
def _tokens(path: str, ranks: str | None) -> Tokens:
    return Tokens(path, ranks)


@dataclass
class Mixture:
    """Cumulative shares. ``totals``: tokens in each queue; ``targets``: their weights, by default the totals."""

    totals: list[int]
    targets: list[int] | None = None
    window: int = MIX_WINDOW

    def __post_init__(self) -> None:
        """A queue of weight x has been given x * v tokens, or all that it has, when v were given for each unit of weight: so it runs out at v = total / x, and between two
        such ends the tokens given in all grow evenly. Queues are sorted by their end once, and sums of those before it tell each phase."""
        t = self.targets or self.totals
        self._weight = [max(0, x) if n else 0 for x, n in zip(t, self.totals, strict=True)]
        fine = 2 * max(self._weight, default=0).bit_length() + 2  # two ends that differ do so by more than 2 ** -fine
        end = lambda s: (self.totals[s] << fine) // self._weight[s]
        order = sorted((s for s, x in enumerate(self._weight) if x), key=end)
        self._rank = [len(order)] * len(self.totals)
        for i, s in enumerate(order):
            self._rank[s] = i
        self._gone = [0, *accumulate(self.totals[s] for s in order)]
        live = sum(self._weight)
        self._live = [live, *(live - x for x in accumulate(self._weight[s] for s in order))]
        # tokens given in all when the queue at each place of the order runs out, rounded down
        self._ends = [self._gone[i] + self.totals[s] * self._live[i] // self._weight[s] for i, s in enumerate(order)]
        self._even = not order or end(order[0]) == end(order[-1])
        self.all = sum(self.totals)
        self.windows = -(-self.all // self.window)
        self._tail = None
        if self._gone[-1] < self.all:  # only queues of no weight are left, all of them whole: they share alike
            rest = [s for s, n in enumerate(self.totals) if n and not self._weight[s]]
            sizes = sorted(self.totals[s] for s in rest)
            gone = [0, *accumulate(sizes)]
            # where each runs out in turn
            self._tail = (self._gone[-1], set(rest), gone, [gone[k] + x * (len(sizes) - k) for k, x in enumerate(sizes)])
            self._even = False
        self._rows: dict[int, tuple[list[int], int]] = {}
        self._firsts: dict[int, list[int]] = {}
        self._most = max(8, 4096 * QUEUES // max(len(self.totals), QUEUES))

    def given(self, w: int) -> list[int]:
        """C(w) of each queue: tokens given before window ``w``."""
        return self._row(w)[0]

    def _row(self, w: int) -> tuple[list[int], int]:
        if w not in self._rows:
            if len(self._rows) >= self._most:
                self._rows.clear()
            g = min(w * self.window, self.all)
            if w >= self.windows:
                c = list(self.totals)
            elif self._tail and g >= self._tail[0]:
                level = self._level(g)
                c = [min(x, level) if s in self._tail[1] else x for s, x in enumerate(self.totals)]
            else:
                k = self._phase(g)
                more, den = g - self._gone[k], self._live[k]
                c = [x * more // den if r >= k else n for x, r, n in zip(self._weight, self._rank, self.totals, strict=True)]
            self._rows[w] = c, sum(c)
        return self._rows[w]

    def _phase(self, g: int) -> int:
        """How many queues have run out when ``g`` tokens, fewer than the weighted queues have, were given. An end that is no whole number lies beyond its rounded one."""
        return bisect_left(self._ends, g)

    def _level(self, g: int) -> int:
        """Tokens that each queue of no target has given, if it had as many, of ``g`` in all."""
        at, live, gone, ends = self._tail
        k = bisect_right(ends, g - at)
        return (g - at - gone[k]) // (len(live) - k)

    def _of(self, w: int, queue: int) -> int:
        """``given(w)[queue]``, without the other queues if they are many."""
        if len(self.totals) <= QUEUES or w in self._rows:
            return self._row(w)[0][queue]
        g = min(w * self.window, self.all)
        if w >= self.windows:
            return self.totals[queue]
        if self._tail and g >= self._tail[0]:
            return min(self.totals[queue], self._level(g)) if queue in self._tail[1] else self.totals[queue]
        k = self._phase(g)
        return self._weight[queue] * (g - self._gone[k]) // self._live[k] if self._rank[queue] >= k else self.totals[queue]

    def place(self, queue: int, at: int) -> tuple[int, int, int]:
        """Of token ``at`` of a queue: its window, its place in the stream, and how many of the queue's tokens follow in that window, itself included."""
        lo, hi = 0, self.windows - 1
        if self.totals[queue] and self._even:  # near, as shares are even
            guess = at * self.all // (self.totals[queue] * self.window)
            lo, hi = max(0, guess - 1), min(hi, guess + 2)
            if self._of(lo, queue) > at or (hi < self.windows - 1 and self._of(hi + 1, queue) <= at):
                lo, hi = 0, self.windows - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self._of(mid + 1, queue) > at else (mid + 1, hi)
        c, d = self._of(lo, queue), self._of(lo + 1, queue)
        if lo not in self._firsts:
            if len(self._firsts) >= self._most:
                self._firsts.clear()
            (row, before), after = self._row(lo), self.given(lo + 1)
            self._firsts[lo] = list(accumulate((y - x for x, y in zip(row, after, strict=True)), initial=before))
        return lo, self._firsts[lo][queue] + at - c, d - at


def tokenise(docs: DataFrame, *, tokenizer: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A written table with a row for each document: doc_id, queue, part, start (tokens of the queue before it in its part), n and ids."""
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), name.alias("source"), F.col(text).alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, part, sums = _tokens(tokenizer, ranks), TaskContext.get().partitionId(), {}
        kind = np.dtype("<u2") if tokens.slow.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        for b in batches:
            ids, n, start = [], [], []
            for queue, t in zip(b["source"], b["text"], strict=True):
                x = tokens(t)
                x.append(END)
                ids.append(np.array(x, kind).tobytes())
                n.append(len(x))
                start.append(sums.get(queue, 0))
                sums[queue] = start[-1] + len(x)
            yield pd.DataFrame({"doc_id": b["doc_id"], "queue": b["source"], "part": np.int32(part), "start": start, "n": n, "width": np.int32(kind.itemsize), "ids": ids})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInPandas(encode, f"doc_id {kind}, queue string, part int, start bigint, n bigint, width int, ids binary"), "tokens")


def pack(docs: DataFrame, *, tokenizer: str, ranks: str | None = None, targets: dict[str, float] | None = None, power: float = 1.0, length: int = LENGTH, window: int = MIX_WINDOW, with_ids: bool = True, **names) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens: doc_id, start, length, ids, ids_crc32, doc_tokens, source, sequence_id, offset.

    A null or empty text is its end token alone; a null source is a source named ''. Rows that repeat, in ids too, are
    packed each for itself. An empty table gives no piece. ``targets``: weights by source; sources it doesn't name get
    none until the others run out. Without ``targets`` a source's weight is its number of tokens to the ``power``: at 1, sources keep their proportions to the end;
    below it, small ones come sooner. Documents are tokenised once, into a written table, so that a task that runs again finds
    the same rows; after that only sums of tokens for each part and queue are moved.
    """
    table = tokenise(docs, tokenizer=tokenizer, ranks=ranks, **names)
    sums = table.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = {r["queue"]: int(r["n"]) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    order = sorted(totals)
    scaled = [round(targets.get(q, 0) * 1_000_000) for q in order] if targets else None if power == 1 else [max(1, round(totals[q] ** power * 1_000)) for q in order]
    number = {q: i for i, q in enumerate(order)}
    plan = ([totals[q] for q in order], scaled, window)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_all = F.sum("n").over(Window.partitionBy("queue"))
    starts = small(sums.select("queue", "part", before.cast("bigint").alias("part_start"), in_all.alias("in_all")))
    kind = table.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mix = Mixture(*plan)
        for b in batches:
            out: list[tuple] = []
            for doc, queue, start, n, width, raw in zip(b["doc_id"], b["queue"], b["at"], b["n"], b["width"], b["ids"], strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                done = 0
                while done < n:
                    _, place, left = mix.place(number[queue], start + done)
                    run = min(n - done, left)
                    while run:
                        k = min(run, length - place % length)
                        piece = ids[done : done + k].tobytes()
                        out.append((doc, done, k, zlib.crc32(piece), n, queue, place // length, place % length, *([piece] if with_ids else [])))
                        done, place, run = done + k, place + k, run - k
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "source", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    at = F.col("part_start") + F.col("start")
    rows = table.join(starts, ["queue", "part"])
    if len(totals) > QUEUES:
        rows = rows.withColumn("_share", at / F.col("in_all")).repartitionByRange("_share").sortWithinPartitions("_share")
    rows = rows.select("doc_id", "queue", at.alias("at"), "n", "width", "ids")
    return rows.mapInPandas(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, source string, sequence_id bigint, offset bigint" + ", ids binary" * with_ids)


def public_files() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


#: The mixture of the registered queries: weights go by the square root of a source's size.
POWER = 0.5


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs, **public_files(), power=POWER, with_ids=False)
