"""The trie of conversations' first turns: which prefixes are shared, by whom, and what sharing them saves.

A node is a distinct sequence of first turns; its owner is the least conversation that starts with it. A conversation that owns a
node owns all deeper nodes of its path, so what it owns is a chain, from its first owned depth to its end. That depth is found by
binary search: in each round all conversations look the digest of one prefix up in the table of digests with their least
conversation. Chains hang on the chain that owns the prefix above them; subtree sums go up the chains, twice as far in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import looked_up
from ordertide.llm.scan import laid, running
from ordertide.session import discard, written

_KEY = ["depth", "d1", "d2"]


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, th (digest of role and text) and chars."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    th = F.unhex(F.md5(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t)))
    return rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), th.alias("th"), F.char_length(t).cast("bigint").alias("chars"))


def _placed(turns: DataFrame, what: str) -> DataFrame:
    """A written table of the turns with ``depth``, 1 and on, in place of ``turn``. Turns go by number, null first, and then by digest."""
    lying = laid(turns, "conv_id", ["turn", "th"], what)
    out = written(running(lying, "conv_id", ["turn", "th"], {"depth": F.lit(1).cast("bigint")}).drop("turn"), what)
    discard(lying)
    return out


def _paths(placed: DataFrame) -> DataFrame:
    """A written table with the digest of each prefix: sums of 32 bits in four lanes, of hashes of place and turn."""
    low = 0xFFFFFFFF
    lanes = {}
    for i in (1, 2):
        h = F.xxhash64("th", "depth", F.lit(i))
        lanes |= {f"_l{i}": F.shiftrightunsigned(h, 32), f"_h{i}": h.bitwiseAND(F.lit(low))}
    sums = running(placed, "conv_id", ["depth"], lanes)
    word = lambda i: F.shiftleft(F.col(f"_l{i}").bitwiseAND(F.lit(low)), 32).bitwiseOR(F.col(f"_h{i}").bitwiseAND(F.lit(low)))
    return written(sums.select("conv_id", "depth", word(1).alias("d1"), word(2).alias("d2"), "chars", "_run"), "paths")


def _thousandth(n: int) -> int:
    return max(n // 1000, 1)


def _first_owned(paths: DataFrame, minima: DataFrame, convs: DataFrame, least: int) -> DataFrame:
    """conv_id, first (owned depth, beyond the end if none is), n and above (who owns the prefix before): all but ``least``, which owns all that it has."""
    rows, all_convs = paths.count(), convs.count()
    long = F.col("n") > _thousandth(rows)
    start = looked_up(paths.select("conv_id", *_KEY), convs.where(F.col("conv_id") != least), ["conv_id"], long, "inner")
    left = written(start.select("*", F.lit(1).cast("bigint").alias("lo"), (F.col("n") + 1).alias("hi"), F.lit(least).cast("bigint").alias("above")), "search")
    found = []
    while not left.isEmpty():
        middle = F.expr("(lo + hi) div 2")
        probe = written(left.where(F.col("depth") == middle), "probe")
        said = looked_up(probe, minima, _KEY, F.col("n_convs") > _thousandth(all_convs))
        owned = F.coalesce("owner", "conv_id") == F.col("conv_id")
        now = said.select(
            "conv_id", "n", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"),
            F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"),
        )
        now = written(now, "bounds")
        found.append(now.where("lo = hi").select("conv_id", F.col("lo").alias("first"), "n", "above"))
        open_ = now.where("lo < hi").drop("n")
        after = looked_up(left.drop("lo", "hi", "above"), open_, ["conv_id"], F.col("hi") - F.col("lo") > _thousandth(rows), "inner")
        after = written(after.where("depth >= lo AND depth < hi"), "search")
        discard(left, probe)
        left = after
    return reduce(DataFrame.unionByName, found) if found else start.select("conv_id", F.col("depth").alias("first"), "n", F.col("conv_id").alias("above")).limit(0)


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """depth, d1, d2 and the digest of the ids that end there, ascending and joined by commas.

    The digest goes through a node's ids in order, so one task makes it, a piece at a time; ranges of ids are joined to pieces before.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = list(zip(*(b.column(k).to_pylist() for k in _KEY), strict=True)), b.column("conv_id").to_pylist()
            out, at = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or keys[i] != keys[at]:
                    out.append((*keys[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*_KEY, "at", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        done: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*_KEY, "ends_sha256"])

        for b in batches:
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if k == key:
                    h.update(b"," + ids.encode())
                    continue
                if h:
                    done.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            if len(done) > 10_000:
                yield batch(done)
                done = []
        if h:
            done.append((*key, h.hexdigest()))
        if done:
            yield batch(done)

    cut = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    parts = cut.mapInArrow(pieces, "depth bigint, d1 bigint, d2 bigint, at bigint, ids string")
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "at").mapInArrow(digests, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string")


def _up_the_chains(chains: DataFrame) -> DataFrame:
    """conv_id, saved, leaves: over a chain and all below it. ``chains``: conv_id, up (its parent chain, or null), saved and leaves of its own."""
    all_chains = chains.count()
    now = written(chains.select("conv_id", "up", "saved", "leaves"), "sums")
    while not now.where("up IS NOT NULL").isEmpty():
        # what lies less than 2^i below is summed, and ``up`` is 2^i above: then the same for i + 1
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"), F.count(F.lit(1)).alias("_n"))
        summed = written(now.join(below, "conv_id", "left").select("conv_id", "up", (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), "_n"), "sums")
        above = summed.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"), F.col("_n").alias("_m"))
        after = written(looked_up(summed, above, ["up"], F.col("_m") > _thousandth(all_chains)).select("conv_id", F.col("_up").alias("up"), "saved", "leaves"), "sums")
        discard(now, summed)
        now = after
    return now.select("conv_id", "saved", "leaves")


def _nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie over ``turns`` (of ``_turns``) of the conversations in ``members`` (conv_id, once each), turnless ones included."""
    placed = _placed(turns, "placed")
    paths = _paths(placed)
    discard(placed)
    ends = paths.groupBy("conv_id").agg(F.max("depth").alias("n"))
    convs = written(members.join(ends, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n")), "conversations")
    whole = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    least, n_convs = whole[0] if whole[0] is not None else 0, whole[1]
    minima = written(paths.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 1"), "minima")

    first = convs.where(F.col("conv_id") == least).select("conv_id", F.lit(0).cast("bigint").alias("first"), "n", F.lit(None).cast("bigint").alias("above"))
    chains = written(first.unionByName(_first_owned(paths, minima, convs, least)).where("first <= n"), "chains")
    long = F.col("n") - F.col("first") > _thousandth(paths.count())
    mine = looked_up(paths, chains, ["conv_id"], long, "inner").where("depth >= first")
    mine = mine.join(minima.select(*_KEY, "n_convs"), _KEY, "left").withColumn("n_convs", F.coalesce("n_convs", F.lit(1).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    root = first.select("conv_id", *[zero.alias(c) for c in _KEY], zero.alias("chars"), F.lit(-1).alias("_run"), "first", "n", "above", F.lit(n_convs).cast("bigint").alias("n_convs"))
    hung = chains.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    own = mine.unionByName(root).join(hung, ["conv_id", "depth"], "left").withColumn("hung", F.coalesce("hung", zero))
    leaf = ((F.col("hung") == 0) & (F.col("depth") == F.col("n"))).cast("bigint")
    own = written(own.select("*", ((F.col("n_convs") - 1) * F.col("chars")).alias("_saved"), leaf.alias("_leaf")), "own")

    alone = own.groupBy("conv_id").agg(F.sum("_saved").alias("saved"), F.sum("_leaf").alias("leaves"))
    sums = _up_the_chains(chains.select("conv_id", F.col("above").alias("up")).join(alone, "conv_id"))
    at_top = chains.select("conv_id", "above", "first", "n").join(sums, "conv_id")
    from_hung = at_top.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("_hs"), F.sum("leaves").alias("_hl"))
    full = looked_up(own, at_top.select("conv_id", "saved", "leaves", F.col("n").alias("_n"), F.col("first").alias("_f")), ["conv_id"], F.col("_n") - F.col("_f") > _thousandth(own.count()), "inner").drop("_n", "_f")
    full = full.join(from_hung, ["conv_id", "depth"], "left").withColumns({"_s": F.col("_saved") + F.coalesce("_hs", F.lit(0)), "_l": F.col("_leaf") + F.coalesce("_hl", F.lit(0))})
    full = written(full, "nodes")
    # a chain's total less what lies before the node
    down = running(full, "conv_id", ["depth"], {"_ps": F.col("_s"), "_pl": F.col("_l")})
    at_end = looked_up(paths.select("conv_id", *_KEY), convs, ["conv_id"], F.col("n") > _thousandth(paths.count()), "inner").where("depth = n").select("conv_id", *_KEY)
    at_end = at_end.unionByName(convs.where("n = 0").select("conv_id", *[zero.alias(c) for c in _KEY]))
    return down.join(_digests_of_ends(at_end), _KEY, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        (F.col("hung") + (F.col("depth") < F.col("n")).cast("bigint")).alias("n_children"), (F.col("leaves") - F.col("_pl") + F.col("_l")).alias("n_leaves"),
        (F.col("saved") - F.col("_ps") + F.col("_s")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns, the textless root included: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves and saved_tokens (of the node and all below it), ends_sha256 (of the conversations that end there).

    Turns go by (turn, null first; then a digest of role and text), so ties and repeated rows have a fixed order and all stay. Null
    roles and texts are empty. Rows without a conversation belong to none. No rows give no node, and no root. Very long texts are hashed
    whole and don't move; very long conversations lie in several tasks. Prefixes are equal by 128 bits. Other columns don't matter.
    """
    return _nodes(_turns(rows, conv, turn, role, text), rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv_id")).distinct())


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the contract's conversations, which take their first turns from another."""
    placed = _placed(_turns(conversations, "conv_id", "turn", "role", "text"), "turns")
    donor: Column = F.col("conv_id") - F.col("conv_id") % 100
    sizes = written(placed.groupBy("conv_id").agg(F.max("depth").alias("n")), "sizes")
    info = sizes.select("conv_id", "n", donor.alias("donor"), (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"))
    info = info.join(sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("_n")), "donor", "left").withColumn("given", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n")
    info = written(info, "given")
    own = looked_up(placed, info, ["conv_id"], F.col("n") > _thousandth(placed.count()), "inner").where("depth > h")
    own = own.select("conv_id", (F.col("given") + F.col("depth") - F.col("h")).alias("turn"), "th", "chars")
    heads = placed.where("depth <= 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("donor"), "depth", "th", "chars")
    taken = info.select("conv_id", "donor", "given").join(heads, "donor").where("depth <= given").select("conv_id", F.col("depth").alias("turn"), "th", "chars")
    return own.unionByName(taken), info.select("conv_id")


def op11(conversations: DataFrame) -> DataFrame:
    return _nodes(*_rebuilt(conversations))


#: crc32 bit by bit, and prefixes as digests of joined digests.
OP11_SQL = """WITH t AS (SELECT conv_id, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS th, turn FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, th) AS depth FROM t),
ids AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS donor, list_transform(range(8 * length(CAST(conv_id AS VARCHAR))),
  lambda i: CAST((ascii(CAST(conv_id AS VARCHAR)[i // 8 + 1]) >> (i % 8)) & 1 AS BIGINT)) AS bits FROM p GROUP BY conv_id),
hs AS (SELECT conv_id, n, donor, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bits), lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h FROM ids),
g AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS given FROM hs a LEFT JOIN hs b ON b.conv_id = a.donor),
r AS (SELECT p.conv_id, g.given + p.depth - g.h AS depth, th, chars FROM p JOIN g USING (conv_id) WHERE p.depth > g.h
  UNION ALL SELECT g.conv_id, p.depth, th, chars FROM g JOIN p ON p.conv_id = g.donor AND p.depth <= g.given),
x AS (SELECT conv_id, depth, chars, md5(string_agg(th, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS d FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM g),
node AS (SELECT depth, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM x GROUP BY depth, d),
linked AS (SELECT n.*, u.conv_id AS parent, u.d AS pd FROM node n LEFT JOIN x ON x.conv_id = n.conv_id AND x.depth = n.depth - 1 LEFT JOIN node u ON u.depth = x.depth AND u.d = x.d),
kids AS (SELECT depth - 1 AS depth, pd AS d, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.depth = l.depth AND k.d = l.d),
under AS (SELECT x.depth, x.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved FROM full_ f JOIN x ON x.conv_id = f.conv_id AND x.depth <= f.depth GROUP BY x.depth, x.d),
last_ AS (SELECT conv_id, max(depth) AS depth FROM x GROUP BY conv_id),
ends AS (SELECT x.depth, x.d, sha256(string_agg(CAST(x.conv_id AS VARCHAR), ',' ORDER BY x.conv_id)) AS s FROM x JOIN last_ USING (conv_id, depth) GROUP BY x.depth, x.d)
SELECT f.conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM full_ f JOIN under u ON u.depth = f.depth AND u.d = f.d LEFT JOIN ends e ON e.depth = f.depth AND e.d = f.d"""
