"""What several operators share: table access, checked broadcasts, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.session import discard, written

#: Rows up to which a table of narrow rows (a few numbers each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint only if counting proves it small. Counting stops at the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: str | Column) -> Column:
    """128 bits that stand for a text: rows of equal text share them, whatever their ids. Null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, and no other letter. ASCII texts take the faster way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def _stars(e: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("x"))
    return ends.groupBy("x.n").agg(F.sum("x.up").alias("ups"), F.count(F.lit(1)).alias("all")).where("ups > 0 AND all > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """``id``, ``component``: the least id reachable over the links, for every id that has a link to another.

    Rounds of large-star and small-star: each joins every node with the least of its neighbours, so the rounds are about the
    logarithm of the longest chain, and a node with very many neighbours costs a row for each, dealt by skew-splittable
    joins. Each round is written to the shared folder, so that a lost executor costs no more than a round; the round before
    is deleted then.
    """
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "links")
    for _ in range(most):
        if _stars(e):
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: greater neighbours of u go to u's least
        large = e.select(F.col("u").alias("n"), F.col("v").alias("u")).join(least, "u").select(F.col("n").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v")
        # small star: u and its lesser neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v")
        after = written(tied.distinct(), "links")
        discard(e)
        e = after
    raise RuntimeError(f"components: no end after {most} rounds")


def extended(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups``, of ``components``, with further links (a written table of a, b): only the components that these join are closed anew."""
    if links.isEmpty():
        return groups
    of = lambda x: groups.select(F.col("id").alias(x), F.col("component").alias(f"_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    old = groups.join(joined.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return written(old.unionByName(joined.join(groups.select("id"), "id", "left_anti")), "groups")


def looked_up(left: DataFrame, right: DataFrame, key: list[str], many: Column, how: str = "left") -> DataFrame:
    """``left`` (a written table: it is read twice) joined with ``right``, of one row for each key, however many rows a key has in ``left``.

    ``many``: over ``right``, true for keys with more than a thousandth of the rows of ``left``, so for a thousand at most. These are
    broadcast, and their rows stay where they are; the others are dealt out by key.
    """
    hot = right.where(F.coalesce(many, F.lit(False)))
    if hot.isEmpty():
        return left.join(right, key, how)
    rest = left.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(right.where(~F.coalesce(many, F.lit(False))), key, how))
