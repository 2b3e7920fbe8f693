"""From buckets of candidates to connected groups, without emitting all pairs of a bucket.

1. Hubs: each member of a bucket is compared with the bucket's least id alone, a row for each member.
2. The links found are closed to components.
3. Then, of buckets whose members still lie in different components, either

   * all members are compared, as ``connect`` does without ``classes``: with a few more hubs, drawn by hash, and then in
     full, but only across components, and only members with a near sketch of another component. They meet in salted
     blocks, contents are compared inside the join, and only links leave it. Buckets of copies of one thing, which are the large
     ones, are one component by then and cost nothing here. So every pair that shares a bucket and whose sketches are near is either
     compared in full, or already connected; but the time grows with the square of a mixed bucket.
   * or, with ``linear``, they are compared with HUBS more hubs, a row for each member and hub. The time is in proportion to the
     members, however large a bucket. A pair is missed if in none of the buckets that it shares a hub is connected to both.

Where members have classes, a bucket is one for each class, so that members that can't be links don't meet, as large corpora have
ever more that share a block by chance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.llm.common import components, extended
from ordertide.session import discard, written

#: Members of a bucket that one block holds; hubs that a mixed bucket draws, or each class of it.
BLOCK, HUBS = 4096, 4


def shared_buckets(members: DataFrame, repeated: bool = False) -> DataFrame:
    """A written table of bucket, id, hub (least id) and n, for buckets of two members or more.

    ``members``: bucket and id, a pair once each, or, with ``repeated``, more often. With a column ``class``, members of a bucket meet if their classes are equal or neighbours:
    each lies in the bucket of its class and in that of the next. A column ``at``, if there is one, stays, and ``hub_at`` is the hub's.
    """
    places = ["at"] if "at" in members.columns else []
    if repeated:
        # most buckets are of one id: they go before repeated members do, and before members are dealt to classes. What members are made from is computed once, and they move once
        several = written(_several(members, "id").dropDuplicates(["bucket", "id"]), "members")
        out = shared_buckets(several)
        discard(several)
        return out
    # members move once, to be counted where they have come to, and only those of shared buckets go on
    dealt = members.repartition("bucket")
    count = [F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"), *[F.min(F.struct("id", "at"))["at"].alias("hub_at") for _ in places]]
    hub_at = [f"hub_{x}" for x in places]
    if "class" not in members.columns:
        shared = dealt.groupBy("bucket").agg(*count).where("n > 1")
        return written(dealt.join(shared.hint("shuffle_hash"), "bucket"), "buckets")
    # all of a bucket without a member of its own class lie in the bucket of the class before, too
    by_class = dealt.select("bucket", "id", *places, "class", F.explode(F.array("class", F.col("class") + 1)).alias("k")).groupBy("bucket", "k").agg(*count, F.max("class").alias("_own")).where("n > 1 AND _own = k")
    # joined by bucket alone, as its members lie: a row has as many entries as its members have classes, which grow with the logarithm of the lengths
    shared = by_class.groupBy("bucket").agg(F.collect_list(F.struct("k", "n", "hub", *hub_at)).alias("_all"))
    mine = dealt.join(shared.hint("shuffle_hash"), "bucket").select("bucket", "id", *places, F.explode(F.filter("_all", lambda c: c["k"].between(F.col("class"), F.col("class") + 1))).alias("_c"))
    return written(mine.select(F.xxhash64("bucket", "_c.k").alias("bucket"), "id", *places, "_c.hub", "_c.n", *[f"_c.{x}" for x in hub_at]), "buckets")


def _several(members: DataFrame, of: str) -> DataFrame:
    """Members of the buckets that hold more than one ``of``: sorted by bucket, so that they move once."""
    bucket = Window.partitionBy("bucket")
    return members.select("*", F.min(of).over(bucket).alias("_lo"), F.max(of).over(bucket).alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")


def connect(
    mine: DataFrame,
    sketches: DataFrame,
    near: Callable[[Column, Column], Column],
    contents: Callable[[DataFrame], DataFrame],
    linked: Callable[[Column, Column], Column],
    linear: bool = False,
    placed: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """``id``, ``component`` of every id with a link.

    ``mine``: of ``shared_buckets``; deleted at the end. ``sketches``: id, sketch. ``near``: whether two sketches may belong to a link.
    ``contents``: id and content of the ids in a table. ``linked``: whether two contents are a link. ``linear``: whether mixed
    buckets are compared with hubs alone. ``placed``, where ``mine`` has places: whether what two members share can be the same place of both, by the
    difference of the places and the sketches; null places may be any.
    """

    def fits(x: Column, y: Column, sx: Column, sy: Column) -> Column:
        """Near, and in place in this bucket."""
        return near(sx, sy) & F.coalesce(placed(x - y, sx, sy), F.lit(True)) if placed else near(sx, sy)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        held = written(contents(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "contents")
        both = pairs.join(held.select(F.col("id").alias("a"), F.col("content").alias("_a")), "a").join(held.select(F.col("id").alias("b"), F.col("content").alias("_b")), "b")
        out = written(both.where(linked(F.col("_a"), F.col("_b"))).select("a", "b"), "linked", few=False)
        discard(pairs, held)
        return out

    places = ["at"] if placed else []

    def sides(lab: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        """Members twice: each in one block of its bucket, and in all of them."""
        lab = lab.withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("bigint"))
        cols = lambda x: ["bucket", F.col("id").alias(x), F.col("c").alias(f"_c{x}"), F.col("sketch").alias(f"_s{x}"), *[F.col(m).alias(f"_{m}_{x}") for m in (*places, *more)]]
        return lab.select(*cols("a"), F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("_block")), lab.select(*cols("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"))

    def meet(left: DataFrame, right: DataFrame, once: bool = False, also: Column | None = None) -> Column:
        """Of one bucket, but not of one component, near, and in place; with ``once``, in the least such bucket of all that both have. Only then ``also`` is looked at: as a filter behind the join it would come first."""
        ok = fits(F.col("_at_a"), F.col("_at_b"), F.col("_sa"), F.col("_sb")) if placed else near(F.col("_sa"), F.col("_sb"))
        if once and placed:
            there = lambda x: F.exists("_all_b", lambda y: (x["bucket"] == y["bucket"]) & F.coalesce(placed(x["at"] - y["at"], F.col("_sa"), F.col("_sb")), F.lit(True)))
            least = F.array_min(F.transform(F.filter("_all_a", there), lambda x: x["bucket"]))
        elif once:
            least = F.array_min(F.array_intersect("_all_a.bucket", "_all_b.bucket"))
        no = F.lit(False)
        rest = also if also is not None else F.lit(True)
        ok = F.when(ok, F.when(least == left["bucket"], rest).otherwise(no) if once else rest).otherwise(no)
        return (left["bucket"] == right["bucket"]) & (left["_block"] == right["_block"]) & (F.col("_ca") != F.col("_cb")) & ok

    def promising(lab: DataFrame, *more: str) -> DataFrame:
        """Members that have a near one of another component in their bucket; if they bring ``all``, in no lesser one. Each asks for one, from the one block it lies in; pairs aren't emitted."""
        left, right = sides(lab, "n", *more)
        found = left.join(right, meet(left, right, "all" in more), "left_semi")
        return written(found.select("bucket", F.col("a").alias("id"), F.col("_n_a").alias("n"), F.col("_ca").alias("c"), F.col("_sa").alias("sketch"), *[F.col(f"_{m}_a").alias(m) for m in (*places, *more)]), "near")

    def to_hub(mine: DataFrame) -> DataFrame:
        a, b = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("_sa")), sketches.select(F.col("id").alias("b"), F.col("sketch").alias("_sb"))
        spokes = mine.where("id > hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), *[(F.col("at") - F.col("hub_at")).alias("_off") for _ in places]).distinct()
        ok = fits(F.col("_off"), F.lit(0), F.col("_sa"), F.col("_sb"))
        found = spokes.join(a, "a").join(b, "b").where(ok).select("a", "b")
        return verified(found.distinct() if placed else found)

    links = to_hub(mine)
    groups = components(links)
    discard(links)
    hubs = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("sketch").alias("sb"), *places)).alias(f"_{k}") for k in range(HUBS)]
    if linear:
        # members move by id, where they take component and sketch, and by bucket, where they meet their hubs: near pairs alone go on
        lab = mine.where("n > 2").join(groups, "id", "left").join(sketches, "id").select("bucket", "id", F.coalesce("component", "id").alias("c"), "sketch", *places).repartition("bucket")
        drawn = lab.groupBy("bucket").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), *hubs).where("_lo < _hi").select("bucket", F.array(*[f"_{k}" for k in range(HUBS)]).alias("_hubs"))
        spokes = lab.join(drawn.hint("shuffle_hash"), "bucket").select(F.col("id").alias("a"), "sketch", *places, F.explode(F.filter("_hubs", lambda h: h["cb"] != F.col("c"))).alias("_h"))
        more = verified(spokes.where(fits(F.col("at"), F.col("_h.at"), F.col("sketch"), F.col("_h.sb"))).select(F.greatest("a", "_h.b").alias("a"), F.least("a", "_h.b").alias("b")).distinct())
        discard(mine)
        groups = extended(groups, more)
        discard(more)
        return groups
    # two members were compared at once
    whole = mine.where("n > 2").join(groups, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"), *places)
    lab = promising(_several(whole, "c").join(sketches, "id"))
    discard(mine)
    if lab.isEmpty():
        return groups
    drawn = lab.groupBy("bucket").agg(*hubs).select("bucket", F.array(*[f"_{k}" for k in range(HUBS)]).alias("_hubs"))
    spokes = lab.join(drawn, "bucket").select(F.col("id").alias("a"), F.col("sketch").alias("_sa"), *places, F.explode(F.filter("_hubs", lambda h: h["cb"] != F.col("c"))).alias("_h"))
    spokes = spokes.where(fits(F.col("at"), F.col("_h.at"), F.col("_sa"), F.col("_h.sb"))).select(F.greatest("a", "_h.b").alias("a"), F.least("a", "_h.b").alias("b")).distinct()
    more = verified(spokes)
    groups = extended(groups, more)
    discard(more)

    before, lab = lab, promising(_several(lab.drop("c").join(groups, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "c"))
    discard(before)
    if lab.isEmpty():
        return groups
    # two that are near meet in each bucket that they share, so all of these are still here: the least is where they are compared
    before, lab = lab, promising(lab.join(lab.groupBy("id").agg(F.collect_list(F.struct("bucket", *places)).alias("all")), "id"), "all")
    discard(before)
    held = written(contents(lab.select("id").distinct()), "contents")
    # a member brings its content to each of its buckets: some buckets at a time, so that no more members move at once than there are contents
    turns, found = -(-lab.count() // max(held.count(), 1)), []
    for turn in range(turns):
        left, right = sides(lab.where(F.pmod(F.xxhash64("bucket", F.lit(turns)), F.lit(turns)) == turn).join(held, "id"), "all", "content")
        pairs = left.join(right, (F.col("a") > F.col("b")) & meet(left, right, True, linked(F.col("_content_a"), F.col("_content_b"))))
        found.append(written(pairs.select("a", "b"), "linked", few=False))
    discard(lab, held)
    links = written(reduce(DataFrame.unionByName, found), "linked")
    discard(*found)
    return extended(groups, links)
