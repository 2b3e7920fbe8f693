"""Benchmark decontamination: a hash set of the test items' word windows is looked up at every word of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import ascii_lower, text_key
from ordertide.session import written

#: Words of a window, and windows of test items up to which their hash set is broadcast.
WINDOW = 10
MOST_WINDOWS = 500_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, and its complement.
_BETWEEN_ANY, _WORD_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case (A-Z) runs of ASCII letters, digits and all characters beyond ASCII. Null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _hash(words: str, at: str, n: int) -> Column:
    return F.xxhash64(*[F.expr(f"{words}[{at} + {j}]") for j in range(n)])


def item_windows(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: length, words, hash and the items that hold them. An item of fewer words, but not none, is one window."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(window)))
    at = rows.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    return at.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("win")).groupBy("len", "win").agg(F.collect_set("item").alias("items")).withColumn("key", F.xxhash64("win"))


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """For each distinct text with a hit: text_key, starts (word index and length of each occurrence) and items.

    One pass over the words, in generated code: each position's hash is looked up in the broadcast set, and equal hashes are
    verified word by word. Occurrences combine in the task that found them. If the test items have more than MOST_WINDOWS
    windows, the set isn't broadcast: positions and hashes are dealt out, without words, and hits are verified on the texts that have one. Null and empty texts, and empty tables on either side, give no row.
    """
    windows = written(item_windows(benchmark, item=item, text=item_text, window=window), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most ``window`` numbers
    rows = docs.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    rows = rows.select(text_key("_t").alias("text_key"), words_of(F.col("_t")).alias("w"))
    if not lengths:
        return rows.where("false").select("text_key", F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"))).alias("starts"), F.array(F.lit("")).alias("items"))
    at = rows.where(F.size("w") >= lengths[0]).select("text_key", "w", F.explode(F.sequence(F.lit(0), F.size("w") - lengths[0])).alias("i"))
    if len(lengths) == 1:
        at = at.select("text_key", "w", "i", F.lit(lengths[0]).alias("len"), _hash("w", "i", lengths[0]).alias("key"))
    else:  # one pass for all lengths
        keys = [F.struct(F.lit(n).alias("len"), F.when(F.col("i") + n <= F.size("w"), _hash("w", "i", n)).alias("key")) for n in lengths]
        at = at.select("text_key", "w", "i", F.explode(F.array(*keys)).alias("k")).where("k.key IS NOT NULL").select("text_key", "w", "i", "k.len", "k.key")
    same = F.slice("w", F.col("i") + 1, F.col("len")) == F.col("win")
    if windows.count() <= most_windows:
        found = at.join(F.broadcast(windows), ["len", "key"]).where(same).select("text_key", F.struct("i", F.col("len").alias("n")).alias("at"), "items")
    else:  # the join moves hashes alone; the few texts with a hit are fetched once and verified
        hits = at.select("text_key", "i", "len", "key").distinct().join(windows, ["len", "key"])
        per = hits.groupBy("text_key").agg(F.collect_list(F.struct("i", "len", "win", "items")).alias("_h"))
        both = rows.dropDuplicates(["text_key"]).join(per, "text_key").select("text_key", F.filter("_h", lambda h: F.slice("w", h["i"] + 1, h["len"]) == h["win"]).alias("_h"))
        found = both.select("text_key", F.explode("_h").alias("h")).select("text_key", F.struct("h.i", F.col("h.len").alias("n")).alias("at"), "h.items")
    return found.groupBy("text_key").agg(F.collect_set("at").alias("starts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered(starts: Column) -> Column:
    """Distinct word indexes inside the occurrences."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", mode: str = "spans", most_share: float = 0.5, **names) -> DataFrame:
    """Documents without the test items' passages. All columns of ``docs`` stay.

    ``spans``: cuts from the text each run of hit words, with all between its first and last character; a document of which
    more than ``most_share`` of the words are hit goes whole. ``documents``: every document with a hit goes.
    Documents without a hit stay as they are, null texts too. Rows that repeat are treated alike.
    """
    hit = find(docs, benchmark, text=text, **names).select(F.col("text_key").alias("_key"), F.array_sort(_covered(F.col("starts"))).alias("_hit"))
    both = docs.withColumn("_key", text_key(text)).join(hit, "_key", "left").drop("_key")
    if mode == "documents":
        return both.where("_hit IS NULL").drop("_hit")
    if mode != "spans":
        raise ValueError(mode)
    # the text as (gap, word, gap, word, ..., gap): splitting at words gives the gaps, and both lists alternate.
    # What lambdas use are columns of the join or the zipped elements, as an expression inside a lambda runs for every element
    words, gaps = F.array_remove(F.split(text, _BETWEEN_ANY), ""), F.split(text, _WORD_ANY)
    inside = lambda shift: F.transform(words, lambda w, i: F.array_contains("_hit", i + shift))
    parts = F.arrays_zip(words, F.slice(gaps, F.lit(1), F.size(words)), inside(0), inside(-1))
    # gap i stands before word i; it goes if the words on both its sides do
    piece = F.transform(parts, lambda x: F.concat(F.when(x["2"] & x["3"], F.lit("")).otherwise(x["1"]), F.when(x["2"], F.lit("")).otherwise(x["0"])))
    cut = F.concat(F.array_join(piece, ""), F.element_at(gaps, -1))
    kept = both.where(F.col("_hit").isNull() | (F.size("_hit") <= F.size(words) * float(most_share)))
    return kept.withColumn(text, F.when(F.col("_hit").isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = find(docs, benchmark).select(
        "text_key", F.size(_covered(F.col("starts"))).cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items")
    )
    rows = docs.select("doc_id", text_key("text").alias("text_key"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    both = rows.join(hits, "text_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return both.select("doc_id", "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"))


_W = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_W.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS MATERIALIZED (SELECT item, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT DISTINCT pos.r, pos.i, pos.n, bw.item FROM pos JOIN bw ON bw.n = pos.n AND bw.win = pos.win),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
