"""Quality rules: word statistics of each document, and the frequency of lines across the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import small, text_key
from ordertide.session import written

#: A line is too frequent if more than this many distinct documents of its host hold it, and more than this share of them.
LIMIT_DOCS, LIMIT_SHARE = 20, 0.01
#: A document is depleted if fewer words are left without such lines, or a smaller share of its words.
LEAST_WORDS, LEAST_SHARE = 20, 0.3
REPEAT_WINDOW, MOST_REPEATED = 8, 30
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    # exact: a pair of ids becomes one rank at each doubling
    span, code = 1, w
    while span < window:
        step = min(span, window - span)
        m = len(words) - (span + step) + 1
        code = np.unique((code[:m] << np.uint64(32)) | code[step : step + m], return_inverse=True)[1].astype(np.uint64)
        span += step
    hit = np.bincount(code.astype(np.int64))[code.astype(np.int64)] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(_SPACE))
        else:
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), dup, repeated_words(words)


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its text_key and the five counts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = [c for c in docs.columns if c != text and c not in (*names, "text_key")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [base_of(t) for t in b.pop("_t")]
            yield b.assign(**{n: np.array([g[i] for g in got], np.int64) for i, n in enumerate(names)})

    rows = docs.select(*rest, text_key(text).alias("text_key"), F.col(text).alias("_t"))
    return rows.mapInPandas(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t"), *(f"{n} bigint" for n in names)]))


def normal_line(line: Column) -> Column:
    """Without outer space, in lower case, inner space runs as one."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """host, text_key, and each line with a word: at, line (64-bit hash), words."""
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_key(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    rows = rows.select("host", "text_key", "at", normal_line(F.col("raw")).alias("norm")).where("norm != ''")
    return rows.select("host", "text_key", "at", F.xxhash64("norm").alias("line"), F.size(F.split("norm", " ")).alias("words"))


def frequent_lines(docs: DataFrame, *, host: str = "source", text: str = "text", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """host, line: held by more distinct documents of the host than both limits allow.

    Exact copies of a document count once, so copies alone make no line frequent. Counting first merges what a task has, and
    then deals (host, line, document) by all three, so a hot host or line is spread.
    """
    each = _lines(docs, host, text).groupBy("host", "line", "text_key").agg(F.lit(1).alias("one"))
    per_line = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit_docs)
    of_host = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_key(text).alias("k")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    return per_line.join(of_host, "host").where(F.col("n") > F.col("all") * limit_share).select("host", "line")


def host_line_rules(docs: DataFrame, *, host: str = "source", text: str = "text", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """For each (host, text_key) with a line that is too frequent: removed (indexes of the lines) and removed_words."""
    # written first, as counting rows for the broadcast would run it once more
    frequent = small(written(frequent_lines(docs, host=host, text=text, limit_docs=limit_docs, limit_share=limit_share), "frequent"))
    gone = _lines(docs, host, text).join(frequent, ["host", "line"])
    return gone.groupBy("host", "text_key").agg(F.array_sort(F.collect_set(F.struct("at", "words"))).alias("_w")).select(
        "host", "text_key", F.transform("_w", lambda x: x["at"]).alias("removed"), F.aggregate("_w", F.lit(0), lambda a, x: a + x["words"]).cast("bigint").alias("removed_words")
    )


def judge(docs: DataFrame, *, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """Columns of ``docs`` but the text, with text_key, the five counts, base_failed, removed, removed_words, depleted and kept.

    Null text: no words, so base_failed. A null host is the host ''. Rows that repeat get the same verdict and count as one
    document in the line counts. Empty tables give empty results. ``docs`` columns of these names are replaced.
    """
    least_words, least_share = limits.get("least_words", LEAST_WORDS), limits.get("least_share", LEAST_SHARE)
    rules = host_line_rules(docs, host=host, text=text, **limits).withColumnRenamed("host", "_host")
    keep = docs.drop(*[c for c in ("base_failed", "removed", "removed_words", "depleted", "kept", "_host") if c in docs.columns and c not in (host, text)])
    m = base_metrics(keep.withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit(""))), text)
    both = m.join(rules, ["_host", "text_key"], "left").drop("_host")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    out = both.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    out = out.withColumn("depleted", (F.col("removed_words") > 0) & ((left < least_words) | (left < F.col("n_words") * least_share)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean(docs: DataFrame, *, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The documents that are kept, without their too frequent lines; columns as in ``docs``."""
    rejected_or_cut = judge(docs.select(host, text), host=host, text=text, **limits).where("NOT kept OR removed IS NOT NULL")
    v = rejected_or_cut.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_h"), F.col("text_key").alias("_k"), F.col("kept").alias("_kept"), F.col("removed").alias("_gone")).dropDuplicates(["_h", "_k"])
    both = docs.withColumn("_k", text_key(text)).withColumn("_h", F.coalesce(F.col(host).cast("string"), F.lit(""))).join(v, ["_h", "_k"], "left")
    cut = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return both.where("_kept IS NULL OR _kept").withColumn(text, F.when(F.col("_gone").isNotNull(), cut).otherwise(F.col(text))).select(*docs.columns)


def op6(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP6_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, {_WORDS.format("t")} AS w FROM d),
g AS MATERIALIZED (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(g.i, g.i + 8)) AS p FROM g JOIN (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1) m ON m.r = g.r AND m.g = g.g) GROUP BY r),
l AS MATERIALIZED (SELECT r, host, t, i, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
dup AS (SELECT r, count(*) AS n FROM (SELECT r, norm, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l) WHERE k > 1 AND norm <> '' GROUP BY r),
f AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM l WHERE norm <> '' GROUP BY ALL) JOIN (SELECT host, count(DISTINCT t) AS a FROM d GROUP BY host) USING (host)
  WHERE n > {LIMIT_DOCS} AND n > a * {LIMIT_SHARE}::DOUBLE),
cut AS (SELECT r, CAST(sum(len(string_split(norm, ' '))) AS BIGINT) AS n FROM l JOIN f USING (host, norm) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(cut.n, 0) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN cut USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {LEAST_WORDS} OR n_words - removed_words < n_words * {LEAST_SHARE}::DOUBLE)) AS kept FROM v"""
