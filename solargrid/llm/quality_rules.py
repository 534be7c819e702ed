"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Each statistic is an integer per document. A sketch is the table of counts of its logarithmic buckets (32 to each
power of two, so a quantile is right to about 3 %; small values are exact). Sketches merge by adding counts, so any split
of the input gives the same thresholds: one partial aggregation and one shuffle of a few rows for each group, however
large a group is. Then the thresholds are joined to the statistics and each document is judged.

A statistic's fences lie around the group's median: spread is the distance from the lower quartile to the median,
the half that junk (which sits in the upper half) does not move. A group of less than min_group documents takes the
fences of all documents together. All of it is DataFrame expressions.

Nulls and odd input: a null text has no words and fails the base rule (n_words < 50); so does an empty one. A null
language or source is a group of its own. Repeated rows each get their own result. An empty table gives an empty result.
Other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.llm.row_ids import carried, row_id
from solargrid.llm.storage import stored

#: ASCII white space between words, and the symbols that count.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

#: statistic: (spreads from the median to a fence, slack in the statistic's unit, has a lower fence)
FENCES = {
    "word_len_100": (8, 200, True),
    "symbols_1000": (8, 150, False),
    "upper_1000": (8, 250, False),
    "dup_lines_1000": (8, 400, False),
    "repeat_words_1000": (8, 450, False),
}
MIN_GROUP = 30


def split_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null gives an empty array."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text.

    For repeated words, each 3-word window is packed as hash bits over its position (as many low bits as the text
    needs), the packed longs are sorted, and windows next to an equal one are kept after comparing their words.
    """
    text = F.col("q_text")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    d = d.withColumn("q_words", split_words(text))
    d = d.withColumn("q_bits", F.expr("length(bin(CAST(size(q_words) AS BIGINT)))"))
    d = d.withColumn("q_sorted", F.expr("""
        CASE WHEN size(q_words) < 4 THEN CAST(array() AS ARRAY<BIGINT>)
        ELSE sort_array(transform(sequence(0, size(q_words) - 3),
             i -> shiftleft(xxhash64(q_words[i], q_words[i + 1], q_words[i + 2]), q_bits) | CAST(i AS BIGINT))) END"""))
    d = d.withColumn("q_at", F.expr("transform(q_sorted, x -> CAST(x & (shiftleft(1L, q_bits) - 1) AS INT))"))
    same = "(shiftright(q_sorted[{a}], q_bits) = shiftright(q_sorted[{b}], q_bits) AND q_words[q_at[{a}]] = q_words[q_at[{b}]] AND q_words[q_at[{a}] + 1] = q_words[q_at[{b}] + 1] AND q_words[q_at[{a}] + 2] = q_words[q_at[{b}] + 2])"
    d = d.withColumn("q_starts", F.expr(f"""
        CASE WHEN size(q_sorted) < 2 THEN CAST(array() AS ARRAY<INT>)
        ELSE sort_array(filter(q_at, (p, i) -> (i > 0 AND {same.format(a="i", b="i - 1")}) OR (i < size(q_at) - 1 AND {same.format(a="i", b="i + 1")}))) END"""))
    repeat = F.expr("aggregate(q_starts, named_struct('n', 0L, 'stop', 0), (s, p) -> named_struct('n', s.n + CAST(p + 3 - greatest(p, s.stop) AS BIGINT), 'stop', p + 3), s -> s.n)")
    d = d.withColumn("q_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    joined = F.array_join("q_words", "")
    return d.select(
        "doc_id", "lang", "source",
        F.size("q_words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_upper"),
    )


def statistics(s: DataFrame) -> DataFrame:
    """The integer statistics of FENCES from the base counts; null where a text has no words."""
    ratio = lambda a, b, k: F.when(F.col(b) > 0, F.expr(f"{a} * {k} div {b}"))
    return s.withColumns({
        "word_len_100": ratio("word_chars", "n_words", 100),
        "symbols_1000": ratio("n_symbols", "n_words", 1000),
        "upper_1000": ratio("n_upper", "word_chars", 1000),
        "dup_lines_1000": ratio("n_dup_lines", "n_lines", 1000),
        "repeat_words_1000": ratio("n_repeat_words", "n_words", 1000),
    })


def bucket(value: str) -> str:
    """SQL of a value's sketch bucket, named by its least value: the top six binary digits are kept."""
    drop = f"greatest(length(bin({value})) - 6, 0)"
    return f"shiftleft(shiftright({value}, {drop}), {drop})"


def sketches(stats: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group, statistic and bucket: the mergeable sketch."""
    pairs = ", ".join(f"'{x}', {x}" for x in FENCES)
    long = stats.select(*by, F.expr(f"stack({len(FENCES)}, {pairs}) AS (stat, value)")).where("value IS NOT NULL")
    return long.select(*by, "stat", F.expr(bucket("value")).alias("bucket")).groupBy(*by, "stat", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Lower quartile, median and number of documents of each group's statistics."""
    keys = [*by, "stat"]
    # The sketch has at most some hundred buckets for each group and statistic, so these windows are small.
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda share: F.min(F.when(F.expr(f"upto * 100 >= total * {share}"), F.col("bucket")))
    return run.groupBy(*keys).agg(at(25).alias("q25"), at(50).alias("q50"), F.max("total").alias("total"))


def thresholds(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and, for each statistic, its fences <stat>_lo and <stat>_hi."""
    by = ["lang", "source"]
    own_sketch = sketches(stats, by)
    own = quantiles(own_sketch, by)
    every = quantiles(own_sketch.groupBy("stat", "bucket").agg(F.sum("n").alias("n")), []).select("stat", F.col("q25").alias("all25"), F.col("q50").alias("all50"))
    q = own.join(F.broadcast(every), "stat")  # a row for each statistic
    few = F.col("total") < min_group
    q = q.withColumn("mid", F.when(few, F.col("all50")).otherwise(F.col("q50"))).withColumn("low", F.when(few, F.col("all25")).otherwise(F.col("q25")))
    aggs = []
    for stat, (k, slack, lower) in FENCES.items():
        of = F.col("stat") == stat
        reach = k * (F.col("mid") - F.col("low")) + slack
        aggs.append(F.max(F.when(of, F.col("mid") + reach)).alias(f"{stat}_hi"))
        if lower:
            aggs.append(F.max(F.when(of, F.col("mid") - reach)).alias(f"{stat}_lo"))
    return q.groupBy(*by).agg(*aggs)


def judged(docs: DataFrame, min_group: int = MIN_GROUP, **columns: str) -> DataFrame:
    """Base counts, base_failed and kept for every document."""
    stats = statistics(stored(base_statistics(docs, **columns), "quality-statistics"))
    fences = thresholds(stats, min_group)
    # One row for each language and source. Their number has no bound in general, so Spark chooses the join by its size.
    t = fences.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[x for x in fences.columns if x not in ("lang", "source")])
    j = stats.join(t, stats["lang"].eqNullSafe(t["t_lang"]) & stats["source"].eqNullSafe(t["t_source"]), "left")
    inside = F.lit(True)
    for stat, (_, _, lower) in FENCES.items():
        ok = F.col(stat) <= F.col(f"{stat}_hi")
        if lower:
            ok &= F.col(stat) >= F.col(f"{stat}_lo")
        inside &= F.coalesce(ok, F.lit(True))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of documents whose verdict is to keep them, with their own columns; each row is judged on its own text."""
    own = docs.select(row_id(docs).alias("q_id"), "text", "lang", "source")
    kept = judged(own, min_group, id_col="q_id").where("kept").select(F.col("doc_id").alias("q_id")).distinct()
    return carried(docs).join(kept, "q_id", "left_semi").select("q_row.*")


def _oracle() -> str:
    ratios = {"word_len_100": "word_chars * 100 // n_words", "symbols_1000": "n_symbols * 1000 // n_words", "upper_1000": "n_upper * 1000 // word_chars", "dup_lines_1000": "n_dup_lines * 1000 // n_lines", "repeat_words_1000": "n_repeat_words * 1000 // n_words"}
    long = " UNION ALL ".join(f"SELECT lang, source, '{x}' AS stat, {x} AS value FROM s WHERE {x} IS NOT NULL" for x in FENCES)
    rows = ", ".join(f"('{x}', {k}, {slack}, {'true' if lower else 'false'})" for x, (k, slack, lower) in FENCES.items())
    ok = " AND ".join(f"coalesce({x} <= (SELECT hi FROM f WHERE f.stat = '{x}' AND f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source), true)" + (f" AND coalesce({x} >= (SELECT lo FROM f WHERE f.stat = '{x}' AND f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source), true)" if lower else "") for x, (_, _, lower) in FENCES.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
s AS (SELECT *, {", ".join(f"CASE WHEN n_words > 0 THEN {v} END AS {k}" for k, v in ratios.items())} FROM b),
l AS ({long}),
k AS (SELECT lang, source, stat, value - value % (CAST(1 AS BIGINT) << greatest(length(bin(value)) - 6, 0)) AS bucket, count(*) AS n FROM l GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, stat ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, stat) AS total FROM k),
q AS (SELECT lang, source, stat, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS q25, min(CASE WHEN upto * 100 >= total * 50 THEN bucket END) AS q50, max(total) AS total FROM o GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY stat ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY stat) AS total FROM (SELECT stat, bucket, sum(n) AS n FROM k GROUP BY ALL)),
e AS (SELECT stat, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS a25, min(CASE WHEN upto * 100 >= total * 50 THEN bucket END) AS a50 FROM a GROUP BY ALL),
p(stat, k, slack, lower) AS (VALUES {rows}),
m AS (SELECT q.*, CASE WHEN total < {MIN_GROUP} THEN a50 ELSE q50 END AS mid, CASE WHEN total < {MIN_GROUP} THEN a25 ELSE q25 END AS low FROM q JOIN e USING (stat)),
f AS (SELECT lang, source, m.stat, mid + k * (mid - low) + slack AS hi, mid - k * (mid - low) - slack AS lo FROM m JOIN p ON p.stat = m.stat),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ok} AS inside FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM v"""


ORACLE = _oracle()
