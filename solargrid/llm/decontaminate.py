"""Benchmark decontamination by spaced-seed hashing.

Words are runs of word characters, lower-cased, and each is known by a 64-bit hash. A fixed mask of SPAN positions ignores
some of them; the words at the others are hashed at every place of every benchmark item and of every document. Where a
document's hash equals an item's, both texts are aligned there and a window of WINDOW words around the hit (the whole item,
if it is shorter) is compared word by word: it is a leak when at least MATCH of its words are equal. Substituted words thus
do not hide a copy: of the 4845 ways to spread four substitutions over a window of 20 words, the masks find 4830 (0.997).

Documents are never shuffled for this: their places meet the items' seeds in a broadcast join inside generated code. Up to
BROADCAST_SEEDS seeds are broadcast; a larger benchmark is cut by hash into slices of about that many, and each slice is
joined in a pass of its own, so memory stays bounded whatever the benchmark.

An item of fewer than SPAN words is too short for a mask: it is a leak where all its words stand one after the other. The hash
of the whole item meets the hashes of as many words at every place, for each of the lengths that the benchmark has.

Nulls and odd input: null texts have no words, and an item without words is not tested. Rows with a null doc_id can be reported with it; repeated rows are reported once. Empty tables give an empty
result. Other columns are ignored, whatever they are called. without_leaks judges each row by its own text, also where
rows share a doc_id.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm.storage import input_partitions, stored

#: Words of a lower-cased text are ASCII letters and digits, and all characters beyond ASCII; this is what lies between.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed masks: 1 is compared, 0 is ignored.
MASKS = ("110100111", "111001011", "101110101")
SPAN = 9
WINDOW = 20
MATCH = 80  # per cent of a window's words
BROADCAST_SEEDS = 2_000_000
#: Rows found to leak are broadcast up to so many; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _words(text: str) -> str:
    """Hashes of a text's words. Splitting costs a fifth of extracting them, which copies the whole text for each match."""
    words = f"array_remove(split(lower(coalesce({text}, '')), '{BETWEEN}'), '')".replace("\\", "\\\\")
    return f"transform({words}, w -> xxhash64(w))"


def _places(d: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep and i, hash: a row for each place and mask of q_words."""
    # With the outer forms Spark does not test an array's size before it is laid down, which would build it a second time.
    first = F.expr(f"explode_outer(CASE WHEN size(q_words) >= {SPAN} THEN sequence(0, size(q_words) - {SPAN}) END)")
    d = d.select(*keep, "q_words", first.alias("i")).where("i IS NOT NULL")
    each = [f"xxhash64({k}, " + ", ".join(f"get(q_words, i + {j})" for j, x in enumerate(m) if x == "1") + ")" for k, m in enumerate(MASKS)]
    return d.select(*keep, "q_words", "i", F.expr(f"explode_outer(array({', '.join(each)}))").alias("hash"))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, item_id, b_words: the distinct items that can be tested; item stands for an id and its words."""
    b = benchmark.select(F.col(id_col).alias("item_id"), F.expr(_words(f"`{text_col}`")).alias("q_words")).where(F.size("q_words") > 0)
    b = b.select(F.xxhash64("item_id", "q_words").alias("item"), "item_id", F.col("q_words").alias("b_words"))
    return stored(b.dropDuplicates(["item"]), "benchmark-items")


def seeds_of(items: DataFrame) -> DataFrame:
    """hash, item, at: the distinct seeds of the items that masks fit in."""
    places = _places(items.select("item", F.col("b_words").alias("q_words")), "item")
    return stored(places.select("hash", "item", F.col("i").alias("at")), "benchmark-seeds")


def _sliced(seeds: DataFrame) -> list[DataFrame]:
    """Seeds in slices by hash, each small enough to be broadcast."""
    slices = -(-seeds.count() // BROADCAST_SEEDS) or 1
    return [seeds.where(F.pmod(F.xxhash64("hash"), F.lit(slices)) == k) for k in range(slices)] if slices > 1 else [seeds]


def short_hits(d: DataFrame, items: DataFrame, *keep: str) -> DataFrame | None:
    """The same as hits for items of fewer than SPAN words, which must stand there whole; None if there are none."""
    short = items.where(F.size("b_words") < SPAN).select("item_id", "b_words", F.expr("xxhash64(b_words)").alias("hash"))
    lengths = sorted(r["n"] for r in short.select(F.size("b_words").alias("n")).distinct().collect())  # SPAN - 1 at most
    if not lengths:
        return None
    first = F.expr(f"explode_outer(CASE WHEN size(q_words) >= {lengths[0]} THEN sequence(0, size(q_words) - {lengths[0]}) END)")
    each = ", ".join(f"CASE WHEN i + {n} <= size(q_words) THEN slice(q_words, i + 1, {n}) END" for n in lengths)
    places = d.select(*keep, "q_words", first.alias("i")).where("i IS NOT NULL").select(*keep, F.expr(f"explode_outer(array({each}))").alias("run"))
    places = places.where("run IS NOT NULL").select(*keep, "run", F.expr("xxhash64(run)").alias("hash"))
    out = []
    for part in _sliced(stored(short, "benchmark-short")):
        met = places.join(F.broadcast(part), "hash").where("run = b_words")
        out.append(met.select(*keep, "item_id", F.size("run").alias("compared"), F.size("run").alias("matched")))
    return functools.reduce(DataFrame.unionByName, out)


def hits(d: DataFrame, items: DataFrame, seeds: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep, item_id, matched (equal words of a window), compared (its words): a row for each window around a seed that leaks. d has q_words."""
    small = items.agg(F.coalesce(F.sum(F.size("b_words")), F.lit(0))).first()[0] <= BROADCAST_SEEDS
    b = F.broadcast(items) if small else items
    # Bit k says whether the words k - (WINDOW - SPAN) from the hit are equal; the rest is counting bits.
    ahead = WINDOW - SPAN
    equal = lambda k: f"(get(q_words, i + {k}) = get(b_words, at + {k}) AND i + {k} >= 0 AND at + {k} >= 0)"
    bits = " | ".join(f"shiftleft(CAST(coalesce({equal(k)}, false) AS BIGINT), {k + ahead})" for k in range(-ahead, WINDOW))
    size = f"least(size(b_words), {WINDOW})"
    # Windows of the item that hold the hit; each starts at most WINDOW - SPAN words before it.
    inside = lambda o: f"{o} BETWEEN greatest({SPAN} - compared, -at) AND least(0, n_words - compared - at)"
    best = ", ".join(f"CASE WHEN {inside(o)} THEN bit_count(shiftright(bits, {o + ahead}) & (shiftleft(1L, compared) - 1)) END" for o in range(-ahead, 1))
    short = short_hits(d, items, *keep)
    out = [] if short is None else [short]
    for part in _sliced(seeds):
        met = _places(d, *keep).join(F.broadcast(part), "hash")
        # Only the words around a hit leave the scan; hits are dealt out, so that a text full of them does not hold up a task.
        around = F.expr(f"slice(q_words, greatest(i - {ahead}, 0) + 1, {ahead + WINDOW})")
        met = met.select(*keep, "item", "at", F.expr(f"least(i, {ahead})").alias("i"), around.alias("q_words"))
        met = met.repartition(input_partitions(d.sparkSession), *keep, "item", "at").join(b, "item")
        met = met.select(*keep, "item_id", "at", F.expr(size).alias("compared"), F.size("b_words").alias("n_words"), F.expr(bits).alias("bits"))
        windows = met.select(*keep, "item_id", "compared", F.expr(f"explode_outer(array({best}))").alias("matched"))
        out.append(windows.where(f"matched * 100 >= compared * {MATCH}"))
    return functools.reduce(DataFrame.unionByName, out)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched (equal words in the best window), compared (words of that window) for every leak."""
    items = items_of(benchmark, item_col, item_text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.expr(_words(f"`{text_col}`")).alias("q_words"))
    found = hits(d, items, seeds_of(items), "doc_id")
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no passage of a benchmark item, with their own columns."""
    items = items_of(benchmark)
    text = F.xxhash64(F.col("text"))
    d = docs.select(F.col("doc_id").alias("k_id"), text.alias("k_text"), F.expr(_words("text")).alias("q_words"))
    bad = stored(hits(d, items, seeds_of(items), "k_id", "k_text").select("k_id", "k_text").distinct(), "leaking-rows")
    few = bad.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad["k_id"]) & (text == bad["k_text"]), "left_anti")


def _oracle() -> str:
    gram = lambda m, i: " || ' ' || ".join(f"words[{i} + {j + 1}]" for j, x in enumerate(m) if x == "1")
    rows = lambda t, key: " UNION ALL ".join(f"SELECT {key}, {k} AS mask, i, {gram(m, 'i')} AS gram FROM {t}" for k, m in enumerate(MASKS))
    return rf"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{BETWEEN.replace('[', '[^')}') AS words FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{BETWEEN.replace('[', '[^')}') AS words FROM documents),
bp AS (SELECT item_id, words, unnest(range(0, len(words) - {SPAN} + 1)) AS i FROM b WHERE len(words) >= {SPAN}),
dp AS (SELECT doc_id, words, unnest(range(0, len(words) - {SPAN} + 1)) AS i FROM d WHERE len(words) >= {SPAN}),
bs AS ({rows("bp", "item_id")}), ds AS ({rows("dp", "doc_id")}),
h AS (SELECT DISTINCT doc_id, item_id, bs.i AS bi, ds.i AS di FROM bs JOIN ds USING (mask, gram)),
o AS (SELECT h.*, b.words AS bw, d.words AS dw, least(len(b.words), {WINDOW}) AS w, unnest(range({SPAN - WINDOW}, 1)) AS o FROM h JOIN b USING (item_id) JOIN d USING (doc_id)),
short AS (SELECT item_id, len(words) AS w, array_to_string(words, ' ') AS gram FROM b WHERE len(words) BETWEEN 1 AND {SPAN - 1}),
sp AS (SELECT doc_id, words, w, unnest(range(1, len(words) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM short) WHERE len(words) >= w),
sm AS (SELECT DISTINCT doc_id, item_id, w, w AS matched FROM sp JOIN short USING (w) WHERE array_to_string(words[i:i + w - 1], ' ') = gram),
m AS (SELECT doc_id, item_id, w, len(list_filter(range(bi + o, bi + o + w), lambda j: j - bi + di >= 0 AND bw[j + 1] = dw[j - bi + di + 1])) AS matched FROM o
 WHERE bi + o >= 0 AND bi + o + w <= len(bw) AND o + w >= {SPAN})
SELECT doc_id, item_id, CAST(max(matched) AS INT) AS matched, CAST(any_value(w) AS INT) AS compared FROM (SELECT * FROM m UNION ALL SELECT * FROM sm) WHERE matched * 100 >= w * {MATCH} GROUP BY ALL"""


ORACLE = _oracle()
