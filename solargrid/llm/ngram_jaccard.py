"""N-gram Jaccard join by chosen paths.

A document is its set of hashed five-word shingles; a link joins two documents whose sets have a Jaccard similarity of
THRESHOLD or more. Documents with equal sets form a class, which takes part once, with its number of copies.

Chosen paths: in each of RUNS runs a set goes to the buckets of those of its shingles whose hash in that run is below
1 / (THRESHOLD * size). Two similar sets choose a shared shingle with an expected number of one or more in each run. A bucket
of more than LARGE sets is split in the same way again, by shingles chosen anew under that bucket, and so on; a bucket
that does not fall apart (its largest child holds half of it, so its sets are alike) or is LEVELS deep is taken as it is.
What is left is compared by brute force, a bucket of more than BLOCK sets in pairs of blocks.

The chosen buckets of a set are also its sketch: a pair is compared only in the first bucket that both chose, and only if
they chose SHARED buckets in common. With 14 runs a pair of similarity 0.8 chooses 14 common buckets or more on average;
fewer than SHARED have a chance of 1.2e-5, which meets the target recall of 0.9999; each level of splitting misses 1e-6
more. Pairs that pass are verified on the whole sets. Pairs never become rows: a task returns, for each set, its number of links
and one edge to a set that the task's links join it to, from which components are made.

Shingle sets are kept as 40-bit hashes, of which two in a pair of documents of a thousand words collide once in a million.

Nulls and odd input: null texts and texts without words have no set: they are alone, with no link. A text of one to four
words has one shingle. Rows are documents: repeated rows are copies of each other. A null doc_id takes part and is
returned; a group is named by its smallest doc_id that is not null. Empty tables give an empty result. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm.components import components
from solargrid.llm.key_filter import passing
from solargrid.llm.row_ids import carried, row_id
from solargrid.llm.shingles import P, blocks, mix, shingles, texts
from solargrid.llm.storage import input_partitions, stored

WORDS = 5
THRESHOLD = 0.8
RUNS = 14
SHARED = 2
LARGE = 4096
LEVELS = 3
BLOCK = 1024
#: Shingles or buckets that are compared at once in a task.
COLUMNS = 2048
#: A multiplier for each run.
MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(P)) | np.uint64(1)


def pack(tokens: np.ndarray) -> bytes:
    """Five bytes for each 40-bit hash."""
    return (tokens >> np.uint64(8)).astype(np.uint32).tobytes() + (tokens & np.uint64(255)).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return (np.frombuffer(data, np.uint32, n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(data, np.uint8, n, 4 * n)


def choose(tokens: np.ndarray, seed: int, runs: int) -> np.ndarray:
    """The buckets that a set chooses in all runs: 32-bit names under a seed (the bucket above)."""
    if not len(tokens):
        return np.zeros(0, np.uint32)
    limit = np.uint64(min(2**64 - 1, int(2**64 / (THRESHOLD * len(tokens)))))
    g = mix(tokens ^ np.uint64(seed & (2**64 - 1)))
    out = []
    for k in range(runs):
        x = g * MULTIPLIERS[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(P)
        out.append((mix(g[x < limit] + np.uint64(k)) >> np.uint64(32)).astype(np.uint32))
    return np.unique(np.concatenate(out))


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, runs: int) -> DataFrame:
    """doc_id, cls (16 bytes that stand for the set), n, chosen (buckets) and tokens for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts(b.column(1))
            for i, j in blocks(offsets):
                part = [np.unique(t >> np.uint64(24)) for t in shingles(data, offsets[i : j + 1], words)]
                cls = [mix(t).sum(dtype=np.uint64).tobytes() + mix(t ^ np.uint64(P)).sum(dtype=np.uint64).tobytes() for t in part]
                chosen = [choose(t, 0, runs).view(np.int32) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(cls, pa.binary()), pa.array([len(t) for t in part], pa.int32()), pa.array(chosen, pa.list_(pa.int32())), pa.array([pack(t) for t in part], pa.binary())],
                    ["doc_id", "cls", "n", "chosen", "tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, cls binary, n int, chosen array<int>, tokens binary")


def leaves(classes: DataFrame, tokens: DataFrame, runs: int) -> DataFrame:
    """A row for each class and bucket to compare it in.

    bucket, m (the bucket's sets), cls, first_id, n, copies, sigs (what the set chose at each level), path (the buckets
    taken). classes has cls, first_id, n, copies and chosen; tokens has cls, doc_id and tokens.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [choose(unpack(t), a, runs).view(np.int32) for t, a in zip(b.column(0).to_pylist(), b.column(6).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(1, 9)], pa.array(new, pa.list_(pa.int32()))], [*b.schema.names[1:9], "chosen"])

    kind = classes.schema["first_id"].dataType.simpleString()
    rows = classes.select("cls", "first_id", "n", "copies", F.array("chosen").alias("sigs"), F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("m_above"), F.array().cast("array<int>").alias("path"))
    done, parents = [], None
    for level in range(LEVELS):
        own = rows.select("cls", "above", "m_above", F.explode(F.element_at("sigs", -1)).alias("name")).withColumn("bucket", F.xxhash64("above", "name"))
        if level:
            # A bucket that does not fall apart is compared as it is.
            whole = stored(own.groupBy("above", "m_above", "bucket").count().where("count * 2 >= m_above").select("above").distinct(), "whole-buckets")
            done.append(parents.join(whole.withColumnRenamed("above", "bucket"), "bucket", "left_semi"))
            own = own.join(whole, "above", "left_anti")
        sizes = own.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
        sized = stored(own.join(sizes, "bucket").select("bucket", "m", "name", "cls", "above"), "sized-buckets")
        full = sized.join(rows.drop("m_above"), ["cls", "above"]).withColumn("path", F.array_append("path", F.col("name"))).select("bucket", "m", "cls", "first_id", "n", "copies", "sigs", "path")
        large = F.col("m") > LARGE
        if level == LEVELS - 1 or sized.where(large).isEmpty():
            done.append(full)
            break
        done.append(full.where(~large))
        parents = stored(full.where(large), "large-buckets")
        t = passing(tokens.select("cls", "doc_id", "tokens", F.xxhash64("cls").alias("q_key")), parents.select(F.xxhash64("cls").alias("q_key")).distinct())
        t = t.where("q_hit").select("cls", "doc_id", "tokens")  # only the sets to split are shuffled
        mine = parents.join(t, (parents["cls"] == t["cls"]) & parents["first_id"].eqNullSafe(t["doc_id"])).drop(t["cls"]).dropDuplicates(["bucket", "cls"])
        mine = mine.select("tokens", "cls", "first_id", "n", "copies", "sigs", F.col("bucket").alias("above"), F.col("m").alias("m_above"), "path")
        chosen = mine.mapInArrow(split, f"cls binary, first_id {kind}, n int, copies long, sigs array<array<int>>, above long, m_above long, path array<int>, chosen array<int>")
        rows = stored(chosen.withColumn("sigs", F.array_append("sigs", F.col("chosen"))).drop("chosen"), "split-buckets")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def tasks(rows: DataFrame) -> DataFrame:
    """Deal buckets out: task (bucket and a pair of its blocks), side (the row's block)."""
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("cls"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    both = F.least("side", "other"), F.greatest("side", "other")
    return rows.withColumn("task", F.xxhash64("bucket", *both)).withColumn("apart", both[0] != both[1]).drop("other", "m")


def candidates(n: np.ndarray, sigs: list, path: list, side: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task's rows to verify: SHARED choices in common, of which this bucket is the first, and fitting sizes."""
    size = len(n)
    ok = np.triu(np.ones((size, size), dtype=bool), 1)
    ok &= np.minimum(n[:, None], n[None, :]) >= THRESHOLD * np.maximum(n[:, None], n[None, :])
    if apart:
        ok &= side[:, None] != side[None, :]
    for level, here in enumerate(path):
        rows = np.repeat(np.arange(size), [len(s[level]) for s in sigs])
        kinds, at = np.unique(np.concatenate([s[level] for s in sigs]), return_inverse=True)
        common = np.bincount(at, minlength=len(kinds)) > 1
        column = np.cumsum(common) - 1
        rows, column, width = rows[common[at]], column[at[common[at]]], int(common.sum())
        before = int(np.searchsorted(kinds[common], here))
        shared = np.zeros((size, size), dtype=np.float32)
        for start, stop in [(k, min(k + COLUMNS, before)) for k in range(0, before, COLUMNS)] + [(k, min(k + COLUMNS, width)) for k in range(before, width, COLUMNS)]:
            if start == before:
                ok &= shared == 0  # no bucket before this one is common
                if level:
                    break
            on = (column >= start) & (column < stop)
            held = np.zeros((size, stop - start), dtype=np.float32)
            held[rows[on], column[on] - start] = 1
            shared += held @ held.T
        if not level:
            ok &= shared >= SHARED
    return np.nonzero(ok)


def verified(n: np.ndarray, tokens: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets reach THRESHOLD."""
    if len(a) <= 16:
        shared = np.array([len(np.intersect1d(tokens[i], tokens[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    else:
        rows = np.repeat(np.arange(len(n)), n)
        kinds, at = np.unique(np.concatenate(tokens), return_inverse=True)
        common = np.bincount(at, minlength=len(kinds)) > 1
        column = np.cumsum(common) - 1
        total, width = np.zeros((len(n), len(n)), dtype=np.float32), int(common.sum())
        for start in range(0, width, COLUMNS):
            on = common[at] & (column[at] >= start) & (column[at] < start + COLUMNS)
            held = np.zeros((len(n), min(COLUMNS, width - start)), dtype=np.float32)
            held[rows[on], column[at[on]] - start] = 1
            total += held @ held.T
        shared = total[a, b]
    keep = shared >= THRESHOLD * (n[a] + n[b] - shared) - 1e-9
    return a[keep], b[keep]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs (a, b) join it to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal task in batches sorted by it; one run at a time is held."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        task = b.column(0).to_numpy()
        cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
        edges = [0, *cuts.tolist(), len(task)]
        for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if held and (k or held[-1].column(0)[0].as_py() != int(task[0])):
                yield held[0] if len(held) == 1 else pa.concat_tables(held)
                held = []
            held.append(t.slice(i, j - i))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_tables(held)


def _pairs(g: pa.Table) -> tuple:
    n = g.column("n").to_numpy()
    sigs, path = g.column("sigs").to_pylist(), g.column("path")[0].as_py()
    return n, *candidates(n, [[np.array(x, dtype=np.int32).view(np.uint32) for x in s] for s in sigs], [x & 0xFFFFFFFF for x in path], g.column("side").to_numpy(), g.column("apart")[0].as_py())


def compared(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """cls, links (documents linked to it in this task), partner (a class that links in this task join it to, if any)."""
    spark = rows.sparkSession
    parts = input_partitions(spark)
    kind = rows.schema["first_id"].dataType.simpleString()
    fields = f"task long, side int, apart boolean, cls binary, first_id {kind}, n int, copies long, sigs array<array<int>>, path array<int>"
    names = [x.split()[0] for x in fields.split(", ")]

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            if len(g) < 2:
                continue
            _, a, b = _pairs(g)
            if len(a):
                yield from g.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            cls = g.column("cls").to_pylist()
            first = list({c: k for k, c in reversed(list(enumerate(cls)))}.values())  # rows that repeat a doc_id bring a class twice
            if len(first) < len(cls):
                g = g.take(pa.array(sorted(first)))
                cls = g.column("cls").to_pylist()
            n, a, b = _pairs(g)
            a, b = verified(n, [unpack(t) for t in g.column("tokens").to_pylist()], a, b)
            if not len(a):
                continue
            copies = g.column("copies").to_numpy()
            links = np.bincount(a, copies[b], len(n)) + np.bincount(b, copies[a], len(n))
            root = roots(len(n), a, b)
            on = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array([cls[k] for k in on], pa.binary()), pa.array(links[on].astype(np.int64)), pa.array([cls[root[k]] if root[k] != k else None for k in on], pa.binary())], ["cls", "links", "partner"])

    dealt = tasks(rows).select(*names).repartition(parts, "task").sortWithinPartitions("task")
    near = stored(dealt.mapInArrow(involved, fields), "candidate-rows")
    # Only the sets that the tasks need are shuffled.
    t = tokens.select(F.col("cls").alias("t_cls"), "doc_id", "tokens", F.xxhash64("cls").alias("q_key"))
    t = passing(t, near.select(F.xxhash64("cls").alias("q_key")).distinct()).where("q_hit")
    with_tokens = near.join(t, (near["cls"] == t["t_cls"]) & near["first_id"].eqNullSafe(t["doc_id"])).select(*names, "tokens")
    return with_tokens.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(verify, "cls binary, links long, partner binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, runs: int = RUNS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the documents reached by links), copy_id (of those with an equal set), n_links."""
    every = stored(sets(docs, id_col, text_col, words, runs), "shingle-sets")
    light = every.select("doc_id", "cls", "n", "chosen")
    classes = stored(light.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("chosen").alias("chosen")), "classes")
    tokens = every.where("n > 0").select("cls", "doc_id", "tokens")
    found = stored(compared(leaves(classes, tokens, runs), tokens), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    edges = found.where("partner IS NOT NULL").select(F.col("cls").alias("a"), F.col("partner").alias("b"))
    joined = components(edges).select(F.col("node").alias("cls"), "component")
    info = classes.select("cls", "first_id", "copies").join(links, "cls", "left").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = info.groupBy("component").agg(F.min("first_id").alias("class_id"))
    info = info.join(names, "component").select(F.col("cls").alias("i_cls"), "class_id", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = light.select("doc_id", "cls", "n").join(info, (F.col("n") > 0) & (F.col("cls") == F.col("i_cls")), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("first_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of documents, with their own columns, of which each group of linked documents keeps the one with its smallest doc_id.

    Rows are told apart by all their columns; of rows that are equal throughout one stays, as they are copies of each other.
    """
    found = stored(join(docs.select(row_id(docs).alias("q_id"), "text"), id_col="q_id"), "groups")
    own = found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("q_first")).groupBy("doc_id").agg(F.max("q_first").alias("q_first"), F.count("*").alias("q_n"))
    own = stored(own.where("q_first").select(F.col("doc_id").alias("q_id"), "q_n"), "kept-rows")
    kept = carried(docs).join(own, "q_id")
    if own.where("q_n > 1").isEmpty():
        return kept.select("q_row.*")
    once, again = kept.where("q_n = 1"), kept.where("q_n > 1").dropDuplicates(["q_id"])
    return once.unionByName(again).select("q_row.*")
