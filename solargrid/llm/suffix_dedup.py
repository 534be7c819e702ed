"""Suffix-array dedup: every byte covered by a string of LENGTH bytes that also starts at another place is removed.

Which text meets which: winnowing picks, in every window of LENGTH bytes, the substring of ANCHOR bytes with the least hash,
so two equal strings of LENGTH bytes hold an equal anchor at the same place. An anchor's region reaches as far as any
such string around it. Anchors (hash, place, hash of the region) are counted by Spark; an anchor that occurs once
decides nothing. Equal regions cover each other whole, so of equal ones only one goes on, and groups of exact copies
shrink to one member before any text moves.

Shards: the regions that remain are dealt by the least occurrence of their anchor, so that families of near copies meet in one
shard, where a text's regions are merged. An anchor with more than FAMILY distinct regions is a shard of its own. Each
task joins shards to strings of up to SHARD bytes, builds the suffix array by induced sorting, computes permuted common
prefixes, and keeps places that share LENGTH bytes with a neighbour. A place stands in a shard's string once, so
what is found is always another place.

An anchor with more than HOT distinct regions (a passage in a large part of all texts) is not put into one task: its windows
are cut into ranges, and each range's regions are dealt anew by the bytes that all windows of the range share, in
LEVELS steps down to single windows. What is left alone at a step is unique; what has become small enough goes to a shard.

Only texts that a bitmap of the decided keys lets through are shuffled. Spans of each text are joined to it once.

Nulls and odd input: a null or empty text has 0 bytes and loses none. Rows with equal doc_id and text repeat each other, so
they lose all that a copy would; a null doc_id takes part like any other. Empty tables give an empty result. Other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.llm.key_filter import passing
from solargrid.llm.row_ids import carried, row_id
from solargrid.llm.shingles import blocks, mix, powers, prefix_sums, texts
from solargrid.llm.storage import input_partitions, stored
from solargrid.llm.suffix_array import repeated

LENGTH = 400
ANCHOR = 120
FAMILY = 64
HOT = 6000
SHARD = 2 << 20
#: Windows of the least place's text that share a shard, in bytes.
STRETCH = 1 << 16
#: Widths of window ranges of a hot anchor, step by step down to single windows.
LEVELS = (71, 18, 5, 1)


def key(id_col: str, text_col: str) -> Column:
    """Stands for a row: equal for rows with equal doc_id and text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col))


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over windows of w; w - 1 shorter than x."""
    done = 1
    while done * 2 <= w:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (w - done)], x[w - done :]) if done < w else x


def anchors_of(data: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, anchor hashes and region hashes of one text of `length` bytes or more."""
    c = prefix_sums(data)
    inverse = powers(len(data) + 1)[1]
    h = mix((c[size:] - c[:-size]) * inverse[: len(c) - size])
    w = length - size + 1
    least = _sliding(h, w, np.minimum)
    # A place is picked if some window that holds it has its hash as the least one.
    most = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    at = np.flatnonzero(most == h)
    if len(at) > 2 * len(data) // w + 16:
        at = _thinned(at, h, w)
    start, stop = np.maximum(at - (length - size), 0), np.minimum(at + length, len(data))
    region = mix((c[stop] - c[start]) * inverse[start] + (at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (stop - start).astype(np.uint64))
    return at, h[at], region


def _thinned(at: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """Of equal hashes close together (periodic text) only as many as leave one in each window."""
    order = np.lexsort((at, h[at]))
    keep, last = [], None
    for k, i in enumerate(order):
        p = at[i]
        following = at[order[k + 1]] if k + 1 < len(order) and h[at[order[k + 1]]] == h[p] else None
        if last is None or h[last] != h[p] or following is None or following - last > w:
            keep.append(i)
            last = p
    return at[np.sort(np.array(keep))]


def anchors(docs: DataFrame, length: int, size: int) -> DataFrame:
    """q_key, pos, h, rh of every text of `length` bytes or more. docs has q_key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts(b.column(1))
            keys = b.column(0).to_numpy()
            for i, j in blocks(offsets):
                out = []
                for k in range(i, j):
                    if offsets[k + 1] - offsets[k] >= length:
                        at, h, region = anchors_of(data[offsets[k] : offsets[k + 1]], length, size)
                        out.append((np.full(len(at), keys[k]), at, h.view(np.int64), region.view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["q_key", "pos", "h", "rh"])

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, "q_key long, pos long, h long, rh long")


PIECE = "shard long, q_key long, start long, bytes binary"
SPANS = "q_key long, first array<long>, stop array<long>"


def _merged(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges, touching ones joined."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], first[1:] > stop[:-1]))
    at = np.flatnonzero(new)
    return first[at], stop[np.append(at[1:], len(first)) - 1]


def pieces(docs: DataFrame, wanted: DataFrame, length: int, size: int) -> DataFrame:
    """The merged regions of each text and shard, cut from the texts. wanted: q_key, shard, pos."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q_key, text, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "replace")
                by_shard: dict[int, list[int]] = {}
                for x in at:
                    by_shard.setdefault(x["shard"], []).append(x["pos"])
                for shard, pos in by_shard.items():
                    p = np.array(pos, dtype=np.int64)
                    for i, j in zip(*_merged(np.maximum(p - (length - size), 0), np.minimum(p + length, len(data))), strict=True):
                        out.append((shard, q_key, int(i), data[i:j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "q_key", "start", "bytes"])

    # A text's anchors are as many as its length allows; this list is a part of one text.
    per_text = wanted.groupBy("q_key").agg(F.collect_set(F.struct("shard", "pos")).alias("at"))
    hit = passing(docs, wanted.select("q_key").distinct()).where("q_hit").select("q_key", "text").dropDuplicates(["q_key"])
    return hit.join(per_text, "q_key").select("q_key", "text", "at").mapInArrow(cut, PIECE)


def searched(parts: DataFrame, length: int, limit: int) -> DataFrame:
    """Spans covered by repeated strings within shards (column shard groups the rows of PIECE)."""

    def search(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: q_key, start, bytes."""
        rows.sort(key=lambda r: (r[0], r[1]))
        joined: list[tuple[int, int, bytes]] = []
        for q_key, start, data in rows:  # overlapping pieces of one text become one, so a place occurs once
            if joined and joined[-1][0] == q_key and start <= joined[-1][1] + len(joined[-1][2]):
                k, s, d = joined[-1]
                joined[-1] = (k, s, d + data[s + len(d) - start :])
            else:
                joined.append((q_key, start, data))
        text = np.frombuffer(b"\x00".join(d for _, _, d in joined), dtype=np.uint8)
        s = np.zeros(len(text) + 1, dtype=np.int32)
        s[:-1] = text.astype(np.int32) + 2
        begin = np.cumsum([0, *[len(d) + 1 for _, _, d in joined]])[:-1]
        s[begin[1:] - 1] = 1  # a separator, smaller than every byte
        found = np.flatnonzero(repeated(s, 258, length))
        owner = np.searchsorted(begin, found, side="right") - 1
        spans: dict[int, list[np.ndarray]] = {}
        for k in np.unique(owner):
            q_key, start, data = joined[k]
            p = found[owner == k] - begin[k]
            p = p[p + length <= len(data)]
            if len(p):
                spans.setdefault(q_key, []).append(p + start)
        if spans:
            merged = {q: _merged(np.concatenate(p), np.concatenate(p) + length) for q, p in spans.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int64()), pa.array([m[0] for m in merged.values()], pa.list_(pa.int64())), pa.array([m[1] for m in merged.values()], pa.list_(pa.int64()))], ["q_key", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size, shard = [], [], 0, None
        for b in batches:
            for this, q_key, start, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if this != shard:
                    if size > limit:
                        yield from search(held + group)
                        held, group, size = [], [], 0
                    held, group, shard = held + group, [], this
                group.append((q_key, start, data))
                size += len(data)
        if held or group:
            yield from search(held + group)

    spark = parts.sparkSession
    return parts.repartition(input_partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(run, SPANS)


ITEM = "group long, q_key long, pos long, start long, bytes binary, low long, high long, reach long"
ITEMS = [x.split()[0] for x in ITEM.split(", ")]


def occurrences(regions: DataFrame, length: int, size: int) -> DataFrame:
    """ITEM of every occurrence of the anchor in each region. regions: group, q_key, pos (one of them), start, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for group, q_key, pos, start, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                anchor, last = data[pos - start : pos - start + size], None
                p = data.find(anchor)
                while p >= 0:
                    first = max(p - (length - size), 0)
                    reach = length - size if last is None else min(length - size, p - last - 1)
                    out.append((group, q_key, start + p, start + first, data[first : p + length], 0, length - size, reach))
                    last, p = p, data.find(anchor, p + 1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary(), *[pa.int64()] * 3), strict=True)], ITEMS)

    return regions.select("group", "q_key", "pos", "start", "bytes").mapInArrow(run, ITEM)


def hot_spans(items: DataFrame, length: int, size: int, hot: int, limit: int) -> DataFrame:
    """Spans among anchors with too many regions for one task.

    items: group, q_key, pos, start, bytes (the region, from start on), low and high (the group's window offsets before the
    anchor) and reach: windows that start further before it hold an occurrence of the anchor before this one. A window is
    named by its first occurrence only, so equal windows have equal names, whichever anchors were kept.
    """

    def refine(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for group, q_key, pos, start, data, low, high, reach in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                    for a in range(low - low % width, high + 1, width):
                        # Windows that start x to z bytes before the anchor: all hold the bytes between, in whatever text.
                        x, z = max(a, low), min(a + width - 1, high)
                        if max(x, pos - start + length - len(data)) > min(z, pos - start, reach):
                            continue  # none of them lies in this text and has its first anchor here
                        core = data[pos - start - x : pos - start - z + length]
                        code = hashlib.blake2b(b"%d %d %d " % (group, x, z) + core, digest_size=8).digest()
                        out.append((int.from_bytes(code, "little", signed=True), q_key, pos, start, data, x, z, reach))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary(), *[pa.int64()] * 3), strict=True)], ITEMS)

        return run

    done = []
    for width in LEVELS:
        items = stored(items.mapInArrow(refine(width), ITEM), "hot-windows")
        sizes = items.groupBy("group").agg(F.count("*").alias("k")).where("k > 1")
        items = items.join(sizes, "group")
        if width == 1:
            done.append(items.select("q_key", F.array(F.col("pos") - F.col("low")).alias("first"), F.array(F.col("pos") - F.col("low") + length).alias("stop")))
            break
        done.append(searched(items.where(f"k <= {hot}").select(F.col("group").alias("shard"), "q_key", "start", "bytes"), length, limit))
        items = items.where(f"k > {hot}").drop("k")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def spans(docs: DataFrame, length: int, size: int, hot: int, family: int, limit: int) -> DataFrame:
    """SPANS of all texts; a text may have several rows, whose ranges may overlap. docs has q_key and text."""
    found = stored(anchors(docs, length, size), "anchors")
    regions = stored(found.groupBy("h", "rh").agg(F.count("*").alias("c"), F.min(F.struct("q_key", "pos")).alias("at")), "regions")
    groups = regions.groupBy("h").agg(F.sum("c").alias("total"), F.count("*").alias("k"), F.count_if(F.col("c") == 1).alias("alone"), F.min("at").alias("least")).where("total > 1")
    groups = stored(groups, "anchor-groups")
    whole = regions.where("c > 1").select("h", "rh")
    covered = found.join(whole, ["h", "rh"]).select("q_key", F.array(F.greatest(F.col("pos") - (length - size), F.lit(0))).alias("first"), F.array(F.col("pos") + length).alias("stop"))

    open_groups = groups.where("k > 1 AND alone > 0").select("h", "k", "least")
    of_family = F.xxhash64(F.col("least.q_key"), F.floor(F.col("least.pos") / STRETCH))
    shard = F.when(F.col("k") <= family, of_family).otherwise(F.xxhash64(F.lit("anchor"), "h"))
    wanted = stored(regions.join(open_groups, "h").select("h", "k", shard.alias("shard"), F.col("at.q_key").alias("q_key"), F.col("at.pos").alias("pos")), "wanted-regions")
    shared = searched(pieces(docs, wanted.where(f"k <= {hot}").select("q_key", "shard", "pos"), length, size), length, limit)
    out = covered.unionByName(shared)
    many = wanted.where(f"k > {hot}").select("q_key", F.col("h").alias("shard"), "pos")
    if not many.isEmpty():
        regions_text = pieces(docs, many, length, size).select("q_key", F.col("shard").alias("group"), "start", "bytes")
        own = many.select("q_key", F.col("shard").alias("group"), "pos")
        at = regions_text.join(own, ["q_key", "group"]).where("pos >= start AND pos < start + octet_length(bytes)")
        at = at.groupBy("group", "q_key", "start").agg(F.min("pos").alias("pos"), F.first("bytes").alias("bytes"))
        out = out.unionByName(hot_spans(occurrences(at, length, size), length, size, hot, limit))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR, hot: int = HOT, family: int = FAMILY, limit: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", key("doc_id", "text").alias("q_key"), "text")
    removed = stored(spans(d.select("q_key", "text"), length, size, hot, family, limit), "removed-spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, first, stop in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode("utf-8", "replace")
                kept, n = data, 0
                if first:
                    f, s = _merged(np.array([x for y in first for x in y], dtype=np.int64), np.minimum(np.array([x for y in stop for x in y], dtype=np.int64), len(data)))
                    n = len(f)
                    kept = b"".join(data[i:j] for i, j in zip([0, *s.tolist()], [*f.tolist(), len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], names)

    hit = passing(d, removed.select("q_key").distinct())
    size_of = F.octet_length("text").cast("long")
    plain = hit.where("NOT q_hit").select("doc_id", size_of.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    # The ranges of one text; joined ranges were merged before, so they are a part of the text's own size.
    ranges = removed.groupBy("q_key").agg(F.collect_list("first").alias("first"), F.collect_list("stop").alias("stop"))
    joined = hit.where("q_hit").join(ranges, "q_key", "left").select("doc_id", "text", "first", "stop")
    return plain.unionByName(joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of documents, with their own columns, without repeated strings in their texts.

    Bytes of a character that was cut in two go with it. n_chars, if there, is set to the new length. A text that loses
    everything stays as an empty one. Each row is cut by its own text, also where rows share a doc_id.
    """
    own = docs.select(row_id(docs).alias("q_id"), "text")
    shorter = dedup(own, id_col="q_id").where("n_removed > 0").select(F.col("doc_id").alias("q_id"), F.expr("replace(make_valid_utf8(CAST(kept AS STRING)), '\ufffd', '')").alias("q_text")).dropDuplicates(["q_id"])
    j = carried(docs).join(shorter, "q_id", "left")
    old = F.col("q_row").getField
    cols = {"text": F.coalesce("q_text", old("text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("q_text").isNotNull(), F.length("q_text").cast(docs.schema["n_chars"].dataType)).otherwise(old("n_chars"))
    return j.select(*[cols.get(c, old(c)).alias(c) for c in docs.columns])
