"""SimHash near-duplicates: fingerprints of shingles, linked by a generalised pigeonhole over groups of correlated bits.

A text's A-Z are lower-cased, its words are runs of anything but space and \\x09 to \\x0D, and its shingles are all runs of
four words joined by a space, repeats included; a text of one to three words is one shingle. A bit of the fingerprint is set
if it is set in over half of the shingles' XXH64 (seed 42). Two fingerprints are linked if they differ in at most TAU bits.

Links are found between distinct fingerprints only:

1. Bits are put into parts: the strongest correlated ones together, so that the parts are nearly independent.
2. Each fingerprint allots a radius e >= -1 (-1: not looked up) to each part, with sum(e + 1) = TAU + 1. A pair within TAU
   bits is within the radius of at least one part, or it would differ in TAU + 1 bits. The split is the cheapest one, by
   dynamic programming over the probes and the candidates that histograms of the parts predict for this fingerprint.
3. It probes the parts' values within these radii, and each candidate is verified on all 64 bits.

Families of near copies fill the same buckets. So first each fingerprint is compared with the commonest one of each bucket
alone, which joins most of a family by as many links as it has members; afterwards only buckets that hold several components
are probed, and only pairs of different components leave the join. No link between components is lost.

All joins grow with the input and are merge joins: Spark sizes probes like the rows that they are made of and stored tables by
their compressed files, so it would send millions of rows through the driver as a broadcast.

Edge cases: a null, empty or blank text has fingerprint zero, which is linked like any other. A null doc_id keeps its row and
never names a component, unless all of its members are null (then component_id is null). Repeated ids and rows each keep
their row. Any other columns are ignored. An empty table gives an empty result. A long text is hashed in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.llm import shingles as S
from solargrid.llm.components import components
from solargrid.llm.storage import stored

WORDS, SEED, BITS, TAU = 4, 42, 64, 4
#: Shingles that are hashed at a time.
STRETCH = 1 << 16
#: Bits of one histogram at most: 2 ^ 16 counts, whatever the table's size.
NARROW = 16
#: Cost of a probe against that of one comparison.
PROBE = 20.0


def block_prints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of the texts of a block of UTF-8 bytes."""
    base, data = offsets[0], data[offsets[0] : offsets[-1]]
    at, n = offsets - base, len(offsets) - 1
    solid = ~S.SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1]))))
    if not len(starts):
        return np.zeros(n, np.uint64)
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1
    # The words again, lower-cased and with one space behind each, so that a shingle is a stretch of bytes.
    low = data[solid]
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint8)
    size = ends - starts
    line = np.full(len(low) + len(starts), 32, dtype=np.uint8)
    line[np.arange(len(low)) + np.repeat(np.arange(len(starts)), size)] = low
    begin = np.cumsum(size + 1) - (size + 1)
    end = begin + size
    first = np.searchsorted(starts, at)
    text = np.repeat(np.arange(n), np.diff(first))
    word = np.arange(len(starts))
    last = first[text + 1] - 1
    used = (word + WORDS - 1 <= last) | (word == first[text])
    text, begin, end = text[used], begin[used], end[np.minimum(word + WORDS - 1, last)[used]]
    counts = np.zeros((n, BITS), dtype=np.int64)
    view, digest = memoryview(line.tobytes()), xxhash.xxh64_intdigest
    for k in range(0, len(text), STRETCH):
        part = slice(k, k + STRETCH)
        h = np.array([digest(view[a:b], SEED) for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.diff(text[part], prepend=-1))
        counts[text[part][head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    set_ = 2 * counts > np.bincount(text, minlength=n)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp (a long that holds the 64 bits) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = S.texts(b.column(1))
            parts = [block_prints(data, offsets[i : j + 1]) for i, j in S.blocks(offsets)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["q_id", "fp"])

    return docs.select(F.col(id_col).alias("q_id"), F.col(text_col).cast("string").alias("q_text")).mapInArrow(run, f"q_id {kind}, fp long").withColumnRenamed("q_id", id_col)


def bit_counts(prints: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together, over all fingerprints, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = unpacked(b.column(0).to_numpy()).astype(np.float32)
            both, n = both + (x.T @ x).astype(np.float64), n + len(x)
        if n:
            cell = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(both.astype(np.int64), n))], ["cell", "n"])

    got = prints.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BITS * BITS + 1, dtype=np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out[:-1].reshape(BITS, BITS), int(out[-1])


def unpacked(fp: np.ndarray) -> np.ndarray:
    """One column of 0 and 1 for each bit."""
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[np.ndarray]:
    """m parts of the bits, of equal width but for one bit: each is grown by the bit that goes best with those in it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        group = [max(left, key=lambda i: (r[i, left].sum(), -i))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda i: (r[i, group].sum(), -i))
            group.append(best)
            left.remove(best)
        out.append(np.array(sorted(group)))
    return out


@cache
def masks(width: int, radius: int) -> np.ndarray:
    """All patterns of `width` bits with at most `radius` of them set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.int64)


def number_of_parts(n: int, tau: int = TAU) -> int:
    """The number of parts that is cheapest for n random fingerprints: few wide ones for many fingerprints."""

    def cost(m: int) -> float:
        width, (low, more) = BITS // m, divmod(tau + 1, m)
        one = lambda u: len(masks(width, u - 1)) * (PROBE + n / 2.0**width) if u else 0.0
        return more * one(low + 1) + (m - more) * one(low)

    return min(range(2, tau + 2), key=cost)


def values(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The value of a part: its bits side by side."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> b) & 1) << k
    return out


def pieces(bits: np.ndarray) -> list[np.ndarray]:
    """A part in pieces of at most NARROW bits, each of which has its own histogram."""
    return np.array_split(bits, -(-len(bits) // NARROW))


def histograms(prints: DataFrame, parts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For each piece of each part, how many fingerprints have each value: at most 2 ^ NARROW counts a piece."""
    flat = [p for bits in parts for p in pieces(bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << len(p), dtype=np.int64) for p in flat]
        for b in batches:
            for s, p in zip(sums, flat, strict=True):
                s += np.bincount(values(b.column(0).to_numpy(), p), minlength=len(s))
        for k, s in enumerate(sums):
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(s[some])], ["piece", "v", "n"])

    got = prints.select("fp").mapInArrow(run, "piece long, v long, n long").groupBy("piece", "v").agg(F.sum("n").alias("n")).toArrow()
    piece, v, n = (got[c].to_numpy() for c in ("piece", "v", "n"))
    out = []
    for k, p in enumerate(flat):
        table = np.zeros(1 << len(p))
        table[v[piece == k]] = n[piece == k]
        out.append(table)
    held = iter(out)
    return [[next(held) for _ in pieces(bits)] for bits in parts]


def at_distances(counts: np.ndarray, most: int) -> np.ndarray:
    """Row e: for each value, how many fingerprints are at distance e from it, by flipping one more bit at a time."""
    width = len(counts).bit_length() - 1
    place = np.arange(len(counts))
    out = [counts]
    for e in range(1, most + 1):
        more = sum(out[-1][place ^ (1 << b)] for b in range(width))
        out.append((more - (width - e + 2) * out[-2]) / e if e > 1 else more)
    return np.array(out)


def allotted(fp: np.ndarray, parts: list[np.ndarray], near: list[list[np.ndarray]], n: int, tau: int = TAU) -> np.ndarray:
    """e + 1 for each fingerprint (row) and part (column): the cheapest allotment with a sum of tau + 1."""
    best = np.full((tau + 2, len(fp)), np.inf)
    best[0] = 0
    took = []
    for bits, tables in zip(parts, near, strict=True):
        # Candidates at each distance; pieces of a wide part are taken as independent.
        each = None
        for piece, table in zip(pieces(bits), tables, strict=True):
            own = table[:, values(fp, piece)] / n
            each = own if each is None else np.array([sum(each[i] * own[e - i] for i in range(e + 1)) for e in range(tau + 1)])
        within = np.cumsum(each, axis=0) * n
        cost = np.vstack([np.zeros(len(fp)), *[PROBE * len(masks(len(bits), e)) + within[e] for e in range(tau + 1)]])
        sums = np.array([[best[b - u] + cost[u] if u <= b else np.full(len(fp), np.inf) for u in range(tau + 2)] for b in range(tau + 2)])
        took.append(sums.argmin(axis=1))
        best = sums.min(axis=1)
    out, rest, row = np.zeros((len(fp), len(parts)), dtype=np.int64), np.full(len(fp), tau + 1), np.arange(len(fp))
    for k in range(len(parts) - 1, -1, -1):
        out[:, k] = took[k][rest, row]
        rest = rest - out[:, k]
    return out


def _keyed(df: DataFrame, emit) -> DataFrame:
    """Rows (key, fp, tag) that emit makes of arrays fp; tag is the second column of df. A key is a part and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in range(0, len(fp), 1 << 13):
                for key, row in emit(fp[k : k + (1 << 13)]):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[k + row]), pa.array(tag[k + row])], ["key", "fp", "tag"])

    return df.mapInArrow(run, "key long, fp long, tag long")


def indexed(df: DataFrame, parts: list[np.ndarray]) -> DataFrame:
    """Every fingerprint under its value of each part."""

    def emit(fp: np.ndarray):
        for k, bits in enumerate(parts):
            yield values(fp, bits) | (k << 40), np.arange(len(fp))

    return _keyed(df, emit)


def probed(df: DataFrame, parts: list[np.ndarray], near: list[list[np.ndarray]], n: int, tau: int = TAU) -> DataFrame:
    """Every fingerprint under all values of its parts within the radii allotted to it."""
    shared = df.sparkSession.sparkContext.broadcast(near)

    def emit(fp: np.ndarray):
        units = allotted(fp, parts, shared.value, n, tau)
        for k, bits in enumerate(parts):
            v = values(fp, bits)
            for u in np.unique(units[:, k]):
                if u:
                    row = np.flatnonzero(units[:, k] == u)
                    flips = masks(len(bits), int(u) - 1)
                    yield (v[row][:, None] ^ flips[None, :]).ravel() | (k << 40), np.repeat(row, len(flips))

    return _keyed(df, emit)


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _merged(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join that is never broadcast, whatever sizes Spark takes its sides for."""
    return left.join(right.hint("merge"), on, how)


def linked(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """fp and root: the same one for all fingerprints that links of at most tau bits connect. prints: distinct fp, n rows."""
    both, n = bit_counts(prints)
    parts = correlated_parts(both, n, number_of_parts(n, tau))
    near = [[at_distances(t, tau) for t in tables] for tables in histograms(prints, parts)]

    index = stored(indexed(prints.select("fp", "n"), parts), "simhash-index")
    lead = stored(index.groupBy("key").agg(F.max(F.struct("tag", "fp"))["fp"].alias("lead")), "simhash-leads")
    stars = _merged(index, lead, "key").where((F.col("fp") != F.col("lead")) & (apart("fp", "lead") <= tau)).select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct()
    roots = _rooted(prints.select("fp"), components(stars))

    member = indexed(roots, parts).withColumnsRenamed({"fp": "r_fp", "tag": "r_root"})
    member = stored(member, "simhash-members")
    bucket = member.groupBy("key").agg(F.min("r_root").alias("low"), F.max("r_root").alias("high"))
    probe = probed(roots, parts, near, n, tau).withColumnRenamed("tag", "root")
    open_ = _merged(probe, bucket, "key").where((F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))).select("key", "fp", "root")
    found = _merged(open_, member, (open_["key"] == member["key"]) & (open_["root"] != member["r_root"]) & (apart("fp", "r_fp") <= tau))
    pairs = found.select(F.least("root", "r_root").alias("a"), F.greatest("root", "r_root").alias("b")).distinct()
    above = components(pairs).withColumnsRenamed({"node": "root", "component": "above"})
    return stored(_merged(roots, above, "root", "left").select("fp", F.coalesce("above", "root").alias("root")), "simhash-roots")


def _rooted(prints: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.withColumnRenamed("node", "fp")
    return stored(_merged(prints, own, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")), "simhash-stars")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id (the smallest id that links lead to) of every row."""
    prints = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(id_col).alias("least")), "simhash-distinct")
    roots = _merged(linked(distinct, tau), distinct.select("fp", "least"), "fp")
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(_merged(roots.select("fp", "root"), names, "root").select("fp", "component_id"), "simhash-named")
    return _merged(prints, named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
