"""Language-model scoring by cross-entropy difference.

Two bigram models are matched: the same order, smoothing and vocabulary; one counts the target rows, the other all rows. A
document's score is the mean, over its tokens, of the background model's loss minus the target model's: above 0 if the
target explains the text better.

The vocabulary is every word of all rows. A word is known by 64 bits of a hash, a pair by 64 bits made of both; two of a
billion words or pairs agree by chance with a probability below 3 %, and would then be counted as one. Each model
interpolates its bigrams with its unigrams: p(w | h) = (c(h, w) + WEIGHT p(w)) / (c(h) + WEIGHT),
p(w) = (c(w) + 1) / (N + V + 1), each without the occurrence scored.

Rows are dealt to blocks of about BLOCK_SIZE characters by a hash of id and text. A block counts its words and pairs, cuts the
sorted keys into parts of the range of hashes and sends each part once, as packed differences. The task of a part sums the
counts of all blocks and answers each of them with the sums of its own keys, in their order, so that no key travels back.
The block then scores its texts with them. A key is sent once for each block, however often it stands there, so no
word or pair fills a task; nothing is broadcast but the target's ids, and nothing is dropped. Between blocks and parts go
blocks times parts rows, which for very large inputs outgrows the keys: then raise BLOCK_SIZE and HOT_ROWS.

Nulls and odd input: a null text has no tokens; texts without tokens score 0. A row of the result stands for each row of
the input, whose doc_id may be of any type; rows that repeat a doc_id are in the target together. Without target rows the
target model is uniform. Empty tables give an empty result. Other columns are ignored, whatever they are called.
A block is handled at once; rows with equal doc_id and text share one.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm.shingles import mix, powers

WEIGHT = 50.0
#: Target ids are broadcast up to so many; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Characters of a block.
BLOCK_SIZE = 6_000_000
#: Words and pairs, each counted once for a block, that a part has at about; one stands in CHARS characters or more.
HOT_ROWS, CHARS = 1_000_000, 8
#: Characters that are hashed at once.
BLOCK_CHARS = 1 << 20
WORDS = re.compile(r"[\w']+|[^\w\s]")
#: Stands for a text's start.
START = np.uint64(0x6A09E667F3BCC909)
#: Kinds of code points.
SPACE, OTHER, WORD = 0, 1, 2


def tokens(text: str) -> list[str]:
    return WORDS.findall(text)


def _kind(c: str) -> int:
    return WORD if c == "'" or re.match(r"\w", c) else SPACE if re.match(r"\s", c) else OTHER


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kinds of the first 65,536 code points."""
    return np.array([_kind(chr(k)) for k in range(1 << 16)], dtype=np.uint8)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a block of texts, and each one's text; what `tokens` finds, by numpy."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _kinds()[np.minimum(codes, 0xFFFF)]
    if len(far := np.flatnonzero(codes > 0xFFFF)):
        which, at = np.unique(codes[far], return_inverse=True)
        kind[far] = np.array([_kind(chr(c)) for c in which], dtype=np.uint8)[at]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[np.cumsum(lengths)] = True  # a text's end
    edge[0] = True
    word = kind == WORD
    start = (kind != SPACE) & (~word | edge[:-1] | np.concatenate(([True], ~word[:-1])))
    stop = (kind != SPACE) & (~word | edge[1:] | np.concatenate((~word[1:], [True])))
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    c = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes))[0][: len(codes)], out=c[1:])
    h = mix((c[stop] - c[start]) * powers(len(codes) + 1)[1][start])
    return h, np.repeat(np.arange(len(texts)), lengths)[start]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first ^ ((second << np.uint64(1)) | (second >> np.uint64(63))))


def paired(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's pair with the one before it (or the start), and whether it is its text's first."""
    new = np.concatenate(([True], text[1:] != text[:-1]))[: len(h)]
    before = np.where(new, START, np.concatenate(([START], h[:-1]))[: len(h)])
    return pair_keys(before, h), new


def text_blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about BLOCK_CHARS characters, with their texts; a longer text is a slice of its own."""
    for b in batches:
        texts = [t or "" for t in b.column(column).to_pylist()]
        ends = np.cumsum([len(t) + 1 for t in texts])
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_CHARS, side="right")))
            yield b.slice(i, j - i), texts[i:j]
            i = j


def flagged(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """q_block, doc_id, text, is_target."""
    ids = target.select(F.col("doc_id").alias("t_id")).where("t_id IS NOT NULL").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(blocks)).cast("long").alias("q_block"), "doc_id", "text")
    return d.join(F.broadcast(ids) if few else ids, d["doc_id"] == F.col("t_id"), "left").select("q_block", "doc_id", "text", F.col("t_id").isNotNull().alias("is_target"))


def packed(x: np.ndarray) -> bytes:
    """Numbers by as many bytes as the largest takes; bytes of one rank stand together, so that zeros compress."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = (len(data) - 1) // data[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : data[0]] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], n).T
    return out.reshape(-1).view(np.uint64)


def floors(parts: int) -> np.ndarray:
    """The least key of each part."""
    return np.array([-(-(k << 64) // parts) for k in range(parts)], dtype=np.uint64)


def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, pairs, texts of all tokens of a block, and whether each is its text's first."""
    out, n = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))], 0
    for _, texts in text_blocks(rows.to_batches(), rows.schema.get_field_index("text")):
        h, text = hashed(texts)
        pair, new = paired(h, text)
        out.append((h, pair, text + n, new))
        n += len(texts)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


KINDS = ("words", "pairs")
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
COUNTED = "q_block long, part int, docs_n long, docs_target long, words binary, words_n binary, words_target binary, pairs binary, pairs_n binary, pairs_target binary"
SUMMED = "q_block long, part int, docs_n long, docs_target long, words_n binary, words_target binary, pairs_n binary, pairs_target binary, size long, total_n long, total_target long"


def arrow_table(schema: str, cols: dict) -> pa.Table:
    return pa.table({c: pa.array(cols[c], ARROW[t]) for c, t in (x.split() for x in schema.split(", "))})


def counts(rows: DataFrame, parts: int) -> DataFrame:
    """COUNTED: for each block and part the block's keys there and their counts, in all and in the target."""

    def count(block: tuple, b: pa.Table) -> pa.Table:
        h, pair, text, _ = read(b)
        is_target = b["is_target"].to_numpy()
        own, low = is_target[text], floors(parts)
        cols = {"q_block": [block[0].as_py()] * parts, "part": range(parts), "docs_n": [len(b)] * parts, "docs_target": [int(is_target.sum())] * parts}
        for kind, keys in zip(KINDS, (h, pair), strict=True):
            u, n = np.unique(keys, return_counts=True)
            of_target, m = np.unique(keys[own], return_counts=True)
            n_target = np.zeros(len(u), np.int64)
            n_target[np.searchsorted(u, of_target)] = m
            ends = [*np.searchsorted(u, low).tolist(), len(u)]
            cuts = [slice(i, j) for i, j in itertools.pairwise(ends)]
            cols[kind] = [packed(np.diff(u[c], prepend=low[k])) for k, c in enumerate(cuts)]
            cols[f"{kind}_n"], cols[f"{kind}_target"] = [packed(n[c]) for c in cuts], [packed(n_target[c]) for c in cuts]
        return arrow_table(COUNTED, cols)

    return rows.groupBy("q_block").applyInArrow(count, COUNTED)


def sums(counted: DataFrame, parts: int) -> DataFrame:
    """SUMMED: the counts of a block's keys over all blocks; size: words of the part's range, total: their occurrences.

    Each block has a row in each part, so every part knows the number of texts, and a block learns all totals.
    """

    def total(part: tuple, b: pa.Table) -> pa.Table:
        low = floors(parts)[part[0].as_py()]
        cols = {"q_block": b["q_block"].to_pylist(), "part": b["part"].to_pylist()} | {c: [sum(b[c].to_pylist())] * len(b) for c in ("docs_n", "docs_target")}
        for kind in KINDS:
            keys = [low + np.cumsum(unpacked(x), dtype=np.uint64) for x in b[kind].to_pylist()]
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            ends = np.cumsum([len(k) for k in keys])[:-1]
            for c in ("n", "target"):
                n = np.bincount(at, np.concatenate([unpacked(x) for x in b[f"{kind}_{c}"].to_pylist()]), len(u)).astype(np.uint64)
                cols[f"{kind}_{c}"] = [packed(x) for x in np.split(n[at], ends)]
                if kind == "words":
                    cols |= {"size": [len(u)] * len(b), f"total_{c}": [int(n.sum())] * len(b)}
        return arrow_table(SUMMED, cols)

    return counted.groupBy("part").applyInArrow(total, SUMMED)


def losses(rows: DataFrame, summed: DataFrame) -> DataFrame:
    """doc_id, n_tokens, t and b (the sums of the losses in the target's and in the whole model) of every row."""

    def score_block(b: pa.Table, s: pa.Table) -> pa.Table:
        h, pair, text, new = read(b)
        s = s.sort_by("part")
        size, own = sum(s["size"].to_pylist()), b["is_target"].to_numpy().astype(np.int64)[text]
        word_at, pair_at = (np.unique(keys, return_inverse=True)[1] for keys in (h, pair))
        out = []
        for c, mine in (("target", own), ("n", 1)):
            words, pairs = (np.concatenate([unpacked(x) for x in s[f"{kind}_{c}"].to_pylist()]).astype(np.float64) for kind in KINDS)
            u = words[word_at]
            first = np.where(new, s[f"docs_{c}"][0].as_py(), np.concatenate(([0.0], u[:-1]))[: len(u)])
            p = (u - mine + 1) / (sum(s[f"total_{c}"].to_pylist()) - mine + size + 1)
            loss = np.log((first - mine + WEIGHT) / (pairs[pair_at] - mine + WEIGHT * p))
            out.append(np.bincount(text, loss, len(b)))
        return pa.table({"doc_id": b["doc_id"], "n_tokens": np.bincount(text, minlength=len(b)), "t": out[0], "b": out[1]})

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, t double, b double"
    return rows.groupBy("q_block").cogroup(summed.groupBy("q_block")).applyInArrow(score_block, schema)


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (means over tokens) and score for every row. target: its doc_ids."""
    chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks, parts = chars // BLOCK_SIZE + 1, chars // (CHARS * max(HOT_ROWS, 1)) + 1
    rows = flagged(docs, target, id_col, text_col, blocks)
    out = losses(rows, sums(counts(rows, parts), parts))
    mean = lambda x: F.when(F.col("n_tokens") > 0, F.expr(x) / F.col("n_tokens")).otherwise(0.0)
    return out.select("doc_id", "n_tokens", mean("t").alias("loss_target"), mean("b").alias("loss_background"), mean("b - t").alias("score"))
