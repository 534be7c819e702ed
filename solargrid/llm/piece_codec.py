"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding finds the segmentation of a text into pieces of a public vocabulary with the greatest sum of log-probabilities
(ties: at each place, from the right, the shortest last piece). A text is cut into chunks of CHUNK characters wherever a
chunk ends, also inside a piece. A chunk's boundary states are how many characters a piece that starts before a
boundary reaches beyond it. For each chunk, a task computes the max-plus matrix of best scores from each state at its left
edge to each at its right edge. Matrices combine associatively: blocks of BLOCK chunks are multiplied, then blocks of
blocks, until one row is left for each text; then the states are handed down the same levels. Each chunk, knowing its own
two states, is then traced back by itself. So no task ever holds more than a chunk, or BLOCK matrices, of a giant text.

The vocabulary marks spaces, and a text gets one before it. Pieces hold spaces only in front (or are runs of them), so no
piece spans from a word into the next space: inside a chunk, the stretches between such cuts are independent. Texts are
segmented in blocks by numpy: the distinct stretches of a block (by 64-bit hash) that are not yet known are solved
together, those of one length at a time, and a bounded number is kept. Characters that no piece covers, the vocabulary's own mark among them, become the
byte pieces of their UTF-8 form, so decoding gives back every text exactly.

The vocabulary file is merge-built and its scores are ranks, not probabilities; Viterbi needs probabilities, so a piece has
Zipf's law over its rank (see vocabulary.log_prior). The result is the unigram segmentation over that vocabulary, which
differs from the merge order of the file's own library. The file is read by the driver and broadcast.

Nulls and odd input: null encodes as null ids and decodes to null; the empty text has no pieces. Rows are encoded one by one,
so repeated rows repeat their result and a null doc_id is kept. An empty table gives an empty result. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm import vocabulary as V
from solargrid.llm.shingles import mix, powers
from solargrid.llm.storage import stored

CHUNK = 20_000
BLOCK = 64
#: Characters that a task segments at once.
BLOCK_CHARS = 1 << 19
#: A Python worker forgets its solved stretches beyond so many; longer ones than WIDE are solved one by one.
CACHE, WIDE = 300_000, 48
#: Stretches that are solved together.
ROWS = 10_000
LOW = float("-inf")


def marked(text: str) -> str:
    """A text as it is cut: with the space that the vocabulary expects before it."""
    return " " + text if text else ""


def repeated_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """Every prefix of a piece by hash: its score and id if it is a piece itself, else -inf and -1."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, prefixes: dict[str, float | None], ids: dict[str, int]):
        keys = np.zeros(len(prefixes), np.uint64)
        by_length: dict[int, list[int]] = {}
        names = list(prefixes)
        for k, p in enumerate(names):
            by_length.setdefault(len(p), []).append(k)
        for n, places in by_length.items():
            codes = np.array([names[k] for k in places], dtype=f"U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(places), np.uint64)
            for j in range(n):
                h = h * self.BASE + codes[:, j]
            keys[places] = h
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two prefixes share a hash")
        self.score = np.array([LOW if prefixes[p] is None else prefixes[p] for p in names])[order]
        self.id = np.array([ids.get(p, -1) for p in names], dtype=np.int32)[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and whether they are there."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == h


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def utf8_bytes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of code points, and how many each has."""
    n = utf8_size(codes)
    at, size = np.repeat(codes, n), np.repeat(n, n)
    left = size - 1 - repeated_ranges(np.zeros(len(n), np.int64), n)  # bytes that follow
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size] | (at >> (6 * left))
    return np.where(left == size - 1, np.where(size == 1, at, lead), 0x80 | ((at >> (6 * left)) & 0x3F)), n


class Codec:
    def __init__(self, v: V.Vocabulary):
        prior = V.log_prior(v)
        self.vocabulary, self.byte_ids = v, v.byte_ids
        # Pieces are held with plain spaces, so a mark that stands in a text is a character that no piece covers.
        self.ids = {p.replace(V.SPACE, " "): i for p, i in v.ids.items()}
        self.text_of = [p.replace(V.SPACE, " ") if t in (V.NORMAL, V.USER_DEFINED) else None if t == V.BYTE else "" for p, t in zip(v.pieces, v.types, strict=True)]
        self.score = {p: float(prior[i]) for p, i in self.ids.items()}
        # Every prefix of a piece: its score if it is a piece itself, else None.
        self.prefixes: dict[str, float | None] = {p[:n]: None for p in self.ids for n in range(1, len(p))} | self.score
        self.longest = max(map(len, self.ids))
        self.byte_score = float(min(prior[i] for i in self.byte_ids))
        self.reach = self.longest - 1
        self.table = Pieces(self.prefixes, self.ids)
        self.byte_table = np.array(self.byte_ids, dtype=np.int32)
        self.forget()
        plain = [b"" if t is None else t.encode("utf-8") for t in self.text_of]
        for byte, i in enumerate(self.byte_ids):
            plain[i] = bytes([byte])
        self.out_size = np.array([len(x) for x in plain], dtype=np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(plain), dtype=np.uint8)
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece holds a mark behind other characters")

    def bytes_of(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "replace")]

    def best(self, s: str, start: int, stop: int, first: int = 0) -> tuple[list[float], list[int]]:
        """Best score of each place of s from `first`, and the length of the last piece there.

        Pieces start at first or later and before stop; they may end beyond stop, up to the end of s.
        """
        n = len(s)
        score, back = [LOW] * (n + 1), [0] * (n + 1)
        score[first] = 0.0
        get, longest = self.prefixes.get, self.longest
        for i in range(first, stop):
            base = score[i]
            if base == LOW:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                v = get(s[i:j], False)
                if v is False:  # no piece starts like this
                    break
                if v is not None and (base + v > score[j] or (base + v == score[j] and j - i < back[j])):
                    score[j], back[j] = base + v, j - i
            if s[i] not in self.score:
                v = base + self.byte_score * len(self.bytes_of(s[i]))
                if v > score[i + 1] or (v == score[i + 1] and back[i + 1] > 1):
                    score[i + 1], back[i + 1] = v, 1
        return score, back

    def trace(self, s: str, back: list[int], stop: int, first: int = 0) -> list[int]:
        out: list[int] = []
        while stop > first:
            at = stop - back[stop]
            i = self.ids.get(s[at:stop])
            if i is not None:
                out.append(i)
            else:
                out += reversed(self.bytes_of(s[at]))
            stop = at
        out.reverse()
        return out

    def forget(self) -> None:
        """Drop the solved stretches: their hashes in order, scores, and where their ids stand."""
        self.known, self.known_score = np.zeros(0, np.uint64), np.zeros(0)
        self.known_start, self.known_count, self.known_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def solve(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of ids and all ids of stretches, each alone: a row of codes for each, longest first, filled up with zeros."""
        k, n = codes.shape
        score, back, last = np.full((k, n + 1), LOW), np.zeros((k, n + 1), np.int16), np.zeros((k, n + 1), np.int32)
        score[:, 0] = 0.0
        wide = codes.astype(np.uint64)
        for i in range(n):
            row = np.arange(np.searchsorted(-length, -i, side="left"))  # those longer than i
            h, base = np.zeros(len(row), np.uint64), score[:, i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * self.table.BASE + wide[row, j - 1]
                at, found = self.table.find(h)
                piece, here = self.table.id[at], base[row]
                new = np.where(found, self.table.score[at], LOW) + here
                if j == i + 1:  # what no piece covers becomes bytes; its code stands for them
                    none = ~found | (piece < 0)
                    c = codes[row, i].astype(np.int64)
                    new, piece = np.where(none, here + self.byte_score * utf8_size(c), new), np.where(none, -1 - c, piece)
                # Pieces that start later are shorter, and win ties.
                better = (new >= score[row, j]) & (new > LOW)
                on = row[better]
                score[on, j], back[on, j], last[on, j] = new[better], j - i, piece[better]
                row, h = row[found], h[found]
                if not len(row):
                    break
        path, steps, at = np.zeros((k, n), np.int32), np.zeros(k, np.int64), length.copy()
        row = np.arange(k)
        while len(row):
            path[row, n - 1 - steps[row]] = last[row, at[row]]
            steps[row] += 1
            at[row] -= back[row, at[row]]
            row = row[at[row] > 0]
        flat = path[np.arange(n)[None, :] >= n - steps[:, None]]
        score = score[np.arange(k), length]
        if (covered := flat >= 0).all():
            return score, steps, flat
        size = np.ones(len(flat), np.int64)
        values, size[~covered] = utf8_bytes(-1 - flat[~covered].astype(np.int64))
        out = np.repeat(flat, size)
        out[np.repeat(~covered, size)] = self.byte_table[values]
        return score, np.bincount(np.repeat(np.arange(k), steps), size, k).astype(np.int64), out

    def learn(self, codes: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Solve stretches that are not known yet (each hash once) and keep them."""
        found = [(self.known, self.known_score, self.known_count, self.known_ids[repeated_ranges(self.known_start, self.known_count)])]
        order = np.argsort(-size, kind="stable")
        for k in order[: int((size > WIDE).sum())]:
            s = codes[start[k] : start[k] + size[k]].tobytes().decode("utf-32-le", "surrogatepass")
            score, back = self.best(s, 0, len(s))
            ids = np.array(self.trace(s, back, len(s)), dtype=np.int32)
            found.append((hashes[k : k + 1], np.array([score[-1]]), np.array([len(ids)]), ids))
        order = order[int((size > WIDE).sum()) :]
        for i in range(0, len(order), ROWS):
            part = order[i : i + ROWS]
            n = size[part]
            at = np.arange(n[0])[None, :]
            block = np.where(at < n[:, None], codes[np.minimum(start[part][:, None] + at, len(codes) - 1)], 0)
            found.append((hashes[part], *self.solve(block, n)))
        known, score, count, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(known)
        first = np.cumsum(count) - count
        self.known, self.known_score, self.known_start, self.known_count, self.known_ids = known[order], score[order], first[order], count[order], ids

    def segment(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of marked texts one after the other, their number in each text, and each text's score.

        Each text is taken by stretches: runs of marks, each with the characters up to the next mark.
        """
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        space = codes == 32
        edge = np.zeros(len(codes) + 1, dtype=bool)
        edge[np.cumsum(lengths) - lengths] = True
        edge = edge[:-1]
        edge[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(codes)))
        c = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes))[0][: len(codes)], out=c[1:])
        h = mix((c[start + size] - c[start]) * powers(len(codes) + 1)[1][start] + size.astype(np.uint64))
        kinds, first, at = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, kinds)
        place[place == len(self.known)] = 0
        new = self.known[place] != kinds if len(self.known) else np.ones(len(kinds), dtype=bool)
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE:
                self.forget()
                new[:] = True
            self.learn(codes, kinds[new], start[first[new]], size[first[new]])
            place = np.searchsorted(self.known, kinds)
        own = place[at]
        count = self.known_count[own]
        ids = self.known_ids[repeated_ranges(self.known_start[own], count)]
        text = np.repeat(np.arange(len(texts)), lengths)[start]
        return ids, np.bincount(text, count, len(texts)).astype(np.int64), np.bincount(text, self.known_score[own], len(texts))

    def cuts(self, s: str, length: int) -> tuple[int, int]:
        """The first and last places within a chunk where no piece can span: before a mark that follows another character."""
        places = [m.start() + 1 for m in re.finditer("[^ ] ", s[: length + 1]) if m.start() + 1 <= length]
        return (places[0], places[-1]) if places else (-1, -1)

    def middles(self, parts: list[tuple[str, int]]) -> Iterator[tuple[tuple[int, int], float, np.ndarray]]:
        """The cuts of each chunk (with its length), and the score and ids of what lies between; blocks are segmented at once."""
        step = max(1, BLOCK_CHARS // max([1, *(n for _, n in parts)]))
        for i in range(0, len(parts), step):
            cuts = [self.cuts(*p) for p in parts[i : i + step]]
            ids, count, score = self.segment([s[a:b] if a >= 0 else "" for (s, _), (a, b) in zip(parts[i : i + step], cuts, strict=True)])
            yield from zip(cuts, score.tolist(), np.split(ids, np.cumsum(count)[:-1]), strict=True)

    def matrix(self, s: str, length: int, last: bool, cuts: tuple[int, int], middle: float) -> np.ndarray:
        """Best scores from each left state to each right state of a chunk: s is the chunk and the reach beyond it."""
        k = self.reach + 1
        m = np.full((k, k), LOW)
        a, b = cuts
        tail = None
        if a >= 0:
            score, _ = self.best(s[b:], 0, length - b)
            tail = score
        for state in range(min(k, length + 1)):
            if a >= 0 and state > a:
                break  # no piece reaches over a cut
            if a >= 0:
                head, _ = self.best(s[:a], state, a, state)
                if head[a] == LOW:
                    continue
                for out in range(k):
                    if length - b + out < len(tail):
                        m[state, out] = head[a] + middle + tail[length - b + out]
            else:
                score, _ = self.best(s, state, length, state)
                for out in range(k):
                    if length + out < len(score):
                        m[state, out] = score[length + out]
        for state in range(length + 1, k):  # a piece that spans the whole chunk
            m[state, state - length] = 0.0
        if last:
            m[:, 1:] = LOW
        return m

    def encode_chunk(self, s: str, length: int, left: int, right: int, cuts: tuple[int, int], middle: np.ndarray) -> list[int]:
        """The ids of the pieces that start in a chunk, given its states."""
        if left >= length:
            return []
        end = length + right
        a, b = cuts
        if a >= left and a >= 0:
            _, back = self.best(s[:a], left, a, left)
            out = self.trace(s, back, a, left)
            out += middle.tolist()
            _, back = self.best(s[b:end], 0, length - b)
            return out + self.trace(s[b:end], back, end - b)
        _, back = self.best(s[:end], left, length, left)
        return self.trace(s[:end], back, end, left)

    def decode(self, ids: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts of lists of ids: byte pieces as bytes, marks as spaces. Where first is set, a text loses its first space."""
        size = self.out_size[ids]
        data = self.out_bytes[repeated_ranges(self.out_start[ids], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[offsets]
        drop = ends[:-1][first & (ends[1:] > ends[:-1])]
        drop = drop[data[drop] == 32]
        if len(drop):
            data = np.delete(data, drop)
            ends = ends - np.searchsorted(drop, ends, side="left")
        out = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that no text encodes to: what is no UTF-8 is replaced
            raw = data.tobytes()
            out = pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(ends, ends[1:], strict=False)], pa.large_string())
        return out.cast(pa.string())


_codecs: dict[int, Codec] = {}


def codec(v: V.Vocabulary | str) -> Codec:
    """A process keeps its codecs. v: a vocabulary, or the path of its file."""
    v = V.load(v) if isinstance(v, str) else v
    key = hash(v)
    if key not in _codecs:
        _codecs[key] = Codec(v)
    return _codecs[key]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _matrix(data: bytes) -> np.ndarray:
    m = np.frombuffer(data, dtype=np.float64)
    k = int(len(m) ** 0.5)
    return m.reshape(k, k)


def chunks(giant: DataFrame, chunk: int, reach: int) -> DataFrame:
    """q_row, doc_id, no, body (a chunk of the marked text and the reach beyond it), length, last. giant: q_row, doc_id, text."""
    names = ["q_row", "doc_id", "no", "body", "length", "last"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                s = marked(b.column(2)[k].as_py())
                count = -(-len(s) // chunk)
                for i in range(0, count, BLOCK):
                    no = range(i, min(i + BLOCK, count))
                    own = [pa.array([b.column(x)[k].as_py()] * len(no), b.schema.types[x]) for x in (0, 1)]
                    rest = [pa.array(no, pa.int32()), pa.array([s[x * chunk : (x + 1) * chunk + reach] for x in no], pa.string()), pa.array([min(chunk, len(s) - x * chunk) for x in no], pa.int32()), pa.array([x + 1 == count for x in no])]
                    yield pa.RecordBatch.from_arrays(own + rest, names)

    kind = giant.schema["doc_id"].dataType.simpleString()
    return giant.select("q_row", "doc_id", "text").mapInArrow(cut, f"q_row long, doc_id {kind}, no int, body string, length int, last boolean")


def chunk_states(parts: DataFrame, shared) -> DataFrame:
    """q_row, no, q_left, q_right: the states of every chunk on the best path."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True))
            out = [c.matrix(*r, cuts, score).tobytes() for r, (cuts, score, _) in zip(rows, c.middles([r[:2] for r in rows]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["q_row", "no", "m"])

    def combine(key, table):
        table = table.sort_by("no")
        m = None
        for x in table.column("m").to_pylist():
            m = _matrix(x) if m is None else times(m, _matrix(x))
        return pa.table({"q_row": pa.array([key[0].as_py()]), "no": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    kind = "q_row long, no int, m binary"
    levels = [stored(parts.mapInArrow(matrices, kind), "chunk-matrices")]
    most = levels[0].agg(F.max("no")).first()[0]
    while most:  # log(BLOCK, chunks) levels
        most //= BLOCK
        above = levels[-1].withColumn("q_block", F.expr(f"no div {BLOCK}").cast("int")).groupBy("q_row", "q_block").applyInArrow(combine, kind)
        levels.append(stored(above, "block-matrices"))

    def hand_down(key, table):
        """From a block's states, those between its members: a forward pass, then the best path back."""
        table = table.sort_by("no")
        ms = [_matrix(x) for x in table.column("m").to_pylist()]
        left, right = table.column("b_left")[0].as_py(), table.column("b_right")[0].as_py()
        score = [np.where(np.arange(len(ms[0])) == left, 0.0, LOW)]
        for m in ms:
            score.append((score[-1][:, None] + m).max(axis=0))
        states = [right]
        for k in range(len(ms) - 1, 0, -1):
            states.append(int((score[k] + ms[k][:, states[-1]]).argmax()))
        states = [left, *reversed(states)]
        return pa.table({"q_row": table.column("q_row"), "no": table.column("no"), "q_left": pa.array(states[:-1], pa.int32()), "q_right": pa.array(states[1:], pa.int32())})

    # A text starts and ends in state 0.
    states = levels[-1].select("q_row", "no", F.lit(0).alias("q_left"), F.lit(0).alias("q_right"))
    for level in reversed(levels[:-1]):
        block = states.select("q_row", F.col("no").alias("q_block"), F.col("q_left").alias("b_left"), F.col("q_right").alias("b_right"))
        members = level.withColumn("q_block", F.expr(f"no div {BLOCK}").cast("int")).join(block, ["q_row", "q_block"])
        states = members.groupBy("q_row", "q_block").applyInArrow(hand_down, "q_row long, no int, q_left int, q_right int")
    return states


def encode(docs: DataFrame, model: str = V.DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, no, ids: the ids of every text in stretches (one for a text of up to `chunk` characters), in order of no.

    A giant text's ids stay in one row for each chunk, so no row grows with the longest text.
    """
    vocabulary = V.load(model)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.monotonically_increasing_id().alias("q_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    small, large = F.coalesce(F.length("text") < chunk, F.lit(True)), F.length("text") >= chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            ends = np.cumsum([len(t or "") + 1 for t in texts])
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_CHARS, side="right")))
                ids, count, _ = c.segment([marked(t or "") for t in texts[i:j]])
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32), mask=np.array([t is None for t in texts[i:j]] + [False]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.zeros(j - i, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "no", "ids"])
                i = j

    kind = docs.schema[id_col].dataType.simpleString()
    plain = rows.where(small).select("doc_id", "text").mapInArrow(whole, f"doc_id {kind}, no int, ids array<int>")
    parts = stored(chunks(rows.where(large), chunk, codec(vocabulary).reach), "text-chunks")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True))
            ids = [np.array(c.encode_chunk(*r, cuts, middle), dtype=np.int32) for r, (cuts, _, middle) in zip(rows, c.middles([r[:2] for r in rows]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "no", "ids"])

    states = chunk_states(parts, shared)
    traced = parts.join(states, ["q_row", "no"]).select("doc_id", "no", "body", "length", "q_left", "q_right").mapInArrow(trace, f"doc_id {kind}, no int, ids array<int>")
    return plain.unionByName(traced)


def decode(encoded: DataFrame, model: str = V.DEFAULT_MODEL) -> DataFrame:
    """doc_id, no, ids and text: the text of each stretch, so that a text is its stretches joined in order of no."""
    shared = encoded.sparkSession.sparkContext.broadcast(V.load(model))
    names = ["doc_id", "no", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for i in range(0, len(whole), 512):
                b = whole.slice(i, 512)
                lists = b.column(2)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate(([0], np.cumsum(size)))
                text = c.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets, b.column(1).to_numpy(zero_copy_only=False) == 0)
                if lists.null_count:
                    text = pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, text], [*names, "text"])

    return encoded.select(*names).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, no int, ids array<int>, text string")
