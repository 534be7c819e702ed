"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability in a language is the
sum, over all ways to cut the word into pieces, of the product of their probabilities; a forward algorithm computes it.
A text's log-likelihood is the sum over its words, and the best language wins (ties: the first in order).

Training is one step of expectation maximisation: over all training rows, pieces are counted by their expected number
under a prior that all languages share (forward and backward pass), and smoothed with that prior. Tasks count words,
compute expected counts for each distinct word once, and emit one row for each language and piece at most, so what is
shuffled and collected is bounded by vocabulary times languages.

Words are letters with the letters and combining marks that follow them in the lower-cased text, marked as a word's start. A
run of more than STRETCH letters (text that is written without spaces, say) is taken by stretches of that length, so a text
costs in proportion to its length whatever it holds. A character that no piece covers counts as one unknown piece. Words
are handled in batches of equal length, all languages at once.

Nulls and odd input: `und` and score 0 if the text is null or has no letter, or if nothing could be learned. Rows
without lang or text teach nothing. Rows are predicted one by one, so repeated rows repeat their result; a null doc_id
hashes as the empty string and is kept. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.llm import vocabulary as V

FOLDS, HELD = 3, 1
STRETCH = 256
#: Below U+0300 there are no combining marks, and a plain class (without the superscripts and fractions) is faster.
BEYOND, PLAIN = re.compile("[\u0300-\U0010ffff]"), re.compile(rf"[^\W\d_²³¹¼½¾]{{1,{STRETCH}}}")
LETTERS = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{STRETCH - 1}}}")
#: Pseudo-counts of the prior in each language.
PRIOR_COUNT = 20_000.0
BATCH_CHARS = 400_000
#: A Python worker forgets its word table beyond so many words.
CACHE = 400_000


def held_out(id_col: str = "doc_id", folds: int = FOLDS, held: int = HELD) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held


class Lattice:
    """Pieces of a vocabulary by hash, and the sums over segmentations of batches of words of equal length."""

    #: An odd multiplier for hashes of code points; its powers wrap at 2 ^ 64.
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        vocabulary = V.load(path)
        self.size = len(vocabulary.pieces) + 1  # the last is the unknown character
        prior = np.append(np.exp(V.log_prior(vocabulary)), 1e-7)
        self.prior = prior / prior.sum()
        ids = vocabulary.ids
        self.longest = max(map(len, ids))
        keys = np.array([self._key(p) for p in ids], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(ids.values()), dtype=np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")

    def _key(self, piece: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in piece:
            h = h * self.BASE + np.uint64(ord(c))
        return int(h[0])

    def spans(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: (start, stop) -> the id of that piece in each word, -1 where it is none."""
        n = len(words[0])
        codes = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        found = {}
        for i in range(n):
            h = np.zeros(len(words), dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * self.BASE + codes[:, j - 1]
                at = np.searchsorted(self.keys, h)
                at[at == len(self.keys)] = 0
                ids = np.where(self.keys[at] == h, self.ids[at], -1)
                if j == i + 1:
                    ids = np.where(ids < 0, self.size - 1, ids)
                elif (ids < 0).all():
                    continue
                found[i, j] = ids
        return found

    @staticmethod
    def _sums(n: int, spans: dict, p: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scaled path sums from the start (or to the end) at each position, and their log scales."""
        width, langs = len(next(iter(spans.values()))), p.shape[1]
        sums, scale = np.zeros((n + 1, width, langs)), np.zeros((n + 1, width, langs))
        sums[n if back else 0] = 1.0
        arcs: dict[int, list] = {}
        for (i, j), ids in spans.items():
            arcs.setdefault(i if back else j, []).append((j if back else i, ids))
        for at in reversed(range(n)) if back else range(1, n + 1):
            before = at + 1 if back else at - 1
            base = scale[before]
            total = np.zeros((width, langs))
            for other, ids in arcs.get(at, ()):
                weight = np.where((ids >= 0)[:, None], p[ids], 0.0)
                total += weight * sums[other] * (1.0 if other == before else np.exp(scale[other] - base))
            grow = np.where(total > 0, total, 1.0)
            sums[at], scale[at] = total / grow, base + np.log(grow)
        return sums, scale

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Words of one length by languages: the log of the sum over all segmentations. p: pieces by languages."""
        n = len(words[0])
        return self._sums(n, self.spans(words), p, back=False)[1][n]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """The expected number of each piece under the prior, over words of one length."""
        n, p = len(words[0]), self.prior[:, None]
        spans = self.spans(words)
        a, a_scale = self._sums(n, spans, p, back=False)
        b, b_scale = self._sums(n, spans, p, back=True)
        total = np.zeros(self.size)
        for (i, j), ids in spans.items():
            on = ids >= 0
            share = np.where(on, self.prior[ids], 0.0) * a[i, :, 0] * b[j, :, 0] * np.exp(a_scale[i, :, 0] + b_scale[j, :, 0] - a_scale[n, :, 0])
            total += np.bincount(ids[on], (share * counts)[on], self.size)
        return total


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of equal length, in batches of a bounded number of characters."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, places in groups.items():
        step = max(1, BATCH_CHARS // (n * 16))
        for i in range(0, len(places), step):
            yield places[i : i + step]


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (LETTERS if BEYOND.search(low) else PLAIN).findall(low)


_kept: dict = {}


def lattice(path: str) -> Lattice:
    if path not in _kept:
        _kept[path] = Lattice(path)
    return _kept[path]


def piece_counts(docs: DataFrame, model: str) -> DataFrame:
    """lang, piece, n: expected counts over all rows of docs (lang, text)."""

    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for lang, words in counts.items():
            marked, total = [V.SPACE + w for w in words], np.zeros(lat.size)
            n = np.array(list(words.values()), dtype=np.float64)
            for places in by_length(marked):
                total += lat.expected([marked[k] for k in places], n[places])
            at = np.nonzero(total > 0)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "piece", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > CACHE:
                yield from emit(counts)
                counts = {}
        yield from emit(counts)

    return docs.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model: str = V.DEFAULT_MODEL) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (pieces by languages) from the rows (lang, text) of docs."""
    rows = piece_counts(docs, model).toPandas()  # languages times vocabulary at most
    langs = sorted(rows["lang"].unique())
    lat = lattice(model)
    table = np.repeat(lat.prior[:, None] * PRIOR_COUNT, len(langs), axis=1) if langs else np.zeros((lat.size, 0))
    place = {x: k for k, x in enumerate(langs)}
    table[rows["piece"].to_numpy(dtype=int), [place[x] for x in rows["lang"]]] += rows["n"].to_numpy()
    return langs, table / table.sum(axis=0, keepdims=True)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, model: str = V.DEFAULT_MODEL) -> DataFrame:
    """docs' columns and lang_pred, score, from its column text only."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table.astype(np.float64))  # vocabulary times languages
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, p = lattice(model), shared.value
        place: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for b in batches:
            if len(place) > CACHE:
                place, scores = {}, np.zeros((0, len(langs)))
            texts = [words_of(t) if t is not None and langs else [] for t in b.column(names.index("text")).to_pylist()]
            new = list({w for words in texts for w in words if w not in place})
            if new:
                more = np.zeros((len(new), len(langs)))
                for places in by_length(new):
                    more[places] = lat.log_probability([V.SPACE + new[k] for k in places], p)
                place.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
                scores = np.concatenate([scores, more])
            pred, best = [], []
            for words in texts:
                if not words:
                    pred.append("und")
                    best.append(0.0)
                    continue
                total = scores[[place[w] for w in words]].sum(axis=0)
                k = int(total.argmax())
                pred.append(langs[k])
                best.append(float(1.0 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i, n in enumerate(names) if n != "text"], pa.array(pred, pa.string()), pa.array(best, pa.float64())], [*[n for n in names if n != "text"], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, model: str = V.DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the rows that are not held out."""
    d = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, table = train(d.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"), model)
    return predict(d.select("doc_id", "held_out", "text"), langs, table, model)
