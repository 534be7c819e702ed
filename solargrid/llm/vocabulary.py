"""The pieces of a public SentencePiece model file.

Only the piece table is read: the text, score and type of each piece, in id order. The file's path is a parameter.
"""

from __future__ import annotations

import functools
import os
from typing import NamedTuple

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: SentencePiece's mark for a space, and its piece types.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary(NamedTuple):
    pieces: tuple[str, ...]
    types: tuple[int, ...]
    scores: tuple[float, ...]

    @property
    def ids(self) -> dict[str, int]:
        """Normal pieces only."""
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER_DEFINED)}

    @property
    def byte_ids(self) -> list[int]:
        """The ids of the 256 byte pieces <0x00> to <0xFF>."""
        found = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        return [found[b] for b in range(256)]


def log_prior(vocabulary: Vocabulary) -> np.ndarray:
    """A log-probability for each id where none is learned: Zipf's law over the ids, which run from frequent to rare.

    A merge-built file scores its pieces by rank, which is an order and no probability. Byte pieces come last.
    """
    rank = np.arange(len(vocabulary.pieces), dtype=np.float64)
    rank[np.array(vocabulary.types) == BYTE] = len(rank)
    weight = 1.0 / (rank + 10.0)
    return np.log(weight / weight.sum())


@functools.lru_cache(maxsize=4)
def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer model at {path}")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    kind = lambda i: UNKNOWN if m.is_unknown(i) else CONTROL if m.is_control(i) else BYTE if m.is_byte(i) else UNUSED if m.is_unused(i) else NORMAL
    return Vocabulary(tuple(m.id_to_piece(i) for i in range(n)), tuple(kind(i) for i in range(n)), tuple(m.get_score(i) for i in range(n)))
