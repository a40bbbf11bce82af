"""A unigram piece model over the pieces of a public SentencePiece file.

The file is a BPE model: it has merge ranks, not probabilities, and tokenizers
are never trained here. The unigram log-probabilities follow from the ranks by
Zipf's law, ``-ln(rank + 3) - ln(sum of 1 / (rank + 3))``; a character without a
piece is written as its UTF-8 bytes, each with ``BYTE_SCORE``.

Text convention: a space marker is put before the text and stands for every
space; a pre-token is one marker with all that follows up to the next space.
Pieces with an inner marker or a line end are left out, so the best and the sampled
segmentations of a text are those of its pre-tokens, one after the other. The
file's marker is ``▁``; here it is a code point that no text can hold (a lone
surrogate), so a ``▁`` in a text is written as bytes and decoding is exact.
"""

from __future__ import annotations

import math
from typing import NamedTuple

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FILE_SPACE = "▁"
SPACE = "\ud800"
BYTE_SCORE = -14.0


class Pieces(NamedTuple):
    ids: dict[str, int]        # piece -> id, without byte pieces
    scores: dict[str, float]   # piece -> log-probability
    byte_ids: list[int]        # byte value -> id
    raw: list[bytes]           # id -> the bytes of the text it stands for
    longest: int


def load(path: str = MODEL) -> Pieces:
    """Read the pieces (on the driver; the result is bounded by the vocabulary
    and is broadcast)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    texts = [model.id_to_piece(i) for i in range(size)]
    byte_ids = [0] * 256
    ids = {}
    for i, p in enumerate(texts):
        if model.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or FILE_SPACE in p[1:] or "\n" in p):
            ids[p.replace(FILE_SPACE, SPACE)] = i
    total = math.log(sum(1 / (r + 3) for r in range(len(ids))))
    scores = {p: -math.log(r + 3) - total for r, p in enumerate(ids)}
    raw = [p.replace(FILE_SPACE, " ").encode() for p in texts]
    for value, i in enumerate(byte_ids):
        raw[i] = bytes([value])
    return Pieces(ids, scores, byte_ids, raw, max(map(len, ids)))


def pre_tokens(text: str) -> list[str]:
    """``text`` cut at its spaces; each stands for a marker and itself. The number
    of pre-tokens is the number of spaces plus one (none for an empty text)."""
    return text.split(" ") if text else []


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of a sequence of ids (without the marker before it)."""
    return b"".join([pieces.raw[i] for i in ids])[1:].decode("utf-8", "replace")
