"""The pieces of a SentencePiece model file, and how texts fall into independent chunks.

The normalisation of these models is the identity: a blank becomes the blank
mark, one mark is put in front of a text that isn't empty, and nothing else
changes. No piece crosses from another character to a following mark, from a Latin
letter to one of ``.,!?;:``, or into or out of a line break, so texts are cut at
these places into chunks that are encoded independently. ``load`` checks all this.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BLANK = "▁"
_LATIN, _POINTS = "A-Za-z\u00c0-\u024f", ".,!?;:"
CHUNKS = re.compile(f"{BLANK}*[{_LATIN}]+(?=[{_POINTS}{BLANK}\n]|$)|{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_CROSSING = re.compile(f"[^{BLANK}]{BLANK}|[{_LATIN}][{_POINTS}]|\n.|.\n")

# Piece types of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class PieceModel:
    """``scores`` and ``ids`` by piece, the ids of the 256 bytes, and all pieces by id."""

    scores: dict[str, float]
    ids: dict[str, int]
    bytes_at: tuple[int, ...]
    pieces: tuple[str, ...]
    types: tuple[int, ...]

    def plain(self) -> tuple:
        """The fields as built-in types, fit for a broadcast that executors read without this package."""
        return self.scores, self.ids, self.bytes_at, self.pieces, self.types


def load(path: str) -> PieceModel:
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    proto = model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    normal = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
    ids = {p.piece: i for i, p in enumerate(proto.pieces)}
    rules = proto.normalizer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
    if not plain or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normalisation isn't the identity")
    if not proto.trainer_spec.byte_fallback or any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
        raise ValueError("only models with byte fallback and without user-defined or unused pieces are supported")
    if any(_CROSSING.search(piece) for piece in normal):
        raise ValueError("a piece crosses a border between chunks")
    return PieceModel(
        normal,
        {p: ids[p] for p in normal},
        tuple(ids[f"<0x{b:02X}>"] for b in range(256)),
        tuple(p.piece for p in proto.pieces),
        tuple(p.type for p in proto.pieces),
    )


def marked(text: str | None) -> str:
    """The text as the model sees it."""
    return BLANK + text.replace(" ", BLANK) if text else ""
