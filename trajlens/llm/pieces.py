"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once. At each character its
output links name every piece that ends there, longest first, and each of them
relaxes the best score of the path that ends at this position (Viterbi). The
encoding is the path with the highest sum of piece scores; of equal sums the one
whose last piece is longest wins. A character without a piece costs more than any
piece and becomes its UTF-8 bytes.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.piece_model import BYTE, CHUNKS, NORMAL, PieceModel, load, marked

UNKNOWN_PENALTY = 10.0
# Chunks that one task remembers, and the longest chunk it does remember.
REMEMBERED, LONG_CHUNK = 500_000, 48


class PieceEncoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.unknown = min(model.scores.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in model.scores.items():
            self.automaton.add_word(piece, (len(piece), score, model.ids[piece]))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[bytes, float]] = {}

    def _best(self, chunk: str) -> tuple[bytes, float]:
        """The ids (32-bit) and the score of a chunk's best path."""
        size = len(chunk)
        best, came = [0.0] + [float("-inf")] * size, [(0, -1)] * (size + 1)
        reached = 0  # positions before it have their final score

        def settle(upto: int) -> None:
            nonlocal reached
            while reached < upto:
                if chunk[reached] not in self.model.scores and best[reached] + self.unknown > best[reached + 1]:
                    best[reached + 1], came[reached + 1] = best[reached] + self.unknown, (reached, -1)
                reached += 1

        for last, (length, score, piece) in self.automaton.iter(chunk):
            settle(last)
            start, end = last + 1 - length, last + 1
            if best[start] + score > best[end]:
                best[end], came[end] = best[start] + score, (start, piece)
        settle(size)
        ids: list[int] = []
        at = size
        while at:
            start, piece = came[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.model.bytes_at[b] for b in reversed(chunk[start:at].encode("utf-8", "surrogatepass")))
            at = start
        return np.array(ids[::-1], np.int32).tobytes(), best[size]

    def encode(self, text: str | None) -> tuple[bytes, float]:
        """Ids (32-bit) and score of a whole text."""
        known, found, score = self.known, [], 0.0
        for chunk in CHUNKS.findall(marked(text)):
            path = known.get(chunk)
            if path is None:
                path = self._best(chunk)
                if len(chunk) <= LONG_CHUNK:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = path
            found.append(path[0])
            score += path[1]
        return b"".join(found), score


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, score)`` per row: the best path over the whole text and its summed score.

    * Null or empty text: no ids, score 0. Null id and repeated rows: passed on, one result per row.
    * Characters outside the model: their bytes. Empty table: empty result. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(model_path).plain())
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches):
        encoder = PieceEncoder(PieceModel(*model.value))
        for batch in batches:
            for at in range(0, len(batch), 500):  # bounds the ids held at a time
                part = batch.slice(at, 500)
                paths = [encoder.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0] + [len(ids) // 4 for ids, _ in paths], dtype=np.int32)
                values = np.frombuffer(b"".join(ids for ids, _ in paths), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.array([score for _, score in paths], pa.float64()),
                    ],
                    names=["doc_id", "ids", "score"],
                )

    return source.mapInArrow(encode, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, score double")


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text that the ids stand for. The mark in front goes, other marks become blanks.

    Null ids and control pieces add nothing. A text that itself holds the blank mark
    (U+2581) comes back with blanks there; bytes that aren't UTF-8 become U+FFFD.
    """
    model = load(model_path)
    said = [b""] * len(model.pieces)
    for i, (piece, kind) in enumerate(zip(model.pieces, model.types)):
        if kind == NORMAL:
            said[i] = marked(piece)[1:].replace("▁", " ").encode()
        elif kind == BYTE:
            said[i] = bytes([model.bytes_at.index(i)])
    table = encoded.sparkSession.sparkContext.broadcast(said)
    keep = [c for c in encoded.columns if c != text_col]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def decode(batches):
        pieces = table.value
        for batch in batches:
            column, texts = batch.column(keep.index(ids_col)), []
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                text = b"".join([pieces[i] for i in values[a:b].tolist()]).decode("utf-8", "replace")
                texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, text_col])

    return encoded.select(*keep).mapInArrow(decode, f"{schema}, `{text_col}` string")
