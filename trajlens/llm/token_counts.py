"""Token counts of every prefix of a text by dynamic programming.

The encoding of a prefix ends with one piece ``t``, and what stands before ``t``
is itself the encoding of a shorter prefix. So for each prefix it is enough to
know its last piece: among the pieces that end there, it is the one that may
follow the last piece of the prefix it leaves, which is the case when the two
encoded together come out as just these two. The count is that prefix's count
plus one. Such pairs are checked once and remembered.

A text is stored as one signed byte per character, the change of the count from
one prefix to the next. Truncation and budget questions are answered from these
counts; nothing is encoded again.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.piece_model import BLANK, CHUNKS, PieceModel, load, marked

LIMIT = 4096
# Prefixes of chunks and pairs of pieces that one task remembers of each; beyond that it starts anew.
REMEMBERED = 1_000_000
# Chunks longer than this are not remembered.
LONG_CHUNK = 48

_SIGNED = [bytes([b]) for b in range(256)]


def merge(text: str, model: PieceModel) -> list[str]:
    """Byte-pair encoding of a short string: join the best neighbours, the leftmost of equals, until none join."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    waiting: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (score := model.scores.get(parts[i] + parts[j])) is not None:
            heapq.heappush(waiting, (-score, i, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while waiting:
        _, i, joined = heapq.heappop(waiting)
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != joined:
            continue
        j = after[i]
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]


class PrefixCounter:
    """Counts for every prefix of a text, with memory for prefixes and pairs met before."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.longest = max(map(len, model.scores))
        self.rank = {piece: -score for piece, score in model.scores.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[int, str, bytes]] = {"": (0, "", b"")}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose join made the piece; None if its own encoding isn't the piece."""
        if piece not in self.halves:
            whole = len(merge(piece, self.model)) == 1
            cuts = ((piece[:i], piece[i:]) for i in range(1, len(piece)))
            # The last join is that of the two parts that are encodings and stay apart until then.
            self.halves[piece] = next((c for c in cuts if self._made(*c)), None) if whole else None
        return self.halves[piece]

    def _made(self, left: str, right: str) -> bool:
        """Whether both are encodings of themselves and neighbours until their own join."""
        known = all(len(p) == 1 or (p in self.rank and self._halves(p)) for p in (left, right))
        return bool(known) and self._apart(left, right, self.rank[left + right])

    def _created(self, piece: str) -> float:
        return -1.0 if len(piece) == 1 else self.rank[piece]

    def _apart(self, left: str, right: str, until: float) -> bool:
        """Whether no join across the border happens before rank ``until``.

        Both sides are taken apart again, the part made last first. At each step the
        two parts at the border must not join earlier than one of them is used up by
        its own side; of equal ranks the leftmost join comes first.
        """
        left_end = right_end = until
        while True:
            rank = self.rank.get(left + right)
            if rank is not None and rank < left_end and (rank < right_end or rank == right_end < until):
                return False
            made_left, made_right = self._created(left), self._created(right)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left, left_end = self._halves(left)[1], made_left
            else:
                right, right_end = self._halves(right)[0], made_right

    def _follows(self, first: str, second: str) -> bool:
        """Whether the two pieces, encoded together, come out as just these two; an empty first is the text's start."""
        known = self.pairs.get((first, second))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            if BLANK + BLANK in first + second:  # runs of blanks share one rank
                known = merge(first + second, self.model) == [p for p in (first, second) if p]
            elif len(second) > 1 and self._halves(second) is None:
                known = False
            else:
                known = not first or self._apart(first, second, float("inf"))
            self.pairs[first, second] = known
        return known

    def _learn(self, chunk: str) -> tuple[int, str, bytes]:
        """Count, last piece and changes of a chunk, from its longest known prefix on; each prefix is remembered."""
        if len(chunk) > LONG_CHUNK:
            return 0, "", self.long_changes(chunk)
        scores, pairs, prefixes, longest = self.model.scores, self.pairs, self.prefixes, self.longest
        if len(prefixes) >= REMEMBERED:
            prefixes.clear()
            prefixes[""] = (0, "", b"")
        end = len(chunk) - 1
        while (known := prefixes.get(chunk[:end])) is None:
            end -= 1
        for end in range(end + 1, len(chunk) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = chunk[start:end]
                if piece in scores or end - start == 1:
                    count, last, _ = prefixes[chunk[:start]]
                    follows = pairs.get((last, piece))
                    if follows or (follows is None and self._follows(last, piece)):
                        break
            count += 1 if piece in scores else len(piece.encode("utf-8", "surrogatepass"))
            known = prefixes[chunk[:end]] = (count, piece, known[2] + _SIGNED[(count - known[0]) & 255])
        return known

    def long_changes(self, chunk: str) -> bytes:
        """The same for a long chunk, by position instead of by prefix text, so that its cost is linear."""
        scores, follows = self.model.scores, self._follows
        counts, last, changes = [0], [""], []
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = chunk[start:end]
                if (piece in scores or end - start == 1) and follows(last[start], piece):
                    counts.append(
                        counts[start] + (1 if piece in scores else len(piece.encode("utf-8", "surrogatepass")))
                    )
                    last.append(piece)
                    break
            changes.append((counts[end] - counts[end - 1]) & 255)
        return bytes(changes)

    def changes(self, text: str | None) -> bytes:
        """For each character of the text as the model sees it, how the count changes with it (signed bytes)."""
        known, learn = self.prefixes.get, self._learn
        return b"".join([(known(chunk) or learn(chunk))[2] for chunk in CHUNKS.findall(marked(text))])


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_chars, prefix_changes)`` per row; the changes are one signed byte per character.

    With the leading blank that the model puts in front, entry 0 is that blank's
    change and entry i that of the i-th character; the sum up to entry i is the exact
    count of the first i characters (for i = 0 the text is empty: no token).

    * Null or empty text: no entries, 0 bytes. Null id and repeated rows: passed on.
    * Empty table: empty result. Other columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(model_path).plain())
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        counter = PrefixCounter(PieceModel(*model.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array([len(t) if t else 0 for t in texts], pa.int64()),
                    pa.array([counter.changes(t) for t in texts], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_chars", "prefix_changes"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_chars long, prefix_changes binary")


def budget_answers(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``n_tokens``, ``over_limit`` (more than ``limit``) and ``fitting_chars``, and drops the stored counts.

    ``fitting_chars`` is the length of the longest prefix with at most ``limit`` tokens.
    """
    keep = [c for c in counted.columns if c != "prefix_changes"]
    schema = ", ".join(f"{c} {counted.schema[c].dataType.simpleString()}" for c in keep)

    def answer(batches):
        for batch in batches:
            totals, fitting = [], []
            for stored in batch.column("prefix_changes"):
                counts = np.cumsum(np.frombuffer(stored.as_py(), np.int8), dtype=np.int64)
                totals.append(int(counts[-1]) if len(counts) else 0)
                within = np.flatnonzero(counts[1:] <= limit)
                fitting.append(int(within[-1]) + 1 if len(within) else 0)
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(totals, pa.int64()), pa.array([t > limit for t in totals]), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", "over_limit", "fitting_chars"])

    return counted.mapInArrow(answer, f"{schema}, n_tokens long, over_limit boolean, fitting_chars long")


def tokens_of_prefix(counted: DataFrame, chars: str = "chars") -> DataFrame:
    """Adds ``prefix_tokens``, the exact count of the first ``chars`` characters (a column; clipped to the text)."""
    keep = [c for c in counted.columns if c != "prefix_changes"]
    schema = ", ".join(f"{c} {counted.schema[c].dataType.simpleString()}" for c in keep)

    def look(batches):
        for batch in batches:
            found = []
            for changes, n in zip(batch.column("prefix_changes").to_pylist(), batch.column(chars).to_pylist()):
                n = min(max(n or 0, 0), max(len(changes) - 1, 0))
                found.append(int(np.frombuffer(changes[: n + 1], np.int8).sum(dtype=np.int64)) if n else 0)
            arrays = [batch.column(c) for c in keep] + [pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "prefix_tokens"])

    return counted.mapInArrow(look, f"{schema}, prefix_tokens long")
