"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Byte-pair merging has a local rule: a row of pieces is what a text merges into if, and only if, each
two neighbours are what those two merge into alone.  So the last piece of a prefix is the one piece
that ends there and that its forerunner tolerates, and the count of the prefix is one more than that
of the forerunner.  One walk over a text gives the count of each prefix; how many tokens a cut text
has, and where to cut it for a budget, are then read off without encoding again.

Pieces never continue past white space that follows another character, nor past a line end, so words
are walked alone and short ones are remembered within a task.  Counts are kept as one signed byte per
character: the step from one prefix to the next, which is negative where pieces merge.

Defined cases: null or empty text has no tokens and no steps; control strings in a text are ordinary
characters; a character without a piece counts as its bytes; a text of any length takes time and room
in proportion, with or without spaces; repeated rows are counted one by one; a null doc_id stays null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
REMEMBERED = 400_000  # words that a task keeps; all are forgotten when it has that many
LONGEST_KEPT = 48  # characters of a word that is worth remembering
PAIRS_KEPT = 2_000_000
ROWS = 256
PREFIX_COUNTS = "doc_id long, n_chars long, n_bytes long, n_tokens long, steps binary"


class PrefixCounter:
    """Counts of one byte-pair model file of the sentencepiece library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.pieces = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = [model.get_score(i) for i in range(n)]
        self.has_bytes = any(model.is_byte(i) for i in range(n))
        self.starts = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        if any(len(p) > 1 and ("\n" in p or re.search(f"[^{MARK}]{MARK}", p)) for p in self.pieces):
            raise ValueError("a piece spans words or lines")
        if any(c not in self.pieces for p in self.pieces for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.text = {i: p for p, i in self.pieces.items()}
        self.whole = {p: i for p, i in self.pieces.items() if self.merged(p) == [p]}  # others never survive
        self.size = n
        self.agrees: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, int]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that a short text merges into: the best scored neighbours first, the leftmost of equals."""
        parts, right, left = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and right[a] < len(text):
                both = parts[a] + parts[right[a]]
                if both in self.pieces:
                    heapq.heappush(heap, (-self.score[self.pieces[both]], a, both))

        for a in range(len(text)):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a]
            if not parts[a] or b >= len(text) or parts[a] + parts[b] != both:
                continue  # one of the two has merged meanwhile
            parts[a], parts[b], right[a] = both, "", right[b]
            if right[a] < len(text):
                left[right[a]] = a
            offer(left[a])
            offer(a)
        return [p for p in parts if p]

    def tolerates(self, last: int, piece: int) -> bool:
        """Whether the two stay as they are when they meet."""
        key = last * self.size + piece
        found = self.agrees.get(key)
        if found is None:
            if len(self.agrees) >= PAIRS_KEPT:
                self.agrees.clear()
            a, b = self.text[last], self.text[piece]
            found = self.agrees[key] = self.merged(a + b) == [a, b]
        return found

    def steps(self, word: str) -> tuple[bytes, int]:
        """(step of the count at each character, count) of one word."""
        n = len(word)
        count, last = [0] * (n + 1), [-2] * (n + 1)  # last piece of each prefix; -1 is a boundary, -2 not known yet
        last[0] = -1
        whole, starts, agrees, size = self.whole, self.starts, self.agrees, self.size
        for at in range(n):
            before, here = last[at], count[at] + 1
            end = at + 1
            part = word[at]
            if part not in starts:  # no piece has it: its bytes, and nothing merges across
                last[end], count[end] = -1, count[at] + (len(part.encode()) if self.has_bytes else 1)
                continue
            while True:
                if last[end] == -2:
                    piece = whole.get(part)
                    if piece is not None:
                        fits = before < 0 or agrees.get(before * size + piece)
                        if fits is None:
                            fits = self.tolerates(before, piece)
                        if fits:
                            last[end], count[end] = piece, here
                if end == n:
                    break
                end += 1
                part = word[at:end]
                if part not in starts:
                    break
        return bytes([b - a & 255 for a, b in itertools.pairwise(count)]), count[n]

    def prefixes(self, text: str | None) -> tuple[bytes, int]:
        """(step of the count at each character, count) of a text."""
        if not text:
            return b"", 0
        parts, total, known = [], 0, self.known
        for word in SEGMENT.findall(MARK + text.replace(" ", MARK)):
            found = known.get(word)
            if found is None:
                found = self.steps(word)
                if len(word) <= LONGEST_KEPT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = found
            parts.append(found[0])
            total += found[1]
        steps = b"".join(parts)  # the mark before the text has a step of its own, which the first character takes over
        first = np.frombuffer(steps[:2], np.int8).sum(dtype=np.int8)
        return first.tobytes() + steps[2:], total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_bytes, n_tokens, steps) per row; the count of a prefix of k characters is the sum of its k steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)  # once per worker
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                texts = part.column(1).to_pylist()
                found = [own.prefixes(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                        pa.array([f[1] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.binary()),
                    ],
                    names=["doc_id", "n_chars", "n_bytes", "n_tokens", "steps"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PREFIX_COUNTS)


def cut_points(counts: DataFrame, limit: int) -> DataFrame:
    """(doc_id, kept_chars, kept_tokens): the longest prefix of at most ``limit`` tokens, read off stored counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, tokens = [], []
            for steps in batch.column(1):
                sums = np.cumsum(np.frombuffer(steps.as_py(), np.int8), dtype=np.int64)
                fits = np.flatnonzero(sums <= limit)
                chars.append(int(fits[-1]) + 1 if len(fits) else 0)
                tokens.append(int(sums[fits[-1]]) if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "kept_chars", "kept_tokens"])

    return counts.select("doc_id", "steps").mapInArrow(run, "doc_id long, kept_chars long, kept_tokens long")


def tokens_at(counts: DataFrame, chars: int) -> DataFrame:
    """(doc_id, n_tokens) of the first ``chars`` characters, read off stored counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(s.as_py()[:chars], np.int8).sum(dtype=np.int64)) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return counts.select("doc_id", "steps").mapInArrow(run, "doc_id long, n_tokens long")
