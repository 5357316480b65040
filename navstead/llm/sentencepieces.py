"""SentencePiece encoding by Viterbi over a double-array trie of scored pieces, and decoding.

Pieces and log scores come from a model file.  White space becomes the marker U+2581 and a text starts
with one.  The best path maximises the sum of scores; a character that no piece covers costs
ten below the lowest score and is encoded as its bytes (or as the unknown piece, without byte pieces).
No piece continues past a marker that follows another character, so words are solved alone and
remembered within a task.

Defined cases: null or empty text has no ids; equal paths go to the longer last piece; a space
character U+2581 in a text can't be told from white space, and decodes to it; repeated rows are encoded
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
REMEMBERED = 300_000  # words in each of the two generations that a task keeps
UNKNOWN_PENALTY = 10.0
SEARCHED = 1024  # slots looked at together when a node's children are placed


class DoubleArray:
    """Bytes to ids: the child of node n by byte b is base[n] + b + 1 if check there is n; id of a node or -1."""

    def __init__(self, words: dict[bytes, int]) -> None:
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, number in words.items():
            n = 0
            for b in word:
                if b not in tree[n]:
                    tree[n][b] = len(tree)
                    tree.append({})
                    ends.append(-1)
                n = tree[n][b]
            ends[n] = number
        size = 2 * len(tree) + 4 * SEARCHED
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        marks = bytearray(size)
        used = np.frombuffer(marks, bool)
        marks[0], free, dense = 1, 1, 0
        todo = [(0, 0)]  # (node of the tree, slot)
        for node, slot in todo:
            self.value[slot] = ends[node]
            if not tree[node]:
                continue
            children = sorted(tree[node])
            free = marks.find(0, free)
            begin, first = max(0, free - children[0] - 1), 0
            begin = begin if len(children) == 1 else max(begin, dense - SEARCHED // 2)
            while len(children) > 1 or free <= children[0]:  # the first base whose slots are free for all children
                taken = np.zeros(SEARCHED, bool)
                for b in children:
                    taken |= used[begin + b + 1 : begin + b + 1 + SEARCHED]
                first = int(taken.argmin())
                if not taken[first]:
                    break
                begin += SEARCHED
            self.base[slot] = begin + first
            dense = begin if len(children) > 1 else dense
            for b in children:
                at = begin + first + b + 1
                self.check[at], marks[at] = slot, 1
                todo.append((tree[node][b], at))


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        self.text = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_id = {int(self.text[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte = {i: b for b, i in self.byte_id.items()}
        self.raw = [b"" if special[i] else bytes([self.byte[i]]) if i in self.byte else self.text[i].encode() for i in range(n)]
        normal = [i for i in range(n) if not special[i] and i not in self.byte]
        self.score = [model.get_score(i) for i in range(n)]
        self.unknown_score = min(self.score[i] for i in normal) - UNKNOWN_PENALTY
        self.trie = DoubleArray({self.text[i].encode(): i for i in normal})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best path over one word."""
        data = word.encode()
        n = len(data)
        best: list[float] = [0.0] + [float("-inf")] * n
        origin, last = [0] * (n + 1), [-1] * (n + 1)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        begin = 0
        while begin < n:
            here, lead = best[begin], data[begin]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, end, single = 0, begin, begin + width
            covered = False
            for b in data[begin:]:
                child = base[node] + b + 1
                if check[child] != node:
                    break
                node = child
                end += 1
                piece = value[node]
                if piece >= 0:
                    if end == single:
                        covered = True
                    total = here + score[piece]
                    if total > best[end]:
                        best[end], origin[end], last[end] = total, begin, piece
            if not covered and here + self.unknown_score > best[single]:
                best[single], origin[single], last[single] = here + self.unknown_score, begin, -1
            begin = single
        out: list[int] = []
        at = n
        while at:
            begin, piece = origin[at], last[at]
            if piece >= 0:
                out.append(piece)
            elif self.byte_id:
                out += [self.byte_id[b] for b in reversed(data[begin:at])]
            else:
                out.append(self.unknown)
            at = begin
        return out[::-1]

    def solved(self, word: str) -> bytes:
        """Packed ids of a word that the young generation lacks; the old one is asked before the trie."""
        ids = self.old.get(word)
        if ids is None:
            ids = array.array("i", self.viterbi(word)).tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        parts, look = [], self.young.get
        for word in SEGMENT.findall(MARK + text.replace(" ", MARK)):
            ids = look(word)
            if ids is None:
                ids = self.solved(word)
                look = self.young.get
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes join to characters, markers become spaces, and the first one goes."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row."""

    shared = docs.sparkSession.sparkContext.broadcast(pieces(model))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                packed = [coder.packed(t.as_py()) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, ids_crc32, text) of rows (doc_id, ids)."""

    shared = rows.sparkSession.sparkContext.broadcast(pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        is_byte = np.isin(np.arange(len(coder.raw)), list(coder.byte))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(1)
                flat, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum([0, *[n or 0 for n in lists.value_lengths().to_pylist()]])
                ids = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                columns = [
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([coder.decode(x.tolist()) for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, text string")
