"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point.  An n-gram binds its letters:
the product of their vectors, each rotated by its place.  A text bundles (adds) its n-grams, a
language's prototype bundles those of its documents, and a text goes to the prototype of highest
cosine.  Counts of n-grams per language are integers added over all learned documents, so
prototypes do not depend on the order of work; one number per letter n-gram, language and document
leaves a task, never a text.

Defined cases: null text or one without letters is ``und`` with score 0; texts of one or two letters are
padded with word edges, as all words are; equal cosines go to the first language by name; without any
labelled document every text is ``und``; repeated rows count and are judged one by one; a null doc_id is
never held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

DIM, N = 1024, 3
GRAM = 21  # bits of a code point
UNDETERMINED = "und"
SLICE = 256  # texts at a time


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_codes(text: str | None) -> np.ndarray:
    """Letter trigrams of a text as integers, in order; words have an edge (0) on either side."""
    points = letter_table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[0], points, [0]]).astype(np.int64)
    points = points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]  # one edge between words
    return points[:-2] << 2 * GRAM | points[1:-1] << GRAM | points[2:] if len(points) > 2 else np.empty(0, np.int64)


@functools.lru_cache(maxsize=65536)
def letter_vector(point: int) -> np.ndarray:
    return np.random.default_rng([point, DIM]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """One bound vector per n-gram."""
    out = np.ones((len(codes), DIM), np.int8)
    for place in range(N):
        points, at = np.unique(codes >> GRAM * (N - 1 - place) & (1 << GRAM) - 1, return_inverse=True)
        letters = np.array([np.roll(letter_vector(int(p)), place) for p in points], np.int8).reshape(-1, DIM)
        out *= letters[at.ravel()]
    return out


def gram_counts(learned: DataFrame) -> DataFrame:
    """(lang, gram, n) over documents (lang, text), counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a in range(0, batch.num_rows, SLICE):
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(langs[a : a + SLICE], batch.column(1).slice(a, SLICE), strict=True):
                    by.setdefault(lang, []).append(gram_codes(text.as_py()))
                for lang, codes in by.items():
                    grams, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    return learned.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype per language: DIM numbers each, whatever the corpus."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, grams, n = (batch.column(i) for i in range(3))
            langs = np.array(langs.to_pylist(), object)
            for a in range(0, batch.num_rows, 4096):
                part = slice(a, a + 4096)
                vectors = gram_vectors(grams.to_numpy()[part]).astype(np.int64) * n.to_numpy()[part, None]
                for lang in set(langs[part]):
                    total[lang] = total.get(lang, 0) + vectors[langs[part] == lang].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = counts.mapInArrow(bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    out = {}
    for r in sums.select("lang", "v.x").orderBy("lang").collect():  # languages times DIM numbers
        v = np.array(r.x, np.float64)
        if v.any():
            out[r.lang] = (v / np.sqrt((v * v).sum())).astype(np.float64)
    return out


def predicted(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the best cosine, cut to 0 to 1."""
    codes = [np.unique(gram_codes(t), return_counts=True) for t in texts]
    every, at = np.unique(np.concatenate([c for c, _ in codes]), return_inverse=True)
    vectors = gram_vectors(every).astype(np.float32)
    langs, scores, begin = [], [], 0
    for grams, n in codes:
        mine, begin = at[begin : begin + len(grams)], begin + len(grams)
        if not len(grams) or not names:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            continue
        bundle = (n.astype(np.float32) @ vectors[mine]).astype(np.float64)  # sums of integers: exact below 2**24
        cosine = matrix @ bundle / max(np.sqrt((bundle * bundle).sum()), 1e-9)
        best = int(np.argmax(np.round(cosine, 9)))
        langs.append(names[best])
        scores.append(float(min(1.0, max(0.0, round(cosine[best], 6)))))
    return langs, scores


def language_id(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) per row; prototypes come from rows of known language that ``learn`` chooses."""
    known = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    learned = docs.sparkSession.sparkContext.broadcast(prototypes(cut_lineage(gram_counts(known))))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(learned.value)
        matrix = np.array([learned.value[n] for n in names]).reshape(-1, DIM)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                langs, scores = predicted(part.column(1).to_pylist(), names, matrix)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
