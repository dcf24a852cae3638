"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from a hash of its code point
alone. A trigram's vector is the product of its letters' vectors, each rotated by
its place; a text's vector is the sum of its trigrams' vectors; a language's
prototype is the sum over its training texts. A text gets the language whose
prototype has the largest cosine with it.

Training sums partial prototypes (dimensions x languages numbers per partition)
with an ordinary aggregation, so the driver sees one vector for each language.

Defined results: null text, and text without a letter, is ``und`` with score 0;
ties go to the first language in order; with no training rows all is ``und``;
a null id counts as held out. Only the text enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm.common import held_out, own_worker, table

DIMENSIONS = 1024
SEED = 20240613
#: Letters of texts that are worked on at once (or one text), and different trigrams; they bound the memory of a task.
BLOCK, SLICE = 1 << 19, 8_192


def _letter_vector(code: int) -> np.ndarray:
    """+1/-1 by the bits of a counter-based generator that is keyed by the code point."""
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return 2 * bits - 1


class _Letters:
    """Letter ids and vectors (a byte a dimension), found as they occur; id 0 is the gap between words."""

    def __init__(self) -> None:
        self.id_of = np.full(0x110000, -1, np.int32)
        self.table = np.empty((256, DIMENSIONS), np.int8)
        self.table[0], self.size = _letter_vector(32), 1

    def ids(self, points: np.ndarray) -> np.ndarray:
        out = self.id_of[points]
        if (out < 0).any():
            for c in np.unique(points[out < 0]):
                if chr(c).isalpha():
                    if self.size == len(self.table):
                        self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    self.table[self.size] = _letter_vector(int(c))
                    self.id_of[c] = self.size
                    self.size += 1
                else:
                    self.id_of[c] = 0
            out = self.id_of[points]
        return out

    def trigram_vectors(self, trigrams: np.ndarray) -> np.ndarray:
        """Bound vectors: the letters', permuted by their places, multiplied."""
        out = np.roll(self.table[trigrams >> 42], 2, axis=1)
        out *= np.roll(self.table[(trigrams >> 21) & 0x1FFFFF], 1, axis=1)
        out *= self.table[trigrams & 0x1FFFFF]
        return out


_LETTERS: list[_Letters] = []


def _forget() -> None:
    _LETTERS.clear()


def _letters() -> _Letters:
    if not _LETTERS:
        _LETTERS.append(_Letters())
    return _LETTERS[0]


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams (runs of other characters count as one gap) and their counts; None without a letter."""
    ids = _letters().ids(np.frombuffer(((text or "") + " ").lower().encode("utf-32-le"), np.uint32)).astype(np.int64)
    ids = np.concatenate(([0], ids))
    ids = ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]
    if len(ids) < 3:
        return None
    return np.unique((ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:], return_counts=True)


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of texts: the indexes of those with letters, and in slices counts (texts x trigrams) with the trigrams' vectors.

    A slice has up to ``SLICE`` trigrams, so a text with very many different ones takes no more memory than others.
    """
    at = 0
    while at < len(texts):
        kept, found, letters = [], [], 0
        while at < len(texts) and letters < BLOCK and len(kept) < 128:
            if (c := trigram_counts(texts[at])) is not None:
                kept.append(at)
                found.append(c)
                letters += len(texts[at])
            at += 1
        if kept:
            yield kept, _slices(found)


def _slices(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    every = np.unique(np.concatenate([t for t, _ in found]))
    for i in range(0, len(every), SLICE):
        part = every[i : i + SLICE]
        counts = np.zeros((len(found), len(part)), np.float32)
        for row, (trigrams, n) in enumerate(found):
            a, b = np.searchsorted(trigrams, (part[0], part[-1] + 1))
            counts[row, np.searchsorted(part, trigrams[a:b])] = n[a:b]
        yield counts, _letters().trigram_vectors(part)


def bundles(slices: Iterator[tuple[np.ndarray, np.ndarray]], dtype: type = np.float32) -> np.ndarray:
    """Texts x dimensions: the sum of each text's trigram vectors."""
    total = 0
    for counts, vectors in slices:
        total = total + counts.astype(dtype) @ vectors.astype(dtype)
    return total


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows with text and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("langid", _forget)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for kept, slices in _blocks(texts):
                # Texts of a language are added up before they are bundled.
                of = np.array([langs[i] for i in kept], object)
                names = sorted(set(of))
                member = np.array([of == lang for lang in names], np.float64)
                for lang, v in zip(names, bundles(((member @ counts, vectors) for counts, vectors in slices), np.float64)):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))], ["lang", "dim", "value"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    parts = rows.mapInArrow(run, "lang string, dim int, value long")
    out: dict[str, np.ndarray] = {}
    for lang, dim, value in parts.groupBy("lang", "dim").agg(F.sum("value")).collect():
        out.setdefault(lang, np.zeros(DIMENSIONS))[dim] = value
    return {k: (v / np.linalg.norm(v)) for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score: the nearest prototype's language and its cosine, at least 0."""
    names = [*prototypes]
    matrix = np.array([prototypes[k] for k in names], np.float32).T if names else np.zeros((DIMENSIONS, 0), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("langid", _forget)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for kept, slices in _blocks(texts) if names else ():
                bundle = bundles(slices)
                near = (bundle @ matrix) / np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)[:, None]
                best = near.argmax(1)
                for i, b, s in zip(kept, best, near.max(1)):
                    lang[i], score[i] = names[b], min(1.0, max(0.0, float(s)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(lang), pa.array(score, pa.float64())], ["_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
