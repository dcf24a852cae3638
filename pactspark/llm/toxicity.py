"""Toxicity by maximum-scoring segments.

Training (rows with a label that aren't held out; a bounded sample of
``TRAIN_ROWS`` by hash order):

* features are words and word beginnings. A feature counts once for each row that holds
  it; each pair of neighbours that a word stands between counts in one row of a class only,
  so copied passages don't outweigh independent use;
* each feature that at least ``MIN_COUNT`` rows hold gets its log-odds between toxic and clean
  rows with an informative Dirichlet prior (``PRIOR`` times its share of all rows), lowered by
  ``DEVIATIONS`` standard deviations. What is then above ``DRIFT`` speaks for toxicity;
* a word scores as its most specific known feature; all other words pull down by
  ``DRIFT``.

Scoring finds all maximal scoring segments of a text in one pass (each is a passage
that no extension improves). Extreme-value calibration: the tail of segment scores in
clean training rows is fitted by an exponential law, so ``n K exp(-lambda s)`` segments
of score s are expected in n words by chance; the sum statistic over all of a text's
segments, the best first, gives a p-value, and a logistic fit turns ``-ln p`` into the score.
Both fits see each training row as scored by features that were counted in the other
``FOLDS - 1`` folds, so they hold for rows that weren't trained on.

The features of up to ``BROADCAST_FEATURES`` (12 bytes each, by 64-bit hash) are broadcast. A
larger model stays a table, and words meet it in a join; the results are the same.

Defined results: null and empty texts get the score of a text without any segment;
without labels or without a class all scores are 0; a null id counts as held out;
a row labelled twice counts by its largest label; equal rows count once in training and
as often as they occur in scoring. Only the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm.common import DOCUMENT_COLUMNS, free, held_out, materialise, own_worker, table

#: At most so many labelled rows train a model, the first by hash of the id.
TRAIN_ROWS = 12_000
FOLDS = 4
THRESHOLD = 0.7
#: Lengths of the word beginnings that are features.
PREFIXES = (3, 4, 5, 6, 7)
_LONGEST_FIRST = PREFIXES[::-1]
MIN_COUNT = 5
PRIOR = 0.5
#: Least prior counts of a feature in toxic and in clean rows.
LEAST_PRIOR = 0.05, 0.02
DEVIATIONS = 2.0
DRIFT, LOWEST = 0.5, -4.0
BROADCAST_FEATURES = 2_000_000
#: Segments that chance brings to a text at most so often are reported as passages.
EXPECTED = 0.05

WORD = re.compile(r"\w+")
_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
_SCORED = "score double, passages array<struct<start: long, `end`: long, score: double, expected: double>>"


def maximal_segments(scores: list[tuple[int, float]], n: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word + 1, score) of n words.

    ``scores`` lists (index, score) of the words that don't score ``-drift``, in order.
    Linear: each candidate is pushed once and merged at most once.
    """
    out: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        first, left = i, total
        total += s
        # Join with earlier candidates until one starts lower and ends at least as high.
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= total:
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
        out.append((first, i + 1, left, total))
    return [(a, b, r - q) for a, b, q, r in out]


def feature_keys(word: str) -> list[int]:
    """Hashes (those of Spark's xxhash64) of a word's features, the most specific first."""
    n, digest = len(word), xxhash.xxh64_intdigest
    if word.isascii():  # characters are bytes
        raw = word.encode()
        return [digest(raw, 42), *[digest(raw[:k] + b"*", 42) for k in _LONGEST_FIRST if n > k]]
    return [digest(word.encode(), 42), *[digest((word[:k] + "*").encode(), 42) for k in _LONGEST_FIRST if n > k]]


@dataclass
class Model:
    """What scoring needs: sorted hashes of features with their odds, or else a table (key, odds) of them; the calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    features: DataFrame | None = None
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    offset: float = -1000.0

    def look_up(self, words: set[str], known: dict[str, float]) -> None:
        """Put the scores of new words into ``known``."""
        new = [w for w in words if w not in known]
        if not new or not len(self.keys):
            known.update(dict.fromkeys(new, -DRIFT))
            return
        found = [feature_keys(w) for w in new]
        sizes = np.array([len(x) for x in found])
        asked = np.array([k for x in found for k in x], np.uint64)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == asked)
        word, first = np.unique(np.repeat(np.arange(len(new)), sizes)[hit], return_index=True)
        scores = np.full(len(new), -DRIFT)
        scores[word] = self.odds[at[hit[first]]]
        known.update(zip(new, scores.tolist()))

    def segments(self, words: list[str], known: dict[str, float]) -> list[tuple[int, int, float]]:
        self.look_up({*words}, known)
        return marked_segments([(i, s) for i, w in enumerate(words) if (s := known[w]) != -DRIFT], len(words))

    def expected(self, score: float, n: int) -> float:
        """How many segments of at least this score chance brings to n words."""
        return max(n, 1) * self.scale * math.exp(-self.rate * score)

    def surprise(self, scores: list[float], n: int) -> float:
        """-ln p of the best r segments together, for the r of least p; 0 without segments, 50 at most."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += -math.log(max(self.expected(s, n), 1e-300))
            if total <= 0:
                break
            if total > r:
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return min(best, 50.0)

    def score(self, scores: list[float], n: int) -> float:
        z = self.slope * self.surprise(scores, n) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def passages(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        """The segments that chance hardly brings, with how often it does."""
        return [(a, b, s, e) for a, b, s in found if (e := self.expected(s, n)) <= EXPECTED]


def marked_segments(marked: list[tuple[int, float]], n: int) -> list[tuple[int, int, float]]:
    """Maximal segments of n words, of which ``marked`` don't score ``-DRIFT``."""
    return maximal_segments(marked, n) if any(s > 0 for _, s in marked) else []


def _remembered(known: dict[str, float], most: int = 150_000) -> dict[str, float]:
    if len(known) > most:
        known.clear()
    return known


def _split(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _words(rows: DataFrame) -> DataFrame:
    """(row, fold, toxic, words) of (row, fold, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words = [_split(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("fold"), part.column("toxic"), pa.array(words, pa.list_(pa.string()))], ["row", "fold", "toxic", "words"])

    return rows.select("row", "fold", "toxic", "text").mapInArrow(run, "row long, fold int, toxic int, words array<string>")


def feature_counts(rows: DataFrame) -> DataFrame:
    """key, t0, c0, t1, c1, ...: how many toxic and clean rows of each fold hold a feature (by hash)."""
    each = _words(rows).selectExpr("row", "fold", "toxic", "explode(transform(words, (w, i) -> struct(w AS w, xxhash64(coalesce(get(words, i - 1), ''), w, coalesce(get(words, i + 1), '')) AS c))) AS x")
    first = each.groupBy("x.w", "x.c", "toxic").agg(F.min(F.struct("row", "fold")).alias("x"))
    held = first.groupBy("x.row", "x.fold", "toxic").agg(F.collect_set("w").alias("words"))  # of one text
    parts = ", ".join(f"CASE WHEN length(w) > {k} THEN concat(left(w, {k}), '*') END" for k in PREFIXES)
    features = f"explode(array_distinct(transform(filter(flatten(transform(words, w -> array(w, {parts}))), x -> x IS NOT NULL), x -> xxhash64(x)))) AS key"
    counts = [F.sum(F.expr(f"CAST(fold = {f} AND toxic = {y} AS long)")).alias(f"{name}{f}") for f in range(FOLDS) for name, y in (("t", 1), ("c", 0))]
    return held.selectExpr("fold", "toxic", features).groupBy("key").agg(*counts)


def odds_sql(t: str, c: str, nt: int, nc: int) -> str:
    """SQL for the score of a feature that t of nt toxic and c of nc clean rows hold; null under MIN_COUNT."""
    share = f"({t} + {c}) * {PRIOR / (nt + nc)!r}D"
    of_t, of_c = (f"({n} + greatest({least}D, {share} * {rows}))" for n, least, rows in ((t, LEAST_PRIOR[0], nt), (c, LEAST_PRIOR[1], nc)))
    odds = f"(ln({of_t} / {nt}) - ln({of_c} / {nc}))"
    low = f"({odds} - {DEVIATIONS}D * sqrt(1 / {of_t} + 1 / {of_c}))"
    return f"CASE WHEN {t} + {c} < {MIN_COUNT} THEN NULL WHEN {low} > {DRIFT}D THEN {low} ELSE greatest({LOWEST}D, least({odds}, {-DRIFT}D)) END"


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, fold, text, toxic) of the sample; the sample's ids (16 bytes a row, ``rows`` at most) are broadcast."""
    labels = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("row", F.xxhash64("doc_id", "text"))
    return found.select("row", F.pmod(F.shiftright("row", 7), F.lit(FOLDS)).cast("int").alias("fold"), "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, broadcast_features: int = BROADCAST_FEATURES) -> Model:
    """Fit a model; see the module's text."""
    sample = materialise(training_rows(docs, labels, rows), "toxicity-sample")
    n = {(r.toxic, r.fold): r.n for r in sample.groupBy("toxic", "fold").agg(F.countDistinct("row").alias("n")).collect()}
    of = lambda y, left_out: sum(v for (toxic, f), v in n.items() if toxic == y and f != left_out)
    if not of(1, None) or not of(0, None):
        free(sample)
        return Model()
    odds = []
    for f in [None, *range(FOLDS)]:
        t, c = ("(" + " + ".join(f"{x}{g}" for g in range(FOLDS) if g != f) + ")" for x in "tc")
        odds.append(odds_sql(t, c, max(of(1, f), 1), max(of(0, f), 1)) + f" AS odds{'' if f is None else f}")
    features = materialise(feature_counts(sample).selectExpr("key", *odds).where("odds IS NOT NULL"), "toxicity-features")
    if small := features.count() <= broadcast_features:
        found = features.toArrow()
        keys = found.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        column = lambda f: np.nan_to_num(found.column(f"odds{f}").to_numpy(zero_copy_only=False), nan=-DRIFT).astype(np.float32)[order]
        keys = keys[order]
    parts = []
    for f in range(FOLDS):
        other = Model(keys, column(f)) if small else Model(features=features.select("key", F.coalesce(f"odds{f}", F.lit(-DRIFT)).alias("odds")))
        parts.append(materialise(_all_segments(sample.where(F.col("fold") == f), other), "toxicity-tail"))
    model = Model(keys, column("")) if small else Model(features=features.select("key", "odds"))
    seen = parts[0]
    for part in parts[1:]:
        seen = seen.unionByName(part)
    calibrate(model, seen)
    free(sample, *parts, *[features] * small)
    return model


def _all_segments(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, scores): the number of words and the scores of all segments of (row, toxic, text)."""
    if model.features is not None:
        found = _joined(rows.selectExpr("row", "text"), model.features).join(rows.select("row", "toxic"), "row")
        return found.select("toxic", "n", F.expr("transform(found, x -> x.score)").alias("scores"))
    known: dict[str, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            words = [_split(t.as_py()) for t in batch.column("text")]
            scores = [[s for _, _, s in model.segments(w, _remembered(known))] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([len(w) for w in words], pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, n long, scores array<double>")


def _joined(rows: DataFrame, features: DataFrame) -> DataFrame:
    """(row, n, found: array<struct<start, end, score>>) of distinct (row, text): the words meet a table of features (key, odds) in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                words = [(m[0], m.start(), m.end()) for m in WORD.finditer((text or "").lower())]
                for i in range(0, len(words), 4096):
                    part = words[i : i + 4096]
                    keys = pa.array([np.array(feature_keys(w), np.uint64).view(np.int64) for w, _, _ in part], pa.list_(pa.int64()))
                    ends = [pa.array([x[k] for x in part], pa.int64()) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array(np.arange(i, i + len(part))), *ends, keys], ["row", "at", "first", "last", "keys"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            out = []
            for marks in batch.column("marks").to_pylist():
                spans = {m["at"]: (m["first"], m["last"]) for m in marks}
                segments = marked_segments(sorted((m["at"], m["odds"]) for m in marks), 0)
                out.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s} for a, b, s in segments])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], ["row", "found"])

    words = materialise(rows.distinct().mapInArrow(run, "row long, at long, first long, last long, keys array<long>"), "toxicity-words")
    each = words.select("row", "at", "first", "last", F.posexplode("keys").alias("rank", "key")).join(features, "key")
    # As in memory, odds are single floats.
    best = each.groupBy("row", "at").agg(F.min(F.struct("rank", "first", "last", F.col("odds").cast("float").cast("double").alias("odds"))).alias("x"))
    marks = best.where(F.col("x.odds") != -DRIFT).groupBy("row").agg(F.collect_list(F.struct("at", "x.first", "x.last", "x.odds")).alias("marks"))  # of one text
    found = marks.mapInArrow(finish, "row long, found array<struct<start: long, `end`: long, score: double>>")
    sizes = rows.select("row").distinct().join(words.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "left")
    none = F.expr("cast(array() AS array<struct<start: bigint, `end`: bigint, score: double>>)")
    return sizes.join(found, "row", "left").select("row", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("found", none).alias("found"))


def calibrate(model: Model, rows: DataFrame) -> None:
    """Fit the tail of chance segments on clean rows, then the logistic curve on all (toxic, n, scores).

    To the driver come sums, and two numbers for each row of the bounded sample.
    """
    tail = rows.where("toxic = 0").agg(F.sum(F.size("scores")), F.sum(F.expr("aggregate(scores, 0D, (a, x) -> a + x)")), F.sum("n")).first()
    fit_tail(model, tail[0] or 0, tail[1] or 0.0, tail[2] or 0)
    light = replace(model, features=None, keys=model.keys[:0], odds=model.odds[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [light.surprise(s, n) for s, n in zip(batch.column("scores").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.float64())], ["toxic", "x"])

    found = rows.mapInArrow(run, "toxic int, x double").toArrow()
    model.slope, model.offset = fit_logistic(found.column("x").to_numpy(), found.column("toxic").to_numpy())


def fit_tail(model: Model, segments: int, total: float, words: int) -> None:
    """Rate and scale of the exponential law by maximum likelihood: so many segments of this total score in so many clean words."""
    model.rate = min(3.0, max(0.25, segments / total)) if total > 0 else 1.0
    model.scale = (segments + 0.5) / max(words, 1)


def fit_logistic(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and offset of the most likely logistic curve, the targets drawn in by a row of each class so that it exists for separable rows too."""
    n1, n0 = float((toxic == 1).sum()), float((toxic != 1).sum())
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.column_stack([x, np.ones(len(x))])
    w = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    loss = lambda v: float(np.logaddexp(0, design @ v).sum() - target @ (design @ v))
    for _ in range(200):  # Newton's method, each step halved until it improves
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), design.T @ (target - p))
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number for each row: of (a text, other columns) a struct."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "toxicity-rows")


def _scored_by_join(rows: DataFrame, model: Model) -> DataFrame:
    """(row, score, passages) of (row, text)."""
    light = replace(model, features=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for n, found in zip(batch.column("n").to_pylist(), batch.column("found").to_pylist()):
                found = [(x["start"], x["end"], x["score"]) for x in found]
                scores.append(light.score([s for _, _, s in found], n))
                passages.append([dict(zip(("start", "end", "score", "expected"), x)) for x in light.passages(found, n)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), pa.array(passages, _PASSAGES)], ["row", "score", "passages"])

    return _joined(rows, model.features).mapInArrow(run, f"row long, {_SCORED}")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages: array<struct<start, end, score, expected>> (code points of the text in small letters; the significant ones)."""
    docs = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    if model.features is not None:
        rows = _numbered(docs)
        found = _scored_by_join(rows.select("row", "doc.text"), model)
        return rows.select("row", "doc.doc_id").join(found, "row").drop("row")
    known: dict[str, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("text"):
                text = (text.as_py() or "").lower()
                words = WORD.findall(text)
                found = model.segments(words, _remembered(known))
                scores.append(model.score([s for _, _, s in found], len(words)))
                kept = model.passages(found, len(words))
                at = [m.span() for m in WORD.finditer(text)] if kept else []
                passages.append([{"start": at[a][0], "end": at[b - 1][1], "score": s, "expected": e} for a, b, s, e in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, _PASSAGES)], ["doc_id", "score", "passages"])

    return docs.mapInArrow(run, f"doc_id long, {_SCORED}")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score stays under the threshold, in one pass over the texts."""
    if model.features is not None:
        rows = _numbered(docs)
        return rows.join(_scored_by_join(rows.select("row", "doc.text"), model).where(F.col("score") < threshold), "row").select("doc.*")
    known: dict[str, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                words = _split(text.as_py())
                found = model.segments(words, _remembered(known))
                keep.append(model.score([s for _, _, s in found], len(words)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of at least 0.7 go."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))
