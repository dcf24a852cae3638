"""Delta-maintained token counts.

``RollupStore`` keeps additive totals (documents, tokens) by source, language and
tokenizer version as one small delta file set for each committed batch. A batch is a
feed of signed changes: inserts add, deletes subtract, revised counts subtract what
was counted and add the new count, possibly under another key. Deltas are aggregated
before they are written, so totals are sums over keys x batches, never over documents,
and ``compact`` sums the batches up.

A batch commits by the rename of its folder to its own name, once: replaying a batch
id changes nothing, an attempt that was lost midway leaves no part behind, and
totals read committed batches only.

Versions are vocabularies of public tokenizers; texts are counted whole.

Defined results: null source, language or version are keys of their own; null texts have no
tokens and null counts are 0; changes that cancel out leave no row; an empty store has no rows;
an op that isn't insert, delete or revise (null too) is an error, and so is a batch that
would leave a key with fewer than no documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm import bpe, packing
from pactspark.llm.common import own_worker, shared_dir, table

KEYS = ("source", "lang", "version")
_TOTALS = "source string, lang string, version string, docs long, tokens long"
#: Tokenizers by version: their files' names.
WORDS, BYTES = "word_bpe_49k", "byte_bpe_multi_50k"
VERSIONS = {WORDS: "word_bpe_49k.json", BYTES: "byte_bpe_multi_50k.tiktoken"}


def _counts(texts: list[str | None], version: str | None) -> list[int | None]:
    if version is None:
        return [None] * len(texts)
    path = public_tokenizers.path(VERSIONS[version])
    return packing.tokens(path).counts(texts) if version == WORDS else [*map(bpe.codec(path).count, texts)]


def _forget() -> None:
    packing.forget()
    bpe.forget()


def count_tokens(docs: DataFrame, version: str, old: str | None = None) -> DataFrame:
    """(source, lang, tokens, old_tokens) of each of ``docs`` (source, lang, text): how many ids its whole text has, without special tokens, under two versions (null without ``old``)."""
    for v in (version, old or version):
        if v not in VERSIONS:
            raise ValueError(f"version must be one of {[*VERSIONS]}, not {v}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker(f"token_counts {version} {old}", _forget)
        for batch in batches:
            for part in packing.parts(batch, "text"):
                texts = part.column("text").to_pylist()
                counts = [pa.array(_counts(texts, v), pa.int64()) for v in (version, old)]
                yield pa.RecordBatch.from_arrays([part.column("source"), part.column("lang"), *counts], ["source", "lang", "tokens", "old_tokens"])

    slim = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return slim.mapInArrow(run, "source string, lang string, tokens long, old_tokens long")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, version, docs, tokens) deltas of a change feed.

    ``changes``: op (insert, delete, revise), source, lang, version, tokens, and for
    revise old_source, old_lang, old_version, old_tokens.
    """
    pair = lambda prefix, sign: (
        f"struct({prefix}source AS source, {prefix}lang AS lang, {prefix}version AS version, {sign}L AS docs, "
        f"{sign} * coalesce(cast({prefix}tokens as bigint), 0L) AS tokens)"
    )
    have = {*changes.columns}
    for c, kind in (("old_source", "string"), ("old_lang", "string"), ("old_version", "string"), ("old_tokens", "bigint")):
        if c not in have:
            changes = changes.withColumn(c, F.lit(None).cast(kind))
    rows = f"""CASE op WHEN 'insert' THEN array({pair('', 1)}) WHEN 'delete' THEN array({pair('', -1)})
               WHEN 'revise' THEN array({pair('old_', -1)}, {pair('', 1)})
               ELSE raise_error(concat('op must be insert, delete or revise, not ', coalesce(op, 'null'))) END"""
    return _summed(changes.select(F.explode(F.expr(rows)).alias("x")).select("x.*"))


class RollupStore:
    """Totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(path))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return sorted(n for n in found if n.startswith("batch="))

    def bases(self) -> list[str]:
        """Names of the compacted states, the newest last."""
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return sorted(n for n in found if n.startswith("base="))

    def applied(self, batch_id: str) -> bool:
        """Whether the batch is committed, by itself or in a compacted state."""
        if self._fs.exists(self._path(f"{self.path}/batch={batch_id}")):
            return True
        bases = self.bases()
        return bool(bases) and not self.spark.read.schema("batch string").parquet(f"{self.path}/{bases[-1]}/batches").where(F.col("batch") == f"batch={batch_id}").isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False (and no work) if it was applied before.

        A batch that takes more documents from a key than it holds is refused (ValueError).
        """
        target = self._path(f"{self.path}/batch={batch_id}")
        if self.applied(batch_id):
            return False
        staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        signed(changes).write.parquet(staging)
        delta = self.spark.read.schema(_TOTALS).parquet(staging)
        short = _summed(self.totals().unionByName(delta)).where("docs < 0").select(*KEYS).limit(5).collect()
        if short:
            self._fs.delete(self._path(staging), True)
            raise ValueError(f"batch {batch_id} takes more documents than there are from {[tuple(r) for r in short]}")
        if self._fs.exists(target) or not self._fs.rename(self._path(staging), target):
            self._fs.delete(self._path(staging), True)
            return False
        if self._fs.exists(inner := self._path(f"{target.toString()}/{staging.rpartition('/')[2]}")):
            self._fs.delete(inner, True)  # another attempt committed between the test and the rename
            return False
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; keys whose documents are all gone have no row."""
        names, bases = self.batches(), self.bases()[-1:]
        if bases:
            gone = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{bases[0]}/batches").where(F.col("batch").isin(names)).collect()} if names else {}
            names = [n for n in names if n not in gone]
        paths = [f"{self.path}/{n}" for n in names] + [f"{self.path}/{b}/totals" for b in bases]
        if not paths:
            return self.spark.createDataFrame([], _TOTALS)
        return _summed(self.spark.read.schema(_TOTALS).parquet(*paths))

    def compact(self) -> None:
        """Put all batches into one state, so that totals read one folder again; a batch in it still counts as applied.

        The state commits by the rename of its folder. Batches that it holds are deleted after
        that, and left out of totals by their names until they are. One compaction runs at a time.
        """
        names, bases = self.batches(), self.bases()
        if not names:
            return
        staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{staging}/totals")
        done = self.spark.createDataFrame([(n,) for n in names], "batch string")
        if bases:
            done = done.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/{bases[-1]}/batches")).distinct()
        done.coalesce(1).write.parquet(f"{staging}/batches")
        number = int(bases[-1].removeprefix("base=")) + 1 if bases else 1
        self._fs.rename(self._path(staging), self._path(f"{self.path}/base={number:012d}"))
        for name in (*names, *bases):
            self._fs.delete(self._path(f"{self.path}/{name}"), True)


def feed(docs: DataFrame, op: str, version: str, old: str | None = None) -> DataFrame:
    """Changes for documents (source, lang, text): counted under ``version``, for revise counted before under ``old``."""
    both = count_tokens(docs, version, old)
    columns = [F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), "tokens"]
    if old:
        columns += [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(old).alias("old_version"), "old_tokens"]
    return both.select(*columns)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all ``documents`` after four batches: all inserted, counted by words; those in German revised to their
    counts by bytes; those in French deleted; those in French inserted again. Each batch is committed twice, which changes nothing."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    store = RollupStore(spark, f"{shared_dir(spark)}/pactspark/rollup-{uuid.uuid4().hex}")
    german, french = docs.where("lang = 'de'"), docs.where("lang = 'fr'")
    batches = {
        "1-insert": feed(docs, "insert", WORDS),
        "2-revise": feed(german, "revise", BYTES, WORDS),
        "3-delete": feed(french, "delete", WORDS),
        "4-insert": feed(french, "insert", WORDS),
    }
    for name, changes in batches.items():
        store.commit(name, changes)
    for name, changes in batches.items():
        store.commit(name, changes)
    return store.totals().select("source", "lang", "version", F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))
