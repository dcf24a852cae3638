"""Byte-level BPE encoding and decoding.

Two tiers for each pre-token: a minimal perfect hash over the vocabulary resolves
whole pre-tokens in one probe (the slot holds the key, so strangers are refused);
any other is split into bytes on a doubly linked list, and a heap of adjacent pairs
by rank merges the lowest rank, leftmost first, until no pair is in the vocabulary.

Texts repeat words, so each Python worker remembers what it has encoded: up to
``REMEMBER`` runs without inner white space in each of two generations; a full
generation replaces the older one.

Defined results: null and empty texts give no ids (and the digests of nothing);
repeated rows give repeated results; only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from pactspark.llm.common import own_worker, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
REMEMBER = 600_000

_SPACE = "\t-\r \x85\xa0  -     　"
#: Cuts a text where no match of the pattern goes across: a space opens the run that follows it.
RUNS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


class PerfectHash:
    """Minimal perfect hash of byte strings: a pilot for each bucket places its keys in free slots."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        first = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(first):
            groups[h % self.buckets].append(i)
        self.pilot = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        self.value = [0] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            pilot = 0
            while groups[b]:
                at = [self._place(first[i], pilot) for i in groups[b]]
                if len(set(at)) == len(at) and all(self.slots[x] is None for x in at):
                    for x, i in zip(at, groups[b]):
                        self.slots[x], self.value[x] = keys[i], i
                    break
                pilot += 1
            self.pilot[b] = pilot

    def _place(self, h: int, pilot: int) -> int:
        h = ((h ^ (pilot * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (h >> 17) % self.n

    def index(self, key: bytes) -> int:
        """The key's position in the list it was built from, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        x = self._place(h, self.pilot[h % self.buckets])
        return self.value[x] if self.slots[x] == key else -1


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, remember: int = REMEMBER) -> None:
        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
        self.ranks = dict(pairs)
        self.whole = PerfectHash([k for k, _ in pairs])
        self.id_at = [r for _, r in pairs]
        self.bytes_of = [b""] * (max(self.id_at) + 1)
        for k, r in pairs:
            self.bytes_of[r] = k
        self.pattern = regex.compile(pattern)
        self.remember = remember
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge a pre-token's bytes: a heap over linked nodes.

        A node is named by its first byte; ``end`` links to the next node (0: merged
        away), ``before`` to the one in front. An entry (rank, node, end of the pair) is
        stale unless the node and the next one still make up that pair.
        """
        n, get = len(piece), self.ranks.get
        end = [*range(1, n + 1), 0]
        before = [*range(-1, n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, e = pop(heap)
            m = end[i]
            if not m or end[m] != e:
                continue
            end[i], end[m] = e, 0
            before[e] = i
            if e < n and (r := get(piece[i : end[e]])) is not None:
                push(heap, (r, i, end[e]))
            if i and (r := get(piece[before[i] : e])) is not None:
                push(heap, (r, before[i], e))
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : end[i]]))
            i = end[i]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        at = self.whole.index(raw)
        return [self.id_at[at]] if at >= 0 else self.merge(raw)

    def encode_run(self, run: str) -> list[int]:
        return [i for piece in self.pattern.findall(run) for i in self.encode_piece(piece)]

    def _learn(self, runs: set[str]) -> None:
        known, older = self.known, self.older
        for run in runs:
            if run in older:
                known[run] = older[run]
                continue
            ids = self.encode_run(run)
            known[run] = (struct.pack(f"<{len(ids)}I", *ids), b"%d," * len(ids) % tuple(ids))

    def count(self, text: str | None) -> int:
        """How many ids the text has."""
        return len(self.encode(text)[0])

    def encode(self, text: str | None) -> tuple[np.ndarray, bytes]:
        """Ids as an array, and in decimal with a comma after each."""
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        runs = RUNS.findall(text) if text else []
        get = self.known.get
        found = [*map(get, runs)]
        if None in found:
            self._learn({r for r, x in zip(runs, found) if x is None})
            found = [*map(get, runs)]
        return np.frombuffer(b"".join([a for a, _ in found]), "<u4"), b"".join([b for _, b in found])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_CODECS: dict[str, Codec] = {}


def forget() -> None:
    """Drop what this worker remembers."""
    _CODECS.clear()


def codec(path: str) -> Codec:
    """One codec for each path and worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("bpe", forget)
        own = codec(path)
        for batch in batches:
            ids, counts, sums, backs, lists = batch.column("doc_id").to_pylist(), [], [], [], []
            for text in batch.column("text"):
                found, decimal = own.encode(text.as_py())
                counts.append(len(found))
                sums.append(hashlib.sha256(decimal[:-1]).hexdigest())
                backs.append(hashlib.sha256(own.decode(found)).hexdigest())
                if keep_ids:
                    lists.append(found.astype(np.int32))
            columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids (null ids: null text; bytes that aren't UTF-8 become U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("bpe", forget)
        own = codec(path)
        for batch in batches:
            made = [None if x is None else own.decode(np.array(x, "<u4")).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(ids as array<int>) AS ids").mapInArrow(run, "doc_id long, text string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
