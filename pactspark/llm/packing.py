"""Packing of token streams into training windows, in the documents' order.

Each task tokenises its documents in order into one stream of ids and cuts it into
windows of at most ``WINDOW`` tokens. A dynamic programme over the allowed cuts (ends
of documents and of sentences; where a sentence is longer than a window, fixed steps
inside it) finds the cuts of least cost: ``WINDOW - length`` for each window but the
last as padding, plus ``DOCUMENT_CUT`` or ``SENTENCE_CUT`` where a cut splits a document.
``cost[j] = min(cost[i] + position[i]) + WINDOW - position[j] + penalty[j]`` over the
cuts ``i`` within a window of ``j``: the minimum slides, so a monotone queue gives
every transition in amortised constant time.

The stream is worked off in blocks of ``BLOCK`` tokens whose unfinished last window
moves to the next block, so memory is bounded by a block and one document. A task's
last window is padded, or where that would be much, cut into powers of two, which
need no padding. ``sequence_id`` holds the task's number in its high bits.

Defined results: null and empty texts are one token (the end id); repeated rows are
packed as often as they occur; only id and text are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from pactspark.llm.common import own_worker, table

TOKENIZER = "word_bpe_49k.json"
END = 2
WINDOW = 4096
#: What a cut costs, in tokens of padding.
SENTENCE_CUT, TOKEN_CUT = 4, 24
BLOCK = 1 << 20
REMEMBER = 400_000
#: Texts that are tokenised at once: so many bytes of them, and one text at least.
BYTES = 1 << 22
#: A pre-token of one id that stands between runs when many are encoded at once.
_MARK = "\x01"
#: Texts with one of these are encoded whole: the mark; what one library takes for white space and the
#: other doesn't; marks that combine with a letter, as the tokenizer composes letters first and makes
#: them small then, and small letters combine with other marks. So are texts that hold an added token.
_ODD = "[\x01\x1c-\x1f\u0300-\u036f]"


def _plain_letter(c: str) -> bool:
    """Whether a letter or digit is sure to stay the single character it is when it is composed and made small."""
    return c.isalnum() and (c.isascii() or (c.islower() and unicodedata.is_normalized("NFC", c)))


class Tokens:
    """Ids of texts, remembered by runs without white space (no pre-token goes across it)."""

    def __init__(self, path: str, end: int = END, remember: int = REMEMBER) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD, *added]), re.IGNORECASE)
        self.end = np.uint32(end)
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        (self.mark,) = self._whole(_MARK)
        self.single = {c: self._whole(c).tobytes() for c in ".,"}
        names = self.tokenizer.get_vocab()
        self.stops = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            if (bare := name.removesuffix("</w>")) and bare != name and bare[-1] in ".!?":
                self.stops[i] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _look_up(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs."""
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        known, older, new, stopped = self.known, self.older, [], []
        for run in runs:
            if run in known:
                continue
            if run in older:
                known[run] = older[run]
            elif run[-1:] in self.single and _plain_letter(run[-2:-1]):
                # One stop after a word is a pre-token of its own.
                stopped.append(run)
                if (word := run[:-1]) not in known:
                    if word in older:
                        known[word] = older[word]
                    else:
                        new.append(word)
            else:
                new.append(run)
        if new:
            new = [*dict.fromkeys(new)]
            ids = self._whole(f" {_MARK} ".join(new))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            raw, at = ids.tobytes(), 0
            for run, end in zip(new, (4 * ends).tolist(), strict=True):
                known[run] = raw[at:end]
                at = end + 4
        for run in stopped:
            known[run] = known[run[:-1]] + self.single[run[-1]]
        return [known[run] for run in runs]

    def _coded(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Which texts are to be encoded whole, the ids of each distinct run, which run stands where, and where each text's runs begin."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
        coded = split.flatten().dictionary_encode()
        runs, which, offsets = coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        whole = np.zeros(len(texts), bool)
        if self.odd.search("\n".join(runs)):
            odd = np.array([self.odd.search(run) is not None for run in runs])
            before = np.concatenate(([0], np.cumsum(odd[which])))[offsets]
            whole = np.diff(before) > 0
            runs = ["" if o else run for o, run in zip(odd.tolist(), runs)]
        return whole, self._look_up(runs), which, offsets

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id. Distinct runs are found and put in place column-wise."""
        whole, raw, which, offsets = self._coded(texts)
        every = np.frombuffer(b"".join(raw), "<u4")
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        start = np.cumsum(size) - size
        sizes = size[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = every[np.repeat(start[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[offsets].tolist()
        return [np.append(self._whole(t) if odd else ids[a:b], self.end) for t, odd, a, b in zip(texts, whole, bounds, bounds[1:])]

    def counts(self, texts: list[str | None]) -> list[int]:
        """How many ids each text has, without the end id."""
        whole, raw, which, offsets = self._coded(texts)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        bounds = np.concatenate(([0], np.cumsum(size[which])))[offsets]
        return [len(self._whole(t)) if odd else n for t, odd, n in zip(texts, whole, np.diff(bounds).tolist())]


def parts(batch: pa.RecordBatch, column: str, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have up to ``most`` bytes together, one row at least."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


_TOKENS: dict[str, Tokens] = {}


def forget() -> None:
    """Drop what this worker remembers."""
    _TOKENS.clear()


def tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def choose_cuts(position: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cheapest path of cuts from 0 to the last position; the last window's padding is free.

    ``position`` ascends from above 0; no gap exceeds ``window``. Returns the chosen
    positions, the last one included.
    """
    where = [0, *position.tolist()]
    cost, back = [0.0] * len(where), [0] * len(where)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # ascending cost + position; the front is the least
    for j in range(1, len(where)):
        at = where[j]
        while where[queue[0][1]] < at - window:
            queue.popleft()
        least, back[j] = queue[0]
        cost[j] = now = least + window - at + float(penalty[j - 1])
        key = now + at
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    # The last window isn't padded: it goes on in the next block or ends in powers of two.
    j = len(where) - 1
    back[j] = min((i for i in range(j) if where[i] >= where[j] - window), key=lambda i: (cost[i], i), default=0)
    cuts = []
    while j:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


def powers(n: int, window: int = WINDOW) -> list[int]:
    """Lengths of the windows that the last n tokens go to: one padded window if that wastes little, else powers of two."""
    if n * 50 >= window * 49 or n == 0:
        return [n] * (n > 0)
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a stream and what each costs."""
    kind = np.zeros(len(ids) + 1, np.int8)
    kind[1:][stops[ids]] = 1
    kind[ends] = 2
    at = np.flatnonzero(kind)
    gaps = np.diff(np.concatenate(([0], at, [len(ids)])))
    for g in np.flatnonzero(gaps > 1 + window // 64):  # a long sentence: further cuts, at a price
        first = 0 if g == 0 else at[g - 1]
        kind[first + window // 64 : first + gaps[g] : window // 64] = np.maximum(kind[first + window // 64 : first + gaps[g] : window // 64], 3)
    kind[len(ids)] = 2 if kind[len(ids)] == 0 else kind[len(ids)]
    at = np.flatnonzero(kind)
    return at, np.array([0, SENTENCE_CUT, 0, TOKEN_CUT], np.float64)[kind[at]]


def pack_stream(documents: Iterator[tuple[int | None, np.ndarray]], stops: np.ndarray, first_id: int = 0, window: int = WINDOW, block: int = BLOCK) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of a stream of (doc_id, ids)."""
    sequence = first_id
    held: list[tuple[int | None, np.ndarray, int]] = []  # id, all its ids, how many of them are packed

    def emit(lengths: list[int], docs: list[tuple[int | None, np.ndarray, int]]) -> Iterator[tuple]:
        nonlocal sequence
        d, done = 0, docs[0][2] if docs else 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc_id, ids, _ = docs[d]
                n = min(length - offset, len(ids) - done)
                piece = ids[done : done + n]
                yield doc_id, done, n, zlib.crc32(piece.tobytes()), len(ids), sequence, offset, piece
                offset, done = offset + n, done + n
                if done == len(ids):
                    d += 1
                    done = docs[d][2] if d < len(docs) else 0
            sequence += 1
        docs[:] = [(docs[d][0], docs[d][1], done), *docs[d + 1 :]] if d < len(docs) else []

    def cut(last: bool) -> Iterator[tuple]:
        ids = np.concatenate([x[p:] for _, x, p in held])
        ends = np.cumsum([len(x) - p for _, x, p in held])
        cuts = choose_cuts(*_candidates(ids, ends, stops, window), window)
        lengths = np.diff([0, *cuts]).tolist()
        tail = lengths.pop()
        if last:
            lengths += powers(tail, window)
        yield from emit(lengths, held)

    size = 0
    for doc_id, ids in documents:
        held.append((doc_id, ids, 0))
        size += len(ids)
        if size >= block:
            yield from cut(False)
            size = sum(len(x) - p for _, x, p in held)
    if held:
        yield from cut(True)


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (array<int>)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("packing", forget)
        own = tokens(path)

        def stream() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for part in parts(batch, "text"):
                    yield from zip(part.column("doc_id").to_pylist(), own.ids(part.column("text").to_pylist()))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows)]
            made = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                made.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(made, [*names, *["ids"] * with_ids])

        rows: list[tuple] = []
        for row in pack_stream(stream(), own.stops, TaskContext.get().partitionId() << 40):
            rows.append(row if with_ids else row[:7])
            if len(rows) >= 4096:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    schema = ", ".join(f"`{n}` long" for n in names) + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows, a row for each piece."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: the kept documents packed into windows."""
    return pack(docs, public_tokenizers.path(TOKENIZER))
