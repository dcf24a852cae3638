"""Near-duplicate detection by Order MinHash.

A text's words (lower case, split at white space) are each labelled with how often
they occurred before. A sketch takes the ``TAKE`` labelled words of least hash and
keeps them in text order, so it is sensitive to edit similarity and not only to shared
content. Each of ``BANDS`` sketches is a bucket. Two texts of edit similarity 0.8 or
more hold at least two thirds of their labelled words in common, wherever the edits
are (n words with 0.2 n substituted: 0.8 n of 1.2 n); a sketch then agrees with a chance
of 0.117 or more (40 words; 0.13 in long texts), so a pair misses all buckets with a
probability below 1e-6, as long as the shared labelled words stand in the same order. An
edit of a word that occurs more often shifts the labels of its later occurrences, which can
break that order: for such pairs the bound isn't exact. Texts under ``SHORT`` words
take only ``TAKE_SHORT`` words, as few edits leave them fewer in common. Texts of ``LONG``
words or more are sketched by pairs of neighbouring words, as long texts of one language share
many labelled words by chance: linked ones hold at least three sevenths of their labelled
pairs in common (an edit changes two pairs at most: 0.6 n of 1.4 n), a sketch of
``TAKE_LONG`` then agrees with a chance of 0.078, and all ``BANDS_LONG`` miss with one below 1e-6 again.
Texts that can be linked to another kind have the sketches of both.

Candidates are not all pairs of a bucket. Round one verifies every member against
the bucket's least id (a star, linear in the bucket's size) if their bags of words
allow a link (as below), the least of these leaders first, then those with which it isn't
connected by then. Round two is for members that stay apart from a leader: they meet
the bucket's other members with which they aren't connected either. Such buckets are split
by length into cells of two neighbouring classes, so that texts whose lengths allow a link
share one; most buckets of chance fall apart by that. Cells of up to ``SMALL`` texts are
paired directly, ``SMALL`` rows for a text at most. The texts of
larger cells are dealt anew by their rarest labelled words (prefix filter): of two
linked texts the longer has at most a fifth of its words beyond those that both hold, so of
either's labelled words, in one order for all texts, the first fifth and one more hold a
word of the other's first fifth and one more. The order is by frequency in these texts, so a
phrase that many of them share makes no pairs, and no link is lost however large a bucket
is. Two texts that share many such words meet at the first of them, not once for each: a word
makes no pair if one of the ``BEFORE`` words before it in either text's order is shared too, as the
pair met there or earlier. A mask of each text's large cells sorts out most pairs that share none.

Two texts are at least as many edits apart as the longer has words beyond those that
both hold, and counts of labelled words by hash bound that number from above: pairs
which that rules out are sorted out without reading the texts. Verification is an exact
alignment of all words of both texts: a pair is linked if edit distance <= 0.2 x the
longer length. Connected links are classes.

Exact copies are grouped by digest first; one text per digest enters all that.

Defined results: a null text counts as empty; texts without words are linked to
exact copies only; rows that repeat an id give one row; a null id gives a row with
null class; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm.common import DOCUMENT_COLUMNS, clean_shuffles, free, materialise, own_worker, table

SIMILARITY = 0.8
TAKE, BANDS = 5, 112
#: Texts of fewer words are sketched by ``TAKE_SHORT`` words.
SHORT, TAKE_SHORT = 40, 3
#: Texts of so many words are sketched by ``TAKE_LONG`` pairs of words.
LONG, TAKE_LONG, BANDS_LONG = 400, 3, 176
#: Least and usual most number of counts that stand for a text's bag of words: twice as many as it has words, in between.
SLOTS = 64, 16_384
#: Counts (by hash of a labelled word) that put words in order of frequency; which order it is changes the work, not the result.
RANKS = 1 << 20
#: Words that a rare word carries of those before it in its text's order, to make a pair once; more make fewer pairs twice, none lost.
BEFORE = 4
#: Lengths in a class differ by less than this factor, a little over 1 / ``SIMILARITY``: two texts of fitting lengths are of one class or of neighbouring ones.
LENGTHS = 1.2501
#: Cells of up to so many texts are paired directly, larger ones by rare words; it changes the work, not the result.
SMALL = 16
#: Up to so many ids (16 bytes each) are broadcast to pick texts from a scan; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_RNG = np.random.Generator(np.random.Philox(key=[7, 5]))
_FACTORS = _RNG.integers(0, 1 << 31, max(BANDS, BANDS_LONG), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Words:
    """Hashes of words, remembered in two generations."""

    def __init__(self, remember: int = 150_000) -> None:
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.remember = remember

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for w in {*words}:
            if w not in known:
                known[w] = older[w] if w in older else xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def _occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each word occurred before."""
    order = np.argsort(hashes, kind="stable")
    first = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    at = np.arange(len(hashes))
    occurrence = np.empty(len(hashes), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return occurrence


def labelled_words(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the words, each with how often it occurred before."""
    return _mixed(_mixed(hashes) * _MIX + _occurrences(hashes) * _MIX)


def bag(labelled: np.ndarray) -> bytes | None:
    """How many labelled words fall into each of a power of two of slots, a byte each; None if that is too few bits."""
    n = len(labelled)
    slots = 1 << (max(SLOTS[0], min(2 * n, max(SLOTS[1], n // 32))) - 1).bit_length()
    counts = np.bincount((labelled & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def most_shared(a: bytes | None, b: bytes | None) -> float:
    """A bound from above of how many labelled words two texts share, by their bags."""
    if a is None or b is None:
        return float("inf")
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(x) < len(y):
        y = y.reshape(-1, len(x)).sum(0)
    return float(np.minimum(x, y).sum(dtype=np.int64))


def prefix(labelled: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The rarest labelled words of a text, rarest first: all but as many as any linked text shares, and one more."""
    n = len(labelled)
    spare = int(n * (1 - SIMILARITY) + 1e-9)
    return labelled[np.lexsort((labelled, frequency[labelled & np.uint64(RANKS - 1)]))[: spare + 1]]


def _sketches(words: np.ndarray, labelled: np.ndarray, takes: list[int], bands: int, kind: int) -> np.ndarray:
    """The keys of ``bands`` sketches for each of ``takes``: of the (labelled) words of least rank, in text order."""
    n = len(words)
    high = (labelled >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(takes), bands), np.uint64)
    step = max(1, (1 << 18) // n)
    for s in range(0, bands, step):
        rank = _FACTORS[s : min(s + step, bands), None] * high[None, :]
        row = np.arange(len(rank))
        taken = []
        for _ in range(min(takes[-1], n)):
            best = rank.argmin(1)
            taken.append(best)
            rank[row, best] = 0xFFFFFFFF
        for i, take in enumerate(takes):
            key = np.arange(s, s + len(rank), dtype=np.uint64) + np.uint64(1 + (kind + take) * max(BANDS, BANDS_LONG))
            for p in np.sort(np.array(taken[:take]), axis=0):
                key = _mixed(key * _MIX + words[p])
            keys[i, s : s + len(rank)] = key
    return keys.reshape(-1).view(np.int64)


def band_keys(hashes: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """The band keys (signed 64 bits) of a text whose words have these hashes; none without words."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    words, found = _mixed(hashes), []
    takes = [t for t, fits in ((TAKE_SHORT, n * SIMILARITY < SHORT), (TAKE, n >= SHORT and n * SIMILARITY < LONG)) if fits]
    if takes:
        found.append(_sketches(words, labelled, takes, BANDS, 0))
    if n >= LONG:
        pairs = _mixed(words[:-1] * _MIX + words[1:])
        found.append(_sketches(pairs, labelled_words(pairs), [TAKE_LONG], BANDS_LONG, 100))
    return np.concatenate(found)


def _run_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements agree."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if (i := int(differ.argmax())) or differ[0]:
            return at + i
        at, step = at + len(differ), step * 8
    return n


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two integer arrays, or limit + 1 if it is larger; eight edits are looked for along diagonals, more by columns."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    p = _run_length(a, b)
    a, b = a[p:], b[p:]
    p = _run_length(a[::-1], b[::-1])
    a, b = a[: len(a) - p], b[: len(b) - p]
    n, m = len(a), len(b)
    if not n or not m:
        return min(max(n, m), limit + 1)
    both = max(int(a.max()), int(b.max())) + 1
    if max(n, m) - int(np.minimum(np.bincount(a, minlength=both), np.bincount(b, minlength=both)).sum()) > limit:
        return limit + 1
    # Few edits: the furthest row that each diagonal reaches with d edits.
    reach = {0: _run_length(a, b)}
    for d in range(1, min(limit, 8) + 1):
        ahead = {}
        for k in range(-d, d + 1):  # column = row + k
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            ahead[k] = i = i + _run_length(a[i:], b[i + k :])
            if i == n and i + k == m:
                return d
        reach = ahead
    if limit <= 8:
        return limit + 1
    return _by_bits(a.tolist(), b.tolist(), limit)


def _by_bits(a: list[int], b: list[int], limit: int) -> int:
    """Edit distance, or limit + 1 if it is larger: a column of the table in two integers, a bit for each element of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    mask, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0  # where the table grows or falls by 1 from one row to the next
    for left, x in zip(range(len(b) - 1, -1, -1), b):
        same = at.get(x, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        more = down | (mask & ~(horizontal | up))
        less = up & horizontal
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        if distance - left > limit:
            return limit + 1
        more = (more << 1 | 1) & mask
        up = (less << 1 & mask) | (mask & ~(vertical | more))
        down = more & vertical
    return min(distance, limit + 1)


def near(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether the texts' words have an edit similarity of at least ``similarity``."""
    x, y = a.lower().split(), b.lower().split()
    if not x or not y:
        return False
    number: dict[str, int] = {}
    u, v = (np.array([number.setdefault(w, len(number)) for w in z], np.int64) for z in (x, y))
    limit = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
    return edit_distance(u, v, limit) <= limit


def signatures(docs: DataFrame) -> DataFrame:
    """node, n_words, bands, bag of (doc_id, text)."""
    schema = pa.schema([("node", pa.int64()), ("n_words", pa.int64()), ("bands", pa.list_(pa.int64())), ("bag", pa.binary())])
    words = _Words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("near_dup")
        for batch in batches:
            counts, bands, bags = [], [], []
            for text in batch.column("text"):
                hashes = words.hashes((text.as_py() or "").lower().split())
                counts.append(len(hashes))
                labelled = labelled_words(hashes)
                bands.append(band_keys(hashes, labelled))
                bags.append(bag(labelled))
            made = [pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=schema)

    return docs.mapInArrow(run, "node long, n_words long, bands array<long>, bag binary")


def _bounded(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has up to ``BROADCAST_IDS``."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def rarest(docs: DataFrame) -> DataFrame:
    """node, words, places: the ``prefix`` of each of (doc_id, text), words ranked by their counts in these texts, one row for a text with words.

    Words that surely stand in no other of these texts are left out; places count them.
    """
    words = _Words()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("near_dup")
        total = np.zeros(RANKS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                at, n = np.unique(labelled_words(words.hashes((text.as_py() or "").lower().split())) & np.uint64(RANKS - 1), return_counts=True)
                total[at.astype(np.int64)] += n
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total[slots])], ["slot", "n"])

    counts = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # RANKS rows at most
    frequency = np.zeros(RANKS, np.int32)
    frequency[counts.column("slot").to_numpy()] = np.minimum(counts.column("n").to_numpy(), np.iinfo(np.int32).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("near_dup")
        for batch in batches:
            nodes, found, places = [], [], []
            for node, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                hashes = words.hashes((text.as_py() or "").lower().split())
                if len(hashes):
                    rare = prefix(labelled_words(hashes), frequency)
                    place = np.flatnonzero(frequency[rare & np.uint64(RANKS - 1)] > 1)
                    nodes.append(node)
                    found.append(rare[place].view(np.int64))
                    places.append(place)
            made = [pa.array(nodes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (found, places))]
            yield pa.RecordBatch.from_arrays(made, ["node", "words", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, words array<long>, places array<long>")


def word_rows(texts: DataFrame) -> DataFrame:
    """word, place, the other columns of ``texts`` (words, places, node, ...), before1, ...: a row for each word, with the words just before."""
    others = [c for c in texts.columns if c not in ("words", "places")]
    before = [f"before{k}" for k in range(1, BEFORE + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("near_dup")
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                lists = part.column("words")
                word = lists.flatten()
                text = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                made = [word, part.column("places").flatten(), *(part.column(c).take(pa.array(text)) for c in others)]
                for back in range(1, BEFORE + 1):
                    first = np.ones(len(text), bool)
                    first[back:] = text[back:] != text[:-back]
                    moved = np.zeros(len(text), np.int64)
                    moved[back:] = word.to_numpy()[:-back]
                    made.append(pa.array(moved, mask=first))
                yield pa.RecordBatch.from_arrays(made, ["word", "place", *others, *before])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join(["word long, place long", *(f"{c} {kinds[c]}" for c in others), *(f"{c} long" for c in before)]))


def rare_words(docs: DataFrame) -> DataFrame:
    """(word, place, node, before1, ...): a row for each word of ``rarest``."""
    return word_rows(rarest(docs))


def shared_words(texts: DataFrame) -> DataFrame:
    """word: those of ``texts`` (words, label, apart) that can make a pair, as texts of different labels hold them and one is apart."""
    held = texts.select(F.explode("words").alias("word"), "label", "apart").groupBy("word")
    return held.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("apart").alias("apart")).where("low != high AND apart").select("word")


def cells(rest: DataFrame) -> DataFrame:
    """key, node, n_words, label, apart, class, cells (cell, n), written: the texts of each bucket (key, node, n_words, label, leader_label) by length.

    Cell c holds the classes c - 1 and c, and n texts in all. It is for pairs of class c and of both classes, as two
    of class c - 1 meet in their own; cells and texts that can make no such pair are left out.
    """
    of_length = F.floor(F.log("n_words") / math.log(LENGTHS)).cast("int")
    placed = rest.select("key", "node", "n_words", "label", (F.col("label") != F.col("leader_label")).alias("apart"), of_length.alias("class"))
    sizes = placed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("any"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = sizes.select("*", F.explode(F.array("class", F.col("class") + 1)).alias("cell")).groupBy("key", "cell")
    sizes = sizes.agg(F.sum("n").alias("n"), F.max("any").alias("any"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.col("class") == F.col("cell")).alias("own"))
    sizes = sizes.where("own AND any AND n > 1 AND low != high").select("key", F.struct("cell", "n").alias("of"), F.explode(F.array(F.col("cell") - 1, "cell")).alias("class"))
    sizes = materialise(sizes.groupBy("key", "class").agg(F.collect_list("of").alias("cells")), "near-sizes")
    found = materialise(placed.join(_bounded(sizes), ["key", "class"]), "near-cells")
    free(sizes)
    return found


def meet_directly(found: DataFrame) -> DataFrame:
    """(a, b) of the texts of small ``cells`` that are of lengths that fit and of different labels, one of them apart; not distinct."""
    small = found.select("*", F.explode(F.expr(f"filter(cells, of -> of.n <= {SMALL})")).alias("of")).select("*", "of.cell")
    other = small.select("key", "cell", *[F.col(c).alias(f"other_{c}") for c in ("node", "n_words", "label", "apart", "class")])
    fits = (F.col("label") != F.col("other_label")) & (~F.col("other_apart") | (F.col("node") < F.col("other_node"))) & _lengths_fit("n_words", "other_n_words")
    once = F.col("cell") == F.greatest("class", "other_class")  # texts of one class share two cells
    return small.where("apart").join(other, ["key", "cell"]).where(fits & once).select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))


def held_by(found: DataFrame) -> DataFrame:
    """node, n_words, label, apart, bits0 to bits3: the texts of large ``cells``; texts without a common bit share no cell."""
    large = f"filter(cells, of -> of.n > {SMALL})"
    bit = "shiftleft(1L, cast(pmod(xxhash64(key, of.cell), 64) AS int))"
    bits = [F.expr(f"bit_or(aggregate({large}, 0L, (m, of) -> IF(pmod(shiftright(xxhash64(key, of.cell), 6), 4) = {i}, m | {bit}, m)))").alias(f"bits{i}") for i in range(4)]
    held = found.where(f"size({large}) > 0").groupBy("node")
    return held.agg(F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("apart").alias("apart"), *bits)


def meet(rare: DataFrame) -> DataFrame:
    """(a, b), most of them once, of the texts that share a rare word and a cell, are of lengths that fit and of different labels, one of them apart.

    ``rare`` has the columns of ``rare_words``, n_words, label, apart and the masks bits0 to bits3.
    """
    other = rare.select("word", *[F.col(c).alias(f"other_{c}") for c in rare.columns if c != "word"])
    # The first word that both share: what comes before it in either text isn't shared.
    first_shared = F.least(F.col("n_words") - F.col("place"), F.col("other_n_words") - F.col("other_place")) >= _least_shared(F.greatest("n_words", "other_n_words"))
    one_cell = F.expr(" OR ".join(f"(bits{i} & other_bits{i}) != 0" for i in range(4)))
    fits = (F.col("label") != F.col("other_label")) & (~F.col("other_apart") | (F.col("node") < F.col("other_node"))) & _lengths_fit("n_words", "other_n_words") & first_shared & one_cell
    # The earlier word passed all these tests as well: they are the same for all words of a pair, or easier for earlier ones.
    before = [c for c in rare.columns if c.startswith("before")]
    for mine, its in itertools.product(before, before):
        fits = fits & F.coalesce(F.col(mine) != F.col(f"other_{its}"), F.lit(True))
    return rare.where("apart").join(other, "word").where(fits).select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, linked) of candidate pairs, written; ``docs`` has doc_id and text."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    texts = docs.join(_bounded(ids), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("near_dup")
        for batch in batches:
            linked = [near(x.as_py() or "", y.as_py() or "") for x, y in zip(batch.column("left"), batch.column("right"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    outcome = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean"), "near-outcome")
    free(ids)
    return outcome


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) is connected with.

    Large-star and small-star in turns; each round is written to the shared folder, and
    the round before it deleted.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    mark = None
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").selectExpr("v AS u", "m AS v").unionByName(low.selectExpr("u", "m AS v")).distinct()
        before, now = now, materialise(small, "cc")
        free(before)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.selectExpr("u AS node", "v AS label").unionByName(now.selectExpr("v AS node", "v AS label").distinct())
        mark = new


def _labelled(df: DataFrame, column: str, label: DataFrame) -> DataFrame:
    """Add ``<column>_label``: the label of a node, itself where it has none."""
    named = label.select(F.col("node").alias(column), F.col("label").alias(f"{column}_label"))
    return df.join(named, column, "left").withColumn(f"{column}_label", F.coalesce(f"{column}_label", column))


def _least_shared(longer: Column | str) -> Column:
    """How many words two linked texts share at least, the longer having so many."""
    longer = F.col(longer) if isinstance(longer, str) else longer
    return longer - F.floor(longer * (1 - SIMILARITY) + 1e-9)


def _lengths_fit(a: str, b: str) -> Column:
    return F.least(a, b) >= _least_shared(F.greatest(a, b))


def possible(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b), written, of the distinct (a, b) whose lengths and bags (of ``signed``: node, n_words, bag) allow a link; no link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("near_dup")
        for batch in batches:
            least = batch.column("least").to_pylist()
            fits = [most_shared(x.as_py(), y.as_py()) >= n for n, x, y in zip(least, batch.column("bag"), batch.column("other_bag"))]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = signed.selectExpr("node AS a", "n_words", "bag")
    right = signed.selectExpr("node AS b", "n_words AS other_words", "bag AS other_bag")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").where(_lengths_fit("n_words", "other_words"))
    least = _least_shared(F.greatest("n_words", "other_words")).cast("long").alias("least")
    tried = both.select("a", "b", least, "bag", "other_bag").mapInArrow(run, "a long, b long")
    return materialise(tried.distinct(), "near-possible")


def _copies(known: DataFrame) -> DataFrame:
    """(doc_id, node), distinct and written: the least id of each document's text. Null texts count as empty."""
    digests = known.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    groups = materialise(digests.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "near-copies")
    member = materialise(digests.join(groups, "digest", "left").select("doc_id", F.coalesce("node", "doc_id").alias("node")).distinct(), "near-members")
    free(groups)
    return member


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least id of its class): one row for each id of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id IS NOT NULL")
    member = _copies(known)
    # Only the least id of each text goes on; what doesn't is mostly the shorter list.
    gone = materialise(member.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("node")).alias("own")).where("NOT own").select("doc_id"), "near-gone")
    signed = materialise(signatures(known.join(_bounded(gone), "doc_id", "left_anti")), "near-signatures")
    free(gone)
    buckets = signed.select(F.explode("bands").alias("key"), "node", "n_words")
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
    leaders = leaders.where("n > 1").join(signed.selectExpr("node AS leader", "n_words AS leader_words"), "leader")
    leaders = materialise(leaders, "near-leaders")
    stars = materialise(buckets.join(leaders, "key").where("node != leader").select("key", "leader", "leader_words", "node", "n_words", "n"), "near-stars")
    free(leaders)
    clean_shuffles(docs.sparkSession)

    label = None  # (node, label) of what is connected so far

    def connected(pairs: DataFrame) -> DataFrame:
        """Verify pairs and join what they link; returns the pairs with the outcome."""
        nonlocal label
        pairs = materialise(pairs, "near-pairs")
        outcome = verify(pairs, known)
        free(pairs)
        links = outcome.where("linked").select("a", "b")
        if label is None:
            label = components(links)
            return outcome
        top = components(_labelled(_labelled(links, "a", label).drop("a"), "b", label).selectExpr("a_label AS a", "b_label AS b"))
        moved = top.withColumnRenamed("label", "above").withColumnRenamed("node", "label")
        old = label.join(moved, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
        before, label = label, materialise(old.unionByName(top.join(label.select("node"), "node", "left_anti")), "near-labels")
        free(before)
        return outcome

    # Round one: every member against the least of its leaders that it can be linked to, and then against those it isn't connected with yet.
    pairs = possible(stars.where(_lengths_fit("leader_words", "n_words")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), signed)
    first = connected(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    rest = _labelled(_labelled(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), "a", label), "b", label)
    second = connected(rest.where("a_label != b_label").select("a", "b"))
    outcome = first.unionByName(second)
    free(pairs)
    # Round two: members that no alignment or chain connects with a leader meet the rest of its bucket.
    # A bucket of two has no rest.
    stars_of = _labelled(_labelled(stars.where("n > 2").withColumnRenamed("leader", "a").withColumnRenamed("node", "b"), "a", label), "b", label)
    stars_of = materialise(stars_of.select("key", "n", F.col("b").alias("node"), "n_words", F.col("b_label").alias("label"), F.col("a_label").alias("leader_label")), "near-rest")
    free(stars)
    apart = stars_of.where("label != leader_label")
    if not apart.isEmpty():
        keys = materialise(apart.select("key").distinct(), "near-keys")
        open_ = cells(stars_of.join(_bounded(keys), "key", "left_semi"))
        found = meet_directly(open_)
        held = materialise(held_by(open_), "near-open")
        ids = texts = shared = rare = None
        if not held.isEmpty():
            ids = materialise(held.select(F.col("node").alias("doc_id")), "near-ids")
            texts = materialise(rarest(known.join(_bounded(ids), "doc_id", "left_semi")).join(held, "node"), "near-texts")
            shared = materialise(shared_words(texts), "near-shared")
            rare = materialise(word_rows(texts).join(_bounded(shared), "word", "left_semi"), "near-rare")
            free(texts, shared)
            clean_shuffles(docs.sparkSession)
            found = found.unionByName(meet(rare))
        pairs = possible(found.distinct().join(outcome.select("a", "b"), ["a", "b"], "left_anti"), signed)
        free(keys, open_, held, ids, rare)
        clean_shuffles(docs.sparkSession)
        free(connected(pairs), pairs)
    free(first, second, stars_of, signed)
    found = member.join(label, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("class_id"))
    return found.unionByName(docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, is_kept (the class's least id) of every document."""
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class the least id stays; documents with null id stay."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    gone = materialise(classes(docs).where("doc_id != class_id").select("doc_id"), "near-gone")
    return docs.join(_bounded(gone), "doc_id", "left_anti")
