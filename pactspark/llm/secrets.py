"""Secret scans, in DataFrame expressions only.

Two layers find spans in a text:

* base patterns (``assign``, ``access``, ``hex``), leftmost and non-overlapping
  per kind;
* the entropy layer: over every candidate string (a maximal run of base64-like
  characters with a digit in it) a window slides; the window's character counts
  and the sum of ``c * log2(c)`` are kept up to date as one character leaves and
  one enters, so each step costs the same whatever the window's width. The
  candidate's character class (hex, upper-case alphanumeric, base64) sets the
  entropy that a window must reach. Candidates on the allow-list are suppressed;
* pieces: the maximal runs of hex, upper-case or lower-case alphanumerics in the text,
  whatever joins them to other characters (``key=``, ``sk_live_``). All windows of one of
  these classes lie in such a run, so each is judged by its own class's limit. A piece
  with a digit, off the allow-list by itself, is a span as a whole if one window reaches
  the limit.

Positions: ``split`` and ``regexp_extract_all`` walk a text in the same way, so
running sums over their pieces are the matches' offsets, in code points.

Defined results: null text counts as empty; empty text has no spans; repeated
rows give repeated results; a null id passes through; ties of start are ordered
by kind. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm.common import DOCUMENT_COLUMNS, free_prefix, table

ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: Runs of one class, and their kind; the limits of the lower-case and the upper-case class are the same, as are their alphabets' sizes.
PIECES = (
    (r"(?<![0-9a-f])[0-9a-f]{20,}+", 3),
    (r"(?<![0-9A-F])[0-9A-F]{20,}+", 3),
    (r"(?<![0-9A-Z])[0-9A-Z]{20,}+", 4),
    (r"(?<![0-9a-z])[0-9a-z]{20,}+", 6),
)

WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Bits per character that a window of a class must reach.
THRESHOLDS = {"ent_hex": 3.0, "ent_upper": 3.6, "ent_base64": 3.9, "ent_lower": 3.6}
#: Candidates that match one of these are no secrets.
ALLOW_LIST = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9_=+/-]+$",  # numbers
    r"EXAMPLE|example|0123456789|abcdefghij|1234567890",  # placeholders
    r"^/?([a-z0-9_-]*[a-z][a-z0-9_-]*/)+[a-z0-9_-]*$",  # paths
)
_SCALE = 1_000_000
#: Items of an array whose outputs are gathered at once.
_BLOCK = 128
_KINDS = ("assign", "access", "hex", *THRESHOLDS)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scanned(items: str, at: str, out: str, kind: str) -> str:
    """SQL for array<kind>: walks an array, ``a.at`` being a number carried along, ``x`` the item; ``at`` and ``out`` are its next value and the item's output.

    Outputs are gathered in blocks of ``_BLOCK``, so a long array isn't copied for each of its items.
    """
    return f"""transform(array({items}), whole -> flatten(aggregate(
        transform(sequence(1, greatest(1, cast(ceil(size(whole) / {_BLOCK}) as int))), b -> slice(whole, (b - 1) * {_BLOCK} + 1, {_BLOCK})),
        named_struct('at', 0L, 'out', cast(array() as array<array<{kind}>>)),
        (acc, block) -> transform(array(aggregate(block,
            named_struct('at', acc.at, 'out', cast(array() as array<{kind}>)),
            (a, x) -> named_struct('at', {at}, 'out', concat(a.out, array({out}))))),
          done -> named_struct('at', done.at, 'out', concat(acc.out, array(done.out))))[0],
        acc -> acc.out)))[0]"""


def _located(text: str, pattern: str, kind: int) -> str:
    """SQL for array<struct<start, kind, end, hit>> of all matches, offsets from 0."""
    p = _quoted(pattern)
    slim = "struct<start: bigint, kind: int, `end`: bigint, hit: string>"
    pieces = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, hit) -> named_struct('gap', gap, 'hit', hit))"
    found = f"cast(named_struct('start', a.at + length(x.gap), 'kind', {kind}, 'end', a.at + length(x.gap) + length(x.hit), 'hit', x.hit) as {slim})"
    walked = _scanned(pieces, "a.at + length(x.gap) + coalesce(length(x.hit), 0)", found, slim)
    return f"CASE WHEN {text} RLIKE {p} THEN filter({walked}, x -> x.hit IS NOT NULL) ELSE cast(array() as array<{slim}>) END"


def _entropy_extent(hit: str, kind: str) -> str:
    """SQL for struct<first, last>: from the first to the last window that reaches its class's entropy (first -1: none)."""
    f = [0, *(round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1)), 0]
    table_ = "array(" + ", ".join(f"{x}L" for x in f) + ")"
    cap = {k: round((math.log2(WINDOW) - t) * WINDOW * _SCALE) for k, t in THRESHOLDS.items()}
    limit = f"CASE {kind} WHEN 3 THEN {cap['ent_hex']}L WHEN 4 THEN {cap['ent_upper']}L WHEN 6 THEN {cap['ent_lower']}L ELSE {cap['ent_base64']}L END"
    leave = f"(CASE WHEN i > {WINDOW} THEN y.codes[i - {WINDOW + 1}] ELSE 0 END)"
    enter = "y.codes[i - 1]"
    gone = f"(CASE WHEN i > {WINDOW} THEN acc.counts[y.codes[i - {WINDOW + 1}] - 1] ELSE 1 END)"
    there = f"(acc.counts[{enter} - 1] - CASE WHEN {leave} = {enter} THEN 1 ELSE 0 END)"
    total = f"(acc.s + y.f[{gone} - 1] - y.f[{gone}] + y.f[{there} + 1] - y.f[{there}])"
    # f[0] = f[1] = 0, so a window that isn't full yet loses nothing.
    return f"""aggregate(
        transform(array(named_struct('f', {table_}, 'cap', {limit},
            'codes', transform(split({hit}, ''), ch -> locate(ch, '{ALPHABET}')))), y ->
          aggregate(sequence(1, size(y.codes)),
            named_struct('counts', array_repeat(0, {len(ALPHABET)}), 's', 0L, 'first', -1, 'last', -1),
            (acc, i) -> named_struct(
              'counts', CASE WHEN {leave} = {enter} THEN acc.counts ELSE transform(acc.counts, (c, j) ->
                  c + CASE WHEN j + 1 = {enter} THEN 1 ELSE 0 END - CASE WHEN j + 1 = {leave} THEN 1 ELSE 0 END) END,
              's', {total},
              'first', CASE WHEN acc.first < 0 AND i >= {WINDOW} AND {total} <= y.cap THEN i - {WINDOW} ELSE acc.first END,
              'last', CASE WHEN i >= {WINDOW} AND {total} <= y.cap THEN i ELSE acc.last END),
            acc -> named_struct('first', acc.first, 'last', acc.last))),
        named_struct('first', -1, 'last', -1), (a, z) -> z)"""


def _class(hit: str) -> str:
    return f"CASE WHEN {hit} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 3 WHEN {hit} RLIKE '^[A-Z0-9]+$' THEN 4 ELSE 5 END"


def find_spans(docs: DataFrame, text_col: str = "text", allow_list: tuple[str, ...] = ALLOW_LIST, base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """Add (or replace) ``base_spans`` and ``spans``: array<struct<start, kind, end>> ordered by start and kind.

    ``kind`` is a position in ``assign, access, hex, ent_hex, ent_upper, ent_base64, ent_lower``;
    offsets are code points from 0, the end is exclusive. ``spans`` holds the base
    spans and those of the entropy layer.
    """
    p = free_prefix(docs, "_secret")
    t = f"{p}_text"
    slim = "struct<start: bigint, kind: int, `end`: bigint>"
    bare = lambda x: f"transform({x}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.`end`))"
    allowed = " OR ".join(f"x.hit RLIKE {_quoted(p)}" for p in allow_list) or "false"
    df = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({
        f"{p}_assign": F.expr(f"filter({_located(t, ASSIGN, 0)}, x -> length(regexp_extract(x.hit, {_quoted(ASSIGN)}, 2)) >= 6)"),
        f"{p}_access": F.expr(_located(t, ACCESS, 1)),
        f"{p}_hex": F.expr(_located(t, HEX, 2)),
        f"{p}_cand": F.expr(f"filter({_located(t, CANDIDATE, 3)}, x -> x.hit RLIKE '[0-9]' AND NOT ({allowed}))"),
    })
    df = df.withColumn(
        f"{p}_entropy",
        F.expr(
            f"filter(transform({p}_cand, x -> named_struct('x', x, 'w', {_entropy_extent('x.hit', _class('x.hit'))}, 'k', {_class('x.hit')})), z -> z.w.first >= 0)"
        ),
    )
    # Candidates that are of one class as a whole are judged above.
    whole = f"exists({p}_cand, c -> c.start = x.start AND c.`end` = x.`end` AND x.kind = k)".replace("= k)", f"= {_class('c.hit')})")
    found = "concat(" + ", ".join(_located(t, x, k) for x, k in PIECES) + ")"
    df = df.withColumn(f"{p}_piece", F.expr(f"filter({found}, x -> x.hit RLIKE '[0-9]' AND NOT ({allowed}))"))
    df = df.withColumn(f"{p}_piece", F.expr(f"filter(filter({p}_piece, x -> NOT {whole}), x -> {_entropy_extent('x.hit', 'x.kind')}.first >= 0)"))
    base = f"concat({bare(f'{p}_assign')}, {bare(f'{p}_access')}, {bare(f'{p}_hex')})"
    more = f"transform({p}_entropy, z -> named_struct('start', z.x.start + z.w.first, 'kind', z.k, 'end', z.x.start + z.w.last))"
    df = df.withColumn(base_col, F.expr(f"array_sort(cast({base} as array<{slim}>))"))
    df = df.withColumn(spans_col, F.expr(f"array_sort(concat(`{base_col}`, cast(array_distinct(concat({more}, {bare(f'{p}_piece')})) as array<{slim}>)))"))
    return df.drop(t, *[f"{p}_{x}" for x in ("assign", "access", "hex", "cand", "entropy", "piece")])


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in _KINDS) + ")"
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.`end`)))")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Replace every found span (overlapping ones as one) by ``mark``; a null text stays null."""
    kept = docs.columns
    p = free_prefix(docs, "_redact")
    df = find_spans(docs, text_col, base_col=f"{p}_base", spans_col=f"{p}_spans")
    t, m, spans = f"`{text_col}`", _quoted(mark), f"{p}_spans"
    # What stands before a span and after all spans before it, and the mark; nothing for a span that begins in another one.
    piece = f"CASE WHEN x.start < a.at THEN '' ELSE concat(substring({t}, cast(a.at + 1 as int), cast(x.start - a.at as int)), {m}) END"
    pieces = _scanned(spans, "greatest(a.at, x.`end`)", piece, "string")
    rest = f"substring({t}, cast(array_max(transform({spans}, s -> s.`end`)) + 1 as int))"
    new = f"CASE WHEN size({spans}) = 0 THEN {t} ELSE concat(array_join({pieces}, ''), {rest}) END"
    return df.withColumn(text_col, F.expr(new)).select(*[f"`{c}`" for c in kept])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every document."""
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(base_spans, s -> s.kind = {k})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        F.expr("cast(size(spans) - size(base_spans) as bigint)").alias("n_entropy"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets redacted and n_chars brought up to date."""
    out = redact(docs.select(*DOCUMENT_COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
