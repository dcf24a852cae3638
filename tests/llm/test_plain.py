"""Plain versions of toxicity, language profiles, token counts and the pipeline, and odd input for every operator."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pactspark.llm import ann, bpe, common, langid, line_dedup, media, near_dup, packing, secrets, token_counts, toxicity
from pactspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_counts(rows):
    """{feature: {(toxic, fold): rows}} of (row, fold, toxic, text), one row at a time."""
    first = {}
    for row, fold, toxic, text in rows:
        w = words_of(text)
        for i, x in enumerate(w):
            key = (w[i - 1] if i else None, x, w[i + 1] if i + 1 < len(w) else None, toxic)
            first[key] = min(first.get(key, (row, fold)), (row, fold))
    held = collections.defaultdict(set)
    for (_, x, _, toxic), (row, fold) in first.items():
        held[toxic, row, fold] |= {x, *(x[:k] + "*" for k in toxicity.PREFIXES if len(x) > k)}
    out = collections.defaultdict(collections.Counter)
    for (toxic, _, fold), features in held.items():
        for f in features:
            out[f][toxic, fold] += 1
    return out


def plain_odds(t, c, nt, nc):
    if t + c < toxicity.MIN_COUNT:
        return None
    share = (t + c) * toxicity.PRIOR / (nt + nc)
    a, b = t + max(toxicity.LEAST_PRIOR[0], share * nt), c + max(toxicity.LEAST_PRIOR[1], share * nc)
    odds = math.log(a / nt) - math.log(b / nc)
    low = odds - toxicity.DEVIATIONS * math.sqrt(1 / a + 1 / b)
    return low if low > toxicity.DRIFT else max(toxicity.LOWEST, min(odds, -toxicity.DRIFT))


def plain_segments(scores):
    """Maximal segments by their definition: the best one, then those to its left and right."""

    def best(lo, hi):
        sums = np.concatenate(([0.0], np.cumsum(scores[lo:hi])))
        top = (1e-12, 0, 0)
        low = 0
        for j in range(1, len(sums)):
            if sums[j] - sums[low] > top[0] + 1e-12:
                top = (sums[j] - sums[low], low, j)
            if sums[j] < sums[low]:
                low = j
        if top[0] <= 1e-9:
            return []
        return [*best(lo, lo + top[1]), top[0], *best(lo + top[2], hi)]

    return best(0, len(scores))


def plain_score(model, odds, text):
    """Score of a text by a dictionary of odds and a model's calibration."""
    w = words_of(text)
    find = lambda x: next((odds[f] for f in [x, *(x[:k] + "*" for k in reversed(toxicity.PREFIXES) if len(x) > k)] if odds.get(f) is not None), -toxicity.DRIFT)
    segments = sorted(plain_segments(np.array([find(x) for x in w])), reverse=True) if w else []
    best, total = 0.0, 0.0
    for r, s in enumerate(segments, 1):
        total += model.rate * s - math.log(len(w) * model.scale)
        if total <= 0:
            break
        if total > r:  # e^-T T^(r-1) / (r! (r-1)!)
            best = max(best, -(-total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)))
    z = model.slope * min(best, 50) + model.offset
    return (segments, len(w), 1 / (1 + math.exp(-z)) if z > -700 else 0.0)


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    neutral = [f"w{i}" for i in range(150)]
    bad = [f"nasty{s}" for s in ("ly", "est", "ness", "ies")] + ["vile", "foul"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(neutral) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(2, 6) if toxic else rng.random() < 0.05):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_feature_counts_and_odds(spark):
    rng = random.Random(4)
    rows = [(i, i % 4, i % 3 // 2, " ".join(rng.choice(["abcd", "abcdefgh", "x", "Über", "日本語です", "abc"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, i % 4, y, t) for i, (_, _, y, t) in enumerate(rows[:20])]  # copies
    got = {r.key: r for r in toxicity.feature_counts(spark.createDataFrame(rows, "row long, fold int, toxic int, text string")).collect()}
    want = plain_counts(rows)
    signed = lambda f: int(np.uint64(xxhash.xxh64_intdigest(f.encode(), 42)).astype(np.int64))
    assert {*got} == {signed(f) for f in want}
    for f, n in want.items():
        assert all(got[signed(f)][f"{'ct'[y]}{k}"] == n[y, k] for y in (0, 1) for k in range(4)), f
    pairs = [(rng.choice([0, 1, 3, 50, 400]), rng.choice([0, 2, 9, 3000])) for _ in range(40)]
    sql = toxicity.odds_sql("t", "c", 500, 4000)
    for r in spark.createDataFrame(pairs, "t long, c long").selectExpr("t", "c", f"{sql} AS odds").collect():
        want = plain_odds(r.t, r.c, 500, 4000)
        assert (r.odds is None) == (want is None) and (want is None or abs(r.odds - want) < 1e-9)


def test_toxicity_against_plain(spark):
    """Odds, segments, tail, curve and scores of a trained model against the plain version; the joined path gives the same."""
    docs, labels = toxic_corpus()
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "vile " * 3000, "en", "s", 0)]
    frame = spark.createDataFrame(docs, DOCS)
    label_frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, label_frame)
    sample = toxicity.training_rows(frame, label_frame).select("row", "fold", "toxic", "text").collect()
    assert {zlib.crc32(str(i).encode()) % 3 for i, t, *_ in docs if any(r.text == t for r in sample)} == {0, 2}
    counts = plain_counts([tuple(r) for r in sample])
    sizes = collections.Counter((r.toxic, r.fold) for r in sample)

    def odds(left_out):
        of = lambda n, y: sum(v for (a, f), v in n.items() if a == y and f != left_out)
        return {f: plain_odds(of(n, 1), of(n, 0), of(sizes, 1), of(sizes, 0)) for f, n in counts.items() if sum(n.values()) >= toxicity.MIN_COUNT}

    full = odds(None)
    assert len(model.keys) == len(full)
    parts = {f: odds(f) for f in range(toxicity.FOLDS)}
    seen = [(r.toxic, *plain_score(model, parts[r.fold], r.text)) for r in sample]
    tail = [s for y, segments, _, _ in seen if not y for s in segments]
    assert abs(model.rate - min(3.0, max(0.25, len(tail) / sum(tail)))) < 1e-4
    assert abs(model.scale - (len(tail) + 0.5) / sum(n for y, _, n, _ in seen if not y)) < 1e-6
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    want = {i: plain_score(model, full, t) for i, t, *_ in docs}
    assert all(abs(got[i].score - s) < 1e-3 for i, (_, _, s) in want.items())
    assert all(len(got[i].passages) == sum(model.expected(x, n) <= toxicity.EXPECTED for x in seg) for i, (seg, n, _) in want.items() if not any(abs(model.expected(x, n) - toxicity.EXPECTED) < 1e-4 for x in seg))
    held = [(y, got[i].predicted if "predicted" in got[i] else got[i].score >= 0.7) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p for y, p in held if y) > 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) < 0.03 * len(held)
    joined = toxicity.train(frame, label_frame, broadcast_features=0)
    assert joined.features is not None and abs(joined.slope - model.slope) < 1e-6 and abs(joined.offset - model.offset) < 1e-6
    for r in toxicity.score(frame, joined).collect():
        assert abs(r.score - got[r.doc_id].score) < 1e-6 and r.passages == got[r.doc_id].passages
    assert sorted(r.doc_id for r in toxicity.keep_clean(frame, joined).collect()) == sorted(r.doc_id for r in toxicity.keep_clean(frame, model).collect())


def test_logistic_fit():
    """The gradient vanishes; separable rows have a fit too."""
    rng = np.random.default_rng(2)
    for x, y in ((rng.normal(0, 5, 400), None), (np.concatenate([np.zeros(300), np.full(40, 30.0)]), None), (np.zeros(50), None)):
        y = (x + rng.normal(0, 3, len(x)) > 4).astype(int) if y is None else y
        slope, offset = toxicity.fit_logistic(x, y)
        n1, n0 = y.sum(), (1 - y).sum()
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        assert abs((target - p).sum()) < 1e-4 * len(x)
        assert slope == 0 or abs(((target - p) * x).sum()) < 1e-3 * len(x)


def test_language_bundles():
    """Binding, bundling and cosine, one trigram at a time, also where a text goes over several slices."""
    rng = random.Random(5)
    texts = ["Hello,  world", "", None, "123", "été à Łódź", "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(10_000))]
    vector = lambda c: langid._letter_vector(ord(c)).astype(int)
    got = {i: b for kept, slices in langid._blocks(texts) for i, b in zip(kept, langid.bundles(slices))}
    for i in (0, 4, 5):
        letters = re.sub(r"[^\w]+|[\d_]+", " ", " " + texts[i].lower() + " ")
        total = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        assert (got[i] == total).all()
    assert {*got} == {0, 4, 5}


def test_language_prototypes(spark):
    rows = [(1, "aaa bbb", "x"), (2, "ccc ddd", "y"), (3, "aaa", "x"), (4, "zz", None)]
    got = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = lambda t: sum(b for _, s in langid._blocks([t]) for b in langid.bundles(s))
    for lang, texts in (("x", ["aaa bbb", "aaa"]), ("y", ["ccc ddd"])):
        v = sum(map(own, texts))
        assert np.allclose(got[lang], v / np.linalg.norm(v))
    assert [*got] == ["x", "y"]
    tie = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), {"b": got["x"], "a": got["x"]}).where("doc_id = 1").first()
    assert tie.lang_pred == "b"  # the first in order


def test_token_counts_against_plain(spark):
    docs = common.table(spark, SF, "documents").collect()
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ranks = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    byte = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.defaultdict(lambda: [0, 0])
    for d in docs:
        version = token_counts.BYTES if d.lang == "de" else token_counts.WORDS
        n = len(byte.encode_ordinary(d.text or "")) if d.lang == "de" else len(word.encode(d.text or "", add_special_tokens=False).ids)
        want[d.source, d.lang, version][0] += 1
        want[d.source, d.lang, version][1] += n
    got = {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    assert got == dict(want)


def test_rollup_store(spark, tmp_path):
    store = token_counts.RollupStore(spark, str(tmp_path / "store"))
    schema = "op string, source string, lang string, version string, tokens long"
    feed = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert store.commit("1", feed(("insert", "a", "en", "v", 5), ("insert", "b", "en", "v", 7)))
    assert store.commit("2", feed(("delete", "a", "en", "v", 5)))
    before = sorted(map(tuple, store.totals().collect()))
    store.compact()
    assert sorted(map(tuple, store.totals().collect())) == before == [("b", "en", "v", 1, 7)]
    assert store.batches() == [] and not store.commit("1", feed(("insert", "a", "en", "v", 5)))
    assert store.commit("3", feed(("insert", "a", "en", "v", 1)))
    store.compact()
    assert not store.commit("2", feed(("delete", "a", "en", "v", 5))) and len(store.bases()) == 1
    with pytest.raises(ValueError):
        store.commit("4", feed(("delete", "never", "en", "v", 1)))
    for op in ("upsert", None):
        with pytest.raises(Exception, match="op must be"):
            store.commit("5", feed((op, "a", "en", "v", 1)))
    assert sorted(map(tuple, store.totals().collect())) == [("a", "en", "v", 1, 1), ("b", "en", "v", 1, 7)]
    assert [p.name for p in (tmp_path / "store").iterdir() if p.name.startswith(".staging")] in ([], [".staging"]) or store.commit("6", feed(("insert", "a", "en", "v", 1)))
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.createDataFrame([], DOCS), "words-1")


def plain_pipeline(docs, toxic_ids):
    """What the stages keep, in loops: {doc_id: text}."""
    kept = [d for d in docs if d[0] not in toxic_ids]
    pages = collections.Counter(d[3] for d in kept)
    count = collections.Counter((d[3], x) for d in kept for x in {y.strip(" \t\r\f\v") for y in (d[1] or "").split("\n")} - {""})
    gone = {k for k, n in count.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    texts = {d[0]: None if d[1] is None else "\n".join(x for x in d[1].split("\n") if (d[3], x.strip(" \t\r\f\v")) not in gone) for d in kept}
    above = {i: i for i in texts}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = ((texts[i] or "").lower().split() for i in (a, b))
        row = [*range(len(y) + 1)]
        for i, u in enumerate(x, 1):
            new = [i]
            for j, v in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (u != v)))
            row = new
        if (texts[a] or "") == (texts[b] or "") or (x and y and 5 * row[-1] <= max(len(x), len(y))):
            above[max(top(a), top(b))] = min(top(a), top(b))
    texts = {i: t for i, t in texts.items() if top(i) == i}
    secret = re.compile(r"(?:password|token)[:=] ?[A-Za-z0-9]{6,}")
    return {i: None if t is None else secret.sub("[REDACTED]", t) for i, t in texts.items()}


def test_pipeline_against_plain(spark, tmp_path):
    rng = random.Random(6)
    docs, labels = toxic_corpus(160, seed=9)
    docs = [(i, f"{t}\n{'menu of the site' if s == 's1' else f'line {i} of its own'}", lang, s, n) for i, t, lang, s, n in docs]
    clean = [d for d in docs if d[0] % 4]
    for j in range(25):  # exact and near copies, some with secrets
        i, t, lang, s, n = rng.choice(clean)
        w = t.split(" ")
        w[rng.randrange(len(w))] = f"edit{j}"
        docs += [(1000 + j, " ".join(w), lang, s, n), (1100 + j, t, lang, s, n), (1200 + j, f"{t} extra words {j} password: abc{j}defXYZ token=zzz{j}yyy " + " ".join(f"own{j}x{k}" for k in range(40)), lang, s, n)]
    docs += [(2000, None, "en", "s0", None), (2001, "", "en", "s0", 0), (2002, "", "en", "s2", 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = common.table(spark, str(tmp_path), "documents")
    model = toxicity.train(frame, common.table(spark, str(tmp_path), "labels"))
    sample = toxicity.training_rows(frame, common.table(spark, str(tmp_path), "labels")).select("row", "fold", "toxic", "text").collect()
    counts = plain_counts([tuple(r) for r in sample])
    sizes = collections.Counter(r.toxic for r in sample)
    of = lambda n, y: sum(v for (a, _), v in n.items() if a == y)
    odds = {f: plain_odds(of(n, 1), of(n, 0), sizes[1], sizes[0]) for f, n in counts.items()}
    toxic = {d[0] for d in docs if plain_score(model, odds, d[1])[2] >= 0.7}
    assert 30 <= len(toxic) <= 45
    want = plain_pipeline(docs, toxic)
    assert len(want) < len(docs) - len(toxic) - 40
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in want.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {*ids}
    for i, x in ids.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(x)


@pytest.fixture(scope="module")
def empty(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    run = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert run(spark, empty).count() == 0


def test_clashing_columns(spark):
    """Columns with the names of inner ones come back as they were."""
    rows = [(i, f"menu\nbody {i} password=abcdef{i}\nfoot", "en", "h", 5) for i in range(20)] + [(50, None, None, None, None)]
    odd = spark.createDataFrame(rows, DOCS)
    extra = ["_lines", "_kept", "_host", "_boilerplate", "_line_host", "_LINE_kept", "_secret_text", "_Secret_assign", "_redact_base", "host", "lines", "boilerplate", "n_lines", "bag", "node", "key", "row", "found"]
    for c in extra:
        odd = odd.withColumn(c, F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")))
    same = [c for c in extra if c != "n_lines"]
    dropped = line_dedup.drop_lines(odd).collect()
    assert all(r[c] == f"{c}-{r.doc_id}" for r in dropped for c in same) and sum(r.n_dropped for r in dropped) == 40
    redacted = secrets.redact(odd)
    assert redacted.columns == odd.columns
    for r in redacted.collect():
        assert all(r[c] == f"{c}-{r.doc_id}" for c in extra) and (r.text is None or r.text.split("\n")[1] == f"body {r.doc_id} [REDACTED]")
    spans = secrets.find_spans(odd).collect()
    assert all(r[c] == f"{c}-{r.doc_id}" for r in spans for c in extra) and all(len(r.base_spans) == (r.doc_id < 50) for r in spans)
    got = near_dup.classes(odd)
    assert got.count() == 21 and langid.predict(odd, {}).count() == 21 and packing.pack(odd, public_tokenizers.path(packing.TOKENIZER)).count() >= 21
    assert toxicity.keep_clean(odd, toxicity.Model()).columns == odd.columns and media.store_texts(odd.select("doc_id", "text")).count() == 21
    assert {c: n for c, n in odd.dtypes} == {c: n for c, n in toxicity.keep_clean(odd, toxicity.Model()).dtypes}


def test_many_secrets_in_a_text(spark):
    """Time grows with the hits of a text, not with their square, and blocks don't show in the result."""
    import time

    took = []
    for n in (3_000, 12_000):
        text = " ".join(f"token=abc{i:06d}x" for i in range(n))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        (r,) = secrets.find_spans(rows).select("base_spans").collect()
        took.append(time.perf_counter() - began)
        assert [(s.start, s.end) for s in r.base_spans] == [(m.start(), m.end()) for m in re.finditer(r"token=\w+", text)]
        assert secrets.redact(rows).first().text == " ".join(["[REDACTED]"] * n)
    assert took[1] < 10 * took[0]


def test_bags_and_prefixes_lose_no_link():
    """Bags bound what texts share from above; of linked texts the rarest words always meet."""
    rng = random.Random(7)
    for _ in range(300):
        n = rng.choice([1, 3, 10, 60, 500])
        a = [rng.choice(["the", "of", f"w{rng.randrange(40)}"]) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, n // 5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = [rng.choice(["the", f"new{rng.randrange(99)}"])] * rng.randint(0, 1)
        if not b:
            continue
        x, y = (near_dup.labelled_words(near_dup._Words().hashes(t)) for t in (a, b))
        assert near_dup.most_shared(near_dup.bag(x), near_dup.bag(y)) >= len({*x.tolist()} & {*y.tolist()})
        frequency = np.random.default_rng(len(a)).integers(0, 5, near_dup.RANKS).astype(np.int32)
        if near_dup.near(" ".join(a), " ".join(b)):
            assert {*near_dup.prefix(x, frequency).tolist()} & {*near_dup.prefix(y, frequency).tolist()}
    many = near_dup.labelled_words(np.zeros(300_000, np.uint64) + np.uint64(5))
    assert near_dup.most_shared(near_dup.bag(many), near_dup.bag(many[:200])) >= 200


def test_large_bucket_meets_by_rare_words(spark):
    """Texts that share a long phrase and little else: only the pairs that are near are linked, through the large-bucket path."""
    rng = random.Random(11)
    phrase = " ".join(f"p{i}" for i in range(60))
    texts = []
    for g in range(60):
        own = [f"o{g}x{k}" for k in range(60)]
        texts.append(f"{phrase} {' '.join(own)}")
        if g % 3 == 0:
            for i in rng.sample(range(60), 8):
                own[i] = f"e{g}y{i}"
            texts.append(f"{phrase} {' '.join(own)}")
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    above = [*range(len(texts))]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if near_dup.near(texts[a], texts[b]) and above[a] != above[b]:
            low, high = sorted((above[a], above[b]))
            above = [low if x == high else x for x in above]
    assert got == dict(enumerate(above)) and len({*above}) == 60


def test_near_copies_meet_once(spark):
    """A pair of texts that share many rare words makes about one row, not one for each word, and none is lost."""
    rng = random.Random(5)
    texts = []
    for i in range(80):
        own = [f"w{k}" for k in range(100)]
        for k in rng.sample(range(100), 18):
            own[k] = f"e{i}y{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bits = [F.lit(1).cast("long").alias(f"bits{i}") for i in range(4)]
    rare = near_dup.rare_words(docs).select("*", F.lit(100).alias("n_words"), F.col("node").alias("label"), F.lit(True).alias("apart"), *bits)
    got = [tuple(r) for r in near_dup.meet(rare).collect()]
    every = [tuple(r) for r in near_dup.meet(rare.drop(*[c for c in rare.columns if c.startswith("before")])).collect()]
    assert {*got} == {*every} and len(got) < 1.3 * len({*got}) and len(every) > 1.5 * len({*got})
    assert all((a, b) in {*got} for a, b in itertools.combinations(range(80), 2) if near_dup.near(texts[a], texts[b]))


def test_cells_lose_no_pair(spark):
    """All pairs of a bucket that can be linked are paired directly or share a large cell, and no others directly."""
    rng = random.Random(3)
    words = [rng.choice([1, 2, 4, 5, 64, 80, 81, 100, 101, rng.randint(1, 400)]) for _ in range(260)]
    label = [rng.randrange(200) for _ in words]
    buckets = [rng.sample(range(260), n) for n in (3, 12, 40, 150, 150)]
    rest = [(key, node, words[node], label[node], label[nodes[0]]) for key, nodes in enumerate(buckets) for node in nodes]
    found = near_dup.cells(spark.createDataFrame(rest, "key long, node long, n_words long, label long, leader_label long"))
    direct = {tuple(r) for r in near_dup.meet_directly(found).collect()}
    held = {r.node: r for r in near_dup.held_by(found).collect()}
    fit = lambda x, y: min(x, y) >= max(x, y) - math.floor(max(x, y) * 0.2 + 1e-9)
    every = {(a, b) for nodes in buckets for a, b in itertools.combinations(sorted(nodes), 2) if label[a] != label[b] and fit(words[a], words[b])}
    large = {(a, b) for a, b in itertools.combinations(sorted(held), 2) if (held[a].apart or held[b].apart) and any(held[a][f"bits{i}"] & held[b][f"bits{i}"] for i in range(4))}
    assert direct <= every and every <= direct | large and direct and every - direct
    assert all(held[x].label == label[x] and held[x].n_words == words[x] for x in held)


def test_buckets_of_chance_are_split_by_length(spark, monkeypatch):
    """Texts that share a bucket but have lengths that allow no link aren't dealt by their words."""
    texts = [" ".join(f"p{i}" for i in range(n)) for n in (64, 82, 104, 132, 168)]
    rows = {}

    def counted(df, name):
        made = common.materialise(df, name)
        rows[name] = rows.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(near_dup, "materialise", counted)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(5)} and rows["near-keys"] > 0 and not rows.get("near-rare")


def test_ann_recall_over_several_blocks(spark, monkeypatch):
    """Recall where candidates fill many blocks and queries several parts; at two sizes."""
    monkeypatch.setattr(ann, "BLOCK", 256)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    for n in (600, 2000):
        part = rows.orderBy("vec_id").limit(n)
        ids, x = zip(*[(r.vec_id, r.embedding) for r in part.collect()])
        ids, x = np.array(ids), np.array(x, float)
        found = collections.defaultdict(list)
        for r in ann.search(part, "id % 20 = 0", rerank=40).collect():
            found[r.query_id].append((r.rank, r.vec_id, r.score))
        hits = 0
        for q in ids[ids % 20 == 0]:
            s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
            got = sorted(found[q])
            hits += len({*ids[np.lexsort((ids, -s))[:20]]} & {v for _, v, _ in got})
            assert all(abs(p - math.fsum(x[ids == v][0] * x[ids == q][0])) == 0 for _, v, p in got)
            assert [(-p, v) for _, v, p in got] == sorted((-p, v) for _, v, p in got)
        assert hits >= 0.9 * 20 * len(found), (n, hits / (20 * len(found)))


def test_cosine_hash():
    """The hash against the sums that define box means and a cosine transform."""
    rng = np.random.default_rng(3)
    for h, w in ((12, 20), (media.GRID, media.GRID), (71, 45), (1, 64)):
        pixels = rng.integers(0, 256, (h, w)).astype(np.uint8)

        def part(n, i):
            if n < media.GRID:
                return [i * n // media.GRID]
            return range(i * n // media.GRID, (i + 1) * n // media.GRID)

        grid = [[np.mean([float(pixels[y, x]) for y in part(h, i) for x in part(w, j)]) for j in range(media.GRID)] for i in range(media.GRID)]
        turn = lambda k, x: math.cos(math.pi * k * (2 * x + 1) / (2 * media.GRID))
        low = [sum(grid[y][x] * turn(u, y) * turn(v, x) for y in range(media.GRID) for x in range(media.GRID)) for u in range(media.LOW) for v in range(media.LOW)]
        median = sorted(low[1:])[len(low[1:]) // 2]
        bits = np.unpackbits(np.frombuffer(media.dct_hash(pixels), np.uint8))
        assert all(b == (x > median) for b, x in zip(bits, low) if abs(x - median) > 1e-6)
