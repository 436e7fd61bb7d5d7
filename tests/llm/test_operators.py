"""The ten operators against brute force, round trips, the tokenizers library and held-out rows, with the odd cases of each."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from smokelake.llm import bpe_codec, language_id, line_dedup, mixing, ngram_join, quality_mil, quality_rules, secret_scan, token_counts, vector_search
from smokelake.llm import queries as Q

from ..compare import connection, duck_rows, spark_rows
from ..conftest import DATA

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "Hello World's café 123", "a", 7), (2, None, "b", 7), (3, "", None, 7), (4, "Hello World's café 123", "a", 7), (4, "Hello World's café 123", "a", 7),
    (None, "x<|endoftext|>y ΑΣ éé ☃ \U0001f600 \x1c\x85\xa0", "c", 7), (6, "word " * 30000, "a", 7), (7, " \n\t ", "a", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, and columns whose names clash with results."""
    return spark.createDataFrame([(*r, 99) for r in ODD], "doc_id long, text string, source string, n_tokens int, score int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_twins(spark, name):
    assert spark_rows(Q.QUERIES[name](spark, DATA)) == duck_rows(connection(DATA), Q.ORACLES[name])


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, odd, none, docs, library):
    for df in (odd, docs):
        for r in token_counts.token_counts(df, TOKENIZER, 100).collect():
            assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(_ids(library, r.text)))
            assert r.over_limit == (r.n_tokens > 100)
    assert token_counts.token_counts(none, TOKENIZER).count() == 0


def test_bpe_round_trip(spark, odd, none, docs, library):
    for df in (odd, docs):
        for r in bpe_codec.decode(bpe_codec.encode(df, TOKENIZER), TOKENIZER).collect():
            ids = _ids(library, r.text)
            assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode(none, TOKENIZER).count() == 0


def test_bpe_digests(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in Q.op8_bpe_codec(spark, DATA).collect():
        ids = _ids(library, texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest() and r.n_tokens == len(ids)


def _fill(sizes, weights, cap):
    """Clamp and reshare until nothing is above its cap."""
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [k for k in sizes if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > cap * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: cap * sizes[k] for k in over}


def test_water_filling_against_rounds(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 70}, {"a": 0, "b": 3}, {"a": 1, "b": 1, "c": 1000}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = _fill(sizes, {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(sizes))}, 3)
        for r in mixing.water_fill(df).collect():
            assert r.target == pytest.approx(want[r.source])


def test_mixing_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and mixing.mix(none).count() == 0
    assert all(0 <= r.taken <= 3 * r["size"] and r.copies <= 3 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert {r["size"] for r in rows if r.doc_id in (2, 3, 7)} == {0}
    for _, part in itertools.groupby(sorted(rows, key=lambda r: str(r.source)), key=lambda r: str(r.source)):
        part = list(part)
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r["size"] for r in part) / 2 + 1e-6


def test_mixing_repeats_documents(spark, docs):
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = collections.Counter(r.doc_id for r in mixing.repeated(docs).select("doc_id").collect())
    assert got == collections.Counter({k: v for k, v in copies.items() if v})


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in Q.op3_quality_mil(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, labels[k]) for k, r in rows.items() if r.held_out and k in labels]
    pairs = [(a, b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(a > b for a, b in pairs) / len(pairs) > 0.95
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 for k, r in rows.items())


def test_quality_odd_rows(spark, odd, none):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = quality_mil.fit(odd, labels, F.lit(True), quality_mil.QualitySettings(epochs=1))
    rows = quality_mil.quality_score(odd, model).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality_mil.quality_score(none, model).count() == 0
    unlabelled = labels.withColumn("label", F.lit(None).cast("int"))
    for docs, told, learn in ((odd, labels, F.lit(False)), (odd, unlabelled, F.lit(True)), (none, labels, F.lit(True)), (odd, labels.limit(0), F.lit(True))):
        blank = quality_mil.fit(docs, told, learn)
        assert {(r.score, r.predicted) for r in quality_mil.quality_score(odd, blank).collect()} == {(0.5, 1)}
    twice = quality_mil.fit(odd, labels.union(labels), F.lit(True), quality_mil.QualitySettings(epochs=1))
    assert all(np.array_equal(twice.p[k], model.p[k]) for k in model.p)


def test_passages_of_long_texts():
    """In parts or at once, and no count is cut."""
    s, rng = quality_mil.QualitySettings(), np.random.default_rng(4)
    for n in (0, 1, 2, 511, 512, 513, 64 * 512 - 1, 64 * 512, 64 * 512 + 1, 200 * 512 + 7):
        text = "".join(rng.choice(list("abcé "), n))
        data = text.encode()
        whole = lambda t: np.concatenate(list(quality_mil.passages(t, s)))
        counts = whole(text)
        assert counts.shape == (max(1, -(-len(data) // s.passage)), s.buckets)
        assert counts.sum() == sum(max(0, len(data) - k + 1) for k in (1, 2, 3))
        if len(data) > s.passage:
            later = whole(data[s.passage :].decode(errors="ignore"))
            assert np.array_equal(later, counts[1:]) or data[s.passage] & 0xC0 == 0x80
    assert whole("a" * 512).max() == 512


def test_quality_arithmetic():
    """The forward pass against loops over passages, the gradients against differences of the loss, and no passage left out."""
    s, rng = quality_mil.QualitySettings(buckets=16, width=5, gate=3), np.random.default_rng(8)
    sizes = [3, 1, 40]
    p = {k: rng.normal(0, 0.7, v) for k, v in {"Wx": (18, 5), "bx": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "b": ()}.items()}
    x, y, starts = rng.normal(0, 1, (sum(sizes), 18)), np.array([1.0, 0.0, 1.0]), np.array([0, 3, 4])

    def logits(p):
        out = []
        for a, n in zip(starts, sizes, strict=True):
            hs = [np.tanh(p["bx"] + sum(x[k, i] * p["Wx"][i] for i in range(18))) for k in range(a, a + n)]
            e = np.exp([sum(p["w"][j] * np.tanh(h @ p["V"][:, j]) / (1 + np.exp(-h @ p["U"][:, j])) for j in range(3)) for h in hs])
            out.append(sum(w * h for w, h in zip(e / e.sum(), hs, strict=True)) @ p["c"] + p["b"])
        return np.array(out)

    model = quality_mil.QualityModel(p)
    assert np.allclose(model.forward(model.encode(x), starts)["logit"], logits(p))
    loss = lambda p: np.mean(np.logaddexp(0, logits(p)) - y * logits(p))
    for name, d in model.gradients(x, starts, y).items():
        for at in list(np.ndindex(p[name].shape))[:12]:
            up, down = ({k: np.array(v, dtype=float) for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert np.isclose((loss(up) - loss(down)) / 2e-5, np.asarray(d)[at], atol=1e-7), name
    text = "a" * 512 * 100 + "b" * 512
    assert len(np.concatenate(list(quality_mil.passages(text, s)))) == 101


def test_quality_of_texts_in_parts(spark, odd):
    """A text of many parts among short ones gets the score that it gets alone."""
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = quality_mil.fit(odd, labels, F.lit(True), quality_mil.QualitySettings(epochs=2))
    together = sorted((str(r.doc_id), str(r.text), r.score) for r in quality_mil.quality_score(odd.coalesce(1), model).collect())
    apart = sorted((str(r.doc_id), str(r.text), r.score) for k in range(len(ODD)) for r in quality_mil.quality_score(spark.createDataFrame([(*ODD[k], 99)], odd.schema), model).collect())
    assert [r[:2] for r in together] == [r[:2] for r in apart] and np.allclose([r[2] for r in together], [r[2] for r in apart], atol=1e-6)

def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in Q.op7_language_id(spark, "/root/testdata/sf0.01").collect()}
    held = [(rows[r.doc_id].lang_pred, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if rows[r.doc_id].held_out and len(r.text) > 60]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_language_odd_rows(spark, odd, none):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and dog", "en"), ("der hund und die katze", "de")] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit(train, F.lit(True))
    rows = language_id.language_id(odd, model).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 7)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert language_id.language_id(none, model).count() == 0
    assert language_id.language_id(train, model).filter("lang_pred = lang").count() == 10
    wide = spark.createDataFrame([(1, None, "s", 2, 3)], "doc_id long, text string, lang_pred string, score int, _language int")
    assert language_id.language_id(wide, model).columns == ["doc_id", "text", "_language", "lang_pred", "score", "ambiguous"]
    for rows, learn in ((train.limit(0), F.lit(True)), (train, F.lit(False)), (train.withColumn("lang", F.lit(None).cast("string")), F.lit(True))):
        assert {(r.lang_pred, r.score) for r in language_id.language_id(train, language_id.fit(rows, learn)).collect()} == {("und", 0.0)}
    code = language_id.codewords(9, 1)
    assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= 8


def test_language_arithmetic():
    """Decoding against loops over codewords and bits."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        code = language_id.codewords(n, 1)
        model = language_id.LanguageModel([f"l{k}" for k in range(n)], code, rng.normal(0, 1, (12, code.shape[1])), rng.normal(0, 1, code.shape[1]))
        x = rng.normal(0, 1, (7, 12))
        for row, got in zip(x, model.decode(x), strict=True):
            margins = row @ model.weights + model.bias
            e = [np.exp(-sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, word, strict=True))) for word in code]
            assert np.allclose(got, np.array(e) / sum(e))


def test_every_language_is_learned(spark):
    """1,500 labels, most of them of one row, beside one that holds a third of all."""
    rows = [(i, f"common words of the large language number {i % 7}", "big") for i in range(900)] + [(1000 + i, f"wort{i} " * 5, f"l{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = language_id.LanguageSettings(sample=300, epochs=1, buckets=256)
    model = language_id.fit(df, F.lit(True), s)
    assert len(model.languages) == 1501 and len({tuple(c) for c in model.code}) == 1501
    assert language_id.language_id(df.limit(5), model, s).count() == 5


def _top(rows, k):
    valid = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    asked = {}
    for i, v in valid:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for i, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in valid if j != i)[:k]
        want += [(i, n + 1, j, -score) for n, (score, j) in enumerate(best)]
    return sorted(want)


def test_cells_are_coarser_than_values(spark):
    """In the registered query's settings bounds differ from scores, hold them, and leave a small share of the vectors to be read."""
    s = vector_search.SearchSettings()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", vector_search.whole_steps("embedding").alias("v")).collect()
    v, ids = np.array([r.v for r in rows]), np.array([r.vec_id for r in rows])
    low, size, width, cells = vector_search.quantised(v, s.bits)
    assert size.min() >= 2 and (width <= s.bits).all()
    blob = vector_search.packed(cells, width)
    assert np.array_equal(vector_search.unpacked(blob, width, len(v)), cells) and len(blob) < 0.75 * v.size
    asked = ids % 20 == 0
    scan = vector_search.Scan(ids[asked], v[asked], s.k)
    lower, upper = scan.bounds(low, size, cells)
    exact = v[asked] @ v.T
    assert (lower <= exact).all() and (exact <= upper).all() and (lower < upper).mean() > 0.99 and (lower != exact).mean() > 0.9
    scan.block(np.stack([ids, ids, ids]), low, size, cells)
    share = len(scan.rest()[0]) / exact.size
    assert s.k / len(v) < share < 0.15


@pytest.mark.parametrize(("bits", "query_block", "part"), [(8, 512, 1 << 18), (3, 4, 60), (1, 2, 1000)])
def test_vector_search(spark, bits, query_block, part):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 3, 8)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (7, rows[7][1]), (7, rows[8][1]), (None, rows[1][1]), (20, rows[5][1]), (20, rows[5][1])]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # copies
    rows += [(500, []), (501, []), (502, [1.0, -2.0]), (520, [2.0] * 11)]  # of other lengths
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    small = vector_search.SearchSettings(k=5, bits=bits, query_block=query_block, part=part)
    assert sorted(tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 20 == 0, small).collect()) == _top(rows, 5)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vector_search.top_k(df.filter("vec_id = 500"), F.col("vec_id") % 20 == 0).count() == 0


def test_vector_search_reads_few_exact_vectors():
    """Cells alone leave about k vectors of a query, and bounds hold beyond what doubles can tell apart."""
    rng = np.random.default_rng(6)
    for scale, bits in ((20, 8), (1 << 40, 8), (20, 4)):
        v = (rng.normal(0, 1, (2000, 64)) * scale).astype(np.int64)
        low = v.min(axis=0)
        size = np.maximum(-(-(v.max(axis=0) - low + 1) // (1 << bits)), 1)
        keys = np.stack([np.arange(2000)] * 3)
        scan = vector_search.Scan(np.array([0, 20]), v[[0, 20]], 20)
        for at in range(0, 2000, 500):
            scan.block(keys[:, at : at + 500], low, size, ((v[at : at + 500] - low) // size).astype(np.uint8))
        query, found, *_ = scan.rest()
        for q in (0, 20):
            scores = [(-sum(map(lambda a, b: int(a) * int(b), v[q], w)), i) for i, w in enumerate(v) if i != q]
            left = set(found[query == q].tolist())
            assert {i for _, i in sorted(scores)[:20]} <= left and q not in left
            assert bits == 4 or len(left) < 60


def _components(rows, k, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    first = {}
    for g, (i, _) in zip(group, rows, strict=True):
        first[g] = i if first.get(g) is None else first[g] if i is None else min(i, first[g])
    return sorted(str((i, len(s), first[g])) for g, s, (i, _) in zip(group, sets, rows, strict=True))


def _near_copies():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], list(rng.choice(words, 60))
    for i in range(60):
        text = list(base if i % 3 else rng.choice(words, 60))
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(0, 60))] = str(rng.choice(words))
        rows.append((i, " ".join(text[: 60 - i % 4])))
    return [*rows, (100, rows[1][1]), (100, rows[1][1]), (101, None), (102, ""), (103, "Two words"), (104, "two WORDS"), (None, rows[4][1]), (105, " \n ")]


@pytest.mark.parametrize(("k", "percent", "least"), [(4, 85, 16), (5, 70, 3), (2, 60, 3)])
def test_ngram_join(spark, k, percent, least):
    rows = _near_copies()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_shingles int")
    s = ngram_join.JaccardSettings(shingle=k, percent=percent, few=least, block=8)
    assert sorted(str(tuple(r)) for r in ngram_join.jaccard_components(df, s).collect()) == _components(rows, k, percent)
    assert ngram_join.jaccard_components(df.limit(0), s).count() == 0


def test_frequent_shingles_are_found_across_batches(spark):
    """A shingle of few texts in each of many partitions is counted over all of them."""
    words = [f"w{k}" for k in range(2000)]
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["a", "b", "c", "d", *rng.choice(words, 3)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    s = ngram_join.JaccardSettings(percent=10)
    common = ngram_join.shingle_set("a b c d", s, ngram_join.Powers())
    hot = ngram_join.hot_keys(docs, s)
    assert common[0] in hot and len(hot) < 10 and len(ngram_join.hot_keys(docs.limit(0), s)) == 0


def test_one_hot_shingle(spark):
    """Texts that share one passage and little else, and a hub of copies, in small blocks."""
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"v{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(2, 40))))) for i in range(80)]
    hub = [f"h{i}" for i in range(60)]
    rows += [(1000 + i, " ".join([*hub[: 59 - i % 3], f"x{i}"])) for i in range(60)]
    for k in range(12):  # groups around the limit of a small tile
        rows += [(2000 + 100 * k + i, " ".join([*(f"g{k}_{j}" for j in range(40 + i % 2)), *(f"y{k}_{i}_{j}" for j in range(i % 4))])) for i in range(11 + k)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for s in (ngram_join.JaccardSettings(few=3, block=7, salts=3, broadcast=0), ngram_join.JaccardSettings(hot=0, block=16), ngram_join.JaccardSettings(hot=0, few=50)):
        assert sorted(str(tuple(r)) for r in ngram_join.jaccard_components(df, s).collect()) == _components(rows, 4, 85)


def test_bitmap_bound_never_drops_a_link():
    s, rng = ngram_join.JaccardSettings(), np.random.default_rng(1)
    for n in (1, 5, 40, 200, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.93)], rng.integers(0, 2**63, n // 12).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            ma, mb = (np.frombuffer(ngram_join.bitmap(x, s), dtype=np.uint8)[None] for x in (a, b))
            assert ngram_join.may_link(ma, mb, len(a), len(b), 85).all()


def _deduped(rows):
    kept, out, sets = collections.defaultdict(list), {}, []
    places = sorted({(-(1 << 63) if i is None else i, p, line) for i, t in rows if t is not None for p, line in enumerate(t.split("\n"))})
    for i, p, line in places:
        w = frozenset(x for x in re.split(r"[\x20\x09\x0B-\x0D]+", line.lower()) if x)
        if w and any(10 * len(w & v) >= 8 * len(w | v) for v, q in sets if q < (i, p)):
            pass
        else:
            kept[i].append(line)
        if w:
            sets.append((w, (i, p)))
    for i, t in rows:
        out[i] = None if t is None else "\n".join(kept[-(1 << 63) if i is None else i])
    return out


def test_line_dedup(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 14, 12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            w = base[int(rng.integers(0, 12))].split()
            if rng.random() < 0.5:
                w[int(rng.integers(0, len(w)))] = str(rng.choice(words)).upper()
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n  \n"), (None, rows[3][1]), (53, "  lead  gap\t" + "x " * 9), (54, "Lead gap x")]
    rows += [rows[5]]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, n_lines int, gone int, _d int, _line_t int")
    want = _deduped(rows)
    forms = (line_dedup.LineSettings(), line_dedup.LineSettings(few=1, cold=0, block=3), line_dedup.LineSettings(few=1, buckets_log2=3, broadcast=0), line_dedup.LineSettings(few=2, cold=6, block=8))
    for s in forms:
        got = line_dedup.line_dedup(df, s).collect()
        assert len(got) == len(rows) and {r.doc_id: r.text for r in got} == want
        assert {(r.gone, r._d, r._line_t) for r in got} == {(2, 3, 4)}
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def _measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def _rejecting(text, rules=quality_rules.RepetitionRules()):
    """The first rule that fails, word by word."""
    n_words, chars, _, dup, repeat = _measure(text)
    if n_words < rules.min_words:
        return "words"
    if 100 * repeat > rules.max_repeat_percent * n_words:
        return "repeat_words"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if dup / len(lines) > rules.max_lines:
        return "lines"
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    if sum(len(w) for x in again for w in re.findall(r"[^\x20\x09-\x0D]+", x)) / chars > rules.max_line_chars:
        return "line_chars"
    grams = lambda k: [tuple(words[i : i + k]) for i in range(n_words - k + 1)]
    for k, most in rules.max_top:
        counts = collections.Counter(grams(k))
        top = max(counts.values())
        if top > 1 and top * max(sum(map(len, g)) for g, c in counts.items() if c == top) / chars > most:
            return f"top_{k}"
    for k, most in rules.max_coverage:
        seen, inside = set(), set()
        for i, g in enumerate(grams(k)):
            inside |= set(range(i, i + k)) if g in seen else set()
            seen.add(g)
        if sum(len(words[i]) for i in inside) / chars > most:
            return f"coverage_{k}"
    return None


def test_quality_rules(spark, odd, none, docs):
    wide = odd.unionByName(spark.createDataFrame([(8, "a b c\nd\na b c\n# é\nd", "s", 1, 1)], odd.schema)).withColumns({"kept": F.lit("x"), "_measures": F.lit(1)})
    for df in (wide, docs):
        for r in quality_rules.quality_rules(df).collect():
            want = _measure(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert (r.failed_rule, r.kept) == (_rejecting(r.text), r.failed_rule is None)
    assert quality_rules.quality_rules(wide).columns == ["doc_id", "text", "source", "n_tokens", "score", "_measures", *quality_rules.quality_rules(none).columns[5:]]
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_rules_coverage():
    """Each rule decides alone, on texts that the base rule keeps; a text without repeats stays."""
    rules, words = quality_rules.RepetitionRules(), [f"w{i}" for i in range(300)]
    line = " ".join(words[:20])
    texts = {
        None: " ".join(words),
        "lines": "\n".join(["a b", " ".join(words), "a b", "a b"]),
        "line_chars": "\n".join([line, *(" ".join(words[20 * k : 20 * k + 20]) for k in range(1, 3)), line]),
        "top_2": " ".join(f"{'x' * 30} {'y' * 30} {w}" if k % 5 == 0 else w for k, w in enumerate(words[:80])),
        "coverage_5": " ".join(words + [w for k in range(16) for w in [*words[9 * k : 9 * k + 5], f"v{k}"]]),
        "coverage_10": " ".join(words + words[100:132]),
    }
    for rule, text in texts.items():
        assert _rejecting(text) == rule == quality_rules.verdict(quality_rules.measure(text, rules), rules)[1], rule
    share = quality_rules.measure(" ".join(words[:100] + words[:60]), rules).coverage
    later = sum(map(len, words[:60])) / sum(map(len, words[:100] + words[:60]))
    assert all(v == pytest.approx(later) for v in share.values())


def test_secret_scan(spark, odd, none):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    noise = "Zq8$Lm2!vX0p".replace("$", "R").replace("!", "s") + "9KtWbY4cNfJ7hD3e"
    text = f'é token = "deadbeef01" then {key} and 0123456789abcdef01234567 but PASSWORD:abc or Secret=abcdef\nauth key is {noise} ok'
    odd = odd.withColumns({"_scan": F.lit(1), "spans": F.lit(2)})
    none = odd.limit(0)
    df = odd.unionByName(spark.createDataFrame([(8, text, "s", 1, 1, 1, 2), (9, "the key is internationalization_of_things and more", "s", 1, 1, 1, 2)], odd.schema))
    rows = {r.doc_id: r for r in secret_scan.secret_scan(df).collect()}
    r = rows[8]
    assert (r.n_assign, r.n_access, r.n_hex) == (2, 1, 1)
    spans = [s.split(":") for s in r.spans.split(",")]
    assert [s[0] for s in spans] == ["assign", "access", "hex", "assign", "novel"]
    assert text[int(spans[0][1]) : int(spans[0][2])] == 'token = "deadbeef01' and text[int(spans[-1][1]) : int(spans[-1][2])] == noise
    assert set(r.base_spans.split(",")) <= set(r.spans.split(","))
    assert all(rows[k].spans == "" for k in (1, 2, 3, 9)) and secret_scan.secret_scan(none).count() == 0


def _base(text):
    found = []
    for kind, pattern, least, group, flags in (("assign", secret_scan.ASSIGN, 6, 2, re.IGNORECASE | re.ASCII), ("access", secret_scan.ACCESS, 20, 0, 0), ("hex", secret_scan.HEX, 24, 0, 0)):
        found += [(m.start(), k, m.end(), kind) for k, m in zip(itertools.repeat(("assign", "access", "hex").index(kind)), re.finditer(pattern, text, flags), strict=False) if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_of_documents(spark, odd):
    """The base spans by plain patterns; the method weighs each of them and keeps them."""
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd):
        weighed = 0
        for r in secret_scan.secret_scan(df).collect():
            assert r.base_spans == _base(r.text or "") and set(r.base_spans.split(",")) <= set(r.spans.split(","))
            assert len(r.novelty) == len([x for x in r.spans.split(",") if x])
            weighed += len(r.novelty)
        assert weighed or df is odd


def test_secret_scan_on_planted_secrets(spark, docs):
    """Secrets of many forms, and harmless values of the same forms, planted in the given documents."""
    rng = np.random.default_rng(8)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    marks = np.array([*letters, *"!@#%&*?^"])
    draw = lambda n, a=letters: "".join(rng.choice(a, n))
    forms = [
        ("signing_key = '{}'", lambda: draw(32)), ("auth: {}", lambda: draw(24)), ("db_password: \"{}\"", lambda: draw(18, marks)), ("deploy_handle = \"{}\"", lambda: draw(32)),
        ("the session cookie is {}", lambda: draw(28)), ("webhook={}", lambda: draw(40)), ("bearer {}", lambda: draw(36)), ("private key -> {}", lambda: draw(44)),
    ]
    names = ["internationalization", "user_account_settings_table", "handleAuthenticationRequest", "DEFAULT_CONNECTION_TIMEOUT_MS", "application_configuration", "requestValidationMiddleware", "/usr/local/share/tables_data", "max_retry_attempts_per_host"]
    texts = [t.text for t in docs.select("text").collect() if t.text and len(t.text) < 5000 and _base(t.text) == ""]
    rows, secret = [], {}
    for k in range(400):
        form, make = forms[k % len(forms)]
        value = make() if k % 2 else str(rng.choice(names))
        text = texts[k % len(texts)]
        cut = len(text) // 2
        rows.append((k, f"{text[:cut]}\n{form.format(value)}\n{text[cut:]}"))
        secret[k] = (cut + 1, value, k % 2)
    hit = wrong = 0
    for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        at, value, real = secret[r.doc_id]
        spans = [(kind, r.text[int(a) : int(b)]) for kind, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        hit += bool(real and any(value in x or (len(x) > 10 and x in value) for _, x in spans))
        wrong += sum(kind == "novel" and not (real and value in x) for kind, x in spans)  # the base patterns are not the method's
    assert hit >= 0.95 * 200 and wrong <= 0.05 * 200, (hit, wrong)


def test_secret_scan_by_novelty():
    """Values of few digits, values behind refused candidates, and other separators; ordinary names stay out."""
    novelty, rules = secret_scan.Novelty(), secret_scan.NoveltyRules()
    found = lambda t: [t[a:b] for a, _, b, _ in secret_scan.novel_spans(t, secret_scan.base_spans(t), novelty, rules)]
    value, few = "Zx81kQ0pLm47RtYw93BnVc62", "qWzKvTbXnGdRjLmP"
    for form in (
        "# session key\nproduction_signing_key = '{}'", "signing_key       =       '{}'", "signing_key := `{}`", "signing_key = b'{}'", "signing_key: bytes = b'{}'",
        "signing_key: Optional[str] = '{}'", "('signing_key', '{}')", "<signing_key>{}</signing_key>", "signing_key -> {}", "auth signing_key={}",
        "signing_key_of_the_whole_production_environment = '{}'", "login(\"{}\")", "session key=production_signing_key={}",
    ):
        for v in (value, few):
            assert [x[-len(v) :] for x in found(form.format(v))] == [v], form
    draw = np.random.default_rng(1)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    drawn = ["".join(draw.choice(alphabet, 16)) for _ in range(500)]
    assert sum(found(f'encryption_key = "{v}"') == [v] for v in drawn) >= 490
    assert [found(f) for f in ("auth = kjHg7_2", "login cookie: 8f2k9d0s1a")] == [["kjHg7_2"], ["8f2k9d0s1a"]]
    for name in ("internationalization_of_things", "handleAuthenticationRequest", "DEFAULT_CONNECTION_TIMEOUT", "base64_encoded_values", "/usr/local/share/tables"):
        assert found(f"the key is {name} and more") == []
    import time

    start = time.monotonic()
    for unit in ("key=", "key ", "key: ", "secretkey", "key " + " " * 1000, "key: a" + " b" * 1000):
        found(unit * (400_000 // len(unit)))
    assert time.monotonic() - start < 30


def test_secret_scan_weighs_every_form_of_value(docs):
    """Random values of ten characters or more are found whatever their letters, and ordinary words of the same lengths are not."""
    import pydoc_data.topics
    import string

    novelty, rules, rng = secret_scan.Novelty(), secret_scan.NoveltyRules(), np.random.default_rng(3)
    texts = [t.text for t in docs.select("text").collect() if t.text and len(t.text) < 5000 and _base(t.text) == ""]

    def reported(form, value):
        text = str(rng.choice(texts))
        cut = int(rng.integers(len(text) + 1))
        text = f"{text[:cut]}\n{form.format(value)}\n{text[cut:]}"
        spans = [text[a:b] for a, _, b, _ in secret_scan.novel_spans(text, secret_scan.base_spans(text), novelty, rules)]
        assert spans in ([], [value])
        return bool(spans)

    forms = ("signing_key = {}", 'auth = "{}"', "login cookie: {}")
    alphabets = (string.ascii_lowercase, string.ascii_uppercase, string.ascii_uppercase + string.digits, string.ascii_letters, string.ascii_letters + string.digits)
    for alphabet in alphabets:
        values = ["".join(rng.choice(list(alphabet), int(rng.integers(10, 17)))) for _ in range(300)]
        assert sum(reported(forms[k % 3], v) for k, v in enumerate(values)) >= 0.95 * 300, alphabet
    words = sorted({w for topic in pydoc_data.topics.topics.values() for w in re.findall(r"\b[a-z]{8,}\b", topic)})
    assert sum(reported(forms[k % 3], w) for k, w in enumerate(words)) <= 0.03 * len(words)
    assert sum(reported("handler = {}", w) for w in ("_".join(map(str, rng.choice(words, 3))) for _ in range(200))) <= 0.03 * 200


def test_pipeline_stages(spark, library):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start, out = docs, {}
    for name, stage in P.STAGES:
        out[name] = docs = stage(spark, docs, DATA).cache()
        if name != "bpe":
            assert docs.columns == start.columns
    kept = {r.doc_id for r in quality_rules.quality_rules(start).filter("kept").collect()}
    assert {r.doc_id for r in out["quality_rules"].collect()} == kept
    rows = [(r.doc_id, r.text) for r in out["quality_rules"].collect()]
    want = {i: t for i, t in _deduped(rows).items() if re.search(r"[^\x20\x09-\x0D]", t)}
    lines = out["line_dedup"].collect()
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)
    groups = [eval(x) for x in _components(sorted(want.items()), 5, 80)]  # noqa: S307
    assert sorted(r.doc_id for r in out["near_duplicates"].collect()) == sorted(i for i, _, g in groups if i == g)
    copies = {r.doc_id: r.copies for r in mixing.mix(out["near_duplicates"]).collect()}
    got = collections.Counter(r.doc_id for r in out["mixing"].collect())
    assert got == collections.Counter({k: v for k, v in copies.items() if v})
    texts = {r.doc_id: r.text for r in out["near_duplicates"].collect()}
    want = sorted((i, hashlib.sha256(library.decode(_ids(library, texts[i]), skip_special_tokens=False).encode()).hexdigest()) for i, n in got.items() for _ in range(n))
    for rows in (out["bpe"], P.run(spark, DATA)):
        rows = rows.collect()
        assert sorted((r.doc_id, r.decoded_sha256) for r in rows) == want
        assert all(list(r.ids) == _ids(library, texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_pipeline_odd_rows(spark):
    """Nulls in any column, empty and repeated rows, no rows, and columns named like those of the operators."""
    import corpus_pipeline as P

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (None, words + " x", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "b", 0), (None, None, None, None, None), (4, " \n ", "en", "b", 3), (5, " ".join(f"v{i}" for i in range(50_000)), "de", "b", 9)]
    names = ["gone", "n_words", "kept", "coverage", "_id", "_group", "_n", "_row", "_copies", "t", "stays", "c0"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names))
    want = tuple(range(len(names)))
    for name, stage in P.STAGES:
        assert stage(spark, df.limit(0), DATA).count() == 0
        got = stage(spark, df, DATA)
        if name != "bpe":
            assert got.schema.names == df.schema.names and {r[5:] for r in got.collect()} <= {want}
        count = {"quality_rules": 4, "line_dedup": 6, "near_duplicates": 6, "bpe": 8}.get(name)
        assert count is None or got.count() == count, name


def test_rows_without_or_with_repeated_ids(spark):
    """Rows that share an id are documents of their own: none loses what no other row holds."""
    import corpus_pipeline as P

    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    lines = [(1, words[0]), (None, "\n".join([words[1], words[2], words[0]])), (None, "\n".join(words[3:6])), (2, f"{words[6]}\n{words[0]}"), (2, f"{words[1]} x\n{words[7]}")]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    left = [line for r in line_dedup.line_dedup(df).collect() for line in r.text.split("\n") if line]
    assert {*words[2:]} <= {*left} and len(left) == 8  # one of each, the two near copies of words[1] count as one

    near = lambda k: words[k] + " more"
    rows = [(None, words[0]), (None, near(0)), (None, words[1]), (None, words[2]), (7, near(2)), (8, words[3]), (8, words[4]), (9, near(4)), (None, None), (None, " "), (None, words[5]), (None, words[5])]
    df = spark.createDataFrame([(*r, "s", "l") for r in rows], "doc_id long, text string, source string, lang string")
    got = ngram_join.jaccard_components(df).collect()
    assert sorted(str(tuple(r)) for r in got) == _components(rows, 4, 85)
    stay = [(r.doc_id, r.text) for r in P.near_duplicate_stage(spark, df, DATA).collect()]
    assert len([x for x in stay if x in rows[:2]]) == 1 and len(stay) == 8
    assert {(None, words[1]), (7, near(2)), (8, words[3]), (8, words[4]), (None, words[5]), (None, None), (None, " ")} <= {*stay}


def test_lines_of_a_frequent_word_meet_by_size(spark):
    """Rows of one frequent word: with lines of many sizes each meets the blocks of its band and the next ones, not all; every pair whose sizes fit shares a tile, once."""
    s = line_dedup.LineSettings(block=4)
    sizes = [5 * 2 ** (k % 6) + k % 3 for k in range(240)] + [4, 5] * 3
    rows = [(k, 0, 0, n, k * 7919, [1], 0, 0, 0, 0) for k, n in enumerate(sizes)]
    lines = spark.createDataFrame(rows, "id long, t long, pos int, n int, sid long, keys array<int>, skip int, cold int, m0 long, m1 long")
    keys = line_dedup.dealt_keys(lines, s)[0].collect()
    tiles = collections.defaultdict(list)
    for r in keys:
        tiles[r.p, r.q].append(r)
    met = collections.Counter((a.id, b.id) for (p, q), held in tiles.items() for a in held for b in held if a.id < b.id and (p == q or a.mine != b.mine))
    fit = {(a, b) for a in range(len(sizes)) for b in range(a + 1, len(sizes)) if 10 * min(sizes[a], sizes[b]) >= 8 * max(sizes[a], sizes[b])}
    assert fit <= met.keys() and set(met.values()) == {1}
    assert len(keys) < len(sizes) * len(sizes) / s.block / 2


def test_linked_lines_share_a_token_of_their_prefixes(spark):
    """Sets at and above the threshold share a pair of neighbouring words among the first ones of both; words and tokens are made without Python on the executors."""
    rng = np.random.default_rng(5)
    rows, sets = [], {}
    for k in range(400):
        n = int(rng.integers(4, 60))
        x = [f"{'w' * int(rng.integers(1, 9))}{j}" for j in rng.permutation(400)[:n]]
        out = int(rng.integers(0, n // 5 + 1))
        y = x[out:] + [f"new{j}" for j in range(int(rng.integers(0, n // 5 + 1)))]
        for i, w in ((2 * k, x), (2 * k + 1, y)):
            sets[i] = {*w}
            rows.append((i, 0, " ".join(rng.permutation(w))))
    df = spark.createDataFrame(rows, "id long, t long, text string")
    s = line_dedup.LineSettings()
    sid = {r.id: r.sid for r in line_dedup.lines_of(df).collect()}
    tokens = collections.defaultdict(set)
    for r in line_dedup.tokens_of(df, s).collect():
        tokens[r.sid].add(r.key)
    linked = [k for k in range(400) if sets[2 * k] != sets[2 * k + 1] and 10 * len(sets[2 * k] & sets[2 * k + 1]) >= 8 * len(sets[2 * k] | sets[2 * k + 1])]
    assert len(linked) > 100 and all(tokens[sid[2 * k]] & tokens[sid[2 * k + 1]] for k in linked)
    plan = line_dedup.tokens_of(df, s)._jdf.queryExecution().executedPlan().toString() + line_dedup.lines_of(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    with pytest.raises(ValueError):
        line_dedup.LineSettings(tenths=5)
