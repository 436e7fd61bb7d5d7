"""Filter audit, decontamination and Merkle manifest against plain versions, with the odd cases of each."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from smokelake.llm import decontamination, filter_audit, merkle

ODD = [
    (1, "The same Text " * 40, "en", "a"), (2, "The same Text " * 40, "en", "b"), (2, "The same Text " * 40, None, None), (None, "The same Text " * 40, "en", None),
    (3, None, "en", "a"), (4, "", "de", "a"), (5, None, "", "b"), (None, None, None, None), (None, "ABC | DEF", "fr", "é"), (6, " ".join(f"w{i}" for i in range(60_000)), "fr", "é"),
    (7, "SHOUT " * 200, "en", "z"), (8, " \n\t ", "en", "z"), (8, " \n\t ", "en", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, n int, digest string, items int, alive int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long rows, and columns named like those of the operators."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "p", "k", 1, "d", 2, 3) for r in ODD], SCHEMA)


# filter audit


def _fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {f for f, bad in zip("ABCD", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text or "")) > 10 * len(text or ""), bool(re.search(r"[#$%&*|]", text or ""))), strict=True) if bad}


def _audit(rows, good, toxic):
    """The five filters applied one after the other, in every order."""
    docs = []
    for i, text, lang in rows:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        docs.append((lang or "", _fails(text) | ({"E"} if copy else set()), i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        some = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                some.append((part, order, step, len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in some]
    return sorted(out)


def test_audit_against_filters_one_by_one(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0, 5), (1, 0, 1, 5), (3, None, 1, 5), (None, 1, 1, 5), (7, 1, None, 5), (99, 1, 1, 5)], "doc_id long, quality int, toxic int, part int")
    want = _audit([r[:3] for r in ODD], {1, 7}, {1, 3})
    assert sorted(map(tuple, filter_audit.filter_audit(odd, labels).collect())) == want
    nobody = sorted(map(tuple, filter_audit.filter_audit(odd, labels.limit(0)).collect()))
    assert nobody == [(*r[:7], 0, 0, r[9]) for r in want]
    assert filter_audit.filter_audit(odd.limit(0), labels).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(1, 1000)), max_size=60))
def test_positional_counts(rows):
    words, times = np.array([w for w, _ in rows], dtype=np.uint32), np.array([n for _, n in rows], dtype=np.int64)
    assert filter_audit.positional_counts(words, times).tolist() == [sum(n for w, n in rows if w >> b & 1) for b in range(32)]


def test_hot_texts_meet_as_counts(spark):
    """A third of all rows in one group of copies leaves one row for its first document and one for the others."""
    rows = [(i, "copy", "en") for i in range(500)] + [(1000 + i, f"own {i}", "en") for i in range(1000)]
    words = filter_audit.survival_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(r.times for r in words.collect())[-2:] == [1, 499] and words.count() == 1002


# decontamination

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _leaks(text, items, window):
    words, hit, names = _WORDS.findall(_lower(text)), set(), set()
    for name, item in items:
        own = _WORDS.findall(_lower(item))
        k = min(window, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for p in range(len(words) - k + 1):
            if k and tuple(words[p : p + k]) in windows:
                hit |= set(range(p, p + k))
                names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names), hit


ITEMS = [
    (1, "What is the Capital of France, and of which Country is Lima the capital now? Say both."), (2, "short item"), (2, "another text of the same item"), (3, None), (4, "?!"), (None, "ünïcode Wörter; im TEXT"),
    (5, "a b " * 12), (6, "a b a b a b a b a b c"), (10, "of which country is lima the capital now say both and more"),
]
TEXTS = [
    None, "", "???", "nothing here", "A Short, ITEM!", "shorter item", "x short item y another text of the same item z", "ünïcode wörter im text", "Ünïcode wörter im text",
    "So: what is the capital of france and of which country is lima?", "what is the capital of france and of which", "what is the capital of france and of",
    "of which country is lima the capital now say both", "of which country is lima the capital now say both and more or less", "a b " * 30, "b a " * 30 + "c", "a b a b a c",
    ("word " * 20_000) + "of which country is lima the capital now say both" + " word" * 20_000, "a\x00b", "capital1 of",
]


@pytest.mark.parametrize("part_chars", [2_000_000, 60])
def test_leaks_against_all_windows(spark, part_chars):
    """One automaton, and many parts of items, tell the same."""
    rows = [(k, t, "x", 7) for k, t in enumerate(TEXTS + TEXTS[4:6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, extra int")
    for window in (10, 7, 1):
        got = decontamination.decontaminate(docs, items, decontamination.Decontamination(window, part_chars)).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, names, places = _leaks(r.text, ITEMS, window)
            assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (n, hit, names, hit > 0), (r.doc_id, window)
            assert {w for s in r.spans for w in range(s.first_word, s.end_word)} == places
            for s in r.spans:
                assert _WORDS.findall(_lower(r.text[s.begin : s.end])) == _WORDS.findall(_lower(r.text))[s.first_word : s.end_word]
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    assert not decontamination.decontaminate(docs, items.limit(0)).filter("contaminated OR n_hit > 0 OR size(items) > 0").count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=40), max_size=4), st.text("abc ", max_size=120), st.integers(1, 5))
def test_automaton(items, text, window):
    items = list(enumerate(items))
    n, runs, names = decontamination.Automaton([(str(k), t) for k, t in items], window).hits(text)
    want = _leaks(text, items, window)
    assert (n, {w for a, b in runs for w in range(a, b)}, names) == (want[0], want[3], want[2])


# Merkle manifest


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def _path(levels, k, fanout):
    for level in levels[:-1]:
        start = k // fanout * fanout
        yield level[start:k], level[k + 1 : start + fanout]
        k //= fanout


def _manifest(rows, fanout):
    """rows: doc_id, source, lang, n_chars, text."""
    def leaf(values):
        return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        low = r[:4] + (_lower(r[4]) if r[4] is not None else None,)
        altered = leaf(low) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), altered, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s])], fanout) for s in names}
    upper, out = _tree([trees[s][-1][0] for s in names], fanout), []
    for s in names:
        for k, (_, _, own, altered, i) in enumerate(sorted(groups[s])):
            proof, digest = "", altered
            for left, right in [*_path(trees[s], k, fanout), *_path(upper, names.index(s), fanout)]:
                proof += "".join(left + right)
                digest = _h("".join([*left, digest, *right]))
            out.append((i, own, trees[s][-1][0], upper[-1][0], _h(proof), digest, digest == upper[-1][0]))
    return sorted(map(str, out))


def _got(docs, fanout):
    rows = merkle.merkle_manifest(docs, merkle.MerkleSettings(fanout=fanout), altered=merkle.lowered(docs))
    return sorted(str(tuple(r)) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_against_plain_trees(spark, odd, fanout):
    """Trees of one leaf, of repeated leaves and of several levels, of sources and above them."""
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert _got(odd, fanout) == _manifest(rows, fanout)
    many = [(i, None if i % 40 == 0 else f"s{i % 37}" if i % 3 else "hot", None, i, f"Text {i}") for i in range(600 if fanout == 16 else 90)]
    docs = spark.createDataFrame(many, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert _got(docs, fanout) == _manifest(many, fanout)
    one = docs.filter("doc_id = 5")
    assert _got(one, fanout) == _manifest(many[5:6], fanout)
    assert merkle.merkle_manifest(odd.limit(0)).count() == 0


def test_manifest_tells_tampering(spark):
    """Only altered leaves fail, and their own leaf does not verify with another row's path."""
    docs = spark.createDataFrame([(i, "s", "l", 1, f"Text {i}") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.merkle_manifest(docs, altered=merkle.lowered(docs)).collect()
    assert {r.doc_id for r in rows if not r.verified} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len({r.proof_sha256 for r in rows}) == 100 and len({r.root for r in rows}) == 1
