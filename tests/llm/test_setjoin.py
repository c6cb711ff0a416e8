"""The set joins against brute force."""

import random
import re

import numpy as np
import pytest

from harvestry.llm import jaccard, lines, setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(x, y, least):
    return bool(x and y) and 100 * len(x & y) >= least * len(x | y)


def brute_components(rows, least=75):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i][1], sets[j][1], least):
                root[find(i)] = find(j)
    least_id = {}
    for i in range(len(rows)):
        ids = [x for x in (least_id.get(find(i)), sets[i][0]) if x is not None]
        least_id[find(i)] = min(ids) if ids else None
    return sorted(((sets[i][0], len(sets[i][1]), least_id[find(i)]) for i in range(len(rows))), key=str)


def corpus(seed, n, vocabulary=40, longest=60):
    """Documents of which many are edits of one another, with shared passages and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(vocabulary)]
    out = []
    passage = rng.choices(vocabulary, k=20)
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.6:
            w = words(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += rng.choices(vocabulary, k=rng.randint(1, 6))
        elif kind < 0.7:
            w = passage + rng.choices(vocabulary, k=rng.randint(0, 25))
        else:
            w = rng.choices(vocabulary, k=rng.randint(0, longest))
        sep = [rng.choice([" ", " ", "\n", "\t "]) for _ in w]
        out.append("".join(a + b for a, b in zip(w, sep, strict=True)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed, 300))) + [(300, None), (301, ""), (302, " \n"), (None, "w1 w2 w3"), (5, "w1 w2 w3")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, set_id string, key int")
    got = sorted(map(tuple, jaccard.link_documents(docs).collect()), key=str)
    assert got == brute_components(rows)


def test_every_boundary_and_split_keys_give_the_same(spark, monkeypatch):
    rows = list(enumerate(corpus(7, 200, longest=25)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    monkeypatch.setattr(setjoin, "HOT", 8)
    monkeypatch.setattr(setjoin, "BLOCK", 3)
    monkeypatch.setattr(setjoin, "DEALT", 50)
    for boundary in (0, 4, 32):
        monkeypatch.setattr(setjoin.Join, "_boundary", lambda self, b=boundary: b)
        assert sorted(map(tuple, jaccard.link_documents(docs).collect()), key=str) == want


def test_one_of_each_keeps_all_columns(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(4, text, "x"), (2, text + " b", "y"), (3, "other", "z"), (9, None, "n")], "doc_id long, text string, component_id string")
    assert sorted(jaccard.one_of_each(docs).collect()) == sorted([(2, text + " b", "y"), (3, "other", "z"), (9, None, "n")])


def brute_lines(rows, least):
    places = [((i is not None, i), k, set(words(line)), i, k) for i, t in rows for k, line in enumerate((t or "").split("\n") if t else [])]
    gone = {(i, t): set() for i, t in rows}
    at = 0
    for i, t in rows:
        for k, _ in enumerate((t or "").split("\n") if t else []):
            me = places[at]
            at += 1
            if any((o[0], o[1]) < (me[0], me[1]) and alike(o[2], me[2], least) for o in places):
                gone[(i, t)].add(k)
    return sorted(((i, len(t.split("\n")) if t else 0, len(gone[(i, t)]), ",".join(map(str, sorted(gone[(i, t)])))) for i, t in rows), key=str)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_removed_lines_are_those_of_all_pairs(spark, seed, monkeypatch):
    if seed == 4:
        monkeypatch.setattr(setjoin, "HOT", 8)
    if seed == 5:  # nearly all lists are kept
        monkeypatch.setattr(lines, "MET", 3)
        monkeypatch.setattr(lines, "CHOSEN", 1)
        monkeypatch.setattr(setjoin, "BLOCK", 3)
        monkeypatch.setattr(setjoin, "DEALT", 50)
    texts = corpus(seed, 120)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, "\n\n"), (None, "w1 w2\nw3"), (7, "the same id\nw1 w2"), (7, "the same id\nw1 w2")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row_id string")
    assert sorted(map(tuple, lines.removed_lines(docs).collect()), key=str) == brute_lines(rows, 80)


def test_dedup_lines_changes_texts_and_lengths(spark):
    rows = [(2, "one two three\nfour five\n\nsix", "k", 30), (1, "four five", "k", 9), (3, "six\nsix", "k", 7), (4, None, "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars, r.kept) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: ("four five", 9, "k"), 2: ("one two three\n\nsix", 18, "k"), 3: ("", 0, "k"), 4: (None, None, "k")}
    assert {r.doc_id for r in lines.dedup_lines(docs, drop_emptied=True).collect()} == {1, 2, 4}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_documents(docs).collect() == []
    assert lines.removed_lines(docs).collect() == []


def test_prefixes_hold_a_common_token():
    for n in range(1, 60):
        for m in range(n, 60):
            least_overlap = -(-75 * (n + m) // 175)
            if 100 * n >= 75 * m and least_overlap <= n:
                assert setjoin.prefix(n, 75) >= n - least_overlap + 1
                assert setjoin.prefix(m, 75) >= m - least_overlap + 1
    assert np.all([setjoin.prefix(n, 100) == 1 for n in range(1, 50)])
