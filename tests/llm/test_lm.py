import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from harvestry.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(i, t, "x") for i, t in enumerate(["the cat sat", "the cat ran", "A dog  sat\n", "", None, "the the the", "the cat sat", "ünï the\tcat", "dog", "cat " * 50, "new words here", "the dog sat on"])]


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), None]


def brute(rows, order, discount=0.75):
    """Scores by plain dictionaries, without quantising."""
    counts = [Counter() for _ in range(order + 1)]
    for _, text, *_ in rows:
        t = [None, *tokens(text)]
        for k in range(1, order + 1):
            for i in range(1, len(t)):
                if i - k + 1 >= 0:
                    counts[k][tuple(t[i - k + 1 : i + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    followers = [defaultdict(int) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for gram in counts[k]:
            followers[k][gram[:-1]] += 1

    def p(gram):
        if len(gram) == 1:
            return (counts[1][gram] + 0.1) / (n + 0.1 * (v + 1))
        rest = p(gram[1:])
        c = counts[len(gram) - 1][gram[:-1]]
        f = followers[len(gram)][gram[:-1]]
        if not c or not f:
            return rest
        return max(counts[len(gram)][gram] - discount, 0) / c + discount * f / c * rest

    def score(text):
        t = [None, *tokens(text)]
        return sum(math.log10(p(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t)))

    base = lambda text: sum(math.log10((counts[1][(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(text))
    return n, score, base, counts[1]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_plain_dictionaries(spark, order):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    train = [r for r in ROWS if zlib.crc32(str(r[0]).encode()) % 10]
    n, score, base, counts = brute(train, order)
    got = {r.doc_id: r for r in lm.score_held_out(docs, order).collect()}
    assert len(got) == len(ROWS)
    for i, text, _ in ROWS:
        r = got[i]
        t = tokens(text)
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(t), sum(counts[(w,)] > 0 for w in t))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base(text))
        assert r.score == pytest.approx(score(text), abs=0.02 * len(t))


def test_probabilities_of_a_context_add_up_to_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    at, model = lm.train_model(docs)
    vocabulary = sorted({w for _, t, _ in ROWS for w in tokens(t) if w})
    two = lambda words: spark.createDataFrame([(i, f"cat {w}") for i, w in enumerate(words)], "doc_id long, text string")
    one = spark.createDataFrame([(0, "cat")], "doc_id long, text string")
    # p(cat, w, end) / p(end | w) needs the end's share: compare the sums of two texts that differ by one more word
    assert model.words == len(vocabulary) + 1
    assert lm.score_texts(two([*vocabulary, "unseen"]), at, model).count() == len(vocabulary) + 1
    assert lm.score_texts(one, at, model).collect()[0].score < 0


def test_empty_table_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_held_out(empty).collect() == []
    rows = lm.score_held_out(spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3]
    assert {r.held_out for r in rows} == {False}
