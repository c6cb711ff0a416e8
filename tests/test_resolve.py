"""Names: marks of all code points, common letters by bits, and fuzzy matches against every pair."""

import dataclasses
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from harvestry.config import SETTINGS
from harvestry.functions import strings
from harvestry.operators import resolve as resolving
from harvestry.operators.resolve import resolve


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def common(a, b):
    line = [0] * (len(b) + 1)
    for c in a:
        before = line
        line = [0]
        for j, d in enumerate(b):
            line.append(before[j] + 1 if c == d else max(line[-1], before[j + 1]))
    return line[-1]


def ratio(a, b):
    x, y = (" ".join(sorted(t.split(" "))) for t in (a, b))
    return 200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0


def test_marks_of_all_code_points(spark):
    """A text of 64 code points each, so that signs that become several stand beside others; and each alone where they do."""
    signs = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(signs[i : i + 64]) for i in range(0, len(signs), 64)] + [None, "", "Lasalgaon", "é", "e\u0301\u0323", "ﬁn", "각"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8).select("i", strings.without_marks(F.col("t")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: t if t is None else plain(t) for i, t in enumerate(texts)}


def test_common_letters_by_bits_and_rows(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    pairs = [(word(rng.randrange(0, 75)), word(rng.randrange(0, 75))) for _ in range(60)] + [("", ""), ("a", ""), ("", "a"), ("a" * 61, "a" * 61), ("a" * 62, "a" * 62), ("a" * 3000, "b" + "a" * 60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", strings.longest_common(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(a, b, common(a, b)) for a, b in pairs]


@pytest.mark.parametrize("review", [90, 75, 60])
def test_fuzzy_matches_against_every_pair(spark, review):
    """Edited, swapped and short names, with and without a district, ties, repeats, a long name and candidates without a district."""
    rng = random.Random(review)
    syllables = ["lasal", "gaon", "pimpal", "nashik", "yeola", "man", "mad", "sin", "nar", "x", "ab"]
    pool = [(i, " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 3))) for _ in range(rng.randrange(1, 3))), rng.choice(["p", "q", None])) for i in range(40)]
    pool += [(40, "ab", "p"), (41, "b", "q"), (42, "lasalgaon", "p"), (43, "lasalgaon", "q"), (44, "market of " * 9 + "nashik", "p")]

    def edited(name):
        letters = list(name)
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(0, len(letters) + 1)
            letters[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "z", "n"])
        return "".join(letters)

    names = [(edited(rng.choice(pool)[1]), rng.choice(["p", "q", "elsewhere", None])) for _ in range(120)]
    names += [("market of " * 9 + "nasik", "p"), ("", None), (None, "p"), ("baa", "q"), ("bb", "p"), ("ba", "p"), ("lasalgaonn", None)]
    cfg = dataclasses.replace(SETTINGS.resolving, review=review)
    frame = spark.createDataFrame(names + names[:5], "raw string, district string")
    got = resolve(frame, spark.createDataFrame(pool, "entity_id int, name string, district string"), cfg).where("method in ('fuzzy', 'none')").collect()
    assert {r["method"] for r in got} == {"fuzzy", "none"}
    tidy = lambda t: " ".join(plain(t).lower().split())
    for r in got:
        if r["raw"] is None:
            assert r["method"] == "none"
            continue
        known = r["district"] in ("p", "q")
        scored = [(-ratio(tidy(r["raw"]), tidy(n)), i) for i, n, d in pool if not known or d == r["district"]] if tidy(r["raw"]) else []
        best = min([s for s in scored if -s[0] >= review], default=None)
        assert (r["entity_id"], round(r["score"], 9)) == ((best[1], round(-best[0], 9)) if best else (None, 0.0)), r


def test_texts_one_letter_apart_meet_once_and_only_they(spark):
    """Against every pair: equal texts, one letter more or less, in the same district or none; not two letters, not another one."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab0") for _ in range(rng.randrange(1, 7)))
    asked, pool = ({(word(), rng.choice(["p", "q", None])) for _ in range(120)} for _ in range(2))
    got = resolving._one_off(spark.createDataFrame(sorted(asked, key=str), "a string, of string"), spark.createDataFrame([(b, at, n) for n, (b, at) in enumerate(sorted(pool, key=str))], "b string, at string, e int"))
    want = [(a, of, b) for a, of in asked for b, at in pool if of == at and abs(len(a) - len(b)) <= 1 and common(a, b) == min(len(a), len(b))]
    assert sorted(((r["a"], r["of"], r["b"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_copies_of_numbered_names(spark):
    """The least id of a name's copies counts, near ones of many like it are told apart, and so is the best at two letters' distance."""
    pool = [(i + 300 * c, f"Supplier#{i:09d}", "pq"[i % 2]) for c in range(4) for i in range(300)]
    names = [(f"Suplier#{i:09d}", d) for i in range(0, 300, 7) for d in ("pq"[i % 2], None)] + [(f"Suplir#{i:09d}", None) for i in range(0, 300, 50)]
    got = resolve(spark.createDataFrame(names, "raw string, district string"), spark.createDataFrame(pool, "entity_id int, name string, district string")).collect()
    assert {(r["raw"], r["district"]): (r["entity_id"], r["method"]) for r in got} == {n: (int(n[0][-9:]), "fuzzy") for n in names} and len(got) == len(names)
