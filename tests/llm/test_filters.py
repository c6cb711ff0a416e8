"""URL rules, language ID, decontamination and SpotSigs against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harvestry.llm import decontaminate as D
from harvestry.llm import langid, spotsigs, urls
from harvestry.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


def judged(url):
    """Host, path and rule by plain Python."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls_follow_the_rules(spark):
    given_urls = ["http://A.example.ORG/es/x?q=1", "https://example.org/en/12", "https://example.org/en/2#x", "http://x.com/fr/", "http://x.com/fr", "http://com/de/a", "http://notorg/", "nothing", None, "", "x://", "http://h?x://y/", "http://y.org?a", "http://ü.org/ÄA", "http://a..org/", "a\nb://c.org/\nd"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*given_urls, given_urls[0]])], "page_id long, url string, host string, tokens string")
    rows = {r["page_id"]: r for r in urls.judge(pages, URL_RULES, min_support=0.2, min_confidence=0.9).collect()}
    assert len(rows) == len(given_urls) + 1
    for i, u in enumerate(given_urls):
        host, path, rule, verdict = judged(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule), u
        if verdict:
            assert rows[i]["verdict"] == verdict
        assert rows[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0), URL_RULES).collect() == []


def test_mined_rules_are_those_of_counting(spark):
    rows = [(["a", "b"], "block", 6), (["a"], "allow", 5), (["b", "c"], "block", 3), (["c"], "allow", 4)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string, n long")
    rules, items = urls.learn(labelled, 0.1, 0.9)
    assert {(tuple(r["antecedent"]), r["verdict"]): round(r["confidence"], 6) for r in rules.collect()} == {(("b",), "block"): 1.0}
    pages = urls.with_items(spark.createDataFrame([(1, ["b", "z"]), (2, ["z"]), (3, ["a", "b"])], "row int, tokens array<string>"), items, "row")
    assert {r["row"]: r["mined_verdict"] for r in urls.with_mined(pages, rules).collect()} == {1: "block", 2: None, 3: "block"}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_verdicts_are_those_of_counting_all_combinations(spark, seed):
    rng = random.Random(seed)
    draw = lambda: sorted(t for t in "abcdef" if rng.random() < 0.4) + (["g", "h"] if rng.random() < 0.4 else [])  # noqa: E731  g and h always together
    labelled = [(draw(), rng.choice(urls.VERDICTS), rng.randint(1, 3)) for _ in range(60)]
    pages = [(i, draw()) for i in range(40)] + [(40, ["g"]), (41, ["h"]), (42, []), (43, ["z"])]
    total, count = sum(n for *_, n in labelled), {}
    for tokens, verdict, n in labelled:
        for k in range(1, 1 << len(tokens)):
            part = frozenset(t for i, t in enumerate(tokens) if k >> i & 1)
            for v in (verdict, None):
                count[part, v] = count.get((part, v), 0) + n
    sure = {(part, v): n / count[part, None] for (part, v), n in count.items() if v and n >= 0.05 * total and n / count[part, None] >= 0.6}
    rules, items = urls.learn(spark.createDataFrame(labelled, "tokens array<string>, verdict string, n long"), 0.05, 0.6)
    rows = urls.with_mined(urls.with_items(spark.createDataFrame(pages, "row int, tokens array<string>"), items, "row"), rules).collect()
    assert len(rows) == len(pages)
    for r in rows:
        fits = {(v, round(c, 9)) for (part, v), c in sure.items() if part <= set(r["tokens"])}
        best = {x for x in fits if x[1] == max(c for _, c in fits)}
        assert (r["mined_verdict"], r["confidence"] and round(r["confidence"], 9)) in (best or {(None, None)}), r


def test_long_urls_that_repeat_end(spark):
    long = "http://www.example.org/en/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    other = long.replace("example.org/en/", "other.net/")
    pages = spark.createDataFrame([(i, long) for i in range(50)] + [(50 + i, f"http://example.org/es/{w}") for i, w in enumerate(["x", "y"] * 10)] + [(99, other)], "page_id long, url string")
    rows = {r["page_id"]: r for r in urls.judge(pages, URL_RULES).collect()}
    assert (rows[0]["rule"], rows[0]["verdict"]) == ("org/", "allow")
    assert (rows[99]["rule"], rows[99]["verdict"], rows[99]["confidence"]) == (None, "allow", 1.0)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !!", "a"), (4, "中文字符" * 20, "a"), (None, "the of and", "a")], "doc_id long, text string, score string")
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert rows[4]["rejected"] and not rows[None]["rejected"]
    assert langid.predict(odd.limit(0), model).collect() == []
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() > 0.99 * docs.count()
    none = langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def least_distance(pattern, text):
    """The usual table, with free ends in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
def test_bit_parallel_distance_is_that_of_the_table(pattern, text):
    assert D.distance(pattern, text)[0] == min(len(pattern), least_distance(pattern, text))


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(4, 14)))) for i in range(12)] + [(90, ""), (91, None), (92, "x"), (0, "alpha alpha beta gamma delta eps zeta")]
    texts = []
    for _ in range(60):
        base = list(" ".join(rng.choices(words, k=rng.randint(0, 20))) + " " + (rng.choice(items[:12])[1] if rng.random() < 0.7 else "") + ". " + " ".join(rng.choices(words, k=5)))
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(len(base))] = rng.choice(["x", "", "Q ", " -- "])
        texts.append("".join(base))
    rows = [*enumerate(texts), (100, None), (101, ""), (None, items[0][1])]
    want = set()
    for d, t in rows:
        for i, x in items:
            p = D.normalise(x)
            if p and least_distance(p, D.normalise(t)) <= min(int(0.1 * len(p)), len(p) - 1):
                want.add((d, i))
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench, 0.1).collect()} == want
    clean = {r["doc_id"] for r in D.clean_documents(docs, bench, 0.1).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}


def test_no_items_match_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).collect() == []
    assert D.clean_documents(docs, none).count() == 1


def spots(text):
    words = [w for w in re.sub(r"[^\w]|_", " ", (text or "").lower()).split()]
    common, found = set(spotsigs.COMMON), set()
    for i, w in enumerate(words):
        if w in common:
            rest = [x for x in words[i + 1 :] if x not in common][:2]
            if len(rest) == 2:
                found.add(zlib.crc32(" ".join([w, *rest]).encode()))
    return found or {zlib.crc32(w.encode()) for w in words}


def likeness(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_and_edits(spark):
    texts = {5: "The cat of the big old house", 3: "no common words here", 9: "", 1: None, 7: "the cat of the big old house and the dog was in a small yard", 4: "über die Straße und das Haus é", 8: "one"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, spots int")
    rows = {r["doc_id"]: r for r in spotsigs.compare_with_next(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = rows[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h:08x}" for h in sorted(spots(t)))
        assert r["near_edited"] == pytest.approx(likeness(spots(t), spots(edited)))
        assert r["near_next"] == pytest.approx(likeness(spots(t), spots(nxt)))
    assert {r["doc_id"]: r["fingerprint"] for r in spotsigs.fingerprints(docs).collect()} == {i: r["fingerprint"] for i, r in rows.items()}


def test_next_over_many_ranges_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS", 3)
    rows = [(i * 1000 + (i % 7), f"text {i} of the big tree {i * 3}") for i in range(40)]
    got = {r["doc_id"]: r["edited_sha256"] for r in spotsigs.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(reverse=True)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (2, "c"), (2, "c")], "doc_id long, text string")
    assert spotsigs.compare_with_next(nulls).count() == 4
    assert spotsigs.compare_with_next(nulls.limit(0)).collect() == []
    assert spotsigs.compare_with_next(nulls.where("doc_id = 2").limit(1)).first()["near_next"] == 1.0


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices(["the", "of", *[f"w{i}" for i in range(30)]], k=40)) for _ in range(6)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else "zzz" for w in rng.choice(base).split())) for i in range(60)] + [(99, None)]
    pairs, members = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 60)
    prints = {r["fingerprint"]: spots(dict(rows)[r["doc_id"]]) for r in members.collect()}
    names = sorted(p for p in prints if p)
    want = {frozenset((a, b)) for i, a in enumerate(names) for b in names[:i] if 100 * len(prints[a] & prints[b]) >= 60 * len(prints[a] | prints[b])}
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == want
    assert members.count() == 61


def test_a_benchmark_in_parts_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    benchmark = benchmark.unionAll(benchmark.limit(2)).unionAll(spark.createDataFrame([(None, "a null id"), (77, None)], benchmark.schema))
    whole, clean = sorted(map(str, D.matches(docs, benchmark).collect())), {r["doc_id"] for r in D.clean_documents(docs, benchmark).collect()}
    monkeypatch.setattr(D, "MOST_CHARACTERS", 1500)
    assert sorted(map(str, D.matches(docs, benchmark).collect())) == whole
    assert {r["doc_id"] for r in D.clean_documents(docs, benchmark).collect()} == clean
    assert whole and len(clean) < docs.count()
