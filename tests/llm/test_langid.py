"""Rejection of texts in unseen scripts at every length, and that clean documents stay."""

import random

from harvestry.llm import langid

SF = "/root/testdata/sf0.001"
SCRIPTS = {"greek": range(0x3B1, 0x3CA), "cyrillic": range(0x430, 0x450), "arabic": range(0x628, 0x64B), "cjk": range(0x4E00, 0x9000), "hangul": range(0xAC00, 0xD7A4), "latin": range(0x61, 0x7B)}


def test_unseen_scripts_are_rejected_at_every_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    pick, odd = random.Random(5), []
    for name, letters in SCRIPTS.items():
        for words in (10, 50, 200, 1000, 5000, 20000):
            for _ in range(2):
                if name != "latin" or words > 50:  # short random Latin letters may pass for words
                    odd.append((len(odd), name, words, " ".join("".join(map(chr, pick.choices(letters, k=pick.randint(2, 9)))) for _ in range(words))))
    texts = spark.createDataFrame(odd, "doc_id long, name string, words int, text string")
    rejected = {r["doc_id"] for r in langid.predict(texts, model).where("rejected").collect()}
    assert [x[1:3] for x in odd if x[0] not in rejected] == []


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.where("length(regexp_replace(text, '[^\\\\p{L}]', '')) > 0").select("doc_id"), "doc_id").collect()
    assert len(rows) > 100
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


def test_short_texts_of_a_language_sampled_with_long_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    model = langid.fit(docs.where("length(text) > 1500"))
    short = docs.where("length(text) > 1500").selectExpr("doc_id", "substring(text, 1, 60) as text")
    rows = langid.predict(short, model).collect()
    assert len(rows) > 20
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


def test_rows_without_identifiers_are_drawn_one_by_one_and_repeated_ones_count_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    languages = {r[0] for r in docs.select("lang").distinct().collect()}
    nameless = docs.selectExpr("cast(null as long) as doc_id", "text", "lang")
    for rows in (nameless, docs.selectExpr("7L as doc_id", "text", "lang")):
        assert set(langid.fit(rows, per_language=20).languages) == languages
    once = langid.fit(nameless, per_language=10**6)
    often = langid.fit(nameless.unionByName(nameless).unionByName(nameless), per_language=10**6)
    assert once.languages == often.languages and (once.idf == often.idf).all() and (once.centres == often.centres).all()
