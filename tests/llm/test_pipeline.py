"""The pipeline's stages, each against a plain version of itself, at the smallest scale."""

import hashlib

import public_tokenizers
import tokenizers
from test_setjoin import alike, brute_components, words

import corpus_pipeline
from harvestry.llm import decontaminate as D
from harvestry.llm import shared

SF = "/root/testdata/sf0.001"


def plain_line_dedup(docs):
    """doc_id -> text without lines similar to earlier ones; None: no word is left of some."""
    seen, out = [], {}
    for i in sorted(docs):
        text, kept = docs[i] or "", []
        for line in text.split("\n"):
            mine = frozenset(words(line))
            if not (mine and any(4 * len(mine) <= 5 * len(x) and 4 * len(x) <= 5 * len(mine) and alike(x, mine, 80) for x in seen)):
                kept.append(line)
            if mine:
                seen.append(mine)
        gone = len(kept) < len(text.split("\n"))
        out[i] = None if gone and not words("\n".join(kept)) else "\n".join(kept)
    return out


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, before = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = shared.materialise(stage(spark, docs, SF), name)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == columns
    texts = lambda name: {i: r["text"] for i, r in kept[name].items()}
    assert all(before["language"][i] == t for i, t in texts("language").items())
    assert all(any(c.isalpha() for c in t) for t in texts("language").values())
    assert texts("line_dedup") == {i: t for i, t in plain_line_dedup(before["line_dedup"]).items() if t is not None}
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values())
    assert set(kept["near_duplicates"]) == {i for i, _, component in brute_components(list(before["near_duplicates"].items())) if i == component}
    items = [D.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # At this scale every item found is there word for word, or all but a few characters of it.
    for i, text in before["decontamination"].items():
        text = D.normalise(text)
        least = min(D.distance(x, text)[0] / len(x) for x in items)
        assert (i in kept["decontamination"]) == (least > 0.08), (i, least)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in before["encoding"].items():
        ids = library.encode(text, add_special_tokens=False).ids
        row = kept["encoding"][i]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert kept["encoding"].keys() == before["encoding"].keys()


def test_stages_take_empty_tables_and_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "\n\n", None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF).collect()
            assert len(out) <= len(rows), name
