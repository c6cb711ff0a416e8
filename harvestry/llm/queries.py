"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.lm import score_held_out

    return score_held_out(_table(spark, sf_dir, "documents"), order=3)


def op2_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm import shared, sst

    at = shared.scratch_dir(spark, "sst")
    return sst.read_shards(sst.write_shards(_table(spark, sf_dir, "documents"), at, public_tokenizers.path(BYTE_BPE), end_id=2))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.lines import removed_lines

    return removed_lines(_table(spark, sf_dir, "documents"))


#: verdict, host and path of the given rules
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.urls import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.decontaminate import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.spotsigs import compare_with_next

    return compare_with_next(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.jaccard import link_documents

    return link_documents(_table(spark, sf_dir, "documents"), least=75)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed="2024")


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.mixing import taken

    return taken(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, times=3)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestry.llm.alignment import align_counted

    return align_counted(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_sst_shards": op2_sst_shards,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_spotsigs": op9_spotsigs,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_mixing": op12_source_mixing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

#: Every shingle that two texts share is joined with itself, then links are followed from each document.
OP10_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) END AS s FROM w),
 u AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(any_value(s)) AS n FROM s WHERE len(s)>0 GROUP BY list_sort(s)),
 e AS (SELECT id, n, unnest(s) AS sh FROM u), x AS (SELECT id, n, dense_rank() OVER (ORDER BY sh) AS sh FROM e SEMI JOIN (SELECT sh FROM e GROUP BY sh HAVING count(*)>1) q USING (sh)),
 p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.sh=b.sh AND a.id<>b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100*count(*)>=75*(a.n+b.n-count(*))),
 c AS (SELECT id AS root, id AS node FROM u UNION SELECT c.root, p.b FROM c JOIN p ON p.a=c.node),
 m AS (SELECT node AS id, min(root) AS component_id FROM c GROUP BY 1)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN u ON u.s=list_sort(s.s) LEFT JOIN m USING (id)"""

#: CRC-32 by its table, of each distinct word once.
OP11_SQL = r"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n,0,0,0,0,0,0,0,0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
 d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 dw AS (SELECT r, unnest(w) AS w FROM d),
 bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
 b AS (SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), (2*i+1)::INT, 2))::BIGINT)), lambda c, x: xor(t[(1 + (xor(c, x) & 255))::INT], c >> 8))) % 10000 AS bucket FROM v, tab),
 s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (w) GROUP BY 1),
 g AS (SELECT bucket, floor(1000*ln((coalesce(t,0)+1)::DOUBLE*((SELECT count(*) FROM dw)+10000)::DOUBLE/((s+1)::DOUBLE*((SELECT count(*) FROM bw)+10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
 m AS (SELECT r, floor(sum(gain)::DOUBLE/count(*))::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
 x AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight,0) AS weight, ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR,''))[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (r)),
 y AS (SELECT r, doc_id, n_features, weight, weight+floor(-1000*ln(-ln((h+0.5)/4294967296)))::BIGINT AS score FROM x),
 z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS k FROM y WHERE n_features>=20)
SELECT doc_id, n_features, weight, score, CASE WHEN k<=10*(SELECT count(*) FROM z)//100 THEN k END AS rank FROM y LEFT JOIN z USING (r)"""

ORACLE_SQL = {"op10_ngram_jaccard": OP10_SQL, "op11_importance_resampling": OP11_SQL}
