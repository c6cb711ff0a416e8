"""URL filtering by rules and by association rules.

Given rules decide the urls that they fit. From the urls so decided FP-growth mines
combinations of url tokens that imply a verdict; those of enough support and confidence decide
the others, found by an inverted index from each combination's rarest token. Tokens that always
occur together in the mined urls stand for one another: they are one item, so that long urls
which repeat don't give all combinations of their tokens. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VERDICTS = ("allow", "block")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: labels of the host, the top one marked, and words of the path with digits as one sign."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace(F.translate(path, UPPER, LOWER), r"[0-9]+", "0"), r"[^\p{L}0-9]+"), lambda x: x != "")
    top = F.when(F.size(labels) > 0, F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(top, F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), F.transform(words, lambda x: F.concat(F.lit("path:"), x))))


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (row, host, path) with the longest of the rules (rule_host, rule_path, rule_verdict) that fits each: rule, rule_verdict; null if none.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(F.col("labels"), i, F.size("labels"))))
    keyed = urls.withColumn("labels", labels).withColumn("suffix", F.explode(suffixes)).drop("labels")
    named = rules.withColumn("rule", F.concat("rule_host", "rule_path"))
    fits = keyed.join(named, (F.col("suffix") == F.col("rule_host")) & F.startswith("path", F.col("rule_path")))
    best = fits.groupBy("row").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    return urls.join(best, "row", "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def items_of(labelled: DataFrame, min_support: float) -> DataFrame:
    """token, item of the tokens that are in min_support of the rows (tokens, verdict, n: how often) or more; tokens that are in the same rows have the same item.

    They are a bounded number: the tokens of a url on average, over min_support, at most.
    """
    total = labelled.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    row = F.struct(F.array_sort("tokens"), "verdict")
    single = labelled.select(F.explode("tokens").alias("token"), "n", F.xxhash64(row).alias("h"), F.xxhash64(row, F.lit(1)).alias("g"))
    where = single.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    frequent = where.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * min_support).drop("total")
    named = frequent.groupBy("n", "k", "h", "g").agg(F.min("token").alias("item"))
    return frequent.join(named, ["n", "k", "h", "g"]).select("token", "item")


def with_items(rows: DataFrame, items: DataFrame, *key: str) -> DataFrame:
    """key and the distinct items of the rows' tokens (null if there are none)."""
    found = rows.select(*key, F.explode("tokens").alias("token")).join(F.broadcast(items), "token").groupBy(*key).agg(F.collect_set("item").alias("items"))
    return rows.join(found, list(key), "left").select(*rows.columns, "items")


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """antecedent array<string>, verdict, confidence, support of the rules that FP-growth finds in (items, verdict).

    A rule with a part that is as sure of the same verdict says nothing more, and is left out.
    """
    marked = labelled.select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(marked)
    verdicts = F.array(*(F.lit(f"verdict:{v}") for v in VERDICTS))
    found = model.associationRules.where(F.arrays_overlap("consequent", verdicts) & ~F.arrays_overlap("antecedent", verdicts))
    rules = found.select(F.array_sort("antecedent").alias("antecedent"), F.expr("substring(consequent[0], 9)").alias("verdict"), "confidence", "support")
    keyed = rules.withColumn("part", F.explode("antecedent"))
    less = rules.select(F.col("antecedent").alias("l_antecedent"), F.col("verdict").alias("l_verdict"), F.col("confidence").alias("l_confidence")).withColumn("part", F.element_at("l_antecedent", 1))
    smaller = (F.size("l_antecedent") < F.size("antecedent")) & (F.size(F.array_except("l_antecedent", "antecedent")) == 0)
    implied = keyed.join(less, "part").where(smaller & (F.col("l_verdict") == F.col("verdict")) & (F.col("l_confidence") >= F.col("confidence")))
    return rules.join(implied.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")


def learn(labelled: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """The rules mined from (tokens, verdict, n: how often), and the items that their antecedents are made of (token, item)."""
    labelled = labelled.groupBy("tokens", "verdict").agg(F.sum("n").alias("n"))
    items = items_of(labelled, min_support)
    copies = with_items(labelled, items, "tokens", "verdict").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return mine(copies.select("items", "verdict"), min_support, min_confidence), items


def with_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (row, items) with the verdict of the surest mined rule all of whose items are there: mined_verdict, confidence; null if none."""
    postings = urls.select("row", "items", F.explode("items").alias("item"))
    counts = postings.groupBy("item").agg(F.count("*").alias("n"))
    parts = rules.withColumn("item", F.explode("antecedent")).join(counts, "item")
    rarest = parts.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    fits = postings.join(rarest, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    order = F.struct("confidence", F.size("antecedent"), "support", "verdict", F.array_join("antecedent", " "))
    best = fits.groupBy("row").agg(F.max_by(F.struct(F.col("verdict").alias("mined_verdict"), "confidence"), order).alias("best"))
    return urls.join(best, "row", "left").select(*urls.columns, F.col("best.mined_verdict").alias("mined_verdict"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", min_support: float = 0.01, min_confidence: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row.

    rules: verdict, host, path. verdict is the longest fitting rule's, else the surest mined one's, else default;
    confidence is that of a mined rule (null: none decided). Each distinct url is judged once and given to all its
    rows. A null url, or one without ://, has empty host and path, fits no rule and holds no token: default.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
    parts = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    distinct = parts.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("row", F.struct("host", "path"))
    given = spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")
    ruled = with_rules(distinct, given).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    # Mined from labelled pages, each as often as its url occurs.
    found, items = learn(ruled.where("rule_verdict is not null").select("tokens", F.col("rule_verdict").alias("verdict"), "n"), min_support, min_confidence)
    judged = with_mined(with_items(ruled, items, "row"), found).select("host", "path", "rule", F.coalesce("rule_verdict", "mined_verdict", F.lit(default)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
    return parts.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "confidence")
