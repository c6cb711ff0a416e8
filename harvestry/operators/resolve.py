"""Entity resolution: exact, then prefix, then fuzzy, each distinct name once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.config import SETTINGS, Resolving
from harvestry.functions.strings import BITS, common_by_bits, letter_places, longest_common, normalise, numbered_grams, sorted_tokens

GRAM = 2


def resolve(names: DataFrame, pool: DataFrame, cfg: Resolving = SETTINGS.resolving) -> DataFrame:
    """raw, district, entity_id, matched_name, score, method (exact, prefix, fuzzy, none), needs_review.

    names: raw, district (null: none). pool: entity_id, name, district. Candidates are those of the name's district, or
    all if none lies in it. Of several prefixes that with the least id counts; of fuzzy matches the best, then the least id.
    Each text stands once in each district, however many candidates or names have it.
    """
    distinct = names.select("raw", "district").distinct().withColumn("needle", normalise(F.col("raw")))
    pool = pool.select("entity_id", "name", F.col("district").alias("pool_district"), normalise(F.col("name")).alias("candidate"))
    here = pool.select("pool_district").distinct().withColumn("known", F.lit(True))
    rows = distinct.join(here, distinct["district"] == here["pool_district"], "left").select("raw", "district", "needle", F.when(F.col("known"), F.col("district")).alias("of"))
    key = ["raw", "district", "needle", "of"]
    # Candidates stand under their district, for names of it, and under none, for names that may be anywhere; of equal ones that with the least id is enough.
    anywhere = F.explode(F.array_distinct(F.array(F.col("pool_district"), F.lit(None).cast("string"))))
    pool = pool.where("candidate is not null and entity_id is not null").withColumn("at", anywhere).groupBy("candidate", "at").agg(F.min(F.struct("entity_id", "name")).alias("e"))

    # A candidate is the whole name or a prefix of whole tokens: equal to one of the needle's own heads, so an equi-join finds it.
    words = F.split("needle", " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    headed = rows.withColumn("head", F.explode_outer(heads)).withColumn("whole", F.col("head") == F.col("needle"))
    named = headed.join(pool, (F.col("head") == F.col("candidate")) & F.col("of").eqNullSafe(F.col("at")) & (F.col("whole") | (F.length("head") >= cfg.prefix_chars)), "left")
    match = F.struct("e.entity_id", F.col("e.name").alias("matched_name"), F.lit(100.0).alias("score"), F.when(F.col("whole"), "exact").otherwise("prefix").alias("method"))
    first = named.groupBy(*key).agg(F.min_by(match, F.when(F.col("e").isNotNull(), F.struct(~F.col("whole"), "e.entity_id"))).alias("m"))

    rest = first.where("m is null").drop("m").withColumn("a", sorted_tokens(F.col("needle")))
    best = _best(rest.where(F.length("a") > 0).select("a", "of").distinct(), pool.where(F.length("candidate") > 0), cfg).select("a", F.col("of").alias("best_of"), "found")
    fuzzy = rest.join(best, (rest["a"] == best["a"]) & F.col("of").eqNullSafe(F.col("best_of")), "left")
    match = F.when(F.col("found").isNotNull(), F.struct("found.entity_id", F.col("found.name").alias("matched_name"), "found.score", F.lit("fuzzy").alias("method")))
    out = first.where("m is not null").select("raw", "district", "m").unionByName(fuzzy.select("raw", "district", match.alias("m")))
    method = F.coalesce("m.method", F.lit("none"))
    return out.select("raw", "district", "m.entity_id", "m.matched_name", F.coalesce("m.score", F.lit(0.0)).alias("score"), method.alias("method"), ((method == "fuzzy") & (F.col("m.score") < cfg.auto)).alias("needs_review"))


def _needed(total: Column, edits: Column) -> Column:
    """Shared runs of two texts of so many letters together, at so many edits: an edit that takes a letter away breaks GRAM
    runs, one that puts one in a run less, and the texts' lengths say how many of both there are."""
    return F.ceil(total / 2 - (GRAM - 1) - edits * (GRAM - 0.5) - 1e-9)


def _by_rarity(texts: DataFrame, counts: DataFrame, cfg: Resolving) -> DataFrame:
    """text, grams (rarest in the pool first) and head: the first grams, of which two texts that score enough share one."""
    shortest = F.ceil(F.length("text") * cfg.review / (200 - cfg.review) - 1e-9)
    total = F.length("text") + shortest
    least = F.greatest(_needed(total, total * (100 - cfg.review) / 100), F.lit(1))
    rows = texts.select("text", F.explode(numbered_grams(F.col("text"), GRAM)).alias("gram")).join(counts, "gram", "left")
    ordered = rows.groupBy("text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("all"))
    # Runs that no candidate has come first; nothing meets by them.
    head = F.filter(F.slice("all", F.lit(1), F.greatest(F.size("all") - least + 1, F.lit(0)).cast("int")), lambda x: x["n"] > 0)
    return ordered.select("text", F.col("all.gram").alias("grams"), head["gram"].alias("head"))


def _one_off(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """a, of, b, e: texts that are equal, or one of which is the other without one letter. They meet by the shorter text's hash."""
    key = lambda t, side, place: F.xxhash64(t, F.lit(side), place)

    def shorter(t: Column, side: int, place: Column) -> Column:
        without = lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: key(without(i), side, place))

    a, b, of, at = (F.col(c) for c in ("a", "b", "of", "at"))
    ours = asked.select("a", "of", F.explode(F.array_distinct(F.concat(F.array(key(a, 0, of)), shorter(a, 1, of)))).alias("key"))
    theirs = pool.select("b", "at", "e", F.explode(F.array_distinct(F.concat(F.array(key(b, 0, at), key(b, 1, at)), shorter(b, 0, at)))).alias("key"))
    apart = F.abs(F.length("a") - F.length("b"))
    return ours.join(theirs, "key").where(of.eqNullSafe(at) & (apart <= 1) & (F.levenshtein("a", "b") == apart)).select("a", "of", "b", "e")


def _best(asked: DataFrame, pool: DataFrame, cfg: Resolving) -> DataFrame:
    """a, of, found (score, entity_id, name): the best candidate of each text and district whose score is at least cfg.review.

    asked: a, of, once each. A candidate at one letter's distance beats all that are further, so texts that have one are done.
    For the others: the edits that the score counts are at most a share of both lengths. So the texts share a least number
    of runs, and one of the rarest runs of both: an equi-join of these finds the pairs, each under the first that it shares.
    Pairs for which no shared run is sure (very short texts, or a low least score) meet by their lengths.
    """
    pool = pool.withColumn("b", sorted_tokens(F.col("candidate"))).groupBy("b", "at").agg(F.min("e").alias("e"))
    total = F.length("a") + F.length("b")
    edits = F.floor(total * (100 - cfg.review) / 100 + 1e-9)
    needed = _needed(total, edits)
    # Negative, so that the least is the best, then the least id.
    pair = lambda common: F.struct((-200.0 * common / total).alias("worse"), "e.entity_id", "e.name")
    good = F.col("p.worse") <= -cfg.review

    here = pool.select(F.col("b").alias("text")).distinct()
    counts = here.select(F.explode(numbered_grams(F.col("text"), GRAM)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    ours = _by_rarity(asked.select(F.col("a").alias("text")).distinct(), counts, cfg).select(F.col("text").alias("a"), F.col("grams").alias("a_grams"), F.col("head").alias("a_head")).where(F.size("a_head") > 0)
    hopeful = asked.join(ours, "a")

    one_off = _one_off(hopeful.select("a", "of"), pool).withColumn("p", pair(F.least(F.length("a"), F.length("b")))).where(good).groupBy("a", "of").agg(F.min("p").alias("p"))
    # Two letters apart, the best that there can be is a candidate with two letters more.
    done = one_off.where(-F.col("p.worse") > 200.0 * F.length("a") / (2 * F.length("a") + 2) + 1e-9).select(F.col("a").alias("done_a"), F.col("of").alias("done_of"))
    left = hopeful.join(done, (hopeful["a"] == done["done_a"]) & hopeful["of"].eqNullSafe(done["done_of"]), "left_anti")

    theirs = _by_rarity(here, counts, cfg).withColumn("places", letter_places(F.col("text"))).select(F.col("text").alias("b"), F.col("grams").alias("b_grams"), F.col("head").alias("b_head"), "places")
    pool_rows = pool.join(theirs, "b").withColumn("gram", F.explode("b_head"))
    rows = left.withColumn("gram", F.explode("a_head"))
    met = rows.join(pool_rows, (rows["gram"] == pool_rows["gram"]) & F.col("of").eqNullSafe(F.col("at"))).where(rows["gram"] == F.get(F.array_intersect("a_head", "b_head"), F.lit(0)))
    met = met.where((F.size(F.array_intersect("a_grams", "b_grams")) >= needed) & (F.levenshtein("a", "b") <= edits))
    common = F.when(F.length("b") <= BITS, common_by_bits(F.col("a"), F.col("places"), F.length("b"))).otherwise(longest_common(F.col("a"), F.col("b")))
    out = one_off.unionByName(met.select("a", "of", pair(common).alias("p")).where(good))

    share = 0.5 - (GRAM - 0.5) * (100 - cfg.review) / 100
    if share <= 0 or GRAM / share > 4:
        few = lambda c: F.lit(True) if share <= 0 else F.length(c) <= GRAM / share
        lengths = F.sequence(F.greatest(F.floor(F.length("a") * cfg.review / (200 - cfg.review)), F.lit(1)), F.ceil(F.length("a") * (200 - cfg.review) / cfg.review))
        short, near = pool.where(few("b")).withColumn("of_length", F.length("b").cast("long")), asked.where(few("a")).withColumn("of_length", F.explode(lengths))
        near = near.join(short, (near["of_length"] == short["of_length"]) & F.col("of").eqNullSafe(F.col("at"))).where((needed < 1) & (F.levenshtein("a", "b") <= edits))
        out = out.unionByName(near.select("a", "of", pair(longest_common(F.col("a"), F.col("b"))).alias("p")).where(good))
    best = out.groupBy("a", "of").agg(F.min("p").alias("p"))
    return best.select("a", "of", F.struct((-F.col("p.worse")).alias("score"), "p.entity_id", "p.name").alias("found"))


def attach(rows: DataFrame, resolved: DataFrame, raw: str, district: str | None, as_: str) -> DataFrame:
    """rows with the entity id of each name."""
    r = resolved.select(F.col("raw").alias("__raw"), F.col("district").alias("__district"), F.col("entity_id").alias(as_))
    same = rows[raw].eqNullSafe(r["__raw"]) & (rows[district].eqNullSafe(r["__district"]) if district else F.lit(True))
    return rows.join(r, same, "left").drop("__raw", "__district")
