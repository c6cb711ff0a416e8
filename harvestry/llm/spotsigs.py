"""SpotSigs fingerprints in DataFrame operations only.

A spot is a common word (an anchor) with the next two words that aren't common; a text's
fingerprint is the set of its spots' 32-bit hashes, written as ascending hexadecimal numbers.
A text without spots takes its words instead. Two fingerprints are as alike as their sets'
Jaccard similarity. Near duplicates are found by partitioning the sets by length and comparing
those of neighbouring partitions that share one of their rarest hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words of English, French, German and Spanish.
COMMON = """
a an and are as at be been by for from had has have in is it not of on or that the their this to was were which will with
au aux ce dans de des du elle en est et il la le les ne ou par pas plus pour que qui se sur un une
als auch auf das dem den der des die ein eine es für im in ist mit nicht sich und von zu
al con del el ella en es la las lo los no para por que se su sus un una y
""".split()
ROWS = 4096  # documents for each range of identifiers


def words(text: Column) -> Column:
    """The words, lower-cased, each between single blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))


def spots(text: Column) -> Column:
    """The sorted distinct hashes of a text's spots; of its words if it has none."""
    common = "|".join(sorted(set(COMMON)))
    pattern = f" ({common})(?= (?:(?:{common}) )*+([^ ]+) (?:(?:{common}) )*+([^ ]+) )"
    marked = F.regexp_replace(words(text), pattern, "\u0001$1 $2 $3\u0002")
    found = F.regexp_extract_all(marked, F.lit("\u0001([^\u0002]*)"), F.lit(1))
    plain = F.filter(F.split(words(text), " "), lambda w: w != "")
    chosen = F.when(F.contains(marked, F.lit("\u0001")), found).otherwise(plain)
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda s: F.crc32(s.cast("binary")))))


def fingerprint(spots: Column) -> Column:
    return F.array_join(F.transform(spots, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_spots, fingerprint of every row; a null text is an empty one, whose fingerprint is empty."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), spots(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("spots"))
    return rows.select("doc_id", F.size("spots").cast("long").alias("n_spots"), fingerprint(F.col("spots")).alias("fingerprint"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is that with the next smaller doc_id, after the smallest the greatest; a single row is its
    own next. The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document (all of them, if it has fewer). Null texts are empty ones. Rows of one doc_id follow each other
    in the order of their texts' hashes; null ids come after all others, in ranges of those hashes.

    Rows are dealt out by ranges of identifiers; each range also gets the last row of the range before.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, n // ROWS)
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    of_null = F.lit(-1) - F.pmod(F.shiftrightunsigned("tie", 1), F.lit(ranges))
    place = F.when(F.col("doc_id").isNull(), of_null).otherwise(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)))
    rows = rows.withColumn("range", place.cast("long"))
    order = F.struct(F.col("doc_id"), F.col("tie"))
    lasts = rows.groupBy("range").agg(F.max_by("text", order).alias("text"))
    # One row for each range, so that a single task may order them.
    ring = lasts.select("range").withColumn("follows", F.lead("range").over(Window.orderBy("range")))
    first = lasts.agg(F.min("range").alias("first"))
    ring = ring.crossJoin(F.broadcast(first)).select("range", F.coalesce("follows", "first").alias("follows"))
    carried = lasts.join(ring, "range").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("tie"), F.col("follows").alias("range"), F.lit(True).alias("carried"))
    all_rows = rows.withColumn("carried", F.lit(False)).unionByName(carried).repartition("range").withColumn("spots", spots(F.col("text")))
    ordered = Window.partitionBy("range").orderBy(F.col("carried").desc(), F.col("doc_id").asc_nulls_first(), "tie", "text")
    pairs = all_rows.withColumn("next_text", F.lag("text").over(ordered)).withColumn("next_spots", F.lag("spots").over(ordered)).where("not carried")
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = pairs.select("doc_id", chars.cast("long").alias("n_chars"), "spots", "next_spots", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "spots", "next_spots", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spots(F.col("edited")).alias("edited_spots"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, least: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of different fingerprints whose likeness is least / 100 or more, and the membership (fingerprint, doc_id) of all rows.

    Sets are dealt to partitions by length, each a third longer than the one before at most, so that similar sets
    lie in the same or the next one. Within them a set looks up its rarest hashes only, and a pair is compared only
    if its lengths allow the likeness. Empty fingerprints pair with none.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), spots(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("spots"))
    members = rows.withColumn("fingerprint", fingerprint(F.col("spots")))
    sets = members.where(F.size("spots") > 0).groupBy("fingerprint").agg(F.first("spots").alias("spots")).withColumn("n", F.size("spots"))
    sets = sets.withColumn("length_range", F.floor(F.ln("n") / F.ln(F.lit(100 / least))).cast("int"))
    counts = sets.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("k"))
    ranked = sets.select("fingerprint", "n", "length_range", F.explode("spots").alias("spot")).join(counts, "spot")
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("k", "spot"))
    prefix = ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least / 100) + 1).select("fingerprint", "n", "length_range", "spot")
    x = prefix.select(F.col("fingerprint").alias("a"), F.col("n").alias("a_n"), "length_range", "spot")
    y = prefix.select(F.col("fingerprint").alias("b"), F.col("n").alias("b_n"), F.explode(F.array("length_range", F.col("length_range") - 1)).alias("length_range"), "spot")
    longer = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    near = x.join(y, ["length_range", "spot"]).where(longer & (100 * F.col("a_n") >= least * F.col("b_n"))).select("a", "b").distinct()
    of = lambda c: sets.select(F.col("fingerprint").alias(c), F.col("spots").alias(f"{c}_spots"))
    pairs = near.join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness(F.col("a_spots"), F.col("b_spots")).alias("likeness"))
    return pairs.where(F.col("likeness") * 100 >= least), members.select("fingerprint", "doc_id")
