"""N-gram Jaccard join: documents whose sets of five-word shingles are alike, by a size-aware heavy-light join.

Small sets enumerate all pairs of their rarest tokens (subsets of size two), so that two of
them meet only under a pair they share; large sets scan the inverted lists of their single
rarest tokens. The boundary between both is where the estimated work is least; a small set
that can be similar to a large one is in the inverted lists as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm import shared
from harvestry.llm.components import components
from harvestry.llm.setjoin import DOCUMENTS, Join


def link_documents(docs: DataFrame, least: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Rows are linked if 100 * intersection >= least * union of their sets; component_id is the
    smallest doc_id that links lead to. A null text or one without words has an empty set, no
    links and its own doc_id as component. Rows of one doc_id are rows of their own. Null ids
    count as greater than all others, so a component's id is null only if all of its ids are.
    """
    join = Join(shared.texts_of(docs, id_col, text_col, F.xxhash64(docs[text_col].cast("string")).alias("row_id")), DOCUMENTS, least, light=True, parities=8)
    standing = join.standing()
    lists = join.lists()
    links = join.verified(join.first_pairs(lists), standing)
    labels = components(links)
    rows = _labelled(lists, labels)
    links = links.unionByName(join.verified(join.led_pairs(rows.where("label <> l_label")), standing))
    labels = components(links)
    links = links.unionByName(join.verified(join.joined_pairs(_open(join, rows, labels)), standing))
    labels = components(links)
    sets = join.sets()
    filled = sets.where("n > 0")
    classes = filled.groupBy("set_id").agg(F.min("doc_id").alias("first"))
    named = classes.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least_ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = named.join(least_ids, "label").select("set_id", "component_id")
    linked = filled.join(of_class, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    rows = lists.join(of("set_id"), "set_id", "left").join(of("l_set_id"), "l_set_id", "left")
    rows = rows.withColumn("label", F.coalesce("set_id_label", "set_id")).withColumn("l_label", F.coalesce("l_set_id_label", "l_set_id"))
    return shared.materialise(rows.drop("set_id_label", "l_set_id_label"), "open")


def _open(join: Join, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """key, set_id, n, pos, label of the sets, leaders apart, of lists that have several of them and aren't in one component."""
    some = rows.groupBy("key").agg(F.count("*").alias("k"), F.max((F.col("label") != F.col("l_label")).cast("int")).alias("open")).where("k > 1 and open = 1").select("key")
    entries = join.entries(rows, some)
    named = entries.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    named = shared.materialise(named, "open")
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return named.join(several, "key")


def one_of_each(docs: DataFrame, least: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the smallest id; all columns as they are. Rows that repeat the kept id stay with it."""
    kept = link_documents(docs, least, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
