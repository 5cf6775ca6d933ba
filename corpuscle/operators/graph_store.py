"""Writing the graph: labels, what was extracted from chunks, upserts, aliases, deletions by source, its schema, and sources in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters of a label, what stands in for an unsafe one, labels that only the store itself uses.
LABEL = r"(?U)^[\w㐀-䶿一-鿿·.\-+/]{1,64}$"
ENTITY, RELATION = "Entity", "RELATED_TO"
INTERNAL = ("__Entity__", "__Node__")


def safe_label(raw: Column, fallback: str = ENTITY) -> Column:
    """The trimmed label if it is made of letters, digits and a few signs, else the fallback (for null, too)."""
    plain = F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(plain.rlike(LABEL), plain).otherwise(fallback)


def primary_label(labels: Column) -> Column:
    """The first label that is not one of the store's own."""
    return F.coalesce(F.get(F.filter(labels, lambda x: ~x.isin(*INTERNAL)), F.lit(0)), F.lit(INTERNAL[0]))


def collected(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, mentions) of (chunk_id, entities, relations), each with its own key.

    Entities once by id (name and label of the smallest chunk_id), relations once by head, relation and tail with the
    smallest chunk_id as ``triplet_source_id``, mentions once by chunk and entity: one entity in twenty chunks has twenty
    mentions.  Labels are made safe; entities without id and relations without an end drop out.
    """
    found = extracted.select("chunk_id", F.inline("entities")).where("id <> ''").select("chunk_id", "id", "name", safe_label(F.col("label")).alias("label"))
    entities = found.groupBy("id").agg(F.min_by(F.struct("name", "label"), F.struct("chunk_id", "name", "label")).alias("e")).select("id", "e.*")
    edges = extracted.select("chunk_id", F.inline("relations")).where("head <> '' AND tail <> ''").withColumn("relation", safe_label(F.col("relation"), RELATION))
    relations = edges.groupBy("head", "relation", "tail").agg(F.min("chunk_id").alias("triplet_source_id"))
    return entities, relations, found.select("chunk_id", F.col("id").alias("entity_id")).distinct()


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, name, label, aliases): incoming values win where they are not null, aliases of both are kept, labels are made safe.

    Several incoming rows of one id count by their least values, so the result does not depend on their order.
    """
    none = F.array().cast("array<string>")
    new = incoming.groupBy("id").agg(F.min("name").alias("n"), F.min("label").alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", none))))).alias("a"))
    both = existing.join(new, "id", "full")
    aliases = F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("a", none)))
    return both.select("id", F.coalesce("n", "name").alias("name"), safe_label(F.coalesce("l", "label")).alias("label"), aliases.alias("aliases"))


def append_aliases(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities that are left after merging (names: id, canonical_id); a canonical one gets the ids of those merged into it as aliases.

    The ids of a very large group are first made distinct and combined in each task.
    """
    merged = names.where("id <> canonical_id")
    gained = merged.groupBy(F.col("canonical_id").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("gained"))
    kept = entities.join(merged.select("id"), "id", "left_anti").join(gained, "id", "left")
    none = F.array().cast("array<string>")
    return kept.withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("gained", none))).drop("gained")


def without_sources(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations but for those that were extracted from the given chunks (chunk_id); relations without a source stay."""
    return relations.join(gone.select(F.col("chunk_id").alias("triplet_source_id")).distinct(), "triplet_source_id", "left_anti")


def schema_summary(relations: DataFrame, entities: DataFrame, most: int = 1000) -> DataFrame:
    """(start, type, end): which labels which kinds of relations connect, the first ``most`` in order."""
    labels = entities.select("id", safe_label(F.col("label")).alias("label"))
    end = lambda c, name: labels.select(F.col("id").alias(c), F.col("label").alias(name))
    kinds = relations.join(end("head", "start"), "head").join(end("tail", "end"), "tail").select("start", F.col("relation").alias("type"), "end").distinct()
    return kinds.orderBy("start", "type", "end").limit(most)


def in_scope(mentions: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity_id): entities that a chunk of one of the sources mentions."""
    own = chunks.join(sources.select("source").distinct(), "source", "left_semi").select("chunk_id").distinct()
    return mentions.join(own, "chunk_id", "left_semi").select("entity_id").distinct()


def scoped_seeds(scored: DataFrame, scope: DataFrame, want: int) -> DataFrame:
    """The ``want`` best seeds (query_id, node, score) of each query among the entities in scope.

    The scope is applied before the cut, so entities of other sources never take a place.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    own = scored.join(scope.select(F.col("entity_id").alias("node")), "node", "left_semi")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want).select("query_id", "node", "score", (F.col("rank") - 1).cast("long").alias("rank"))
