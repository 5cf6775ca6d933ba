"""The graph beside the chunks: seeds, expansion, facts, mentions, merging, alike entities and upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import checkpoint, shared_table, spread_join

# Fixed value: full-width forms and the ideographic blank, for names of entities.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def normal_name(name: Column) -> Column:
    """Name of an entity in half-width forms, without blanks and enclosing quotes or brackets."""
    return F.regexp_replace(F.regexp_replace(F.translate(name, _WIDE, _ASCII), r"\s+", ""), "^[\"'“”‘’《〈「『【\\[(]+|[\"'“”‘’》〉」』】\\])]+$", "")


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, head, relation, tail): each edge from both ends."""
    keep = ["head", "relation", "tail"]
    return edges.select(F.col("head").alias("node"), F.col("tail").alias("other"), *keep).unionByName(edges.select(F.col("tail").alias("node"), F.col("head").alias("other"), *keep))


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, head, relation, tail, hop): edges within ``hops`` steps of a query's seeds, each with its least hop.

    Edges are walked in both directions and keep their own.  Each step only walks on from
    nodes that were not reached before, so cycles end by themselves.  Edges of a hub are dealt to several tasks.
    """
    sides = undirected(edges.distinct())
    reached = seeds.select("query_id", "node").distinct()
    front, found = reached, None
    for hop in range(1, hops + 1):
        step = spread_join(sides, front, "node").select("query_id", "head", "relation", "tail", "other")
        step = shared_table(step) if hop < hops else step  # read as facts and as the next front
        facts = step.select("query_id", "head", "relation", "tail", F.lit(hop).cast("long").alias("hop"))
        found = facts if found is None else found.unionByName(facts)
        if hop < hops:
            front = step.select("query_id", F.col("other").alias("node")).distinct().join(reached, ["query_id", "node"], "left_anti")
            reached = reached.unionByName(front)
    return found.groupBy("query_id", "head", "relation", "tail").agg(F.min("hop").alias("hop"))


def score_facts(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Facts with ``score``: the greater seed score of their ends, at least 0; seeds have query_id, node, score."""
    best = seeds.groupBy("query_id", "node").agg(F.max("score").alias("s"))
    end = lambda c: best.select("query_id", F.col("node").alias(c), F.col("s").alias(f"{c}_score"))
    both = facts.join(end("head"), ["query_id", "head"], "left").join(end("tail"), ["query_id", "tail"], "left")
    return both.withColumn("score", F.greatest(F.lit(0.0), F.coalesce("head_score", F.lit(0.0)), F.coalesce("tail_score", F.lit(0.0)))).drop("head_score", "tail_score")


def mentioning(nodes: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, hits, rank): chunks that mention most different nodes of a query; superseded ones never take a place.

    ``chunks`` are the visible ones, with chunk_id.  Ties go to the smaller chunk_id.
    """
    pairs = mentions.select("chunk_id", F.col("entity_id").alias("node")).distinct()
    hits = spread_join(pairs, nodes.select("query_id", "node").distinct(), "node").groupBy("query_id", "chunk_id").agg(F.count("*").alias("hits"))
    seen = hits.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "chunk_id")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("rank", (F.col("rank") - 1).cast("long"))


def merge_candidates(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, graph_hits, from_graph): vector rows win, rows of the graph alone score 0.

    ``vector`` has query_id, chunk_id and score, ``graph`` query_id, chunk_id and hits.
    """
    both = vector.join(graph.select("query_id", "chunk_id", "hits"), ["query_id", "chunk_id"], "full")
    return both.select("query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("hits", F.lit(0)).cast("long").alias("graph_hits"), F.col("score").isNull().alias("from_graph"))


def attach_facts(candidates: DataFrame, mentions: DataFrame, facts: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, chunk_id, head, relation, tail, place): up to ``most`` best facts whose head or tail a candidate chunk mentions."""
    ends = facts.withColumn("node", F.explode(F.array_distinct(F.array("head", "tail"))))
    named = candidates.select("query_id", "chunk_id").distinct().join(mentions.select("chunk_id", F.col("entity_id").alias("node")).distinct(), "chunk_id")
    found = named.join(ends, ["query_id", "node"]).groupBy("query_id", "chunk_id", "head", "relation", "tail").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "head", "relation", "tail")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).withColumn("place", F.col("place").cast("long")).drop("score")


def name_stem(name: Column) -> Column:
    """Normal name in lower case without a serial code at its end."""
    return F.regexp_replace(F.lower(normal_name(name)), "[a-z]{2}-[0-9]+$", "")


def alike_names(entities: DataFrame, key: Callable[[Column], Column] = normal_name) -> DataFrame:
    """(a, b): entities linked by an equal key of a name or alias; the first of each key with every other.

    A name that very many entities share makes a star of links, not all pairs.
    """
    spelled = entities.select("id", F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("written"))
    named = spelled.select("id", key(F.col("written")).alias("plain")).where("plain <> ''").distinct()
    first = named.groupBy("plain").agg(F.min("id").alias("a"))
    return named.join(first, "plain").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, group_id): nodes of links (a, b) and the least node of their connected component.

    Every round takes the least label of the neighbours and then the label of that label,
    and is checkpointed; rounds grow with the logarithm of the longest chain.
    """
    sides = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = checkpoint(sides.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("group_id")))
    while True:
        near = sides.join(labels.select(F.col("id").alias("b"), "group_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group_id").alias("near"))
        lower = labels.join(near, "id").select("id", "group_id", F.least("group_id", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("group_id").alias("far"))
        after = checkpoint(lower.join(jump, "low").select("id", F.least("low", "far").alias("next"), "group_id"))
        changed = after.where("next <> group_id").limit(1).count()
        labels = after.select("id", F.col("next").alias("group_id"))
        if not changed:
            return labels


def canonical(groups: DataFrame, degrees: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, canonical_id): for each member of a group its entity of most mentions, then of the shortest name, then the smallest id."""
    known = groups.join(degrees, "id", "left").join(entities.select("id", F.length("name").alias("size")), "id", "left")
    order = Window.partitionBy("group_id").orderBy(F.desc(F.coalesce("degree", F.lit(0))), F.asc_nulls_last("size"), "id")
    return known.select("id", F.first("id").over(order).alias("canonical_id"))


def relabel(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between canonical entities (names: id, canonical_id), each once; those that become loops are dropped."""
    end = lambda c: names.select(F.col("id").alias(c), F.col("canonical_id").alias(f"{c}_to"))
    moved = edges.join(end("head"), "head", "left").join(end("tail"), "tail", "left")
    out = moved.select(F.coalesce("head_to", "head").alias("head"), "relation", F.coalesce("tail_to", "tail").alias("tail"), (F.col("head") == F.col("tail")).alias("was_loop"))
    return out.where(F.col("was_loop") | (F.col("head") != F.col("tail"))).select("head", "relation", "tail").distinct()


def orphans(touched: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Touched entities (id) without mentions of their own and without a neighbour that has some."""
    mentioned = mentions.select(F.col("entity_id").alias("id")).distinct()
    beside = undirected(edges).join(mentioned, F.col("other") == F.col("id"), "left_semi").select(F.col("node").alias("id")).distinct()
    return touched.select("id").distinct().join(mentioned, "id", "left_anti").join(beside, "id", "left_anti")


def coverage(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_mentioning, complete): whether every chunk of a document has mentions; a repeated chunk_id counts once."""
    named = mentions.select("chunk_id").distinct().withColumn("named", F.lit(1))
    each = chunks.select("doc_id", "chunk_id").distinct().join(named, "chunk_id", "left")
    counted = each.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count("named").alias("n_mentioning"))
    return counted.withColumn("complete", F.col("n_chunks") == F.col("n_mentioning"))


def without_documents(mentions: DataFrame, chunks: DataFrame, entities: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, entities) that are left when documents go: their chunks' mentions, and the touched entities that become orphans."""
    lost = chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id").distinct()
    left = mentions.distinct().join(lost, "chunk_id", "left_anti")
    touched = mentions.join(lost, "chunk_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    return left, entities.join(orphans(touched, left, linked_terms(left)), "id", "left_anti")


def linkable(pairs: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (chunk_id, entity_id) pairs both of whose ends exist."""
    both = pairs.select("chunk_id", "entity_id").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return both.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def linked_terms(mentions: DataFrame, relation: str = "next") -> DataFrame:
    """(head, relation, tail): entities that follow one another in the order of ids within a chunk's mentions.

    Linking only neighbours in that order, not all pairs, keeps a chunk of n entities at n - 1 edges.
    """
    order = Window.partitionBy("chunk_id").orderBy("entity_id")
    chained = mentions.select("chunk_id", "entity_id").distinct().withColumn("tail", F.lead("entity_id").over(order))
    return chained.where("tail IS NOT NULL").select(F.col("entity_id").alias("head"), F.lit(relation).alias("relation"), "tail").distinct()
