"""Queries of the graph of entities and mentions.

Edges link entities that follow one another in the order of ids within a chunk's mentions; the
query set is every chunk whose row number is divisible by 100, its seeds what it mentions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions.status import visible
from corpuscle.operators import alike_vectors, fusion, graph, search
from corpuscle.plans import retrieval
from corpuscle.session import shared_table
from corpuscle.sources.tables import table


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mentions")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.linked_terms(_mentions(spark, folder))


def linkable(spark: SparkSession, folder: str) -> DataFrame:
    return graph.linkable(_mentions(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "entities"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


def degrees(spark: SparkSession, folder: str) -> DataFrame:
    sides = graph.undirected(_edges(spark, folder))
    return sides.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"), F.count_distinct("relation").alias("n_relations"))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of a query: what its chunk mentions; the score falls with the number of mentions of the entity."""
    often = _mentions(spark, folder).distinct().groupBy("entity_id").agg(F.count("*").alias("n"))
    asked = table(spark, folder, "chunks").where(retrieval.ASKED).select(F.col("chunk_row").alias("query_id"), "chunk_id")
    own = asked.join(_mentions(spark, folder).distinct(), "chunk_id").join(often, "entity_id")
    return own.select("query_id", F.col("entity_id").alias("node"), F.round(1 / F.sqrt(F.col("n").cast("double")), 6).alias("score"))


def seed_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _seeds(spark, folder)


def seed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The three labels whose mean vectors are most similar to a vector; queries are the vec_ids divisible by 100."""
    vectors = table(spark, folder, "embeddings").where(F.size("embedding") > 0)
    means = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    asked = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.dense_topk(asked, centres.select(F.col("label").alias("row"), F.col("c").alias("vector")), 3, retrieval.WIDTH)
    return found.withColumnRenamed("row", "label")


def expand_hops(spark: SparkSession, folder: str) -> DataFrame:
    return graph.expand(_seeds(spark, folder), _edges(spark, folder), 2)


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best facts of each query within two hops: by hop, then by score, then by name."""
    seeds = _seeds(spark, folder)
    scored = graph.score_facts(graph.expand(seeds, _edges(spark, folder), 2), seeds)
    order = Window.partitionBy("query_id").orderBy("hop", F.desc("score"), "head", "relation", "tail")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 50).withColumn("place", F.col("place").cast("long"))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder)


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    found = _facts(spark, folder).select("query_id", F.explode(F.array("head", "tail")).alias("node"))
    return _seeds(spark, folder).select("query_id", "node").unionByName(found).distinct()


def _mentioning(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "chunks").where(visible(F.col("status")))
    return graph.mentioning(_nodes(spark, folder), _mentions(spark, folder), seen, 60)


def mention_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _mentioning(spark, folder)


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    chunk_ids = table(spark, folder, "chunks").select(F.col("chunk_row").alias("row"), "chunk_id")
    dense = retrieval.dense_topk(spark, folder).join(chunk_ids, "row").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return graph.merge_candidates(dense, _mentioning(spark, folder))


def graph_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)


def graph_only(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("from_graph").alias("n_graph_only"), F.count_if(F.col("graph_hits") > 0).alias("n_graph"))


def attached_facts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.attach_facts(_mentioning(spark, folder), _mentions(spark, folder), _facts(spark, folder))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities, and each of their spellings as an entity of its own, as an extraction that does not know them would write it."""
    given = table(spark, folder, "entities").select("id", "name", "label", "aliases")
    spelled = given.select(F.explode("aliases").alias("name")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return given.unionByName(spelled.select(F.concat(F.lit("v"), F.md5(F.col("name").cast("binary"))).alias("id"), "name", none("string").alias("label"), none("array<string>").alias("aliases")))


def entity_dupes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.alike_names(_entities(spark, folder), graph.name_stem)


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(entity_dupes(spark, folder))


def entity_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder)


def _alike_vectors(spark: SparkSession, folder: str, links_only: bool = False) -> DataFrame:
    return alike_vectors.alike_vectors(table(spark, folder, "chunks"), "chunk_row", "dense", retrieval.WIDTH, 0.97, links_only)


def vector_dupes(spark: SparkSession, folder: str) -> DataFrame:
    """Every two chunks of a cosine of 0.97 or more; of chunks with identical vectors the first one stands for all."""
    return _alike_vectors(spark, folder)


def vector_groups(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(shared_table(_alike_vectors(spark, folder, links_only=True)))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    often = _mentions(spark, folder).distinct().groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("degree"))
    return graph.canonical(_groups(spark, folder), often, _entities(spark, folder))


def canonical_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _names(spark, folder)


def relabel_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges, and those that the spellings of their heads would have, between canonical entities."""
    edges = _edges(spark, folder)
    spelled = table(spark, folder, "entities").select(F.col("id").alias("head"), F.get("aliases", F.lit(0)).alias("name")).where("name IS NOT NULL")
    other = edges.join(spelled, "head").select(F.concat(F.lit("v"), F.md5(F.col("name").cast("binary"))).alias("head"), "relation", "tail")
    return graph.relabel(edges.unionByName(other), _names(spark, folder))


def orphan_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that lose all mentions when the superseded chunks go."""
    seen = table(spark, folder, "chunks").where(visible(F.col("status"))).select("chunk_id").distinct()
    left = _mentions(spark, folder).join(seen, "chunk_id", "left_semi")
    return graph.orphans(table(spark, folder, "entities"), left, graph.linked_terms(left))


def graph_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return graph.coverage(table(spark, folder, "chunks"), _mentions(spark, folder))


def missing_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with mentions in chunks that the visible collection lacks, and in how many."""
    seen = table(spark, folder, "chunks").where(visible(F.col("status"))).select("chunk_id").distinct()
    return _mentions(spark, folder).distinct().join(seen, "chunk_id", "left_anti").groupBy("entity_id").agg(F.count("*").alias("n_missing"))


def entities_left(spark: SparkSession, folder: str) -> DataFrame:
    """Entities after the first versions of documents have gone, with their mentions."""
    chunks = table(spark, folder, "chunks")
    mentions, entities = graph.without_documents(_mentions(spark, folder), chunks, table(spark, folder, "entities"), chunks.where("doc_version = 'v1'"))
    often = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    return entities.select("id").join(often, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_mentions"))


def tie_of_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded seed scores, cut at a threshold with a floor of one seed for each query."""
    scored = _seeds(spark, folder).select("query_id", F.col("node").alias("row"), F.round("score", 1).alias("score"))
    return fusion.threshold_floor(scored, 0.4, 1, 10)


NAMES = (
    "linkable edges degrees seed_entities seed_labels expand_hops facts mention_lookup graph_merge graph_only attached_facts entity_dupes entity_groups vector_dupes vector_groups canonical_entities relabel_edges "
    "orphan_entities graph_coverage missing_chunks entities_left tie_of_seeds"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "　"
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "
_SEEDS = """pairs AS (SELECT DISTINCT chunk_id, entity_id FROM mentions), often AS (SELECT entity_id, count(*) AS n FROM pairs GROUP BY ALL),
seeds AS (SELECT chunk_row AS query_id, entity_id AS node, round(1 / sqrt(n), 6) AS score FROM chunks JOIN pairs USING (chunk_id) JOIN often USING (entity_id) WHERE chunk_row % 100 = 0),
edges AS (SELECT DISTINCT entity_id AS head, 'next' AS relation, tail FROM (SELECT *, lead(entity_id) OVER (PARTITION BY chunk_id ORDER BY encode(entity_id)) AS tail FROM pairs) WHERE tail IS NOT NULL),
sides AS (SELECT head AS node, tail AS other, * FROM edges UNION ALL SELECT tail, head, * FROM edges)"""
_FACTS = """one AS (SELECT DISTINCT query_id, head, relation, tail, other, 1 AS hop FROM (SELECT DISTINCT query_id, node FROM seeds) JOIN sides USING (node)),
two AS (SELECT DISTINCT o.query_id, s.head, s.relation, s.tail, 2 AS hop FROM one o JOIN sides s ON s.node = o.other WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = o.query_id AND x.node = o.other)),
hops AS (SELECT query_id, head, relation, tail, CAST(min(hop) AS BIGINT) AS hop FROM (SELECT query_id, head, relation, tail, hop FROM one UNION ALL FROM two) GROUP BY ALL),
best AS (SELECT query_id, node, max(score) AS s FROM seeds GROUP BY ALL),
facts AS (SELECT query_id, head, relation, tail, hop, score, p AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, score DESC, encode(head), encode(relation), encode(tail)) AS p FROM (
  SELECT h.*, greatest(0, coalesce(a.s, 0), coalesce(b.s, 0)) AS score FROM hops h LEFT JOIN best a ON a.query_id = h.query_id AND a.node = head LEFT JOIN best b ON b.query_id = h.query_id AND b.node = tail)) WHERE p <= 50)"""
_LOOKUP = """nodes AS (SELECT query_id, node FROM seeds UNION SELECT query_id, head FROM facts UNION SELECT query_id, tail FROM facts),
found AS (SELECT query_id, chunk_id, hits, p - 1 AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS p FROM (
  SELECT query_id, chunk_id, count(*) AS hits FROM nodes JOIN pairs ON entity_id = node WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE coalesce(status, '') <> 'superseded') GROUP BY ALL)) WHERE p <= 60)"""
_UP = f"WITH {_SEEDS}, {_FACTS}, {_LOOKUP}"
_MERGED = f"""{retrieval._BASE}, {_SEEDS}, {_FACTS}, {_LOOKUP}, dense AS (SELECT query_id, chunk_id, max(score) AS score FROM d10 JOIN chunks ON chunk_row = "row" GROUP BY ALL),
merged AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score, coalesce(hits, 0) AS graph_hits, score IS NULL AS from_graph FROM dense FULL JOIN found USING (query_id, chunk_id))"""
_ALIKE = f"""ents AS (SELECT id, name, label, aliases FROM entities UNION ALL SELECT DISTINCT 'v' || md5(a), a, NULL, NULL FROM (SELECT unnest(aliases) AS a FROM entities)),
named AS (SELECT DISTINCT id, plain FROM (SELECT id, regexp_replace(lower(regexp_replace(regexp_replace(translate(w, '{_WIDE}', '{_ASCII}'), '\\s+', '', 'g'), '^["''“”‘’《〈「『【\\[(]+|["''“”‘’》〉」』】\\])]+$', '', 'g')), '[a-z]{{2}}-[0-9]+$', '') AS plain
  FROM (SELECT id, unnest(list_append(coalesce(aliases, []), name)) AS w FROM ents)) WHERE plain <> ''),
alike AS (SELECT DISTINCT a, id AS b FROM named JOIN (SELECT plain, arg_min(id, encode(id)) AS a FROM named GROUP BY plain) USING (plain) WHERE id <> a),
links AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike)"""
_GROUPED = f"""WITH RECURSIVE {_ALIKE}, reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
grouped AS (SELECT id, arg_min(other, encode(other)) AS group_id FROM reach GROUP BY id)"""
_CANON = f"""{_GROUPED}, {_SEEDS}, canon AS (SELECT g.id, first_value(g.id) OVER (PARTITION BY group_id ORDER BY coalesce(n, 0) DESC, length(e.name) NULLS LAST, encode(g.id)) AS canonical_id
  FROM grouped g LEFT JOIN often o ON o.entity_id = g.id LEFT JOIN ents e ON e.id = g.id)"""
_ALIKE_VECTORS = """given AS (SELECT chunk_row, dense, list_transform(dense, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks
  WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
firsts AS (SELECT dense, min(chunk_row) AS first FROM given GROUP BY dense),
units AS MATERIALIZED (SELECT chunk_row, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) :: DOUBLE[64] AS u FROM given JOIN firsts ON first = chunk_row),
near_vectors AS MATERIALIZED (SELECT p.chunk_row AS a, q.chunk_row AS b FROM units p JOIN units q ON p.chunk_row < q.chunk_row AND round(array_inner_product(p.u, q.u), 9) >= 0.97
  UNION SELECT first, chunk_row FROM given JOIN firsts USING (dense) WHERE chunk_row <> first)"""

ORACLES = {
    "linkable": "SELECT DISTINCT chunk_id, entity_id FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM chunks) AND entity_id IN (SELECT id FROM entities)",
    "edges": f"WITH {_SEEDS} SELECT * FROM edges",
    "degrees": f"WITH {_SEEDS} SELECT node AS id, count(*) AS degree, count(DISTINCT relation) AS n_relations FROM sides GROUP BY node",
    "seed_entities": f"WITH {_SEEDS} SELECT * FROM seeds",
    "seed_labels": """WITH parts AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
      centres AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label),
      s AS (SELECT vec_id AS query_id, CAST(c.label AS BIGINT) AS label, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c)), 9) AS score
        FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 100 = 0), centres c)
      SELECT query_id, label, score, p - 1 AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS p FROM s) WHERE p <= 3""",
    "expand_hops": f"WITH {_SEEDS}, {_FACTS} SELECT * FROM hops",
    "facts": f"WITH {_SEEDS}, {_FACTS} SELECT * FROM facts",
    "mention_lookup": f"{_UP} SELECT * FROM found",
    "graph_merge": f"{_MERGED} SELECT * FROM merged",
    "graph_only": f"{_MERGED} SELECT query_id, count(*) AS n, count(*) FILTER (from_graph) AS n_graph_only, count(*) FILTER (graph_hits > 0) AS n_graph FROM merged GROUP BY ALL",
    "attached_facts": f"""{_UP} SELECT query_id, chunk_id, head, relation, tail, p AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, encode(head), encode(relation), encode(tail)) AS p
      FROM (SELECT DISTINCT query_id, chunk_id, head, relation, tail, score FROM found JOIN pairs USING (chunk_id) JOIN facts f USING (query_id) WHERE entity_id IN (head, f.tail))) WHERE p <= 8""",
    "entity_dupes": f"WITH {_ALIKE} SELECT * FROM alike",
    "entity_groups": f"{_GROUPED} SELECT * FROM grouped",
    "vector_dupes": f"WITH {_ALIKE_VECTORS} SELECT a, b FROM near_vectors",
    "vector_groups": f"""WITH RECURSIVE {_ALIKE_VECTORS}, near AS (SELECT a, b FROM near_vectors UNION SELECT b, a FROM near_vectors),
      reach AS (SELECT a AS id, a AS other FROM near UNION SELECT r.id, l.b FROM reach r JOIN near l ON l.a = r.other) SELECT id, min(other) AS group_id FROM reach GROUP BY id""",
    "canonical_entities": f"{_CANON} SELECT * FROM canon",
    "relabel_edges": f"""{_CANON} SELECT DISTINCT coalesce(a.canonical_id, head) AS head, relation, coalesce(b.canonical_id, tail) AS tail FROM (FROM edges UNION ALL SELECT 'v' || md5(aliases[1]), relation, tail FROM edges JOIN entities ON id = head WHERE len(aliases) > 0) LEFT JOIN canon a ON a.id = head LEFT JOIN canon b ON b.id = tail
      WHERE coalesce(a.canonical_id, head) <> coalesce(b.canonical_id, tail)""",
    "orphan_entities": """WITH leftover AS (SELECT DISTINCT chunk_id, entity_id FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE coalesce(status, '') <> 'superseded'))
      SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM leftover)""",
    "graph_coverage": """SELECT doc_id, count(*) AS n_chunks, count(m.chunk_id) AS n_mentioning, count(*) = count(m.chunk_id) AS complete FROM (SELECT DISTINCT doc_id, chunk_id FROM chunks)
      LEFT JOIN (SELECT DISTINCT chunk_id FROM mentions) m USING (chunk_id) GROUP BY doc_id""",
    "missing_chunks": """SELECT entity_id, count(*) AS n_missing FROM (SELECT DISTINCT * FROM mentions) WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE coalesce(status, '') <> 'superseded') GROUP BY ALL""",
    "entities_left": """WITH lost AS (SELECT DISTINCT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM chunks WHERE doc_version = 'v1')), pairs AS (SELECT DISTINCT * FROM mentions WHERE chunk_id NOT IN (FROM lost)),
      touched AS (SELECT DISTINCT entity_id FROM mentions WHERE chunk_id IN (FROM lost)), often AS (SELECT entity_id, count(*) AS n FROM pairs GROUP BY ALL)
      SELECT id, coalesce(n, 0) AS n_mentions FROM entities LEFT JOIN often ON entity_id = id WHERE n > 0 OR id NOT IN (FROM touched)""",
    "tie_of_seeds": f"""WITH {_SEEDS}, t AS (SELECT query_id, node AS "row", round(score, 1) AS score FROM seeds), c AS (SELECT *, row_number() OVER w AS p, count(*) FILTER (score >= 0.4) OVER (PARTITION BY query_id) AS n FROM t
      WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, encode("row")))
      SELECT query_id, "row", score, p - 1 AS "rank" FROM c WHERE (score >= 0.4 OR (n < 1 AND p <= 1)) AND p <= 10""",
}
