"""Queries of the text-preparation operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import format_copies, mixture, near_duplicates, personal, pieces, similar_vectors, tokens
from corpuscle.sources.tables import table


#: Length of the vectors of chunks, and how many most similar ones each has.
VECTOR_WIDTH, NEIGHBOURS = 64, 5


def _chunk_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.nearest_vectors(table(spark, folder, "chunks"), "chunk_row", "dense", VECTOR_WIDTH, NEIGHBOURS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.similar_pairs(_chunk_neighbours(spark, folder))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_neighbours(spark, folder).select(F.col("row").alias("chunk_row"), F.col("near").alias("near_row"), F.round("cosine", 9).alias("cosine"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_copies.format_copies(table(spark, folder, "chunks"), "chunk_row", "text")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return format_copies.collapsed_records(table(spark, folder, "chunks"), "chunk_row", "text")


#: Pairs of rule texts count from this similarity on (the statement of the problem fixes it).
RULE_SIMILARITY = 0.6


def _rule_texts(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.rule_texts(table(spark, folder, "chunks"), table(spark, folder, "kb_docs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(_rule_texts(spark, folder), RULE_SIMILARITY)


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_groups(_rule_texts(spark, folder), RULE_SIMILARITY)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.oversized_stretches(pieces.split_texts(table(spark, folder, "kb_docs"), "doc_row", "text", with_text=False), "doc_row")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_texts(table(spark, folder, "kb_docs"), "doc_row", "text")


def p5_checked(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "kb_docs")
    return pieces.checked_pieces(pieces.split_texts(docs, "doc_row", "text"), docs, "doc_row", "text")


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode_corpus(p6_ids(spark, folder), "doc_id", "ids")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    sized = mixture.sized_sources(tokens.token_counts(documents, "doc_id", "text"), documents)
    return mixture.mixture(sized, targets), targets


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(*_mixed(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_items(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redacted_texts(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_neighbours, p2_found, p2_records, p3_found, p3_groups, p5_found, p5_pieces, p5_checked,
        p6_ids, p6_decoded, p7_mixture, p7_shares, p8_found, p8_redacted,
    )
    return {query.__name__: query for query in every}


# Reduced texts character by character, apart from the expressions that the operators use.
_REDUCED = r"""
texts AS (SELECT level, chunk_row, text, list_filter(list_transform(regexp_split_to_array(text, '[；;\n]'),
              lambda x: regexp_replace(x, '^[\s\x0B\pZ\x{{1C}}-\x{{1F}}\x{{85}}]+|[\s\x0B\pZ\x{{1C}}-\x{{1F}}\x{{85}}]+$', '', 'g')), lambda x: x <> '') AS items
          FROM given WHERE text IS NOT NULL),
parts AS (SELECT level, chunk_row, CASE WHEN len(items) >= 3 AND len(list_filter(items, lambda x: NOT regexp_full_match(x, '[^：:]{{1,12}}[：:][^：:]+'))) = 0
              THEN items ELSE [text] END AS parts FROM texts),
pieces AS (SELECT level, chunk_row, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS part FROM parts),
plain AS (SELECT level, chunk_row, k, string_split(regexp_replace(lower(translate(part, '{wide}', '{narrow}')),
              '[\s\pZ\x{{1C}}-\x{{1F}}\x{{85}}\x{{200B}}-\x{{200D}}\x{{FEFF}}]+', '', 'g'), '') AS cs FROM pieces),
kept AS (SELECT level, chunk_row, k, array_to_string(list_filter(cs, lambda c, i: NOT regexp_full_match(c, '\pP')
              OR (i > 1 AND i < len(cs) AND cs[i - 1] BETWEEN '0' AND '9' AND cs[i + 1] BETWEEN '0' AND '9')), '') AS p FROM plain),
reduced AS (SELECT level, chunk_row, string_agg(p, '' ORDER BY encode(p)) AS r FROM kept GROUP BY level, chunk_row)
""".format(
    wide="".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "　",
    narrow="".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " ",
)


def oracle_sql() -> dict[str, str]:
    groups = f"WITH given AS (SELECT 'chunk' AS level, chunk_row, text FROM chunks), {_REDUCED}, g AS (SELECT r, min(chunk_row) AS first_row, count(*) AS n_copies FROM reduced WHERE r <> '' GROUP BY r)"
    rules = f"""WITH given AS (SELECT 'chunk' AS level, chunk_row, text FROM chunks UNION ALL SELECT 'document', doc_row, text FROM kb_docs), {_REDUCED},
      classes AS MATERIALIZED (SELECT level, r, row_number() OVER () AS c FROM reduced WHERE r <> '' GROUP BY level, r),
      grams AS MATERIALIZED (SELECT DISTINCT level, c, substr(r, k, 5) AS g FROM (SELECT *, unnest(range(1, greatest(2, length(r) - 3))) AS k FROM classes)),
      sizes AS MATERIALIZED (SELECT c, count(*) AS n FROM grams GROUP BY c),
      shared AS MATERIALIZED (SELECT x.c AS a, y.c AS b, count(*) AS s FROM grams x JOIN grams y ON x.g = y.g AND x.level = y.level AND x.c < y.c GROUP BY ALL),
      near AS (SELECT a, b FROM shared JOIN sizes p ON p.c = a JOIN sizes q ON q.c = b WHERE s >= {RULE_SIMILARITY} * (p.n + q.n - s)),
      members AS (SELECT level, c, chunk_row FROM reduced JOIN classes USING (level, r))"""
    units = """WITH units AS (SELECT chunk_row, list_transform(dense, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks
        WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
      cosines AS (SELECT a.chunk_row AS q, b.chunk_row AS o, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 9) AS s FROM units a JOIN units b ON a.chunk_row <> b.chunk_row),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) AS p FROM cosines) WHERE p <= 5)"""
    blank = r"[\s\x0B\pZ\x{1C}-\x{1F}\x{85}]"
    return {
        "p1_found": f"{units} SELECT DISTINCT least(q, o) AS row_a, greatest(q, o) AS row_b FROM best",
        "p1_neighbours": f"{units} SELECT q AS chunk_row, o AS near_row, s AS cosine FROM best",
        "p3_found": f"{rules} SELECT x.level, least(x.chunk_row, y.chunk_row) AS row_a, greatest(x.chunk_row, y.chunk_row) AS row_b FROM near JOIN members x ON x.c = a JOIN members y ON y.c = b",
        "p3_groups": f"""{rules.replace("WITH given", "WITH RECURSIVE given", 1)},
          firsts AS (SELECT level, c, min(chunk_row) AS class_row FROM members GROUP BY ALL),
          links AS MATERIALIZED (SELECT a AS x, b AS y FROM near UNION ALL SELECT b, a FROM near),
          reach AS (SELECT x AS s, y AS t FROM links UNION SELECT s, y FROM reach JOIN links ON t = x),
          groups AS (SELECT s AS c, min(class_row) AS group_row FROM reach JOIN firsts ON firsts.c = t GROUP BY s),
          degrees AS (SELECT x AS c, count(*) AS n FROM links GROUP BY x)
          SELECT m.level, m.chunk_row AS "row", class_row, coalesce(group_row, class_row) AS group_row, CAST(coalesce(n, 0) AS BIGINT) AS n_links
          FROM members m JOIN firsts USING (level, c) LEFT JOIN groups USING (c) LEFT JOIN degrees USING (c)""",
        "p5_checked": f"SELECT doc_row, CAST(coalesce(length(regexp_replace(text, '{blank}+', '', 'g')), 0) AS BIGINT) AS n_kept, CAST(0 AS BIGINT) AS n_wrong FROM kb_docs",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p5_found": f"""WITH cut AS (SELECT doc_row, regexp_extract_all(text, '[^\\r\\n。！？；!?;…]*[。！？；!?;…][。！？；!?;…」』”’）)》〉】〕｝"''\\]}}]*|[^\\r\\n。！？；!?;…]+|[\\r\\n]') AS s FROM kb_docs),
          placed AS (SELECT doc_row, unnest(s) AS t, unnest(list_transform(range(len(s)), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0))) AS pos FROM cut)
          SELECT doc_row, CAST(pos + length(t) - length(regexp_replace(t, '^{blank}+', '')) AS BIGINT) AS start_pos FROM placed WHERE length(regexp_replace(t, '^{blank}+|{blank}+$', '', 'g')) > 512""",
        "p2_found": f"{groups} SELECT first_row, chunk_row AS copy_row FROM reduced JOIN g USING (r) WHERE chunk_row <> first_row",
        "p2_records": f"{groups} SELECT first_row, n_copies FROM g",
    }
