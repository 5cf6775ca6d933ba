"""Queries of the stored collection: identities, clean-up, listings, ingest and status changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import ids, text, vectors
from corpuscle.functions.status import plain_status, visible
from corpuscle.operators import graph, segment, store
from corpuscle.sources.tables import table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "kb_docs")


def doc_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_row", ids.content_hash(F.col("text")).alias("h"), ids.path_id(F.col("source")).alias("path_id"), ids.slug(F.col("source")).alias("slug"))


def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    made = ids.chunk_id(F.col("doc_id"), F.col("chunk_index"))
    return _chunks(spark, folder).select("chunk_row", made.alias("point_id"), (made == F.col("chunk_id")).alias("as_stored"))


def hash_states(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).where("text IS NOT NULL").groupBy(store.hash_state().alias("state")).agg(F.count("*").alias("n"))


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    plain = text.normalize_text(F.col("text"))
    return _docs(spark, folder).select("doc_row", F.length(plain).cast("long").alias("n_chars"), F.sha1(plain.cast("binary")).alias("h"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A null text has no spans."""
    return table(spark, folder, "documents").select("doc_id", F.coalesce(F.array_size(text.sentences(F.col("text"))), F.lit(0)).cast("long").alias("n_spans"))


def sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = _docs(spark, folder).select("doc_row", F.posexplode(text.sentences(F.col("text"))).alias("ord", "span"))
    return spans.select("doc_row", F.col("ord").cast("long").alias("ord"), F.sha1(F.col("span").cast("binary")).alias("h"), text.is_heading(F.col("span")).alias("heading"))


def doc_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_row", text.guess_title(text.normalize_text(F.col("text")), F.col("source"), F.col("doc_id")).alias("guessed"))


def version_hints(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_row", text.version_hint(F.col("source")).alias("v")).select("doc_row", "v.*")


def embed_cost(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _chunks(spark, folder).select(F.length("text").alias("plain"), F.length(text.embed_text(F.col("text"), F.col("context"))).alias("full")).where("plain IS NOT NULL")
    return sizes.agg(F.count("*").alias("n"), F.sum("plain").alias("chars_plain"), F.sum("full").alias("chars_context"), F.round((F.sum("full") / F.sum("plain") - 1) * 100, 4).alias("growth_percent"))


def visible_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).where(visible(F.col("status"))).select("chunk_row", plain_status(F.col("status")).alias("status"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return store.backfill_status(_chunks(spark, folder)).groupBy("status").agg(F.count("*").alias("n"))


def list_docs(spark: SparkSession, folder: str) -> DataFrame:
    return store.list_documents(_chunks(spark, folder))


def docs_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = _chunks(spark, folder).where(text.keyword_match("锅炉", F.col("source"), F.col("title")))
    return found.groupBy("source").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))


def doc_detail(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_row")
    cited = text.citation(F.col("title"), F.col("source"), F.col("doc_id"), F.col("chunk_index"))
    return _chunks(spark, folder).select("doc_id", "chunk_row", F.row_number().over(order).cast("long").alias("at"), cited.alias("cited"), text.clip(F.col("text"), 40).alias("start"))


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the collection; each table is read once."""
    mentions = table(spark, folder, "mentions").distinct()
    sides = [
        _chunks(spark, folder).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.count_if(visible(F.col("status"))).alias("visible")),
        table(spark, folder, "entities").agg(F.count("*").alias("entities"), F.count("label").alias("labelled")),
        mentions.agg(F.count("*").alias("mentions")), graph.linked_terms(mentions).agg(F.count("*").alias("relations")),
    ]
    rows = [side.unpivot([], side.columns, "name", "value") for side in sides]
    return reduce(DataFrame.unionByName, rows)


def locate_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    at = F.instr(F.lower("text"), "cooling tower")
    found = docs.select("doc_id", "text", at.alias("at"), F.contains("text", F.lit("cooling tower")).alias("exact")).where("at > 0")
    return found.select("doc_id", (F.col("at") - 1).cast("long").alias("offset"), F.expr("substring(text, greatest(at - 12, 1), 37)").alias("preview"), "exact")


def same_starts(spark: SparkSession, folder: str) -> DataFrame:
    starts = _chunks(spark, folder).select("doc_id", F.substring(F.col("text"), 1, 30).alias("snippet")).where("length(snippet) > 0")
    each = starts.groupBy("snippet").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
    return each.select(F.sha1(F.col("snippet").cast("binary")).alias("snippet"), "n", "n_docs", (F.col("n") == 1).alias("is_unique"), (F.col("n_docs") > 1).alias("crosses"))


def _latest_docs(spark: SparkSession, folder: str) -> DataFrame:
    return store.latest(_docs(spark, folder), ["doc_id"], F.desc_nulls_last("loaded_at"), F.desc("doc_row"))


def anchor_check(spark: SparkSession, folder: str) -> DataFrame:
    docs = _latest_docs(spark, folder).select("doc_id", F.col("text").alias("whole"), F.lit(True).alias("known"))
    both = _chunks(spark, folder).select("chunk_row", "doc_id", "start_pos", "end_pos", F.substring(F.col("text"), 1, 30).alias("snippet")).join(docs, "doc_id", "left")
    kind = (
        F.when(F.col("known").isNull(), "no_document").when(F.length(F.coalesce("snippet", F.lit(""))) == 0, "no_text").when(F.col("whole").isNull(), "no_whole")
        .when(F.col("start_pos").isNull() | F.col("end_pos").isNull(), "no_position")
        .when(F.col("end_pos") > F.length("whole"), "out_of_range")
        .when(F.expr("substring(whole, int(start_pos) + 1, length(snippet))") == F.col("snippet"), "ok")
        .when(F.contains("whole", "snippet"), "elsewhere").otherwise("mismatch")
    )
    return both.select("chunk_row", kind.alias("kind"))


def changed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The first load of every document against its latest one, each as one piece."""
    piece = lambda df: df.select("doc_id", F.lit(0).alias("chunk_index"), F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    first = store.latest(_docs(spark, folder), ["doc_id"], F.asc_nulls_first("loaded_at"), F.asc("doc_row"))
    return store.document_state(piece(first), piece(_latest_docs(spark, folder)))


def duplicate_content(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("length(text) > 0").select("doc_id", ids.content_hash(F.col("text")).alias("h"))
    return docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder).select("chunk_id", "chunk_row", "ingested_at", "status")
    early, late = chunks.where("chunk_row % 2 = 0"), chunks.where("chunk_row % 2 = 1")
    order = (F.desc_nulls_last("ingested_at"), F.desc("chunk_row"))
    return store.upsert(store.latest(early, ["chunk_id"], *order), late, ["chunk_id"], *order).select("chunk_id", "chunk_row")


def replace_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were loaded again take the place of their chunks, as one new chunk each."""
    again = _docs(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    new = _latest_docs(spark, folder).join(again, "doc_id", "left_semi").select("doc_id", F.lit(0).alias("chunk_index"), F.lit(None).cast("long").alias("chunk_row"))
    return store.replace_documents(_chunks(spark, folder).select("doc_id", "chunk_index", "chunk_row"), new)


def delete_docs(spark: SparkSession, folder: str) -> DataFrame:
    blank = _docs(spark, folder).where("text IS NULL OR trim(text) = ''")
    return store.delete_documents(_chunks(spark, folder), blank).groupBy("doc_id").agg(F.count("*").alias("n"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return store.mark_superseded(chunks, chunks.where("doc_version = 'v1'"), "replaced by a later version")


def mark_superseded(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("chunk_row", "status", "previous_status", "outcome")


def restore_marked(spark: SparkSession, folder: str) -> DataFrame:
    marked = _marked(spark, folder)
    return store.restore(marked, marked.where("outcome = 'marked'")).select("chunk_row", "status", "previous_status")


def set_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Every document gets the version of its first rule text, its first chunk a section of its own."""
    docs = _docs(spark, folder)
    whole = docs.select("doc_id", F.lit(None).cast("int").alias("chunk_index"), F.col("rule_no").alias("doc_version"), F.lit(None).cast("string").alias("section"))
    first = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("doc_version"), F.lit("开头").alias("section"))
    changed = store.set_payload(_chunks(spark, folder).select("chunk_row", "doc_id", "chunk_index", "doc_version", "section"), whole.unionByName(first), ["doc_version", "section"])
    return changed.select("chunk_row", "doc_version", "section", "n_set")


def hinted_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of chunks: what is stored, and what the source's name says only where nothing is."""
    hint = text.version_hint(F.col("source"))
    some = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), hint[c]).alias(c)
    return _chunks(spark, folder).select("chunk_row", *(some(c) for c in ("doc_version", "effective_from", "effective_to")))


def doc_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose source or title holds a word, the largest first, with the totals of all documents beside them."""
    chunks = _chunks(spark, folder)
    named = text.keyword_match("冷凝器", F.col("source"), F.col("title"))
    each = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(named).alias("found"))
    totals = each.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("total_chunks"), F.count_if("found").alias("n_found")).first()
    beside = [F.lit(value).cast("long").alias(name) for name, value in totals.asDict().items()]
    return each.where("found").select("doc_id", "n_chunks", *beside).orderBy(F.desc("n_chunks"), "doc_id")


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Norm and first number of each usable vector after normalisation."""
    own = _chunks(spark, folder).where(vectors.usable(F.col("dense"), 64)).select("chunk_row", vectors.normalised(F.col("dense")).alias("u"))
    return own.select("chunk_row", F.round(vectors.norm(F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def chunk_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """How many characters other than blanks the chunks of each document hold at least once, and how many chunks are not what stands at their place."""
    docs = _docs(spark, folder)
    cut = segment.chunk_documents(docs, "doc_row", "text").join(docs.select("doc_row", F.col("text").alias("whole")), "doc_row")
    order = Window.partitionBy("doc_row").orderBy("chunk_index")
    placed = cut.withColumn("before", F.coalesce(F.lag("end_pos").over(order), F.lit(0)))
    same = (F.col("text") == F.substring(F.col("whole"), F.col("start_pos").cast("int") + 1, F.length("text"))) & (F.length("text") == F.col("end_pos") - F.col("start_pos"))
    new = F.substring("text", F.greatest(F.lit(0), F.col("before") - F.col("start_pos")).cast("int") + 1, F.length("text"))
    each = placed.groupBy("doc_row").agg(F.sum(F.length(F.regexp_replace(new, r"[\s\p{Z}\x1c-\x1f\x85]+", ""))).alias("n_kept"), F.count_if(~same).alias("n_wrong"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_row").join(each, "doc_row", "left").select("doc_row", zero("n_kept"), zero("n_wrong"))


def fetch_chunks(spark: SparkSession, folder: str) -> DataFrame:
    keys = _docs(spark, folder).select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(2), F.lit(9))).alias("chunk_index"))
    return store.fetch_chunks(_chunks(spark, folder), keys).select("chunk_row", "doc_id", "chunk_index")


def roundrobin_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's long fragments, dealt out in rounds (the sampling operator takes 500)."""
    long = _chunks(spark, folder).where("length(trim(text)) >= 80").select("doc_id", "chunk_row", F.md5(F.col("chunk_row").cast("string")).alias("key"))
    dealt = long.withColumn("round", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")).cast("long"))
    return dealt.orderBy("round", "doc_id", "key").limit(500).select("doc_id", "chunk_row", "round")


def truncated(spark: SparkSession, folder: str) -> DataFrame:
    short = text.truncate_middle(F.col("text"), 800, 0.6, "\n……\n")
    return table(spark, folder, "documents").select("doc_id", F.length(short).cast("long").alias("n_chars"), F.sha1(short.cast("binary")).alias("h"))


def chunked(spark: SparkSession, folder: str) -> DataFrame:
    return segment.chunk_documents(_docs(spark, folder), "doc_row", "text")


NAMES = (
    "doc_ids point_ids hash_states normalize_text sentence_counts sentence_spans doc_titles version_hints embed_cost visible_chunks status_counts list_docs docs_filter doc_detail stats "
    "locate_text same_starts anchor_check changed_docs duplicate_content upsert_latest replace_docs delete_docs mark_superseded restore_marked fetch_chunks roundrobin_sample truncated chunked set_payload hinted_versions doc_totals unit_vectors chunk_anchors"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), '　' || chr(160), '  '),
  '[\x{FEFF}\x{200B}\x{200C}\x{200D}]', '', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"""
_SPANS = r"""list_filter(regexp_extract_all(text, '[^\n。！？；!?;…]*[。！？；!?;…][。！？；!?;…」』”’）)》〉】〕｝"''\]}]*|[^\n。！？；!?;…]+'), lambda x: regexp_matches(x, '[^\s\x0B]'))"""
_CITED = "coalesce(nullif(title, ''), nullif(source, ''), doc_id) || ' (块 ' || chunk_index || ')'"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, doc_row DESC) AS p FROM kb_docs) WHERE p = 1)"
_LIST = """listed AS (SELECT doc_id, count(*) AS n_chunks, CASE WHEN bool_or(coalesce(status, '') = 'superseded') THEN 'superseded' ELSE 'current' END AS status,
  bool_or(coalesce(status, '') = 'superseded') AND NOT bool_and(coalesce(status, '') = 'superseded') AS mixed,
  first(nullif(doc_version, '') ORDER BY chunk_index, chunk_row) FILTER (coalesce(doc_version, '') <> '') AS doc_version, first(title ORDER BY chunk_index, chunk_row) FILTER (coalesce(title, '') <> '') AS title FROM chunks GROUP BY doc_id)"""
_MARKED = f"""{_LIST}, marked AS (SELECT c.*, CASE WHEN o.mixed THEN 'denied' WHEN o.status = 'superseded' THEN 'unchanged' WHEN o.status IS NOT NULL THEN 'marked' END AS outcome
  FROM chunks c LEFT JOIN (SELECT * FROM listed WHERE doc_id IN (SELECT doc_id FROM chunks WHERE doc_version = 'v1')) o USING (doc_id))"""

ORACLES = {
    "doc_ids": """SELECT doc_row, sha1(text) AS h, left(sha1(lower(replace(source, chr(92), '/'))), 16) AS path_id,
      coalesce(nullif(left(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 24), ''), 'corpus') AS slug FROM kb_docs""",
    "point_ids": """SELECT chunk_row, u AS point_id, u = chunk_id AS as_stored FROM (SELECT *, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(strpos('0123456789abcdef', h[17:17]) - 1 AS BIGINT) % 4 + 1, 1)
      || h[18:20] || '-' || h[21:32] AS u FROM (SELECT *, sha1(unhex('a3f1c2d45b6e4f7a8c9d0e1f2a3b4c5d') || encode(doc_id || '::' || chunk_index)) AS h FROM chunks))""",
    "hash_states": "SELECT CASE WHEN content_hash IS NULL THEN 'missing' WHEN content_hash = sha1(text) THEN 'ok' ELSE 'stale' END AS state, count(*) AS n FROM chunks WHERE text IS NOT NULL GROUP BY ALL",
    "normalize_text": f"SELECT doc_row, length(n) AS n_chars, sha1(n) AS h FROM (SELECT doc_row, {_NORMAL} AS n FROM kb_docs)",
    "sentence_counts": f"SELECT doc_id, coalesce(len({_SPANS}), 0) AS n_spans FROM documents",
    "sentence_spans": f"""SELECT doc_row, ord - 1 AS ord, sha1(span) AS h, regexp_matches(span, '^\\s*(?:第[一二三四五六七八九十百零0-9]+[章节篇部]|#{{1,6}}\\s*[^\\s]|[0-9]+(?:\\.[0-9]+){{0,3}}[、.\\s]\\s*[^\\s])') AND length(trim(span)) <= 60 AS heading
      FROM (SELECT doc_row, unnest(range(1, len(s) + 1)) AS ord, unnest(s) AS span FROM (SELECT doc_row, {_SPANS} AS s FROM kb_docs))""",
    "doc_titles": f"""SELECT doc_row, coalesce(left(nullif(trim(regexp_extract(left(n, 2000), '(?m)^[ ]{{0,3}}#{{1,6}}[ \\t]+([^\\n]+?)[ \\t]*#*[ \\t]*$', 1)), ''), 120),
      list_filter(list_transform(string_split(n, chr(10))[1:30], lambda x: regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 40)[1],
      nullif(regexp_replace(regexp_extract(source, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), ''), doc_id) AS guessed FROM (SELECT *, {_NORMAL} AS n FROM kb_docs)""",
    "version_hints": r"""SELECT doc_row, 'v' || nullif(regexp_extract(f, '(?:^|[^A-Za-z0-9])[vV]([0-9]+(?:\.[0-9]+)*)(?:[^A-Za-z0-9]|$)', 1), '') AS doc_version, list_sort(d)[1] AS effective_from, list_sort(d)[2] AS effective_to
      FROM (SELECT doc_row, f, regexp_extract_all(f, '(?:^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})', 1)[1:2] AS d FROM (SELECT doc_row, regexp_extract(source, '([^/\\]*)$', 1) AS f FROM kb_docs))""",
    "embed_cost": """SELECT count(*) AS n, CAST(sum(p) AS BIGINT) AS chars_plain, CAST(sum(f) AS BIGINT) AS chars_context, round((sum(f) / sum(p) - 1) * 100, 4) AS growth_percent FROM (
      SELECT length(text) AS p, length(CASE WHEN coalesce(context, '') <> '' THEN context || chr(10) || text ELSE text END) AS f FROM chunks WHERE text IS NOT NULL)""",
    "visible_chunks": "SELECT chunk_row, 'current' AS status FROM chunks WHERE coalesce(status, '') <> 'superseded'",
    "status_counts": "SELECT coalesce(nullif(status, ''), 'current') AS status, count(*) AS n FROM chunks GROUP BY 1",
    "list_docs": f"WITH {_LIST} SELECT * FROM listed",
    "docs_filter": "SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM chunks WHERE contains(lower(source), '锅炉') OR contains(lower(title), '锅炉') GROUP BY source",
    "doc_detail": f"""SELECT doc_id, chunk_row, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_row) AS "at", {_CITED} AS cited,
      CASE WHEN length(text) > 40 THEN left(text, 40) || '…（省略 ' || (length(text) - 40) || ' 字）' ELSE text END AS "start" FROM chunks""",
    "stats": """SELECT 'chunks' AS name, count(*) AS value FROM chunks UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM chunks UNION ALL SELECT 'visible', count(*) FROM chunks WHERE coalesce(status, '') <> 'superseded'
      UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'labelled', count(label) FROM entities UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT * FROM mentions)
      UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT entity_id, tail FROM (SELECT *, lead(entity_id) OVER (PARTITION BY chunk_id ORDER BY encode(entity_id)) AS tail FROM (SELECT DISTINCT * FROM mentions)) WHERE tail IS NOT NULL)""",
    "locate_text": """SELECT doc_id, p - 1 AS "offset", substr(text, greatest(p - 12, 1), 37) AS preview, contains(text, 'cooling tower') AS exact FROM (SELECT *, strpos(lower(text), 'cooling tower') AS p FROM documents) WHERE p > 0""",
    "same_starts": "SELECT sha1(s) AS snippet, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(*) = 1 AS is_unique, count(DISTINCT doc_id) > 1 AS crosses FROM (SELECT doc_id, left(text, 30) AS s FROM chunks WHERE text <> '') GROUP BY s",
    "anchor_check": f"""WITH {_LATEST} SELECT chunk_row, CASE WHEN l.doc_id IS NULL THEN 'no_document' WHEN coalesce(c.text, '') = '' THEN 'no_text' WHEN l.text IS NULL THEN 'no_whole' WHEN start_pos IS NULL OR end_pos IS NULL THEN 'no_position'
      WHEN end_pos > length(l.text) THEN 'out_of_range' WHEN substr(l.text, start_pos + 1, length(left(c.text, 30))) = left(c.text, 30) THEN 'ok' WHEN contains(l.text, left(c.text, 30)) THEN 'elsewhere' ELSE 'mismatch' END AS kind
      FROM chunks c LEFT JOIN latest l USING (doc_id)""",
    "changed_docs": f"""WITH {_LATEST}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at NULLS FIRST, doc_row) AS p FROM kb_docs) WHERE p = 1)
      SELECT doc_id, CASE WHEN f.doc_id IS NULL THEN 'new' WHEN coalesce(f.text, '') = coalesce(l.text, '') THEN 'unchanged' ELSE 'changed' END AS state FROM latest l LEFT JOIN firsts f USING (doc_id)""",
    "duplicate_content": "SELECT sha1(text) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    "upsert_latest": "SELECT chunk_id, chunk_row FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_row % 2 DESC, ingested_at DESC NULLS LAST, chunk_row DESC) AS p FROM chunks) WHERE p = 1",
    "replace_docs": f"""WITH again AS (SELECT doc_id FROM kb_docs GROUP BY doc_id HAVING count(*) > 1) SELECT doc_id, chunk_index, chunk_row FROM chunks WHERE doc_id NOT IN (FROM again)
      UNION ALL SELECT doc_id, 0, NULL FROM again""",
    "delete_docs": "SELECT doc_id, count(*) AS n FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM kb_docs WHERE text IS NULL OR trim(text) = '') GROUP BY doc_id",
    "mark_superseded": f"""WITH {_MARKED} SELECT chunk_row, CASE WHEN outcome = 'marked' THEN 'superseded' ELSE status END AS status, CASE WHEN outcome = 'marked' THEN 'current' END AS previous_status, outcome FROM marked""",
    "restore_marked": f"""WITH {_MARKED} SELECT chunk_row, CASE WHEN outcome = 'marked' THEN 'current' ELSE status END AS status, CAST(NULL AS VARCHAR) AS previous_status FROM marked""",
    "set_payload": """SELECT chunk_row, coalesce(v, doc_version) AS doc_version, CASE WHEN known AND chunk_index = 0 THEN '开头' ELSE section END AS section,
      CAST(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN known AND chunk_index = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_set FROM chunks LEFT JOIN (SELECT doc_id, max(rule_no) AS v, true AS known FROM kb_docs GROUP BY doc_id) USING (doc_id)""",
    "hinted_versions": r"""SELECT chunk_row, coalesce(nullif(doc_version, ''), 'v' || nullif(regexp_extract(f, '(?:^|[^A-Za-z0-9])[vV]([0-9]+(?:\.[0-9]+)*)(?:[^A-Za-z0-9]|$)', 1), '')) AS doc_version, coalesce(nullif(effective_from, ''), list_sort(d)[1]) AS effective_from,
      coalesce(nullif(effective_to, ''), list_sort(d)[2]) AS effective_to FROM (SELECT *, regexp_extract_all(f, '(?:^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})', 1)[1:2] AS d FROM (SELECT *, regexp_extract(source, '([^/\\]*)$', 1) AS f FROM chunks))""",
    "doc_totals": """WITH e AS (SELECT doc_id, count(*) AS n_chunks, bool_or(contains(lower(coalesce(source, '')), '冷凝器') OR contains(lower(coalesce(title, '')), '冷凝器')) AS found FROM chunks GROUP BY doc_id)
      SELECT doc_id, n_chunks, (SELECT count(*) FROM e) AS total_docs, (SELECT CAST(sum(n_chunks) AS BIGINT) FROM e) AS total_chunks, (SELECT count(*) FROM e WHERE found) AS n_found FROM e WHERE found""",
    "unit_vectors": """SELECT chunk_row, 1.0 :: DOUBLE AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS "first" FROM (SELECT chunk_row, list_transform(dense, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks
      WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0)""",
    "chunk_anchors": r"SELECT doc_row, CAST(coalesce(length(regexp_replace(text, '[\s\x0B\pZ\x{1C}-\x{1F}\x{85}]+', '', 'g')), 0) AS BIGINT) AS n_kept, CAST(0 AS BIGINT) AS n_wrong FROM kb_docs",
    "fetch_chunks": "SELECT chunk_row, doc_id, chunk_index FROM chunks WHERE chunk_index IN (0, 2, 9) AND doc_id IN (SELECT doc_id FROM kb_docs)",
    "roundrobin_sample": """SELECT doc_id, chunk_row, "round" FROM (SELECT doc_id, chunk_row, md5(CAST(chunk_row AS VARCHAR)) AS key, row_number() OVER (PARTITION BY doc_id ORDER BY md5(CAST(chunk_row AS VARCHAR))) AS "round" FROM chunks WHERE length(trim(text)) >= 80)
      ORDER BY "round", doc_id, key LIMIT 500""",
    "truncated": """SELECT doc_id, length(s) AS n_chars, sha1(s) AS h FROM (SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 477) || chr(10) || '……' || chr(10) || right(text, 319) ELSE text END AS s FROM documents)""",
}
