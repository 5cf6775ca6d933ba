"""Identities of documents and chunks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of chunk ids.
CHUNK_NAMESPACE = "a3f1c2d4-5b6e-4f7a-8c9d-0e1f2a3b4c5d"


def content_hash(text: Column) -> Column:
    """SHA-1 of the text as it stands; null for null."""
    return F.sha1(text.cast("binary"))


def path_id(path: Column) -> Column:
    """First 16 hex characters of the SHA-1 of the lower-case path with ``/`` separators."""
    return F.substring(F.sha1(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).cast("binary")), 1, 16)


def name_uuid(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda start, size: F.substring(digest, start, size)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    """Id of a chunk: the UUID of ``doc_id::chunk_index``."""
    return name_uuid(CHUNK_NAMESPACE, F.concat(doc_id, F.lit("::"), chunk_index.cast("string")))


def slug(name: Column, most: int = 24) -> Column:
    """Lower-case ASCII slug, at most ``most`` characters, ``corpus`` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, most), F.lit("")), F.lit("corpus"))
