"""Content-addressed keys: text hash, cache key, point id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with line ends made LF."""
    return F.sha2(F.regexp_replace(text, "\r\n|\r", "\n"), 256)


def cache_key(text_hash: Column, model: Column, version: Column) -> Column:
    """SHA-256 of the canonical JSON of what an embedding depends on; model and version are ASCII."""
    canon = F.to_json(F.struct(version.alias("artifact_version"), text_hash.alias("content_hash"), model.alias("embedding_model")))
    return F.sha2(canon, 256)


def point_id(key: Column) -> Column:
    """UUID version 5 of the key in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), key.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    at = lambda a, n: F.substring(digest, a, n)
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))
