"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 5


def _struct(**kinds: str) -> T.StructType:
    """Fields by name; a question mark makes one nullable."""
    simple = {"string": T.StringType(), "long": T.LongType(), "integer": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, simple[kind.rstrip("?")], kind.endswith("?")) for name, kind in kinds.items()])


DOCUMENTS = _struct(paper_id="string", source_path="string", source_filename="string", source_sha256="string", paper_title="string?", title_source="string", parser_id="string", chunker_id="string", ingested_at="timestamp", updated_at="timestamp")
CHUNKS = _struct(
    chunk_id="string", vector_id="long?", paper_id="string", paper_title="string?", source="string", chunk_index="long", raw_text="string", embedding_text="string", section="string?", page_start="integer?", page_end="integer?",
    raw_token_count="long", embedding_token_count="long", prev_chunk_id="string?", next_chunk_id="string?", content_kind="string", front_matter_type="string?", section_type="string",
)
ITEMS = _struct(paper_id="string", pos="integer", label="string", text="string", level="integer?", page="integer?", l="double?", t="double?", r="double?", b="double?")
QUERY_PLANS = _struct(qid="long", original_query="string", semantic_query="string?", keywords="strings", search_bibliography="boolean", status="string")
ROUTE_HITS = _struct(qid="long", route="string", chunk_id="string", rank="integer", raw_score="double", weight="double")
CONTENT_KINDS = ("body", "front_matter")
SECTION_TYPES = ("content", "bibliography")
