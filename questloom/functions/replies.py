"""Strict reading of model replies: JSON text, perhaps inside a Markdown fence."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from questloom.functions.text import trim_space

# Reply shapes (field -> required JSON type) and the fence markers.
ROUTE_REPLY = {"route": "STRING"}
SQL_REPLY = {"query": "STRING"}
INTENT_REPLY = {"intent": "STRING", "filters": "ARRAY<STRING>"}
ANSWER_REPLY = {
    "answer_found": "BOOLEAN",
    "answer": "STRING",
    "exact_quote": "STRING",
    "source_chunk_id": "STRING",
}
OPENING_FENCE = r"\A```(json)?\n?"
CLOSING_FENCE = r"```\z"


def strip_fence(raw: Column) -> Column:
    """Drop one opening and one closing code fence and the white space around them."""
    body = F.regexp_replace(trim_space(raw), OPENING_FENCE, "")
    return trim_space(F.regexp_replace(trim_space(body), CLOSING_FENCE, ""))


def parse_reply(raw: Column, shape: dict[str, str]) -> Column:
    """A struct with the fields of ``shape``, or null.

    Null unless the text is one JSON object that has every field with exactly
    the required type.  Extra fields are ignored.
    """
    def has_type(document: Column, field: str, kind: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(document, f"$.{field}", "variant"))
        if not kind.startswith("ARRAY"):
            return F.coalesce(found == kind, F.lit(False))
        # An empty array has no element type of its own; a null element has no place in one.
        elements = F.try_variant_get(document, f"$.{field}", kind.lower())
        return F.coalesce(found.isin(kind, "ARRAY<VOID>"), F.lit(False)) & ~F.exists(
            elements, lambda x: x.isNull()
        )

    def read(document: Column) -> Column:
        valid = reduce(and_, [has_type(document, f, kind) for f, kind in shape.items()])
        fields = [
            F.try_variant_get(document, f"$.{f}", kind.lower()).alias(f) for f, kind in shape.items()
        ]
        return F.when(valid, F.struct(*fields))

    # A one-element array binds the parsed text to a name: it is parsed once, not once per field.
    return F.transform(F.array(F.try_parse_json(strip_fence(raw))), read)[0]
