"""Comparison keys, flags and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.text import blank_to_null, let, normalize_line, strip

# Fixed value: the namespace of all exported ids.
ID_NAMESPACE = "8f0f8c50-0f58-45d8-b8e5-83a0f7e79a11"

# Words read as yes.
YES_WORDS = ("1", "true", "yes", "ja", "y")
PRICING_YES_WORDS = (*YES_WORDS, "on")

# Spellings of "piece".
PIECE_WORDS = ("stueck", "stuck", "stck", "stk", "st")


def reference_key(value: Column) -> Column:
    """Upper-case letters and digits only; empty becomes null."""
    return blank_to_null(F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""))


def lookup_key(value: Column) -> Column:
    """Lower case; everything but letters and digits becomes a blank, outer blanks go."""
    low = F.replace(F.lower(strip(value)), F.lit("&"), F.lit(" "))
    return F.coalesce(strip(F.regexp_replace(low, r"(?U)[^\p{L}\p{N}]", " ")), F.lit(""))


def collapsed_lookup_key(value: Column) -> Column:
    return F.regexp_replace(lookup_key(value), " +", " ")


def ascii_key(value: Column) -> Column:
    """Lower case with umlauts spelled out, other signs as single blanks."""
    # outer blanks are signs as well and go with them
    low = F.lower(value)
    for sign, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(sign), F.lit(spelled))
    return F.coalesce(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), F.lit(""))


def customer_position_key(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(normalize_line(value)), "[^a-z0-9]+", ""), F.lit(""))


def unit_key(value: Column) -> Column:
    """Unit for comparison; all spellings of piece are one key."""
    def spelled(bare: Column) -> Column:
        return F.when(bare.isin(*PIECE_WORDS), "piece").otherwise(bare)

    def key(clean: Column) -> Column:
        low = F.replace(F.lower(clean), F.lit("²"), F.lit("2"))
        low = F.replace(F.replace(low, F.lit(".")), F.lit("ü"), F.lit("ue"))
        return F.when(clean == "", None).otherwise(let(F.regexp_replace(low, r"(?U)\s+", ""), spelled))

    return let(strip(value), key)


def truthy(value: Column) -> Column:
    """Flag stored as text or boolean; null is no."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin(*YES_WORDS), F.lit(False))


def pricing_enabled(value: Column) -> Column:
    """The document's pricing flag; null is yes."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin(*PRICING_YES_WORDS), F.lit(True))


def uuid5(name: Column, namespace: str = ID_NAMESPACE) -> Column:
    """Name-based UUID, version 5, computed in the JVM."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def external_document_id(document_id: Column) -> Column:
    return uuid5(F.concat(F.lit("document:"), document_id.cast("string")))


def external_line_item_id(document_id: Column, source_id: Column) -> Column:
    return uuid5(F.concat(F.lit("document:"), document_id.cast("string"), F.lit(":line-item:"), source_id))


def distinct_ids(ids: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(ids)


def position_numbers(text: Column) -> Column:
    """`1, 2/3` to the distinct digit texts in order."""
    parts = F.transform(F.split(text, r"[,/;\s]+"), lambda part: F.btrim(part, F.lit(" .-")))
    digits = F.filter(parts, lambda part: F.regexp_like(part, F.lit("^[0-9]+$")))
    return F.coalesce(F.array_distinct(digits), F.array().cast("array<string>"))


def metadata_map(text: Column) -> Column:
    """JSON object as a text map; anything else is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)
