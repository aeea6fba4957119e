"""Text, hash and request helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped != "", stripped)


def split_list(text: Column) -> Column:
    """``' a, b,,'`` -> ``['a', 'b']``."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")


def url_component(text: Column) -> Column:
    """Percent-encode one URL component; ``- _ . ! ~ * ' ( )`` stay literal."""
    out = F.url_encode(text)
    # fixed values: what form encoding does differently from component encoding
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def truthy(text: Column) -> Column:
    return F.coalesce(text.isin("true", "1"), F.lit(False))


def tile_row_text(y: Column) -> Column:
    """Drop a tile file suffix from the row part of an address."""
    return F.regexp_replace(y, r"(?i)\.(mvt|pbf)$", "")


def client_address(forwarded_for: Column, real_ip: Column) -> Column:
    first = F.split(forwarded_for, ",")[0]
    return F.coalesce(blank_to_null(first), blank_to_null(real_ip), F.lit("127.0.0.1"))


def etag_of(length: Column, digest: Column) -> Column:
    return F.when(length == 0, 'W/"0-empty"').otherwise(
        F.concat(F.lit('W/"'), length.cast("string"), F.lit("-"), digest, F.lit('"'))
    )


def etag(tile: Column) -> Column:
    """Weak ETag of a tile: byte length and the first half of its md5."""
    return etag_of(F.octet_length(tile), F.substring(F.md5(tile), 1, 16))


def catalog_schema_of(catalog_id: Column, default: str = "public") -> Column:
    return F.when(F.instr(catalog_id, ".") > 0, F.regexp_extract(catalog_id, r"^([^.]*)\.", 1)).otherwise(
        F.lit(default)
    )


def catalog_table_of(catalog_id: Column) -> Column:
    return F.when(F.instr(catalog_id, ".") > 0, F.regexp_extract(catalog_id, r"^[^.]*\.(.*)$", 1)).otherwise(
        catalog_id
    )


def split_catalog_id(catalog_id: str, default: str = "public") -> tuple[str, str]:
    head, dot, tail = catalog_id.partition(".")
    return (head, tail) if dot else (default, catalog_id)
