"""Text and identity functions as column expressions: identifiers, tokens, ids, checksums."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of version 5 UUIDs.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
NIL_UUID = "00000000-0000-0000-0000-000000000000"


def split_identifier(c: Column) -> Column:
    """camelCase, ACRONYMWord and snake_case to separate words; everything but ASCII letters and digits parts words."""
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(c, "[^a-zA-Z0-9]+", " ")


def tokens(c: Column) -> Column:
    """Lower-case tokens of a text, without stemming or stop words."""
    return F.filter(F.split(F.lower(split_identifier(F.coalesce(c, F.lit("")))), " "), lambda t: t != "")


_JOINTS = re.compile(rb"([a-z0-9])([A-Z])"), re.compile(rb"([A-Z]+)([A-Z][a-z])")
_PLAIN = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


def byte_tokens(content: bytes) -> list[bytes]:
    """The tokens of a text in UTF-8, as `tokens` has them."""
    for joint in _JOINTS:
        content = joint.sub(rb"\1 \2", content)
    return content.translate(_PLAIN).split()


def uuid5(c: Column) -> Column:
    """Version 5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(c, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def file_id(path: Column, sum_: Column) -> Column:
    return uuid5(F.concat(F.lit("file:"), path, F.lit(":"), sum_))


def symbol_id(file: Column, name: Column, start_line: Column, start_byte: Column) -> Column:
    return uuid5(F.concat_ws(":", file, name, start_line.cast("string"), start_byte.cast("string")))


def import_edge_id(path: Column, edge_type: Column, target: Column, module: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("edge"), path, edge_type, F.coalesce(target, F.lit("")), F.coalesce(module, F.lit(""))))


def edge_id(source: Column, edge_type: Column, target_id: Column, target: Column, path: Column) -> Column:
    to = F.coalesce(F.nullif(target_id, F.lit("")), F.concat(F.lit("unresolved:"), target))
    return uuid5(F.concat_ws(":", F.lit("edge"), source, edge_type, to, path))


def external_id(module: Column) -> Column:
    return uuid5(F.concat(F.lit("external:"), module))


def file_symbol_id(path: Column) -> Column:
    return uuid5(F.concat(F.lit("file:"), path))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last extension with its dot, or the empty text."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def normal_signature(c: Column) -> Column:
    """Signatures compared without white space differences, terminators and letter case of nothing."""
    c = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[;{]\s*$", "")
    c = F.regexp_replace(c, r"\s+", " ")
    return F.trim(F.regexp_replace(c, r"\s*([(),*&])\s*", "$1"))
