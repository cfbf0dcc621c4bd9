"""Mail address headers and entity keys."""

from __future__ import annotations

from collections.abc import Callable

from email.utils import getaddresses
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import text as tx

ADDRESS = T.StructType().add("address", T.StringType()).add("name", T.StringType())


@F.arrow_udf(T.ArrayType(ADDRESS))
def parse_headers(headers: pa.Array) -> pa.Array:
    """Addresses of an array of header strings; one string may hold several."""
    return _lists(headers, lambda strings: listed(strings) if strings else [])


@F.arrow_udf(T.ArrayType(ADDRESS))
def parse_odd(headers: pa.Array) -> pa.Array:
    """Addresses of header strings that are not plain; the others come as NULL. (Spark hands arrays over far more slowly.)"""
    return _lists(headers, lambda header: [] if header is None else listed([header]))


def _lists(headers: pa.Array, parse: Callable[[Any], list]) -> pa.Array:
    kind = pa.list_(pa.struct([("address", pa.string()), ("name", pa.string())]))
    if headers.null_count == len(headers):  # nearly every batch: plain headers are not for Python
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(headers) + 1, np.int32)), pa.array([], kind.value_type))
    return pa.array([parse(h) for h in headers.to_pylist()], kind)


def listed(strings: list[str | None]) -> list[dict[str, str | None]]:
    pairs = getaddresses([s for s in strings if s is not None])
    return [{"address": addr.strip(), "name": name.strip() or None} for name, addr in pairs if addr]


# Items that mean the same to any reader: 'addr' or 'words <addr>', nothing quoted,
# commented, grouped or folded. No part can give back what another one needs, hence the possessive
# quantifiers, which make matching one loop over a header, however long it is.
_MAILBOX = r"[A-Za-z0-9._+\-]++@[A-Za-z0-9.\-]++"
_WORDS = r"[\p{L}\p{N} .#$%&'*+/=?^_`{|}~!\-]*+"
_ITEM = rf" *+(?:{_MAILBOX} *+(?=,|\z)|{_WORDS}<{_MAILBOX}> *+(?=,|\z))"
_PLAIN = rf"^{_ITEM}(?:,{_ITEM})*+\z"


def is_plain(header: Column) -> Column:
    """Whether Spark can split a header string by itself, which is so for nearly all of them."""
    return header.rlike(_PLAIN)


def plain_items(header: Column) -> Column:
    return F.split(header, ",")


def plain_parts(item: Column) -> tuple[Column, Column]:
    """Address and name ('' for none) of an item of a plain header."""
    angled = F.contains(item, F.lit("<"))
    words = F.substring_index(item, "<", 1)
    spaced = F.when(F.contains(words, F.lit("  ")), F.regexp_replace(words, " +", " ")).otherwise(words)
    return (
        F.when(angled, F.substring_index(F.substring_index(item, "<", -1), ">", 1)).otherwise(F.trim(item)),
        F.when(angled, F.trim(spaced)).otherwise(F.lit("")),
    )


def _plain_address(item: Column) -> Column:
    address, name = plain_parts(item)
    return F.struct(address.alias("address"), F.when(name != "", name).alias("name"))


def parse_header(header: Column) -> Column:
    """Addresses of one header string.

    Plain lists, which is nearly all of them, are split by Spark itself; only
    headers with quotes, comments, groups or anything else go to Python.
    """
    plain = is_plain(header)
    parsed = parse_odd(F.when(~plain, header))
    return F.when(plain, F.transform(plain_items(header), _plain_address)).otherwise(parsed)


# The keys of an address that comes in parts, the first that is filled counts.
ADDRESS_KEYS, NAME_KEYS = ("email", "address"), ("name", "display")


def _of_parts(pick: Callable[[str], Column | None]) -> Column:
    """An address from its named parts; ``pick`` gives the part of a key, or None where there is no such part."""
    def filled(keys: tuple[str, ...]) -> Column:
        parts = [p for k in keys if (p := pick(k)) is not None]
        return tx.strip(F.coalesce(*[F.when(p != "", p) for p in parts], F.lit(None).cast("string")))

    name = filled(NAME_KEYS)
    return F.struct(filled(ADDRESS_KEYS).alias("address"), F.when(name != "", name).alias("name"))


def _with_address(items: Column) -> Column:
    return F.filter(items, lambda p: F.coalesce(p["address"], F.lit("")) != "")


def address_list(field: Column, kind: T.DataType) -> Column:
    """``array<struct<address, name>>`` of a header string, a list of them, a list of structs with the
    keys above, or a variant: any of these, or a list that mixes strings and objects (objects come first)."""
    if isinstance(kind, T.VariantType):
        several = F.startswith(F.schema_of_variant(field), F.lit("ARRAY"))
        items = F.when(several, F.try_variant_get(field, "$", "array<variant>")).otherwise(F.array(field))
        objects = F.filter(items, lambda i: F.startswith(F.schema_of_variant(i), F.lit("OBJECT")))
        strings = F.filter(items, lambda i: F.schema_of_variant(i) == "STRING")
        parted = F.transform(objects, lambda i: _of_parts(lambda k: F.try_variant_get(i, f"$.{k}", "string")))
        parsed = parse_headers(F.transform(strings, lambda i: F.try_variant_get(i, "$", "string")))
        return F.concat(_with_address(parted), F.coalesce(parsed, F.array().cast(T.ArrayType(ADDRESS))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = kind.elementType.names
        return _with_address(F.transform(field, lambda p: _of_parts(lambda k: p[k].cast("string") if k in names else None)))
    return parse_headers(field) if isinstance(kind, T.ArrayType) else parse_header(field)


def email_key(address: Column) -> Column:
    """Lower case, '+tag' of the local part removed; non-addresses stay as they are."""
    lower = F.lower(tx.strip(address))
    return F.when(F.contains(address, F.lit("+")), F.regexp_replace(lower, r"^([^@+]*)\+[^@]*@", "$1@")).otherwise(lower)


_NOT_WORD = r"(?U:[^\p{L}\p{N}_\s\x1c-\x1f])"


def slug(name: Column) -> Column:
    """Lower case words separated by single spaces, punctuation dropped."""
    return F.lower(tx.squash(F.regexp_replace(name, _NOT_WORD, " ")))


def category(path: Column) -> Column:
    """First folder of a path; NULL for files at the top."""
    first = tx.strip(F.element_at(F.split(path, "/"), 1))
    return F.when(F.contains(path, F.lit("/")) & (first != ""), first)
