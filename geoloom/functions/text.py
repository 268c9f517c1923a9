"""Tags, names, addresses and parsing, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPES = ("node", "way", "relation")
ADDRESS_KEYS = ("addr:housenumber", "addr:street", "addr:place", "addr:postcode", "addr:city")


def filled(value: Column) -> Column:
    """Null for an empty string: empty and missing are the same."""
    return F.nullif(value, F.lit(""))


def tag(key: str, tags: str = "tags") -> Column:
    return filled(F.col(tags)[key])


def has_key(key: str, tags: str = "tags") -> Column:
    return F.coalesce(F.map_contains_key(F.col(tags), key), F.lit(False))


def best_name(tags: str = "tags") -> Column:
    """The German name where there is one."""
    return F.coalesce(tag("name:de", tags), tag("name", tags))


def has_address(tags: str = "tags") -> Column:
    out = F.lit(False)
    for key in ADDRESS_KEYS:
        out = out | has_key(key, tags)
    return out


def typed_id(type_rank: Column, id_: Column) -> Column:
    return F.concat(F.element_at(F.array(*[F.lit(t) for t in TYPES]), type_rank.cast("int") + 1), F.lit("/"), id_.cast("string"))


def admin_level(value: Column) -> Column:
    """A whole number of 16 bits, blanks and a sign before it allowed, nothing after it; else -1."""
    whole = value.rlike(r"^[ \t\n\x0B\f\r]*[+-]?[0-9]+$")
    return F.coalesce(F.when(whole, value.try_cast("smallint")), F.lit(-1).cast("smallint"))


def ascii_fold(value: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(value, UPPER, LOWER)


def name_contains(name: Column, query: Column) -> Column:
    """Substring search without regard to ASCII case; an empty query and a missing name match nothing."""
    return F.coalesce((query != "") & F.contains(ascii_fold(name), ascii_fold(query)), F.lit(False))


def full_address(street: Column, number: Column, postcode: Column, city: Column, state: Column, country: Column) -> Column:
    return F.concat_ws(", ", *[filled(c) for c in (street, number, postcode, city, state, country)])


def address_complete(street: Column, number: Column, postcode: Column, city: Column, country: Column) -> Column:
    out = F.lit(True)
    for c in (street, number, postcode, city, country):
        out = out & filled(c).isNotNull()
    return out


def display_address(street: Column, number: Column, postcode: Column, city: Column) -> Column:
    """`street number, postcode city` with missing parts left out."""
    first = filled(F.concat_ws(" ", filled(street), filled(number)))
    return F.concat_ws(", ", first, filled(F.concat_ws(" ", filled(postcode), filled(city))))


def strict_double(value: Column) -> Column:
    """The whole string as a finite double, or null."""
    plain = F.when(value.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), value.try_cast("double"))
    return F.when(~F.isnan(plain) & (F.abs(plain) < F.lit(float("inf"))), plain)


def printable(value: Column) -> Column:
    return F.coalesce(filled(value), F.lit("<missing>"))
