"""Cleaning, keys and values out of free text. Everything is a Column of built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street suffixes and ordinals in address keys.
SUFFIXES = {
    "AVENUE": "AVE", "BOULEVARD": "BLVD", "COURT": "CT", "DRIVE": "DR", "HIGHWAY": "HWY", "LANE": "LN",
    "PLACE": "PL", "ROAD": "RD", "STREET": "ST", "TERRACE": "TER", "TURNPIKE": "TPKE",
}
ORDINALS = {
    "FIRST": "1", "1ST": "1", "SECOND": "2", "2ND": "2", "THIRD": "3", "3RD": "3", "FOURTH": "4", "4TH": "4", "FIFTH": "5", "5TH": "5",
    "SIXTH": "6", "6TH": "6", "SEVENTH": "7", "7TH": "7", "EIGHTH": "8", "8TH": "8", "NINTH": "9", "9TH": "9", "TENTH": "10", "10TH": "10",
}
# Spellings kept after title-casing an address.
ADDRESS_SPELLINGS = {" Nj": " NJ", " N.J.": " NJ", " Aka ": " a/k/a ", " Fka ": " f/k/a ", " Po Box": " PO Box"}
# Fixed value: an amount of money with an optional dollar sign, grouped thousands and cents.
MONEY = r"\$?\s*((?:\d{1,3}(?:,\s*\d{3})+|\d+)(?:\.\d{1,2})?)"


def _mapping(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def squeeze(c: Column) -> Column:
    """Any run of white space, no-break spaces included, is one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_whitespace(c: Column) -> Column:
    """As ``squeeze``, without spaces before commas, and without spaces or commas at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r" ,", ","), r"^[ ,]+|[ ,]+$", "")


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital, so letters after digits do too (2Nd)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1), lambda x: F.initcap(F.lower(x))), "")


def title_case_address(c: Column) -> Column:
    out = title_case(c)
    for old, new in ADDRESS_SPELLINGS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def last_zip(c: Column) -> Column:
    """The last five-digit code, with or without its four-digit extension."""
    codes = F.regexp_extract_all(c, F.lit(r"\b(\d{5})(?:-\d{4})?\b"), 1)
    return F.try_element_at(codes, F.lit(-1))


# Fixed value: the designators of a unit, and what is its number.
_UNIT = r"(?i)\b(?:UNIT|APT|APARTMENT|SUITE|STE|#)\s*([A-Z0-9-]+)\b"


def unit_number(c: Column) -> Column:
    return F.upper(found(c, _UNIT))


def without_unit(c: Column) -> Column:
    """The text without its first unit designator."""
    return F.when(c.rlike(_UNIT), clean_whitespace(F.regexp_replace(c, r"(?s)^(.*?)" + _UNIT.replace("(?i)", "(?i:") + r")(.*)$", "$1$3"))).otherwise(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"([A-Z0-9]+)"), 1)


def address_key(c: Column, ordinals: bool = True) -> Column:
    """Letters and digits only, suffixes shortened and, if asked, ordinals as numbers."""
    short = _mapping(SUFFIXES | (ORDINALS if ordinals else {}))
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(short, t), t)), "")


def dotted_component(c: Column) -> Column:
    """Block or lot as files write it: no white space, upper case, no leading zeros; dots stay."""
    compact = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
    return F.when(compact == "", "").otherwise(F.coalesce(F.nullif(F.regexp_replace(compact, "^0+", ""), F.lit("")), F.lit("0")))


def identity_component(c: Column) -> Column:
    """Block or lot in identity keys: only letters, digits and hyphens; no leading zeros; dots go."""
    compact = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9-]", "")
    return F.when(compact == "", "").otherwise(F.coalesce(F.nullif(F.regexp_replace(compact, "^0+", ""), F.lit("")), F.lit("0")))


def parcel_pin(municipality: Column, block: Column, lot: Column, qualifier: Column) -> Column:
    return F.concat_ws("_", F.trim(municipality), identity_component(block), identity_component(lot), F.nullif(identity_component(qualifier), F.lit("")))


def map_number(c: Column) -> Column:
    """A map number with one dot between its parts; null if nothing is left."""
    joined = F.regexp_replace(F.upper(F.regexp_replace(c, r"(?U)\s+", "")), r"[._/\\-]+", ".")
    return F.nullif(F.regexp_replace(joined, r"^\.+|\.+$", ""), F.lit(""))


def alias_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def address_hash(street: Column, unit: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """SHA-256 of the parts in upper case; a missing part is an empty one."""
    upper = [F.trim(F.upper(F.coalesce(x, F.lit("")))) for x in (street, unit, city, state)]
    return F.sha2(F.concat_ws("|", *upper, F.trim(F.coalesce(zip_code, F.lit("")))), 256)


def street_number(c: Column) -> Column:
    return found(F.upper(F.coalesce(c, F.lit(""))), r"^\s*(\d+[A-Z]?)\b")


def address_parts(c: Column) -> Column:
    """What ``parts_support`` reads of an address: its key, its numbers and its words."""
    parts = F.array_distinct(tokens(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?<=[A-Z])(?=\d)", " ")))
    short = _mapping(SUFFIXES | ORDINALS)
    words = F.array_distinct(F.transform(F.filter(parts, lambda t: ~t.rlike(r"^\d+$")), lambda t: F.coalesce(F.try_element_at(short, t), t)))
    return F.struct(address_key(c).alias("key"), F.filter(parts, lambda t: t.rlike(r"^\d{1,4}$")).alias("numbers"), words.alias("words"))


def parts_support(subject: Column, candidate: Column) -> Column:
    """As ``address_supports``, of ``address_parts``; what is quick and seldom true comes first."""
    numbers, words = candidate["numbers"], candidate["words"]
    named = (F.size(numbers) > 0) & F.array_contains(subject["numbers"], F.get(numbers, F.lit(0))) & (F.size(words) > 0)
    by_parts = F.when(named, (F.size(F.array_except(numbers, subject["numbers"])) == 0) & (F.size(F.array_intersect(words, subject["words"])) >= 0.6 * F.size(words))).otherwise(False)
    return (subject["key"] != "") & (candidate["key"] != "") & (subject["key"].contains(candidate["key"]) | by_parts)


def address_supports(subject: Column, candidate: Column) -> Column:
    """Whether a candidate address stands in the subject: as a key, or by its numbers and three fifths of its words."""
    return parts_support(address_parts(subject), address_parts(candidate))


def amount(c: Column) -> Column:
    """A decimal out of digits with dollar signs, commas and spaces; null if it is none."""
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(14,2)")


def money_after(c: Column, labels: Sequence[str], distance: int = 180) -> Column:
    """The first amount at most ``distance`` characters after a label; labels are tried in their order."""
    return F.coalesce(*[amount(found(c, rf"(?is)(?:{label}).{{0,{distance}}}?{MONEY}")) for label in labels])


#: Characters of a window: more than the longest label, distance and value take together.
WINDOW = 340


def first_word(pattern: str) -> str:
    """The literal letters with which a pattern starts."""
    return re.match(r"[a-z]+(?![?*])", pattern)[0]


def windows(c: Column, words: Sequence[str], size: int = WINDOW) -> Column:
    """The text from each place where one of ``words`` (patterns, any case) stands, ``size`` characters of it, in the order of the places.

    One scan of the text, however many patterns then look at the windows' beginnings.
    """
    shortest = [w for w in dict.fromkeys(words) if not any(w != x and w.startswith(x) for x in words)]
    return F.regexp_extract_all(c, F.lit(rf"(?is)(?=((?:{'|'.join(shortest)}).{{0,{size}}}))"), 1)


def in_windows(places: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first window that starts with ``pattern``, null where none does or the group is empty."""
    at_start = rf"(?is)^(?:{pattern})"
    return found(F.get(F.filter(places, lambda w: w.rlike(at_start)), F.lit(0)), at_start, group)


def money_in(places: Column, labels: Sequence[str], distance: int = 180) -> Column:
    """As ``money_after``, by windows."""
    return F.coalesce(*[amount(in_windows(places, rf"(?:{label}).{{0,{distance}}}?{MONEY}")) for label in labels])


def money_in_unless(places: Column, label: str, distance: int, stops: Sequence[str]) -> Column:
    """The first amount with a dollar sign after a label, none of ``stops`` between them."""
    between = rf"(?:(?!{'|'.join(stops)})(?!\$\s*\d).){{0,{distance}}}"
    return amount(in_windows(places, rf"(?:{label}){between}{MONEY.replace('?', '', 1)}"))


def first_rule(c: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The result of the first rule whose text the value contains."""
    out = None
    for part, result in rules:
        hit = F.lower(c).contains(part)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(F.lit(otherwise))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the values as one JSON text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
