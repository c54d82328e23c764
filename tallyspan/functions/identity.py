"""Identifiers, digests, validators and mutations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of identifiers.
SHAPES = {
    "slug": r"\A[a-z0-9]+(-[a-z0-9]+)*\z",
    "family": r"\A[a-z]+:(global|[a-z]{2}):[a-z0-9]+(-[a-z0-9]+)*\z",
    "language": r"\A[a-z]{2,3}\z",
    "digest": r"\A[0-9a-f]{64}\z",
    "timestamp": r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z\z",
}

#: The largest integer that a double holds exactly with all before it, and the most decimal places.
MOST_SAFE, MOST_SCALE = 2**53 - 1, 12


def preimage(*fields: Column) -> Column:
    """Binary: each field as its byte length in four bytes, the highest first, and its bytes."""

    def one(f: Column) -> Column:
        n = F.octet_length(f)
        # most fields are short, and a length below 128 is a byte that is a character too
        length = F.when(n < 128, F.concat(F.lit(bytes(3)), F.char(n).cast("binary"))).otherwise(F.unhex(F.lpad(F.hex(n), 8, "0")))
        return F.concat(length, f.cast("string").cast("binary"))

    return F.concat(*map(one, fields))


def variant_id(case_id: Column, slot: Column, domain: str | None = None) -> Column:
    """The slot and 24 hex digits of the hash of (case_id, slot), with the tag of the ids' domain before them if one is given."""
    tag = [] if domain is None else [F.lit(domain)]
    return F.concat(slot, F.lit("-"), F.substring(F.sha2(preimage(*tag, case_id, slot), 256), 1, 24))


def variant_seed(rule: Column, domain: str, generator: Column, version: Column, case_seed: Column, case_id: Column, slot: Column) -> Column:
    """A variant's seed: the hash of its derivation, or under the rule ``legacy-case-seed`` its case's own."""
    digest = F.sha2(preimage(F.lit(domain), generator, version.cast("string"), case_seed, case_id, slot), 256)
    return F.when(rule == "legacy-case-seed", case_seed).when(rule == "pii-seed-v1", digest)


def patterned(seed: Column, pattern: Column) -> Column:
    """The pattern with each D replaced by a digit and each A by a letter, drawn from the hash of the seed and the count of such marks before."""
    held = F.filter(F.split(pattern, ""), lambda c: c != "")

    def drawn(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(held, 1, i), lambda x: x.isin("A", "D")))
        number = F.conv(F.substring(F.sha2(F.concat(seed, F.lit("/"), before), 256), 1, 8), 16, 10).cast("long")
        letter = F.char(number % 26 + F.ascii(F.lit("A")))
        return F.when(c == "D", (number % 10).cast("string")).when(c == "A", letter).otherwise(c)

    return F.array_join(F.transform(held, drawn), "")


def scaled_decimal(mantissa: Column, scale: Column) -> Column:
    """(mantissa, scale) without zeros at the end of the fraction; null beyond the safe integers or MOST_SCALE places."""
    digits = mantissa.cast("string")
    zeros = F.when(mantissa == 0, scale).otherwise(F.least(scale, F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))))
    kept = F.struct(F.when(mantissa == 0, 0).otherwise(F.substring(digits, F.lit(1), F.length(digits) - zeros).cast("long")).cast("long").alias("mantissa"), (scale - zeros).cast("int").alias("scale"))
    return F.when((mantissa >= 0) & (mantissa <= MOST_SAFE) & scale.between(0, MOST_SCALE), kept)


def family_scope(family: Column) -> Column:
    return F.upper(F.element_at(F.split(family, ":"), 2))


def scope_agrees(family: Column, jurisdiction: Column) -> Column:
    scope = family_scope(family)
    return F.coalesce(((scope == "GLOBAL") & jurisdiction.isNull()) | (scope == jurisdiction), F.lit(False))


def _digit(value: Column, at: int) -> Column:
    return F.substring(value, at, 1).cast("int")


def synthetic_mod10(value: Column) -> Column:
    """SYNTHETIC-dddd whose first three digits add up to the last modulo ten."""
    fits = value.rlike(r"\ASYNTHETIC-[0-9]{4}\z")
    return F.when(fits & ((_digit(value, 11) + _digit(value, 12) + _digit(value, 13)) % 10 == _digit(value, 14)), "valid").otherwise("invalid")


def us_ssn_allocation(value: Column) -> Column:
    """Nine ASCII digits and nothing else, whose area, group and serial can be allocated."""
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 4, 2), F.substring(value, 6, 4)
    fits = value.rlike(r"\A[0-9]{9}\z") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return F.when(fits, "valid").otherwise("invalid")


#: Registered validators by (id, version).
VALIDATORS = {("synthetic-mod10", 1): synthetic_mod10, ("us-ssn-allocation", 1): us_ssn_allocation}


def observe(validator: Column, version: Column, value: Column) -> Column:
    """A registered validator's verdict; unavailable for an unknown id or version."""
    out = F.lit("unavailable")
    for (name, number), run in VALIDATORS.items():
        out = F.when((validator == name) & (version == number), run(value)).otherwise(out)
    return out


def invalidate_final_digit(value: Column) -> Column:
    """The value with its last ASCII digit d replaced by (d + 1) modulo ten; unchanged without a digit."""
    head, last, tail = (F.regexp_extract(value, r"(?s)^(.*)([0-9])([^0-9]*)$", i) for i in (1, 2, 3))
    return F.when(last != "", F.concat(head, ((last.cast("int") + 1) % 10).cast("string"), tail)).otherwise(value)


def framed(template: Column, candidate: Column) -> tuple[Column, Column]:
    """A template with its one {{candidate}} filled in, and the byte offset where it stands; null for other templates."""
    parts = F.split(template, r"\{\{candidate\}\}")
    one = F.size(parts) == 2
    return F.when(one, F.concat(parts[0], candidate, parts[1])), F.when(one, F.octet_length(parts[0])).cast("long")
