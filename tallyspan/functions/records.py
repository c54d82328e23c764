"""Documents as columns: canonical JSON, digests, timestamps, commands and the tables of evidence classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, StringType, StructType

from .identity import MOST_SAFE, SHAPES, preimage

#: The method that counts an evidence class, and the benign classes that it may stand in.
EVIDENCE_CLASSES = {
    "near-miss": ("type-validation", []),
    "cross-family-collision": ("jurisdiction-collision", []),
    "reserved-documentation": ("pii-benign", ["reserved", "documentation"]),
    "official-test": ("pii-benign", ["test-value"]),
    "public-identifier": ("pii-benign", ["public-operational"]),
    "ordinary-reference-account": ("pii-benign", ["public-operational"]),
    "placeholder": ("pii-benign", ["placeholder"]),
    "context-negative": ("pii-benign", ["context-negative"]),
}
#: The family of each kind of evidence; a date of birth takes the scope of its jurisdiction.
KINDS = {
    "date-of-birth/global/labeled-field": "pii:global:date-of-birth",
    "uk-nino/uk/structured": "pii:gb:national-insurance-number",
    "email/global/basic": "pii:global:email",
    "phone/global/basic": "pii:global:phone",
    "payment-card/global/basic": "pii:global:payment-card",
    "iban/global/basic": "pii:global:iban",
    "us-ssn/us/structured": "pii:us:ssn",
    "medical-record-number/us/labeled-field": "pii:us:medical-record-number",
    "health-plan-member-id/us/member-field": "pii:us:health-plan-member-id",
    "health-claim-identifier/us/claim-field": "pii:us:health-claim-identifier",
    "prescription-order-identifier/us/order-field": "pii:us:prescription-order-identifier",
}
#: The scope of each jurisdiction of evidence.
SCOPES = {"global": "global", "us": "us", "uk": "gb"}
#: The longest first line of a command in bytes, a profile's shape, and the last millisecond of the year 9999.
LONGEST_COMMAND, PROFILE, LAST_MILLI = 128, "[a-z0-9][a-z0-9-]{0,39}", 253402300799999
_DAY = 86_400_000


def _quoted(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def canonical(value: Column, kind: DataType) -> Column:
    """JSON text of a value of strings, integers, booleans, arrays and structs: no blanks, fields in order of their names' bytes.

    Null if the value or anything in it is null, or an integer is beyond what a double holds exactly.
    """
    if isinstance(kind, StringType):
        return _quoted(value)
    if isinstance(kind, BooleanType):
        return value.cast("string")
    if isinstance(kind, IntegralType):
        return F.when(value.between(-MOST_SAFE, MOST_SAFE), value.cast("string"))
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda x: canonical(x, kind.elementType))
        return F.when(~F.exists(items, lambda x: x.isNull()), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        pairs = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType)) for f in fields]
        parts = [p if i == 0 else F.concat(F.lit(","), p) for i, p in enumerate(pairs)]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    raise TypeError(f"no canonical JSON for {kind.simpleString()}")


def semantic_digest(construction: str, domain: str, text: Column) -> Column:
    """The hash of three lines: how digests are built, what this one is of, and its canonical JSON."""
    return F.sha2(F.concat(F.lit(f"{construction}\n{domain}\n"), text), 256)


def job_digest(domain: str, *fields: Column) -> Column:
    """The identity of a job: the hash of its fields, each with its length before it. Who asked isn't part of it."""
    return F.sha2(preimage(F.lit(domain), *[f.cast("string") for f in fields]), 256)


def dotted_seed(seed: Column) -> Column:
    """An older seed as a seed of today: dots for slashes; null if it still isn't 1 to 64 of A-Z, a-z, 0-9, dot, underscore, hyphen."""
    out = F.replace(seed, F.lit("/"), F.lit("."))
    return F.when(out.rlike(r"\A[A-Za-z0-9._-]{1,64}\z"), out)


def unix_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a timestamp in UTC, with or without milliseconds; null for any other text."""
    return F.when(text.rlike(SHAPES["timestamp"]), F.unix_millis(F.try_to_timestamp(text)))


def civil_timestamp(millis: Column) -> Column:
    """The timestamp in UTC with milliseconds, in any session time zone; times before 1970 or after 9999 give the start of 1970."""
    at = F.when(millis.between(0, LAST_MILLI), millis).otherwise(F.lit(0)).cast("long")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / _DAY).cast("int")).cast("string")
    rest = at % _DAY
    part = lambda size, of, width: F.lpad((F.floor(rest / size) % of).cast("string"), width, "0")
    return F.concat(date, F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def command(body: Column, name: str) -> Column:
    """(kind, profile) of a comment's first line: ``name run`` with at most one profile, malformed, or not a command at all."""
    first = F.regexp_extract(body, r"\A([^\n]*?)(?:\r?\n|\z)", 1)
    shape = rf"\A{re.escape(name)} run(?: ({PROFILE}))?\z"
    fits = (F.octet_length(first) <= LONGEST_COMMAND) & first.rlike(shape)
    profile = F.nullif(F.regexp_extract(first, shape, 1), F.lit(""))
    kind = F.when(~first.startswith(name), "not-a-command").when(fits, "run").otherwise("malformed")
    return F.when(body.isNotNull(), F.struct(kind.alias("kind"), F.when(kind == "run", profile).alias("profile")))


def evidence_method(evidence: Column) -> Column:
    """The method that counts an evidence class; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for name, (method, _) in EVIDENCE_CLASSES.items() for x in (name, method)])
    return F.try_element_at(table, evidence)


def accounting_classes(evidence: Column) -> Column:
    """The benign classes that an evidence class may stand in, empty where it is no benign evidence; null for an unknown one."""
    pairs = [(F.lit(name), F.array(*map(F.lit, classes)).cast("array<string>")) for name, (_, classes) in EVIDENCE_CLASSES.items()]
    return F.try_element_at(F.create_map(*[x for pair in pairs for x in pair]), evidence)


def kind_family(kind: Column, jurisdiction: Column) -> Column:
    """(family, code) of a kind of evidence: kind-unmapped for an unknown one, jurisdiction-unmapped for a birth date of an unknown place."""
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    scope = F.try_element_at(table(SCOPES), jurisdiction)
    born = kind == "date-of-birth/global/labeled-field"
    family = F.when(born, F.concat(F.lit("pii:"), scope, F.lit(":date-of-birth"))).otherwise(F.try_element_at(table(KINDS), kind))
    code = F.when(family.isNull(), F.when(born, "jurisdiction-unmapped").otherwise("kind-unmapped"))
    return F.struct(family.alias("family"), code.alias("code"))
