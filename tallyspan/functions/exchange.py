"""Exchange documents: strict JSON, the envelope of a document, keys that may not appear."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from .ranges import LARGEST

#: Limits of a document, and parts of keys that no evidence record may have, in any case of letters.
MOST_BYTES, MOST_DEPTH = 32 * 1024 * 1024, 32
BANNED = ("scanner", "detector", "support", "threshold", "blocker", "score", "benchmark", "qualif", "expectedcurrent")


class _Defect(Exception):
    pass


def _object(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Defect("duplicate-key")
    return dict(pairs)


def _integer(token: str) -> int:
    n = int(token)
    if token == "-0" or not -(2**63) <= n < 2**64:
        raise _Defect("float-not-allowed")
    if abs(n) > LARGEST:
        raise _Defect("integer-out-of-range")
    return n


def _refuse(code: str):
    def run(_: str):
        raise _Defect(code)

    return run


def _walk(value: object, depth: int, keys: list[str]) -> None:
    if value is None:
        raise _Defect("null-not-allowed")
    if isinstance(value, str):
        value.encode("utf-8")
    elif isinstance(value, (dict, list)):
        if depth >= MOST_DEPTH:
            raise _Defect("nesting-too-deep")
        if isinstance(value, dict):
            keys += value
            "".join(value).encode("utf-8")
            value = list(value.values())
        for item in value:
            _walk(item, depth + 1, keys)


def inspect(raw: bytes) -> tuple[str | None, bool]:
    """(first defect or None, whether a key is banned) of one document; a document with a defect has no keys."""
    if len(raw) > MOST_BYTES:
        return "document-too-large", False
    keys: list[str] = []
    try:
        value = json.loads(raw.decode("utf-8"), object_pairs_hook=_object, parse_int=_integer, parse_float=_refuse("float-not-allowed"), parse_constant=_refuse("malformed-json"))
        _walk(value, 0, keys)
    except _Defect as e:
        return str(e), False
    except RecursionError:
        return "nesting-too-deep", False
    except ValueError:
        return "malformed-json", False
    return None, any(part in key.lower() for key in keys for part in BANNED)


@F.pandas_udf(StructType().add("defect", StringType()).add("banned", BooleanType()))
def _inspect(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([(None, None) if x is None else inspect(x) for x in part], columns=["defect", "banned"]).astype({"defect": object, "banned": object})


def strict_json(document: Column) -> Column:
    """struct(defect, banned) of a string or binary column.

    Refused are documents above MOST_BYTES, text that isn't UTF-8 or JSON or has data behind it, keys that an object repeats,
    null, numbers that aren't integers of at most 2^53 - 1, and nesting beyond MOST_DEPTH. Spark's own reader accepts all
    of these, hence the UDF. Of several defects in one document the defect is one. Null gives null in both fields.
    """
    return _inspect(document.cast("binary"))


def envelope_error(document: Column, schema: str, known: list[str], major: int, minor: int) -> Column:
    """The first defect of a strict document's ``schema`` and ``schemaVersion`` ("major.minor"), or null."""
    found, version = (F.get_json_object(document, p) for p in ("$.schema", "$.schemaVersion"))
    first, second = (F.regexp_extract(version, r"^(0|[1-9][0-9]{0,3})\.(0|[1-9][0-9]{0,3})$", i) for i in (1, 2))
    return (
        F.when(~F.startswith(F.ltrim(document), F.lit("{")), "not-an-object")
        .when(found.isNull(), "missing-schema")
        .when(~found.isin(known), "unknown-schema")
        .when(found != schema, "schema-kind-mismatch")
        .when(version.isNull() | (first == ""), "malformed-schema-version")
        .when(first.try_cast("int") != major, "incompatible-schema-major")
        .when(second.try_cast("int") > minor, "schema-minor-too-new")
    )
