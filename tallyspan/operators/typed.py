"""Documents against a table of their fields: every violation with its path.

Spark parses a document, which leaves out what isn't well-formed, and a task goes through it once, from the root down; a member is entered only if
the table knows its path and it has the type named there. Documents are judged one by one, so there is no shuffle, and nothing is parsed again for a level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity


class Field(NamedTuple):
    """A path (members of arrays as []), its type, whether its parent must have it, and what its value must meet.

    least and most bound an integer, or the length of an array; key is the member by which an array of objects ascends.
    """

    path: str
    type: str
    required: bool = True
    values: tuple[str, ...] | None = None
    shape: str | None = None
    least: int | None = None
    most: int | None = None
    key: str | None = None


_STATUS = ("complete", "error", "unavailable", "unstable", "unsupported")
#: Fields of the documents of this engine's own exchange.
FIELDS = {
    "observation": [
        Field("", "object"),
        Field("schema", "string", values=("observation",)),
        Field("scannerId", "string", shape="slug"),
        Field("status", "string", values=_STATUS),
        Field("replays", "integer", least=1, most=1024),
        Field("inputs", "array", most=4, key="variantId"),
        Field("inputs[]", "object"),
        Field("inputs[].variantId", "string", shape="slug"),
        Field("inputs[].findings", "array"),
        Field("inputs[].findings[]", "object"),
        Field("inputs[].findings[].start", "integer", least=0, most=2**53 - 1),
        Field("inputs[].findings[].end", "integer", least=0, most=2**53 - 1),
        Field("inputs[].findings[].family", "string", False, shape="family"),
        Field("inputs[].findings[].sensitive", "boolean", False),
    ],
    "artifact": [
        Field("", "object"),
        Field("schema", "string", values=("artifact",)),
        Field("scanners", "array", least=1, most=32, key="id"),
        Field("scanners[]", "object"),
        Field("scanners[].id", "string", shape="slug"),
        Field("scanners[].status", "string", values=_STATUS),
        Field("failures", "array", key="scannerId"),
        Field("failures[]", "object"),
        Field("failures[].scannerId", "string", shape="slug"),
        Field("failures[].code", "string", values=("execution-error", "replay-disagreement", "timeout", "unavailable", "unsupported")),
        Field("methodCoverage", "array", least=1, key="method"),
        Field("methodCoverage[]", "object"),
        Field("methodCoverage[].method", "string", shape="slug"),
        Field("methodCoverage[].cases", "integer", least=0, most=2**53 - 1),
        Field("methodCoverage[].variants", "integer", least=0, most=2**53 - 1),
        Field("populationCounts", "object"),
        Field("populationCounts.authoredCases", "integer", least=0, most=2**53 - 1),
        Field("populationCounts.variants", "integer", least=0, most=2**53 - 1),
        Field("populationCounts.occurrences", "integer", least=0, most=2**53 - 1),
    ],
}


class _Other(str):
    """The text of a number that is no integer."""


class _Part(NamedTuple):
    """A field of the table with the fields of its members, or of its elements, and its shape's pattern."""

    field: Field
    members: dict[str, _Part]
    wants: list[str]
    shape: re.Pattern | None


def _parts(fields: list[Field]) -> _Part:
    """The table as a tree, from the root down; the elements of an array are its member []."""
    made: dict[str, _Part] = {}
    for f in fields:
        shape = re.compile(identity.SHAPES[f.shape].replace(r"\z", r"\Z"), re.ASCII) if f.shape else None
        made[f.path] = _Part(f, {}, [], shape)
    for f in fields:
        if f.path:
            parent, name = (f.path[:-2], "[]") if f.path.endswith("[]") else f.path.rpartition(".")[::2]
            made[parent].members[name] = made[f.path]
            if f.required and name != "[]":
                made[parent].wants.append(name)
    return made[""]


_KINDS = {bool: "boolean", int: "integer", dict: "object", list: "array", str: "string"}


def _kind(v: object) -> str:
    kind = _KINDS.get(type(v), "other")
    return "other" if kind == "integer" and not -(2**63) <= v < 2**63 else kind


def _order(items: list, key: str) -> str | None:
    """non-canonical-order or duplicate-identity of an array by a member; elements without it are passed over."""
    ids = [x[key] for x in items if isinstance(x, dict) and x.get(key) is not None]
    ids = [str(x) if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in ids]
    pairs = list(zip(ids, ids[1:]))
    return "non-canonical-order" if any(a > b for a, b in pairs) else "duplicate-identity" if any(a == b for a, b in pairs) else None


def _visit(v: object, part: _Part | None, path: str, told: list[tuple[str, str]]) -> None:
    """Add the violations (path, code) of a value and of what it holds. A table's depth bounds the recursion."""
    f, kind = part and part.field, _kind(v)
    if f is None or f.type != kind:
        told.append((path, "schema-violation"))
    elif kind == "object":
        before = f"{path}." if path else ""
        for name in part.wants:
            if name not in v:
                told.append((before + name, "schema-violation"))
        for name, x in v.items():
            _visit(x, part.members.get(name), before + name, told)
    else:
        if f.values is not None and v not in f.values:
            told.append((path, "schema-violation"))
        if part.shape and not part.shape.search(v):
            told.append((path, "invalid-identifier"))
        n = len(v) if kind == "array" else v if kind == "integer" else None
        if n is not None and (f.most is not None and n > f.most or kind == "integer" and f.least is not None and n < f.least):
            told.append((path, "limit-exceeded"))
        if kind == "array":
            if f.least is not None and n < f.least:
                told.append((path, "empty-collection"))
            if f.key and (code := _order(v, f.key)):
                told.append((path, code))
            items = part.members.get("[]")
            for i, x in enumerate(v):
                _visit(x, items, f"{path}[{i}]", told)


def violations(docs: DataFrame, fields: list[Field]) -> DataFrame:
    """(id, path, code) of docs (id, document): every violation of the table, for well-formed documents (a null variant has none).

    schema-violation for a member that the table doesn't know, a missing one, another type or value; invalid-identifier, limit-exceeded,
    empty-collection, non-canonical-order and duplicate-identity. A member of the wrong type is named once and not entered.
    What isn't well-formed becomes null and is left out by the task: a filter would move below a shuffle of the documents, to the few tasks that read them.
    """
    schema = T.StructType([docs.schema["id"], T.StructField("path", T.StringType()), T.StructField("code", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, read = _parts(fields), json.JSONDecoder(parse_float=_Other).raw_decode
        for batch in batches:
            at: list[int] = []
            told: list[tuple[str, str]] = []
            for i, document in enumerate(batch["document"].to_pylist()):
                if document is not None:
                    _visit(read(document.lstrip(" \t\r\n"))[0], root, "", told)
                    at += [i] * (len(told) - len(at))
            paths, codes = zip(*told) if told else ((), ())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(codes, pa.string())], names=["id", "path", "code"])

    well_formed = F.when(F.try_parse_json("document").isNotNull(), F.col("document"))
    return docs.select("id", well_formed.alias("document")).mapInArrow(run, schema)


def artifact_defects(docs: DataFrame) -> DataFrame:
    """(id, path, code) of what an artifact's parts say of each other; docs (id, document) have no violation of the table.

    Where docs have a column ``found``, the violations (path, code) of a document or null, those are given as they are; so the table is gone through once.
    Failures name scanners that are there, a scanner that didn't complete has a failure and a complete one none, and coverage adds up to the counts.
    """
    part = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    given = F.col("found") if "found" in docs.columns else F.lit(None).cast("array<struct<path:string,code:string>>")
    rows = docs.select("id", given.alias("found"), F.try_parse_json("document").alias("v"))
    counts = "struct<authoredCases:bigint,variants:bigint,occurrences:bigint>"
    rows = rows.select("id", "found", part("scanners", "array<struct<id:string,status:string>>").alias("scanners"), part("failures", "array<struct<scannerId:string,code:string>>").alias("failures"), part("methodCoverage", "array<struct<cases:bigint,variants:bigint>>").alias("methods"), part("populationCounts", counts).alias("counts"))
    ids, failed = F.transform("scanners", lambda s: s["id"]), F.transform("failures", lambda f: f["scannerId"])
    total = lambda c: F.aggregate(F.transform("methods", lambda m: m[c]), F.lit(0).cast("long"), lambda a, x: a + x)
    stray = F.transform(F.filter(F.transform("failures", lambda f, i: F.struct(f["scannerId"].alias("s"), i.alias("i"))), lambda x: ~F.array_contains(ids, x["s"])), lambda x: F.struct(F.format_string("failures[%d]", x["i"]).alias("path"), F.lit("unknown-scanner").alias("code")))
    torn = F.exists("scanners", lambda s: (s["status"] == "complete") == F.array_contains(failed, s["id"]))
    n = F.col("counts")
    wrong = (total("cases") != n["authoredCases"]) | (total("variants") != n["variants"]) | (n["variants"] < n["authoredCases"]) | (n["occurrences"] < n["variants"])
    one = lambda test, path, code: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))
    own = F.concat(stray, F.array_compact(F.array(one(torn, "failures", "status-inconsistent"), one(wrong, "populationCounts", "count-mismatch"))))
    return rows.select("id", F.explode(F.coalesce("found", own)).alias("x")).select("id", "x.path", "x.code")
