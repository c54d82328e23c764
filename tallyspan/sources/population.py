"""A measurement population derived from the driver's tables by integer arithmetic.

The statements are plain SQL that Spark and DuckDB read alike, so that both sides of a comparison measure the same
population. Each order is a case; line items are what four detectors reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Scanners: (id, status, then what they declare of ranges, families, jurisdictions, sensitivity and actions).
SCANNERS = [
    (0, "complete", "supported", "supported", "supported", "supported", "sanitized-output"),
    (1, "complete", "supported", "supported", "supported", "undeclared", "reported"),
    (2, "complete", "supported", "supported", "undeclared", "supported", "unavailable"),
    (3, "unstable", "supported", "supported", "supported", "supported", "sanitized-output"),
]
#: What they declare of one family or jurisdiction; what isn't named is undeclared.
DECLARED = {
    "family": [(s, f, "unsupported" if (s, f) == (2, "card") else "supported") for s in range(4) for f in ("card", "email", "phone", "ssn") if (s, f) != (2, "ssn")],
    "jurisdiction": [(s, j, "unsupported" if (s, j) == (2, "GB") else "supported") for s in range(4) for j in ("GB", "US")],
}
_CAPS = "cap_ranges, cap_family, cap_jurisdiction, cap_sensitivity, cap_action"
_rows = lambda rows: ", ".join(map(str, rows))


def _maps(kind: str) -> str:
    """The map of each scanner, as Spark SQL."""
    of = lambda s: ", ".join(f"'{name}', '{state}'" for i, name, state in DECLARED[kind] if i == s)
    return "CASE id " + " ".join(f"WHEN {s[0]} THEN map({of(s[0])})" for s in SCANNERS) + " END"


TABLES = {
    "cases": """SELECT o_orderkey AS case_id, o_custkey AS c,
  CASE o_orderkey % 7 WHEN 0 THEN 'type-validation' WHEN 1 THEN 'context-discrimination' WHEN 2 THEN 'pii-benign'
    WHEN 3 THEN 'jurisdiction-collision' WHEN 4 THEN 'mutation' WHEN 5 THEN 'reference-differential' ELSE 'schema-only' END AS method,
  CASE o_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ko' ELSE 'de' END AS language,
  CASE WHEN o_orderkey % 7 = 3 OR o_custkey % 4 = 0 THEN 'US' WHEN o_custkey % 4 = 1 THEN 'GB' END AS jurisdiction,
  CASE o_orderkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'ssn' ELSE 'card' END AS family
FROM orders""",
    "variants": """SELECT cases.*, CAST(v.vi AS BIGINT) AS vi, case_id * 10 + v.vi AS variant_id,
  CASE WHEN method <> 'context-discrimination' THEN 'neutral' WHEN v.vi = 0 THEN 'sensitive' WHEN v.vi = 1 THEN 'neutral' ELSE 'non-sensitive' END AS context_class
FROM cases JOIN (VALUES (0), (1), (2)) AS v(vi) ON v.vi = 0 OR method = 'context-discrimination'""",
    "spans": """SELECT variants.*, CAST(o.oi AS BIGINT) AS occurrence_id, (case_id * 7 + vi * 5 + o.oi * 13) % 40 AS s,
  method = 'schema-only' AND case_id % 11 = 0 AS rangeless, method = 'schema-only' AND case_id % 22 = 0 AS text_negative
FROM variants JOIN (VALUES (0), (1)) AS o(oi) ON o.oi = 0 OR case_id % 3 = 0""",
    "expectations": """SELECT case_id, variant_id, occurrence_id, method, language, jurisdiction, family, context_class, text_negative,
  CASE WHEN NOT rangeless THEN s END AS exp_start, CASE WHEN NOT rangeless THEN s + 6 + c % 9 END AS exp_end,
  CASE WHEN text_negative THEN 'invalid' WHEN rangeless OR (method = 'reference-differential' AND c % 5 = 0) THEN 'not-established'
    WHEN method = 'mutation' OR (method = 'pii-benign' AND c % 2 = 0) THEN 'invalid' ELSE 'valid' END AS type_expectation,
  CASE WHEN text_negative THEN 'non-sensitive' WHEN rangeless THEN 'not-established' WHEN method = 'pii-benign' THEN 'non-sensitive'
    WHEN method = 'context-discrimination' THEN CASE vi % 3 WHEN 0 THEN 'sensitive' WHEN 1 THEN 'not-established' ELSE 'non-sensitive' END
    WHEN c % 4 = 3 THEN 'non-sensitive' ELSE 'sensitive' END AS sensitivity
FROM spans""",
    "scanners": f"SELECT CAST(id AS BIGINT) AS scanner_id, status, {_CAPS} FROM (VALUES {_rows(SCANNERS)}) AS s(id, status, {_CAPS})",
    "families": f"SELECT * FROM (VALUES {_rows(DECLARED['family'])}) AS f(scanner_id, family, state)",
    "jurisdictions": f"SELECT * FROM (VALUES {_rows(DECLARED['jurisdiction'])}) AS j(scanner_id, jurisdiction, state)",
    "declarations": """SELECT CAST(s_suppkey AS BIGINT) AS scanner_id, CASE WHEN s_nationkey % 5 = 4 THEN 'unstable' ELSE 'complete' END AS status,
  CASE WHEN s_acctbal < 0 THEN 'undeclared' ELSE 'supported' END AS cap_family, CASE s_nationkey % 3 WHEN 0 THEN 'undeclared' ELSE 'supported' END AS cap_sensitivity,
  concat('v', s_nationkey) AS version FROM supplier""",
    "earlier": "SELECT * FROM declarations WHERE scanner_id % 13 <> 0",
    "later": """SELECT scanner_id, CASE WHEN scanner_id % 5 = 0 THEN 'unstable' ELSE status END AS status, cap_family,
  CASE WHEN scanner_id % 17 = 0 THEN 'unsupported' ELSE cap_sensitivity END AS cap_sensitivity, CASE WHEN scanner_id % 11 = 0 THEN version || '.1' ELSE version END AS version
FROM declarations WHERE scanner_id % 7 <> 0""",
    "findings": """SELECT CAST(l_linenumber % 4 AS BIGINT) AS scanner_id, v.variant_id, v.case_id, CAST(l_linenumber AS BIGINT) AS emission,
  greatest(CAST(0 AS BIGINT), (v.case_id * 7 + v.vi * 5) % 40 + CASE l_partkey % 6 WHEN 1 THEN -3 WHEN 2 THEN 2 WHEN 4 THEN 60 WHEN 5 THEN 1 ELSE 0 END) AS f_start,
  (v.case_id * 7 + v.vi * 5) % 40 + CASE l_partkey % 6 WHEN 1 THEN 9 + v.c % 9 WHEN 2 THEN 10 WHEN 4 THEN 66 WHEN 5 THEN 4 ELSE 6 + v.c % 9 END AS f_end,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN 'phone' ELSE v.family END AS f_family,
  CASE WHEN l_suppkey % 7 < 4 THEN v.jurisdiction WHEN l_suppkey % 7 = 4 THEN 'FR' END AS f_jurisdiction,
  CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE END AS f_sensitive,
  CASE l_linestatus WHEN 'F' THEN 'redact' END AS f_action
FROM lineitem JOIN variants v ON l_orderkey = v.case_id""",
}
#: The same tables as Spark reads them without a nested loop: rows are repeated by their own arrays.
IN_SPARK = TABLES | {
    name: TABLES[name][: TABLES[name].index(" JOIN (VALUES")] + f" LATERAL VIEW explode(CASE WHEN {more} END) {view}"
    for name, more, view in (
        ("variants", "method = 'context-discrimination' THEN array(0, 1, 2) ELSE array(0)", "v AS vi"),
        ("spans", "case_id % 3 = 0 THEN array(0, 1) ELSE array(0)", "o AS oi"),
    )
}
IN_SPARK["scanners"] = TABLES["scanners"].replace(" FROM", f", {_maps('family')} AS families, {_maps('jurisdiction')} AS jurisdictions FROM", 1)
#: The scanners of two runs, which come of another table than the rest.
RUNS = {"declarations", "earlier", "later"}
BASE = ("orders", "lineitem", "documents", "events", "part", "labels", "customer", "pages", "conversations", "benchmark")


def sql_with(query: str, *more: tuple[str, str]) -> str:
    """A statement that defines the population's tables, then ``more`` (name, statement), then asks ``query``."""
    parts = [f"{name} AS ({body})" for name, body in [*TABLES.items(), *more]]
    return "WITH " + ",\n".join(parts) + "\n" + query


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the population."""
    own = RUNS if table in RUNS else {name for name in TABLES if name not in RUNS}
    inputs = [f"{name} AS (SELECT * FROM parquet.`{sf_dir}/{name}.parquet`)" for name in (("supplier",) if own is RUNS else ("orders", "lineitem"))]
    parts = [f"{name} AS ({body})" for name, body in IN_SPARK.items() if name in own]
    return spark.sql("WITH " + ",\n".join([*inputs, *parts]) + f"\nSELECT * FROM {table}")
