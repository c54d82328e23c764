"""DuckDB SQL that asks for the same results as the DataFrame queries, on the same derived population."""

from __future__ import annotations

from ..operators.accounting import COUNTS_EVENTS, METRICS, STANDINGS
from ..sources.population import sql_with

MATRIX = (
    "mat",
    """SELECT e.*, s.*, coalesce(f.state, CASE s.cap_family WHEN 'unsupported' THEN 'unsupported' ELSE 'undeclared' END) AS family_state,
  CASE WHEN e.jurisdiction IS NOT NULL THEN coalesce(j.state, CASE s.cap_jurisdiction WHEN 'unsupported' THEN 'unsupported' ELSE 'undeclared' END) END AS place_state
FROM expectations e CROSS JOIN scanners s LEFT JOIN families f ON f.scanner_id = s.scanner_id AND f.family = e.family
LEFT JOIN jurisdictions j ON j.scanner_id = s.scanner_id AND j.jurisdiction = e.jurisdiction""",
)
PAIRS = (
    "pairs",
    """SELECT m.*, f.f_start, f.f_end, f.f_family, f.f_jurisdiction, f.f_sensitive, f.f_action, f.emission,
  CASE WHEN f_start = exp_start AND f_end = exp_end THEN 'exact' WHEN f_start <= exp_start AND f_end >= exp_end THEN 'overbroad' ELSE 'partial' END AS relation
FROM mat m JOIN findings f ON m.scanner_id = f.scanner_id AND m.variant_id = f.variant_id AND exp_start < f_end AND f_start < exp_end""",
)
RANKED = (
    "ranked",
    """SELECT *, row_number() OVER (PARTITION BY scanner_id, variant_id, occurrence_id ORDER BY
  CASE relation WHEN 'exact' THEN 0 WHEN 'overbroad' THEN 1 ELSE 2 END,
  CASE relation WHEN 'exact' THEN 0 WHEN 'overbroad' THEN (f_end - f_start) - (exp_end - exp_start)
    ELSE (exp_end - exp_start) - (least(exp_end, f_end) - greatest(exp_start, f_start)) END,
  CASE WHEN f_family = family AND (jurisdiction IS NULL OR f_jurisdiction = jurisdiction) THEN 0 WHEN f_family = family THEN 1 ELSE 2 END,
  (f_jurisdiction IS NULL)::INT + (f_sensitive IS NULL)::INT + (f_action IS NULL)::INT,
  f_start, f_end, f_family NULLS FIRST, f_jurisdiction NULLS FIRST, f_sensitive NULLS FIRST, f_action NULLS FIRST) AS rn
FROM pairs WHERE status = 'complete'""",
)
SEEN = (
    "seen",
    """SELECT scanner_id, variant_id, occurrence_id, count(*) AS n, coalesce(string_agg(DISTINCT f_family, ',' ORDER BY f_family), '') AS families,
  coalesce(string_agg(DISTINCT f_jurisdiction, ',' ORDER BY f_jurisdiction), '') AS jurisdictions FROM ranked GROUP BY ALL""",
)
LOCATED = (
    "located",
    """SELECT m.*, coalesce(s.n, 0) AS n, coalesce(s.families, '') AS families, coalesce(s.jurisdictions, '') AS jurisdictions,
  r.f_family, r.f_jurisdiction, r.f_sensitive, r.f_action, r.relation, FALSE AS lacks
FROM mat m LEFT JOIN seen s USING (scanner_id, variant_id, occurrence_id)
LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (scanner_id, variant_id, occurrence_id) WHERE NOT m.text_negative""",
)
SCOPED = (
    "scoped",
    """SELECT m.scanner_id, m.variant_id, m.occurrence_id,
  coalesce(f.f_family = m.family AND (m.jurisdiction IS NULL OR f.f_jurisdiction = m.jurisdiction), FALSE) AS hit,
  coalesce(f.f_start IS NOT NULL AND (f.f_family IS NULL OR (f.f_family = m.family AND m.jurisdiction IS NOT NULL AND f.f_jurisdiction IS NULL)), FALSE) AS lacks,
  f.f_family, f.f_jurisdiction, f.f_sensitive
FROM mat m LEFT JOIN findings f ON m.scanner_id = f.scanner_id AND m.variant_id = f.variant_id WHERE m.text_negative AND m.status = 'complete'""",
)
NEGATIVE = (
    "negative",
    """SELECT m.*, coalesce(s.n, 0) AS n, coalesce(s.families, '') AS families, coalesce(s.jurisdictions, '') AS jurisdictions,
  CAST(NULL AS VARCHAR) AS f_family, CAST(NULL AS VARCHAR) AS f_jurisdiction, s.flag AS f_sensitive, CAST(NULL AS VARCHAR) AS f_action, CAST(NULL AS VARCHAR) AS relation, coalesce(s.lacks, FALSE) AS lacks
FROM mat m LEFT JOIN (SELECT scanner_id, variant_id, occurrence_id, count(*) FILTER (hit) AS n, bool_or(lacks) AS lacks,
  string_agg(DISTINCT f_family, ',' ORDER BY f_family) FILTER (hit) AS families, string_agg(DISTINCT f_jurisdiction, ',' ORDER BY f_jurisdiction) FILTER (hit) AS jurisdictions,
  CASE WHEN bool_or(hit AND f_sensitive IS TRUE) THEN TRUE WHEN bool_or(hit AND f_sensitive IS NULL) THEN NULL ELSE FALSE END AS flag
  FROM scoped GROUP BY ALL) s USING (scanner_id, variant_id, occurrence_id) WHERE m.text_negative""",
)
STATES = (
    "states",
    """SELECT *,
  CASE WHEN cap_family = 'unsupported' OR family_state = 'unsupported' OR place_state = 'unsupported' THEN 'not-measured'
    WHEN type_expectation = 'not-established' THEN 'unresolved'
    WHEN type_expectation = 'invalid' THEN CASE WHEN n > 0 THEN 'invalid-accepted' ELSE 'invalid-correct' END
    WHEN n = 0 THEN 'miss' WHEN f_family IS NULL THEN 'not-measured'
    WHEN f_family <> family THEN CASE WHEN f_jurisdiction <> jurisdiction THEN 'wrong-jurisdiction' ELSE 'wrong-family' END
    WHEN jurisdiction IS NOT NULL AND f_jurisdiction IS NULL THEN 'not-measured'
    WHEN f_jurisdiction <> jurisdiction THEN 'wrong-jurisdiction' ELSE 'correct' END AS t,
  CASE WHEN cap_sensitivity = 'unsupported' THEN 'not-measured' WHEN sensitivity IN ('not-established', 'context-dependent') THEN 'unresolved'
    WHEN (CASE WHEN n > 0 THEN f_sensitive WHEN cap_sensitivity = 'supported' THEN FALSE END) IS NULL THEN 'not-measured'
    WHEN (sensitivity = 'sensitive') = (CASE WHEN n > 0 THEN f_sensitive ELSE FALSE END) THEN 'correct'
    WHEN n > 0 AND f_sensitive THEN 'false-positive' ELSE 'miss' END AS s
FROM (SELECT * FROM located UNION ALL BY NAME SELECT * FROM negative)""",
)
OUTCOMES = (
    "outcomes",
    """SELECT * EXCLUDE (t, s),
  CASE WHEN status <> 'complete' THEN 'not-measured' WHEN text_negative AND t = 'invalid-correct' AND (lacks OR cap_family <> 'supported' OR family_state <> 'supported' OR place_state <> 'supported') THEN 'not-measured' ELSE t END AS type_state,
  CASE WHEN status <> 'complete' THEN 'not-measured' WHEN text_negative AND s = 'correct' AND sensitivity = 'non-sensitive' AND lacks THEN 'not-measured' ELSE s END AS sensitivity_state,
  CASE WHEN status <> 'complete' OR text_negative THEN 'not-applicable' WHEN exp_start IS NULL THEN 'unresolved' WHEN n = 0 THEN 'miss' ELSE relation END AS range_state,
  CASE WHEN status <> 'complete' OR text_negative OR exp_start IS NULL OR cap_action = 'unavailable' THEN 'not-measured' WHEN f_action IS NOT NULL THEN 'reported' ELSE 'no-action-reported' END AS action_state,
  CASE WHEN status = 'complete' AND NOT text_negative AND exp_start IS NOT NULL AND cap_action <> 'unavailable' THEN f_action END AS action, n AS finding_count
FROM states""",
)
_VALID, _METHOD = "type_expectation = 'valid'", "method = '{}'"
_TYPE, _MOOD = "type_state = 'not-measured'", "sensitivity_state = 'not-measured'"
_TYPE_REVIEW, _MOOD_REVIEW = "type_state = 'unresolved'", "sensitivity_state = 'unresolved'"
_BAD_MOOD = "sensitivity_state NOT IN ('correct', 'unresolved', 'not-measured')"
_ENDS = f"{_METHOD.format('context-discrimination')} AND context_class <> 'neutral'"
#: For each standing: the outcomes that it looks at, those under review, those not measured, and those with an event.
_LOOKS = {
    "missed_type": (_VALID, "FALSE", _TYPE, "type_state = 'miss'"),
    "wrong_family": (_VALID, "FALSE", _TYPE, "type_state = 'wrong-family'"),
    "wrong_place": (f"{_VALID} AND jurisdiction IS NOT NULL", "FALSE", _TYPE, "type_state = 'wrong-jurisdiction'"),
    "missed_sensitive": ("sensitivity = 'sensitive'", _MOOD_REVIEW, _MOOD, "sensitivity_state = 'miss'"),
    "flagged_harmless": ("sensitivity = 'non-sensitive'", _MOOD_REVIEW, _MOOD, "sensitivity_state = 'false-positive'"),
    "ends_told_apart": (_METHOD.format("context-discrimination"), f"{_ENDS} AND {_MOOD_REVIEW}", f"{_ENDS} AND {_MOOD}", f"{_ENDS} AND {_BAD_MOOD}"),
    "benign_left_alone": (_METHOD.format("pii-benign"), _MOOD_REVIEW, _MOOD, _BAD_MOOD),
    "collision_resolved": (_METHOD.format("jurisdiction-collision"), _TYPE_REVIEW, _TYPE, "type_state NOT IN ('correct', 'invalid-correct', 'unresolved', 'not-measured')"),
    "range_off": (f"{_VALID} AND range_state <> 'miss'", "FALSE", "range_state IN ('not-applicable', 'unresolved')", "range_state IN ('overbroad', 'partial')"),
    "type_measurable": ("TRUE", _TYPE_REVIEW, _TYPE, "FALSE"),
    "sensitivity_measurable": ("TRUE", f"({_MOOD_REVIEW} OR sensitivity = 'not-established')", _MOOD, "FALSE"),
}


def _standing(name: str) -> str:
    looked, review, missing, event = _LOOKS[name]
    some = lambda test: f"count(*) FILTER ({looked} AND {test}) > 0"
    return f"CASE WHEN {some(review)} THEN 3 WHEN {some(missing)} THEN 2 WHEN {some(event)} THEN 1 WHEN {some('TRUE')} THEN 0 END AS {name}"


FOLDED = ("folded", "SELECT scanner_id, case_id, method, language, jurisdiction, " + ", ".join(map(_standing, STANDINGS)) + " FROM outcomes GROUP BY ALL")


def _bucket(name: str) -> str:
    one, zero = ("'numerator'", "'other'") if name in COUNTS_EVENTS else ("'other'", "'numerator'")
    none = "" if name == "ends_told_apart" else " ELSE 'not-applicable'"
    return f"CASE {name} WHEN 3 THEN 'unresolved' WHEN 2 THEN 'not-measured' WHEN 1 THEN {one} WHEN 0 THEN {zero}{none} END"


BUCKETED = ("bucketed", " UNION ALL ".join(f"SELECT scanner_id, case_id, language, jurisdiction, method, '{m}' AS metric, {_bucket(c)} AS bucket FROM folded" for c, m in STANDINGS.items()))
ASSESSED = (MATRIX, PAIRS, RANKED, SEEN, LOCATED, SCOPED, NEGATIVE, STATES, OUTCOMES)
_COUNTS = """count(*) FILTER (bucket IN ('numerator', 'other', 'unresolved', 'not-measured')) AS eligible, count(*) FILTER (bucket IN ('numerator', 'other')) AS measured,
  count(*) FILTER (bucket = 'numerator') AS numerator, count(*) FILTER (bucket = 'unresolved') AS unresolved, count(*) FILTER (bucket = 'not-measured') AS not_measured,
  count(*) FILTER (bucket = 'not-applicable') AS not_applicable, count(*) AS total"""
TALLIED = (
    "tallied",
    " UNION ALL ".join(f"SELECT scanner_id, metric, '{s}' AS stratum, {v} AS value, {_COUNTS} FROM bucketed WHERE bucket IS NOT NULL GROUP BY ALL" for s, v in [("overall", "CAST(NULL AS VARCHAR)"), ("language", "language"), ("jurisdiction", "jurisdiction"), ("method", "method")]),
)
_UP = ", ".join(f"'{m}'" for m, (up, _) in METRICS.items() if up)
_WILSON = """CAST(floor(greatest(0, least(1, (2 * numerator + 3.8416 {sign} 1.96 * sqrt(3.8416 + 4.0 * numerator * (n - numerator) / n)) / (2 * (n + 3.8416)))) * 1000000 + 0.5) AS BIGINT)"""
PUBLISHED = (
    "published",
    f"""SELECT *, CASE WHEN eligible = 0 THEN 'not-applicable' WHEN measured = 0 THEN 'not-measured' WHEN measured < eligible THEN 'partial' ELSE 'measured' END AS status,
  CASE WHEN n = 0 THEN 'zero-denominator' WHEN n < 4 THEN 'insufficient-evidence' ELSE 'published' END AS value_state,
  CASE WHEN n >= 4 THEN (2 * numerator * 1000000 + n) // (2 * n) END AS point,
  CASE WHEN n >= 4 THEN CASE WHEN metric IN ({_UP}) THEN {_WILSON.format(sign="+")} ELSE {_WILSON.format(sign="-")} END END AS bound
FROM (SELECT *, CASE WHEN metric = 'measurable-share' THEN eligible ELSE measured END AS n FROM tallied)""",
)
ALL = (*ASSESSED, FOLDED, BUCKETED, TALLIED, PUBLISHED)


def ask(query: str, upto: tuple[tuple[str, str], ...] = ALL) -> str:
    return sql_with(query, *upto)
