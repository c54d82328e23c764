"""The reasons that contract checks give, and which reason each of this engine's finer rules stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reason codes, by what they are about; they are never renamed.
REASONS = {
    "parsing": ("malformed-json", "document-too-large", "nesting-too-deep", "duplicate-key", "null-not-allowed", "float-not-allowed", "integer-out-of-range"),
    "envelope": ("not-an-object", "missing-schema", "unknown-schema", "schema-kind-mismatch", "malformed-schema-version", "incompatible-schema-major", "schema-minor-too-new", "schema-violation", "invalid-identifier", "semantic-digest-mismatch"),
    "structure": (
        "limit-exceeded", "duplicate-identity", "non-canonical-order", "empty-collection", "range-invalid", "range-out-of-bounds", "range-not-on-char-boundary", "decimal-invalid", "text-digest-mismatch", "derivation-invalid",
        "family-scope-mismatch", "incomplete-context-trio", "collision-invalid", "limits-invalid", "mechanics-invalid", "product-identity-invalid", "context-class-conflict", "diagnostics-invalid",
    ),
    "bindings": (
        "population-binding-mismatch", "run-class-mismatch", "scope-violation", "generation-binding-mismatch", "engine-binding-mismatch", "protocol-binding-mismatch", "unknown-scanner", "configuration-binding-mismatch",
        "configuration-digest-mismatch", "unknown-variant", "input-digest-mismatch", "observation-incomplete", "status-inconsistent", "capability-contradiction",
    ),
    "outcomes": ("outcome-contradiction", "metric-counts-inconsistent", "metric-value-inconsistent", "metric-definition-mismatch", "count-mismatch"),
    "publication": ("public-projection-forbidden",),
    "gates": ("identity-not-established-gate", "range-not-established-gate", "range-not-established-invalid"),
    "projection": ("projection-invalid", "projection-view-missing", "projection-binding-mismatch", "projection-pooled-denominator"),
}
#: Rules of the lattice of outcomes, and refusals of generation that contracts have a reason for.
STANDS_FOR = {
    "range-contradiction": "outcome-contradiction",
    "unreachable-type": "outcome-contradiction",
    "unreachable-sensitivity": "outcome-contradiction",
    "measured-by-incomplete-scanner": "outcome-contradiction",
    "measured-unsupported-type": "outcome-contradiction",
    "range-offset-too-large": "integer-out-of-range",
    "text-too-large": "limit-exceeded",
    "too-many-variants": "limit-exceeded",
    "context-frames-not-a-trio": "incomplete-context-trio",
    "invalid-collision": "collision-invalid",
    "duplicate-frame": "duplicate-identity",
}
ALL = tuple(code for codes in REASONS.values() for code in codes)


def reason(code: Column) -> Column:
    """The contract's reason for a code: itself, or what its rule stands for; null where contracts have none."""
    table = F.create_map(*[F.lit(x) for pair in [*((c, c) for c in ALL), *STANDS_FOR.items()] for x in pair])
    return F.try_element_at(table, code)
