"""What a scanner declares that it can report: a state for each kind of report, and maps for families and jurisdictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def declared(entries: Column, name: Column, overall: Column) -> Column:
    """The state of a family or jurisdiction: its own entry, else unsupported where the whole kind is, else undeclared; null for no name."""
    absent = F.when(overall == "unsupported", "unsupported").otherwise("undeclared")
    return F.when(name.isNotNull(), F.coalesce(F.try_element_at(entries, name), absent))


def expected_states(family: Column, jurisdiction: Column) -> tuple[Column, Column]:
    """Declared states of an expected family and of a case's jurisdiction, by the scanner's maps ``families`` and ``jurisdictions``."""
    return declared(F.col("families"), family, F.col("cap_family")), declared(F.col("jurisdictions"), jurisdiction, F.col("cap_jurisdiction"))


def classifies(family_state: Column, place_state: Column) -> Column:
    """Whether the scanner's silence on a family, in the case's jurisdiction if it has one, is an answer."""
    return (F.col("cap_family") == "supported") & (family_state == "supported") & (F.coalesce(place_state, F.lit("supported")) == "supported")


def rules_out_type(family_state: Column, place_state: Column) -> Column:
    """Whether the type of an expectation can't be measured at all."""
    return (F.col("cap_family") == "unsupported") | (family_state == "unsupported") | (F.coalesce(place_state, F.lit("")) == "unsupported")


def measures() -> Column:
    """Whether a scanner measured anything: it ran to the end and reports ranges."""
    return (F.col("status") == "complete") & (F.col("cap_ranges") != "unsupported")
