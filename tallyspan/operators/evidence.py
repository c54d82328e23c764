"""Mapping evidence fixtures to cases: a method for each case, weakened expectations, and the losses that it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_methods(fixtures: DataFrame) -> DataFrame:
    """(case_id, located, method, variants): fixtures of a case with and without a range become separate cases.

    fixtures: (case_id, start, identity, sensitivity). One aggregate whose partial sums combine before the shuffle.
    """
    located = F.col("start").isNotNull().alias("located")
    counted = fixtures.groupBy("case_id", located).agg(F.count("*").alias("variants"), F.bool_and(F.col("sensitivity") == "non-sensitive").alias("benign"))
    method = F.when(~F.col("located"), "schema-only").when(F.col("benign"), "pii-benign").otherwise("type-validation")
    return counted.select("case_id", "located", method.alias("method"), "variants")


def _text_negative(semantics: bool) -> Column:
    negative = (F.col("identity") == "invalid") | (F.col("sensitivity") == "non-sensitive")
    positive = (F.col("identity") == "valid") | (F.col("sensitivity") == "sensitive")
    return F.lit(semantics) & F.col("start").isNull() & negative & ~positive


def mapped(fixtures: DataFrame, semantics: bool = False) -> DataFrame:
    """The fixtures with text_negative, type_expectation, sensitivity_expectation and an array of losses.

    fixtures: (start, identity, sensitivity, contexts array, domains array, ...). Without a range, an expectation can't be
    anchored and is weakened to ``not-established``. With ``semantics``, negative statements about a whole text, contexts,
    domains and a sensitivity that depends on context are carried; without it each is a loss. Null arrays are empty.
    """
    kept = F.col("start").isNotNull() | F.col("text_negative")
    depends = F.col("sensitivity") == "context-dependent"
    told = F.when(depends, "context-dependent" if semantics else "not-established").otherwise(F.col("sensitivity"))
    open_ = F.when(depends & F.lit(semantics), "context-dependent").otherwise("not-established")
    plain = F.lit(not semantics)
    losses = [
        (~kept & (F.col("identity") != "not-established"), "identity-weakened-no-span"),
        (~kept & ~depends, "sensitivity-weakened-no-span"),
        (plain & depends & F.col("start").isNotNull(), "sensitivity-context-flattened"),
        (plain & (F.size(F.coalesce("contexts", F.array())) > 0), "contexts-not-carried"),
        (plain & F.coalesce(F.array_contains("domains", "phi"), F.lit(False)), "phi-domain-not-carried"),
    ]
    return (
        fixtures.withColumn("text_negative", _text_negative(semantics))
        .withColumn("type_expectation", F.when(kept, F.col("identity")).otherwise("not-established"))
        .withColumn("sensitivity_expectation", F.when(kept, told).otherwise(open_))
        .withColumn("losses", F.array_compact(F.array(*[F.when(on, F.lit(name)) for on, name in losses])))
    )


def loss_counts(rows: DataFrame) -> DataFrame:
    """(loss, n) over mapped fixtures."""
    return rows.select(F.explode("losses").alias("loss")).groupBy("loss").agg(F.count("*").alias("n"))
