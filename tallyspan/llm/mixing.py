"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are summed into cells (source, language, topic) of token weight. The cells' weights are raked in turn to each
margin's targets, until ``rounds`` rounds are done. A margin's targets are shares that the caller states (``targets``, a map
of value to share by margin); values that a map doesn't name share what it leaves, and without a map all, by their tokens'
shares to the power ``flatten``. A cell's rate is its raked weight over its tokens, scaled by one number for all cells, so
the expected tokens of a margin's values are in the ratio of its raked weights.

A rate above one gives whole copies, and a copy more with the probability of its fraction; a hash of the id decides. ``prob``,
the rate cut off at one, is the probability of at least one copy, and the scale makes the tokens that are kept at least
once ``keep`` of all; copies come on top. ``sampled`` gives each copy as a row. ``achieved`` reports the margins.

Everything is DataFrame functions. Few cells meet in one partition and are broadcast; more than ``FEW_CELLS`` are raked by sums of
each margin that are joined back, scaled by repeated sums, and joined by a shuffle.

Defined results: null sources and languages are the category ``(null)``; null texts are empty and weigh one token; rows that
repeat an id share one draw; empty tables give no rows; input columns that clash with this operator's are left out in favour
of its own in ``mix`` and untouched by ``sampled``. Targets of values without rows are spread over the others in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

MARGINS = ("source", "lang", "topic")
#: Most cells that meet in one partition and are broadcast.
FEW_CELLS = 20_000
#: Bytes that count as a token.
TOKEN_BYTES = 4

Targets = dict[str, dict[str, float]] | None


def topic_of(text: Column) -> Column:
    """The form of a text: table, markup, short, long or prose."""
    size, has = F.octet_length(text), lambda s: F.instr(text, s) > 0
    marks = has("###") | has("$$$") | has("%%%") | has("&&&") | has("***")
    return F.when(has(" | "), "table").when(marks, "markup").when(size < 400, "short").when(size >= 8000, "long").otherwise("prose")


def _stated(margin: str, default: Column, rest: Column, targets: Targets) -> Column:
    """A value's target: what the caller states, or its part of what the stated shares leave; ``rest`` sums the defaults of values not named."""
    named = (targets or {}).get(margin)
    if not named:
        return default
    left = max(0.0, 1.0 - sum(named.values()))
    out = F.coalesce(F.try_divide(default * left, rest), F.lit(0.0))
    for value, share in named.items():
        out = F.when(F.col(margin) == value, float(share)).otherwise(out)
    return out


def _named(margin: str, targets: Targets) -> Column:
    return F.col(margin).isin(*(targets or {}).get(margin, {}))


def raked(cells: DataFrame, flatten: float, rounds: int, targets: Targets = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with a column w, raked to every margin."""
    over = {m: W.partitionBy(m) for m in MARGINS}
    everything = W.partitionBy(F.lit(1))
    out = cells.withColumn("tokens", F.col("tokens").cast("double"))
    for m in MARGINS:
        out = out.withColumn("part", F.sum("tokens").over(over[m]))
        out = out.withColumn("part", F.pow("part", F.lit(flatten)))
        each = F.col("part") * F.col("tokens") / F.sum("tokens").over(over[m])
        out = out.withColumn("each", each).withColumn("to_" + m, F.col("part") / F.sum("each").over(everything))
        if (targets or {}).get(m):
            # A value's share of its margin's tokens makes the sum over cells one over values.
            alone = lambda c: c * F.col("tokens") / F.sum("tokens").over(over[m])  # noqa: B023, E731
            rest = F.sum(F.when(~_named(m, targets), alone(F.col("to_" + m)))).over(everything)
            out = out.withColumn("rest", rest).withColumn("to_" + m, _stated(m, F.col("to_" + m), F.col("rest"), targets))
            out = out.withColumn("each", alone(F.col("to_" + m))).withColumn("to_" + m, F.col("to_" + m) / F.sum("each").over(everything))
    out = out.withColumn("w", F.col("tokens") / F.sum("tokens").over(everything))
    for _ in range(rounds):
        for m in MARGINS:
            out = out.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col("to_" + m), F.sum("w").over(over[m])), F.lit(0.0)))
    return out


def raked_wide(cells: DataFrame, flatten: float, rounds: int, targets: Targets = None) -> DataFrame:
    """``raked`` for any number of cells: each margin is summed by a shuffle and joined back."""
    out = cells.withColumn("tokens", F.col("tokens").cast("double"))
    for m in MARGINS:
        parts = cut(out.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(flatten)).alias("part")))
        total = parts.agg(F.sum("part")).first()[0]
        parts = parts.withColumn("goal", F.col("part") / F.lit(total))
        rest = parts.where(~_named(m, targets)).agg(F.sum("goal")).first()[0] if (targets or {}).get(m) else None
        parts = parts.withColumn("goal", _stated(m, F.col("goal"), F.lit(rest).cast("double"), targets))
        total = parts.agg(F.sum("goal")).first()[0]
        out = out.join(parts.select(m, (F.col("goal") / F.lit(total)).alias("to_" + m)), m)
    everything = out.agg(F.sum("tokens")).first()[0]
    out = cut(out.withColumn("w", F.col("tokens") / F.lit(everything)))
    for _ in range(rounds):
        for m in MARGINS:
            sums = out.groupBy(m).agg(F.sum("w").alias("sum_w"))
            out = out.join(sums, m).withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col("to_" + m), F.col("sum_w")), F.lit(0.0))).drop("sum_w")
        out = cut(out)
    return out


def calibrated_wide(cells: DataFrame, keep: float) -> DataFrame:
    """``calibrated`` for any number of cells: the scale grows by sums until no further cell is cut off."""
    cells = cells.withColumn("ratio", F.col("w") / F.col("tokens"))
    total = cells.agg(F.sum("tokens")).first()[0]
    scale, cut_off = 0.0, -1
    while True:
        over = F.col("ratio") * F.lit(scale) > 1
        full, rest, n = cells.agg(F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.count_if(over)).first()
        if n <= cut_off or rest <= 0:
            break
        scale, cut_off = (keep * total - full) / rest, n
    return _rates(cells.withColumn("scale", F.lit(scale)))


def _rates(cells: DataFrame) -> DataFrame:
    rate = F.coalesce(F.round(F.col("scale") * F.col("ratio"), 9), F.lit(1.0))
    return cells.withColumn("prob", F.round(F.least(F.lit(1.0), F.col("scale") * F.col("ratio")), 9)).withColumn("rate", rate)


def calibrated(cells: DataFrame, keep: float) -> DataFrame:
    """raked cells with rate = s * w / tokens and prob = min(1, rate), where s makes the expected tokens of prob ``keep`` of all.

    With cells in order of w / tokens, the largest first, s follows from the first place after which no
    cell is cut off at one.
    """
    everything = W.partitionBy(F.lit(1))
    down = everything.orderBy(F.desc("ratio"), *MARGINS)
    out = cells.withColumn("ratio", F.col("w") / F.col("tokens"))
    out = out.withColumn("full", F.coalesce(F.sum("tokens").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("rest", F.sum("w").over(down.rowsBetween(0, W.unboundedFollowing)))
    scale = (F.lit(keep) * F.sum("tokens").over(everything) - F.col("full")) / F.col("rest")
    out = out.withColumn("scale", F.when(scale * F.col("ratio") <= 1, scale)).withColumn("scale", F.max("scale").over(everything))
    return _rates(out)


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, seed: str) -> list[Column]:
    text, name = F.coalesce(F.col(text_col).cast("string"), F.lit("")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    mark = F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return [
        name(source_col).alias("mix_source"),
        name(lang_col).alias("mix_lang"),
        topic_of(text).alias("mix_topic"),
        F.greatest(F.lit(1), F.ceil(F.octet_length(text) / TOKEN_BYTES)).cast("long").alias("mix_tokens"),
        (F.conv(F.substring(F.md5(mark.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))).alias("mix_draw"),
    ]


def cell_probabilities(docs: DataFrame, keep: float = 0.8, flatten: float = 0.8, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: str = "mix", targets: Targets = None) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, prob, rate, target) for each cell of docs."""
    rows = docs.select(*_prepared(docs, id_col, text_col, source_col, lang_col, seed))
    cells = rows.groupBy(*["mix_" + m for m in MARGINS]).agg(F.sum("mix_tokens").alias("tokens"))
    cells = cut(cells.select(*[F.col("mix_" + m).alias(m) for m in MARGINS], "tokens"))
    few = cells.count() <= FEW_CELLS
    done = calibrated(raked(cells.repartition(1), flatten, rounds, targets), keep) if few else calibrated_wide(raked_wide(cells, flatten, rounds, targets), keep)
    done = cut(done.select(*[F.col(m).alias("mix_" + m) for m in MARGINS], "prob", "rate", F.round("w", 9).alias("target")))
    return F.broadcast(done) if few else done


def _copies(draw: str, rate: str) -> Column:
    whole = F.floor(F.col(rate))
    return (whole + (F.col(draw) < F.col(rate) - whole).cast("int")).cast("int")


def achieved(docs: DataFrame, keep: float = 0.8, flatten: float = 0.8, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: str = "mix", targets: Targets = None) -> DataFrame:
    """(margin, value, given, target, expected, sampled): shares of all tokens, of the raked weights, and of the tokens of all copies."""
    rows = mix(docs, keep, flatten, rounds, id_col, text_col, source_col, lang_col, seed, targets)
    cells = rows.groupBy(*MARGINS, "target", "rate").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    at = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS])).alias("at")
    cells = cells.select(at, "tokens", "target", (F.col("rate") * F.col("tokens")).alias("due"), "drawn")
    sums = cells.groupBy("at.margin", "at.value").agg(*[F.sum(c).alias(c) for c in ("tokens", "target", "due", "drawn")])
    share = lambda c, name: F.try_divide(F.col(c), F.sum(c).over(W.partitionBy("margin"))).alias(name)
    return sums.select("margin", "value", share("tokens", "given"), share("target", "target"), share("due", "expected"), share("drawn", "sampled"))


def mix(docs: DataFrame, keep: float = 0.8, flatten: float = 0.8, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: str = "mix", targets: Targets = None) -> DataFrame:
    """(id_col, source, lang, topic, tokens, target, prob, selected, rate, copies) for every document."""
    cells = cell_probabilities(docs, keep, flatten, rounds, id_col, text_col, source_col, lang_col, seed, targets)
    rows = docs.select(F.col(id_col), *_prepared(docs, id_col, text_col, source_col, lang_col, seed))
    rows = rows.join(cells, ["mix_" + m for m in MARGINS])
    return rows.select(id_col, *[F.col("mix_" + m).alias(m) for m in MARGINS], F.col("mix_tokens").alias("tokens"), "target", "prob", (F.col("mix_draw") < F.col("prob")).alias("selected"), "rate", _copies("mix_draw", "rate").alias("copies"))


def sampled(docs: DataFrame, keep: float = 0.8, flatten: float = 0.8, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: str = "mix", targets: Targets = None) -> DataFrame:
    """The selected documents with all their columns, whatever their names, each as often as it has copies."""
    cells = cell_probabilities(docs, keep, flatten, rounds, id_col, text_col, source_col, lang_col, seed, targets)
    cells = cells.select(*["mix_" + m for m in MARGINS], F.col("rate").alias("mix_rate"))
    rows = docs.select(F.struct("*").alias("mix_row"), *_prepared(docs, id_col, text_col, source_col, lang_col, seed)).join(cells, ["mix_" + m for m in MARGINS])
    rows = rows.select("mix_row", _copies("mix_draw", "mix_rate").alias("mix_copies")).where("mix_copies > 0")
    return rows.select("mix_row", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))).select("mix_row.*")


def oracle(keep: float = 0.8, flatten: float = 0.8, rounds: int = 12, seed: str = "mix") -> str:
    """The same in DuckDB SQL over the view documents."""
    margins = ", ".join(MARGINS)
    steps = [f"""WITH d AS (
  SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
    CASE WHEN contains(t, ' | ') THEN 'table'
      WHEN contains(t, '###') OR contains(t, '$$$') OR contains(t, '%%%') OR contains(t, '&&&') OR contains(t, '***') THEN 'markup'
      WHEN strlen(t) < 400 THEN 'short' WHEN strlen(t) >= 8000 THEN 'long' ELSE 'prose' END AS topic,
    CAST(greatest(1, (strlen(t) + {TOKEN_BYTES - 1}) // {TOKEN_BYTES}) AS BIGINT) AS tokens,
    CAST(CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {16**13}.0 AS draw
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
c AS (SELECT {margins}, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)""",
    *[f"m_{m} AS (SELECT {m}, s / sum(s) OVER () AS goal FROM (SELECT {m}, pow(sum(tokens), {flatten}) AS s FROM c GROUP BY {m}))" for m in MARGINS],
    f"w0 AS (SELECT c.*, m_source.goal AS to_source, m_lang.goal AS to_lang, m_topic.goal AS to_topic, tokens / sum(tokens) OVER () AS w FROM c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic))"]
    for i in range(rounds * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        steps.append(f"w{i + 1} AS (SELECT * REPLACE (w * to_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{i})")
    order = f"ORDER BY w / tokens DESC, {margins}"
    steps.append(f"""s AS (SELECT *, w / tokens AS ratio, coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
  sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS total FROM w{rounds * len(MARGINS)}),
k AS (SELECT max(({keep} * total - full_) / rest) AS scale FROM s WHERE ({keep} * total - full_) / rest * ratio <= 1),
p AS (SELECT {margins}, round(w, 9) AS target, round(least(1.0, scale * ratio), 9) AS prob FROM s, k)""")
    return ",\n".join(steps) + f"\nSELECT doc_id, {', '.join('d.' + m for m in MARGINS)}, d.tokens, target, prob, draw < prob AS selected FROM d JOIN p USING ({margins})"


def copies_oracle(keep: float = 0.8, flatten: float = 0.8, rounds: int = 12, seed: str = "mix") -> str:
    """(doc_id, source, lang, topic, tokens, target, rate, copies) in DuckDB SQL, on the steps of ``oracle``."""
    margins, steps = ", ".join(MARGINS), oracle(keep, flatten, rounds, seed).rsplit("\nSELECT ", 1)[0]
    return f"""{steps},
r AS (SELECT {margins}, round(w, 9) AS target, round(scale * ratio, 9) AS rate FROM s, k)
SELECT doc_id, {", ".join("d." + m for m in MARGINS)}, d.tokens, target, rate, CAST(floor(rate) AS INTEGER) + (draw < rate - floor(rate))::INTEGER AS copies FROM d JOIN r USING ({margins})"""
