"""Mixing sources to target weights: iterative proportional fitting over cells, then sampling by calibrated probabilities.

Documents are counted by cell (source, language, topic). The tokens of the cells are raked: each dimension in turn is scaled to its
target marginals, until no marginal is off by more than the tolerance. The cells are a table, every sweep is a chain of window sums, and
each sweep is written to the checkpoint folder. A document is sampled with probability min(1, rate x factor of its cell); the rate is
found so that the expected tokens meet the budget exactly, cells at probability 1 taken into account. The sample depends on the id and the seed only.

Targets come from tables of shares, or are powers of the own shares. Some cannot be met together (a source all in one language, with
targets that differ). `rake` then raises `Unsettled`. `mix` raises as well where targets were given; for powers of own shares it takes the
dimensions in their order, leaves out those that cannot be met beside the ones before, and warns which. The first alone can always be met.

Defined results: null values are a category of their own; a null text has no tokens; documents without tokens are sampled by their cell's factor. A
cell or category without tokens keeps its factor. Repeated rows are sampled alike, null ids share one random number. An empty table
gives no rows. Columns of the table that clash with the ones used here are carried unharmed by `sample_documents`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.catalogue import query, table, written

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a category: its share of the tokens to this power (1 leaves it, 0 makes all categories equal).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET, TOLERANCE = 0.8, 1e-9
#: Raking has failed after this many sweeps, or once the largest error does not even halve in this many sweeps.
MAX_SWEEPS, PATIENCE = 1000, 6
#: Sweeps that the SQL of the query makes; the given tables settle in 6 to 21.
SQL_SWEEPS = 30
#: Cells are broadcast up to this number (some 20 MB) and joined by a shuffle beyond it; the result is the same.
BROADCAST_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A rough topic by the form of a text."""
    chars = F.length(text)
    without = lambda letters: chars - F.length(F.translate(text, letters, ""))
    return (F.when(F.coalesce(tokens, F.lit(0)) == 0, "empty").when(100 * without("#*$%&|<>") >= 3 * chars, "markup")
            .when(100 * without("0123456789") >= 3 * chars, "figures")
            .when(100 * without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") >= 30 * chars, "capitals")
            .when(tokens < 100, "note").when(tokens >= 800, "essay").otherwise("prose"))


def described(docs: DataFrame) -> DataFrame:
    """Adds ``_source, _lang, _topic, _tokens``."""
    docs = docs.withColumn("_tokens", n_tokens(F.col("text")))
    return docs.withColumns({
        "_source": F.coalesce("source", F.lit("(none)")), "_lang": F.coalesce("lang", F.lit("(none)")),
        "_topic": topic_of(F.col("text"), F.col("_tokens"))})


def targets_by_power(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """``dimension, goal``: tokens that each category should have; the total is that of the cells."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("own"))
    total = sums.agg(F.sum("own").alias("t"), F.sum(F.pow("own", F.lit(power))).alias("p")).first()
    if not total["t"]:
        return sums.select(dimension, F.col("own").alias("goal"))
    return sums.select(dimension, (F.pow("own", F.lit(power)) / F.lit(total["p"]) * F.lit(total["t"])).alias("goal"))


def targets_by_share(cells: DataFrame, dimension: str, shares: DataFrame) -> DataFrame:
    """``dimension, goal`` from a table of ``category, share``: shares of the categories that have tokens, scaled to the total of the cells.

    A null category is the one of null values. Categories that the table does not name get nothing.
    """
    named = shares.groupBy(F.coalesce(F.col("category"), F.lit("(none)")).alias(dimension)).agg(F.sum("share").cast("double").alias("share"))
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("own")).where("own > 0").join(named, dimension, "left")
    total = sums.agg(F.sum("own").alias("t"), F.sum("share").alias("s"), F.min("share").alias("least")).first()
    if total["t"] and (not total["s"] or total["least"] < 0):
        raise ValueError(f"no shares, or negative ones, for the categories of {dimension}")
    return sums.select(dimension, (F.coalesce("share", F.lit(0.0)) / F.lit(total["s"]) * F.lit(total["t"])).alias("goal"))


class Unsettled(ValueError):
    """The targets of these dimensions cannot be met together."""


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Adds ``factor`` to cells with ``tokens``: so that tokens x factor meet the targets of every dimension."""
    columns = cells.columns
    for dimension, goal in targets.items():
        cells = cells.join(goal.withColumnRenamed("goal", f"goal{dimension}"), dimension, "left")
    cells = written(cells.withColumn("factor", F.lit(1.0)))
    errors: list[float] = []
    while True:
        off = F.lit(0.0)
        for dimension in targets:
            goal = F.col(f"goal{dimension}")
            cells = cells.withColumn("have", F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(dimension)))
            # Tokens that are wanted, of a category that the other dimensions leave without any, are an error of 1.
            error = F.when(F.col("have") > 0, F.when(goal > 0, F.abs(goal / F.col("have") - 1)).otherwise(0.0)).when(goal > 0, 1.0)
            cells = cells.withColumns({
                f"off{dimension}": F.coalesce(error, F.lit(0.0)),
                "factor": F.col("factor") * F.coalesce(F.when(F.col("have") > 0, goal / F.col("have")), F.lit(1.0))})
            off = F.greatest(off, F.col(f"off{dimension}"))
        cells = written(cells.drop("have"))
        error = cells.agg(F.max(off)).first()[0]
        cells = cells.drop(*[f"off{d}" for d in targets])
        if error is None or error < TOLERANCE:
            return cells.select(*columns, "factor")
        errors.append(error)
        if len(errors) >= MAX_SWEEPS or len(errors) > PATIENCE and error > 0.5 * errors[-1 - PATIENCE]:
            raise Unsettled(f"targets of {', '.join(targets)} are off by {error:.3g} after {len(errors)} sweeps")


def rake_in_order(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """`rake`, without the dimensions that cannot be met beside those before them."""
    try:
        return rake(cells, targets)
    except Unsettled as failed:
        warnings.warn(str(failed), stacklevel=2)
    met: dict[str, DataFrame] = {}
    raked = cells
    for dimension, goal in targets.items():
        try:
            raked = rake(cells, {**met, dimension: goal})
            met[dimension] = goal
        except Unsettled:
            warnings.warn(f"targets of {dimension} are left out", stacklevel=2)
    return raked


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Adds ``prob`` = min(1, rate x factor), with the expected tokens equal to the budget's share of all tokens."""
    total, weighted = cells.agg(
        F.sum("tokens").cast("double"), F.sum(F.col("tokens") * F.col("factor"))).first()
    if not total or budget >= 1:
        return cells.withColumn("prob", F.lit(1.0))
    rate, before = budget * total / weighted, 0.0
    while rate > before * (1 + 1e-13):
        # Cells that reach 1 give all their tokens; the others share what is left. The rate only grows, so this ends.
        full = F.col("factor") * F.lit(rate) >= 1
        sure, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double"),
                               F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("factor")))).first()
        before, rate = rate, max(rate, (budget * total - sure) / rest if rest else rate)
    return cells.withColumn("prob", F.least(F.lit(1.0), F.col("factor") * F.lit(rate)))


def draw(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the id and the seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, seed: str = ":mix",
        shares: dict[str, DataFrame] | None = None, texts: bool = True) -> DataFrame:
    """The documents with ``_source, _lang, _topic, _tokens, _weight`` (factor of the cell), ``_prob`` and ``_kept``.

    Targets are the tables ``shares`` (``category, share``, by dimension), or else the own shares to the ``powers``. Without ``texts`` the
    column ``text`` is left out, and the texts are read once instead of twice.
    """
    marked = described(docs)
    if not texts:
        marked = written(marked.drop("text"))
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = written(marked.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")))
    if shares:
        raked = rake(cells, {f"_{d}": targets_by_share(cells, f"_{d}", s) for d, s in shares.items()})
    else:
        raked = rake_in_order(cells, {f"_{d}": targets_by_power(cells, f"_{d}", p) for d, p in (powers or POWERS).items()})
    ready = written(calibrate(raked, budget).select(*keys, F.col("factor").alias("_weight"), F.col("prob").alias("_prob")))
    side = F.broadcast(ready) if ready.count() <= BROADCAST_CELLS else ready
    return marked.join(side, keys, "left").withColumn("_kept", draw(F.col("doc_id"), seed) < F.col("_prob"))


def sample_documents(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET,
                     shares: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    own = [c for c in docs.columns if c.startswith("_")]
    renamed = docs.withColumnsRenamed({c: f"own{c}" for c in own})
    return mix(renamed, powers, budget, shares=shares).where("_kept").select(*renamed.columns).withColumnsRenamed({f"own{c}": c for c in own})


def _sql() -> str:
    steps = ["""
WITH marked AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
docs AS (
  SELECT doc_id, source, lang, n_tokens,
         CASE WHEN n_tokens = 0 THEN 'empty'
              WHEN 100 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) >= 3 * length(text) THEN 'markup'
              WHEN 100 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) >= 3 * length(text) THEN 'figures'
              WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) >= 30 * length(text) THEN 'capitals'
              WHEN n_tokens < 100 THEN 'note' WHEN n_tokens >= 800 THEN 'essay' ELSE 'prose' END AS topic
  FROM marked),
c0 AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS factor FROM docs GROUP BY ALL)"""]
    for dimension, power in POWERS.items():
        steps.append(f"""
goal_{dimension} AS MATERIALIZED (
  SELECT {dimension}, pow(own, {power}) / sum(pow(own, {power})) OVER () * sum(own) OVER () AS goal
  FROM (SELECT {dimension}, sum(tokens) AS own FROM c0 GROUP BY ALL))""")
    k = 0
    for _ in range(SQL_SWEEPS):
        for dimension in POWERS:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, factor * CASE WHEN have > 0 AND goal >= 0 THEN goal / have ELSE 1 END AS factor
  FROM (SELECT *, sum(tokens * factor) OVER (PARTITION BY {dimension}) AS have FROM c{k}) JOIN goal_{dimension} USING ({dimension}))""")
            k += 1
    steps.append(f"""
ordered AS (
  SELECT *, sum(tokens) OVER w - tokens AS sure, sum(tokens * factor) OVER () - sum(tokens * factor) OVER w + tokens * factor AS rest
  FROM c{k} WINDOW w AS (ORDER BY factor DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
rate AS (
  SELECT ({BUDGET} * (SELECT sum(tokens) FROM c0) - sure) / rest AS rate FROM ordered
  WHERE rest > 0 AND factor * ({BUDGET} * (SELECT sum(tokens) FROM c0) - sure) / rest < 1
  ORDER BY factor DESC, source, lang, topic LIMIT 1)
SELECT doc_id, source, lang, topic, n_tokens, round(factor, 6) AS weight,
       round(least(1.0, factor * (SELECT rate FROM rate)), 6) AS prob,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix'), 1, 12) AS BIGINT) / 281474976710656.0
         < least(1.0, factor * (SELECT rate FROM rate)) AS kept
FROM docs JOIN c{k} USING (source, lang, topic)""")
    return ",".join(steps)


@query("op2_mixing", _sql())
def op2(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), texts=False)
    return found.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"), F.round("_prob", 6).alias("prob"),
        F.col("_kept").alias("kept"))
