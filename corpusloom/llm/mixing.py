"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic. Token weights of the cells are scaled to the target share of each
source, then of each language, then of each topic, over and over until all three marginals hold. A document is then kept with
the probability of its cell, calibrated so that the expected tokens of the cells are in proportion to the raked weights and
add up to the wanted share of all tokens; no probability exceeds 1, what a full cell can't give is spread over the others.

Only the table of cells is raked: one row per cell, summed before the shuffle. Up to MAX_CELLS cells are numbers in the driver;
a larger table stays where it is, and each step of the same loop is one aggregation over it. Rounds, tolerance and calibration
are the same, so the size changes where sums are made and nothing else. The documents themselves are never shuffled: cells
are joined by broadcast up to MAX_CELLS, else by the engine's own choice.

Topics are a coarse genre by rules over the whole text (`topic`); any other column can be given. Nulls in source or language
form a cell of their own named "". Empty texts have no tokens; a cell without tokens takes part with probability 1.
Repeated rows draw the same number and so share their fate; ties with a probability are not drawn. Very long texts count
whole. An empty table gives an empty result. Clashing column names do
not matter: only doc_id, text, source and lang are read. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, whole_text

AXES = ("source", "lang", "topic")
#: Targets are the present shares to this power (1 keeps them, 0 makes them equal), and this share of tokens is kept.
FLATTEN, KEEP = 0.7, 0.7
MAX_CELLS = 50_000
ROUNDS, TOLERANCE = 200, 1e-9


def topic(text: Column) -> Column:
    """A coarse genre: table, notice, list, long, short or prose."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (
        F.when(F.regexp_count(text, F.lit("\\|")) >= 10, "table")
        .when(F.lower(text).rlike("licen[cs]e|copyright"), "notice")
        .when(lines >= 20, "list")
        .when(F.char_length(text) >= 5000, "long")
        .when(F.char_length(text) < 500, "short")
        .otherwise("prose")
    )


def described(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id (or what is given to be carried along), source, lang, topic, tokens and a uniform number in [0, 1) drawn from id and text."""
    text = whole_text()
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text, F.lit("mixing")), 11).cast("double") / float(1 << 53)
    return docs.select(
        (F.col("doc_id") if carry is None else carry).alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic(text).alias("topic"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"), draw.alias("draw"),
    )


def targets(cells: DataFrame, axis: str, flatten: float = FLATTEN) -> dict[str, float]:
    """Wanted shares by category: present shares of tokens, flattened. An axis has as many as it has categories with tokens."""
    tokens = {r[axis]: float(r["t"]) ** flatten for r in cells.groupBy(axis).agg(F.sum("tokens").alias("t")).where("t > 0").collect()}
    whole = math.fsum(tokens.values())
    return {k: x / whole for k, x in sorted(tokens.items())}


class Numbers:
    """Cells as arrays in the driver: keys by axis, and tokens."""

    def __init__(self, keys: list[list[str]], tokens: np.ndarray):
        self.tokens, self.codes = tokens, [np.unique(k, return_inverse=True) for k in keys]
        self.weight = tokens / tokens.sum() if len(tokens) else tokens

    def shares(self, axis: int) -> dict[str, float]:
        names, code = self.codes[axis]
        return dict(zip(names.tolist(), np.bincount(code, weights=self.weight, minlength=len(names)).tolist(), strict=True))

    def scale(self, axis: int, factors: dict[str, float]) -> None:
        names, code = self.codes[axis]
        self.weight = self.weight * np.array([factors[n] for n in names.tolist()])[code]

    def beyond(self, factor: float) -> tuple[float, float]:
        """Weight of the cells that this factor does not fill, and tokens of those it does."""
        full = factor * self.weight >= self.tokens
        return float(self.weight[~full].sum()), float(self.tokens[full].sum())


class Table:
    """Cells as a stored table; a weight is the tokens' share times one factor for each category of the three axes, which the
    driver holds."""

    def __init__(self, cells: DataFrame):
        self.cells = cells.where("tokens > 0")
        self.whole = self.cells.agg(F.sum("tokens")).first()[0] or 0
        self.factors: list[dict[str, float]] = [{} for _ in AXES]

    def weighed(self) -> DataFrame:
        out = self.cells.withColumn("weight", F.col("tokens") / F.lit(float(self.whole)))
        for axis, factors in zip(AXES, self.factors, strict=True):
            if factors:
                own = self.cells.sparkSession.createDataFrame(list(factors.items()), f"{axis} string, factor double")
                out = out.join(own, axis).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        return out

    def shares(self, axis: int) -> dict[str, float]:
        return {r[0]: r[1] for r in self.weighed().groupBy(AXES[axis]).agg(F.sum("weight")).collect()}

    def scale(self, axis: int, factors: dict[str, float]) -> None:
        self.factors[axis] = {k: self.factors[axis].get(k, 1.0) * x for k, x in factors.items()}

    def beyond(self, factor: float) -> tuple[float, float]:
        full = F.lit(factor) * F.col("weight") >= F.col("tokens")
        row = self.weighed().agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("tokens")))).first()
        return float(row[0] or 0), float(row[1] or 0)


def raked(cells: Numbers | Table, wanted: list[dict[str, float]], rounds: int = ROUNDS) -> None:
    """Scales the weights until all marginals are as wanted, within TOLERANCE."""
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(wanted):
            have = cells.shares(axis)
            worst = max([worst, *(abs(have[k] - goal.get(k, 0.0)) for k in have)])
            cells.scale(axis, {k: goal.get(k, 0.0) / x if x > 0 else 0.0 for k, x in have.items()})
        if worst < TOLERANCE:
            break


def calibrated(cells: Numbers | Table, whole: float, keep: float = KEEP) -> float:
    """The factor with which probabilities min(1, factor * weight / tokens) keep this share of all tokens in expectation. What
    full cells can't give is spread over the others, until no more are filled."""
    factor = 0.0
    while True:
        weight, filled = cells.beyond(factor)
        new = (keep * whole - filled) / weight if weight > 0 else factor
        if new <= factor * (1 + 1e-15):
            return factor
        factor = new


def mix(docs: DataFrame, flatten: float = FLATTEN, keep: float = KEEP, max_cells: int = MAX_CELLS, carry: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (of the cell), probability, draw, sampled for each document."""
    spark = docs.sparkSession
    rows = described(docs, carry)
    cells = stored(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-cells")
    schema = "source string, lang string, topic string, weight double, probability double"
    wanted = [targets(cells, axis, flatten) for axis in AXES]
    small = cells.count() <= max_cells
    if small:
        found = cells.where("tokens > 0").orderBy(*AXES).collect()
        table = Numbers([[r[a] for r in found] for a in AXES], np.array([r["tokens"] for r in found], float))
        whole = float(table.tokens.sum())
    else:
        table = Table(cells)
        whole = float(table.whole)
    raked(table, wanted)
    factor = calibrated(table, whole, keep)
    if small:
        p = np.minimum(1.0, factor * table.weight / table.tokens)
        chances = F.broadcast(spark.createDataFrame([(r["source"], r["lang"], r["topic"], float(w), float(q)) for r, w, q in zip(found, table.weight, p, strict=True)], schema))
    else:
        chances = stored(table.weighed().select(*AXES, "weight", F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("tokens")).alias("probability")), "mixing-chances")
    out = rows.join(chances, list(AXES), "left")
    p = F.coalesce("probability", F.lit(1.0))
    return out.select("doc_id", *AXES, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), p.alias("probability"), "draw", (F.col("draw") < p).alias("sampled"))
