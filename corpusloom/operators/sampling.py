"""Deterministic samples: hash ranks, largest remainders, quotas, nested waves and design weights."""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.dedup import numbered


def stable_rank(seed: str | int, *parts: Column) -> Column:
    """Hex SHA-256 of seed and parts, joined by U+001F."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def tuple_text(*columns: str) -> Column:
    """How Python writes a tuple of plain strings, as hash input: ('a', 'b') or ('a',)."""
    values = [F.concat(F.lit("'"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("'")) for c in columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(",)" if len(columns) == 1 else ")"))


def hamilton(cells: DataFrame, size: str, total: int, order: Sequence[str]) -> DataFrame:
    """Quota of each cell in proportion to its size, by largest remainders; ties by cell. The table of cells is small."""
    every = Window.partitionBy()
    exact = cells.withColumn("_exact", F.lit(float(total)) * F.col(size) / F.sum(size).over(every)).withColumn("_floor", F.floor("_exact"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_floor")), *order))
    left = F.lit(total) - F.sum("_floor").over(every)
    return exact.withColumn("quota", (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_floor")


def cell_ranked(df: DataFrame, strata: Sequence[str], order: Column, tie: Column, name: str, most: str | None = None) -> DataFrame:
    """Adds each row's rank in its cell by a hexadecimal hash, then `tie`. A cell's rows are ranked in bins by the hash's first
    three digits, and a bin starts after the counts of those before it, so a large cell is spread over 4,096 windows. Rows of
    bins that begin beyond column `most` are left out before they are ranked."""
    keys = [*strata, "_bin"]
    hashed = df.withColumn("_order", order).withColumn("_bin", F.substring("_order", 1, 3))
    before = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_bin")) - F.col("_n")
    bins = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", before)
    placed = hashed.join(bins.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_start"), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    if most:
        placed = placed.where(F.col("_start") < F.col(most))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", tie)) + F.col("_start")
    return placed.withColumn(name, rank).drop("_order", "_bin", "_start", *[f"_of_{k}" for k in keys])


def stratified(df: DataFrame, total: int, strata: Sequence[str], seed: str | int, record_id: str) -> DataFrame:
    """Proportional sample without replacement; rank within a cell by hash, then id. Order of the result: `output_rank`."""
    quotas = hamilton(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("cell_n")), "cell_n", total, strata)
    own = df.join(quotas, list(strata))
    out = cell_ranked(own, strata, stable_rank(seed, tuple_text(*strata), F.col(record_id)), F.col(record_id).cast("string"), "rank", "quota").where("rank <= quota")
    return out.withColumn("sampling_track", F.lit("probability")).withColumn("output_rank", stable_rank(seed, F.lit("output"), F.col(record_id)))


def duplicate_ids(df: DataFrame, record_id: str) -> DataFrame:
    """Ids that are missing or given more than once: a sample needs this to be empty."""
    return df.groupBy(F.coalesce(F.col(record_id).cast("string"), F.lit("")).alias("id")).count().where("count > 1 or id = ''")


def enriched(df: DataFrame, group: str, quotas: Mapping[str, int], seed: str | int, record_id: str, excluded: DataFrame | None = None) -> DataFrame:
    """The first rows of each group by hash, less excluded ids; a group with too few rows raises when it is read."""
    spark = df.sparkSession
    table = spark.createDataFrame(sorted(quotas.items()), f"`{group}` string, quota long")
    pool = df if excluded is None else df.join(excluded.select(record_id), record_id, "left_anti")
    own = pool.join(table, group)
    sizes = own.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cell_ranked(own, [group], stable_rank(seed, F.col(group), F.col(record_id)), F.col(record_id).cast("string"), "rank", "quota").join(F.broadcast(sizes), F.col(group) == F.col("_group"))
    enough = F.when(F.col("_n") >= F.col("quota"), True).otherwise(F.raise_error(F.lit("a group has fewer rows than its quota")).cast("boolean"))
    return ranked.where(enough & (F.col("rank") <= F.col("quota"))).drop("_n", "_group").withColumn("sampling_track", F.lit("mechanism_enriched"))


def bounded_hamilton(populations: Mapping[Hashable, int], total: int, minima: Mapping[Hashable, int] | None = None) -> dict[Hashable, int]:
    """Proportional shares of what is left, rounded down, round after round; when no cell gets a whole one any more, the largest
    fractions get one each (ties by the cell's text). Runs over the small table of cells."""
    given = {c: (minima or {}).get(c, 0) for c in populations}
    if any(given[c] > n for c, n in populations.items()) or not sum(given.values()) <= total <= sum(populations.values()):
        raise ValueError("the total does not fit minima and capacities")
    while (left := total - sum(given.values())) > 0:
        room = {c: n - given[c] for c, n in populations.items() if n > given[c]}
        share = {c: left * n / sum(room.values()) for c, n in room.items()}
        whole = {c: min(room[c], math.floor(x)) for c, x in share.items()}
        if not any(whole.values()):
            whole = dict.fromkeys(sorted(room, key=lambda c: (math.floor(share[c]) - share[c], str(c)))[:left], 1)
        for c, n in whole.items():
            given[c] += n
    return given


def pilot_size(n: Column, fraction: float) -> Column:
    """Half up."""
    return F.floor(n * fraction + 0.5)


def waves(df: DataFrame, strata: Sequence[str], sizes: Sequence[int], seed: str | int, record_id: str, exhaust: bool = False) -> DataFrame:
    """Nested cumulative waves: each wave takes a prefix of every cell's hash order, with at least one row of a cell that has
    any left; adds wave, rank in the cell, inclusion probability and weight of the cumulative sample. A size below one raises,
    and so do sizes that leave rows over where the frame is to be used up."""
    spark = df.sparkSession
    cells = {tuple(r[:-1]): r["n"] for r in df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
    if any(size < 1 for size in sizes):
        raise ValueError("cumulative sizes of waves must grow")
    if exhaust and sum(sizes) != sum(cells.values()):
        raise ValueError("the waves do not use up the frame")
    left, taken, rows = dict(cells), {c: 0 for c in cells}, []
    for wave, size in enumerate(sizes, 1):
        live = {c: n for c, n in left.items() if n}
        quota = bounded_hamilton(live, size, {c: 1 for c in live} if size >= len(live) else None)
        for c, k in quota.items():
            rows.append((*c, wave, taken[c] + 1, taken[c] + k, (taken[c] + k) / cells[c]))
            taken[c] += k
            left[c] -= k
    kinds = ", ".join(f"`{s}` {df.schema[s].dataType.simpleString()}" for s in strata)
    table = spark.createDataFrame(rows, f"{kinds}, wave int, first long, last long, pi double")
    ranked = cell_ranked(df, strata, stable_rank(seed, F.col(record_id)), F.col(record_id).cast("string"), "cell_rank")
    return ranked.join(table, [*strata]).where("cell_rank between first and last").withColumn("weight", 1 / F.col("pi")).drop("first", "last")


def wave_weights(waved: DataFrame, population: DataFrame, strata: Sequence[str], n_waves: int) -> DataFrame:
    """Adds pi_w and weight_w for every wave w: the cell's share that is drawn by then, for rows of that wave or an earlier one;
    else 0 and null."""
    cells = population.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    drawn = waved.groupBy(*strata).agg(*[F.count_if(F.col("wave") <= w).alias(f"_drawn_{w}") for w in range(1, n_waves + 1)])
    out = waved.join(cells.join(drawn, [*strata]), [*strata])
    for w in range(1, n_waves + 1):
        pi = F.when(F.col("wave") <= w, F.col(f"_drawn_{w}") / F.col("_n")).otherwise(0.0)
        out = out.withColumn(f"pi_{w}", pi).withColumn(f"weight_{w}", F.when(pi > 0, 1 / pi))
    return out.drop("_n", *[f"_drawn_{w}" for w in range(1, n_waves + 1)])


def wave_margins(waved: DataFrame, population: DataFrame, strata: Sequence[str], n_waves: int, known: int = 0) -> DataFrame:
    """For each cumulative wave: rows, cells without a row, Kish's effective size of the weights, and the widest 95 % margin of a
    share in the frame and `known` rows beside it (known without error); 1 where one row or less is effective."""
    cells = population.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    drawn = waved.groupBy(*strata, "wave").agg(F.count(F.lit(1)).alias("_k"))
    grid = cells.withColumn("upto", F.explode(F.sequence(F.lit(1), F.lit(n_waves))))
    each = grid.join(drawn, [*strata], "left").groupBy(*strata, "upto", "_n").agg(F.coalesce(F.sum(F.when(F.col("wave") <= F.col("upto"), F.col("_k"))), F.lit(0)).alias("_k"))
    # the weights of a cell are all n / k, so their sum is n and that of their squares n * n / k
    out = each.groupBy(F.col("upto").alias("wave")).agg(
        F.sum("_k").alias("drawn"), F.count_if(F.col("_k") == 0).alias("empty_cells"), F.sum("_n").alias("_frame"),
        (F.pow(F.sum(F.when(F.col("_k") > 0, F.col("_n"))), F.lit(2)) / F.sum(F.when(F.col("_k") > 0, F.col("_n") * F.col("_n") / F.col("_k")))).alias("effective"),
    )
    frame, effective = F.col("_frame"), F.col("effective")
    correction = F.sqrt(F.greatest(F.lit(0.0), (frame - effective) / (frame - 1)))
    margin = frame / (frame + known) * 1.96 * F.sqrt(0.25 / effective) * correction
    return out.withColumn("margin", F.when(effective > 1, margin).otherwise(1.0)).drop("_frame")


def dispatched(waved: DataFrame, seed: str | int, record_id: str, batch: int = 20) -> DataFrame:
    """Adds dispatch_index (from 1 without gaps, by wave, then hash) and batch_id."""
    ordered = waved.withColumn("_dispatch", stable_rank(seed, F.lit("dispatch"), F.col(record_id)))
    out = numbered(ordered, ["wave", "_dispatch", record_id], "dispatch_index").drop("_dispatch")
    return out.withColumn("batch_id", F.format_string("batch_%06d", F.floor((F.col("dispatch_index") - 1) / batch) + 1))


def summary(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Counts by track and by cell in one pass of grouping sets."""
    keys = ["sampling_track", *strata]
    df.createOrReplaceTempView("corpusloom_sample")
    cell = ", ".join(strata)
    return df.sparkSession.sql(f"select {', '.join(keys)}, count(*) as n, grouping(sampling_track) as by_cell from corpusloom_sample group by grouping sets ((sampling_track), ({cell}))")
