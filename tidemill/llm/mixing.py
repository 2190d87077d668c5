"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic, by tokens.  Raking scales the
cells, one marginal after another, until the weighted token counts have the target shares of
all three; the weights become sampling probabilities that a budget of tokens calibrates,
and a hash of the id decides each document, so the sample is the same every time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import discard, materialize

#: Cells that the driver rakes; more are raked as a table, with the same result.
MOST_CELLS = 100_000


def rake(cells: dict[tuple, float], targets: list[dict | None], rounds: int = 60) -> dict[tuple, float]:
    """A weight for each cell such that weighted sizes have the target shares of each marginal.

    ``cells``: size of each cell; ``targets``: for each part of the cells' keys the share of
    each value, or None to leave it as it is.  Shares are taken relative to the values that
    occur; a value without a target keeps its own total.  Every round scales each marginal once.
    """
    total = sum(cells.values())
    weight = {k: 1.0 for k in cells}
    goals = []
    for d, target in enumerate(targets):
        if target is None:
            continue
        have: dict = {}
        for k in sorted(cells, key=repr):
            have[k[d]] = have.get(k[d], 0.0) + cells[k]
        given = {v: target[v] for v in have if v in target and have[v] > 0}
        free = total - sum(have[v] for v in have if v not in given)
        asked = sum(given.values())
        goals.append((d, {v: free * s / asked for v, s in given.items()} if asked > 0 else {}))
    keys = sorted(cells, key=repr)
    for _ in range(rounds):
        for d, goal in goals:
            have = {}
            for k in keys:
                have[k[d]] = have.get(k[d], 0.0) + cells[k] * weight[k]
            scale = {v: goal[v] / have[v] for v in goal if have[v] > 0}
            for k in keys:
                weight[k] *= scale.get(k[d], 1.0)
    return weight


def calibrate(cells: dict[tuple, float], weight: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """A probability for each cell, in proportion to its weight but at most 1, whose expected size is ``budget``.

    A budget beyond what all cells with a weight hold gives probability 1 for each of them.
    """
    probability = {k: 0.0 for k in cells}
    open_cells = [k for k in sorted(cells, key=repr) if weight[k] > 0 and cells[k] > 0]
    left = float(budget)
    while open_cells:
        factor = left / sum(cells[k] * weight[k] for k in open_cells)
        full = [k for k in open_cells if factor * weight[k] >= 1]
        if not full:
            for k in open_cells:
                probability[k] = max(factor, 0.0) * weight[k]
            break
        for k in full:
            probability[k] = 1.0
            left -= cells[k]
        gone = set(full)
        open_cells = [k for k in open_cells if k not in gone]
    return probability


def uniform(identity: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of a column's text; null gives that of the empty text."""
    head = F.substring(F.md5(F.coalesce(identity.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def _cells(docs: DataFrame, parts: list[Column], names: list[str], tokens: Column) -> DataFrame:
    """The size of each cell; a cell's documents combine before they shuffle."""
    sized = docs.select(*(p.cast("string").alias(n) for p, n in zip(parts, names)), F.coalesce(tokens.cast("double"), F.lit(0.0)).alias("_size"))
    return sized.groupBy(*names).agg(F.sum("_size").alias("_size"))


#: A round that moves no marginal by more than this share changes nothing that a probability shows.
SETTLED = 1e-13


def rake_table(cells: DataFrame, names: list[str], targets: list[dict | None], rounds: int = 60) -> DataFrame:
    """``cells`` (names and ``_size``) with ``_weight``: what :func:`rake` gives, by joins and aggregates.

    Each step is staged; raking ends early once all marginals are met.
    """
    spark, goals = cells.sparkSession, []
    for name, target in zip(names, targets):
        if target is None:
            continue
        wanted = spark.createDataFrame([(str(k), float(v)) for k, v in target.items()], f"{name} string, _share double")
        have = cells.groupBy(name).agg(F.sum("_size").alias("_have")).where("_have > 0")
        given = materialize(have.join(wanted, name), "mix-goals")
        sums = given.agg(F.sum("_have").alias("h"), F.sum("_share").alias("s")).first()
        free = sums["h"]  # what the values with a target share
        if sums["s"]:
            goals.append((name, given.select(name, (F.col("_share") * free / sums["s"]).alias("_goal"))))
    table = cells.withColumn("_weight", F.lit(1.0))
    for _ in range(rounds):
        before, moved = table, 0.0
        for name, goal in goals:
            have = table.groupBy(name).agg(F.sum(F.col("_size") * F.col("_weight")).alias("_have")).where("_have > 0")
            scale = materialize(have.join(goal, name).select(name, (F.col("_goal") / F.col("_have")).alias("_scale")), "mix-scales")
            moved = max(moved, scale.agg(F.max(F.abs(F.col("_scale") - 1))).first()[0] or 0.0)
            table = table.join(scale, name, "left").withColumn("_weight", F.col("_weight") * F.coalesce("_scale", F.lit(1.0)))
            table = materialize(table.select(*names, "_size", "_weight"), "mix-weights")
            discard(before, scale)
            before = table
        if moved <= SETTLED:
            break
    return table


def calibrate_table(table: DataFrame, names: list[str], budget: float) -> DataFrame:
    """``table`` of :func:`rake_table` with ``_chance``: what :func:`calibrate` gives."""
    live = (F.col("_weight") > 0) & (F.col("_size") > 0)
    top = float("inf")  # weights from here on have probability 1
    while True:
        sums = table.where(live).agg(
            F.sum(F.when(F.col("_weight") >= top, F.col("_size"))).alias("full"), F.sum(F.when(F.col("_weight") < top, F.col("_size") * F.col("_weight"))).alias("rest")
        ).first()
        factor = (float(budget) - (sums["full"] or 0.0)) / sums["rest"] if sums["rest"] else 0.0
        least = table.where(live & (F.col("_weight") < top) & (F.col("_weight") * factor >= 1)).agg(F.min("_weight")).first()[0]
        if least is None:
            break
        top = least
    chance = F.when(~live, 0.0).when(F.col("_weight") >= top, 1.0).otherwise(F.col("_weight") * max(factor, 0.0))
    return table.select(*names, chance.alias("_chance"))


def mixture(docs: DataFrame, parts: list[Column], targets: list[dict | None], tokens: Column, share: float, names: list[str], rounds: int = 60) -> tuple[DataFrame, bool]:
    """(the probability ``_chance`` of each cell that occurs, by ``names``; whether there are few cells).

    ``parts``: the columns of a cell, as text; null is a value of its own.  ``tokens``: the size
    of a document (null counts as zero).  ``share``: the budget as a share of all tokens.
    """
    found = materialize(_cells(docs, parts, names, tokens), "mix-cells")
    rows = found.limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        budget = share * found.agg(F.sum("_size")).first()[0]
        return calibrate_table(rake_table(found, names, targets, rounds), names, budget), False
    discard(found)
    cells = {tuple(r[n] for n in names): r["_size"] for r in rows}
    chances = calibrate(cells, rake(cells, targets, rounds), share * sum(cells.values()))
    schema = ", ".join([f"{n} string" for n in names] + ["_chance double"])
    return docs.sparkSession.createDataFrame([(*k, float(p)) for k, p in chances.items()], schema), True


def sample_mixture(docs: DataFrame, parts: list[Column], targets: list[dict | None], tokens: Column, share: float, id_col: str = "doc_id", chance_col: str | None = None, rounds: int = 60) -> DataFrame:
    """The documents of ``docs`` that the mixture draws, with all columns.

    Repeated rows and rows of equal id are drawn together.  With ``chance_col`` all rows
    stay, with their probability in that column and ``sampled`` beside it.  An empty table
    gives an empty one.
    """
    mark = "_mix"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    mine, theirs = ([f"{mark}{side}{i}" for i in range(len(parts))] for side in "ab")
    cells, few = mixture(docs, parts, targets, tokens, share, theirs, rounds)
    cells = cells.withColumnRenamed("_chance", mark)
    keyed = docs.withColumns({n: p.cast("string") for n, p in zip(mine, parts)})
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(mine, theirs)]
    found = keyed.join(F.broadcast(cells) if few else cells, same, "left")  # MOST_CELLS bounds what is broadcast
    chance = F.coalesce(mark, F.lit(0.0))
    drawn = uniform(F.col(id_col)) < chance
    kept = [F.col(f"`{c}`") for c in docs.columns if chance_col is None or c not in (chance_col, "sampled")]
    if chance_col is None:
        return found.where(drawn).select(*kept)
    return found.select(*kept, chance.alias(chance_col), drawn.alias("sampled"))
