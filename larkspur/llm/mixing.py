"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Targets: sources by code point (null last) get the weights 3, 1, 2, repeating, and share 150 % of
all words; no target exceeds twice its source's words, the excess being reshared by weight. The level up to which sources are
filled is the root of a concave piecewise linear function of one number, found by Newton's method on sums
over the sources; their places in the order come from ranges of them.

Rates: of all document rates r, the one closest to uniform in relative entropy that meets the token
constraints is exponentially tilted, r = exp(lambda . x) with x the document's constraint vector.
lambda solves the convex dual, minimise sum(size * exp(lambda . x)) - lambda . target, by
Newton steps (`newton`): each aggregates the value, the gradient and the Hessian over the documents and solves the system of at most
`DRIVER_CONSTRAINTS` unknowns on the driver; a step that makes the dual worse is halved. Documents of equal x
add equal terms, so their sizes are summed first. `balance` makes x of any number of columns, one constraint for each of
their values: mixing asks for `source` alone. With one column the Hessian is diagonal, so beyond that many values every
constraint takes the same steps in its own row.

Copies: systematic rounding. Repeated rows (equal doc_id, source and size) are counted first and stand for as many
places. Documents of a source are put in order of size class (powers of two),
salt and size; copies are floor(r * place) - floor(r * (place - 1)), so every stretch of the order
has its share of copies. Places come from a prefix sum in three levels: classes, salts, rows; each size class of a source has as
many salts as keep a salt near `cell_rows` documents, so the hottest source is split over many tasks, and
rows repeated very often are written out by many tasks. What remains between the words taken and
the target is at last closed greedily, from the largest size down, by one copy more or less of at
most 4 documents in each size class.

Defined results: null or empty text has size 0 and no words taken; null source is a source of its
own, the last; sources of no words have target 0. Repeated rows are documents of their own. Targets that can't be met
raise an error. Empty table: no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import table, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Unknowns that a step's linear system may have on the driver.
DRIVER_CONSTRAINTS = 1_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, range_rows: int = 100_000) -> DataFrame:
    """sources (source, source_size): adds target."""
    n, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    order = F.col("source").asc_nulls_last()
    ranges = written(sources.repartitionByRange(max(1, -(-n // range_rows)), order).withColumn("range", F.spark_partition_id()), "source-ranges")
    before = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = before.select(F.col("range"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = written(ranges.join(before, "range").select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(most)).cast("long").alias("cap")), "weights")
    # the words of all sources at a level are concave in it, so Newton's steps from below rise to the root and end there
    budget, level = share * (total or 0), 0.0
    while n:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        filled, rest = rows.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0))).first()
        higher = (budget - filled) / rest if rest else level
        if not higher > level:
            break
        level = higher
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("w")).alias("target"))


def newton(cells: DataFrame, goals: list[float], steps: int = 40, close: float = 1e-10) -> list[float]:
    """cells (words double, x array<struct<k int, v double>>): lambda for each of the constraints 0, 1, ..., whose targets are `goals`.

    Each step is one aggregation of the cells to at most a row for each pair of constraints that meet in a cell."""
    goal, lam = np.array(goals, float), np.zeros(len(goals))
    # the pair (-1, -1) stands for the dual's value, (a, -1) for the gradient
    terms = "concat(array(named_struct('a', -1, 'b', -1, 'v', 1D)), transform(x, p -> named_struct('a', p.k, 'b', -1, 'v', p.v)), flatten(transform(x, p -> transform(filter(x, q -> q.k >= p.k), q -> named_struct('a', p.k, 'b', q.k, 'v', p.v * q.v)))))"
    cells = cells.filter("words > 0")

    def at(lam):
        """Dual's value, words that the constraints get, and Hessian."""
        literal = F.expr("array(" + ", ".join(f"{v!r}D" for v in lam.tolist()) + ")")
        tilt = F.exp(F.aggregate("x", F.lit(0.0), lambda s, p: s + p["v"] * F.get(literal, p["k"])))
        terms_of = cells.select((F.col("words") * tilt).alias("w"), F.explode(F.expr(terms)).alias("t"))
        value, got, hessian = 0.0, np.zeros(len(lam)), np.zeros((len(lam), len(lam)))
        for a, b, v in terms_of.groupBy("t.a", "t.b").agg(F.sum(F.col("w") * F.col("t.v"))).collect():
            if a < 0:
                value = v
            elif b < 0:
                got[a] = v
            else:
                hessian[a, b] = hessian[b, a] = v
        return value - float(lam @ goal), got, hessian

    value, got, hessian = at(lam)
    for _ in range(steps):
        if not (np.abs(got - goal) > close * np.maximum(1.0, np.abs(goal))).any():
            return lam.tolist()
        # constraints may depend on one another (sums of two columns' targets), so the least step is taken
        step = np.linalg.lstsq(hessian, goal - got, rcond=1e-12)[0]
        step /= max(1.0, float(np.abs(step).max()))
        for _ in range(40):
            tried = at(lam + step)
            if tried[0] <= value + 1e-12 * abs(value):
                break
            step /= 2
        lam, (value, got, hessian) = lam + step, tried
    raise ValueError(f"targets can't be met together: after {steps} steps the words of some constraint are off by {float(np.abs(got - goal).max()):g}")


def _in_rows(words: Column, target: Column, steps: int = 100) -> Column:
    """lambda of a constraint that shares no document with another, by Newton steps within its row."""
    value = lambda at: words * F.exp(at)
    step = lambda at, _: at + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (target - value(at)) / value(at)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return F.when(F.abs(value(found) - target) <= 1e-9 * target, found).otherwise(F.raise_error(F.lit("a target can't be met")).cast("double"))


def balance(docs: DataFrame, goals: dict[str, DataFrame], size: str = "size", most_constraints: int = DRIVER_CONSTRAINTS) -> dict[str, DataFrame]:
    """The tilt of every constraint: for each column of `docs` in `goals` (value, target), a table (value, lambda).

    A document's rate is exp of the sum of its values' lambda. Targets must be above 0 and have words; values without a goal are free (lambda 0)."""
    names = list(goals)
    count = {c: g.count() for c, g in goals.items()}
    if sum(count.values()) > most_constraints:
        if len(names) > 1:
            raise ValueError(f"{sum(count.values())} constraints of several columns; at most {most_constraints}")
        words = docs.groupBy(F.col(names[0]).alias("v")).agg(F.sum(size).cast("double").alias("words"))
        goal = goals[names[0]].select("value", "target").join(words, F.col("value").eqNullSafe(F.col("v")))
        return {names[0]: written(goal.select("value", _in_rows(F.col("words"), F.col("target")).alias("lambda")), "tilts")}
    numbered, wanted, first = {}, [], 0
    for c in names:
        # few rows: at most most_constraints
        at = F.row_number().over(Window.orderBy(F.col("value").asc_nulls_last())) - 1 + first
        numbered[c] = written(goals[c].select("value", F.col("target").cast("double").alias("target"), at.cast("int").alias("k")), "goals")
        wanted += [r["target"] for r in sorted(numbered[c].collect(), key=lambda r: r["k"])]
        first += count[c]
    cells = docs.groupBy(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(names)]).agg(F.sum(size).cast("double").alias("words"))
    for i, c in enumerate(names):
        of = numbered[c].select(F.col("value").alias("g"), F.col("k").alias(f"k_{i}"))
        cells = cells.join(of, F.col(f"c_{i}").eqNullSafe(F.col("g")), "left").drop("g")
    ks = F.filter(F.array(*[F.col(f"k_{i}") for i in range(len(names))]), lambda k: k.isNotNull())
    cells = written(cells.select("words", F.transform(ks, lambda k: F.struct(k.alias("k"), F.lit(1.0).alias("v"))).alias("x")), "cells")
    lam = newton(cells, wanted)
    literal = F.expr("array(" + ", ".join(f"{v!r}D" for v in lam) + ")") if lam else F.array().cast("array<double>")
    return {c: t.select("value", F.get(literal, F.col("k")).alias("lambda")) for c, t in numbered.items()}


def _hash(*names: str) -> Column:
    return F.xxhash64(*names, F.lit("mix"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", cell_rows: int = 500, **rule) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row of `docs`."""
    rows = docs.select("doc_id", F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = written(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    rows = written(_mixed(rows, cell_rows, rule), "copies")
    return _closed(rows)


def _mixed(rows: DataFrame, cell_rows: int, rule: dict) -> DataFrame:
    """rows (doc_id, source, size, n): a row for each of the n, with its copies and place."""
    per_source = written(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    goal = written(targets(per_source, **rule), "targets")
    reachable = goal.filter("source_size > 0 and target > 0").select(F.col("source").alias("value"), "target")
    tilt = balance(rows.select("source", (F.col("size") * F.col("n")).alias("size")), {"source": reachable})["source"]
    # rates just under a whole number (2 of 2 words) must not lose copies to the last bits of exp
    rate = F.least(F.lit(float(rule.get("most", MOST))), F.round(F.exp("lambda"), 9))
    goal = goal.join(tilt, F.col("source").eqNullSafe(F.col("value")), "left").select(F.col("source").alias("s"), "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    classed = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    per_class = classed.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("salts"))
    per_class = per_class.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), "salts")
    dealt = classed.join(per_class, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class"))).drop("c_source", "c_class")
    # rows of one id are told apart by their sizes; equal ones are one row here
    dealt = dealt.withColumn("salt", F.pmod(_hash("doc_id", "size"), F.col("salts")).cast("int")).drop("salts")
    cell, until = ["source", "class", "salt"], (Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*cell).agg(F.sum("n").alias("n"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("source", "class").orderBy("salt").rowsBetween(*until)), F.lit(0))
    by_class = counts.groupBy("source", "class").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(*until)), F.lit(0))
    by_class = by_class.select(F.col("source").alias("a_source"), F.col("class").alias("a_class"), above.alias("above"))
    base = counts.withColumn("inside", inside).join(by_class, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("class") == F.col("a_class")))
    base = base.select(*[F.col(c).alias(f"b_{c}") for c in cell], (F.col("inside") + F.col("above")).alias("base"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy(F.desc("size"), "doc_id").rowsBetween(*until)), F.lit(0))
    placed = dealt.withColumn("start", start)
    placed = placed.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")) & (F.col("salt") == F.col("b_salt")))
    placed = placed.select("doc_id", "source", "size", "n", (F.col("base") + F.col("start")).alias("start"))
    each = _each(written(placed, "places"))
    each = each.join(goal, F.col("source").eqNullSafe(F.col("s")))
    copies = (F.floor(F.col("rate") * F.col("place") + 0.5) - F.floor(F.col("rate") * (F.col("place") - 1) + 0.5)).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", "rate", "place", copies.alias("copies"))


def _each(rows: DataFrame, chunk: int = 1_000) -> DataFrame:
    """A row with its place for each of the n that a row stands for. Those of more than `chunk` are dealt out in chunks first."""
    kept = ["doc_id", "source", "size"]
    few = rows.filter(F.col("n") <= chunk).select(*kept, "start", F.col("n").alias("left"))
    lot = rows.filter(F.col("n") > chunk).select(*kept, "start", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("c"))
    lot = lot.repartition("doc_id", "source", "size", "c").select(*kept, (F.col("start") + F.col("c") * chunk).alias("start"), F.least(F.lit(chunk).cast("long"), F.col("n") - F.col("c") * chunk).alias("left"))
    return few.unionAll(lot).select(*kept, F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("left"))).alias("place"))


def _closed(rows: DataFrame) -> DataFrame:
    """One copy more or less of a few documents of each size class, so that the words taken meet the target."""
    most = F.lit(MOST)
    off = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.max("target").alias("goal"))
    off = off.select(F.col("source").alias("s"), (F.col("goal") - F.col("got")).alias("off"))
    # at most 4 candidates of a size class and direction, whatever the number of documents: max_by, not a list of all
    pick = F.struct("size", _hash("doc_id").alias("h"), "doc_id", "place")
    sized = rows.filter("size > 0 and rate > 0").withColumn("class", F.floor(F.log2("size")).cast("int")).withColumn("slot", F.pmod(_hash("doc_id"), F.lit(4)))
    best = sized.groupBy("source", "class", "slot").agg(F.max(F.when(F.col("copies") < most, pick)).alias("more"), F.max(F.when(F.col("copies") > 0, pick)).alias("less"))
    lists = best.groupBy("source").agg(*[F.reverse(F.array_sort(F.collect_list(c))).alias(c) for c in ("more", "less")])
    lists = lists.join(off, F.col("source").eqNullSafe(F.col("s")))
    way = F.when(F.col("off") > 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")
    none = F.filter(F.col("more"), lambda x: F.lit(False))

    def take(state, x):
        fits = x["size"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - x["size"]).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["took"], F.array(x))).otherwise(state["took"]).alias("took"))

    start = F.struct(F.abs("off").cast("double").alias("left"), none.alias("took"))
    took = F.aggregate(F.when(F.col("off") > 0, F.col("more")).otherwise(F.col("less")), start, take)["took"]
    # of repeated rows of one id only one changes, told by its place, which is its own within the source
    flips = lists.select(F.col("s"), way.alias("way"), F.explode(took).alias("x")).select(F.col("s"), "way", F.col("x.place").alias("f_place"))
    key = F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("f_place"))
    copies = F.greatest(F.lit(0).cast("long"), F.least(most.cast("long"), F.col("copies") + F.coalesce("way", F.lit(0).cast("long"))))
    out = rows.join(flips, key, "left").withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
