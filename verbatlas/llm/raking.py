"""Samples whose shares of several categories match targets, with minimums and a report of what is missing.

The rows of a plan are counted by cell (the combination of the fields that its targets name). On the
cells, which are as few as the categories, weights are raked by iterative proportional fitting until
every target's weighted share is met as nearly as can be. Cells that meet the same targets form a
group; each takes the raked number of rows, then minimums, and after them shares, are repaired: a short
target takes more rows of any group that it meets, replacing rows of groups with rows to spare. A
group's rows are drawn without replacement by weighted exponential keys (the smallest -ln(u) / weight).
How keys are spread follows from the cells' counts and weights, so bounds are known below which fewer
rows than wanted lie, and below which more do: rows under the first are taken where they stand, and
only those between the bounds, about as many as the root of the sample, are ranked.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

FIELDS = ("sentiment", "page_type", "category")
UNKNOWN = "unknown"
ROUNDS = 200
#: Rows of cells that are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def needed_rows(share: float | None, size: int | None, least: int | None) -> int:
    """The larger of the minimum and share x size, rounded to the nearest integer (a half up)."""
    return max(least or 0, math.floor(round((share or 0) * (size or 0), 6) + 0.5))


def _targets(plans: DataFrame) -> list:
    """The plans themselves: a table of settings, which a person writes."""
    return plans.select("plan_id", "target_no", "project_id", "sample_size", *FIELDS, "share", "min_rows").collect()


OTHER = "\u0001other"


def _scoped(rows: DataFrame, plans: list, *keep: Column) -> DataFrame:
    """Rows with only the projects and values that the plans name: other projects are null, other values OTHER.

    So there are never more combinations than the plans allow, however dirty the categories are. A
    null value stays null; the literal string `unknown` is another value.
    """
    projects = sorted({t.project_id for t in plans if t.project_id is not None})
    scope = F.when(F.col("project_id").isin(projects), F.col("project_id")) if projects else F.lit(None).cast("string")
    values = []
    for f in FIELDS:
        named = sorted({getattr(t, f) for t in plans if getattr(t, f) not in (None, UNKNOWN)})
        values.append((F.when(F.col(f).isin(named), F.col(f)) if named else F.when(F.col(f).isNull(), None)).when(F.col(f).isNotNull(), F.lit(OTHER)).alias(f))
    return rows.select(*keep, scope.alias("project_id"), *values)


def cells(rows: DataFrame, plans: list) -> DataFrame:
    """Counts of all rows by project and category values as the plans name them."""
    return _scoped(rows, plans).groupBy("project_id", *FIELDS).agg(F.count("*").alias("n"))


def _meets(t, cell) -> bool:
    if t.project_id is not None and cell.project_id != t.project_id:
        return False
    return all(getattr(t, f) is None or (cell[f] is None if getattr(t, f) == UNKNOWN else cell[f] == getattr(t, f)) for f in FIELDS)


def rake(counts: list[int], members: list[list[int]], shares: list[float], rounds: int = ROUNDS) -> list[float]:
    """Weights per row of each cell, so that target k's cells hold share k of the weight, as nearly as can be.

    members[k]: the cells of target k. Targets that no row meets are left out. Cells of no target share
    what the shares leave over.
    """
    weights = [1.0] * len(counts)
    covered = set(itertools.chain.from_iterable(members))
    groups = [(m, s) for m, s in zip(members, shares) if sum(counts[i] for i in m) > 0]
    rest = [i for i in range(len(counts)) if i not in covered]
    left = 1 - sum(s for _, s in groups)
    if rest and sum(counts[i] for i in rest):
        groups.append((rest, max(left, 0.0)))
    for _ in range(rounds):
        off = 0.0
        for m, share in groups:
            total = sum(w * n for w, n in zip(weights, counts))
            own = sum(weights[i] * counts[i] for i in m)
            if total <= 0 or own <= 0:
                continue
            want = share / max(1e-12, 1 - share) * (total - own) if total > own else own
            factor = want / own
            off = max(off, abs(factor - 1))
            for i in m:
                weights[i] *= factor
        if off < 1e-9:
            break
        top = max(weights)
        if top > 0:
            weights = [w / top for w in weights]
    return weights


def _path(k: int, x: list[int], room: list[int], meets: list[set[int]], total: list[int], goal: list[int], free: bool, weight: list[float]) -> list[tuple[int, int | None]]:
    """Moves (group that takes a row, group that gives one or None) after which target k has a row more and no other falls short; empty if there are none.

    A row that a target with none to spare gives is made up for by the next move.
    """
    seen, queue = {k}, [(k, [])]
    for m, moves in queue:
        take = sorted((g for g in range(len(x)) if m in meets[g] and x[g] < room[g]), key=lambda g: (-sum(total[t] < goal[t] for t in meets[g]), -weight[g], g))
        if take and free:
            return [*moves, (take[0], None)]
        for g in take:
            for h in sorted((h for h in range(len(x)) if h != g and x[h] > 0 and m not in meets[h]), key=lambda h: (weight[h], h)):
                short = [t for t in meets[h] - meets[g] if total[t] <= goal[t]]
                if not short:
                    return [*moves, (g, h)]
                if len(short) == 1 and short[0] not in seen:
                    seen.add(short[0])
                    queue.append((short[0], [*moves, (g, h)]))
    return []


def repair(x: list[int], room: list[int], meets: list[set[int]], goal: list[int], size: int, weight: list[float], beyond: bool = False) -> list[int]:
    """Rows per group, changed until each target has its goal or no exchange of rows helps it.

    meets[g]: the targets that group g meets; room[g]: its rows. A row counts for every target that it
    meets. The sum stays within size; `beyond` lets a target exceed it that nothing else helps.
    """
    x = list(x)
    count = lambda x: [sum(n for n, m in zip(x, meets) if k in m) for k in range(len(goal))]
    for k in range(len(goal)):
        while (total := count(x))[k] < goal[k]:
            moves = _path(k, x, room, meets, total, goal, sum(x) < size, weight)
            if not moves and beyond:
                moves = [(g, None) for g in range(len(x)) if k in meets[g] and x[g] < room[g]][:1]
                size = max(size, sum(x) + goal[k] - total[k])
            step, done = goal[k] - total[k], False
            while moves and step and not done:
                y = list(x)
                for g, h in moves:
                    y[g] += step
                    if h is not None:
                        y[h] -= step
                after = count(y)
                done = all(0 <= n <= r for n, r in zip(y, room)) and sum(y) <= max(size, sum(x)) and after[k] > total[k] and all(b >= min(a, c) for a, b, c in zip(total, after, goal))
                x, step = (y, step) if done else (x, step // 2)
            if not done:
                break
    return x


def allocate(room: list[int], meets: list[set[int]], weight: list[float], needed: list[int], least: list[int], size: int) -> list[int]:
    """Rows to draw of each group: their raked part of the sample, then the targets' minimums (beyond the size if they must) and needs repaired."""
    x = [min(r, math.floor(size * w)) for r, w in zip(room, weight)]
    for g in sorted(range(len(x)), key=lambda g: weight[g]):  # a target takes up to its share
        over = [sum(n for n, m in zip(x, meets) if k in m) - needed[k] for k in meets[g]]
        x[g] -= max(0, min([x[g], *over]))
    x = repair(x, room, meets, least, size, weight, beyond=True)
    return repair(x, room, meets, needed, size, weight)


def plan_report(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Per target: rows needed, rows there are, and whether it can be met. All rows count, each once.

    A plan without rows reports 0; empty plans give no rows; null project means all projects; rows whose
    value is null match only targets `unknown` or without that field; the literal value `unknown` is not null.
    """
    wanted = _targets(plans)
    found = cells(rows, wanted).collect()  # at most as many as the plans' values combine to
    out = []
    for t in wanted:
        need, there = needed_rows(t.share, t.sample_size, t.min_rows), sum(c.n for c in found if _meets(t, c))
        out.append((t.plan_id, t.target_no, need, there, there >= need))
    return rows.sparkSession.createDataFrame(out, "plan_id int, target_no int, needed long, available long, met boolean")


def key_bounds(counts: list[int], weights: list[float], take: int) -> tuple[float, float]:
    """Keys below which surely fewer, and surely more, than `take` of the cells' rows lie: eight deviations off what is expected."""
    total, slack = sum(counts), 8 * math.sqrt(take) + 64

    def key_of(rows: float) -> float:
        low, high = 0.0, 1.0
        expected = lambda t: sum(-n * math.expm1(-w * t) for n, w in zip(counts, weights))
        while expected(high) < rows:
            high *= 2
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if expected(middle) < rows else (low, middle)
        return high

    if take >= total:
        return math.inf, math.inf
    return key_of(take - slack) if take > slack else 0.0, key_of(take + slack) if take + slack < 0.999 * total else math.inf


def raked_sample(rows: DataFrame, plans: DataFrame, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The samples, rows (plan_id, id_col, target_no), and the report, per target (plan_id, target_no, needed, available, taken, gap).

    Rows are drawn by exponential keys with raked weights. A target takes up to its share of the sample
    and at least its minimum; a row is drawn at most once per plan and counts for all targets that it
    meets, which may take more than the shares of overlapping ones; target_no is the scarcest. What no
    target can fill is not filled by other categories but reported as gap. Rows without an id are left out.
    """
    wanted = _targets(plans)
    found = _scoped(rows, wanted, F.col(id_col).alias("_id")).groupBy("project_id", *FIELDS).agg(F.count("*").alias("n"), F.count("_id").alias("ids")).collect()
    spark = rows.sparkSession
    quota_rows, cell_rows, group_rows = [], [], []
    for plan, group in itertools.groupby(sorted(wanted, key=lambda t: (t.plan_id, t.target_no)), key=lambda t: t.plan_id):
        targets = list(group)
        inside = [c for c in found if any(t.project_id is None or c.project_id == t.project_id for t in targets)]
        members = [[i for i, c in enumerate(inside) if _meets(t, c)] for t in targets]
        weights = rake([c.n for c in inside], members, [t.share or 0.0 for t in targets])
        for k, t in enumerate(targets):
            quota_rows.append((plan, t.target_no, needed_rows(t.share, t.sample_size, t.min_rows), t.min_rows or 0, t.sample_size or 0, sum(inside[i].n for i in members[k])))
        mass = sum(w * c.n for w, c in zip(weights, inside)) or 1.0
        own = [frozenset(k for k, m in enumerate(members) if i in m) for i in range(len(inside))]
        groups = sorted({o for o in own if o}, key=sorted)
        of = [[i for i, o in enumerate(own) if o == g] for g in groups]
        quota = quota_rows[len(quota_rows) - len(targets) :]
        room = [sum(inside[i].ids for i in m) for m in of]
        take = allocate(room, [set(g) for g in groups], [sum(weights[i] * inside[i].n for i in m) / mass for m in of], [q[2] for q in quota], [q[3] for q in quota], max(q[4] for q in quota))
        for g, (group, m, n) in enumerate(zip(groups, of, take)):
            k = min(group, key=lambda k: (quota[k][5] - quota[k][2], k))  # the scarcest target that the group serves
            group_rows += [(plan, g, targets[t].target_no) for t in sorted(group)]
            weight = [float(weights[i]) or 1e-12 for i in m]
            low, high = key_bounds([inside[i].ids for i in m], weight, n)
            cell_rows += [[plan, g, n, targets[k].target_no, inside[i].project_id, *(inside[i][f] for f in FIELDS), w, low, high] for i, w in zip(m, weight)]
    quotas = spark.createDataFrame(quota_rows, "plan_id int, target_no int, needed long, min_rows long, sample_size long, available long")
    served = spark.createDataFrame(group_rows, "plan_id int, _group int, target_no int")
    src = _scoped(rows.where(F.col(id_col).isNotNull()), wanted, F.col(id_col).alias("_id")).withColumnRenamed("project_id", "_scope")
    small = F.broadcast if len(cell_rows) <= BROADCAST_CELLS else lambda df: df  # plans x category combinations

    def drawn(cells: list) -> DataFrame:
        kind = "plan_id int, _group int, take long, target_no int, _project string, sentiment string, page_type string, category string, weight double, low double, high double"
        weighted = spark.createDataFrame(cells, kind)
        on = [src[f].eqNullSafe(weighted[f]) for f in FIELDS] + [src["_scope"].eqNullSafe(weighted["_project"])]
        keyed = src.join(small(weighted), on).select("_id", "plan_id", "_group", "take", "target_no", "weight", "low", "high").where("take > 0")
        return keyed.withColumn("key", -F.log((F.pmod(F.xxhash64(F.lit(seed), "plan_id", "_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.col("weight"))

    below = drawn(cell_rows).groupBy("plan_id", "_group").agg(F.count_if(F.col("key") < F.col("low")).alias("sure"), F.count_if(F.col("key") < F.col("high")).alias("enough"))
    sure = {(r.plan_id, r["_group"]): (r.sure, r.enough) for r in below.collect()}
    for c in cell_rows:  # bounds that chance has proved wrong are given up: all of the group's rows are ranked
        under, within = sure.get((c[0], c[1]), (0, 0))
        if c[2] < math.inf and not (under <= c[2] <= within or under == within <= c[2]):
            c[-2:] = 0.0, math.inf
    counted = spark.createDataFrame([(*k, under) for k, (under, _) in sure.items()], "plan_id int, _group int, sure long")
    keyed = drawn(cell_rows)
    taken = keyed.where(F.col("key") < F.col("low")).select("plan_id", "_group", "_id", "target_no")
    band = keyed.where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("high"))).join(small(counted), ["plan_id", "_group"])
    left = F.when(F.col("low") > 0, F.col("take") - F.col("sure")).otherwise(F.col("take"))
    best = band.withColumn("rank", F.row_number().over(Window.partitionBy("plan_id", "_group").orderBy("key", "_id"))).where(F.col("rank") <= left)
    taken = taken.unionByName(best.select("plan_id", "_group", "_id", "target_no"))
    sample = taken.select("plan_id", F.col("_id").alias(id_col), "target_no")
    counts = taken.groupBy("plan_id", "_group").agg(F.count("*").alias("n")).join(small(served), ["plan_id", "_group"]).groupBy("plan_id", "target_no").agg(F.sum("n").alias("taken"))
    report = quotas.join(counts, ["plan_id", "target_no"], "left").select("plan_id", "target_no", "needed", "available", F.coalesce("taken", F.lit(0)).alias("taken"))
    return sample, report.withColumn("gap", F.greatest(F.lit(0).cast("long"), F.col("needed") - F.col("taken")))
