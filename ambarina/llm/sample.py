"""A sample whose categories have given shares, with a floor for each, by swap repair on counts.

Records are grouped by their signature, the categories they fall in for the fields of a plan. A random sample of the wanted size that
meets the floors is drawn as counts of signatures; then counts are exchanged between two signatures, always the exchange that lowers the
deviation from the target counts most, until none lowers it. Last, each signature's records are drawn at random: those whose hashes are
lowest. What the repaired sample misses is reported with the reason.

A category with fewer records than it needs has all of them as its floor. Floors that cannot all be met (together they exceed the size, or
contradict each other) are first repaired by the same exchanges until no exchange lowers what they lack; the sample keeps its size.

Only counts of signatures reach the driver: as many as combinations of listed categories occur. Drawing n of a signature of N records
takes no window over the signature: a histogram of 4096 hash ranges finds the range in which the n-th lies, and only it is ranked.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import folded

RANGES = 4096
#: Words before the name of a specialty.
BEFORE = r"^(servicio|serv|consultas?|unidad|seccion|departamento|dpto|dep|area)\.?( de la| del| de)? "


def named(value: Column) -> Column:
    """What a category's name says, however it is written: without case, accents, surplus blanks, or the words of a unit before it."""
    return F.regexp_replace(F.regexp_replace(folded(value), BEFORE, ""), r"[\s.,;:]+$", "")


@dataclass
class Plan:
    """size; for each field its categories with (share, floor)."""

    plan_id: int
    size: int
    fields: dict[str, dict[str, tuple[float, int]]] = field(default_factory=dict)


def plans_of(quotas: DataFrame) -> list[Plan]:
    """Plans of a table of quotas (plan_id, campo, categoria, cuota, minimo, tamano): a row a category, whatever the size of the data.

    Null shares and floors are 0; of two rows for one category the first in order of share counts; a null category or field is left out.
    """
    out: dict[int, Plan] = {}
    for r in sorted(quotas.distinct().collect(), key=lambda r: (r.plan_id or 0, r.campo or "", r.categoria or "", r.cuota or 0)):
        if r.plan_id is None or r.campo is None or r.categoria is None:
            continue
        plan = out.setdefault(r.plan_id, Plan(r.plan_id, 0))
        plan.size = max(plan.size, r.tamano or 0)
        plan.fields.setdefault(r.campo, {}).setdefault(r.categoria, (r.cuota or 0.0, r.minimo or 0))
    return list(out.values())


def needed(plan: Plan, share: float, floor: int) -> int:
    return max(floor, math.floor(share * plan.size + 0.5))


def signatures(cases: DataFrame, plans: list[Plan], key: str = "id") -> DataFrame:
    """key, plan_id, firma (an array: the category in each field of the plan, null for none), once a record and plan.

    A record delivered several times counts once; where deliveries name different categories of a field, the first in order. A null or
    unlisted value falls in no category; null keys are left out.
    """
    spark = cases.sparkSession
    if not plans:
        return spark.createDataFrame([], T.StructType([cases.schema[key], T.StructField("plan_id", T.IntegerType()), T.StructField("firma", T.ArrayType(T.StringType()))]))
    fields = sorted({f for p in plans for f in p.fields})
    table = [(f, folded_name, p.plan_id, c) for p in plans for f, cs in p.fields.items() for c in cs for folded_name in (c,)]
    known = spark.createDataFrame(table, "campo string, escrita string, plan_id int, categoria string").withColumn("n", named(F.col("escrita")))
    lists: dict[tuple[int, str], dict[str, str]] = defaultdict(dict)
    for r in known.orderBy("categoria").collect():  # the quota table again, names folded
        lists[r.plan_id, r.campo].setdefault(r.n, r.categoria)

    def category(plan: Plan, f: str) -> Column:
        names = [x for n, c in lists[plan.plan_id, f].items() for x in (F.lit(n), F.lit(c))]
        return F.try_element_at(F.create_map(*names), named(F.col(f).cast("string")))

    each = F.array(*(F.struct(F.lit(p.plan_id).alias("plan_id"), F.array(*(category(p, f) for f in sorted(p.fields))).alias("firma")) for p in plans))
    rows = cases.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), *{f.split(".")[0] for f in fields})
    out = rows.select("__k", F.explode(each).alias("s")).select("__k", "s.plan_id", "s.firma")
    width = {p.plan_id: len(p.fields) for p in plans}
    best = F.array(*(F.min(F.try_element_at("firma", F.lit(i + 1))).alias(f"c{i}") for i in range(max(width.values(), default=0))))
    trim = F.lit(None).cast("int")
    for p, n in width.items():
        trim = F.when(F.col("plan_id") == p, n).otherwise(trim)
    return out.groupBy(F.col("__k").alias(key), "plan_id").agg(best.alias("firma")).withColumn("firma", F.slice("firma", F.lit(1), trim))


class Counts:
    """Counts of signatures and of the categories they fall in; the best exchange of one record between two signatures.

    An exchange a -> b changes only the categories in which the two differ. For a set M of fields in which b agrees with a, the best b is
    the least of its group by the categories of M; the least over all M is the best of all. So a step looks at every signature once for
    each M and holds no matrix of pairs: n signatures of f fields take n * 2 ** f.
    """

    def __init__(self, sigs: list[tuple], have: np.ndarray):
        self.have, self.x = have, np.zeros(len(sigs), dtype=np.int64)
        self.width = len(sigs[0])
        cats: dict[tuple, int] = {}
        self.of = np.array([[cats.setdefault((i, c), len(cats)) for i, c in enumerate(s)] for s in sigs], dtype=np.int64).reshape(len(sigs), self.width)
        self.cats = cats
        self.groups = []  # of each M: its fields, and the signatures in the order of their groups
        for m in range(2**self.width):
            fields = [i for i in range(self.width) if m >> i & 1]
            group = np.unique(self.of[:, fields], axis=0, return_inverse=True)[1].ravel() if fields else np.zeros(len(sigs), dtype=np.int64)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
            self.groups.append((fields, group, order, starts))

    def by_category(self) -> np.ndarray:
        return np.bincount(self.of.ravel(), weights=np.repeat(self.x, self.width), minlength=len(self.cats)).round().astype(np.int64)

    def best(self, more: np.ndarray, less: np.ndarray, tight: np.ndarray) -> tuple[float, int, int]:
        """(change, a, b) of the exchange of least change; ``more`` and ``less``: the change by one record more or less in a category, ``tight``:
        categories that may not lose one."""
        gives, takes = self.x > 0, self.x < self.have
        b_cost, a_cost = np.where(takes, more[self.of].sum(1), np.inf), np.where(gives, less[self.of].sum(1), np.inf)
        held, same = tight[self.of], (more + less)[self.of]
        out = (0.0, -1, -1)
        for fields, group, order, starts in self.groups:
            rest = [i for i in range(self.width) if i not in fields]
            may = ~held[:, rest].any(1) if rest else np.ones(len(self.x), bool)
            least = np.minimum.reduceat(b_cost[order], starts)
            change = np.where(may, a_cost + least[group] - (same[:, fields].sum(1) if fields else 0), np.inf)
            a = int(np.argmin(change))
            if change[a] < out[0]:
                own = order[starts[group[a]] : (starts[group[a] + 1] if group[a] + 1 < len(starts) else None)]
                out = (float(change[a]), a, int(own[np.argmin(b_cost[own])]))
        return out

    def exchange(self, a: int, b: int, f, n: np.ndarray, lo: np.ndarray) -> None:
        """Moves from a to b as many records as lower the sum of ``f`` most, no category that loses any falling below ``lo``."""
        out, into = self.of[a][self.of[a] != self.of[b]], self.of[b][self.of[a] != self.of[b]]
        most = int(min(self.x[a], self.have[b] - self.x[b], *(n[out] - lo[out])))
        value = lambda s: f(out, n[out] - s).sum() + f(into, n[into] + s).sum()
        low, high = 1, most
        while low < high:  # the sum is convex in the number
            mid = (low + high) // 2
            low, high = (low, mid) if value(mid) <= value(mid + 1) else (mid + 1, high)
        self.x[a] -= low
        self.x[b] += low
        n[out] -= low
        n[into] += low


def repair(plan: Plan, sizes: dict[tuple, int], seed: int = 0) -> dict[tuple, int]:
    """How many records of each signature to draw: never more than the plan's size, and as many as there are if there are fewer."""
    rng = np.random.default_rng([seed, plan.plan_id & 0xFFFFFFFF])
    sigs = sorted(sizes, key=str)
    if not sigs:
        return {}
    c = Counts(sigs, np.array([sizes[s] for s in sigs], dtype=np.int64))
    size = int(min(plan.size, c.have.sum()))
    c.x = c.have.copy()
    there = c.by_category()
    # targets and floors; a field's rest, of records in none of its categories, has what the shares leave
    t, lo = np.zeros(len(c.cats)), np.zeros(len(c.cats), dtype=np.int64)
    for (i, name), k in c.cats.items():
        of = plan.fields[sorted(plan.fields)[i]]
        if name is None:
            t[k] = max(0.0, 1 - sum(q for q, _ in of.values())) * plan.size
        else:
            share, least = of[name]
            t[k], lo[k] = share * plan.size, there[k] if there[k] < needed(plan, share, least) else least
    c.x = np.zeros(len(sigs), dtype=np.int64)
    for k in np.argsort(there, kind="stable"):  # floors, the scarcest category first
        own = (c.of == k).any(1)
        lack = min(int(lo[k] - c.x[own].sum()), size - int(c.x.sum()))
        if lack > 0 and (room := np.where(own, c.have - c.x, 0)).sum():
            c.x += rng.multivariate_hypergeometric(room, min(lack, int(room.sum())), method="marginals")
    if (rest := size - int(c.x.sum())) > 0:
        c.x += rng.multivariate_hypergeometric(c.have - c.x, rest, method="marginals")
    n = c.by_category()
    # what the floors lack: whole numbers, so every exchange lowers a whole number and the loop ends
    lacks = lambda k, v: np.maximum(lo[k] - v, 0) ** 2
    every, none = np.arange(len(t)), np.zeros(len(t), dtype=np.int64)
    while True:
        change, a, b = c.best(lacks(every, n + 1) - lacks(every, n), lacks(every, n - 1) - lacks(every, n), np.zeros(len(t), bool))
        if change >= 0:
            break
        c.exchange(a, b, lacks, n, none)
    lo = np.minimum(lo, n)
    # deviations count relative to their target, so that a surplus spreads in proportion; each exchange lowers their sum, which takes
    # finitely many values
    w = 1 / np.maximum(t, 1.0)
    off = lambda k, v: w[k] * (v - t[k]) ** 2
    while True:
        change, a, b = c.best(w * (2 * (n - t) + 1), w * (1 - 2 * (n - t)), n <= lo)
        if change >= -1e-9 * w.min():
            break
        c.exchange(a, b, off, n, lo)
    return {s: int(v) for s, v in zip(sigs, c.x) if v}


def counts_of(signed: DataFrame) -> dict[int, dict[tuple, int]]:
    out: dict[int, dict[tuple, int]] = defaultdict(dict)
    for r in signed.groupBy("plan_id", "firma").agg(F.count("*").alias("n")).collect():  # combinations of listed categories
        out[r.plan_id][tuple(r.firma)] = r.n
    return out


SHORT, FLOORS, OTHERS = "faltan registros", "los mínimos no caben", "otras categorías"


def report(plans: list[Plan], sizes: dict[int, dict[tuple, int]], drawn: dict[int, dict[tuple, int]], spark) -> DataFrame:
    """plan_id, campo, categoria, cuota, necesarios, disponibles, tomados, cuota_real, corto, motivo: a row a category.

    ``motivo`` says why the repaired sample has fewer than needed, null if it has not: too few records exist (``corto``), the floors of the
    plan exceed its size or contradict each other, or the targets and floors of other categories leave no more.
    """
    rows = []
    for p in plans:
        total = sum(drawn.get(p.plan_id, {}).values())
        for i, f in enumerate(sorted(p.fields)):
            have, took = defaultdict(int), defaultdict(int)
            for tally, of in ((have, sizes), (took, drawn)):
                for s, n in of.get(p.plan_id, {}).items():
                    tally[s[i]] += n
            for c, (share, floor) in p.fields[f].items():
                need = needed(p, share, floor)
                why = None if took[c] >= need else SHORT if have[c] < need else FLOORS if took[c] < floor else OTHERS
                rows.append((p.plan_id, f, c, float(share), need, have[c], took[c], took[c] / total if total else 0.0, why == SHORT, why))
    return spark.createDataFrame(rows, "plan_id int, campo string, categoria string, cuota double, necesarios long, disponibles long, tomados long, cuota_real double, corto boolean, motivo string")


def draw(signed: DataFrame, wanted: dict[int, dict[tuple, int]], key: str = "id", seed: int = 0) -> DataFrame:
    """key, plan_id, firma of the records drawn: the lowest hashes of each signature, ties by key."""
    spark = signed.sparkSession
    rows = [(p, list(s), n) for p, by in wanted.items() for s, n in by.items()]
    want = spark.createDataFrame(rows, "plan_id int, firma array<string>, n long")  # a row a signature, made here
    join = lambda df, other: df.join(F.broadcast(other), (df.plan_id == other.plan_id) & df.firma.eqNullSafe(other.firma)).drop(other.plan_id, other.firma)
    h = F.xxhash64(F.col(key), F.col("plan_id"), F.lit(seed))
    hashed = signed.withColumn("__h", h).withColumn("__r", F.pmod("__h", F.lit(RANGES)))
    hist = join(hashed.groupBy("plan_id", "firma", "__r").agg(F.count("*").alias("c")), want)
    below = F.coalesce(F.sum("c").over(_range_window()), F.lit(0))
    cutting = hist.withColumn("below", below).filter("below < n").select("plan_id", "firma", "__r", F.least(F.col("c"), F.col("n") - F.col("below")).alias("take"), "c")
    # at most RANGES rows a signature; most are taken whole and need no rank
    picked = hashed.alias("a").join(cutting.alias("b"), (F.col("a.plan_id") == F.col("b.plan_id")) & F.col("a.firma").eqNullSafe(F.col("b.firma")) & (F.col("a.__r") == F.col("b.__r"))).select("a.*", "take", "c")
    whole = picked.filter("take = c")
    part = picked.filter("take < c").withColumn("__n", F.row_number().over(_rank_window(key))).filter("__n <= take").drop("__n")
    return whole.unionByName(part).select(key, "plan_id", "firma")


def _range_window():
    from pyspark.sql import Window

    return Window.partitionBy("plan_id", "firma").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)


def _rank_window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy("plan_id", "firma", "__r").orderBy("__h", key)


def solve(cases: DataFrame, quotas: DataFrame, key: str = "id", seed: int = 0) -> tuple[DataFrame, dict[int, dict[tuple, int]], DataFrame]:
    """(signed records, counts to draw, report)."""
    plans = plans_of(quotas)
    signed = signatures(cases, plans, key)
    sizes = counts_of(signed)
    wanted = {p.plan_id: repair(p, sizes.get(p.plan_id, {}), seed) for p in plans}
    return signed, wanted, report(plans, sizes, wanted, cases.sparkSession)
