"""Mixing sources to target weights by cube-method balanced sampling.

A mixture wants ``cuota`` of ``presupuesto_tokens`` from each source, no document used more than ``max_usos`` times. A source of T tokens
is used c = target / T times: every document floor(c) times, and once more with probability f = c - floor(c). The once-more draw is
balanced on the number of documents and of tokens: the flight moves the probabilities of three documents at a time along the direction
that leaves both totals as they are, until one of them is 0 or 1. Documents fly in BUCKETS buckets by the hash of their id, in the order
of their ids, and each keeps at most two undecided for each mixture and source; these alone meet in one task (at most two a bucket), fly
on, and the last two land, first keeping the number of tokens, then by their own probability. So the total misses its target by less than
one document.

Nothing but the totals of the sources named in the mixtures and these few undecided documents is ever gathered. Draws depend on the rows
and a seed alone, not on how the table is split or how many tasks there are. A source that cannot give its target is used to its cap and
reported.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

EDGE = 1e-9
#: Buckets of documents that fly together, however many tasks there are.
BUCKETS = 1024


@dataclass(frozen=True)
class Part:
    """What a mixture takes of a source: every document ``times``, and once more with probability ``more``."""

    mezcla_id: int
    times: int
    more: float


class Flight:
    """The undecided documents (id, tokens, probability) of one mixture and source, never more than two between calls of ``add``."""

    def __init__(self, seed: str):
        self.random, self.open = random.Random(seed), []

    def add(self, key, tokens: float, p: float) -> list[tuple]:
        """Decided (id, tokens, 0 or 1)."""
        done = self._settle([[key, tokens, p]])
        while len(self.open) >= 3:
            (a, b, c) = self.open[:3]
            t = (a[1], b[1], c[1])
            u = (t[2] - t[1], t[0] - t[2], t[1] - t[0])
            self._move(self.open[:3], (1.0, -1.0, 0.0) if u == (0, 0, 0) else u)
            units, self.open = self.open, []
            done += self._settle(units)
        return done

    def land(self) -> list[tuple]:
        done = []
        while len(self.open) >= 2:
            a, b = self.open[:2]
            self._move([a, b], (b[1], -a[1]))
            units, self.open = self.open, []
            done += self._settle(units)
        for key, tokens, p in self.open:
            done.append((key, tokens, int(self.random.random() < p)))
        self.open = []
        return done

    def _move(self, units: list[list], u: tuple[float, ...]) -> None:
        up = min((1 - x[2]) / d if d > 0 else x[2] / -d for x, d in zip(units, u) if d)
        down = min(x[2] / d if d > 0 else (1 - x[2]) / -d for x, d in zip(units, u) if d)
        by = up if self.random.random() * (up + down) < down else -down
        for x, d in zip(units, u):
            x[2] += by * d

    def _settle(self, units: list[list]) -> list[tuple]:
        done = []
        for x in units:
            if x[2] <= EDGE or x[2] >= 1 - EDGE:
                done.append((x[0], x[1], int(x[2] > 0.5)))
            else:
                self.open.append(x)
        return done


def targets(sizes: DataFrame, mixtures: DataFrame) -> DataFrame:
    """The mixtures' rows with objetivo (tokens wanted), disponible (tokens of the source), n_docs and corto (the cap is in the way).

    sizes: doc_id, source, n_tokens. A source that is not in the corpus has 0; a null source or share wants nothing; a null cap is 1.
    The join is on sources summed before, one row each.
    """
    by = sizes.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("disponible"), F.count_if(F.col("n_tokens") > 0).alias("n_docs"))
    m = mixtures.select("mezcla_id", "source", "cuota", "max_usos", "presupuesto_tokens").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    goal = F.coalesce(F.col("cuota") * F.col("presupuesto_tokens"), F.lit(0.0))
    out = m.join(by, "source", "left").select("mezcla_id", "source", "cuota", F.coalesce("max_usos", F.lit(1)).alias("max_usos"), "presupuesto_tokens", F.when(F.col("source").isNull(), 0.0).otherwise(goal).alias("objetivo"), zero("disponible"), zero("n_docs"))
    return out.withColumn("corto", F.col("objetivo") > F.col("max_usos") * F.col("disponible"))


def draw(sizes: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """mezcla_id, source, doc_id, n_tokens, usos of every document a mixture uses. ``sizes`` should be a table that is read, not computed,
    as it is read twice. Documents without tokens or source are never used; of rows with one id each counts for itself. Only ids and sizes
    are shuffled, into the buckets.
    """
    plan: dict[str, list[Part]] = {}
    for r in goals.filter("objetivo > 0 and disponible > 0").collect():  # as many rows as the mixtures have
        c = min(r.objetivo / r.disponible, float(r.max_usos))
        times = math.floor(c)
        plan.setdefault(r.source, []).append(Part(r.mezcla_id, times, c - times))
    fields = [T.StructField("mezcla_id", T.IntegerType()), sizes.schema["source"], sizes.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("times", T.IntegerType()), T.StructField("p", T.DoubleType())]
    schema, names = T.StructType(fields), [f.name for f in fields]

    times = {(p.mezcla_id, s): p.times for s, parts in plan.items() for p in parts}

    def still_open(flights: dict) -> list[tuple]:
        """The undecided of a bucket, whose flights end with it."""
        out = [(m, s, k, n, times[m, s], p) for (m, s), f in flights.items() for k, n, p in f.open]
        flights.clear()
        return out

    def fly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flights: dict[tuple[int, str], Flight] = {}
        bucket = None
        for pdf in batches:
            out = []
            for doc, source, tokens, b in zip(pdf["doc_id"], pdf["source"], pdf["n_tokens"], pdf["__bucket"]):
                if b != bucket:
                    out += still_open(flights)
                    bucket = b
                for part in plan.get(source, ()):
                    if part.more <= EDGE:
                        if part.times:
                            out.append((part.mezcla_id, source, doc, tokens, part.times, 0.0))
                        continue
                    at = (part.mezcla_id, source)
                    if at not in flights:
                        flights[at] = Flight(f"{seed} {part.mezcla_id} {source} {doc}")
                    out += [(part.mezcla_id, source, k, n, part.times, float(x)) for k, n, x in flights[at].add(doc, tokens, part.more)]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(still_open(flights), columns=names)

    used = sizes.filter(F.col("source").isin(*plan) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("__bucket"))
    flown = used.repartition("__bucket").sortWithinPartitions("__bucket", "doc_id", "source", "n_tokens").mapInPandas(fly, schema)

    def land(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "p", "n_tokens"])
        first = pdf.iloc[0]
        flight, done = Flight(f"{seed} {first.mezcla_id} {first.source} land"), []
        for k, n, p in zip(pdf["doc_id"], pdf["n_tokens"], pdf["p"]):
            done += flight.add(k, n, p)
        done += flight.land()
        return pd.DataFrame([(first.mezcla_id, first.source, k, n, first.times, float(x)) for k, n, x in done], columns=names)

    undecided = (F.col("p") > EDGE) & (F.col("p") < 1 - EDGE)
    landed = flown.filter(undecided).groupBy("mezcla_id", "source").applyInPandas(land, schema)
    uses = (F.col("times") + F.round("p").cast("int")).alias("usos")
    return flown.filter(~undecided).unionByName(landed).select("mezcla_id", "source", "doc_id", "n_tokens", uses).filter("usos > 0")


def report(goals: DataFrame, drawn: DataFrame) -> DataFrame:
    """The goals with tokens and n_usos reached, cuota_real (share of what the mixture reached) and falta (tokens short of the target)."""
    got = drawn.groupBy("mezcla_id", "source").agg(F.sum(F.col("n_tokens") * F.col("usos")).alias("tokens"), F.sum("usos").alias("n_usos"), F.max("usos").alias("mas_usado"))
    total = got.groupBy("mezcla_id").agg(F.sum("tokens").alias("__all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = goals.join(got, ["mezcla_id", "source"], "left").join(total, "mezcla_id", "left")
    return out.select(*goals.columns, zero("tokens"), zero("n_usos"), zero("mas_usado"), F.coalesce(F.try_divide(F.col("tokens"), F.col("__all")), F.lit(0.0)).alias("cuota_real"), F.greatest(F.col("objetivo") - F.coalesce("tokens", F.lit(0)), F.lit(0.0)).alias("falta"))


def mix(sizes: DataFrame, mixtures: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). The sizes are written once to the shared folder, so that all passes read the same rows in the same order."""
    kept = cut(sizes.select("doc_id", "source", "n_tokens"))
    goals = cut(targets(kept, mixtures))
    drawn = draw(kept, goals, seed)
    return drawn, report(goals, drawn)
