"""Greedy ordered packing of turns into chunks under a budget: a left fold over each case.

A case's turns are laid out in stretches of ``FOLD_TURNS`` positions, the unit of every shuffle, so that no task ever holds a case. A
stretch is folded inside the JVM from what the stretch before left open. Only cases of several stretches need that state to be carried:
of each later stretch a small table says, for every sum it could be entered with, how it is left; one pass over these tables, a row a
stretch, gives the state at each entry. Cases of one stretch never leave the JVM.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A request may hold LIMIT characters; what exceeds it is packed into chunks of BUDGET.
LIMIT, BUDGET = 5000, 4500
#: Positions in a stretch of turns.
FOLD_TURNS = 1024
#: A budget that nothing exceeds.
NO_BUDGET = 2**62


def stretches(turns: DataFrame, *fields: str, key: str = "case_id", order: str = "seq") -> DataFrame:
    """key, __b (number of the stretch) and __t, its distinct (order, *fields) in order. Repeated rows count once; of rows with the same
    position all distinct ones stay, ordered by ``fields``. A null or negative position belongs to the first stretch."""
    b = F.coalesce(F.greatest(F.floor(F.col(order) / FOLD_TURNS), F.lit(0)), F.lit(0)).cast("long").alias("__b")
    return turns.groupBy(key, b).agg(F.sort_array(F.collect_set(F.struct(order, *fields))).alias("__t"))


def spans(turns: DataFrame, order: str = "seq") -> bool:
    """Whether any case has turns beyond its first stretch: a filter that Parquet statistics answer. Only then is state carried."""
    return not turns.filter(F.col(order) >= FOLD_TURNS).isEmpty()


def pieces(lengths: Column, budget: Column | int = BUDGET, carried: Column | None = None) -> Column:
    """[{n_turns, n_chars}] of the chunks an array of lengths falls into.

    A new chunk starts exactly when the running sum would exceed the budget and the chunk is not empty; an element above the budget is a
    chunk of its own. ``carried`` is the sum of an open chunk to begin with (null: none is open); that chunk's share here comes first and
    may be empty. A null length counts as 0 (callers fail such cases before). No element gives no chunk.
    """
    zero = F.lit(0).cast("long")
    carried = F.lit(None).cast("long") if carried is None else carried
    budget = F.lit(budget) if isinstance(budget, int) else budget
    done = F.array().cast("array<struct<n_turns:bigint,n_chars:bigint>>")
    state = F.struct(zero.alias("n"), zero.alias("own"), F.coalesce(carried, zero).alias("s"), carried.isNotNull().alias("open"), done.alias("done"))

    def step(a: Column, n: Column) -> Column:
        n = F.coalesce(n.cast("long"), zero)
        opens = a["open"] & (a["s"] + n > budget)
        return F.struct(
            F.when(opens, F.lit(1).cast("long")).otherwise(a["n"] + 1).alias("n"),
            F.when(opens, n).otherwise(a["own"] + n).alias("own"),
            F.when(opens, n).otherwise(a["s"] + n).alias("s"),
            F.lit(True).alias("open"),
            # only a chunk's end is kept, so the fold is linear in the turns
            F.when(opens, F.array_append(a["done"], F.struct(a["n"].alias("n_turns"), a["own"].alias("n_chars")))).otherwise(a["done"]).alias("done"),
        )

    end = lambda a: F.array_append(a["done"], F.struct(a["n"].alias("n_turns"), a["own"].alias("n_chars")))
    return F.when(F.size(lengths) > 0, F.aggregate(lengths, state, step, end)).otherwise(done)


def entries(lengths: list[int], budget: int) -> tuple[list[int], list[int], list[int], int]:
    """How a stretch entered with an open chunk is left: (sums, opened, left, whole). Entered with a sum c, the first turn k with
    c + sums[k] > budget opens a chunk; from there ``opened[k]`` chunks begin and the last is left with ``left[k]``. If there is no
    such k the stretch adds ``whole``. Turns after the first that must open a chunk need no entry."""
    total, sums = 0, []
    for n in lengths:
        total += n
        sums.append(total)
    opened, left = [0] * len(sums), [0] * len(sums)
    for i in range(len(sums) - 1, -1, -1):
        before = sums[i] - lengths[i]
        j = max(bisect_right(sums, before + budget, i), i + 1)
        opened[i], left[i] = (1, total - before) if j >= len(sums) else (1 + opened[j], left[j])
    n = min(bisect_right(sums, budget) + 1, len(sums))
    return sums[:n], opened[:n], left[:n], total


ENTRIES = "sums array<long>, opened array<long>, left array<long>, whole long"


def _entries(blocks: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """key, __b and ``entries`` of the stretches after a case's first."""
    own = blocks.filter("__b > 0").select(key, "__b", F.transform("__t", lambda t: F.coalesce(t[size], F.lit(0)).cast("long")).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [entries(list(n), budget) for n in pdf["n"]]
            yield pd.DataFrame({key: pdf[key], "__b": pdf["__b"], **{c: [g[i] for g in got] for i, c in enumerate(("sums", "opened", "left", "whole"))}})

    schema = T.StructType([blocks.schema[key], blocks.schema["__b"], *T._parse_datatype_string(ENTRIES).fields])
    return own.mapInPandas(run, schema)


def carry(blocks: DataFrame, cases: DataFrame, size: str, budget: int, key: str, several: bool) -> DataFrame:
    """``cases`` (key, __b, __n: stretches of the case, __over: whether to pack it, and more) with __carried and __base, the sum and number
    of the chunk that is open where the stretch begins (null and 0 at a case's beginning). ``several``: what ``spans`` says."""
    alone = cases.withColumn("__carried", F.lit(None).cast("long")).withColumn("__base", F.lit(0).cast("long"))
    if not several:
        return alone
    alone = alone.filter("__n is null or __n = 1")
    # the first stretch is entered with nothing open: its own chunks say how it is left
    begun = pieces(F.transform("__t", lambda t: t[size]), budget)
    first = blocks.filter("__b = 0").select(key, "__b", F.size(begun).cast("long").alias("__k"), F.element_at(begun, -1)["n_chars"].alias("__s"))
    many = cases.filter("__n > 1")
    many = many.join(first, [key, "__b"], "left").join(_entries(blocks, key, size, budget), [key, "__b"], "left")
    own = cases.columns
    schema = T.StructType([*cases.schema.fields, T.StructField("__carried", T.LongType()), T.StructField("__base", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, s, base = object(), None, 0
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r[key] != case:
                    case, s, base = r[key], None, 0
                out.append((s, base if r["__over"] else 0))
                if r["sums"] is None:  # the first stretch
                    s, base = int(r["__s"]), int(r["__k"]) - 1
                    continue
                sums = list(r["sums"])
                if s is None:  # a case whose first stretch is empty: its first turn opens chunk 0
                    k, base = 0, -1
                else:
                    k = bisect_right(sums, budget - s)
                if k < len(sums):
                    base, s = base + int(r["opened"][k]), int(r["left"][k])
                else:
                    s += int(r["whole"])
            got = pdf[own].copy()
            got["__carried"] = pd.array([x[0] for x in out], dtype="Int64")
            got["__base"] = [x[1] for x in out]
            yield got[schema.names]

    ordered = many.select(*own, "__k", "__s", "sums", "opened", "left", "whole").repartition(key).sortWithinPartitions(key, "__b")
    return alone.unionByName(ordered.mapInPandas(run, schema))


def pack_stretches(blocks: DataFrame, cases: DataFrame, several: bool, size: str = "n_chars", budget: int = BUDGET, key: str = "case_id", content: DataFrame | None = None) -> DataFrame:
    """The stretches of ``cases`` (as in ``carry``) with __t (of ``content``, else of ``blocks``) and __p, the pieces of its chunks; piece k
    belongs to chunk __base + k of its case. One join on (case, stretch); a hot case is spread over its stretches. A case without a
    stretch (null __b) has one piece of no turn."""
    placed = carry(blocks, cases, size, budget, key, several)
    both = placed.join(blocks if content is None else content, [key, "__b"], "left")
    most = F.when(F.col("__over"), F.lit(budget)).otherwise(F.lit(NO_BUDGET))
    zero = F.lit(0).cast("long")
    empty = F.array(F.struct(zero.alias("n_turns"), zero.alias("n_chars")))
    return both.withColumn("__p", F.when(F.col("__b").isNull(), empty).otherwise(pieces(F.transform("__t", lambda t: t[size]), most, F.col("__carried"))))


def whole_cases(blocks: DataFrame, size: str = "n_chars", key: str = "case_id", limit: int | None = None) -> DataFrame:
    """key, __b, __n, n_turns, n_chars, __over of every stretch, the figures being those of its case: what ``carry`` needs where all cases
    are packed. With ``limit`` only cases above it are."""
    case = Window.partitionBy(key)
    own = blocks.select(key, "__b", F.size("__t").cast("long").alias("n_turns"), total("__t", size).alias("n_chars"))
    own = own.select(key, "__b", F.count("*").over(case).alias("__n"), F.sum("n_turns").over(case).alias("n_turns"), F.sum("n_chars").over(case).alias("n_chars"))
    return own.withColumn("__over", F.col("n_chars") > (-1 if limit is None else limit))


def total(array: str, size: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, t: a + F.coalesce(t[size].cast("long"), F.lit(0)))


def numbered(packed: DataFrame, order: str = "seq", size: str = "n_chars", key: str = "case_id") -> DataFrame:
    """key, order, size and chunk_no of every turn of ``pack_stretches``."""
    numbers = F.flatten(F.transform("__p", lambda p, k: F.array_repeat(k.cast("long") + F.col("__base"), p["n_turns"].cast("int"))))
    each = packed.select(key, F.explode(F.arrays_zip(F.col("__t").alias("t"), numbers.alias("c"))).alias("__z"))
    return each.select(key, F.col("__z.t")[order].alias(order), F.col("__z.t")[size].cast("long").alias(size), F.col("__z.c").cast("int").alias("chunk_no"))


def packed_sizes(packed: DataFrame, key: str = "case_id") -> DataFrame:
    """key, chunk_no, n_turns, n_chars of every chunk of ``pack_stretches``; the pieces of a chunk that spans stretches are added up."""
    rows = packed.select(key, "__b", "__base", F.posexplode("__p").alias("k", "p")).filter("p.n_turns > 0 or __b is null")
    return rows.groupBy(key, (F.col("__base") + F.col("k")).cast("int").alias("chunk_no")).agg(F.sum("p.n_turns").alias("n_turns"), F.sum("p.n_chars").alias("n_chars"))


def pack(turns: DataFrame, order: str = "seq", size: str = "n_chars", budget: int = BUDGET, key: str = "case_id", limit: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """key, order, size and chunk_no for every turn (key, order, size); with ``limit``, cases whose sizes sum to no more stay one chunk.

    ``counted`` (key): cases to pack; those it lacks are left out. Turns without a key belong to no case and are left out; repeated rows count
    once, and of several turns at one position the shorter comes first.
    """
    several = spans(turns, order)
    blocks = stretches(turns.filter(F.col(key).isNotNull()), size, key=key, order=order)
    cases = whole_cases(blocks, size, key, limit)
    if counted is not None:
        cases = cases.join(counted.select(key), key, "left_semi")
    return numbered(pack_stretches(blocks, cases, several, size, budget, key), order, size, key)


def route(measures: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The branch of each case: ``chunked`` strictly above the limit, else ``single``."""
    return measures.withColumn("route", F.when(F.col("n_chars") > limit, "chunked").otherwise("single"))


def plan_chunks(turns: DataFrame, plannable: DataFrame, limit: int = LIMIT, budget: int = BUDGET) -> DataFrame:
    """case_id, seq, n_chars, chunk_no of all turns of plannable cases (case_id): one chunk up to the limit, packed beyond it."""
    own = turns.select("case_id", "seq", F.length("texto").cast("long").alias("n_chars"))
    return pack(own, budget=budget, limit=limit, counted=plannable)


def chunk_sizes(chunks: DataFrame, key: str = "case_id") -> DataFrame:
    """n_turns and n_chars of each chunk of ``plan_chunks`` or ``pack``."""
    return chunks.groupBy(key, "chunk_no").agg(F.count("*").alias("n_turns"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("n_chars"))


def pack_lines(texts: DataFrame, key: str, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """key, chunk_no, n_turns, n_chars of texts packed line by line, within the row: nothing is shuffled. A null text has no chunk."""
    lengths = F.transform(F.split(text, "\n"), lambda x: F.length(x))
    return texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(pieces(lengths, budget)).alias("chunk_no", "p")).select(key, "chunk_no", "p.n_turns", "p.n_chars")
