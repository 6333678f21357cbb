"""From cases and turns as tables to the chunks and requests of those cases that can be voiced whole.

A case is planned with all its turns or not at all: any turn without role, text or voice fails its case, which ``status`` reports. What is
shuffled of a turn is its position, role and length; its text moves once, to the stretch in which its request is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import manifest as M
from . import packing as P
from . import status as S
from .dialogue import voice_map


FLAGS = ("__no_rol", "__no_texto", "__no_voice")


def turn_stretches(turns: DataFrame, rol: Column | None = None) -> DataFrame:
    """``packing.stretches`` of turns (case_id, seq, rol, texto) with role and length; ``rol``: a reading of the role."""
    own = turns.select("case_id", "seq", (F.col("rol") if rol is None else rol).alias("rol"), F.length("texto").cast("long").alias("n_chars"))
    return P.stretches(own, "rol", "n_chars")


def _figures(blocks: DataFrame) -> DataFrame:
    """case_id, __b and the sums and flags of each stretch."""

    def any_(flag: str) -> Column:
        return F.exists("__t", lambda t: S.turn_flags(t["rol"], t["n_chars"])[flag]).alias(flag)

    return blocks.select("case_id", "__b", F.size("__t").cast("long").alias("n_turns"), P.total("__t", "n_chars").alias("n_chars"), *map(any_, FLAGS))


def status(cases: DataFrame, blocks: DataFrame) -> DataFrame:
    """``status.flat_status`` of ``turn_stretches``: a row a case of either side."""
    f = _figures(blocks)
    per_case = f.groupBy("case_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("n_chars"), *(F.bool_or(c).alias(c) for c in FLAGS))
    return S.judged(cases, per_case)


def plannable(cases: DataFrame, blocks: DataFrame, limit: int = P.LIMIT) -> DataFrame:
    """The stretches of the cases that can be voiced, as ``packing.carry`` takes them, with the voices of the case. A case without turns
    has one row with a null stretch: it is one empty request."""
    f, case = _figures(blocks), Window.partitionBy("case_id")
    own = f.select("case_id", "__b", F.count("*").over(case).alias("__n"), F.sum("n_chars").over(case).alias("n_chars"), *(F.bool_or(c).over(case).alias(c) for c in FLAGS))
    v = voice_map()
    heads = S.case_head(cases.filter(F.col("id").isNotNull()), "id", *(v[r].alias(f"__{r}") for r in S.VOICE_KEYS))
    kept = heads.join(own, "case_id", "left").filter(S.flat_reason().isNull())
    return kept.select("case_id", "__b", "__n", F.coalesce(F.col("n_chars") > limit, F.lit(False)).alias("__over"), *(f"__{r}" for r in S.VOICE_KEYS))


def chunks(cases: DataFrame, turns: DataFrame, rol: Column | None = None) -> DataFrame:
    """case_id, chunk_no, n_turns, n_chars of every request."""
    blocks = turn_stretches(turns.filter(F.col("case_id").isNotNull()), rol)
    return P.packed_sizes(P.pack_stretches(blocks, plannable(cases, blocks), P.spans(turns)))


def requests(cases: DataFrame, turns: DataFrame, rol: Column | None = None) -> DataFrame:
    """case_id, chunk_no, n_turns, payload of every request. The texts are shuffled once."""
    turns = turns.filter(F.col("case_id").isNotNull())
    blocks = turn_stretches(turns, rol)
    texts = turns.select("case_id", "seq", (F.col("rol") if rol is None else rol).alias("rol"), F.length("texto").cast("long").alias("n_chars"), "texto")
    packed = P.pack_stretches(blocks, plannable(cases, blocks), P.spans(turns), content=P.stretches(texts, "rol", "n_chars", "texto"))

    def voice(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for r in S.VOICE_KEYS:
            out = F.when(t["rol"] == r, F.col(f"__{r}")).otherwise(out)
        return out

    return M.packed_requests(packed, voice)
