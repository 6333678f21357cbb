"""Dialogues: nested phases to ordered turns and back, speakers to voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VOICE_KEYS


def turns_of(cases: DataFrame, key: str = "id") -> DataFrame:
    """One row a turn: case_id, phase_idx, fase, turn_idx, seq (from 0 through all phases), rol, texto, audio_tag.

    Empty or missing lists give no rows (``status`` is where a missing list counts against its case). seq comes from the array
    positions alone, so no shuffle and no window is needed.
    """
    phases = F.posexplode("transcripcion").alias("phase_idx", "__p")
    # where each phase starts: the turns of all phases before it
    starts = F.transform("transcripcion", lambda p: F.coalesce(F.size(p["dialogos"]), F.lit(0)))
    with_start = cases.select(F.col(key).alias("case_id"), starts.alias("__sizes"), phases)
    before = F.aggregate(F.slice("__sizes", F.lit(1), F.col("phase_idx")), F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0)))
    one = with_start.select("case_id", "phase_idx", F.col("__p.fase").alias("fase"), before.alias("__start"), F.posexplode("__p.dialogos").alias("turn_idx", "__t"))
    return one.select("case_id", "phase_idx", "fase", "turn_idx", (F.col("__start") + F.col("turn_idx")).alias("seq"), "__t.rol", "__t.texto", "__t.audio_tag")


def nest_turns(turns: DataFrame, *fields: str, key: str = "case_id", order: tuple[str, ...] = ("seq",), name: str = "inputs") -> DataFrame:
    """The ordered list of a case's turns as an array of structs of ``fields``. A case's turns must fit a task, as in a request."""
    whole = F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    return turns.groupBy(key).agg(F.transform(whole, lambda t: F.struct(*(t[f].alias(f) for f in fields))).alias(name))


def voice_map(voces: Column | str = "voces") -> Column:
    """{rol: voice} of a case. Both keys are read whether or not the role speaks, so a missing one is a null value, never an absent key."""
    v = F.col(voces) if isinstance(voces, str) else voces
    pairs = [x for rol, key in VOICE_KEYS.items() for x in (F.lit(rol), v[key])]
    return F.create_map(*pairs)


def voice_dimension(cases: DataFrame, key: str = "id") -> DataFrame:
    """The lookup as a relation: a row for each case and role."""
    return cases.select(F.col(key).alias("case_id"), F.explode(voice_map()).alias("rol", "voice_id"))


def with_voice(turns: DataFrame, cases: DataFrame, key: str = "id") -> DataFrame:
    """Turns with the voice of their speaker; a miss is null, not a lost row. Roles match exactly as written.

    The case side is one row a case; its two voices travel as columns, so a hot case does not multiply and the join key is the case.
    """
    voices = cases.select(F.col(key).alias("case_id"), voice_map().alias("__voices"), F.lit(True).alias("__case"))
    joined = turns.join(voices, "case_id", "left")
    return joined.withColumn("voice_id", F.try_element_at("__voices", F.col("rol"))).drop("__voices", "__case")


def request_turns(turns: DataFrame) -> DataFrame:
    """Projection to what a request holds; the text passes verbatim, stage directions included."""
    return turns.select("case_id", "seq", F.col("texto").alias("text"), "voice_id")


def canonical_rol(rol: Column | str) -> Column:
    """A reading of the role however it is spelled; opt-in, as lookups match exactly. Null, blank and unknown stay null."""
    r = F.lower(F.translate(F.trim(F.col(rol) if isinstance(rol, str) else rol), "áéíóúÁÉÍÓÚ", "aeiouAEIOU"))
    return F.when(r.isin("medico", "doctor", "doctora", "medica"), "medico").when(r == "paciente", "paciente").when(r.isin("padre", "madre", "tutor"), "padre")
