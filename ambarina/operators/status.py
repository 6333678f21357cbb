"""Which cases can be voiced, and why the others cannot. No case is ever lost: every input case gets exactly one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VOICE_KEYS
from ..sources.cases import CORRUPT

OK, FAILED = "success", "failed"


def nested_reason(has_corrupt: bool = True) -> Column:
    """The first thing that stops a nested case, in the order in which a reader of the document meets it; null if nothing does."""
    turns = F.flatten(F.transform("transcripcion", lambda p: p["dialogos"]))
    checks = [
        (F.col(CORRUPT).isNotNull(), "unreadable document") if has_corrupt else None,
        (F.col("id").isNull(), "no id"),
        (F.col("audio_file").isNull(), "no audio_file"),
        (F.col("diagnostico_principal.nombre").isNull(), "no diagnostico_principal.nombre"),
        *((F.col("voces")[k].isNull(), f"no voces.{k}") for k in VOICE_KEYS.values()),
        (F.col("transcripcion").isNull(), "no transcripcion"),
        (F.exists("transcripcion", lambda p: p.isNull() | p["dialogos"].isNull()), "phase without dialogos"),
        (F.exists(turns, lambda t: t.isNull() | t["rol"].isNull()), "turn without rol"),
        (F.exists(turns, lambda t: t["texto"].isNull()), "turn without texto"),
        (F.exists(turns, lambda t: ~t["rol"].isin(*VOICE_KEYS)), "role without voice"),
    ]
    reason = F.lit(None).cast("string")
    for cond, why in reversed([c for c in checks if c]):
        reason = F.when(cond, why).otherwise(reason)
    return reason


def nested_status(cases: DataFrame) -> DataFrame:
    """case_id, path if there, status, reason of nested cases; judged within the row, without a shuffle."""
    keep = [F.col("id").alias("case_id")] + [F.col(c) for c in ("path",) if c in cases.columns]
    reason = nested_reason(CORRUPT in cases.columns)
    return cases.select(*keep, reason.alias("reason")).withColumn("status", F.when(F.col("reason").isNull(), OK).otherwise(FAILED))


def turn_flags(rol: Column, size: Column) -> dict[str, Column]:
    """What may be wrong with a turn: each true, false or null (unknown, which is not wrong)."""
    return {"__no_rol": rol.isNull(), "__no_texto": size.isNull(), "__no_voice": ~rol.isin(*VOICE_KEYS)}


def case_head(cases: DataFrame, key: str = "id", *keep: Column) -> DataFrame:
    """case_id and what may be wrong with a case apart from its turns, with the columns of ``keep``."""
    return cases.select(
        F.col(key).alias("case_id"),
        F.lit(True).alias("__case"),
        F.col("audio_file").isNull().alias("__no_audio"),
        F.col("diagnostico_principal.nombre").isNull().alias("__no_dx"),
        *(F.col("voces")[k].isNull().alias(f"__no_{k}") for k in VOICE_KEYS.values()),
        *keep,
    )


def flat_reason() -> Column:
    """The first thing that stops a case, of the columns of ``case_head`` and the flags of its turns; null if nothing does."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    steps = [
        (F.col("__case").isNull(), "no case"),
        (yes("__no_audio"), "no audio_file"),
        (yes("__no_dx"), "no diagnostico_principal.nombre"),
        *((yes(f"__no_{k}"), f"no voces.{k}") for k in VOICE_KEYS.values()),
        (yes("__no_rol"), "turn without rol"),
        (yes("__no_texto"), "turn without texto"),
        (yes("__no_voice"), "role without voice"),
    ]
    reason = F.lit(None).cast("string")
    for cond, why in reversed(steps):
        reason = F.when(cond, why).otherwise(reason)
    return reason


def flat_status(cases: DataFrame, turns: DataFrame, key: str = "id", size: Column | None = None) -> DataFrame:
    """case_id, n_turns, n_chars, status, reason where cases and turns are tables.

    A case without turns is plannable with 0 turns; a turn whose case is not in ``cases`` fails as "no case". One shuffle on the case.
    ``size`` is the length of the text (null where there is none) of turns that come without it.
    """
    size = F.length("texto").cast("long") if size is None else size
    flags = turn_flags(F.col("rol"), size)
    per_case = turns.groupBy("case_id").agg(F.count("*").alias("n_turns"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("n_chars"), *(F.bool_or(c).alias(n) for n, c in flags.items()))
    return judged(cases, per_case, key)


def judged(cases: DataFrame, per_case: DataFrame, key: str = "id") -> DataFrame:
    """``flat_status`` of turns that are already summed by case: case_id, n_turns, n_chars and the flags."""
    both = case_head(cases, key).join(per_case, "case_id", "full_outer")
    reason = flat_reason()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select("case_id", zero("n_turns"), zero("n_chars"), F.when(reason.isNull(), OK).otherwise(FAILED).alias("status"), reason.alias("reason"))


def rollup(status: DataFrame) -> DataFrame:
    """Cases by status; both statuses are always there."""
    both = status.sparkSession.createDataFrame([(OK,), (FAILED,)], "status string")
    n = status.groupBy("status").agg(F.count("*").alias("__n"))
    return both.join(n, "status", "left").select("status", F.coalesce("__n", F.lit(0)).cast("long").alias("n_cases"))


def succeeded(http_status: Column | str) -> Column:
    """Exactly 200; no answer is no success."""
    return F.coalesce((F.col(http_status) if isinstance(http_status, str) else http_status) == 200, F.lit(False))


def chunk_outcome(requests: DataFrame) -> DataFrame:
    """case_id, status and attempted per chunk from the responses of a run (case_id, chunk_no, http_status).

    Chunks run in order and the first that is not exactly 200 ends its case: later ones count as not attempted, earlier parts stay.
    A null http_status is a failed call (no answer).
    """
    ok = succeeded("http_status")
    first_bad = requests.groupBy("case_id").agg(F.min(F.when(~ok, F.col("chunk_no"))).alias("first_failed"))
    with_bad = requests.join(first_bad, "case_id")
    attempted = F.col("first_failed").isNull() | (F.col("chunk_no") <= F.col("first_failed"))
    return with_bad.select("case_id", "chunk_no", F.when(~attempted, "not attempted").when(ok, "ok").otherwise("failed").alias("outcome"), F.when(F.col("first_failed").isNull(), OK).otherwise(FAILED).alias("status"))


def concat_outcome(runs: DataFrame) -> DataFrame:
    """status and detail of cases whose parts were joined (case_id, n_chunks, tool: ok, error, absent or timeout).

    A failing or absent tool still is a success, with the parts kept; only its timeout fails the case. One chunk is renamed, not joined.
    """
    t = F.col("tool")
    detail = F.when(F.col("n_chunks") <= 1, "renamed").when(t == "ok", "joined, parts removed").when(t == "timeout", "timeout").otherwise("parts kept")
    return runs.select("case_id", F.when((F.col("n_chunks") > 1) & (t == "timeout"), FAILED).otherwise(OK).alias("status"), detail.alias("detail"))
