"""What a run would send and write: output paths, request payloads, the list of parts to join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the model a request names.
MODEL = "eleven_v3"


def output_path(root: str, audio_file: Column | str = "audio_file") -> Column:
    """Where a case's audio goes; an absolute ``audio_file`` stands for itself, a null one is null."""
    f = F.col(audio_file) if isinstance(audio_file, str) else audio_file
    return F.when(f.startswith("/"), f).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), f))


def part_path(path: Column, chunk_no: Column) -> Column:
    """Every ``.mp3`` in the path gets the part's number from 1; a path without one is the same for all parts."""
    return F.replace(path, F.lit(".mp3"), F.concat(F.lit("_part"), (chunk_no + 1).cast("string"), F.lit(".mp3")))


def list_path(path: Column) -> Column:
    return F.replace(path, F.lit(".mp3"), F.lit("_filelist.txt"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def chunk_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """case_id, chunk_no, n_chunks, path, part and list file of each chunk; a case's only chunk carries the final path.

    ``chunks``: a row a turn or a chunk; ``paths``: case_id, path.
    """
    n = chunks.groupBy("case_id").agg(F.max("chunk_no").alias("__last"))
    rows = chunks.select("case_id", "chunk_no").distinct().join(n.join(paths, "case_id"), "case_id")
    only = F.col("__last") == 0
    part = F.when(only, F.col("path")).otherwise(part_path(F.col("path"), F.col("chunk_no")))
    return rows.select("case_id", "chunk_no", (F.col("__last") + 1).cast("long").alias("n_chunks"), "path", part.alias("part"), F.when(~only, list_path(F.col("path"))).alias("list_file"))


def _payload(turns: Column, model: str) -> Column:
    return F.to_json(F.struct(turns.alias("inputs"), F.lit(model).alias("model_id")))


def requests(turns: DataFrame, chunks: DataFrame, model: str = MODEL) -> DataFrame:
    """The JSON body of each request, turns in order. ``turns``: case_id, seq, texto, voice_id; keyed by (case_id, chunk_no)."""
    rows = turns.select("case_id", "seq", "texto", "voice_id").join(chunks, ["case_id", "seq"])
    inputs = F.transform(F.sort_array(F.collect_list(F.struct("seq", "texto", "voice_id"))), lambda t: F.struct(t["texto"].alias("text"), t["voice_id"].alias("voice_id")))
    out = rows.groupBy("case_id", "chunk_no").agg(F.count("*").alias("n_turns"), inputs.alias("__i"))
    return out.select("case_id", "chunk_no", "n_turns", _payload(F.col("__i"), model).alias("payload"))


def packed_requests(packed: DataFrame, voice: Callable[[Column], Column], model: str = MODEL) -> DataFrame:
    """The same of ``packing.pack_stretches``, whose stretches hold the texts: a chunk that lies in one stretch is written where the stretch
    is, and only the pieces of chunks that span stretches meet in a shuffle. ``voice``: the voice of a turn of __t."""
    ends = F.aggregate(F.transform("__p", lambda p: p["n_turns"]), F.array(F.lit(0).cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    last = F.size("__p") - 1
    pieces = packed.withColumn("__e", ends).select("*", last.alias("__last"), F.posexplode("__p").alias("k", "p")).filter("p.n_turns > 0 or __b is null")
    turns = F.coalesce(F.col("__t"), F.array().cast(packed.schema["__t"].dataType))
    own = F.transform(F.slice(turns, F.element_at("__e", F.col("k") + 1).cast("int") + 1, F.col("p.n_turns").cast("int")), lambda t: F.struct(t["texto"].alias("text"), voice(t).alias("voice_id")))
    open_ = ((F.col("k") == 0) & F.col("__carried").isNotNull()) | ((F.col("k") == F.col("__last")) & F.coalesce(F.col("__n") > 1, F.lit(False)))
    each = pieces.select("case_id", (F.col("__base") + F.col("k")).cast("int").alias("chunk_no"), "__b", "p.n_turns", own.alias("__i"), open_.alias("__open"))
    whole = each.filter(~F.col("__open")).select("case_id", "chunk_no", "n_turns", _payload(F.col("__i"), model).alias("payload"))
    parts = each.filter("__open").groupBy("case_id", "chunk_no").agg(F.sum("n_turns").alias("n_turns"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__b", "__i"))), lambda x: x["__i"])).alias("__i"))
    return whole.unionByName(parts.select("case_id", "chunk_no", "n_turns", _payload(F.col("__i"), model).alias("payload")))


def file_lists(parts: DataFrame) -> DataFrame:
    """The text of the list a joiner reads, for cases of more than one part (case_id, chunk_no, part). Quotes are not escaped."""
    line = F.concat(F.lit("file '"), F.col("part"), F.lit("'"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", line.alias("line")))), lambda x: x["line"]), "\n")
    return parts.groupBy("case_id").agg(F.count("*").alias("n_parts"), F.concat(whole, F.lit("\n")).alias("content")).filter("n_parts > 1")


def join_lists(parts: DataFrame) -> DataFrame:
    """What joining takes, of cases of more than one part: case_id, path, list_file, content and the parts in order. ``parts``: ``chunk_paths``."""
    own = parts.filter("list_file is not null")
    lists = own.groupBy("case_id", "path", "list_file").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "part"))), lambda x: x["part"]).alias("parts"))
    return lists.join(file_lists(own), "case_id").select("case_id", "path", "list_file", "content", "parts")


def kilobytes(n_bytes: Column) -> Column:
    """Size in KB with one decimal, halves to even."""
    return F.bround(n_bytes / F.lit(1024.0), 1)
