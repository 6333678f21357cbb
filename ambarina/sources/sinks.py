"""Sinks. The default output of a run is its manifest; calling a service is an explicit, separate step.

Everything here runs on executors: a case's chunks are sent in order by one task, bodies are written where the call is made, parts are
joined by a tool that the caller names. A lost task does its cases again and overwrites what it wrote, as a second run would.
"""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .cases import required_setting

#: Seconds a call may take, and characters kept of an error.
TIMEOUT, ERROR = 300.0, 500


def write_manifest(requests: DataFrame, path: str) -> None:
    """Requests as Parquet, overwriting: the state from which a sender works, keyed by (case_id, chunk_no)."""
    requests.write.mode("overwrite").parquet(path)


class MissingKey(SystemExit):
    """No key: the run ends with code 1 before any work."""


def guard(spark: SparkSession, setting: str) -> str:
    """The key a service wants, from a session setting. Unset and empty are the same: ``MissingKey``."""
    key = required_setting(spark, setting)
    if not key:
        raise MissingKey(1)
    return key


def http_call(url: str, header: str, key: str, timeout: float = TIMEOUT) -> Callable[[str], tuple[int, bytes]]:
    """A call for ``send``: POSTs a payload as JSON with the key in ``header``, once. Any status is an answer; no answer within ``timeout``
    or no connection raises."""
    if not key:
        raise MissingKey(1)

    def call(payload: str) -> tuple[int, bytes]:
        request = urllib.request.Request(url, payload.encode(), {header: key, "Content-Type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    return call


def put(path: str, body: bytes) -> None:
    """Writes a file where ``path`` says (a local or mounted path, or a URI that Arrow knows), folders made, an old file overwritten."""
    fs, at = _filesystem(path)
    if folder := os.path.dirname(at):
        fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(at + ".writing") as f:
        f.write(body)
    fs.move(at + ".writing", at)  # a reader sees the whole file or none


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


RESPONSE = "case_id string, chunk_no int, http_status int, n_bytes long, error string"


def send(requests: DataFrame, call: Callable[[str], tuple[int, bytes]], limit: int = ERROR) -> DataFrame:
    """Responses (case_id, chunk_no, http_status, n_bytes, error) of calling ``call(payload)`` for each request, once, without retry.

    ``call`` gives status and body, or raises; a raised error is a null status. The chunks of a case are sent in order and the first that is
    not exactly 200 ends the case: later ones are not called (null status, error ``not attempted``). Where ``requests`` has ``part``, the
    body of a 200 is written there, overwriting; a failing write is a failing call. A lost task calls again: cut the result with
    ``session.cut`` and let ``call`` be idempotent by key where calls cost money. ``error`` is cut at ``limit`` characters.
    """
    to = "part" in requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, ended = object(), False
        for pdf in batches:
            out = []
            for case_id, no, payload, part in zip(pdf.case_id, pdf.chunk_no, pdf.payload, pdf.part if to else [None] * len(pdf)):
                if case_id != case:
                    case, ended = case_id, False
                if ended:
                    out.append((case_id, no, None, None, "not attempted"))
                    continue
                try:
                    status, body = call(payload)
                    if status == 200 and part is not None:
                        put(part, body)
                    out.append((case_id, no, status, len(body), None if status == 200 else body.decode("utf-8", "replace")[:limit]))
                    ended = status != 200
                except Exception as e:  # a failing call fails its case, never the run
                    out.append((case_id, no, None, None, str(e)[:limit]))
                    ended = True
            yield pd.DataFrame(out, columns=["case_id", "chunk_no", "http_status", "n_bytes", "error"]).astype({"http_status": "Int32", "n_bytes": "Int64"})

    own = requests.select("case_id", "chunk_no", "payload", *(["part"] if to else []))
    return own.repartition("case_id").sortWithinPartitions("case_id", "chunk_no").mapInPandas(run, RESPONSE)


def join_parts(lists: DataFrame, tool: Callable[[str, str], str]) -> DataFrame:
    """case_id, n_chunks, tool of joining the parts of cases (case_id, path, list_file, content, parts: in order).

    The list is written to list_file and ``tool(list_file, path)`` called; it gives ``ok`` or ``error``, raises FileNotFoundError where there is
    no tool (``absent``) and TimeoutError where it takes too long (``timeout``). Only after ``ok`` the parts and the list are removed.
    ``status.concat_outcome`` says what each means for the case.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    put(r.list_file, r.content.encode())
                    said = tool(r.list_file, r.path)
                except FileNotFoundError:
                    said = "absent"
                except TimeoutError:
                    said = "timeout"
                if said == "ok":
                    for p in [*r.parts, r.list_file]:
                        fs, at = _filesystem(p)
                        fs.delete_file(at)
                out.append((r.case_id, len(r.parts), said))
            yield pd.DataFrame(out, columns=["case_id", "n_chunks", "tool"])

    return lists.select("case_id", "path", "list_file", "content", "parts").mapInPandas(run, "case_id string, n_chunks int, tool string")


def progress(requests: DataFrame, name: str = "requests") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of what has passed once a job over them ends: requests, cases (about), turns and payload characters."""
    seen = Observation(name)
    out = requests.observe(
        seen, F.count(F.lit(1)).alias("requests"), F.approx_count_distinct("case_id").alias("cases"), F.coalesce(F.sum("n_turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum(F.length("payload").cast("long")), F.lit(0)).alias("chars")
    )
    return out, seen

