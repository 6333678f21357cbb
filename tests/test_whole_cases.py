import json
import os

import pytest
from pyspark.sql import functions as F

from ambarina.plans.queries import QUERIES

from folders import SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three of the given cases with turns of our own: one that can be voiced, one with a third speaker, one with a turn without text."""
    d = tmp_path_factory.mktemp("whole")
    c = spark.read.parquet(f"{SMALL}/casos.parquet")
    ok = c.filter("audio_file like '%.mp3' and diagnostico_principal.nombre is not null and voces['medico_voice_id'] is not null and voces['paciente_voice_id'] is not null")
    ids = [r.id for r in ok.select("id").distinct().orderBy("id").limit(3).collect()]
    c.filter(F.col("id").isin(ids)).write.parquet(f"{d}/casos.parquet")
    rows = []
    for n, case in enumerate(ids):
        for seq in range(6):
            rol, texto = ("Médico ", "DOCTORA", "paciente")[seq % 3], str(seq) * 900
            rol, texto = ("madre" if n == 1 and seq == 2 else rol), (None if n == 2 and seq == 2 else texto)
            rows += [(case, seq, rol, texto)] * (1 + (seq == 0))  # the first redelivered
    spark.createDataFrame(rows, "case_id string, seq int, rol string, texto string").write.parquet(f"{d}/turnos.parquet")
    return str(d), ids


def test_failed_cases_are_reported_and_not_sent(spark, folder):
    d, ids = folder
    q = lambda name: QUERIES[name](spark, d).collect()
    assert {(r.case_id, r.n_turns, r.status, r.reason) for r in q("case_status_canonical")} == {(ids[0], 6, "success", None), (ids[1], 6, "failed", "role without voice"), (ids[2], 6, "failed", "turn without texto")}
    sizes = sorted((r.case_id, r.chunk_no, r.n_turns, r.n_chars) for r in q("chunk_pack_dialogue_whole"))
    assert sizes == [(ids[0], 0, 5, 4500), (ids[0], 1, 1, 900)]
    assert [(r.case_id, r.n_chunks) for r in q("chunk_count_per_case_whole")] == [(ids[0], 2)]
    assert {(r.case_id, r.chunk_no, r.n_chunks) for r in q("chunk_paths_whole")} == {(ids[0], 0, 2), (ids[0], 1, 2)}
    assert [(r.case_id, r.n_parts) for r in q("concat_filelist_whole")] == [(ids[0], 2)]
    sent = [x for r in sorted(q("request_manifest_whole"), key=lambda r: r.chunk_no) for x in json.loads(r.payload)["inputs"]]
    assert [x["text"][0] for x in sent] == list("012345") and all("voice_id" in x for x in sent)


def test_planned_cases_have_all_their_turns(spark):
    """On the given tables: what is planned and what fails are all cases, and planned ones have the turns and characters of the case."""
    status = {r.case_id: r for r in QUERIES["case_status_canonical"](spark, SMALL).collect()}
    measures = {r.case_id: (r.n_turns, r.n_chars) for r in QUERIES["case_measures"](spark, SMALL).collect()}
    got = {}
    for r in QUERIES["chunk_pack_dialogue_whole"](spark, SMALL).collect():
        n, s = got.get(r.case_id, (0, 0))
        got[r.case_id] = (n + r.n_turns, s + r.n_chars)
    assert got == {c: m for c, m in measures.items() if status[c].status == "success"}
    assert all(status[c].reason for c in measures.keys() - got.keys()) and len(got) < len(measures)
