import json
import random

from ambarina.operators import packing as P
from ambarina.operators import planning as L
from ambarina.schema import CASE

TURN = "case_id string, seq int, rol string, texto string, case string"


def plain_fold(lengths, budget, limit):
    out, c, s, filled = [], 0, 0, False
    for n in lengths:
        if sum(lengths) > limit and filled and s + n > budget:
            c, s = c + 1, 0
        s, filled = s + n, True
        out.append(c)
    return out


def cases(spark, ids):
    docs = [{"id": i, "audio_file": f"{i}.mp3", "diagnostico_principal": {"nombre": "d"}, "voces": {"medico_voice_id": f"m{i}", "paciente_voice_id": f"p{i}"}} for i in ids]
    return spark.read.schema(CASE).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))


def test_cases_of_many_stretches(spark, monkeypatch):
    """Requests of cases cut into stretches of 7 turns are those of one fold over the whole case, texts, voices and order included."""
    monkeypatch.setattr(P, "FOLD_TURNS", 7)
    rng = random.Random(3)
    text, rows = {}, []
    for c in "abcdef":
        first = 0 if c != "f" else 20  # no turn in the first stretches
        for i in range(rng.randint(1, 6) if c == "a" else rng.randint(30, 90)):
            n = rng.choice([0, 1, 40, 90, 300, 4600]) if c != "e" else 0
            text.setdefault(c, {})[first + i * (1 if c != "d" else 3)] = (rng.choice(["medico", "paciente"]), "x" * n)
    for c, t in text.items():
        rows += [(c, i, r, x, "z") for i, (r, x) in t.items()]
    rows += rows[:40] + [("bad", 0, "medico", "a", "z"), ("bad", 30, "nadie", "b", "z"), (None, 3, "medico", "x", "z"), ("no case", 0, "medico", "x", "z")]
    c, t = cases(spark, [*text, "bad", "silent"]), spark.createDataFrame(rows, TURN)
    want = {("silent", 0): []}
    for k, ts in text.items():
        order = sorted(ts)
        for i, no in zip(order, plain_fold([len(ts[i][1]) for i in order], P.BUDGET, P.LIMIT)):
            want.setdefault((k, no), []).append((ts[i][1], ts[i][0][0] + k))
    got = {(r.case_id, r.chunk_no): (r.n_turns, json.loads(r.payload)) for r in L.requests(c, t).collect()}
    assert {k: [(x["text"], x["voice_id"]) for x in p["inputs"]] for k, (_, p) in got.items()} == want
    assert all(n == len(want[k]) and p["model_id"] == "eleven_v3" for k, (n, p) in got.items())
    sizes = {(r.case_id, r.chunk_no): (r.n_turns, r.n_chars) for r in L.chunks(c, t).collect()}
    assert sizes == {k: (len(v), sum(len(x) for x, _ in v)) for k, v in want.items()}


def test_null_positions_and_empty_tables(spark):
    c = cases(spark, ["a"])
    t = spark.createDataFrame([("a", None, "medico", "x", ""), ("a", 1, "paciente", "y", ""), ("a", 1, "paciente", "y", "")], TURN)
    body = json.loads(L.requests(c, t).first().payload)
    assert [x["text"] for x in body["inputs"]] == ["x", "y"]  # a turn without position comes first
    assert [(r.n_turns, r.n_chars) for r in L.chunks(c, t.limit(0)).collect()] == [(0, 0)] and L.requests(c.limit(0), t).count() == 0


def test_hot_case_is_exact(spark):
    """One case with most of all turns: sizes as by one fold."""
    n = 40_000
    df = spark.range(n).selectExpr("'hot' as case_id", "cast(id as int) as seq", "id * 7919 % 613 as n_chars")
    want = plain_fold([i * 7919 % 613 for i in range(n)], 4500, -1)
    got = {r.seq: r.chunk_no for r in P.pack(df).collect()}
    assert [got[i] for i in range(n)] == want
    assert P.pack_lines(spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a\n\n" + "b" * 5000 + "\nc", "x")], "k long, text string, chunk_no string"), "k").orderBy("k", "chunk_no").collect() == [
        (2, 0, 1, 0), (3, 0, 2, 1), (3, 1, 1, 5000), (3, 2, 1, 1)]
