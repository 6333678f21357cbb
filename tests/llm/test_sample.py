from ambarina.llm import sample as S
from pyspark.sql import functions as F

CASES = "id string, especialidad string, raro struct<es_rara:boolean>, plan_id string"
QUOTAS = "plan_id int, campo string, categoria string, cuota double, minimo int, tamano int"


def test_repair_reaches_targets():
    plan = S.Plan(1, 100, {"a": {"x": (0.5, 0), "y": (0.3, 0), "z": (0.2, 0)}})
    assert S.repair(plan, {("x",): 900, ("y",): 80, ("z",): 20, (None,): 500}) == {("x",): 50, ("y",): 30, ("z",): 20}
    two = S.Plan(2, 40, {"a": {"x": (0.5, 0), "y": (0.5, 0)}, "b": {"p": (0.25, 0), "q": (0.75, 0)}})
    got = S.repair(two, {(a, b): 30 for a in "xy" for b in "pq"})
    assert sum(got.values()) == 40 and sum(n for (a, _), n in got.items() if a == "x") == 20 and sum(n for (_, b), n in got.items() if b == "p") == 10


def test_floors_and_shortage():
    plan = S.Plan(1, 50, {"a": {"x": (0.9, 1), "y": (0.1, 20), "w": (0.0, 3)}})
    got = S.repair(plan, {("x",): 100, ("y",): 100, ("w",): 2})
    assert got[("y",)] == 20 and got[("w",)] == 2 and sum(got.values()) == 50
    assert sum(S.repair(plan, {("x",): 3, ("y",): 4}).values()) == 7 and S.repair(plan, {}) == {}


def cases(spark):
    rows = [(f"c{i}", ["Cardiología", " CARDIOLOGIA", "Serv. Cardiología"][i % 3], (i % 10 == 0,), "x") for i in range(300)]
    rows += [(f"d{i}", ["Urología", "Consulta de  urologia"][i % 2], (None,), "x") for i in range(40)]
    rows += [("c0", "cardiología", (True,), "x"), ("c0", None, (True,), "x"), (None, "Urología", (True,), "x"), ("n", None, None, None), ("o", "Otra", (False,), "x")]
    return spark.createDataFrame(rows, CASES)


def quotas(spark):
    rows = [(1, "especialidad", "Cardiología", 0.6, 2, 100), (1, "especialidad", "Urología", 0.3, 2, 100), (1, "especialidad", "Pediatría", 0.1, 0, 100)]
    rows += [(2, "especialidad", "Urología", 0.5, 2, 100), (2, "especialidad", "Cardiología", 0.5, 2, 100), (2, "raro.es_rara", "true", 0.2, 31, 100), (2, "raro.es_rara", "false", 0.8, 0, 100), (3, None, "x", 0.1, 0, 5)]
    return spark.createDataFrame(rows + rows[:2], QUOTAS)


def test_sample(spark):
    signed, wanted, report = S.solve(cases(spark), quotas(spark))
    got = {(r.plan_id, r.categoria): r for r in report.collect()}
    assert {k: (r.necesarios, r.disponibles, r.corto) for k, r in got.items()} == {
        (1, "Cardiología"): (60, 300, False), (1, "Urología"): (30, 40, False), (1, "Pediatría"): (10, 0, True),
        (2, "Urología"): (50, 40, True), (2, "Cardiología"): (50, 300, False), (2, "true"): (31, 30, True), (2, "false"): (80, 271, False)}
    drawn = S.draw(signed, wanted)
    assert {r.plan_id: (r.n, r.d) for r in drawn.groupBy("plan_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()} == {1: (100, 100), 2: (100, 100)}
    assert {tuple(r.firma): r.n for r in drawn.filter("plan_id = 1").groupBy("firma").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in wanted[1].items()}
    assert sorted(map(tuple, drawn.select("id", "plan_id").collect())) == sorted(map(tuple, S.draw(signed, wanted).select("id", "plan_id").collect()))
    assert got[2, "true"].tomados == 30


def test_one_hot_signature_is_drawn_exactly(spark):
    df = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("Urología").alias("especialidad"), F.struct(F.lit(True).alias("es_rara")).alias("raro"))
    signed, wanted, _ = S.solve(df, spark.createDataFrame([(1, "especialidad", "Urología", 1.0, 0, 7777)], QUOTAS))
    assert S.draw(signed, wanted).distinct().count() == 7777


def test_empty(spark):
    _, wanted, report = S.solve(cases(spark).limit(0), quotas(spark))
    assert wanted == {1: {}, 2: {}} and report.filter("corto").count() == 7
    signed, wanted, report = S.solve(cases(spark), quotas(spark).limit(0))
    assert wanted == {} and report.count() == 0


def dense(plan, sizes, x):
    """(what the floors lack, weighted deviation) of a sample, by definition."""
    lack = off = 0.0
    for i, f in enumerate(sorted(plan.fields)):
        of = plan.fields[f]
        for c in {s[i] for s in sizes}:
            have, n = (sum(v for s, v in d.items() if s[i] == c) for d in (sizes, x))
            share, least = of.get(c, (max(0.0, 1 - sum(q for q, _ in of.values())), 0))
            lo = (have if have < S.needed(plan, share, least) else least) if c is not None else 0
            lack += max(0, lo - n) ** 2
            off += (n - share * plan.size) ** 2 / max(share * plan.size, 1.0)
    return lack, off


def test_no_exchange_improves():
    """Brute force over all pairs: none lowers the deviation without falling below a floor."""
    import random

    rng = random.Random(6)
    for trial in range(12):
        fields = {f: {c: (rng.random() / 4, rng.choice([0, 0, 2, 9])) for c in "pqrs"[: rng.randint(2, 4)]} for f in "ab"[: rng.randint(1, 2)]}
        plan = S.Plan(trial, rng.randint(10, 60), fields)
        sizes = {}
        for _ in range(30):
            sizes[tuple(rng.choice([*fields[f], None]) for f in sorted(fields))] = rng.randint(0, 25)
        x = S.repair(plan, sizes)
        assert sum(x.values()) == min(plan.size, sum(sizes.values())) and all(n <= sizes[s] for s, n in x.items())
        lack, off = dense(plan, sizes, x)
        for a in [s for s in x if x[s]]:
            for b in [s for s in sizes if x.get(s, 0) < sizes[s] and s != a]:
                lack2, off2 = dense(plan, sizes, x | {a: x[a] - 1, b: x.get(b, 0) + 1})
                assert lack2 >= lack and (lack2 > lack or off2 >= off - 1e-9 or lack > 0)


def test_floors_beyond_the_size_are_reported(spark):
    plan = S.Plan(1, 10, {"a": {"x": (0.5, 8), "y": (0.5, 8)}})
    sizes = {("x",): 50, ("y",): 50}
    got = S.repair(plan, sizes)
    assert got == {("x",): 5, ("y",): 5}
    assert {(r.categoria, r.motivo, r.corto) for r in S.report([plan], {1: sizes}, {1: got}, spark).collect()} == {("x", S.FLOORS, False), ("y", S.FLOORS, False)}
    plan = S.Plan(2, 10, {"a": {"x": (0.6, 0), "y": (0.4, 8)}})
    assert {(r.categoria, r.tomados, r.motivo) for r in S.report([plan], {2: sizes}, {2: S.repair(plan, sizes)}, spark).collect()} == {("x", 2, S.OTHERS), ("y", 8, None)}


def test_many_signatures():
    import random
    import time

    rng = random.Random(1)
    fields = {f: {str(c): (1 / 110, 3) for c in range(100)} for f in "ab"}
    sizes = {(str(a), str(b)): rng.randint(1, 9) for a in range(100) for b in range(100)}
    plan, began = S.Plan(1, 5000, fields), time.time()
    x = S.repair(plan, sizes)
    assert time.time() - began < 10 and sum(x.values()) == 5000
    assert all(abs(sum(n for s, n in x.items() if s[i] == str(c)) - 5000 / 110) <= 5 for i in (0, 1) for c in range(100))
