import random

from ambarina.llm import mix as M

SIZES = "doc_id long, source string, n_tokens long, usos string"
MIXES = "mezcla_id int, source string, cuota double, max_usos int, presupuesto_tokens long"


def test_flight_keeps_both_totals():
    rng = random.Random(5)
    f = M.Flight("x")
    docs = [(i, rng.randint(1, 900), 0.37) for i in range(4000)]
    done = [r for d in docs for r in f.add(*d)]
    assert len(f.open) <= 2
    n = sum(x for _, _, x in done) + sum(p for _, _, p in f.open)
    t = sum(x * k for _, k, x in done) + sum(p * k for _, k, p in f.open)
    assert abs(n - 0.37 * 4000) < 1e-4 and abs(t - 0.37 * sum(k for _, k, _ in docs)) < 1e-2
    done += f.land()
    assert not f.open and sorted(k for k, _, _ in done) == list(range(4000)) and {x for _, _, x in done} == {0, 1}


def test_inclusion_is_as_wanted():
    hits = [0] * 12
    for s in range(3000):
        f = M.Flight(str(s))
        for k, _, x in [r for i in range(12) for r in f.add(i, 10 + i * i, 0.3)] + f.land():
            hits[k] += x
    assert all(abs(h / 3000 - 0.3) < 0.05 for h in hits)


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 else "small", rng.randint(20, 400), "x") for i in range(3000)]
    docs += [(9000, None, 50, "x"), (9001, "big", 0, "x"), (9002, "big", None, "x"), (None, "small", 40, "x")]
    sizes = spark.createDataFrame(docs, SIZES)
    big, small = (sum(n or 0 for _, s, n, _ in docs if s == x) for x in ("big", "small"))
    rows = [(1, "big", 0.4, 3, 2 * big), (1, "small", 0.6, 2, 2 * big), (2, "small", 1.0, 5, round(2.5 * small)), (2, "none", 0.1, 5, 1000), (2, None, 0.5, 1, 1000), (2, "big", None, 1, 1000), (3, "big", 0.5, None, big)]
    drawn, report = M.mix(sizes, spark.createDataFrame(rows + rows[:2], MIXES), seed=7)
    got = {(r.mezcla_id, r.source): r for r in report.collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r.corto} == {(1, "small") if 1.2 * big > 2 * small else (2, "none"), (2, "none")}
    assert abs(got[1, "big"].tokens - 0.8 * big) <= 800 and got[1, "big"].mas_usado <= 1
    assert got[1, "small"].tokens == 2 * small if got[1, "small"].corto else True
    assert abs(got[2, "small"].tokens - round(2.5 * small)) <= 800 and got[2, "small"].mas_usado == 3
    assert got[2, "none"].tokens == got[2, None].tokens == got[2, "big"].tokens == 0
    uses = drawn.collect()
    assert max(r.usos for r in uses) <= 3 and len({(r.mezcla_id, r.doc_id) for r in uses}) == len(uses)
    assert not {9000, 9001, 9002} & {r.doc_id for r in uses}
    assert sorted(map(tuple, uses), key=str) == sorted(map(tuple, M.mix(sizes, spark.createDataFrame(rows, MIXES), seed=7)[0].collect()), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], SIZES)
    one = spark.createDataFrame([(1, "a", 1.0, 1, 10)], MIXES)
    drawn, report = M.mix(none, one)
    assert drawn.count() == 0 and report.first().corto
    assert M.mix(spark.createDataFrame([(1, "a", 5, "")], SIZES), one.limit(0))[1].count() == 0


def test_same_mixture_whatever_the_splits(spark):
    rng = random.Random(4)
    sizes = spark.createDataFrame([(i, rng.choice("abc"), rng.randint(1, 3000), "x") for i in range(6000)], SIZES)
    mixes = spark.createDataFrame([(1, "a", 0.5, 2, 2_000_000), (1, "b", 0.3, 2, 2_000_000), (1, "c", 0.2, 1, 2_000_000)], MIXES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for parts in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        drawn, report = M.mix(sizes.repartition(parts, "n_tokens"), mixes, seed=3)
        got.append(sorted(map(tuple, drawn.collect())))
        assert all(abs(r.tokens - r.objetivo) <= 3000 for r in report.collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]
