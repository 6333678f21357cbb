import random

import pytest
from pyspark.sql import functions as F

from ambarina.llm import split as S


def whole(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert c == b - overlap and d > b
    assert all(e - s <= limit for s, e, _ in pieces)
    joined = text[: pieces[0][1]] + "".join(text[e0:e] for (_, e0, _), (_, e, _) in zip(pieces, pieces[1:]))
    assert joined == text


@pytest.mark.parametrize("seed", range(8))
def test_texts_keep_everything(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choice(["palabra ", "Fin. ", "línea\n", "x" * rng.randint(1, 90), "é", "👩🏽‍⚕️", "\r\n", "  "]) for _ in range(rng.randint(1, 400)))
        limit = rng.randint(40, 300)
        overlap = rng.randint(0, limit - S.LEAST_ROOM)
        pieces = S.split_text(text, limit, overlap)
        whole(text, pieces, limit, overlap)
        if len(text) > limit:
            assert len(pieces) >= -(-(len(text) - overlap) // (limit - overlap))


def test_limits_and_boundaries():
    assert S.split_text("a" * 100, 100, 10) == [(0, 100, S.TURN)]
    assert len(S.split_text("a" * 101, 100, 10)) == 2
    text = "Uno dos tres. " * 10 + "\n" + "cuatro cinco seis " * 8
    pieces = S.split_text(text, 200, 20)
    assert pieces[0][2] == S.LINE and text[: pieces[0][1]].endswith("\n")
    assert S.split_text("una frase. " * 30, 200, 20)[0][2] == S.SENTENCE
    assert S.split_text("palabra " * 40, 200, 20)[0][2] == S.WORD
    assert S.split_text("á" * 300, 200, 20)[0][2] == S.CHAR  # marks stay with their letter
    assert all(s % 2 == 0 for s, _, _ in S.split_text("á" * 300, 200, 20))
    with pytest.raises(ValueError):
        S.split_text("x" * 50, 20, 19)


def test_dialogues_match_one_text(spark):
    rng = random.Random(3)
    rows, whole_text = [], {}
    for c in range(12):
        seq = 0
        for _ in range(rng.randint(1, 60)):
            t = rng.choice([None, "", "Sí.", "palabra " * rng.randint(1, 20), "Frase una. Otra frase.\n" * rng.randint(1, 4), "y" * rng.randint(1, 500)])
            rows.append((f"c{c}", seq, t, "x"))
            whole_text[f"c{c}"] = whole_text.get(f"c{c}", "") + (t or "")
            seq += 1
    rows += rows[:30] + [(None, 0, "z" * 900, "x"), ("c0", None, "z" * 900, "x")]
    df = spark.createDataFrame(rows, "case_id string, seq int, texto string, inicio string")
    limit, overlap = 400, 40
    pieces = S.split_dialogues(df, limit, overlap)
    got = {}
    for r in S.piece_texts(df, pieces).collect():
        assert r.texto == whole_text[r.case_id][r.inicio : r.fin]
        got.setdefault(r.case_id, []).append((r.pieza, r.inicio, r.fin, r.corte))
    assert set(got) == {c for c, t in whole_text.items() if len(t) > limit}
    for c, ps in got.items():
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps)))
        whole(whole_text[c], [p[1:] for p in ps], limit, overlap)
    assert S.split_dialogues(df.limit(0), limit, overlap).count() == 0


def test_one_hot_case_and_long_turn(spark):
    df = spark.range(20000).select(F.lit("hot").alias("case_id"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("turno "), F.col("id").cast("string")).alias("texto"))
    long = spark.createDataFrame([("one", 0, "palabra " * 5000), ("two", 0, "q" * 30000)], "case_id string, seq int, texto string")
    pieces = S.split_dialogues(df.unionByName(long), 1000, 100)
    worst = pieces.groupBy("case_id").agg(F.max(F.expr("fin - inicio")).alias("m"), F.count("*").alias("n"), F.max("fin").alias("l"), F.min("inicio").alias("a"), F.min("corte").alias("c")).collect()
    assert {r.case_id for r in worst} == {"hot", "one", "two"} and all(r.m <= 1000 and r.a == 0 for r in worst)
    assert {r.case_id: r.c for r in worst} == {"hot": S.TURN, "one": S.WORD, "two": S.CHAR}


def test_single_texts(spark):
    df = spark.createDataFrame([("a", 1, "palabra " * 40, "t"), ("a", 1, "palabra " * 40, "u"), ("b", 2, None, "t"), ("c", 3, "", "t")], "case_id string, seq int, texto string, pieza string")
    rows = S.split_texts(df, 100, 10, ("case_id", "seq")).collect()
    assert {(r.case_id, r.seq) for r in rows} == {("a", 1)} and all(len(r.pieza_texto) <= 100 for r in rows) and len(rows) == len(S.split_text("palabra " * 40, 100, 10))
    assert S.limits(spark.createDataFrame([("x", 5, None), ("x", 4, 1), (None, 3, 1)], "tipo string, max_chars int, solape_chars int")) == {"x": (4, 1)}


def cut_at(text, n, limit, overlap):
    """Whether n pieces fit, by definition in fractions."""
    from fractions import Fraction

    step, start = Fraction(len(text) - overlap, n), 0
    for i in range(1, n + 1):
        t = overlap + i * step
        inside = [p for p in range(1, len(text)) if t - step / 5 <= p <= t + step / 5]
        end = S.snap(text, inside[0], inside[-1], float(t))[0] if i < n else len(text)
        if end - start > limit:
            return False
        start = end - overlap
    return True


def test_least_count_that_fits(spark):
    """No smaller count fits, for texts and for the same text as turns."""
    rng = random.Random(12)
    rows, texts, saved = [], {}, 0
    for c in range(25):
        text = "".join("y" * rng.randint(1, 60) + rng.choice([" ", ". ", "\n", ""]) for _ in range(rng.randint(12, 60)))
        texts[f"c{c}"] = text
        n = len(S.split_text(text, 100, 10))
        assert all(not cut_at(text, k, 100, 10) for k in range(S.least_count(len(text), 100, 10), n)) and (len(text) <= 100 or cut_at(text, n, 100, 10))
        saved += n > S.least_count(len(text), 100, 10) + 2
        rows.append((f"c{c}", 0, text))
    assert saved
    got = {r.case_id: r["count"] for r in S.split_dialogues(spark.createDataFrame(rows, "case_id string, seq int, texto string"), 100, 10).groupBy("case_id").count().collect()}
    assert got == {c: len(S.split_text(t, 100, 10)) for c, t in texts.items() if len(t) > 100}


def test_dialogues_try_every_count_in_turn(spark):
    df = spark.createDataFrame([(x,) for x in (5001, 9710, 50_000)], "total long")
    for total, *tries in df.select("total", *(S._tries(F.col("total"), 5000, 300, i) for i in range(3))).collect():
        least, sure = S.least_count(total, 5000, 300), S.sure_count(total, 5000, 300)
        assert tries[0] == [least] and [*tries[0], *tries[1]] == list(range(least, sure + 1)) and tries[2][-1] == sure


def test_turn_that_covers_a_window_to_its_edge(spark):
    """Turns whose ends fall on the edge of a window, one beyond it and one before it."""
    rows = []
    for c, shift in enumerate(range(-3, 4)):
        total, limit, overlap = 9710, 5000, 300
        edge = S.window(1, 3, total, overlap)[1] + shift
        rows += [(f"c{c}", 0, "a" * 1000), (f"c{c}", 1, "b" * (edge - 1000)), (f"c{c}", 2, "d" * (total - edge))]
    pieces = S.split_dialogues(spark.createDataFrame(rows, "case_id string, seq int, texto string"), limit, overlap).collect()
    for c in range(7):
        own = sorted((r.pieza, r.inicio, r.fin) for r in pieces if r.case_id == f"c{c}")
        assert own[0][1] == 0 and own[-1][2] == total and all(b[1] == a[2] - overlap for a, b in zip(own, own[1:])) and all(f - i <= limit for _, i, f in own)


def test_every_dialogue_is_cut_in_whichever_round(spark):
    """Dialogues that fail at the least count, the next being the one that cannot fail; that fit at once; that take more than 64 more."""
    rows = [("next", i, "a" * n) for i, n in enumerate((4213, 3210, 1559))] + [("once", i, "b" * 900) for i in range(8)] + [("word", 0, "palabra " * 900)]
    pieces = S.split_dialogues(spark.createDataFrame(rows, "case_id string, seq int, texto string"), 5000, 300)
    assert {r.case_id: r["count"] for r in pieces.groupBy("case_id").count().collect()} == {"next": 3, "once": 2, "word": 2}
    hard = "".join(("x" * (37 if i % 3 else 23)) + " " for i in range(900))  # few places to cut at, far apart
    got = S.split_dialogues(spark.createDataFrame([("hard", 0, hard), *rows], "case_id string, seq int, texto string"), 60, 20).groupBy("case_id").agg(F.max(F.expr("fin - inicio")).alias("m"), F.max("fin").alias("l")).collect()
    assert {r.case_id: r.l for r in got} == {"hard": len(hard), "next": 8982, "once": 7200, "word": 7200} and all(r.m <= 60 for r in got)
