import random

import pytest

from ambarina.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "Hola, ¿qué tal?  \n\n", "a" * 3000, "ñandú " * 500, "👩🏽‍⚕️ é é\r\n", "<|endoftext|>", "   ", "\t\tx  y", "漢字かな交じり文" * 40, "don't I'LL 've", "0123456789" * 300, "Ã³ Ã±", "x" + " " * 5000 + "y", "ab" * 4000]


def test_same_ids_as_the_library(ranks, reference):
    e = bpe.Encoder(ranks)
    rng = random.Random(1)
    alphabet = "abcñé ß\n\t.,1290漢🙂́ -_"
    for t in [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(500))]:
        assert list(e.encode(t)) == reference.encode_ordinary(t), t[:50]
        assert e.count(t) == len(e.encode(t))


def test_tree_picks_leftmost_lowest():
    tree = bpe.PairTree([5, 3, -1, 3, 9])
    assert tree.lowest() == 1
    tree.set(1, -1)
    assert tree.lowest() == 3
    tree.set(3, 7)
    assert tree.lowest() == 0
    for i in range(5):
        tree.set(i, -1)
    assert tree.lowest() == -1 and bpe.PairTree([]).lowest() == -1


def test_rows(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate([None, *TEXTS, TEXTS[1]])] + [(None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id").collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", keep=("ids",)).collect()} == {i: len(v) for i, v in got.items()}
    assert bpe.encode(df.limit(0), "doc_id").count() == 0
    assert bpe.with_special(bpe.encode(df, "doc_id"), 50256).filter("doc_id = 0").first().ids == [50256]


def test_memory_of_parts_starts_anew(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    e = bpe.Encoder(ranks)
    text = " ".join(f"palabrita{i}" for i in range(300))
    assert list(e.encode(text)) == list(bpe.Encoder(ranks).encode(text)) and len(e.known) < 100
