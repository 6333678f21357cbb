import random

import pytest

from ambarina.llm import terms as T

LIST = [(1, "Estenosis de la válvula mitral", "I11.0", "111", "Stenosis of mitral valve (finding)", ["Estrechez de la válvula mitral"], "x"),
        (2, "Estenosis del tabique ventricular", "I11.1", "112", "Stenosis of ventricular septum (finding)", [], "x"),
        (3, "Fibrosis del nodo sinusal aguda", "I18.0", "113", "Acute fibrosis of sinus node (disorder)", ["Cicatriz interna del nodo sinusal aguda"], "x"),
        (4, "Fibrosis del nodo sinusal crónica", "I18.1", "113", "Chronic fibrosis of sinus node (disorder)", ["Cicatriz interna del nodo sinusal crónica"], "x"),
        (5, "Luxación del menisco interno", "S19.0", "115", "Dislocation of medial meniscus (disorder)", None, "x"),
        (6, "Hiperplasia del timo", "E20.0", None, None, [], "x"), (None, "nada", None, None, None, None, None)]
ENTRIES = "entrada_id long, nombre string, cie10 string, snomed_ct string, snomed_termino string, termino_id string"


@pytest.fixture(scope="module")
def forms():
    return T.Forms([(k, c or "", [("es", T.plain(n)) for n in (name, *(syn or []))] + ([("en", T.plain(t.split(" (")[0]))] if t else [])) for k, name, c, _, t, syn, _ in LIST[:-1]])


@pytest.mark.parametrize("text,want", [
    ("ESTENOSIS DE LA VALVULA MITRAL ", ("uno", (1,))), ("Estrechez  de la válvula mitral", ("uno", (1,))), ("Stenosis of mitral valve", ("uno", (1,))), ("EstenosiÂ\xads", ("varios", (1, 2))),
    ("válvula mitral, estenosis de la", ("uno", (1,))), ("Dx: probable estnosis dela válvuIa mitral?", ("uno", (1,))), ("Esten. de la válv. mitr.", ("uno", (1,))), ("Estenosis del tabiqueventricular", ("uno", (2,))),
    ("Fibrosis aguda del nodo sinusal", ("uno", (3,))), ("Fibrosis del nodo sinusal", ("varios", (3, 4))), ("Fibrosis del nodo sinusal cr0n1ca", ("uno", (4,))), ("fibrosis del tabique ventricular", ("fuera", ())),
    ("Estenosis de la válvula mitral crónica", ("fuera", ())), ("Luxación del menisco externo", ("fuera", ())), ("Subluxación del menisco interno", ("fuera", ())), ("Hipoplasia del timo", ("fuera", ())), ("Caries", ("fuera", ())),
    ("i11.1", ("uno", (2,))), ("cod. I111", ("uno", (2,))), ("I18", ("varios", (3, 4))), ("I99.9", ("fuera", ())), (None, ("nada", ())), ("", ("nada", ())), ("  - ", ("nada", ())), ("ver código", ("nada", ())), ("ÍDEM", ("nada", ())), ("x" * 9000, ("fuera", ())), ("estenosis " * 5000, ("fuera", ())), ("de la " * 3000, ("nada", ())),
])
def test_meaning(forms, text, want):
    assert forms.meaning(text) == want


def test_slips_at_a_beginning_are_slips():
    assert not T.other_word("difuncion", "disfuncion") and not T.other_word("dissplasia", "displasia") and not T.other_word("hyperplasia", "hiperplasia")
    assert T.other_word("hipoplasia", "hiperplasia") and T.other_word("subluxacion", "luxacion") and T.other_word("externo", "interno")


def test_common_words_are_their_own():
    entries = [(1, "A00.0", [("es", "hernia del paladar")])]
    assert T.Forms(entries).meaning("Herniola del paladar")[0] == "uno"
    assert T.Forms(entries, words={"herniola": (40, 40), "hernia": (300, 300)}).meaning("Herniola del paladar")[0] == "fuera"
    assert T.Forms(entries, words={"herniola": (6, 6), "hernia": (300, 300)}).meaning("Herniola del paladar")[0] == "uno"


def test_a_hot_list_word_swallows_no_other():
    """A list word that a third of all keys have, in few texts: a word near it keeps its own texts as evidence; a slip of it has few."""
    entries = [(1, "A00.0", [("es", "infeccion del paladar")]), (2, "A00.1", [("es", "lesion de la medula")])]
    hot = {"infeccion": (1_000_000, 90), "medula": (1_000_000, 80), "infestacion": (60, 20), "medusa": (60, 12), "infeccoin": (60, 2), "medlua": (60, 4)}
    forms = T.Forms(entries, words=hot)
    assert forms.own_words == {"infestacion", "medusa"}


def test_prefix_filter_loses_nothing(forms):
    rng = random.Random(4)
    texts = [n for _, n, *_ in LIST[:-1]]
    for _ in range(300):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("aeiou lrst")
        g = T.grams(T.tokens(T.plain("".join(t))))
        brute = {}
        for f, words in enumerate(forms.form_words):
            s = T.grams(T.Token(w, False) for w in words)  # empty for a code
            j = len(g & s) / max(1, len(g | s))
            if j >= forms.open:
                brute[f] = j
        assert forms.candidates(g, forms.open) == pytest.approx(brute)
        assert forms.candidates(g) == pytest.approx({f: j for f, j in brute.items() if j >= forms.similar})


def rows():
    return [(1, "Estenosis de la valvula mitral", None, None, None, "e"), (2, None, "I11,1", None, None, "e"), (3, "Fibrosis del nodo sinusal", "I181", None, "Chronic fibrosis of sinus nod", "e"), (4, "Fibrosis del nodo sinusal", None, "113", None, "e"),
            (5, "ver código", "I11.0", "112", "Stenosis of ventricular septum", "e"), (6, "Luxación del menisco externo", "S19.0", "115", None, "e"), (7, None, None, None, None, None), (8, "Estenosis de la válvula mitral", "S19.0", None, None, "e"),
            (9, "N/A", "I11.99", None, None, "e"), (None, "Hiperplasia del timo", None, None, None, None), (10, "n/a", None, "113", None, "e"), (11, "", "I11.0", None, "Caries dental", "e")]


def test_resolve(spark):
    terms = spark.createDataFrame(LIST, "termino_id int, nombre string, cie10 string, snomed_ct string, snomed_termino string, sinonimos array<string>, especialidad string")
    df = spark.createDataFrame(rows() + rows()[:3], ENTRIES)
    got = {r.entrada_id: (r.termino_id, r.veredicto) for r in T.resolve(df, terms).collect()}
    assert got == {1: (1, "nombre"), 2: (2, "otros"), 3: (4, "otros"), 4: (None, "abierto"), 5: (2, "otros"), 6: (None, "fuera"), 7: (None, "nada"), 8: (1, "nombre"), 9: (None, "abierto"), None: (6, "nombre"), 10: (None, "abierto"), 11: (None, "fuera")}
    assert T.resolve(df.limit(0), terms).count() == 0
    assert T.resolve(df, terms.limit(0)).filter("termino_id is not null").count() == 0


def test_shuffled_join_is_the_same(spark, forms):
    rng = random.Random(9)
    base = [n for _, n, *_ in LIST[:-1]]
    left = [(i, "".join(c if rng.random() > 0.08 else rng.choice("aeiou ") for c in rng.choice(base))) for i in range(60)] + [(100, None), (101, "")]
    right = [(i, n) for i, n in enumerate(base)] + [(50, None)]
    got = {(r.l, r.r): r.jaccard for r in T.similarity_join(spark.createDataFrame(left, "l int, text string"), spark.createDataFrame(right, "r int, text string"), 0.3, best=False).collect()}
    sets = {k: T.grams(T.tokens(T.plain(t))) for k, t in right if t}
    want = {}
    for k, t in left:
        g = T.grams(T.tokens(T.plain(t)))
        for r, s in sets.items():
            if g and len(g & s) / len(g | s) >= 0.3:
                want[k, r] = len(g & s) / len(g | s)
    assert got == pytest.approx(want)
    best = T.similarity_join(spark.createDataFrame(left, "l int, text string"), spark.createDataFrame(right, "r int, text string"), 0.3)
    assert best.count() == len({k for k, _ in want})


TERMS = "termino_id int, nombre string, cie10 string, snomed_ct string, snomed_termino string, sinonimos array<string>, especialidad string"


def test_unrelated_texts_change_nothing(spark):
    """Every own word and verdict stays when texts that have nothing to do with the list are added, and when all rows are delivered thrice."""
    terms = spark.createDataFrame(LIST, TERMS)
    typed = ["Estenosis de la válvula mitral", "Estenosis de la valvula mitrel", "Estemosis valvular mitral", "Hiperplasia del timo", "Luxacion del menisco interno"]
    own = [f"Esclerosis de la válvula mitral {x}" for x in ("", "?", "probable", "dx", "posible", "control")]  # a word of its own, near a list word
    df = spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(typed + own)], ENTRIES)
    noise = spark.range(20_000).selectExpr("id + 1000 as entrada_id", "concat('texto ', hex(id * 7919), ' ', hex(id * 104729)) as nombre", "cast(null as string) as cie10", "cast(null as string) as snomed_ct", "cast(null as string) as snomed_termino", "'x' as termino_id")
    want = {r.entrada_id: (r.termino_id, r.veredicto) for r in T.resolve(df, terms).collect()}
    assert {i for i, v in want.items() if v[0] is None} == {len(typed) + i for i in range(len(own))}
    got = {r.entrada_id: (r.termino_id, r.veredicto) for r in T.resolve(df.unionByName(noise), terms).filter("entrada_id < 1000").collect()}
    thrice = {r.entrada_id: (r.termino_id, r.veredicto) for r in T.resolve(df.unionByName(df).unionByName(df), terms).collect()}
    assert got == want == thrice


def test_a_list_of_any_length(spark):
    """The shuffled way gives what the list in memory gives."""
    terms = spark.createDataFrame(LIST, TERMS)
    rng = random.Random(11)
    more = []
    for i in range(150):
        name = list(rng.choice([n for _, n, *_ in LIST[:-1]]))
        for _ in range(rng.randint(0, 4)):
            name[rng.randrange(len(name))] = rng.choice("aeiou lrst.")
        more.append((100 + i, "".join(name), rng.choice([None, "I11.0", "I18", "x", "S19.0"]), rng.choice([None, "113", "115"]), rng.choice([None, "Stenosis of mitral valve", "Hernia"]), "e"))
    df = spark.createDataFrame(rows() + rows()[:3] + more + [(900, "i11.1", None, None, None, None), (901, "I18", "I18.0", None, None, None), (902, "I99.9", None, None, None, None), (903, "x" * 9000, None, None, None, None)], ENTRIES)
    want = {r.entrada_id: (r.termino_id, r.veredicto) for r in T.resolve(df, terms).collect()}
    got = {r.entrada_id: (r.termino_id, r.veredicto) for r in T.resolve(df, terms, most=3).collect()}
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert T.resolve_shuffled(df.limit(0), terms).count() == 0 and T.resolve_shuffled(df, terms.limit(0)).filter("termino_id is not null").count() == 0


def test_more_than_200_000_forms(spark):
    """A list that no task holds: 70,000 entries of three forms, made of syllables; typed exactly, mistyped, turned round and off the list."""
    syllable = "ba be bi bo bu ca co cu da de di do du fa fe fi fo ga go ja jo la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po pu ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo za zo".split()
    word = lambda i: "".join(syllable[(i // 60**j * 7 + j * 13 + i) % 60] for j in range(4)) + "sis"
    site = lambda i: "".join(syllable[(i // 60**j * 11 + j * 17 + i * 3) % 60] for j in range(4)) + "ria"
    n = 70_000
    names = [f"{word(i // 100)} de la {site(i % 100)} {word(i // 100 + 900)}" for i in range(n)]
    listed = spark.createDataFrame([(i, names[i], f"{chr(65 + i % 26)}{i // 26 % 100:02d}.{i // 2600 % 10}", str(i), f"{names[i]}x (disorder)", [f"{names[i]} b{site(i % 100)}"], "e") for i in range(n)], TERMS)
    pick = [0, 777, 12_345, 69_999]
    typed = [(i, names[k]) for i, k in enumerate(pick)] + [(10 + i, " ".join(reversed(names[k].split()))) for i, k in enumerate(pick)] + [(20 + i, names[k][:3] + "z" + names[k][4:]) for i, k in enumerate(pick)]
    typed += [(30, "quemadura de la cornea"), (31, names[5] + " quemadura"), (32, None)]
    df = spark.createDataFrame([(i, t, None, None, None, None) for i, t in typed], ENTRIES)
    got = {r.entrada_id: r.termino_id for r in T.resolve(df, listed).collect()}
    assert all(got[b + i] == k for b in (0, 10, 20) for i, k in enumerate(pick))
    assert got[30] is got[31] is got[32] is None
