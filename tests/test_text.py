import random

from checker import bare, norm
from pyspark.sql import functions as F

from namesieve.functions import shape, text
from namesieve.operators import fuzzy
from namesieve.operators.normalize import preprocess, remove_stopwords_by_join

CASES = [
    "", "Université de Genève", "Université de Genève", "a b", "The  DEPT. of Physics", "A & B", "A &B",
    "x &amp; y", "d'Or l'eau d'Eau", "KK Ω 가가", "tab\tand\nnewline", "(a) Chem Unit", "12. X",
    "from the lab", "First unit IV", "Affiliated lab", "ABC,D. efg", "Ελληνικά ABC",
]


def values(spark, strings, column):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, input string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_normalisation_equals_checker(spark):
    rng = random.Random(3)
    alphabet = list("aBcDé&;#1 .,'()-") + [" d'", "é", " ", "&x;", " & ", "K", "ß"]
    strings = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    assert values(spark, strings, text.normalize_name(F.col("input"))) == [norm(s) for s in strings]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, input string")
    rows = preprocess(df, ()).orderBy("i").collect()
    assert [r.norm for r in rows] == [bare(norm(s)) for s in strings]


def test_stop_words_by_join_keep_empty_rows(spark):
    df = spark.createDataFrame([(1, "the lab the"), (2, "the the"), (3, "x the y x")], "id int, norm string")
    stops = spark.createDataFrame([("the",)], "term string")
    got = {r.id: r.norm_no_sw for r in remove_stopwords_by_join(df, stops, "id").collect()}
    assert got == {1: "lab", 2: "", 3: "x y x"}


def test_shape(spark):
    got = values(spark, ["ABC Hospital", "", "Abc. d/e"], shape.freq_capitals(F.col("input")))
    assert got == [4 / 12, 0.0, 1 / 8]
    assert values(spark, ["A1 b", " ", "AB CD e"], shape.freq_all_caps(F.col("input"))) == [0.5, 0.0, 2 / 3]
    words = ["Sci.Tech.Dept. x", "phys/chem./bio", "a/b", "ab.cd."]
    assert values(spark, words, shape.split_linked_words(F.col("input"))) == [
        "Sci. Tech. Dept. x", "phys chem. bio", "a/b", "ab.cd.",
    ]
    titles = ["McDonald", "Foo", "Foo Bar1Baz", "fOO", "123", "Fo'O"]
    assert values(spark, titles, shape.is_title(F.col("input"))) == [t.istitle() for t in titles]
    tags = F.split("input", " ")
    assert values(spark, ["a a b a", "b"], shape.join_tags(shape.collapse_runs(tags))) == ["a_b_a", "b"]
    v1 = ["fooBar", "FOO", "Foo", "Foo BARQ", "FOO BAR", "Lab (A.B)", "Lab IV (A.B)", "lab x"]
    got = values(spark, v1, shape.has_acronym_v1(F.col("input"), F.lit(False)))
    assert got == [True, True, False, True, True, True, False, False]


def test_grams(spark):
    got = values(spark, ["a b c"], F.transform(shape.grams(F.split("input", " "), 2), lambda g: g["term"]))
    assert got == [["a", "a b", "b", "b c", "c"]]


def test_fuzzy_equals_enumerated_variants(spark):
    universe = "abcdefghijklmnopqrstuvwxyz0123456789 "
    terms = ["physx", "abcd", "Lawyer", "medic al", "aaaaa"]
    closure = set(terms)
    for t in (t for t in terms if len(t) >= 5):
        for i in range(len(t) + 1):
            closure |= {t[:i] + t[i + 1 :]} if i < len(t) else set()
            for c in universe:
                closure |= {t[:i] + c + t[i:]} | ({t[:i] + c + t[i + 1 :]} if i < len(t) else set())
    rng = random.Random(1)
    queries = set(terms) | set(rng.sample(sorted(closure), 300))
    for q in list(queries):
        i = rng.randrange(len(q))
        queries |= {q[:i] + "X" + q[i:], q[:i] + "Q" + q[i + 1 :], q[:i] + q[i + 1 :], q + "z"}
    df = spark.createDataFrame([(q,) for q in queries], "query string")
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.query for r in fuzzy.fuzzy_match(df, listed).collect()}
    assert got == {q for q in queries if q in closure}
