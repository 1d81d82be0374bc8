import random

from conftest import TERMS
from checker import Checker

from namesieve.operators import rules
from namesieve.operators.lexicon import Lexicon

EDGE = [
    "", " ", "---", "the de", "Ελληνικά", "Physics Department", "Université", "Université", "PHYSICS",
    "x Department of Physics", "Unit 3", "Ward IV", "Johnson & Johnson", "A &B", "R&amp;D Unit", "Foo (ABC)",
    "Foo (A.B.C.)", "McDonald", "XYZ", "12345", "neurosurgery theology", "Logistics statics", "central",
    "central physics", "central General physics", "graduate central general law", "central a general physics",
    "ear clinic", "the ear clinic", "Centre of Hope", "CDC", "cdc", "Acme systems", "foo technologies", "Word ",
    "Dept of EE", "Dep. for CSE", "EEE Dept.", "CE Dep", "Department of Law, Foo University", "Oslo", "in Oslo now",
    "New York Physics", "physics GmbH", "GmbH", "University", "University physics dept", "college applied institute",
    "applied and experimental physics", "applied theoretical and experimental medical chemistry", "physics and law",
    "physics and law and theology", "law and biology and genetics", "biology and genetics and law",
    "physics law and theology", "dept. of applied and theoretical physics", "Research Unit of physics", "institute of xyz",
    "dept of medicine", "department for surgery", "type of xx", "institute of studies in Law", "foo, NY 12345-6789", "Foo, FL, 33199-0001",
    "Solid STATE Physics", "physics et law", "physics und law en theology", "UMRX", "aBC UMRX", "Bio ABCDE", "4ABC DEF",
    "Physics (II)", "first physics", "affiliated physics", "physics ii", "from the physics", "and law", "d'Or de d'Oslo",
]


def generated(n, seed):
    rng = random.Random(seed)
    words = [w for _, t in TERMS for w in t.split()] + [
        "of", "and", "in", "for", "et", "the", "de", "Foo", "BAR", "BAZQ", "xxology", "chirurgery", "&", "3", "II",
        "University", "(ABC)", "é", "école", "dept", "Department", "central", "general", "applied", "a",
    ]
    seps = [" "] * 12 + [", ", ". ", "  ", " ", "-"]
    out = []
    for _ in range(n):
        s = ""
        for _ in range(rng.randint(1, 7)):
            s += rng.choice(words) + rng.choice(seps)
        out.append(s if rng.random() < 0.1 else s.strip())
    return out


def test_rules_equal_row_checker(spark, lexicon):
    strings = sorted(set(EDGE + generated(4000, 11)))
    check = Checker(TERMS)
    df = spark.createDataFrame([(s,) for s in strings], "input string")
    rows = {r.input: r for r in rules.rule_matrix(df, lexicon).collect()}
    assert len(rows) == len(strings)
    seen = set()
    for s in strings:
        decided, fired = check.rules(s)
        row = rows[s]
        got = {k: row[rules.column_of(k)] for k in range(26) if row[rules.column_of(k)]}
        assert got == fired, (s, got, fired)
        assert row.list_prediction == decided, s
        assert row.prediction == (decided or fired[min(fired)])
        seen |= set(fired)
    assert seen == set(range(26))


def test_prefilter_does_not_change_results(spark, terms, lexicon):
    from dataclasses import replace

    df = spark.createDataFrame([(s,) for s in EDGE + generated(300, 5)], "input string")
    fast = rules.rule_matrix(df, lexicon)
    plain = rules.rule_matrix(df, replace(lexicon, first_words=None))
    assert sorted(map(str, fast.collect())) == sorted(map(str, plain.collect()))


def test_labels_reach_every_row_with_and_without_hot_strings(spark, lexicon):
    rows = [(i, s) for i, s in enumerate(EDGE * 3 + ["physics"] * 200 + [None])]
    df = spark.createDataFrame(rows, "id int, input string")
    runs = [
        {r.id: r.prediction for r in rules.classify(df.repartition(p), lexicon, hot_rows=h).collect()}
        for p, h in ((1, None), (7, 3), (3, 1), (5, 10**9))
    ]
    assert len(runs[0]) == len(rows)
    assert all(r == runs[0] for r in runs)


def test_switches_and_first_generation(spark, lexicon):
    df = spark.createDataFrame([("foo FL, 12345",), ("XYZQ foo",), ("Foo BARQ Group",)], "input string")
    off = rules.profile(acronyms=False, zipcodes=False)
    got = {r.input: r for r in rules.rule_matrix(df, lexicon, off).collect()}
    assert all(r.rule_09 is None and r.rule_24 is None for r in got.values())
    v1 = {r.input: r for r in rules.rule_matrix(df, lexicon, rules.profile_v1(fuzzy_subjects=False)).collect()}
    assert v1["Foo BARQ Group"].rule_24 == "SPE" and v1["foo FL, 12345"].rule_09 is None


def test_one_exchange_and_broadcast_terms(spark, lexicon, tmp_path):
    path = str(tmp_path / "strings")
    spark.createDataFrame([(s,) for s in EDGE], "input string").write.parquet(path)
    plan = rules.rule_matrix(spark.read.parquet(path), lexicon)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_large_term_table_is_not_broadcast(lexicon):
    from dataclasses import replace

    assert lexicon.fits_broadcast
    assert not replace(lexicon, n_bytes=1 << 30).fits_broadcast


def test_empty_terms_are_optional(spark):
    from namesieve.operators.lexicon import normalise_terms

    raw = spark.createDataFrame([("subject", "ελληνικά"), ("type", "dept")], ["list", "term"])
    df = spark.createDataFrame([("---",)], "input string")
    with_empty = Lexicon.compile(normalise_terms(raw))
    without = Lexicon.compile(normalise_terms(raw, keep_empty_terms=False))
    assert rules.rule_matrix(df, with_empty).first().rule_18 == "GEN"
    assert rules.rule_matrix(df, without).first().rule_18 is None


def test_registered_rules_take_their_place(spark, terms):
    import pytest

    from namesieve.operators.lexicon import Lexicon
    from namesieve.operators.rules import CustomRule, profile, rule_matrix

    more = spark.createDataFrame([("river", "rhine"), ("river", "river po")], "list string, term string")
    lexicon = Lexicon.compile(terms.select("list", "term").unionByName(more), ("river",))
    river = CustomRule("river", "SPE", ("river",), lambda found: found("river"), before=14)
    whole = CustomRule("only_river", "GEN", ("river",), lambda found: found("river"), look_at="whole", before="allow")
    strings = ["Department of Physics", "dept physics rhine", "River Po lab", "rhine", "law"]
    df = spark.createDataFrame([(x,) for x in strings], "input string")
    rows = {r.input: r for r in rule_matrix(df, lexicon, profile().register(river, whole)).collect()}
    assert [rows[x].rule_river for x in strings] == [None, "SPE", "SPE", "SPE", None]
    assert rows["rhine"].prediction == "GEN" and rows["rhine"].rule_only_river == "GEN"
    assert rows["River Po lab"].prediction == "SPE" and rows["River Po lab"].rule_first == "SPE"
    plain = {r.input: r for r in rule_matrix(df, lexicon).collect()}
    assert all(plain[x].prediction == rows[x].prediction for x in ("Department of Physics", "law"))
    with pytest.raises(ValueError):
        profile().register(river, river)
    with pytest.raises(ValueError):
        profile().register(CustomRule("x", "GEN", ("river",), lambda found: found("river"), before=77))
