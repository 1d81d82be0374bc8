from pyspark.sql import functions as F

from namesieve.operators import markup
from namesieve.plans.annotate import annotate_records
from namesieve.sources.readers import split_tagged

ROWS = [
    (1, '<affiliation><org id="0">Physics</org>, <multi-org>Foo <sup>1</sup> Bar</multi-org>, <city>Oslo</city></affiliation>'),
    (2, "<affiliation>none</affiliation>"),
    (3, '<affiliation><org/><org id="1"/><organization a="b">X &amp; Y</organization><org></org></affiliation>'),
    (4, "<affiliation><ce:text>q</ce:text><org>A & B</org></affiliation>; <affiliation><org>C</org></affiliation>"),
    (5, "<affiliation><b><org>deep</org></b></affiliation>"),
    (6, "<org>top</org>"),
    (7, "<affiliation><affiliation></affiliation></affiliation>"),
    (8, "<affiliation><org>open</affiliation>"),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "k int, xml string")


def test_extraction(spark):
    rows = markup.extract_tagged(frame(spark), ["k"]).collect()
    got = {(r.k, r.ordinal): (r.tag, r.text) for r in rows}
    assert got[1, 0] == ("org", "Physics") and got[1, 1] == ("multi-org", "Foo <sup>1</sup> Bar")
    assert got[3, 0] == ("organization", "X &amp; Y") and got[3, 1] == ("org", "")
    assert not any(k == 2 for k, _ in got) and got[4, 1] == ("org", "C")


def test_dom_order_and_text(spark):
    rows = markup.extract_tagged_dom(frame(spark), ["k"]).orderBy("k", "dom_ordinal").collect()
    got = {(r.k, r.dom_ordinal): (r.tag, r.text, r.malformed, r.ordinal) for r in rows}
    assert got[1, 0] == ("org", "Physics", False, 0) and got[1, 1] == ("multi-org", "Foo ", False, 1)
    assert got[3, 0] == ("organization", "X & Y", False, 0)
    assert got[4, 0] == ("org", None, True, 0)


def test_annotations_round_trip(spark):
    df = frame(spark).where("k <> 8")
    labels = markup.extract_tagged(df, ["k"]).withColumn(
        "prediction", F.when(F.col("ordinal") % 2 == 0, "GEN").otherwise("SPE")
    )
    rows = markup.annotate_tagged(df, labels, ["k"]).withColumn(
        "back", markup.strip_annotations(F.col("annotated"))
    ).collect()
    assert all(r.back == r.xml for r in rows)
    one = {r.k: r.annotated for r in rows}
    assert '<org id="0" type="g">Physics' in one[1] and '<multi-org type="">' in one[1]
    assert '<org/><org id="1"/><organization a="b" type="g">' in one[3]
    dom = {r.k: r.annotated for r in markup.annotate_dom(df, labels, ["k"]).collect()}
    assert "<org></org>" in dom[3] and '<organization a="b" type="g">' in dom[3]
    empty = df.withColumn("xml", F.replace("xml", F.lit("<org"), F.lit('<org type=""')))
    again = markup.annotate_existing_attr(empty, labels, ["k"]).collect()
    got = {r.k: r for r in again}
    assert '<org type="g" id="0">' in got[1].annotated and got[1].missing_attr
    assert got[4].annotated.count('type="g"') == 1 and not got[4].missing_attr


def test_labels_of_nested_and_open_elements(spark):
    """A label finds the element that extraction numbered, whatever is nested or left open."""
    rows = [(1, "<org>A<org>B</org></org><org>C</org>"), (2, "<org>D</org><org>open"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "k int, xml string")
    labels = markup.extract_tagged(df, ["k"]).withColumn(
        "prediction", F.when(F.col("text").isin("C", "D"), "GEN").otherwise("SPE")
    )
    got = {r.k: r.annotated for r in markup.annotate_tagged(df, labels, ["k"]).collect()}
    assert got == {
        1: '<org type="">A<org>B</org></org><org type="g">C</org>', 2: '<org type="g">D</org><org>open', 3: None, 4: "",
    }


def test_validation_reasons(spark):
    got = {r.k: r.reject_reason for r in markup.validate_tagged(frame(spark)).collect()}
    assert got == {
        1: "sub_element", 2: None, 3: None, 4: None, 5: "deep_element", 6: "top_level", 7: "nested", 8: "unbalanced",
    }
    good, bad = markup.split_valid(markup.validate_tagged(frame(spark)))
    assert good.count() == 3 and bad.count() == 5 and good.columns == ["k", "xml"]


def test_enumeration_and_text(spark):
    rows = markup.enumerate_elements(frame(spark).where("k = 4"), ["k"]).collect()
    assert sorted((r.container_no, r.seq, r.global_seq, r.name) for r in rows) == [(0, 0, 0, "A & B"), (1, 0, 1, "C")]
    df = spark.createDataFrame([("<organization x='1'>Foo <i>y</i></organization>",)], "x string")
    assert df.select(markup.element_text(F.col("x"))).first()[0] == "Foo "


def test_annotation_job(spark, lexicon):
    lines = [(i, "\t".join(["1", "1", "raw", xml, "id"])) for i, xml in ROWS[:4]]
    wide = "\t".join(["w"] * 3 + [ROWS[0][1], ROWS[3][1]] + ["z"] * 10)
    df = spark.createDataFrame([*lines, (9, wide)], "line_no bigint, value string")
    done = {r.line_no: r.fields for r in annotate_records(split_tagged(df), lexicon).collect()}
    assert len(done) == 5 and len(done[9]) == 15
    assert 'type="g">Physics' in done[1][3] and 'type="g">Physics' in done[9][3]
    assert '<org type="">' not in done[2][3] and done[3][0] == "1"


def test_annotation_job_rejects_and_fills(spark, lexicon):
    from namesieve.plans.annotate import annotate_cells, put_back

    org = "<affiliation><org>Department of Physics</org><org></org><org>Foo University</org></affiliation>"
    rows = [
        (0, org), (1, "<affiliation><org>law & order</org></affiliation>"), (2, "<x><org>law</org></x>"),
        (3, '<affiliation><org type="">law</org></affiliation>'), (4, None), (5, "no markup"),
    ]
    cells = spark.createDataFrame([(n, 2, x) for n, x in rows], "line_no long, col int, xml string")

    def done(**options):
        return {r.line_no: (r.annotated, r.reject_reason) for r in annotate_cells(cells, lexicon, **options).collect()}

    lexical, dom = done(), done(mode="dom")
    assert lexical[0] == (org.replace("<org>Dep", '<org type="g">Dep').replace("<org></org><org>", '<org type=""></org><org type="">'), None)
    assert dom[0] == (org.replace("<org>Dep", '<org type="g">Dep').replace("<org>Foo", '<org type="">Foo'), None)
    assert dom[1] == (rows[1][1], "malformed") and lexical[1][1] is None
    assert done(container="affiliation")[2] == (rows[2][1], "top_level") and lexical[2][1] is None
    existing = done(mode="existing")
    assert existing[3] == (rows[3][1].replace('type=""', 'type="g"'), None) and existing[0] == (org, "missing_attr")
    assert lexical[5] == ("no markup", None) and lexical[4] == (None, None)
    tagged = spark.createDataFrame([(0, ["a", "b", org])], "line_no long, fields array<string>")
    back = put_back(tagged, annotate_cells(cells.where("line_no = 0"), lexicon)).first()
    assert back.fields == ["a", "b", lexical[0][0]]
