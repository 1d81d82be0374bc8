import json

from pyspark.sql import functions as F

from namesieve.sources import readers, writers
from namesieve.streaming.classify_stream import LabelSink, classify_stream


def put(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(content, encoding=encoding)
    return str(path)


def test_word_lists(spark, tmp_path):
    put(tmp_path, "types.txt", "Department\n\nDept.\ndepartment\n")
    put(tmp_path, "types.fr.txt", "École\nDépartement\n")
    put(tmp_path, "types.manual.txt", "Unit 3\n")
    rows = readers.read_dictionaries(spark, {"type": str(tmp_path / "types*.txt")}).collect()
    assert sorted((r.list, r.lang, r.term) for r in rows) == [
        ("type", "en", "department"), ("type", "en", "dept"), ("type", "fr", "cole"), ("type", "fr", "dpartement"),
        ("type", "manual", "unit 3"),
    ]


def test_tabular_readers(spark, tmp_path):
    labelled = put(tmp_path, "l.csv", 'input,id,label,numdocs\n"Dept, of ""X""",1.0,GEN,\nFoo,,SPE,3\n')
    rows = readers.read_labelled(spark, labelled).collect()
    assert [(r.input, r.id, r.label, r.numdocs) for r in rows] == [('Dept, of "X"', "1.0", "GEN", 1.0), ("Foo", None, "SPE", 3.0)]
    gold = readers.read_gold(spark, put(tmp_path, "g.tsv", 'VER_GEN\tGEN\tx\tA "quoted\nVER_SPE\tGEN\ty\tB\n')).collect()
    assert [(r.verified_label, r.input) for r in gold] == [("GEN", 'A "quoted'), ("SPE", "B")]
    mapping = readers.read_mapping(spark, put(tmp_path, "m.csv", "abbreviation,replacement\nsci.,science\nsci.,sciences\n"))
    assert [tuple(r) for r in mapping.collect()] == [("sci.", "sciences")]
    bom = put(tmp_path, "r.csv", "﻿Dataset;Classifier;Num queries;Durations;Precision;Recall\nA;B;1;2;0.5;\n")
    assert [tuple(r) for r in readers.read_matcher_results(spark, bom).collect()] == [("A", "B", 1, 2, 0.5, None)]
    grants = readers.read_grants(spark, put(tmp_path, "gr.tsv", "1\t2\t3\t<o>x</o>\ty\tz\tmore\n")).first()
    assert grants.org_xml1 == "<o>x</o>" and grants.matched_id == "z more" and grants.matched_name is None
    pairs = [["fr", [["law", "loi"], ["a b", "c"]]], ["de", [["law", "Recht"]]]]
    got = readers.read_translations(spark, put(tmp_path, "t.json", json.dumps(pairs))).collect()
    assert sorted(map(tuple, got)) == [("de", "law", "Recht"), ("fr", "a b", "c"), ("fr", "law", "loi")]


def test_nested_documents(spark, tmp_path):
    docs = {"response": {"docs": [
        {"id": "1", "name": "A", "_childDocuments_": [{"variant.name": "a1"}, {"variant.name": "a2"}]},
        {"id": "2", "name": "B"},
    ]}}
    got = readers.read_nested_docs(spark, put(tmp_path, "d.json", json.dumps(docs, indent=1))).collect()
    assert sorted(map(tuple, got)) == [("A", "1", "name"), ("B", "2", "name"), ("a1", "1", "variant"), ("a2", "1", "variant")]
    flat = {"response": {"docs": [{"id": "12-3", "variant.name": "v"}, {"id": "x-1", "variant.name": "w"}]}}
    got = readers.read_variant_docs(spark, put(tmp_path, "v.json", json.dumps(flat))).collect()
    assert sorted(map(tuple, got)) == [("v", "12"), ("w", "x-1")]


def test_tagged_round_trip_keeps_order(spark, tmp_path):
    lines = [f"{i}\t1\tx\t<affiliation>{i}</affiliation>" for i in range(500)]
    path = put(tmp_path, "t.tsv", "\n".join(lines) + "\n")
    tagged = readers.read_tagged(spark, path)
    assert [r.xml_cols for r in tagged.limit(1).collect()] == [[2, 3]]
    assert readers.markup_cells(tagged).count() == 1000
    out = str(tmp_path / "out")
    writers.write_tagged(tagged.repartition(7), out)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == lines


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "input string, n int")
    writers.write_sorted_lines(df, "input", str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["a", "b"]
    writers.write_csv(df.coalesce(1), str(tmp_path / "c"), records_per_file=2)
    assert len(list((tmp_path / "c").glob("part-*"))) == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    writers.write_predictions_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_stream_labels_every_line_once(spark, lexicon, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, "a.txt", "Department of Physics\nFoo University\n")
    put(source, "b.txt", "XYZQ\n")
    args = (str(source), str(tmp_path / "out"), str(tmp_path / "state"), lexicon)
    classify_stream(spark, *args, files_per_batch=1).awaitTermination()
    put(source, "c.txt", "Foo University\n")
    classify_stream(spark, *args).awaitTermination()
    sink = LabelSink(str(tmp_path / "out"), lexicon)
    want = [("Department of Physics", "GEN", 1), ("Foo University", "SPE", 2), ("XYZQ", "SPE", 1)]

    def found():
        return sorted(map(tuple, sink.rows(spark).groupBy("input", "prediction").agg(F.count("*").alias("n")).collect()))

    assert found() == want and {r.batch_id: r.rows for r in sink.ledger(spark).collect()} == {0: 2, 1: 1, 2: 1}
    # A batch that comes again replaces its rows; one that is not in the ledger does not count.
    sink.write(spark.createDataFrame([("Foo University",)], "input string"), 2)
    spark.createDataFrame([("x", "GEN", 9)], "input string, prediction string, batch_id long").write.json(str(tmp_path / "out/rows/batch=9"))
    assert found() == want


def test_line_numbers_follow_files_and_splits(spark, tmp_path):
    lines = {"b.txt": [f"b{i}" * (i % 7 + 1) for i in range(900)], "a.txt": [f"a{i}" for i in range(2000)], "c.txt": []}
    for name, each in lines.items():
        put(tmp_path, name, "".join(x + "\n" for x in each))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = readers.numbered_lines(spark, str(tmp_path)).repartition(5).orderBy("line_no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.value for r in found] == lines["a.txt"] + lines["b.txt"]
    assert [r.line_no for r in found] == list(range(2900))
    assert [r.file_line for r in found] == [*range(2000), *range(900)]


def test_ordered_files_hold_ranges_of_numbers(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("line_no"), F.concat(F.lit("v"), "id").alias("value"))
    for total in (None, 1000):
        path = tmp_path / f"o{total}"
        writers.write_ordered(rows.repartition(6), str(path), total=total, per_file=300)
        parts = [f.read_text().split() for f in sorted(path.glob("part-*"))]
        assert [len(p) for p in parts if p] == [300, 300, 300, 100]
        assert sum(parts, []) == [f"v{i}" for i in range(1000)]
    writers.write_ordered(rows.where("false"), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    from namesieve.operators.dataset import resample

    rows = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"))
    seen = [sorted(map(tuple, resample(rows.repartition(n), "k", 3, 40, seed=7).collect())) for n in (1, 4, 9)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 120
    assert [sum(f == i for f, _ in seen[0]) for i in range(3)] == [40] * 3
    assert resample(rows.where("false"), "k", 3, 40).count() == 0
