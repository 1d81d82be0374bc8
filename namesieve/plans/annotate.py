"""Annotate tagged records: extract, classify distinct strings, write the labels back."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.operators.fuzzy import fuzzy_lexicon
from namesieve.operators.learning import HybridModel
from namesieve.operators.lexicon import Lexicon
from namesieve.operators.markup import (
    annotate_dom,
    annotate_existing_attr,
    annotate_tagged,
    extract_tagged,
    extract_tagged_dom,
    validate_tagged,
)
from namesieve.operators.normalize import preprocess
from namesieve.operators.rules import Profile, classify, profile, profile_v1
from namesieve.session import build_session, checkpointed
from namesieve.sources.readers import markup_cells, read_dictionaries, read_tagged
from namesieve.sources.writers import write_predictions_json, write_tagged

MODES = ("lexical", "dom", "existing")


def annotate_cells(
    cells: DataFrame,
    lexicon: Lexicon,
    prof: Profile | None = None,
    mode: str = "lexical",
    model: HybridModel | None = None,
    container: str | None = None,
    tags: tuple[str, ...] = fixed.ORG_TAGS,
) -> DataFrame:
    """``line_no, col, xml, annotated, reject_reason`` of markup cells ``line_no, col, xml``.

    Modes: ``lexical`` labels elements by their raw text, ``dom`` by the decoded text before the first
    child and only elements that have one, ``existing`` fills attributes that are there.  Texts are
    labelled by the rules or by ``model``; empty elements keep their place and get no label.  A cell that
    fails the structure checks of ``container``, holds a malformed text (``dom``) or lacks an attribute
    (``existing``) is rejected: it stays as it is and has a reason.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    keys = ["line_no", "col"]
    if container is None:
        checked = cells.select(*keys, "xml", F.lit(None).cast("string").alias("reject_reason"))
    else:
        checked = validate_tagged(cells, "xml", container, tags).select(*keys, "xml", "reject_reason")
    checked = checkpointed(checked)
    good = checked.where("reject_reason IS NULL").select(*keys, "xml")
    if mode == "dom":
        found = extract_tagged_dom(good, keys, tags=tags)
        broken = found.where("malformed").select(*keys).distinct().withColumn("late", F.lit("malformed"))
    else:
        found = extract_tagged(good, keys, tags=tags)
        broken = None
    found = checkpointed(found)
    texts = found.where("text <> ''").select(*keys, "ordinal", F.col("text").alias("input"))
    labelled = model.predict(texts, lexicon, prof) if model else classify(texts, lexicon, prof)
    labels = found.join(labelled.select(*keys, "ordinal", "prediction"), [*keys, "ordinal"], "left").withColumn(
        "prediction", F.coalesce("prediction", F.lit(""))
    )
    write = {"lexical": annotate_tagged, "dom": annotate_dom, "existing": annotate_existing_attr}[mode]
    done = write(good, labels, keys, tags=tags)
    if mode == "existing":
        late = F.when(F.col("missing_attr"), F.lit("missing_attr"))
    elif broken is not None:
        done, late = done.join(broken, keys, "left"), F.col("late")
    else:
        late = F.lit(None).cast("string")
    done = done.select(*keys, F.when(late.isNull(), F.col("annotated")).alias("annotated"), late.alias("late"))
    return checked.join(done, keys, "left").select(
        *keys, "xml", F.coalesce("annotated", "xml").alias("annotated"),
        F.coalesce("reject_reason", "late").alias("reject_reason"),
    )


def put_back(tagged: DataFrame, cells: DataFrame) -> DataFrame:
    """``line_no, fields`` with the annotated cells in their places."""
    done = cells.groupBy("line_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "annotated"))).alias("new")
    )
    return tagged.join(done, "line_no", "left").select(
        "line_no",
        F.expr("transform(fields, (f, i) -> coalesce(new[i], f))").alias("fields"),
    )


def annotate_records(tagged: DataFrame, lexicon: Lexicon, prof: Profile | None = None, **options) -> DataFrame:
    """``line_no, fields`` with annotated markup fields; options as in ``annotate_cells``."""
    return put_back(tagged, annotate_cells(markup_cells(tagged), lexicon, prof, **options))


def main(argv: list[str] | None = None) -> None:
    """``spark-submit`` entry: input, output, and a JSON file mapping list names to globs."""
    parser = argparse.ArgumentParser()
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--word-lists", required=True, help="JSON file: list name -> path or paths")
    parser.add_argument("--generation", type=int, choices=(1, 2), default=2)
    parser.add_argument("--fuzzy", action="store_true", help="subjects within one edit count too")
    parser.add_argument("--no-acronyms", action="store_true")
    parser.add_argument("--no-zipcodes", action="store_true")
    parser.add_argument("--xml-column", type=int, default=None)
    parser.add_argument("--mode", choices=MODES, default="lexical")
    parser.add_argument("--container", default=None, help="check the structure below this element first")
    parser.add_argument("--model", default=None, help="folder of a saved hybrid model")
    parser.add_argument("--rejects", default=None, help="folder for the rejected cells, as JSON")
    args = parser.parse_args(argv)
    spark = build_session("annotate")
    globs = json.loads(spark.read.option("wholetext", True).text(args.word_lists).first().value)
    terms = read_dictionaries(spark, globs)
    if args.generation == 1:
        prof = profile_v1(fuzzy_subjects=args.fuzzy)
    else:
        prof = profile("job", not args.no_acronyms, not args.no_zipcodes, args.fuzzy)
    tagged = read_tagged(spark, args.source, args.xml_column)
    lexicon = Lexicon.compile(terms)
    if args.fuzzy:
        texts = extract_tagged(markup_cells(tagged), ["line_no"]).select(F.col("text").alias("input")).distinct()
        lexicon = fuzzy_lexicon(preprocess(texts, lexicon.stop_words, generation=args.generation), terms)
    model = HybridModel.load(spark, args.model) if args.model else None
    cells = checkpointed(
        annotate_cells(markup_cells(tagged), lexicon, prof, args.mode, model, args.container)
    )
    write_tagged(put_back(tagged, cells), args.target)
    if args.rejects:
        write_predictions_json(cells.where("reject_reason IS NOT NULL").select("line_no", "col", "xml", "reject_reason"), args.rejects)


if __name__ == "__main__":
    main()
