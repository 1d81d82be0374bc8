"""Named queries over the shared tables, one per operator of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from namesieve.functions import shape, text
from namesieve.operators import acronyms as ac
from namesieve.operators import dataset as ds
from namesieve.operators import fuzzy, lexicon, markup, overlap, rules, scoring, tokens
from namesieve.operators import spans as sp
from namesieve.operators.normalize import preprocess, remove_stopwords_by_join
from namesieve.plans import annotate, files, inputs, learned  # noqa: F401  (register their queries)
from namesieve.plans.inputs import table
from namesieve.plans.registry import QUERIES, query  # noqa: F401
from namesieve.session import checkpointed
from namesieve.sources import readers, writers
from namesieve.streaming import classify_stream

LINK_TAGS = ("a",)
ARTICLE_TAGS = ("h1", "b")

# ---------------------------------------------------------------- normalisation


@query
def normalize_strings(spark, sf):
    rows = preprocess(inputs.segments(spark, sf), inputs.STOP_WORDS)
    return rows.select("doc_id", "pos", "base", "norm", "norm_no_sw")


@query
def normalize_strings_v1(spark, sf):
    rows = preprocess(inputs.segments(spark, sf), inputs.STOP_WORDS, generation=1)
    return rows.select("doc_id", "pos", "base", "norm", "norm_no_sw")


@query
def normalization_steps(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        F.md5(text.nfc(html)).alias("nfc"),
        F.md5(text.strip_entities(html)).alias("no_entities"),
        F.md5(text.ampersand_to_and(html)).alias("ampersand"),
        F.md5(text.d_apostrophe(html)).alias("apostrophe"),
        F.md5(text.strip_punct(html)).alias("no_punct"),
        F.md5(text.squeeze_trim(html)).alias("squeezed"),
        F.md5(text.protect_ampersand(html)).alias("protected"),
    )


@query
def remove_stopwords(spark, sf):
    rows = preprocess(table(spark, sf, "conversations"), (), "text").select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), "norm"
    )
    stops = inputs.word_lists(spark, sf).where("list = 'stop_word'")
    return remove_stopwords_by_join(rows, stops, "key").select("key", "norm_no_sw")


@query
def token_ngrams(spark, sf):
    """N-grams of up to three words, or up to the longest listed term if that is longer."""
    rows = preprocess(inputs.documents(spark, sf, "text"), (), "text")
    longest = max(3, inputs.lexicon(spark, sf).max_words(*lexicon.LISTS))
    return (
        shape.gram_rows(rows, F.split("norm", " "), longest)
        .groupBy("n", "term")
        .agg(F.count("*").alias("c"))
        .groupBy("n")
        .agg(F.sum("c").alias("n_grams"), F.count("*").alias("n_distinct"))
    )


@query
def acronyms(spark, sf):
    names = table(spark, sf, "nation").select(
        F.concat(F.lit("Office of "), "n_name", F.lit(" (N.O."), F.col("n_nationkey"), F.lit(")")).alias("input")
    )
    rows = inputs.segments(spark, sf).select("input").unionByName(names)
    found = ac.with_acronyms(rows).select("input", F.array_join("acronyms", " ").alias("acronyms"))
    return found.groupBy("input", "acronyms").agg(F.count("*").alias("n"))


@query
def linked_words(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(" "),
            F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(". "), "p_type",
        ).alias("input"),
    )
    return parts.select("p_partkey", shape.split_linked_words(F.col("input")).alias("words"))


@query
def lexical_shape(spark, sf):
    s = F.col("input")
    return inputs.segments(spark, sf).select(
        "doc_id",
        "pos",
        shape.char_len(s).alias("char_len"),
        shape.word_len(s).alias("word_len"),
        shape.freq_capitals(s).alias("freq_capitals"),
        shape.freq_all_caps(s).alias("freq_all_caps"),
        text.special_char_flag(s).alias("special"),
    )


@query
def regex_and_length_filters(spark, sf):
    rows = inputs.segments(spark, sf)
    return rows.select(
        F.count_if(F.length("input") < 15).alias("below_15"),
        F.count_if(F.length("input") >= 60).alias("from_60"),
        F.count_if(F.length("input") >= 140).alias("from_140"),
        F.count_if(F.col("input").rlike(r"^\w{3,}\.?(/\w{3,}\.?)+")).alias("slashed"),
        F.count_if(F.col("input").rlike(r"^\w+[.]\s")).alias("abbreviated"),
        F.count_if(F.col("input").rlike(r"\w\w,\s+[0-9]{5}")).alias("zipcode"),
    )


@query
def repair_ragged_tsv(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.replace("text", F.lit(" "), F.lit("\t")).alias("line")
    )
    return lines.select("doc_id", F.md5(text.repair_ragged(F.col("line"))).alias("repaired"))


# ---------------------------------------------------------------- word lists and joins


def _document_tokens(spark, sf):
    rows = inputs.documents(spark, sf, "text").select(
        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")
    )
    return rows.where("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))


@query
def dictionary_table(spark, sf):
    return inputs.word_lists(spark, sf)


@query
def dictionary_exact(spark, sf):
    listed = inputs.word_lists(spark, sf).where("list = 'type'")
    return lexicon.dictionary_exact(_document_tokens(spark, sf), listed, "token")


@query
def dictionary_semi(spark, sf):
    return lexicon.keep_listed(_document_tokens(spark, sf), inputs.word_lists(spark, sf), "token")


@query
def dictionary_anti(spark, sf):
    return lexicon.drop_listed(_document_tokens(spark, sf), inputs.word_lists(spark, sf), "token")


@query
def dictionary_ngram_hits(spark, sf):
    """Strings per list that contain any n-gram of the list."""
    lex = inputs.lexicon(spark, sf)
    names = ("location", "company_name", "company_type", "university")
    rows = preprocess(inputs.segments(spark, sf).select("input").distinct(), lex.stop_words)
    rows = rows.withColumn("toks", text.words(F.col("norm")))
    probes = sp.gram_probes(sp.NORM, "toks", lex.max_words(*names), lex.first_words)
    found = sp.find_spans(rows, lex, ["input"], ["norm"], probes).select(
        sp.mask_at(sp.NORM).alias("m")
    )
    counted = found.agg(
        *[F.count_if(lexicon.hit_list(F.col("m"), n)).alias(n) for n in names]
    )
    return counted.selectExpr(
        "stack(4, " + ", ".join(f"'{n}', {n}" for n in names) + ") AS (list, n_strings)"
    )


@query
def fuzzy_match(spark, sf):
    terms = inputs.word_lists(spark, sf).where("list IN ('subject', 'subject_modifier')")
    return fuzzy.fuzzy_match(_document_tokens(spark, sf), terms, "token")


@query
def pooled_phrases(spark, sf):
    return lexicon.pooled_phrases(inputs.word_lists(spark, sf))


# ---------------------------------------------------------------- rules


@query
def classify_strings(spark, sf):
    lex = inputs.lexicon(spark, sf)
    matrix = rules.rule_matrix(inputs.segments(spark, sf), lex)
    return matrix.select("input", "list_prediction", "rule_first", "prediction")


@query
def classify_rows(spark, sf):
    """Labels joined back to every row, counted per document."""
    lex = inputs.lexicon(spark, sf)
    done = rules.classify(inputs.segments(spark, sf), lex, hot_rows=500)
    return done.groupBy("doc_id", "prediction").agg(F.count("*").alias("n"))


@query
def classify_without_switches(spark, sf):
    prof = rules.profile("plain", acronyms=False, zipcodes=False)
    talk = inputs.pieces(table(spark, sf, "conversations"), "text")
    return rules.rule_matrix(talk, inputs.lexicon(spark, sf), prof).select("input", "prediction")


@query
def classify_v1(spark, sf):
    prof = rules.profile_v1(fuzzy_subjects=False)
    talk = inputs.pieces(table(spark, sf, "conversations"), "text")
    return rules.rule_matrix(talk, inputs.lexicon(spark, sf), prof).select("input", "prediction")


@query
def classify_v1_fuzzy(spark, sf):
    """The first generation as it is by default: subjects within one edit count."""
    probe = inputs.probe_strings(spark, sf)
    lists = inputs.word_lists(spark, sf).select("list", "term")
    content = preprocess(probe, inputs.lexicon(spark, sf).stop_words, generation=1)
    near = fuzzy.fuzzy_lexicon(content, lists)
    return rules.rule_matrix(probe, near, rules.profile_v1()).select("input", "rule_18", "prediction")


@query
def custom_rule(spark, sf):
    """A registered rule with a list of its own: strings of three words or more with a topic are specific."""
    topics = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where(
        "length(term) = 5 AND term LIKE 'e%'"
    )
    lists = inputs.word_lists(spark, sf).select("list", "term")
    lex = lexicon.Lexicon.compile(lists.unionByName(topics.select(F.lit("topic").alias("list"), "term")), ("topic",))
    several = F.size(F.split("norm", " ")) >= 3
    topic = rules.CustomRule("topic", "SPE", ("topic",), lambda found: found("topic") & several, before=13)
    prof = rules.profile().register(topic)
    talk = inputs.pieces(table(spark, sf, "conversations"), "text")
    return rules.rule_matrix(talk, lex, prof).select("input", "rule_topic", "rule_first", "prediction")


@query
def stream_labels(spark, sf):
    """Lines of several files, labelled batch by batch; one batch comes twice."""
    source, target = files.scratch(spark, "arriving"), files.scratch(spark, "labels")
    talk = inputs.pieces(table(spark, sf, "conversations").where("text IS NOT NULL"), "text").select(F.col("input").alias("value"))
    talk.repartition(3).write.text(source)
    lex = inputs.lexicon(spark, sf)
    classify_stream.classify_stream(spark, source, target, files.scratch(spark, "state"), lex, files_per_batch=1).awaitTermination()
    sink = classify_stream.LabelSink(target, lex)
    again = checkpointed(sink.rows(spark).where("batch_id = 1").select("input"))
    sink.write(again, 1)
    return sink.rows(spark).groupBy("input", "prediction").agg(F.count("*").alias("n"))


@query
def rule_matrix(spark, sf):
    talk = inputs.pieces(table(spark, sf, "conversations"), "text")
    return rules.rule_matrix(talk, inputs.lexicon(spark, sf)).select("input", *rules.RULE_COLUMNS)


@query
def subject_match(spark, sf):
    """Pieces and words of benchmark that are subjects (rule 18), through the fuzzy profile as well."""
    lists = inputs.word_lists(spark, sf).select("list", "term")
    probe = inputs.probe_strings(spark, sf)
    lex = inputs.lexicon(spark, sf)
    content = preprocess(probe, lex.stop_words)
    near = fuzzy.fuzzy_lexicon(content, lists)
    strict = rules.rule_matrix(probe, lex).select("input", F.col("rule_18").alias("strict"))
    loose = rules.rule_matrix(probe, near, rules.profile(fuzzy_subjects=True)).select(
        "input", F.col("rule_18").alias("loose")
    )
    return strict.join(loose, "input").where("loose IS NOT NULL")


@query
def modifier_chain(spark, sf):
    rows = rules.rule_matrix(inputs.segments(spark, sf), inputs.lexicon(spark, sf))
    return rows.where("rule_20 IS NOT NULL").select("input", "norm_no_sw", "rule_20")


@query
def rule_mask(spark, sf):
    talk = inputs.pieces(table(spark, sf, "conversations"), "text")
    return rules.rule_mask(rules.rule_matrix(talk, inputs.lexicon(spark, sf)))


@query
def rule_prefix(spark, sf):
    links = markup.extract_tagged(inputs.fragments(spark, sf), ["page_id", "part"], tags=LINK_TAGS)
    matrix = rules.rule_matrix(links.withColumnRenamed("text", "input"), inputs.lexicon(spark, sf))
    return scoring.cumulative_prefix(matrix, "input")


# ---------------------------------------------------------------- evaluation


@query
def score_by_rule(spark, sf):
    # One row for each string and label, so the rows of a frequent string do not meet in one task.
    rows = inputs.labelled_segments(spark, sf).groupBy("input", "label").agg(F.count("*").alias("rows"))
    matrix = rules.rule_matrix(rows, inputs.lexicon(spark, sf)).select("input", *rules.RULE_COLUMNS)
    return scoring.ablation(rows.join(matrix, "input"))


@query
def rule_overlap(spark, sf):
    talk = inputs.pieces(table(spark, sf, "conversations"), "text")
    return scoring.rule_overlap(rules.rule_matrix(talk, inputs.lexicon(spark, sf)))


@query
def score_plain(spark, sf):
    return scoring.score(inputs.labels(spark, sf))


@query
def score_weighted(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return scoring.score(inputs.labels(spark, sf).join(docs, "doc_id"), weight="n_chars", beta=2.0)


@query
def score_by_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return scoring.score(inputs.labels(spark, sf).join(docs, "doc_id"), by=("lang",))


@query
def score_by_length(spark, sf):
    return scoring.score_by_length(inputs.labelled_segments(spark, sf))


@query
def score_short(spark, sf):
    return scoring.score_short(inputs.labelled_segments(spark, sf))


@query
def accuracy(spark, sf):
    return scoring.accuracy(inputs.labels(spark, sf))


@query
def system_crosstab(spark, sf):
    return scoring.system_crosstab(
        inputs.labelled_segments(spark, sf), {"silver": "label", "second": "prediction"}
    )


@query
def profile_changes(spark, sf):
    return scoring.compare_profiles(inputs.labelled_segments(spark, sf), "label", "prediction")


@query
def share_different(spark, sf):
    return scoring.share_different(inputs.labels(spark, sf), "label", "prediction")


@query
def error_rows(spark, sf):
    return scoring.errors(inputs.labels(spark, sf))


@query
def correct_rows(spark, sf):
    return scoring.correct(inputs.labels(spark, sf))


@query
def length_histogram(spark, sf):
    return scoring.length_histogram(inputs.segments(spark, sf), width=20)


@query
def describe_lengths(spark, sf):
    hist = scoring.length_histogram(inputs.segments(spark, sf))
    row = scoring.describe_counts(hist, "length")
    return row.select(
        "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        "min", "q25", "q50", "q75", "max",
    )


@query
def label_counts(spark, sf):
    return scoring.value_counts(inputs.labelled_segments(spark, sf), "label")


@query
def regression_diff(spark, sf):
    """Labels of one source against predictions of another that lacks some rows."""
    rows = inputs.labels(spark, sf)
    lines = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") % 2 == 0, "GEN").otherwise("SPE").alias("prediction")
    )
    return scoring.regression_diff(rows.select("doc_id", "label"), lines.where("doc_id % 5 > 0"), "doc_id")


@query
def baseline_delta(spark, sf):
    totals = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("classifier")
    ).agg(F.count("*").alias("num_queries"), F.sum((F.col("o_totalprice") * 100).cast("bigint")).alias("durations"))
    return scoring.baseline_delta(totals, "classifier", "F", "O", "dataset", ["num_queries", "durations"])


# ---------------------------------------------------------------- tokens


@query
def token_frequency(spark, sf):
    return tokens.token_frequency(inputs.documents(spark, sf, "text"), "text")


@query
def token_rank_bands(spark, sf):
    return tokens.rank_bands(tokens.token_frequency(inputs.documents(spark, sf, "text"), "text"))


@query
def top_words(spark, sf):
    freq = tokens.token_frequency(inputs.documents(spark, sf, "text"), "text")
    return tokens.top_tokens(freq, 100)


@query
def frequency_stats(spark, sf):
    rows = inputs.documents(spark, sf, "text").withColumnRenamed("text", "input")
    return tokens.frequency_stats(rows, tokens.token_frequency(rows), "doc_id")


@query
def last_mapping(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.lower("o_orderpriority").alias("abbreviation"),
        F.concat_ws("-", "o_orderstatus", "o_custkey").alias("replacement"),
        F.col("o_orderkey").alias("line_no"),
    )
    return tokens.last_mapping(rows)


def _mapping(spark, sf):
    """Abbreviations: the words of benchmark, replaced by the word and its length."""
    words = table(spark, sf, "benchmark").select(
        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("abbreviation"), F.col("item_id")
    ).where("abbreviation <> ''")
    return tokens.last_mapping(
        words.select(
            "abbreviation",
            F.concat_ws("_", "abbreviation", "item_id").alias("replacement"),
            F.col("item_id").alias("line_no"),
        )
    )


@query
def translate_tokens(spark, sf):
    rows = inputs.documents(spark, sf, "text").withColumnRenamed("text", "input")
    done = tokens.translate_tokens(rows, _mapping(spark, sf), "doc_id")
    return done.select("doc_id", F.md5("translated").alias("translated"))


@query
def tag_sequences(spark, sf):
    rows = inputs.documents(spark, sf, "text").withColumnRenamed("text", "input")
    tags = tokens.tag_table(inputs.word_lists(spark, sf))
    keep = tokens.top_tokens(tokens.token_frequency(rows), 100)
    done = tokens.tag_sequences(rows, tags, "doc_id", keep=keep)
    return done.select(
        "doc_id",
        F.size("tags").cast("bigint").alias("n_tags"),
        F.md5(shape.join_tags(F.col("tags"))).alias("joined"),
    )


@query
def top_level_tags(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("input")
    )
    lists = inputs.word_lists(spark, sf)
    tags = tokens.top_level_table(lists, lists.where("list = 'type'"))
    done = tokens.tag_sequences(rows, tags, "key", default="other")
    return done.select("key", shape.join_tags(F.col("tags")).alias("joined"))


@query
def translate_lists(spark, sf):
    pairs = _mapping(spark, sf).select(
        F.lit("xx").alias("lang"), F.col("abbreviation").alias("source"), F.col("replacement").alias("target")
    )
    return ds.translate_lists(inputs.word_lists(spark, sf), pairs)


# ---------------------------------------------------------------- overlap


def _corpus_tokens(spark, sf):
    return tokens.flat_tokens(inputs.labelled_segments(spark, sf), "input", "input", "label")


def _list_tokens(spark, sf):
    return tokens.flat_tokens(inputs.page_lists(spark, sf), "term", "list", "lang")


def _overlap(spark, sf, by, distinct):
    marked = overlap.mark_found(_list_tokens(spark, sf), _corpus_tokens(spark, sf))
    return overlap.overlap(marked, by, distinct)


@query
def overlap_by_language(spark, sf):
    return _overlap(spark, sf, "lang", True)


@query
def overlap_by_list(spark, sf):
    return _overlap(spark, sf, "list", False)


@query
def overlap_by_list_distinct(spark, sf):
    return _overlap(spark, sf, "list", True)


@query
def string_flags(spark, sf):
    return overlap.string_flags(overlap.flag_corpus(_corpus_tokens(spark, sf), _list_tokens(spark, sf)))


@query
def string_categories(spark, sf):
    return overlap.category_share(string_flags(spark, sf))


@query
def label_sets(spark, sf):
    return overlap.label_set_counts(string_flags(spark, sf))


@query
def unmatched_tokens(spark, sf):
    flagged = overlap.flag_corpus(_corpus_tokens(spark, sf), _list_tokens(spark, sf))
    return overlap.unmatched_tokens(flagged)


@query
def novel_tokens(spark, sf):
    return overlap.novel_tokens(_list_tokens(spark, sf))


# ---------------------------------------------------------------- acronym tables


def _acronym_source(spark, sf):
    """Strings with capitals: order priorities and clerk-like codes beside the segments."""
    customers = table(spark, sf, "customer").select(
        F.concat_ws(" ", "c_mktsegment", F.lit("Desk")).alias("input"), F.col("c_nationkey").cast("bigint").alias("id")
    )
    return inputs.segments(spark, sf).select("input", F.col("doc_id").alias("id")).unionByName(customers)


@query
def ambiguous_acronyms(spark, sf):
    return ac.ambiguous_acronyms(_acronym_source(spark, sf))


@query
def ambiguous_acronym_ids(spark, sf):
    return ac.ambiguous_acronym_ids(_acronym_source(spark, sf))


@query
def acronym_whitelist(spark, sf):
    talk = inputs.pieces(table(spark, sf, "conversations"), "text").select("input")
    return ac.acronym_whitelist(_acronym_source(spark, sf).select("input"), talk)


# ---------------------------------------------------------------- markup


@query
def extract_tagged(spark, sf):
    return markup.extract_tagged(table(spark, sf, "pages"), ["page_id"], "html", ("a", "h1", "p"))


@query
def extract_tagged_dom(spark, sf):
    return markup.extract_tagged_dom(table(spark, sf, "pages"), ["page_id"], "html", ("p", "a", "h1"))


def _link_labels(spark, sf):
    found = markup.extract_tagged(table(spark, sf, "pages"), ["page_id"], "html", LINK_TAGS)
    return found.withColumn("prediction", F.when(F.length("text") % 2 == 0, "GEN").otherwise("SPE"))


@query
def annotate_tagged(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    done = markup.annotate_tagged(pages, _link_labels(spark, sf), ["page_id"], "html", tags=LINK_TAGS)
    return done.select(
        "page_id",
        F.md5("annotated").alias("annotated"),
        (markup.strip_annotations(F.col("annotated")) == F.col("html")).alias("round_trip"),
    )


@query
def annotate_existing_attr(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.col("html"))
        .otherwise(F.replace("html", F.lit("<a "), F.lit('<a type="" ')))
        .alias("html"),
    )
    done = markup.annotate_existing_attr(pages, _link_labels(spark, sf), ["page_id"], "html", tags=LINK_TAGS)
    return done.select("page_id", F.md5("annotated").alias("annotated"), "missing_attr")


@query
def annotate_job(spark, sf):
    """Whole pages as records: labels by the rules in all three ways, and rejected cells with reasons."""
    cells = checkpointed(readers.markup_cells(readers.split_tagged(files.record_lines(spark, sf))))
    lex = inputs.lexicon(spark, sf)
    given = cells.withColumn(
        "xml",
        F.when(F.col("line_no") % 3 == 0, F.col("xml")).otherwise(
            F.replace(F.replace("xml", F.lit("<a "), F.lit('<a type="" ')), F.lit("<a>"), F.lit('<a type="">'))
        ),
    )
    runs = [
        ("lexical", cells, {}), ("dom", cells, {"mode": "dom"}), ("existing", given, {"mode": "existing"}),
        ("checked", cells, {"container": "li"}),
    ]
    out = None
    for name, rows, options in runs:
        done = annotate.annotate_cells(rows, lex, tags=LINK_TAGS, **options).select(
            F.lit(name).alias("mode"), "line_no", "col", F.md5("annotated").alias("annotated"), "reject_reason"
        )
        out = done if out is None else out.unionByName(done)
    return out


@query
def filled_labels(spark, sf):
    """A label for every position; empty elements keep theirs with an empty label."""
    found = markup.extract_tagged(table(spark, sf, "pages"), ["page_id"], "html", ("p", "b"))
    cut = found.withColumn("text", F.when(F.col("ordinal") % 4 == 1, "").otherwise(F.substring("text", 1, 30)))
    labelled = rules.classify(cut.where("text <> ''").withColumnRenamed("text", "input"), inputs.lexicon(spark, sf))
    return cut.join(labelled.select("page_id", "ordinal", "prediction"), ["page_id", "ordinal"], "left").select(
        "page_id", "ordinal", F.coalesce("prediction", F.lit("")).alias("prediction")
    )


@query
def annotate_dom(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    done = markup.annotate_dom(pages, _link_labels(spark, sf), ["page_id"], "html", tags=LINK_TAGS)
    return done.select("page_id", F.md5("annotated").alias("annotated"))


@query
def validate_tagged(spark, sf):
    rows = inputs.fragments(spark, sf)
    return markup.validate_tagged(rows, "xml", "li", LINK_TAGS).drop("xml")


@query
def reject_counts(spark, sf):
    good, bad = markup.split_valid(markup.validate_tagged(inputs.fragments(spark, sf), "xml", "li", LINK_TAGS))
    ok = good.select(F.lit("valid").alias("reason"))
    return ok.unionByName(bad.select(F.col("reject_reason").alias("reason"))).groupBy("reason").agg(
        F.count("*").alias("n")
    )


@query
def element_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.element_text(F.col("html"), "title").alias("title"))


@query
def compare_extractions(spark, sf):
    pages = table(spark, sf, "pages")
    lexical = markup.extract_tagged(pages, ["page_id"], "html", ("p",))
    dom = markup.extract_tagged_dom(pages, ["page_id"], "html", ("p",))
    both = markup.compare_extractions(lexical, dom, ["page_id"])
    return both.groupBy("page_id", "compare").agg(F.count("*").alias("n"))


@query
def enumerate_elements(spark, sf):
    return markup.enumerate_elements(table(spark, sf, "pages"), ["page_id"], "html", "ul", LINK_TAGS)


# ---------------------------------------------------------------- data sets


def _nested(spark, sf):
    """Every document as a parent with its pieces as child variants."""
    docs = table(spark, sf, "documents")
    child = F.transform(F.split("text", inputs.PIECE), lambda p: F.struct(p.alias("variant.name")))
    with_children = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", "lang", "source").alias("name"),
        child.alias("_childDocuments_"),
    )
    # Nations are parents without children.
    without = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
        F.lit(None).cast(with_children.schema["_childDocuments_"].dataType).alias("_childDocuments_"),
    )
    each = with_children.unionByName(without)
    return each.select(
        F.struct(F.array(F.struct("id", "name", "_childDocuments_")).alias("docs")).alias("response")
    )


@query
def nested_docs(spark, sf):
    rows = ds.nested_docs(_nested(spark, sf))
    return rows.groupBy("input", "id", "name_type").agg(F.count("*").alias("n"))


@query
def variant_docs(spark, sf):
    rows = inputs.segments(spark, sf).select(
        F.struct(
            F.array(
                F.struct(F.concat_ws("-", "doc_id", "pos").alias("id"), F.col("input").alias("variant.name"))
            ).alias("docs")
        ).alias("response")
    )
    return ds.variant_docs(rows).groupBy("id").agg(
        F.count("*").alias("n"), F.max("input").alias("last_input")
    )


@query
def union_sources(spark, sf):
    named = ds.with_label(
        table(spark, sf, "supplier").select(
            F.col("s_name").alias("input"), F.lit(None).cast("double").alias("numdocs")
        ),
        "SPE",
    )
    parts = ds.with_label(
        table(spark, sf, "part").select(F.col("p_name").alias("input"), F.col("p_partkey").alias("id")), "GEN"
    )
    return ds.union_sources(named, parts).groupBy("input", "label", "numdocs").agg(
        F.count("*").alias("n"), F.max("id").alias("last_id")
    )


@query
def attach_counts(spark, sf):
    counts = inputs.segments(spark, sf).groupBy("input").agg(F.count("*").alias("numdocs"))
    talk = inputs.pieces(table(spark, sf, "conversations"), "text").select("input").distinct()
    return ds.attach_counts(talk, counts)


@query
def top_weighted(spark, sf):
    return ds.top_weighted(table(spark, sf, "documents").select("doc_id", "n_chars"), 150, "n_chars", "doc_id")


@query
def single_word_top(spark, sf):
    rows = inputs.segments(spark, sf).groupBy("input").agg(F.count("*").alias("numdocs"))
    return ds.single_word_top(rows)


@query
def slice_sorted(spark, sf):
    rows = inputs.labels(spark, sf).where("label <> prediction").select("doc_id", "label")
    return ds.slice_sorted(rows, 5, 15, "doc_id")


@query
def shuffled_sample(spark, sf):
    return ds.shuffled_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 60, 1323)


@query
def stratified_split(spark, sf):
    return ds.stratified_split(inputs.labels(spark, sf).select("doc_id", "label"), "doc_id", fraction=0.5, seed=7)


@query
def resample(spark, sf):
    """Four samples with replacement, each written as one file and read again."""
    drawn = ds.resample(table(spark, sf, "documents").select("doc_id"), "doc_id", 4, 250, seed=3)
    path = files.scratch(spark, "resample")
    writers.write_numbered_files(drawn, path, 4, value="doc_id")
    number = F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).cast("int")
    lines = spark.read.text(path).select(number.alias("file_no"), F.col("value").cast("long").alias("doc_id"))
    return lines.groupBy("file_no", "doc_id").agg(F.count("*").alias("n"))
