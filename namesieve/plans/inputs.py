"""Engine inputs derived from the shared tables: strings, labels, word lists, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.operators.lexicon import Lexicon, normalise_terms
from namesieve.session import spread

# Sentences and lines of a text; every piece of every text is used.
PIECE = r"[.!?]+[ \n]+|\n+"

STOP_WORDS = (
    "the", "is", "it", "on", "with", "by", "that", "this", "to", "was",
    "la", "le", "les", "un", "une", "der", "die", "el", "los",
)

# Word lists from the words of `benchmark`: (list, condition on the word w and the next
# word x, term).  The conditions are plain SQL.
LIST_RULES = (
    ("type", "w LIKE '%tion'", "w"),
    ("subject", "w LIKE '%ed'", "w"),
    ("subject", "w LIKE 'th%' AND x LIKE '%er'", "concat(w, ' ', x)"),
    ("subject_modifier", "w LIKE '%er'", "w"),
    ("org_modifier", "w LIKE 'an%' AND length(w) >= 4", "w"),
    ("common_subject", "w LIKE '%st'", "w"),
    ("university", "w LIKE '%ing'", "w"),
    ("company_type", "w LIKE 'st%'", "w"),
    ("location", "w LIKE 'wh%' AND length(w) >= 6", "w"),
    ("location", "w = 'of' AND x LIKE 'a%'", "concat(w, ' ', x)"),
    ("company_name", "w LIKE 'ha%' AND length(w) >= 6", "w"),
    ("company_suffix", "w LIKE '%es' AND length(w) >= 5", "w"),
    ("word_ending", "length(w) >= 9", "substring(w, length(w) - 3, 4)"),
    ("allow", "w LIKE '%nd' AND length(w) >= 7", "w"),
    ("deny", "w LIKE '%at' AND length(w) >= 7", "w"),
    ("acronym_allow", "length(w) = 4", "upper(w)"),
    ("expanded_subject", "length(w) >= 5 AND length(x) >= 5", "concat(w, ' ', x)"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``documents``; its texts are parsed at length, so small scans are spread."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def pieces(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.split(text, PIECE)).alias("pos", "input"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, numdocs, pos, input``: all pieces of all documents."""
    docs = documents(spark, sf_dir, "lang", "n_chars", "text").withColumnRenamed("n_chars", "numdocs")
    return pieces(docs, "text", "doc_id", "lang", "numdocs")


def probe_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``input``: distinct pieces and words of ``benchmark``."""
    strings = pieces(table(spark, sf_dir, "benchmark"), "text").select("input").distinct()
    words = strings.select(F.explode(F.split(F.lower("input"), "[^a-z]+")).alias("input"))
    return strings.unionByName(words).where("input <> ''").distinct()


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label, prediction``: two labellings of the same documents."""
    rows = table(spark, sf_dir, "labels")
    return rows.select(
        "doc_id",
        F.when(F.col("quality") == 1, "GEN").otherwise("SPE").alias("label"),
        F.when(F.col("toxic") == 0, "GEN").otherwise("SPE").alias("prediction"),
    )


def labelled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the labelled documents with both labellings."""
    return segments(spark, sf_dir).join(labels(spark, sf_dir), "doc_id")


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``list, lang, term`` from the benchmark words, normalised and distinct."""
    words = F.expr("filter(split(lower(text), '[^a-z]+'), t -> t <> '')")
    pairs = table(spark, sf_dir, "benchmark").select(words.alias("ws")).selectExpr(
        "inline(transform(ws, (w, i) -> named_struct('w', w, 'x', coalesce(get(ws, i + 1), ''))))"
    )
    entries = ", ".join(
        f"IF({cond}, named_struct('list', '{name}', 'lang', 'en', 'term', {term}), NULL)"
        for name, cond, term in LIST_RULES
    )
    derived = pairs.selectExpr(f"inline(filter(array({entries}), e -> e IS NOT NULL))").distinct()
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    closed = spark.range(1).selectExpr(
        "'stop_word' AS list", "'en' AS lang", f"explode(array({stops})) AS term"
    )
    return normalise_terms(derived.unionByName(closed))


def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    return Lexicon.compile(word_lists(spark, sf_dir).select("list", "term"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multilingual lists: words of page titles, one list per page language."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("term"),
    )
    return pages.select(F.concat(F.lit("titles."), "lang").alias("list"), "lang", "term")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, part, xml``: the lists and articles of every page as markup records."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.posexplode(
            F.regexp_extract_all(
                "html", F.lit("(?s)<(?:ul|article)>(.*?)</(?:ul|article)>"), F.lit(1)
            )
        ).alias("part", "xml"),
    )
