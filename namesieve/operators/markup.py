"""Tagged markup in table cells: extraction, validation and write-back of labels.

Records are rows ``(key columns, xml)``.  Elements get an ``ordinal`` in document order, so
labels find their element by key and never by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.functions.text import protect_ampersand, sql_string


def _names(tags: tuple[str, ...]) -> str:
    return "|".join(tags)


def open_tag(tags: tuple[str, ...]) -> str:
    """Opening tags that are not self-closing."""
    return rf"<(?:{_names(tags)})(?:\s[^>]*[^/>]|\s)?>"


def element(tags: tuple[str, ...]) -> str:
    """Opening tag, its name (1) and the raw text (2) up to the closing tag."""
    return rf"(?s)<({_names(tags)})(?:\s[^>]*[^/>]|\s)?>(.*?)</(?:{_names(tags)})[\s>]"


def extract_tagged(
    df: DataFrame, keys: list[str], xml: str = "xml", tags: tuple[str, ...] = fixed.ORG_TAGS
) -> DataFrame:
    """``keys, ordinal, tag, text`` of every element in document order, text raw."""
    pattern = F.lit(element(tags))
    found = F.arrays_zip(
        F.regexp_extract_all(F.col(xml), pattern, F.lit(1)).alias("tag"),
        F.regexp_extract_all(F.col(xml), pattern, F.lit(2)).alias("text"),
    )
    return df.select(*keys, F.posexplode(found).alias("ordinal", "e")).select(
        *keys,
        "ordinal",
        F.col("e").getField("tag").alias("tag"),
        F.col("e").getField("text").alias("text"),
    )


BAD_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"


def extract_tagged_dom(
    df: DataFrame,
    keys: list[str],
    xml: str = "xml",
    tags: tuple[str, ...] = ("organization", "org", "multi-org"),
) -> DataFrame:
    """Elements grouped by tag in the order of ``tags``; text before the first child, decoded.

    ``dom_ordinal`` counts in that order, ``ordinal`` in document order.  A text with a stray
    ``&`` is not well formed: it comes back as null with ``malformed`` set.
    """
    ranks = ", ".join(f"'{tag}', {i}" for i, tag in enumerate(tags))
    pattern = sql_string(element(tags))
    elements = F.expr(
        f"""array_sort(transform(
              zip_with(regexp_extract_all({xml}, {pattern}, 1),
                       regexp_extract_all({xml}, {pattern}, 2),
                       (g, x) -> named_struct('tag', g, 'text', x)),
              (e, i) -> named_struct('rank', element_at(map({ranks}), e.tag), 'ordinal', i,
                'tag', e.tag, 'lead', regexp_extract(e.text, '(?s)^[^<]*', 0))))"""
    )
    rows = df.select(*keys, F.posexplode(elements).alias("dom_ordinal", "e")).select(
        *keys, "dom_ordinal", "e.ordinal", "e.tag", "e.lead"
    )
    malformed = F.col("lead").rlike(BAD_ENTITY)
    decoded = F.expr("xpath_string(concat('<r>', lead, '</r>'), '/r')")
    text = F.when(malformed, F.lit(None).cast("string")).when(
        F.contains("lead", F.lit("&")), decoded
    ).otherwise(F.col("lead"))
    return rows.select(
        *keys, "dom_ordinal", "ordinal", "tag", text.alias("text"), malformed.alias("malformed")
    )


def _labels_per_record(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    attribute = F.create_map(*[F.lit(x) for kv in fixed.ATTRIBUTE_OF_LABEL.items() for x in kv])
    marks = F.coalesce(attribute[F.col(label)], F.lit(""))
    return (
        labels.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", marks.alias("m")))).alias("o"))
        .select(*keys, F.col("o.m").alias("marks"))
    )


def _rewrite(xml: str, tags: tuple[str, ...], new_tag: str) -> Column:
    """Rebuild ``xml`` with the opening tag ``t`` of each element number ``i`` replaced by ``new_tag``.

    Elements are found as :func:`extract_tagged` finds them, so numbers mean the same; opening tags
    inside an element or without a closing tag stay as they are.
    """
    pattern = sql_string(element(tags))
    opening = sql_string("(?s)^" + open_tag(tags))
    found = f"transform(regexp_extract_all({xml}, {pattern}, 0), e -> named_struct('e', e, 't', regexp_extract(e, {opening}, 0)))"
    between = f"split({xml}, {pattern})"
    return F.expr(
        f"""element_at(transform(array(named_struct('o', {found}, 's', {between})),
              x -> concat(
                array_join(transform(transform(x.o, o -> o.t),
                  (t, i) -> concat(get(x.s, i), {new_tag}, substring(get(x.o, i).e, length(t) + 1))), ''),
                element_at(x.s, -1))), 1)"""
    )


def annotate_tagged(
    df: DataFrame,
    labels: DataFrame,
    keys: list[str],
    xml: str = "xml",
    label: str = "prediction",
    tags: tuple[str, ...] = fixed.ORG_TAGS,
) -> DataFrame:
    """Add ``type="g"`` or ``type=""`` to the opening tag of every element, by ordinal."""
    marks = _labels_per_record(labels, keys, label)
    tag = "concat(substring(t, 1, length(t) - 1), ' type=\"', coalesce(get(marks, i), ''), '\">')"
    return (
        df.join(marks, keys, "left").withColumn("annotated", _rewrite(xml, tags, tag)).drop("marks")
    )


def annotate_existing_attr(
    df: DataFrame,
    labels: DataFrame,
    keys: list[str],
    xml: str = "xml",
    label: str = "prediction",
    tags: tuple[str, ...] = fixed.ORG_TAGS,
) -> DataFrame:
    """Fill an empty ``type=""`` for generic elements; ``missing_attr``: an element has none to fill."""
    marks = _labels_per_record(labels, keys, label)
    tag = "IF(get(marks, i) = 'g', replace(t, 'type=\"\"', 'type=\"g\"'), t)"
    opening = "(?s)^" + open_tag(tags)
    found = F.regexp_extract_all(F.col(xml), F.lit(element(tags)), F.lit(0))
    opens = F.transform(found, lambda e: F.regexp_extract(e, opening, 0))
    return (
        df.join(marks, keys, "left")
        .withColumn("annotated", _rewrite(xml, tags, tag))
        .withColumn("missing_attr", F.exists(opens, lambda t: ~F.contains(t, F.lit('type=""'))))
        .drop("marks")
    )


def annotate_dom(
    df: DataFrame,
    labels: DataFrame,
    keys: list[str],
    xml: str = "xml",
    label: str = "prediction",
    tags: tuple[str, ...] = fixed.ORG_TAGS,
) -> DataFrame:
    """Set ``type`` on elements that have text; other elements stay untouched.

    ``labels`` carries ``ordinal, text`` and the label.  An existing attribute is replaced.
    """
    with_text = labels.where("text IS NOT NULL AND text <> ''")
    attribute = F.when(F.col(label) == fixed.GEN, F.lit("g")).otherwise(F.lit(""))
    marks = (
        with_text.groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("ordinal", attribute))).alias("marks"))
    )
    bare = "regexp_replace(t, ' type=\"[^\"]*\"', '')"
    tag = (
        f"IF(marks[i] IS NULL, t, concat(substring({bare}, 1, length({bare}) - 1),"
        " ' type=\"', marks[i], '\">'))"
    )
    return (
        df.join(marks, keys, "left").withColumn("annotated", _rewrite(xml, tags, tag)).drop("marks")
    )


def strip_annotations(annotated: Column) -> Column:
    """Annotated text without the attribute; equals the input of :func:`annotate_tagged`."""
    return F.regexp_replace(annotated, ' type="g?"', "")


REASONS = ("unbalanced", "top_level", "nested", "deep_element", "sub_element")


def validate_tagged(
    df: DataFrame,
    xml: str = "xml",
    container: str = "affiliation",
    tags: tuple[str, ...] = fixed.ORG_TAGS,
) -> DataFrame:
    """Structural checks as flag columns, the first failing one as ``reject_reason``.

    Only ``container`` elements at top level and none inside another; the listed tags
    directly below a container and without children of their own.
    """
    pattern = r"<(/?[A-Za-z][^\s/>]*(?:\s[^>]*?)?/?)>"
    listed = ", ".join(sql_string(t) for t in tags)
    name = "regexp_extract(t, '^/?([^\\\\s/>]+)', 1)"
    state = (
        "named_struct('open', cast(array() AS array<string>), 'unbalanced', false,"
        " 'top_level', false, 'nested', false, 'deep_element', false, 'sub_element', false)"
    )
    opened = f"""named_struct(
        'open', IF(endswith(t, '/'), s.open, concat(s.open, array({name}))),
        'unbalanced', s.unbalanced,
        'top_level', s.top_level OR (size(s.open) = 0 AND {name} <> '{container}'),
        'nested', s.nested OR (size(s.open) > 0 AND {name} = '{container}'),
        'deep_element', s.deep_element OR ({name} IN ({listed})
            AND NOT (size(s.open) = 1 AND get(s.open, 0) = '{container}')),
        'sub_element', s.sub_element OR (size(s.open) > 0 AND element_at(s.open, -1) IN ({listed})))"""
    closed = f"""named_struct(
        'open', IF(size(s.open) > 0, slice(s.open, 1, size(s.open) - 1), s.open),
        'unbalanced', s.unbalanced OR size(s.open) = 0
            OR coalesce(try_element_at(s.open, -1), '') <> {name},
        'top_level', s.top_level, 'nested', s.nested,
        'deep_element', s.deep_element, 'sub_element', s.sub_element)"""
    walk = F.expr(
        f"""aggregate(regexp_extract_all({xml}, {sql_string(pattern)}, 1), {state},
              (s, t) -> IF(startswith(t, '/'), {closed}, {opened}))"""
    )
    out = df.withColumn("walk", walk).select(
        *df.columns,
        (F.col("walk.unbalanced") | (F.size("walk.open") > 0)).alias("unbalanced"),
        *[F.col(f"walk.{r}").alias(r) for r in REASONS[1:]],
    )
    reason = F.coalesce(*[F.when(F.col(r), F.lit(r)) for r in REASONS])
    return out.withColumn("reject_reason", reason)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and rejected records."""
    good = validated.where("reject_reason IS NULL").drop(*REASONS, "reject_reason")
    return good, validated.where("reject_reason IS NOT NULL")


def element_text(xml: Column, tag: str | None = None) -> Column:
    """Text of the (first) element before its first child."""
    name = tag or r"[A-Za-z][^\s/>]*"
    return F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>([^<]*)", 1)


def compare_extractions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Position-wise comparison of two extractions."""
    on = [*keys, "ordinal"]
    left = a.select(*on, F.col("text").alias("text_a"))
    right = b.select(*on, F.col("text").alias("text_b"))
    return left.join(right, on, "full_outer").withColumn(
        "compare", F.coalesce(F.col("text_a") == F.col("text_b"), F.lit(False))
    )


def enumerate_elements(
    df: DataFrame,
    keys: list[str],
    xml: str = "xml",
    container: str = "affiliation",
    tags: tuple[str, ...] = fixed.ORG_TAGS,
) -> DataFrame:
    """Sequence numbers of elements inside their container and over the record."""
    pattern = rf"(?s)<{container}(?:\s[^>]*)?>(.*?)</{container}>"
    parts = F.regexp_extract_all(F.col(xml), F.lit(pattern), F.lit(1))
    items = F.regexp_extract_all(F.col("part"), F.lit(element(tags)), F.lit(2))
    # numbering before the explode: offsets are sums of the earlier containers' sizes
    sized = df.select(
        *keys,
        F.transform(
            parts, lambda p: F.size(F.regexp_extract_all(p, F.lit(element(tags)), F.lit(2)))
        ).alias("sizes"),
        parts.alias("parts"),
    ).select(*keys, "sizes", F.posexplode("parts").alias("container_no", "part"))
    offset = F.aggregate(
        F.slice("sizes", F.lit(1), F.col("container_no")), F.lit(0), lambda a, x: a + x
    )
    return sized.select(
        *keys, "container_no", offset.alias("offset"), F.posexplode(items).alias("seq", "name")
    ).select(*keys, "container_no", "seq", (F.col("offset") + F.col("seq")).alias("global_seq"), "name")


__all__ = [
    "annotate_dom",
    "annotate_existing_attr",
    "annotate_tagged",
    "compare_extractions",
    "element_text",
    "enumerate_elements",
    "extract_tagged",
    "extract_tagged_dom",
    "protect_ampersand",
    "split_valid",
    "strip_annotations",
    "validate_tagged",
]
