"""The ordered rule cascade as nullable columns, one per slot, over distinct strings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.functions.shape import extract_acronyms, has_acronym_v1, is_title
from namesieve.functions.text import member_of, sql_string, words
from namesieve.operators import spans as sp
from namesieve.operators.lexicon import BIT, Lexicon, hit_list, mask_of
from namesieve.operators.normalize import preprocess
from namesieve.operators.subjects import span_is, subject_answers

SLOTS = tuple(range(26))
ORDER_V2: tuple[int | str, ...] = ("allow", "deny", *SLOTS)
ORDER_V1: tuple[int | str, ...] = (
    1, 2, 4, 5, 6, 7, 8, "allow", "deny", 10, 24, 11, *range(12, 24), 25,
)


@dataclass(frozen=True)
class CustomRule:
    """A rule of the caller, evaluated with the others: its probes join the one term join.

    ``lists`` are the word lists it needs.  ``look_at`` says what is looked up in them: the n-grams of
    ``norm`` or ``content``, or the ``whole`` content.  ``condition`` gets a function from list name to
    "was something found in it"; other columns of the plan (``org, norm, norm_no_sw``) may be used as well.
    The rule is asked just before the slot ``before``.
    """

    name: str
    label: str
    lists: tuple[str, ...]
    condition: Callable[[Callable[[str], Column]], Column]
    look_at: str = "norm"
    before: int | str = 25

    @property
    def column(self) -> str:
        return f"rule_{self.name}"

    def probe(self, slot: int, lexicon: Lexicon) -> Column:
        longest = lexicon.max_words(*self.lists)
        if self.look_at == "whole":
            return sp.exact_probe(slot, F.col("norm_no_sw"))
        tokens = {"norm": "norm_tokens", "content": "tokens"}[self.look_at]
        return sp.gram_probes(slot, tokens, longest, lexicon.first_words)

    def spans(self, lexicon: Lexicon) -> str:
        """SQL text of what :meth:`probe` finds, for a lexicon of few terms."""
        mask = sum(lexicon.bits[name] for name in set(self.lists))
        tokens = {"norm": "norm_tokens", "content": "tokens"}[self.look_at]
        return sp.literal_spans(tokens, lexicon, mask, lexicon.max_words(*self.lists))

    def value(self, lexicon: Lexicon) -> Column:
        def found(name: str) -> Column:
            return F.col(f"m_{self.column}").bitwiseAND(F.lit(lexicon.bits[name])) != 0

        return F.when(self.condition(found), F.lit(self.label))


@dataclass(frozen=True)
class Profile:
    """Which rules run, in which order, and in which variant."""

    name: str
    generation: int = 2
    order: tuple[int | str, ...] = ORDER_V2
    disabled: frozenset[int] = frozenset()
    fuzzy_subjects: bool = False
    of_words: tuple[str, ...] = fixed.OF_WORDS
    and_words: tuple[str, ...] = fixed.AND_WORDS
    custom: tuple[CustomRule, ...] = ()

    def register(self, *rules: CustomRule) -> "Profile":
        """This profile with further rules, asked in the given order at equal places."""
        taken = {*RULE_COLUMNS, "rule_first", *(r.column for r in self.custom)}
        for rule in rules:
            if rule.column in taken or rule.before not in self.order:
                raise ValueError(f"rule {rule.name}: its name is taken or its place unknown")
            taken.add(rule.column)
        return replace(self, custom=(*self.custom, *rules))

    def sequence(self) -> list[int | str]:
        """Lists, slots that run and columns of registered rules, in the order they are asked."""
        out: list[int | str] = []
        for item in self.order:
            out += [r.column for r in self.custom if r.before == item]
            if isinstance(item, str) or self.runs(item):
                out.append(item)
        return out

    @property
    def subject_mask(self) -> int:
        return mask_of("subject", "fuzzy_subject") if self.fuzzy_subjects else BIT["subject"]

    def runs(self, slot: int) -> bool:
        return slot in self.order and slot not in self.disabled


def profile(
    name: str = "multilingual",
    acronyms: bool = True,
    zipcodes: bool = True,
    fuzzy_subjects: bool = False,
) -> Profile:
    """Second-generation profile with its three switches."""
    off = set() if acronyms else {24}
    if not zipcodes:
        off.add(9)
    return Profile(name, disabled=frozenset(off), fuzzy_subjects=fuzzy_subjects)


def profile_v1(name: str = "original", fuzzy_subjects: bool = True) -> Profile:
    """First-generation order and variants; English connectors, fuzzy subjects on."""
    return Profile(
        name,
        generation=1,
        order=ORDER_V1,
        fuzzy_subjects=fuzzy_subjects,
        of_words=fixed.OF_WORDS_V1,
        and_words=fixed.AND_WORDS_V1,
    )


def column_of(slot: int) -> str:
    return f"rule_{slot:02d}"


RULE_COLUMNS = tuple(column_of(s) for s in SLOTS)


def _levels(df: DataFrame, lexicon: Lexicon, prof: Profile) -> DataFrame:
    """One row per string and per tail left after leading organisation modifiers.

    A tail is a string of its own: it loses enumerators and stop words again.  The tails
    of a row are built inside one expression, so any number of modifiers is followed
    without a loop over jobs.
    """
    base = preprocess(df, lexicon.stop_words, "input", prof.generation)
    own = F.struct(F.col("input").alias("org"), "base", "norm", "norm_no_sw")
    shape = "struct<org:string,base:string,norm:string,norm_no_sw:string>"

    def leads(text: str) -> str:
        first = f"substring_index({text}, ' ', 1)"
        return f"(instr({text}, ' ') > 0 AND {member_of(first, lexicon.org_modifiers)})"

    # acc: the current stripped string and the tails found so far
    tail = "substring(acc.cur, instr(acc.cur, ' ') + 1)"
    stripped = _sql_strip(tail)
    content = _sql_drop("s.norm", lexicon.stop_words)
    chain = F.expr(
        f"""
        IF({leads('norm_no_sw')},
           aggregate(
             sequence(1, size(split(norm_no_sw, ' ')) - 1),
             named_struct('cur', norm_no_sw, 'tails', cast(array() AS array<{shape}>)),
             (acc, i) -> IF({leads('acc.cur')},
               element_at(transform(
                 array(named_struct('org', {tail}, 'norm', {stripped})),
                 s -> named_struct(
                   'cur', {content},
                   'tails', concat(acc.tails, array(named_struct(
                      'org', s.org, 'base', s.org, 'norm', s.norm, 'norm_no_sw', {content}))))), 1),
               acc),
             acc -> acc.tails),
           cast(array() AS array<{shape}>))
        """
    )
    return (
        base.withColumn("tails", chain)
        .select(
            "input",
            F.col("norm").alias("own_norm"),
            F.col("norm_no_sw").alias("own_no_sw"),
            F.posexplode(F.concat(F.array(own), F.col("tails"))).alias("depth", "level"),
        )
        .select("input", "own_norm", "own_no_sw", "depth", "level.*")
    )


def _sql_strip(text: str) -> str:
    """SQL text of the enumerator removal, for use inside lambda bodies."""
    for pattern in (
        fixed.BULLET,
        fixed.LEADING_AND,
        fixed.LEADING_THE,
        fixed.LEADING_ORDINAL,
        fixed.TRAILING_NUMBER,
        fixed.LEADING_AFFILIATED,
    ):
        text = f"regexp_replace({text}, {sql_string(pattern)}, '')"
    return text


def _sql_drop(text: str, stop_words: tuple[str, ...]) -> str:
    if not stop_words:
        return text
    return f"array_join(filter(split({text}, ' '), w -> NOT {member_of('w', stop_words)}), ' ')"


def _positions(tokens: str, members: tuple[str, ...]) -> Column:
    found = f"transform({tokens}, (w, i) -> IF({member_of('w', members)}, i, -1))"
    return F.expr(f"filter({found}, i -> i >= 0)")


NORM_LISTS = ("location", "company_name", "university", "company_type")
CONTENT_LISTS = ("type", "subject", "university", "common_subject", "org_modifier", "fuzzy_subject")
# Without connectors only terms that end at one of the last two words are looked at.
NEAR_THE_END = "linked OR i + k >= n - 1"


def _exact_terms(prof: Profile) -> dict[int, Column]:
    """What is looked up as a whole, by slot; null if there is nothing to look up."""
    v1 = prof.generation == 1
    org = F.col("org")
    suffix_of = F.col("norm") if v1 else org
    studies = _studies_pattern(prof)
    matches = org.rlike(studies)
    subject = F.lower(F.regexp_extract(org, studies, 1 if v1 else 2))
    one_word = F.size(words(org)) == 1
    terms = {
        sp.WHOLE: F.col("norm_no_sw"),
        sp.SUFFIX: F.when(
            suffix_of.rlike(fixed.WORD_AND_REST), F.regexp_extract(suffix_of, fixed.WORD_AND_REST, 1)
        ),
        sp.BASE: F.when(one_word, F.col("base")),
        sp.RAW_SUBJECT: F.when(matches, subject),
    }
    if not v1:
        terms |= {
            sp.EXPANDED: F.lower("base"),
            sp.RAW_TYPE: F.when(matches, F.regexp_extract(org, studies, 1)),
            sp.RAW: F.when(one_word, org),
            sp.ACRONYM: F.when(F.col("acronym") != "", F.col("acronym")),
        }
    return terms


def _probe_all(levels: DataFrame, lexicon: Lexicon, prof: Profile) -> Column:
    """Everything the active rules will look up, as one array per row."""
    norm = F.col("norm")
    longest = lexicon.max_words(*CONTENT_LISTS)
    first = lexicon.first_words
    parts = [
        sp.gram_probes(sp.NORM, "norm_tokens", lexicon.max_words(*NORM_LISTS), first),
        sp.gram_probes(sp.CONTENT, "tokens", longest, first, NEAR_THE_END),
        sp.ending_probes(F.col("tokens"), lexicon.longest_chars["word_ending"]),
        F.when(
            F.col("and_variant"),
            sp.gram_probes(sp.CONTENT_AND, "and_tokens", longest, first),
        ).otherwise(sp.no_probes()),
    ]
    parts += [sp.exact_probe(slot, term) for slot, term in _exact_terms(prof).items()]
    if prof.generation == 1:
        # an empty string counts as its own n-gram here
        parts.append(sp.exact_probe(sp.NORM, F.when(norm == "", norm)))
    parts += [rule.probe(sp.CUSTOM + i, lexicon) for i, rule in enumerate(prof.custom)]
    return F.concat(*parts)


def _studies_pattern(prof: Profile) -> str:
    if prof.generation == 1:
        return fixed.STUDIES_IN_V1
    return fixed.STUDIES_IN.format(of="|".join(prof.of_words), into="|".join(fixed.IN_WORDS))


MASKS = {
    "m_norm": sp.NORM,
    "m_whole": sp.WHOLE,
    "m_expanded": sp.EXPANDED,
    "m_raw_type": sp.RAW_TYPE,
    "m_raw_subject": sp.RAW_SUBJECT,
    "m_suffix": sp.SUFFIX,
    "m_raw": sp.RAW,
    "m_base": sp.BASE,
    "m_acronym": sp.ACRONYM,
}


def _joined_hits(levels: DataFrame, lexicon: Lexicon, prof: Profile, carried: list[str]) -> DataFrame:
    """Masks by slot, spans and registered rules, from one join with a row for each probe."""
    found = sp.find_spans(levels, lexicon, ["input", "depth"], carried, _probe_all(levels, lexicon, prof))
    return found.select(
        "input",
        "depth",
        *carried,
        *[sp.mask_at(slot).alias(name) for name, slot in MASKS.items()],
        F.expr(f"filter(hits, h -> h.slot = {sp.CONTENT})").alias("spans"),
        F.expr(f"filter(hits, h -> h.slot IN ({sp.CONTENT}, {sp.CONTENT_AND}))").alias("spans_and"),
        F.expr(
            f"transform(filter(hits, h -> h.slot = {sp.ENDING}"
            f" AND (h.mask & {BIT['word_ending']}L) <> 0L), h -> h.start)"
        ).alias("ending_pos"),
        *[sp.mask_at(sp.CUSTOM + i).alias(f"m_{rule.column}") for i, rule in enumerate(prof.custom)],
    )


def _literal_hits(levels: DataFrame, lexicon: Lexicon, prof: Profile, carried: list[str]) -> DataFrame:
    """The same for a lexicon of few terms: n-grams are tested in place, whole terms by broadcast joins.

    Neither makes more rows, so nothing has to be grouped by string again.
    """
    asked = _exact_terms(prof)
    exact = {name: asked[slot] for name, slot in MASKS.items() if slot in asked}
    longest = lexicon.max_words(*CONTENT_LISTS)
    content = mask_of(*CONTENT_LISTS, "subject_modifier")
    norm = sp.union_mask(
        sp.literal_spans("norm_tokens", lexicon, mask_of(*NORM_LISTS), lexicon.max_words(*NORM_LISTS))
    )
    if prof.generation == 1:
        # an empty string counts as its own n-gram here
        norm = f"({norm} | IF(norm = '', {(lexicon.masks or {}).get('', 0)}L, 0L))"
    spans = {
        "m_norm": norm,
        "spans": sp.literal_spans("tokens", lexicon, content, longest, NEAR_THE_END),
        "ending_pos": sp.literal_endings("tokens", lexicon, BIT["word_ending"]),
    }
    together = f"IF(and_variant, concat(spans, {sp.literal_spans('and_tokens', lexicon, content, longest)}), spans)"
    own = {
        f"m_{rule.column}": F.col("m_whole") if rule.look_at == "whole" else F.expr(sp.union_mask(rule.spans(lexicon)))
        for rule in prof.custom
    }
    nothing = F.lit(0).cast("bigint")
    found = sp.exact_masks(levels, lexicon, exact).withColumns({name: F.expr(text) for name, text in spans.items()})
    return found.select(
        "input",
        "depth",
        *carried,
        *[F.col(name) if name in exact or name == "m_norm" else nothing.alias(name) for name in MASKS],
        "spans",
        F.expr(together).alias("spans_and"),
        "ending_pos",
        *[value.alias(name) for name, value in own.items()],
    )


def _with_flags(found: DataFrame, prof: Profile) -> DataFrame:
    """The position arrays and answers the rule texts refer to."""
    flagged = found.select(
        "*",
        F.expr(
            f"transform(filter(spans, h -> h.n = 1 AND (h.mask & {BIT['subject_modifier']}L) <> 0L), h -> h.start)"
        ).alias("sm_pos"),
        F.expr(
            "transform(filter(spans, h -> h.n = 1 AND"
            f" (h.mask & {mask_of('type', 'subject', 'org_modifier')}L) <> 0L), h -> h.start)"
        ).alias("known_pos"),
    )
    first_of = "array_min(filter(of_pos, p -> p >= 1 AND p <= n - 2))"

    def is_type(a: str, b: str) -> str:
        return span_is(a, b, BIT["type"])

    if prof.generation == 1:
        university = f"get(tokens, 0) = '{fixed.UNIVERSITY_WORD_V1}'"
    else:
        university = span_is("0", "1", BIT["university"])
    typed = flagged.select(
        "*",
        F.expr(first_of).alias("first_of"),
        F.expr(is_type("0", "1")).alias("type_first"),
        F.expr(is_type("(n - 1)", "n")).alias("type_last"),
        F.expr(university).alias("university_first"),
    ).withColumn(
        "type_before_of",
        F.expr(f"first_of IS NOT NULL AND {is_type('0', 'first_of')}"),
    )
    questions = {
        "all": ("0", "n", "n > 0"),
        "tail": ("1", "n", "n >= 2 AND type_first"),
        "head": ("0", "(n - 1)", "n >= 2 AND type_last"),
        "middle": ("1", "(n - 1)", "n >= 3 AND type_last AND university_first"),
        "after_of": ("(first_of + 1)", "n", "type_before_of"),
    }
    return typed.withColumn("subj", F.expr(subject_answers(questions, prof.subject_mask)))


def _rule_columns(lexicon: Lexicon, prof: Profile) -> dict[int | str, Column]:
    v1 = prof.generation == 1
    org, norm, content = F.col("org"), F.col("norm"), F.col("norm_no_sw")
    subject = prof.subject_mask
    of = "|".join(prof.of_words)
    several_words = F.contains(norm, F.lit(" "))

    def gen(condition: Column | str) -> Column:
        return F.when(F.expr(condition) if isinstance(condition, str) else condition, F.lit(fixed.GEN))

    def spe(condition: Column) -> Column:
        return F.when(condition, F.lit(fixed.SPE))

    def listed(mask: str, name: str) -> Column:
        return hit_list(F.col(mask), name)

    def is_type(a: str, b: str) -> str:
        return span_is(a, b, BIT["type"])

    def modifier_term(a: str, b: str) -> str:
        return span_is(a, b, BIT["subject_modifier"])

    known = "(array_contains(known_pos, i) OR array_contains(of_pos, i))"
    every = "forall(transform(tokens, (w, i) -> i), i -> {})"
    hospital = fixed.HOSPITAL_HINT_V1 if v1 else fixed.HOSPITAL_HINT

    if v1:
        dept_common = F.expr(
            "startswith(norm_no_sw, 'dep') AND exists(array("
            + ", ".join(sql_string(t) for t in lexicon.common_subjects)
            + "), c -> IF(c = '', length(norm_no_sw) > 3, locate(c, norm_no_sw, 5) > 0))"
        ) if lexicon.common_subjects else F.lit(False)
        acronym = spe(has_acronym_v1(org, listed("m_base", "subject")))
    else:
        dept_common = F.expr(
            f"n >= 3 AND array_contains(of_pos, 1) AND {is_type('0', '1')}"
            f" AND {span_is('2', 'n', BIT['common_subject'])}"
        )
        alone = (F.size(words(org)) == 1) & ~listed("m_raw", "acronym_allow")
        mixed = (org != F.upper(org)) & (org != F.lower(org)) & ~is_title(org)
        shouting = (org == F.upper(org)) & ~listed("m_base", "subject")
        length = F.length("acronym")
        acronym = spe(
            (alone & (mixed | shouting))
            | ((length >= 4) & (length <= 12) & ~listed("m_acronym", "acronym_allow"))
        )

    raw_subject = F.col("m_raw_subject").bitwiseAND(
        F.lit(subject | BIT["subject_modifier"])
    ) != 0
    whole_subject = F.when(
        content == "", F.col("m_whole").bitwiseAND(F.lit(subject)) != 0
    ).otherwise(F.expr("subj.all"))

    return {
        "allow": gen(listed("m_whole", "allow")),
        "deny": spe(listed("m_whole", "deny")),
        0: spe(org.isNull() | (org == "")),
        1: gen(org.rlike(fixed.DEPT_OF_XE.format(of=of if not v1 else "of"))),
        2: gen(org.rlike(fixed.XX_DEPT)),
        3: gen(listed("m_expanded", "expanded_subject")),
        4: spe(listed("m_norm", "location")),
        5: spe(listed("m_norm", "company_name")),
        6: spe(listed("m_norm", "company_type") & (F.lit(v1) | several_words)),
        7: spe(listed("m_norm", "university") & (F.lit(v1) | several_words)),
        8: spe(listed("m_suffix", "company_suffix")),
        9: spe(org.rlike(fixed.US_ZIPCODE)),
        10: gen(org.rlike(fixed.XE_DEPT)),
        11: spe(org.rlike(fixed.DEPT_UNIVERSITY)),
        12: gen(dept_common),
        13: gen("type_before_of AND subj.after_of"),
        14: gen("n >= 2 AND type_first AND subj.tail"),
        15: gen(f"n >= 2 AND type_last AND (subj.head OR {modifier_term('0', '(n - 1)')})"),
        16: gen(
            "n >= 3 AND university_first AND type_last AND"
            f" (subj.middle OR {modifier_term('1', '(n - 1)')})"
        ),
        17: gen(raw_subject if v1 else raw_subject & listed("m_raw_type", "type")),
        18: gen(whole_subject),
        19: gen(listed("m_whole", "type")),
        21: gen(
            f"n >= 3 AND array_contains(of_pos, n - 2) AND {is_type('0', '(n - 2)')} AND"
            f" instr(lower(array_join(slice(tokens, 1, greatest(n - 2, 0)), ' ')), '{hospital}') = 0"
        ),
        22: gen(every.format(known)),
        23: gen(every.format(f"({known} OR array_contains(ending_pos, i))")),
        24: acronym,
        25: F.lit(fixed.GEN),
    }


def _evaluate(df: DataFrame, lexicon: Lexicon, prof: Profile) -> DataFrame:
    """All rules but the recursive one, per string and tail."""
    levels = _levels(df, lexicon, prof)
    tokens = "filter(split({}, ' '), w -> w <> '')"
    acronym = (
        F.lit("") if prof.generation == 1 else F.array_join(extract_acronyms(F.col("org")), " ")
    )
    closing = (
        "filter(and_pos, p -> get(tokens, p) = 'and')" if prof.generation == 1 else "and_pos"
    )
    joined = f"transform(tokens, w -> IF({member_of('w', prof.and_words)}, 'and', w))"
    levels = (
        levels.withColumns(
            {
                "tokens": F.expr(tokens.format("norm_no_sw")),
                "norm_tokens": F.expr(tokens.format("norm")),
                "acronym": acronym,
            }
        )
        .withColumns(
            {
                "n": F.size("tokens"),
                "of_pos": _positions("tokens", prof.of_words),
                "and_pos": _positions("tokens", prof.and_words),
            }
        )
        .withColumns(
            {
                "linked": F.expr("size(of_pos) + size(and_pos) > 0"),
                "and_variant": F.expr("exists(and_pos, p -> get(tokens, p) <> 'and')"),
                "list_pos": F.expr(closing),
            }
        )
        .withColumn(
            "and_tokens", F.expr(f"IF(and_variant, {joined}, cast(array() AS array<string>))")
        )
    )
    carried = ["own_norm", "own_no_sw", "org", "norm", "norm_no_sw", "tokens", "acronym", "n", "of_pos", "and_pos", "list_pos"]
    hits = _literal_hits if lexicon.literal else _joined_hits
    found = hits(levels, lexicon, prof, carried)
    columns = _rule_columns(lexicon, prof)
    registered = {rule.column: rule.value(lexicon) for rule in prof.custom}
    none = F.lit(None).cast("string")
    return _with_flags(found, prof).select(
        "input",
        "depth",
        "own_norm",
        "own_no_sw",
        *[
            (columns[k] if k in ("allow", "deny") or prof.runs(k) else none).alias(
                k if isinstance(k, str) else column_of(k)
            )
            for k in columns
        ],
        *[value.alias(name) for name, value in registered.items()],
    )


WORD_BITS = 60  # rules whose bits share an integer


def _labels() -> dict[str, str]:
    """The label that each list and slot gives, the recursive one left out."""
    generic = {"allow", *(column_of(s) for s in (1, 2, 3, 10, *range(12, 20), 21, 22, 23, 25))}
    names = ("allow", "deny", *(column_of(s) for s in SLOTS if s != 20))
    return {name: fixed.GEN if name in generic else fixed.SPE for name in names}


def _name(item: int | str) -> str:
    return item if isinstance(item, str) else column_of(item)


def rule_matrix(
    df: DataFrame, lexicon: Lexicon, prof: Profile | None = None, text: str = "input"
) -> DataFrame:
    """Evaluate every rule for every distinct string of ``text``.

    Returns ``input, norm, norm_no_sw, list_prediction, rule_00..rule_25,
    rule_first, prediction``, registered rules before ``rule_first``.  The only exchange is the one that makes the strings distinct.
    """
    prof = prof or profile()
    distinct = df.select(F.coalesce(F.col(text), F.lit("")).alias("input")).distinct()
    return _matrix_of(distinct, lexicon, prof)


def _matrix_of(distinct: DataFrame, lexicon: Lexicon, prof: Profile) -> DataFrame:
    order = prof.sequence()
    added = [rule.column for rule in prof.custom]
    at = order.index(20) if 20 in order else len(order)
    before = [_name(k) for k in order[:at]]
    after = [_name(k) for k in order[at + 1 :]]
    none = F.lit(None).cast("string")
    rows = _evaluate(distinct, lexicon, prof)
    # What fired is a bit for each rule: its label is known, so the groups hold integers only.
    labels = {**_labels(), **{rule.column: rule.label for rule in prof.custom}}
    parts = [list(labels)[i : i + WORD_BITS] for i in range(0, len(labels), WORD_BITS)]
    fired = {
        f"fired_{i}": sum(
            (F.when(F.col(name).isNotNull(), F.lit(1 << j)).otherwise(F.lit(0)).cast("bigint") for j, name in enumerate(names)),
            F.lit(0).cast("bigint"),
        )
        for i, names in enumerate(parts)
    }
    # From the deepest tail outwards: a tail that is generic makes its parent generic.  Read from outside,
    # the first tail that does not leave the answer to the next one decides.
    first, last = F.coalesce(*before, none), F.coalesce(*after, none)
    generic = F.coalesce(first == fixed.GEN, last == fixed.GEN, F.lit(False))
    decides = (F.col("depth") > 0) & (first.isNotNull() | generic)
    folded = (
        rows.withColumns({**fired, "decided": F.when(decides, F.col("depth") * 2 + F.when(generic, 0).otherwise(1))})
        .groupBy("input", "own_norm", "own_no_sw")
        .agg(
            *[F.max(F.when(F.col("depth") == 0, F.col(name))).alias(name) for name in fired],
            F.min("decided").alias("decided"),
        )
    )
    chained = F.when(F.col("decided") % 2 == 0, F.lit(fixed.GEN)) if prof.runs(20) else none
    flat = folded.select(
        "input",
        F.col("own_norm").alias("norm"),
        F.col("own_no_sw").alias("norm_no_sw"),
        *[
            F.when(F.col(f"fired_{i}").bitwiseAND(F.lit(1 << j)) != 0, F.lit(labels[name])).alias(name)
            for i, names in enumerate(parts)
            for j, name in enumerate(names)
        ],
        chained.alias(column_of(20)),
    )
    by_rule = [_name(k) for k in order if k not in ("allow", "deny")]
    return flat.select(
        "input",
        "norm",
        "norm_no_sw",
        F.coalesce("allow", "deny").alias("list_prediction"),
        *RULE_COLUMNS,
        *added,
        F.coalesce(*by_rule).alias("rule_first"),
        F.coalesce(*[_name(k) for k in order]).alias("prediction"),
    )


# A string in at least this many rows gets its label by broadcast instead of by shuffle.
# At most (rows / HOT_ROWS) strings can be that frequent, which bounds the broadcast.
HOT_ROWS = 1_000_000


def classify(
    df: DataFrame,
    lexicon: Lexicon,
    prof: Profile | None = None,
    text: str = "input",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Label every row of ``df``; each distinct string is classified once."""
    prof = prof or profile()
    return join_labels(
        df,
        lambda strings: _matrix_of(strings, lexicon, prof).select("input", "prediction"),
        text,
        hot_rows,
    )


def join_labels(
    df: DataFrame,
    label_distinct: Callable[[DataFrame], DataFrame],
    text: str = "input",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Label distinct strings with ``label_distinct`` and bring the labels back to all rows.

    In a shuffle join the rows of a frequent string would all meet in one task.  Frequent
    strings are known exactly from the counts of the de-duplication, so their few labels
    are broadcast and their rows are not shuffled; the other rows join by shuffle.
    """
    counts = df.groupBy(F.coalesce(F.col(text), F.lit("")).alias("label_key")).agg(
        F.count("*").alias("label_rows")
    )
    keyed = df.withColumn("label_key", F.coalesce(F.col(text), F.lit("")))

    def labelled(strings: DataFrame) -> DataFrame:
        return label_distinct(strings.select(F.col("label_key").alias("input"))).select(
            F.col("input").alias("label_key"), "prediction"
        )

    def answer(rows: DataFrame, labels: DataFrame, how: str) -> DataFrame:
        return rows.join(labels, "label_key", how).select(*df.columns, "prediction")

    if hot_rows is None:
        return answer(keyed, labelled(counts), "left")
    hot_keys = F.broadcast(counts.where(F.col("label_rows") >= hot_rows).select("label_key"))
    hot = answer(
        keyed, F.broadcast(labelled(counts.where(F.col("label_rows") >= hot_rows))), "inner"
    )
    cold = answer(
        keyed.join(hot_keys, "label_key", "left_anti"),
        labelled(counts.where(F.col("label_rows") < hot_rows)),
        "left",
    )
    return cold.unionByName(hot)


def first_of(slots: tuple[int, ...]) -> Column:
    """First non-null prediction among a subset of rules, ``'None'`` if there is none."""
    return F.coalesce(*[column_of(s) for s in sorted(slots)], F.lit("None"))


def rule_mask(matrix: DataFrame, slots: tuple[int, ...] = fixed.TUNED_RULES) -> DataFrame:
    """Keep a subset of rules; nulls become ``'None'``; ``rule_first`` is redone for them."""
    names = [column_of(s) for s in sorted(slots)]
    return matrix.select(
        "input",
        *[F.coalesce(n, F.lit("None")).alias(n) for n in names],
        first_of(slots).alias("rule_first"),
    )
