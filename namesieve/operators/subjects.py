"""Subject test over spans: modifiers before a subject, and conjunctions of subjects.

SQL text builders.  They refer to the columns ``spans`` / ``spans_and`` (hits over the
content words, the latter with every connector read as "and"), ``sm_pos`` (positions of
subject modifiers), ``and_pos`` (positions of connectors), ``list_pos`` (positions of the
connectors that may close an enumeration) and ``n`` (number of words).
Spans are half-open word ranges ``[a, b)``.
"""

from __future__ import annotations


def span_is(a: str, b: str, mask: int, spans: str = "spans") -> str:
    """The words ``[a, b)`` form a term of one of the lists in ``mask``."""
    return (
        f"exists({spans}, h -> h.start = {a} AND h.start + h.n = {b} AND (h.mask & {mask}L) <> 0L)"
    )


def single_subject(a: str, b: str, subject: int, spans: str = "spans") -> str:
    """``[a, b)`` is a subject after zero or more leading modifiers."""
    return (
        f"exists({spans}, h -> h.start + h.n = {b} AND h.start >= {a} AND (h.mask & {subject}L) <> 0L"
        f" AND size(filter(sm_pos, p -> p >= {a} AND p < h.start)) = h.start - {a})"
    )


def is_modifier(at: str) -> str:
    return f"array_contains(sm_pos, {at})"


def compound_subject(a: str, b: str, subject: int) -> str:
    """Conjunctions: modifiers joined by a connector, or whole subjects joined by connectors.

    The positions of the connectors that may split the span are bound once, as ``c``.
    """

    def one(x: str, y: str, spans: str = "spans") -> str:
        return single_subject(x, y, subject, spans)

    def connector(at: str) -> str:
        return f"array_contains(and_pos, {at})"

    inside = f"p -> p > {a} AND p <= {b} - 2"
    ends = (
        f"array(named_struct('first', array_min(filter(and_pos, {inside})),"
        f" 'last', array_max(filter(and_pos, {inside})),"
        f" 'final', array_max(filter(list_pos, {inside}))))"
    )
    bound = (
        f"transform({ends}, e -> named_struct('first', e.first, 'last', e.last, 'final', e.final,"
        f" 'mid', array_max(filter(and_pos, p -> p > {a} AND p <= e.last - 2))))"
    )
    two_modifiers = (
        f"({b} >= {a} + 4 AND {connector(f'{a} + 1')} AND {is_modifier(a)}"
        f" AND {is_modifier(f'{a} + 2')} AND {one(f'({a} + 3)', b)})"
    )
    three_modifiers = (
        f"({b} >= {a} + 5 AND {connector(f'{a} + 2')} AND {is_modifier(a)}"
        f" AND {is_modifier(f'{a} + 1')} AND {is_modifier(f'{a} + 3')} AND {one(f'({a} + 4)', b)})"
    )
    two_subjects = f"({one(a, 'c.first')} AND {one('(c.first + 1)', b)})"
    three_subjects = (
        f"(c.mid IS NOT NULL AND"
        f" (({one(a, 'c.mid')} AND {one('(c.mid + 1)', 'c.last')} AND {one('(c.last + 1)', b)})"
        f" OR ({one(a, 'c.mid')} AND {one('(c.mid + 1)', b, 'spans_and')})"
        f" OR ({one(a, 'c.last', 'spans_and')} AND {one('(c.last + 1)', b)})))"
    )
    listed = (
        f"(c.final >= {a} + 2 AND {one(a, '(c.final - 1)')} AND {one('(c.final - 1)', 'c.final')}"
        f" AND {one('(c.final + 1)', b)})"
    )
    return (
        f"({two_modifiers} OR {three_modifiers} OR"
        f" exists({bound}, c -> c.first IS NOT NULL AND"
        f" ({two_subjects} OR {three_subjects} OR {listed})))"
    )


def is_subject(a: str, b: str, subject: int) -> str:
    """``[a, b)`` is a single or compound subject (never null)."""
    compound = f"(size(and_pos) > 0 AND {compound_subject(a, b, subject)})"
    return f"coalesce({single_subject(a, b, subject)} OR {compound}, false)"


def subject_answers(spans: dict[str, tuple[str, str, str]], subject: int) -> str:
    """SQL text of a struct of booleans: for each ``name: (a, b, wanted)``, is it a subject.

    A span is only examined where ``wanted`` holds; the test appears once in the plan.
    """
    asked = ", ".join(
        f"IF({wanted}, named_struct('a', {a}, 'b', {b}), NULL)" for a, b, wanted in spans.values()
    )
    tested = f"transform(array({asked}), s -> s IS NOT NULL AND {is_subject('s.a', 's.b', subject)})"
    fields = ", ".join(f"'{name}', r[{i}]" for i, name in enumerate(spans))
    return f"element_at(transform(array({tested}), r -> named_struct({fields})), 1)"
