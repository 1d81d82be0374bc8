import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from namesieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TERMS = [
    ("type", "Department"), ("type", "dept."), ("type", "Institute"), ("type", "Research Unit"),
    ("subject", "Physics"), ("subject", "medical chemistry"), ("subject", "law"), ("subject", "biology and genetics"),
    ("subject", "theology"), ("subject_modifier", "applied"), ("subject_modifier", "experimental"),
    ("subject_modifier", "theoretical"), ("org_modifier", "central"), ("org_modifier", "General"),
    ("org_modifier", "graduate"), ("common_subject", "medicine"), ("common_subject", "surgery"),
    ("word_ending", "gery"), ("word_ending", "ology"), ("word_ending", "ics"),
    ("location", "New York"), ("location", "Oslo"), ("company_name", "AT&T"), ("company_name", "acme"),
    ("university", "University"), ("university", "college"), ("company_suffix", "technologies"),
    ("company_suffix", "systems"), ("company_type", "ltd."), ("company_type", "gmbh"),
    ("allow", "ear clinic"), ("allow", "Centre of Hope"), ("deny", "cdc"), ("deny", "national agency"),
    ("acronym_allow", "UMRX"), ("acronym_allow", "ABCD"), ("expanded_subject", "Solid State Physics"),
    ("stop_word", "the"), ("stop_word", "with"), ("stop_word", "de"), ("subject", "ελληνικά"),
]


@pytest.fixture(scope="session")
def terms(spark):
    from namesieve.operators.lexicon import normalise_terms

    return normalise_terms(spark.createDataFrame(TERMS, ["list", "term"])).persist()


@pytest.fixture(scope="session")
def lexicon(terms):
    from namesieve.operators.lexicon import Lexicon

    return Lexicon.compile(terms)
