"""Patterns, word alternatives and tags that decide results.

Everything in this module is a constant of the task, stated once as plain text.
Patterns are Java regular expressions.  ``(?U)`` makes the character classes
Unicode aware and ``(?d)`` leaves ``\\n`` as the only line terminator.
"""

# --- fixed values: whitespace -------------------------------------------------
# Unicode white space plus the four ASCII separators.
WS = r"[\s\x1c-\x1f]"

# --- fixed values: string clean-up patterns -----------------------------------
ALL_CAPS_TOKEN = r"^[A-Z.,]+$"
ENTITY = r"&[#x]*[0-9A-Za-z]+;"
AMPERSAND = rf"(?U){WS}&|&amp;{WS}"
AMPERSAND_V1 = " & "
D_APOSTROPHE = " d'"
NOT_ALNUM_OR_SPACE = r"(?U)[^a-zA-Z0-9\s\x1c-\x1f]"
SPACE_RUN = rf"(?U){WS}+"
BULLET = rf"(?U)^(\(?[a-zA-Z0-9][).]?|\d{{2}}[).]){WS}+"
LEADING_AND = rf"(?Ui)^{WS}?and "
LEADING_THE = rf"(?Ui)^{WS}?(from )?the "
LEADING_ORDINAL = rf"(?Ui)^(1st|2nd|3rd|4th|first|second|third|fourth){WS}"
TRAILING_NUMBER = r"(?id) ([1-9]|i|ii|iii|iv|v|a|b|c)$"
LEADING_AFFILIATED = rf"(?Ui)^affiliated{WS}"

# --- fixed values: connector words --------------------------------------------
OF_WORDS = ("of", "de", "des", "der", "di", "fur", "fr", "for", "für", "voor", "in", "zu", "és")
AND_WORDS = ("and", "&", "y", "und", "e", "og", "i", "και", "ja", "et", "és", "en", "ból", "ve")
IN_WORDS = ("in", "a", "op", "zu")
OF_WORDS_V1 = ("of", "de", "des", "di", "fur", "fr", "for", "in")
AND_WORDS_V1 = ("and", "&", "y", "und", "e")

# --- fixed values: rule patterns ----------------------------------------------
DEPT_OF_XE = r"(?d)^Dep[a-z]*\.* (?:{of}) [A-Z]{{1,2}}E$"
XX_DEPT = r"^[A-Z]{2,3} Dep[a-z]*\.*"
XE_DEPT = r"(?d)^[A-Z]{1,2}E Dep[a-z]*\.*$"
DEPT_UNIVERSITY = r"(?d)^Dep[a-z]*\.*.+University"
US_ZIPCODE = rf"(?U)\w\w,{WS}+[0-9]{{5}}(?:-[0-9]{{4}})?"
STUDIES_IN = r"(?Ud)^(\w+) (?:{of}) \w+ (?:{into}) ([^\s\x1c-\x1f]+)$"
STUDIES_IN_V1 = r"(?Ud)^Department of Studies in ([^\s\x1c-\x1f]+)$"
WORD_AND_REST = rf"(?Ud)^[a-zA-Z]+{WS}([a-zA-Z0-9 ]*)$"
HOSPITAL_HINT = "hosp"
HOSPITAL_HINT_V1 = "hospital"
UNIVERSITY_WORD_V1 = "university"

# --- fixed values: acronym patterns -------------------------------------------
NOT_AN_ACRONYM = r"^(ENT|HIV|AIDS|GI)$"
ROMAN_NUMERALS = (
    "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X",
    "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX",
)
ROMAN_NUMERALS_V1 = ("I", "II", "III", "IV", "V")
ACRONYM_LEAD = r"^[a-f0-9]"
ACRONYM_PREFIX = r"^(Bio|Geo|Nano|Neuro|Cardio)"
ACRONYM_PREFIX_RUN = r"^(Bio|Geo|Nano|Neuro|Cardio)+"
TRAILING_PARENTHESES = rf"(?Ud).+\(([A-Z.\s\x1c-\x1f]+)\)$"
LEADING_CAPITALS_V1 = r"(?Ud)^[A-Z.\s\x1c-\x1f]+[\s\x1c-\x1f\-]+.+$"

# --- fixed values: linked-word patterns ---------------------------------------
DOTTED_COMPOUND = r"(?Ud)^([a-z]\w{2,}\.){2,}$"
SLASHED_COMPOUND = r"(?d)^([a-z]{3,}\.?)(/[a-z]{3,}\.?)+$"

# --- fixed values: tags of the word-list tagger, later entries win ------------
TAG_BY_LIST = (
    ("location", "^L"),
    ("expanded_subject", "^sbE"),
    ("subject", "^S"),
    ("common_subject", "^cS"),
    ("subject_modifier", "^sb"),
    ("org_modifier", "^mO"),
    ("company_name", "^cn"),
    ("university", "^univ"),
    ("company_suffix", "^cnS"),
    ("company_type", "^cnT"),
    ("type", "^T"),
    ("word_ending", "^e"),
    ("stop_word", "^sw"),
)
TAG_RARE, TAG_AND, TAG_OF, TAG_IN, TAG_ROMAN = "^lf", "^and", "^of", "^in", "^lat"
TAG_UNKNOWN, TAG_TOP_LEVEL, TAG_OTHER = "^nf", "^top", "other"

# --- fixed values: labels and their markup attribute --------------------------
GEN, SPE = "GEN", "SPE"
ATTRIBUTE_OF_LABEL = {"GEN": "g", "SPE": "", "": ""}
ORG_TAGS = ("org", "multi-org", "organization")

# --- fixed values: rule slots of the tuned model and its training weights -----
TUNED_RULES = (5, 6, 7, 12, 13, 16, 17, 18, 21, 23)
CLASS_WEIGHT = {"SPE": 1.0, "GEN": 15.0}
