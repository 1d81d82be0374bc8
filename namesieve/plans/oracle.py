"""DuckDB SQL for the named queries, written independently of the Spark plans."""

from __future__ import annotations

from namesieve import fixed
from namesieve.plans.inputs import LIST_RULES, STOP_WORDS

SQL: dict[str, str] = {}

# white space as Spark's Unicode-aware classes see it, spelled out for RE2
WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PIECE = r"[.!?]+[ \n]+|\n+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re_sub(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit(WS + '+')}), lambda w: w <> '')"


def fold(ws: str) -> str:
    return f"list_transform({ws}, lambda w: CASE WHEN regexp_matches(w, '^[A-Z.,]+$') THEN w ELSE lower(w) END)"


def squeeze(x: str) -> str:
    return f"trim({re_sub(x, WS + '+', ' ')})"


def normal(x: str) -> str:
    y = f"array_to_string({fold(words(f'nfc_normalize({x})'))}, ' ')"
    y = re_sub(y, "&[#x]*[0-9A-Za-z]+;")
    y = re_sub(y, f"{WS}&|&amp;{WS}", " and ")
    y = f"replace({y}, {lit(chr(32) + 'd' + chr(39))}, ' de ')"
    y = re_sub(y, "[^a-zA-Z0-9" + WS[1:])
    return squeeze(y)


def normal_v1(x: str) -> str:
    y = f"array_to_string({fold(f'string_split({x}, {lit(chr(32))})')}, ' ')"
    y = re_sub(y, "&[#x]*[0-9A-Za-z]+;")
    y = f"replace(replace({y}, ' & ', ' and '), {lit(chr(32) + 'd' + chr(39))}, ' de ')"
    y = re_sub(y, "[^a-zA-Z0-9" + WS[1:])
    return squeeze(y)


def strip(x: str) -> str:
    x = re_sub(x, rf"^(\(?[a-zA-Z0-9][).]?|\d{{2}}[).]){WS}+")
    x = re_sub(x, rf"(?i)^{WS}?and ")
    x = re_sub(x, rf"(?i)^{WS}?(from )?the ")
    x = re_sub(x, rf"(?i)^(1st|2nd|3rd|4th|first|second|third|fourth){WS}")
    x = re_sub(x, "(?i) ([1-9]|i|ii|iii|iv|v|a|b|c)$")
    return re_sub(x, rf"(?i)^affiliated{WS}")


def in_list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


STOPS = in_list(STOP_WORDS)


def no_stops(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN {STOPS}), ' ')"


SEG = (
    "seg AS (SELECT doc_id, lang, n_chars AS numdocs, unnest(p) AS input,"
    " generate_subscripts(p, 1) - 1 AS pos FROM"
    f" (SELECT *, string_split_regex(text, {lit(PIECE)}) AS p FROM documents))"
)
TALK = f"talk AS (SELECT unnest(string_split_regex(text, {lit(PIECE)})) AS input FROM conversations)"
LAB = (
    "lab AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'GEN' ELSE 'SPE' END AS label,"
    " CASE WHEN toxic = 0 THEN 'GEN' ELSE 'SPE' END AS prediction FROM labels)"
)
LSEG = f"{SEG}, {LAB}, lseg AS (SELECT * FROM seg JOIN lab USING (doc_id))"

TERMS = (
    "bw AS (SELECT ws[i] AS w, coalesce(ws[i + 1], '') AS x FROM (SELECT ws,"
    " unnest(generate_series(1, len(ws))) AS i FROM (SELECT"
    " list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '') AS ws FROM benchmark))),"
    " terms AS (SELECT DISTINCT list, 'en' AS lang, "
    + normal("raw")
    + " AS term FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS list, {term} AS raw FROM bw WHERE {cond}" for name, cond, term in LIST_RULES
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'stop_word', {lit(w)}" for w in STOP_WORDS)
    + "))"
)
TOK = (
    "tok AS (SELECT token, count(*) AS cnt FROM (SELECT"
    " unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM documents) WHERE token <> '' GROUP BY token)"
)
DOCFREQ = (
    f"freq AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({words('lower(text)')}) AS token"
    " FROM documents) GROUP BY token)"
)

# ---------------------------------------------------------------- normalisation
def prep(cte: str, src: str) -> str:
    return (
        f"{cte}, b AS (SELECT *, {normal('input')} AS base FROM {src}),"
        f" n AS (SELECT *, {strip('base')} AS norm FROM b),"
        f" prep AS (SELECT *, {no_stops('norm')} AS norm_no_sw FROM n)"
    )


SQL["normalize_strings"] = (
    f"WITH {prep(SEG, 'seg')} SELECT doc_id, CAST(pos AS INTEGER) AS pos, base, norm, norm_no_sw FROM prep"
)
SQL["normalize_strings_v1"] = SQL["normalize_strings"].replace(normal("input"), normal_v1("input"))
SQL["normalization_steps"] = f"""SELECT page_id, md5(nfc_normalize(html)) AS nfc,
 md5({re_sub('html', '&[#x]*[0-9A-Za-z]+;')}) AS no_entities,
 md5({re_sub('html', f'{WS}&|&amp;{WS}', ' and ')}) AS ampersand,
 md5(replace(html, ' d''', ' de ')) AS apostrophe,
 md5({re_sub('html', '[^a-zA-Z0-9' + WS[1:])}) AS no_punct,
 md5({squeeze('html')}) AS squeezed, md5(replace(html, '&', 'and')) AS protected FROM pages"""
SQL["remove_stopwords"] = f"""WITH b AS (SELECT concat_ws('-', conv_id, turn) AS key, {normal('text')} AS base FROM conversations),
 n AS (SELECT key, {strip('base')} AS norm FROM b) SELECT key, {no_stops('norm')} AS norm_no_sw FROM n"""
SQL["token_ngrams"] = f"""WITH {TERMS}, b AS (SELECT {normal('text')} AS base FROM documents),
 n AS (SELECT list_filter(string_split({strip('base')}, ' '), lambda w: TRUE) AS t FROM b),
 g AS (SELECT k AS n, array_to_string(t[i:i + k - 1], ' ') AS term FROM
  (SELECT t, k, unnest(generate_series(1, len(t) - k + 1)) AS i FROM n,
   (SELECT unnest(generate_series(1, (SELECT greatest(3, max(len(string_split(term, ' ')))) FROM terms))) AS k)))
 SELECT CAST(n AS INTEGER) AS n, count(*) AS n_grams, count(DISTINCT term) AS n_distinct FROM g GROUP BY n"""

ROMAN = "^(" + "|".join(fixed.ROMAN_NUMERALS) + ")$"


def acr(x: str) -> str:
    """List of acronyms of ``x``."""
    ws = f"list_filter(string_split_regex({x}, '[^a-zA-Z0-9]+'), lambda w: w <> '')"
    caps = (
        f"list_filter({ws}, lambda w: w = upper(w) AND w NOT IN ('ENT', 'HIV', 'AIDS', 'GI')"
        f" AND NOT regexp_matches(w, '{ROMAN}'))"
    )
    bare = f"list_transform({caps}, lambda w: regexp_replace(w, '^[a-f0-9]', ''))"
    inline = f"list_filter({bare}, lambda w: len(regexp_extract_all(w, '[A-Z]')) >= 3)"
    tail = f"regexp_extract({x}, {lit('.+' + chr(92) + '(([A-Z.' + WS[1:] + '+)' + chr(92) + ')$')}, 1)"
    return (
        f"list_concat({inline}, CASE WHEN length({tail}) >= 3 AND NOT regexp_matches({tail}, '{ROMAN}')"
        f" AND NOT list_contains({inline}, {tail}) THEN [{tail}] ELSE [] END)"
    )


SQL["acronyms"] = f"""WITH {SEG}, s AS (SELECT input FROM seg UNION ALL
 SELECT 'Office of ' || n_name || ' (N.O.' || n_nationkey || ')' FROM nation),
 a AS (SELECT input, {acr('input')} AS a FROM s)
 SELECT input, array_to_string(a, ' ') AS acronyms, count(*) AS n FROM a WHERE len(a) > 0 GROUP BY ALL"""

SQL["linked_words"] = """WITH s AS (SELECT p_partkey, replace(p_name, ' ', '/') || ' ' || replace(p_name, ' ', '.') || '. ' || p_type AS x FROM part)
 SELECT p_partkey, array_to_string(flatten(list_transform(list_filter(string_split(x, ' '), lambda w: w <> ''), lambda w:
  CASE WHEN regexp_matches(lower(w), '^([a-z]\\w{2,}\\.){2,}$') THEN regexp_extract_all(w, '\\w+\\.')
       WHEN regexp_matches(lower(w), '^([a-z]{3,}\\.?)(/[a-z]{3,}\\.?)+$') THEN regexp_extract_all(w, '\\w+\\.?')
       ELSE [w] END)), ' ') AS words FROM s"""
UP = "regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '[\\p{Ll}\\p{Lt}]')"
SQL["lexical_shape"] = f"""WITH {SEG}, t AS (SELECT *, {words('input')} AS ws FROM seg)
 SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(input) AS INTEGER) AS char_len,
  CAST(len(string_split(input, ' ')) AS INTEGER) AS word_len,
  CASE WHEN input = '' THEN 0.0::DOUBLE ELSE len(regexp_extract_all(input, '\\p{{Lu}}')) / length(input) END AS freq_capitals,
  CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(ws, lambda w: {UP})) / len(ws) END AS freq_all_caps,
  regexp_matches(regexp_replace(input, ' |\\.', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]|\\p{{Nd}}') AS special FROM t"""
SQL["regex_and_length_filters"] = f"""WITH {SEG} SELECT count(*) FILTER (length(input) < 15) AS below_15,
 count(*) FILTER (length(input) >= 60) AS from_60, count(*) FILTER (length(input) >= 140) AS from_140,
 count(*) FILTER (regexp_matches(input, '^\\w{{3,}}\\.?(/\\w{{3,}}\\.?)+')) AS slashed,
 count(*) FILTER (regexp_matches(input, '^\\w+[.]\\s')) AS abbreviated,
 count(*) FILTER (regexp_matches(input, '\\w\\w,\\s+[0-9]{{5}}')) AS zipcode FROM seg"""
SQL["repair_ragged_tsv"] = """WITH t AS (SELECT doc_id, string_split(replace(text, ' ', chr(9)), chr(9)) AS p FROM documents)
 SELECT doc_id, md5(CASE WHEN len(p) <= 6 THEN array_to_string(p, chr(9))
  ELSE array_to_string(p[1:5], chr(9)) || chr(9) || array_to_string(p[6:], ' ') END) AS repaired FROM t"""

# ---------------------------------------------------------------- word lists
SQL["dictionary_table"] = f"WITH {TERMS} SELECT list, lang, term FROM terms"
SQL["dictionary_exact"] = f"""WITH {TERMS}, {TOK} SELECT token, cnt,
 token IN (SELECT term FROM terms WHERE list = 'type') AS listed FROM tok"""
SQL["dictionary_semi"] = f"WITH {TERMS}, {TOK} SELECT token, cnt FROM tok WHERE token IN (SELECT term FROM terms)"
SQL["dictionary_anti"] = f"WITH {TERMS}, {TOK} SELECT token, cnt FROM tok WHERE token NOT IN (SELECT term FROM terms)"
SQL["dictionary_ngram_hits"] = f"""WITH {TERMS}, {prep(SEG, '(SELECT DISTINCT input FROM seg)')},
 t AS (SELECT input, string_split(norm, ' ') AS t FROM prep),
 g AS (SELECT input, array_to_string(t[i:i + k - 1], ' ') AS term FROM (SELECT input, t, k, unnest(generate_series(1, len(t) - k + 1)) AS i FROM t, (SELECT unnest([1, 2]) AS k)))
 SELECT list, count(DISTINCT input) AS n_strings FROM g JOIN terms USING (term)
 WHERE list IN ('location', 'company_name', 'company_type', 'university') GROUP BY list"""
SQL["fuzzy_match"] = f"""WITH {TERMS}, {TOK}, s AS (SELECT DISTINCT term FROM terms WHERE list IN ('subject', 'subject_modifier'))
 SELECT token FROM tok WHERE EXISTS (SELECT 1 FROM s WHERE term = token OR (length(term) >= 5
  AND abs(length(term) - length(token)) <= 1 AND levenshtein(term, token) <= 1
  AND (regexp_replace(token, '[a-z0-9 ]', '', 'g') = regexp_replace(term, '[a-z0-9 ]', '', 'g')
   OR length(regexp_replace(token, '[a-z0-9 ]', '', 'g')) < length(regexp_replace(term, '[a-z0-9 ]', '', 'g')))))"""
SQL["pooled_phrases"] = f"""WITH {TERMS} SELECT DISTINCT trim(term) AS phrase FROM terms
 WHERE list NOT IN ('allow', 'deny', 'location', 'stop_word') AND trim(term) <> ''"""

# ---------------------------------------------------------------- evaluation


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a}) / ({b}) END"


def prf(tp: str, p: str, a: str, beta: float = 1.0) -> str:
    pr, rc = f"({ratio(tp, p)})", f"({ratio(tp, a)})"
    b2 = beta * beta
    f = ratio(f"{1 + b2}::DOUBLE * {pr} * {rc}", f"{b2}::DOUBLE * {pr} + {rc}")
    return f"{pr} AS precision, {rc} AS recall, {f} AS f_score"


COUNTS = (
    "count(*) FILTER (label = 'GEN' AND prediction = 'GEN') AS tp,"
    " count(*) FILTER (prediction = 'GEN') AS p, count(*) FILTER (label = 'GEN') AS a, count(*) AS n"
)
SQL["score_plain"] = f"WITH {LAB}, c AS (SELECT {COUNTS} FROM lab) SELECT {prf('tp', 'p', 'a')}, a AS support FROM c"
SQL["score_weighted"] = f"""WITH {LAB}, c AS (SELECT
 coalesce(sum(n_chars::DOUBLE) FILTER (label = 'GEN' AND prediction = 'GEN'), 0) AS tp,
 coalesce(sum(n_chars::DOUBLE) FILTER (prediction = 'GEN'), 0) AS p,
 coalesce(sum(n_chars::DOUBLE) FILTER (label = 'GEN'), 0) AS a FROM lab JOIN documents USING (doc_id))
 SELECT {prf('tp', 'p', 'a', 2.0)}, a AS support FROM c"""
SQL["score_by_language"] = f"""WITH {LAB}, c AS (SELECT lang, {COUNTS} FROM lab JOIN documents USING (doc_id) GROUP BY lang)
 SELECT lang, {prf('tp', 'p', 'a')}, a AS support FROM c"""
SQL["score_by_length"] = f"""WITH {LSEG}, c AS (SELECT length(input) AS l, {COUNTS} FROM lseg GROUP BY 1)
 SELECT CAST(l AS INTEGER) AS input_len, n, {prf('tp', 'p', 'a')}, 1.0::DOUBLE AS pct_predicted FROM c"""
SQL["score_short"] = f"""WITH {LSEG}, c AS (SELECT {COUNTS} FROM lseg WHERE length(input) < 15)
 SELECT n, n / (SELECT count(*) FROM lseg) AS share, {prf('tp', 'p', 'a')} FROM c"""
SQL["accuracy"] = f"""WITH {LAB} SELECT avg((label = prediction)::INT) AS accuracy,
 count(*) FILTER (prediction = 'GEN') AS n_gen FROM lab"""
SQL["system_crosstab"] = f"""WITH {LSEG}, m AS (SELECT 'silver' AS system, label FROM lseg UNION ALL SELECT 'second', prediction FROM lseg)
 SELECT system, count(*) FILTER (label = 'GEN') AS gen, count(*) FILTER (label = 'SPE') AS spe FROM m GROUP BY system"""
SQL["profile_changes"] = f"""WITH {LSEG} SELECT label AS before, count(*) FILTER (label <> prediction) AS n_changed,
 count(*) AS n, avg((label <> prediction)::INT) AS share_changed FROM lseg GROUP BY label"""
SQL["share_different"] = f"WITH {LAB} SELECT avg((label <> prediction)::INT) AS share_different FROM lab"
SQL["error_rows"] = f"WITH {LAB} SELECT doc_id, label, prediction FROM lab WHERE label <> prediction"
SQL["correct_rows"] = f"WITH {LAB} SELECT doc_id, label, prediction FROM lab WHERE label = prediction"
SQL["length_histogram"] = f"WITH {SEG} SELECT CAST(length(input) // 20 * 20 AS INTEGER) AS length, count(*) AS n FROM seg GROUP BY 1"
SQL["describe_lengths"] = f"""WITH {SEG} SELECT count(*) AS n, round(avg(length(input)), 6) AS mean,
 round(stddev_samp(length(input)), 6) AS std, CAST(min(length(input)) AS INTEGER) AS min,
 quantile_cont(length(input), 0.25) AS q25, quantile_cont(length(input), 0.5) AS q50,
 quantile_cont(length(input), 0.75) AS q75, CAST(max(length(input)) AS INTEGER) AS max FROM seg"""
SQL["label_counts"] = f"WITH {LSEG} SELECT label, count(*) AS n FROM lseg GROUP BY label"
SQL["regression_diff"] = f"""WITH {LAB}, x AS (SELECT doc_id, label AS expected, CASE WHEN n_chars % 2 = 0 THEN 'GEN' ELSE 'SPE' END AS actual
 FROM lab JOIN documents USING (doc_id) WHERE doc_id % 5 > 0)
 SELECT *, CASE WHEN expected = actual THEN 'success' ELSE 'failure' END AS status FROM x"""
SQL["baseline_delta"] = """WITH t AS (SELECT o_orderpriority AS dataset, o_orderstatus AS c, count(*) AS q,
 sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS d FROM orders GROUP BY 1, 2)
 SELECT f.dataset, (o.q - f.q) / f.q AS num_queries, (o.d - f.d)::DOUBLE / f.d::DOUBLE AS durations
 FROM t f JOIN t o USING (dataset) WHERE f.c = 'F' AND o.c = 'O'"""

# ---------------------------------------------------------------- tokens
SQL["token_frequency"] = f"WITH {DOCFREQ} SELECT token, cnt FROM freq"
SQL["token_rank_bands"] = f"""WITH {DOCFREQ}, r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, token) AS rk FROM freq)
 SELECT token, cnt, CASE WHEN rk <= 10000 THEN CAST(rk AS INTEGER) END AS rank,
 CASE WHEN rk <= 1000 THEN 1 WHEN rk <= 10000 THEN 2 ELSE 3 END AS band FROM r"""
SQL["top_words"] = f"""WITH {DOCFREQ} SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) AS INTEGER) AS rank
 FROM freq ORDER BY cnt DESC, token LIMIT 100"""
SQL["frequency_stats"] = f"""WITH {DOCFREQ}, t AS (SELECT doc_id, unnest({words("lower(translate(text, '(),', ''))")}) AS token FROM documents),
 s AS (SELECT doc_id, min(coalesce(cnt, 0)) AS lo, max(coalesce(cnt, 0)) AS hi, sum(coalesce(cnt, 0)) AS tot, count(*) AS n
  FROM t LEFT JOIN freq USING (token) GROUP BY doc_id)
 SELECT doc_id, least(1, coalesce(lo, 1)) AS min_freq, greatest(1, coalesce(hi, 1)) AS max_freq,
 (coalesce(tot, 0)::BIGINT + 1) / (coalesce(n, 0) + 1) AS mean_freq FROM documents LEFT JOIN s USING (doc_id)"""
SQL["last_mapping"] = """SELECT lower(o_orderpriority) AS abbreviation,
 max_by(o_orderstatus || '-' || o_custkey, o_orderkey) AS replacement FROM orders GROUP BY 1"""
MAP = (
    "map AS (SELECT a AS abbreviation, a || '_' || max(item_id) AS replacement FROM (SELECT item_id,"
    " unnest(string_split_regex(lower(text), '[^a-z]+')) AS a FROM benchmark) WHERE a <> '' GROUP BY a)"
)
SQL["translate_tokens"] = f"""WITH {MAP}, w AS (SELECT doc_id, {words('text')} AS ws FROM documents),
 t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 j AS (SELECT doc_id, string_agg(coalesce(replacement, word), ' ' ORDER BY i) AS tr FROM t LEFT JOIN map ON lower(word) = abbreviation GROUP BY doc_id)
 SELECT doc_id, md5(coalesce(tr, '')) AS translated FROM documents LEFT JOIN j USING (doc_id)"""
PRIO = [(i, name, tag) for i, (name, tag) in enumerate(fixed.TAG_BY_LIST)]
CLOSED = [(fixed.TAG_AND, fixed.AND_WORDS), (fixed.TAG_OF, fixed.OF_WORDS), (fixed.TAG_IN, fixed.IN_WORDS), (fixed.TAG_ROMAN, fixed.ROMAN_NUMERALS)]
TAGS = (
    "tg AS (SELECT token, max_by(tag, p) AS tag FROM ("
    + " UNION ALL ".join(f"SELECT term AS token, '{tag}' AS tag, {i} AS p FROM terms WHERE list = '{n}' AND term <> ''" for i, n, tag in PRIO)
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT unnest([{', '.join(lit(w) for w in ws)}]), '{tag}', {100 + i}" for i, (tag, ws) in enumerate(CLOSED)
    )
    + ") GROUP BY token)"
)


def tagged(src: str, key: str, default: str, keep: bool) -> str:
    own = "CASE WHEN k.token IS NOT NULL THEN t.token ELSE coalesce(tag, " + lit(default) + ") END" if keep else f"coalesce(tag, {lit(default)})"
    kept = " LEFT JOIN (SELECT token FROM freq ORDER BY cnt DESC, token LIMIT 100) k ON t.token = k.token" if keep else ""
    return f"""t AS (SELECT {key}, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM {src}),
 m AS (SELECT {key}, i, {own} AS tag FROM t LEFT JOIN tg ON t.token = tg.token{kept}),
 d AS (SELECT *, lag(tag) OVER (PARTITION BY {key} ORDER BY i) AS prev FROM m),
 o AS (SELECT {key}, count(*) AS n, string_agg(tag, '_' ORDER BY i) AS j FROM d WHERE prev IS NULL OR prev <> tag GROUP BY {key})"""


SQL["tag_sequences"] = f"""WITH {TERMS}, {TAGS}, {DOCFREQ}, w AS (SELECT doc_id, {words('lower(text)')} AS ws FROM documents),
 {tagged('w', 'doc_id', '^nf', True)}
 SELECT doc_id, coalesce(n, 0) AS n_tags, md5(coalesce(j, '')) AS joined FROM documents LEFT JOIN o USING (doc_id)"""
SQL["top_level_tags"] = f"""WITH {TERMS}, tg AS (SELECT DISTINCT token, '^top' AS tag FROM (SELECT term AS token FROM terms
  WHERE list IN ('company_name', 'university', 'company_type') UNION ALL SELECT unnest(string_split(lower(term), ' ')) FROM terms WHERE list = 'type')),
 w AS (SELECT concat_ws('-', conv_id, turn) AS key, {words('lower(text)')} AS ws FROM conversations), {tagged('w', 'key', 'other', False)}
 SELECT key, coalesce(j, '') AS joined FROM w LEFT JOIN o USING (key)"""
SQL["translate_lists"] = f"""WITH {TERMS}, {MAP} SELECT list, 'xx' AS lang, replacement AS term FROM terms JOIN map ON trim(term) = abbreviation
 WHERE lower(abbreviation) <> lower(replacement)"""

# ---------------------------------------------------------------- overlap
CORPUS = f"{LSEG}, ct AS (SELECT input, label, unnest({fold(words('nfc_normalize(input)'))}) AS token FROM lseg)"
LISTTOK = (
    "pl AS (SELECT regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS term FROM pages),"
    f" lt AS (SELECT 'titles.' || lang AS list, lang, unnest({fold(words('nfc_normalize(term)'))}) AS token FROM pl)"
)
FOUND = f"{CORPUS}, {LISTTOK}, mk AS (SELECT *, token IN (SELECT token FROM ct) AS found FROM lt)"
PCT = "count(*) FILTER (found) AS found, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (found) / count(*) AS found_pct"
SQL["overlap_by_language"] = f"WITH {FOUND} SELECT lang, {PCT} FROM (SELECT DISTINCT lang, token, found FROM mk) GROUP BY lang"
SQL["overlap_by_list"] = f"WITH {FOUND} SELECT list, {PCT} FROM mk GROUP BY list"
SQL["overlap_by_list_distinct"] = f"WITH {FOUND} SELECT list, {PCT} FROM (SELECT DISTINCT list, token, found FROM mk) GROUP BY list"
FLAGS = (
    f"{CORPUS}, {LISTTOK}, fl AS (SELECT ct.*, token IN (SELECT token FROM lt WHERE lang = 'en') AS found_en,"
    " token IN (SELECT token FROM lt WHERE lang <> 'en') AS found_others FROM ct),"
    " sf AS (SELECT input, bool_or(found_en OR found_others) AS found, bool_or(found_en) AS found_en,"
    " bool_or(found_others) AS found_others, bool_or(found_others AND NOT found_en) AS found_novel,"
    " array_to_string(list_sort(list(DISTINCT label)), ',') AS label_set FROM fl GROUP BY input)"
)
SQL["string_flags"] = f"WITH {FLAGS} SELECT * FROM sf"
SQL["string_categories"] = f"""WITH {FLAGS}, c AS (SELECT CASE WHEN found_novel THEN 'found novel' WHEN found THEN 'found not novel' ELSE 'not found' END AS type FROM sf)
 SELECT type, count(*) AS n, count(*) / (SELECT count(*) FROM c) AS share FROM c GROUP BY type"""
SQL["label_sets"] = f"WITH {FLAGS} SELECT label_set, count(*) AS n FROM sf GROUP BY label_set"
SQL["unmatched_tokens"] = f"""WITH {FLAGS} SELECT token, min(input) AS sample_input, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
 count(*) AS cnt FROM fl WHERE NOT found_en AND NOT found_others GROUP BY token"""
SQL["novel_tokens"] = f"WITH {LISTTOK} SELECT DISTINCT token FROM lt WHERE lang <> 'en' AND token NOT IN (SELECT token FROM lt WHERE lang = 'en')"

# ---------------------------------------------------------------- acronym tables
ACS = (
    f"{SEG}, src AS (SELECT input, doc_id AS id FROM seg UNION ALL SELECT c_mktsegment || ' Desk', c_nationkey FROM customer),"
    f" ap AS (SELECT DISTINCT array_to_string({acr('input')}, ' ') AS acronyms, id FROM src),"
    " am AS (SELECT acronyms, count(*) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM ap WHERE acronyms <> '' GROUP BY acronyms HAVING count(*) >= 2)"
)
SQL["ambiguous_acronyms"] = f"WITH {ACS} SELECT * FROM am"
SQL["ambiguous_acronym_ids"] = f"WITH {ACS} SELECT acronyms, id FROM ap WHERE acronyms IN (SELECT acronyms FROM am)"
SQL["acronym_whitelist"] = f"""WITH {ACS}, {TALK} SELECT DISTINCT acronym FROM (SELECT array_to_string({acr('input')}, ' ') AS acronym FROM
 (SELECT input FROM src UNION ALL SELECT input FROM talk)) WHERE acronym <> ''"""

# ---------------------------------------------------------------- markup


def elem(tags: tuple[str, ...]) -> str:
    t = "|".join(tags)
    return lit(rf"(?s)<({t})(?:\s[^>]*[^/>]|\s)?>(.*?)</(?:{t})[\s>]")


def extracted(src: str, keys: str, col: str, tags: tuple[str, ...]) -> str:
    return (
        f"SELECT {keys}, unnest(tg) AS tag, unnest(tx) AS text, generate_subscripts(tg, 1) - 1 AS ordinal FROM"
        f" (SELECT {keys}, regexp_extract_all({col}, {elem(tags)}, 1) AS tg, regexp_extract_all({col}, {elem(tags)}, 2) AS tx FROM {src})"
    )


FRAG = (
    "fr AS (SELECT page_id, unnest(p) AS xml, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part FROM (SELECT page_id,"
    " regexp_extract_all(html, '(?s)<(?:ul|article)>(.*?)</(?:ul|article)>', 1) AS p FROM pages))"
)
SQL["extract_tagged"] = f"SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, tag, text FROM ({extracted('pages', 'page_id', 'html', ('a', 'h1', 'p'))})"


def unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def dom(tags: tuple[str, ...]) -> str:
    order = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(tags))
    bad = "regexp_matches(regexp_replace(lead, '&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);', '', 'g'), '&')"
    return f"""x AS ({extracted('pages', 'page_id', 'html', tags)}),
 l AS (SELECT *, regexp_extract(text, '(?s)^[^<]*') AS lead, CASE tag {order} END AS rk FROM x),
 dm AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rk, ordinal) - 1 AS INTEGER) AS dom_ordinal,
  CAST(ordinal AS INTEGER) AS ordinal, tag, CASE WHEN {bad} THEN NULL ELSE {unescape('lead')} END AS text, {bad} AS malformed FROM l)"""


SQL["extract_tagged_dom"] = f"WITH {dom(('p', 'a', 'h1'))} SELECT * FROM dm"

LINKS = f"lk AS ({extracted('pages', 'page_id', 'html', ('a',))})"


def rebuilt(piece: str, html: str = "html") -> str:
    """Concatenate text between opening link tags and ``piece`` for tag ``t``, text ``x``."""
    tag = lit(r"(?s)<a(?:\s[^>]*[^/>]|\s)?>")
    return f"""p AS (SELECT page_id, html, string_split_regex({html}, {tag}) AS s, regexp_extract_all({html}, {tag}) AS o FROM pages),
 e AS (SELECT page_id, s[i] AS s, o[i] AS t, CAST(i - 1 AS BIGINT) AS ordinal FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM p)),
 r AS (SELECT e.page_id, string_agg(e.s || CASE WHEN t IS NULL THEN '' ELSE {piece} END, '' ORDER BY e.ordinal) AS annotated
  FROM e LEFT JOIN lk ON e.page_id = lk.page_id AND e.ordinal = lk.ordinal GROUP BY e.page_id)"""


MARK = "CASE WHEN length(text) % 2 = 0 THEN 'g' ELSE '' END"
SQL["annotate_tagged"] = f"""WITH {LINKS}, {rebuilt("t[1:-2] || ' type=\"' || coalesce(" + MARK + ", '') || '\">'")}
 SELECT page_id, md5(annotated) AS annotated, regexp_replace(annotated, ' type="g?"', '', 'g') = html AS round_trip FROM r JOIN pages USING (page_id)"""
ALT = "CASE WHEN page_id % 3 = 0 THEN html ELSE replace(html, '<a ', '<a type=\"\" ') END"
EXISTING = rebuilt("CASE WHEN " + MARK + " = 'g' THEN replace(t, 'type=\"\"', 'type=\"g\"') ELSE t END", ALT)
SQL["annotate_existing_attr"] = f"""WITH {LINKS}, {EXISTING}
 SELECT page_id, md5(annotated) AS annotated, page_id % 3 = 0 AND page_id IN (SELECT page_id FROM lk) AS missing_attr FROM r"""
SQL["annotate_dom"] = f"""WITH {LINKS}, {rebuilt("CASE WHEN coalesce(text, '') = '' THEN t ELSE t[1:-2] || ' type=\"' || " + MARK + " || '\">' END")}
 SELECT page_id, md5(annotated) AS annotated FROM r"""
SQL["element_text"] = "SELECT page_id, regexp_extract(html, '(?s)<title(?:\\s[^>]*)?>([^<]*)', 1) AS title FROM pages"
SQL["compare_extractions"] = f"""WITH {dom(('p',))}, b AS (SELECT coalesce(dm.page_id, x.page_id) AS page_id, coalesce(dm.text = x.text, FALSE) AS compare
 FROM x FULL JOIN dm ON x.page_id = dm.page_id AND x.ordinal = dm.ordinal) SELECT page_id, compare, count(*) AS n FROM b GROUP BY ALL"""
SQL["enumerate_elements"] = f"""WITH c AS (SELECT page_id, unnest(p) AS html, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS container_no FROM
 (SELECT page_id, regexp_extract_all(html, '(?s)<ul(?:\\s[^>]*)?>(.*?)</ul>', 1) AS p FROM pages)),
 x AS ({extracted('c', 'page_id, container_no', 'html', ('a',))})
 SELECT page_id, container_no, CAST(ordinal AS INTEGER) AS seq,
 CAST(row_number() OVER (PARTITION BY page_id ORDER BY container_no, ordinal) - 1 AS INTEGER) AS global_seq, text AS name FROM x"""

# ---------------------------------------------------------------- data sets
SQL["nested_docs"] = f"""WITH {SEG}, u AS (SELECT lang || ' ' || source AS input, doc_id::VARCHAR AS id, 'name' AS name_type FROM documents
 UNION ALL SELECT input, doc_id::VARCHAR, 'variant' FROM seg
 UNION ALL SELECT n_name, n_nationkey::VARCHAR, 'name' FROM nation) SELECT input, id, name_type, count(*) AS n FROM u GROUP BY ALL"""
SQL["variant_docs"] = f"WITH {SEG} SELECT doc_id::VARCHAR AS id, count(*) AS n, max(input) AS last_input FROM seg GROUP BY doc_id"
SQL["union_sources"] = """WITH u AS (SELECT s_name AS input, 'SPE' AS label, 1.0::DOUBLE AS numdocs, NULL::BIGINT AS id FROM supplier
 UNION ALL SELECT p_name, 'GEN', NULL, p_partkey FROM part) SELECT input, label, numdocs, count(*) AS n, max(id) AS last_id FROM u GROUP BY input, label, numdocs"""
SQL["attach_counts"] = f"""WITH {SEG}, {TALK}, c AS (SELECT input, count(*) AS numdocs FROM seg GROUP BY input)
 SELECT input, numdocs FROM (SELECT DISTINCT input FROM talk) LEFT JOIN c USING (input)"""
SQL["top_weighted"] = "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 150"
SQL["single_word_top"] = f"""WITH {SEG} SELECT input, count(*) AS numdocs FROM seg WHERE len({words('input')}) = 1
 GROUP BY input ORDER BY numdocs DESC, input LIMIT 20"""
SQL["slice_sorted"] = f"WITH {LAB} SELECT doc_id, label FROM lab WHERE label <> prediction ORDER BY doc_id LIMIT 10 OFFSET 5"
SQL["shuffled_sample"] = "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':1323'), doc_id LIMIT 60"
SQL["stratified_split"] = f"""WITH {LAB}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':7'), doc_id) AS k,
 count(*) OVER (PARTITION BY label) AS n FROM lab)
 SELECT doc_id, label, CASE WHEN k <= floor(n * 0.5 + 0.5) THEN 'train' ELSE 'test' END AS part FROM r"""
SQL["similar_pairs"] = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
 SELECT q.vec_id AS query_id, o.vec_id AS other_id, round(list_dot_product(q.v, o.v), 6) AS dot FROM e q JOIN e o ON q.label = 0 AND o.label <> 0
 ORDER BY list_dot_product(q.v, o.v) DESC, query_id, other_id LIMIT 100"""

# ---------------------------------------------------------------- the rule cascade
W = r"[\p{L}\p{M}\p{N}_]"
NS = "[^" + WS[1:]
LISTED = {
    "lt": "type", "lsm": "subject_modifier", "lom": "org_modifier", "lcs": "common_subject",
    "le": "word_ending", "lloc": "location", "lcn": "company_name", "lu": "university",
    "lcsf": "company_suffix", "lct": "company_type", "lal": "allow", "ldn": "deny",
    "law": "acronym_allow",
}
LISTS = (
    "ls AS (SELECT "
    + ", ".join(f"coalesce(list(term) FILTER (list = '{n}'), []) AS {c}" for c, n in LISTED.items())
    + ", list(term) FILTER (list IN ('subject', 'subject_modifier')) AS lsub,"
    " coalesce(list(lower(term)) FILTER (list = 'expanded_subject'), []) AS lxs FROM terms)"
)


def single(x: str) -> str:
    """Zero or more leading modifiers, then a listed subject."""
    t = f"string_split({x}, ' ')"
    stop = f"coalesce(nullif(list_position(list_transform({t}, lambda w: list_contains(lsm, w)), FALSE), 0), len({t}))"
    return (
        f"coalesce(list_bool_or(list_transform(generate_series(1, {stop}),"
        f" lambda k: list_contains(lsub, array_to_string({t}[k:], ' ')))), FALSE)"
    )


def cascade(
    cte: str, src: str, v1: bool = False, off: tuple[int, ...] = (), lists: str = LISTS,
    custom: tuple[str, str, str, int] | None = None,
) -> str:
    """CTEs ending in ``res``: all rule columns and the predictions of distinct strings.

    ``custom`` is one more rule: its column, condition, label, and the rule it comes before.
    """
    ofs = "|".join(fixed.OF_WORDS_V1 if v1 else fixed.OF_WORDS)
    ands = "|".join(fixed.AND_WORDS_V1 if v1 else fixed.AND_WORDS)
    last_and = "and" if v1 else ands
    base = normal_v1("input") if v1 else normal("input")
    pats = {
        "m2": (rf"^(\S+) (?:{ands}) (\S+) (.+)$", 3),
        "m3": (rf"^(\S+) (\S+) (?:{ands}) (\S+) (.+)$", 4),
        "t2": (rf"^(.+?) (?:{ands}) (.+)$", 2),
        "t3": (rf"^(.+) (?:{ands}) (.+) (?:{ands}) (.+)$", 3),
        "l3": (rf"^(.+) (.+) (?:{last_and}) (.+)$", 3),
    }
    groups = ", ".join(
        f"CASE WHEN linked AND regexp_matches(x, {lit(p)}) THEN regexp_extract(x, {lit(p)}, {g}) END AS {name}_{g}"
        for name, (p, k) in pats.items()
        for g in range(1, k + 1)
    )
    sm = "list_contains(lsm, {})".format
    compound = " OR ".join(
        (
            f"({sm('m2_1')} AND {sm('m2_2')} AND {single('m2_3')})",
            f"({sm('m3_1')} AND {sm('m3_2')} AND {sm('m3_3')} AND {single('m3_4')})",
            f"({single('t2_1')} AND {single('t2_2')})",
            f"({single('t3_1')} AND {single('t3_2')} AND {single('t3_3')})",
            f"({single('t3_1')} AND {single('(t3_2 || ' + lit(' and ') + ' || t3_3)')})",
            f"({single('(t3_1 || ' + lit(' and ') + ' || t3_2)')} AND {single('t3_3')})",
            f"({single('l3_1')} AND {single('l3_2')} AND {single('l3_3')})",
        )
    )
    of_lazy, of_word = rf"^(.+?) (?:{ofs}) (.+)$", rf"^([\w.?]+) (?:{ofs}) (.+)$"
    of_one = rf"^(.+) (?:{ofs}) (\S+)$"
    ins = "|".join(fixed.IN_WORDS)
    studies = rf"^Department of Studies in ({NS}+)$" if v1 else rf"^({W}+) (?:{ofs}) {W}+ (?:{ins}) ({NS}+)$"
    suffix = rf"^[a-zA-Z]+{WS}([a-zA-Z0-9 ]*)$"

    def rx(col: str, p: str, g: int) -> str:
        return f"CASE WHEN regexp_matches({col}, {lit(p)}) THEN regexp_extract({col}, {lit(p)}, {g}) END"

    parts = {
        "p13t": rx("nosw", of_lazy, 1), "p13s": rx("nosw", of_lazy, 2),
        "p12t": rx("nosw", of_word, 1), "p12s": rx("nosw", of_word, 2),
        "p14t": rx("nosw", r"^(\S+) (.+)$", 1), "p14s": rx("nosw", r"^(\S+) (.+)$", 2),
        "p15s": rx("nosw", r"^(.+) (\S+)$", 1), "p15t": rx("nosw", r"^(.+) (\S+)$", 2),
        "p16u": rx("nosw", r"^(\w+) (.+) (\S+)$", 1), "p16s": rx("nosw", r"^(\w+) (.+) (\S+)$", 2),
        "p16t": rx("nosw", r"^(\w+) (.+) (\S+)$", 3),
        "p17t": "'x'" if v1 else rx("org", studies, 1), "p17s": f"lower({rx('org', studies, 1 if v1 else 2)})",
        "p21t": rx("nosw", of_one, 1), "p8": rx("norm" if v1 else "org", suffix, 1),
    }
    known = f"(list_contains(lt, w) OR list_contains(lsub, w) OR list_contains(lom, w) OR w IN {in_list(tuple(ofs.split('|')))})"
    ending = "coalesce(list_bool_or(list_transform(generate_series(4, length(w) - 4), lambda i: list_contains(le, w[i + 1:]))), FALSE)"
    ws = "list_filter(string_split(nosw, ' '), lambda w: w <> '')"
    several = "TRUE" if v1 else "len(nt) >= 2"
    runs = r"regexp_extract_all(org, '\p{L}+')"
    title = f"(len({runs}) > 0 AND list_bool_and(list_transform({runs}, lambda r: regexp_matches(r, '^\\p{{Lu}}\\p{{Ll}}*$'))))"
    one = f"len({words('org')}) = 1"
    mixed = f"(regexp_matches(org, '\\p{{Ll}}') AND regexp_matches(org, '\\p{{Lu}}') AND NOT {title})"
    caps = "(NOT regexp_matches(org, '\\p{Ll}') AND NOT list_contains(lsub, base))"
    if v1:
        al = "list_filter(list_filter(string_split_regex(org, '[^a-zA-Z0-9]+'), lambda w: w <> ''), lambda w: w NOT IN ('ENT', 'HIV', 'AIDS', 'GI'))"
        rom = "w IN ('I', 'II', 'III', 'IV', 'V')"
        cons = f"list_filter({al}, lambda w: NOT ({rom}))"
        like = f"len(list_filter({cons}, lambda w: len(regexp_extract_all(regexp_replace(regexp_replace(w, '^[a-f0-9]', ''), '^(Bio|Geo|Nano|Neuro|Cardio)+', ''), '[A-Z]')) >= 3)) > 0"
        low = f"len(list_filter({cons}, lambda w: w <> upper(w))) > 0"
        noroman = f"len(list_filter({al}, lambda w: {rom})) = 0"
        capws = "[A-Z." + WS[1:]
        acro = (
            f"CASE WHEN {one} THEN {mixed} OR {caps} ELSE ({like} AND {low}) OR ({noroman} AND (regexp_matches(org, {lit('.+' + chr(92) + '(' + capws + '+' + chr(92) + ')$')})"
            f" OR regexp_matches(org, {lit('^' + capws + '+[-' + WS[1:] + '+.+$')}))) END"
        )
    else:
        a = "array_to_string(acr, ' ')"
        acro = f"({one} AND NOT list_contains(law, org) AND ({mixed} OR {caps})) OR (length({a}) BETWEEN 4 AND 12 AND NOT list_contains(law, {a}))"
    dep12 = (
        "starts_with(nosw, 'dep') AND len(list_filter(lcs, lambda c: strpos(nosw[5:], c) > 0)) > 0"
        if v1
        else "list_contains(lt, p12t) AND list_contains(lcs, p12s)"
    )
    u16 = "p16u = 'university'" if v1 else "list_contains(lu, p16u)"
    g = "GEN"
    s = "SPE"
    rule = {
        0: ("org = ''", s), 1: (f"regexp_matches(org, {lit(rf'^Dep[a-z]*[.]* (?:{'of' if v1 else ofs}) [A-Z]{{1,2}}E$')})", g),
        2: ("regexp_matches(org, '^[A-Z]{2,3} Dep[a-z]*[.]*')", g), 3: ("list_contains(lxs, lower(base))", g),
        4: ("list_has_any(gr, lloc)", s), 5: ("list_has_any(gr, lcn)", s),
        6: (f"{several} AND list_has_any(gr, lct)", s), 7: (f"{several} AND list_has_any(gr, lu)", s),
        8: ("list_contains(lcsf, p8)", s), 9: (f"regexp_matches(org, {lit(rf'{W}{W},{WS}+[0-9]{{5}}(?:-[0-9]{{4}})?')})", s),
        10: ("regexp_matches(org, '^[A-Z]{1,2}E Dep[a-z]*[.]*$')", g), 11: ("regexp_matches(org, '^Dep[a-z]*[.]*.+University')", s),
        12: (dep12, g), 13: ("list_contains(lt, p13t) AND k13", g), 14: ("list_contains(lt, p14t) AND k14", g),
        15: ("list_contains(lt, p15t) AND (k15 OR list_contains(lsm, p15s))", g),
        16: (f"{u16} AND list_contains(lt, p16t) AND (k16 OR list_contains(lsm, p16s))", g),
        17: (("" if v1 else "list_contains(lt, p17t) AND ") + "list_contains(lsub, p17s)", g),
        18: ("k18", g), 19: ("list_contains(lt, nosw)", g),
        21: (f"list_contains(lt, p21t) AND NOT contains(lower(p21t), '{'hospital' if v1 else 'hosp'}')", g),
        22: (f"coalesce(list_bool_and(list_transform({ws}, lambda w: {known})), TRUE)", g),
        23: (f"coalesce(list_bool_and(list_transform({ws}, lambda w: {known} OR {ending})), TRUE)", g),
        24: (acro, s), 25: ("TRUE", g),
    }
    order = (
        [1, 2, 4, 5, 6, 7, 8, "al", "dn", 10, 24, 11, *range(12, 24), 25] if v1 else ["al", "dn", *range(26)]
    )
    order = [k for k in order if k not in off]
    more, more_z = "", ""
    if custom:
        order.insert(order.index(custom[3]), custom[0])
        more, more_z = f", CASE WHEN {custom[1]} THEN '{custom[2]}' END AS {custom[0]}", f", z.{custom[0]}"
    name = lambda k: k if isinstance(k, str) else f"rule_{k:02d}"
    at = order.index(20)
    before, after = (", ".join(name(k) for k in ks) for ks in (order[:at], order[at + 1 :]))
    cols = ", ".join(
        (f"CASE WHEN {c} THEN '{v}' END" if k in order else "NULL::VARCHAR") + f" AS rule_{k:02d}" for k, (c, v) in rule.items()
    )
    all_rules = ", ".join(
        f"z.rule_{k:02d}" if k != 20 else "CASE WHEN ch.tail = 'GEN' THEN 'GEN' END AS rule_20" for k in range(26)
    )
    return f"""RECURSIVE {TERMS}, {cte}, {lists},
 b0 AS (SELECT input, {base} AS base FROM (SELECT DISTINCT input FROM {src})), n0 AS (SELECT *, {strip('base')} AS norm FROM b0),
 lv AS (SELECT input AS root, 0 AS depth, input AS org, base, norm, {no_stops('norm')} AS nosw FROM n0 UNION ALL
  SELECT root, depth + 1, tail, tail, {strip('tail')}, {no_stops(strip('tail'))} FROM (SELECT root, depth, nosw[strpos(nosw, ' ') + 1:] AS tail FROM lv
   WHERE strpos(nosw, ' ') > 0 AND split_part(nosw, ' ', 1) IN (SELECT term FROM terms WHERE list = 'org_modifier'))),
 nt AS (SELECT *, list_filter(string_split(norm, ' '), lambda w: w <> '') AS nt, {acr('org')} AS acr, {', '.join(f'{e} AS {k}' for k, e in parts.items())} FROM lv),
 gr AS (SELECT *, list_concat(nt, list_transform(generate_series(1, len(nt) - 1), lambda i: nt[i] || ' ' || nt[i + 1])) AS gr FROM nt),
 cand AS (SELECT DISTINCT unnest([nosw, p13s, p14s, p15s, p16s]) AS x FROM nt),
 link AS (SELECT x, regexp_matches(x, {lit(f' (?:{ands}) ')}) AS linked FROM cand WHERE x IS NOT NULL),
 grp AS (SELECT x, linked, {groups} FROM link),
 sub AS (SELECT x, coalesce({single('x')} OR (linked AND ({compound})), FALSE) AS ok FROM grp, ls),
 ev AS (SELECT gr.*, ls.*, s13.ok AS k13, s14.ok AS k14, s15.ok AS k15, s16.ok AS k16, s18.ok AS k18 FROM gr
  LEFT JOIN sub s13 ON s13.x = p13s LEFT JOIN sub s14 ON s14.x = p14s LEFT JOIN sub s15 ON s15.x = p15s LEFT JOIN sub s16 ON s16.x = p16s LEFT JOIN sub s18 ON s18.x = nosw, ls),
 z AS (SELECT root, depth, nosw, CASE WHEN list_contains(lal, nosw) THEN 'GEN' END AS al, CASE WHEN list_contains(ldn, nosw) THEN 'SPE' END AS dn, {cols}{more} FROM ev),
 ch AS (SELECT root, list_reduce(list_prepend('', list(coalesce({before}, '') || '|' || coalesce({after}, '') ORDER BY depth DESC) FILTER (depth > 0)),
   lambda a, e: CASE WHEN split_part(e, '|', 1) <> '' THEN split_part(e, '|', 1) WHEN a = 'GEN' THEN 'GEN' ELSE split_part(e, '|', 2) END) AS tail FROM z GROUP BY root),
 al AS (SELECT z.root AS input, z.nosw AS norm_no_sw, z.al, z.dn, {all_rules}{more_z} FROM z LEFT JOIN ch ON z.root = ch.root WHERE depth = 0),
 res AS (SELECT *, coalesce(al, dn) AS list_prediction, coalesce({', '.join(name(k) for k in order if k not in ('al', 'dn'))}) AS rule_first,
  coalesce({', '.join(name(k) for k in order)}) AS prediction FROM al)"""


RULES = ", ".join(f"rule_{k:02d}" for k in range(26))
DOCS_RES = cascade(SEG, "seg")
TALK_RES = cascade(TALK, "talk")
SQL["classify_strings"] = f"WITH {DOCS_RES} SELECT input, list_prediction, rule_first, prediction FROM res"
SQL["classify_rows"] = f"WITH {DOCS_RES} SELECT doc_id, prediction, count(*) AS n FROM seg JOIN res USING (input) GROUP BY ALL"
SQL["classify_without_switches"] = f"WITH {cascade(TALK, 'talk', off=(9, 24))} SELECT input, prediction FROM res"
SQL["classify_v1"] = f"WITH {cascade(TALK, 'talk', v1=True)} SELECT input, prediction FROM res"
SQL["rule_matrix"] = f"WITH {TALK_RES} SELECT input, {RULES} FROM res"
SQL["modifier_chain"] = f"WITH {DOCS_RES} SELECT input, norm_no_sw, rule_20 FROM res WHERE rule_20 IS NOT NULL"
NONE = "None"
_mask = [f"rule_{k:02d}" for k in fixed.TUNED_RULES]
SQL["rule_mask"] = (
    f"WITH {TALK_RES} SELECT input, {', '.join(f'coalesce({c}, {lit(NONE)}) AS {c}' for c in _mask)},"
    f" coalesce({', '.join(_mask)}, 'None') AS rule_first FROM res"
)
LINKSTR = f"{FRAG}, lnk AS (SELECT text AS input FROM ({extracted('fr', 'page_id, part', 'xml', ('a',))}))"
SQL["rule_prefix"] = f"WITH {cascade(LINKSTR, 'lnk')} SELECT input, " + ", ".join(
    f"coalesce({', '.join(f'rule_{j:02d}' for j in range(k + 1))}, 'None') AS prefix_{k:02d}" for k in range(26)
) + " FROM res"
SQL["score_by_rule"] = f"WITH {cascade(LSEG, 'lseg')}, m AS (SELECT label, res.* FROM lseg JOIN res USING (input)), c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS system, count(v) AS pc, count(*) FILTER (v = 'GEN') AS p, count(*) FILTER (v = 'GEN' AND label = 'GEN') AS tp,"
    f" count(*) FILTER (label = 'GEN') AS a, count(*) AS n FROM (SELECT label, {e} AS v FROM m)"
    for k in range(26)
    for n, e in (
        (f"rule_{k:02d}", f"rule_{k:02d}"),
        (f"rule_00-{k:02d}", f"coalesce({', '.join(f'rule_{j:02d}' for j in range(k + 1))}, NULL)"),
    )
) + f") SELECT system, pc AS prediction_count, {prf('tp', 'p', 'a')}, pc / n AS pct_predicted FROM c"
SQL["rule_overlap"] = (
    f"WITH {TALK_RES} SELECT CAST({' + '.join(f'(rule_{k:02d} IS NOT NULL)::INT' for k in range(26))} AS INTEGER) AS n_rules,"
    " count(*) AS n FROM res GROUP BY 1"
)

# subjects within one edit: the subject list grows by the near n-grams of the probed strings
PROBES = (
    f"bp AS (SELECT unnest(string_split_regex(text, {lit(PIECE)})) AS input FROM benchmark),"
    " pr AS (SELECT DISTINCT input FROM (SELECT input FROM bp UNION ALL"
    " SELECT unnest(string_split_regex(lower(input), '[^a-z]+')) FROM bp) WHERE input <> '')"
)
NEAR = (
    f"{PROBES}, b1 AS (SELECT {normal('input')} AS base FROM pr), n1 AS (SELECT {strip('base')} AS norm FROM b1),"
    f" c1 AS (SELECT string_split({no_stops('norm')}, ' ') AS t FROM n1),"
    " g1 AS (SELECT DISTINCT array_to_string(t[i:i + k - 1], ' ') AS g FROM"
    " (SELECT t, k, unnest(generate_series(1, len(t) - k + 1)) AS i FROM c1, (SELECT unnest([1, 2, 3]) AS k))),"
    " st AS (SELECT DISTINCT term FROM terms WHERE list IN ('subject', 'subject_modifier') AND length(term) >= 5),"
    " fz AS (SELECT DISTINCT g FROM g1 JOIN st ON abs(length(g) - length(term)) <= 1 AND levenshtein(g, term) <= 1"
    " AND (regexp_replace(g, '[a-z0-9 ]', '', 'g') = regexp_replace(term, '[a-z0-9 ]', '', 'g')"
    " OR length(regexp_replace(g, '[a-z0-9 ]', '', 'g')) < length(regexp_replace(term, '[a-z0-9 ]', '', 'g'))))"
)
STRICT = "list(term) FILTER (list IN ('subject', 'subject_modifier')) AS lsub"
LOOSE = (
    "(SELECT list(DISTINCT t) FROM (SELECT term AS t FROM terms WHERE list IN ('subject', 'subject_modifier')"
    " UNION ALL SELECT g FROM fz)) AS lsub"
)
SQL["subject_match"] = (
    f"SELECT l.input, s.rule_18 AS strict, l.rule_18 AS loose FROM (WITH {cascade(PROBES, 'pr')} SELECT input, rule_18 FROM res) s"
    f" JOIN (WITH {cascade(NEAR, 'pr', lists=LISTS.replace(STRICT, LOOSE))} SELECT input, rule_18 FROM res) l USING (input)"
    " WHERE l.rule_18 IS NOT NULL"
)

# open elements as a depth that never falls below zero; the element on top of the stack at a
# depth is the latest one opened there
CHECKS = f"""{FRAG}, tg AS (SELECT page_id, part, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT page_id, part,
  regexp_extract_all(xml, '<(/?[A-Za-z][^\\s/>]*(?:\\s[^>]*?)?/?)>', 1) AS ts FROM fr)),
 kd AS (SELECT *, regexp_extract(t, '^/?([^\\s/>]+)', 1) AS nm, CASE WHEN starts_with(t, '/') THEN -1 WHEN ends_with(t, '/') THEN 0 ELSE 1 END AS k FROM tg),
 cs AS (SELECT *, sum(k) OVER (PARTITION BY page_id, part ORDER BY pos) AS c FROM kd),
 da AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY page_id, part ORDER BY pos)) AS after FROM cs),
 dp AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY page_id, part ORDER BY pos), 0) AS depth FROM da),
 pa AS (SELECT a.page_id, a.part, a.pos, any_value(a.nm) AS nm, any_value(a.k) AS k, any_value(a.depth) AS depth,
   max_by(o.nm, o.pos) FILTER (o.depth = a.depth - 1) AS parent, max_by(o.nm, o.pos) FILTER (o.depth = 0) AS root
  FROM dp a LEFT JOIN dp o ON o.page_id = a.page_id AND o.part = a.part AND o.pos < a.pos AND o.k = 1 GROUP BY a.page_id, a.part, a.pos),
 fl AS (SELECT page_id, part, bool_or(k = -1 AND (depth = 0 OR parent <> nm)) AS bad, bool_or(k >= 0 AND depth = 0 AND nm <> 'li') AS top_level,
   bool_or(k >= 0 AND depth > 0 AND nm = 'li') AS nested, bool_or(k >= 0 AND nm = 'a' AND NOT (depth = 1 AND root = 'li')) AS deep_element,
   bool_or(k >= 0 AND depth > 0 AND parent = 'a') AS sub_element FROM pa GROUP BY page_id, part),
 op AS (SELECT page_id, part, max_by(after, pos) > 0 AS left_open FROM dp GROUP BY page_id, part),
 vd AS (SELECT page_id, part, coalesce(bad OR left_open, FALSE) AS unbalanced, coalesce(top_level, FALSE) AS top_level,
   coalesce(nested, FALSE) AS nested, coalesce(deep_element, FALSE) AS deep_element, coalesce(sub_element, FALSE) AS sub_element
  FROM fr LEFT JOIN fl USING (page_id, part) LEFT JOIN op USING (page_id, part)),
 vr AS (SELECT *, CASE WHEN unbalanced THEN 'unbalanced' WHEN top_level THEN 'top_level' WHEN nested THEN 'nested'
   WHEN deep_element THEN 'deep_element' WHEN sub_element THEN 'sub_element' END AS reject_reason FROM vd)"""
SQL["validate_tagged"] = f"WITH {CHECKS} SELECT * FROM vr"
SQL["reject_counts"] = f"WITH {CHECKS} SELECT coalesce(reject_reason, 'valid') AS reason, count(*) AS n FROM vr GROUP BY 1"
SQL["classify_v1_fuzzy"] = (
    f"WITH {cascade(NEAR.replace(normal('input'), normal_v1('input')), 'pr', v1=True, lists=LISTS.replace(STRICT, LOOSE))}"
    " SELECT input, rule_18, prediction FROM res"
)
TOPIC = "coalesce((SELECT list(DISTINCT w) FROM bw WHERE length(w) = 5 AND w LIKE 'e%'), []) AS ltopic"
TOPIC_RULE = ("rule_topic", "list_has_any(gr, ltopic) AND len(string_split(norm, ' ')) >= 3", "SPE", 13)
SQL["custom_rule"] = (
    f"WITH {cascade(TALK, 'talk', lists=LISTS.replace('ls AS (SELECT ', f'ls AS (SELECT {TOPIC}, '), custom=TOPIC_RULE)}"
    " SELECT input, rule_topic, rule_first, prediction FROM res"
)
SQL["stream_labels"] = f"WITH {TALK_RES} SELECT input, prediction, count(*) AS n FROM talk JOIN res USING (input) GROUP BY ALL"

# ---------------------------------------------------------------- the annotation job
CELLS = """cl AS (SELECT * FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS line_no, regexp_replace(html, '[\t\n\r]', ' ', 'g') AS page FROM pages) p,
 LATERAL (SELECT 2 AS col, page AS xml WHERE page_id % 2 = 0 UNION ALL SELECT 3, '<li><a>' || page_id || '</a></li>' WHERE page_id % 2 = 0
  UNION ALL SELECT 3, page WHERE page_id % 2 <> 0 UNION ALL SELECT 4, 'x' WHERE page_id % 2 <> 0) c)"""
OPEN_A = lit(r"(?s)<a(?:\s[^>]*[^/>]|\s)?>")
LEAD = "regexp_extract(text, '(?s)^[^<]*')"
FOUND_A = f"""{CELLS}, fa AS ({extracted('cl', 'line_no, col', 'xml', ('a',))}),
 fd AS (SELECT *, regexp_matches(regexp_replace({LEAD}, '&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);', '', 'g'), '&') AS bad, {unescape(LEAD)} AS lead FROM fa),
 jobin AS (SELECT text AS input FROM fa WHERE text <> '' UNION SELECT lead FROM fd WHERE NOT bad AND lead <> '')"""


def job(name: str, cells: str, piece: str, late: str) -> str:
    """CTEs of one way to annotate cells: ``name`` ends as ``mode, line_no, col, annotated, reject_reason``."""
    return f"""{name}_c AS ({cells}),
 {name}_e AS (SELECT line_no, col, s[i] AS s, o[i] AS t, CAST(i - 1 AS BIGINT) AS ordinal FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM
  (SELECT line_no, col, string_split_regex(xml, {OPEN_A}) AS s, regexp_extract_all(xml, {OPEN_A}) AS o FROM {name}_c))),
 {name}_r AS (SELECT e.line_no, e.col, string_agg(e.s || CASE WHEN t IS NULL THEN '' ELSE {piece} END, '' ORDER BY e.ordinal) AS annotated
  FROM {name}_e e LEFT JOIN told USING (line_no, col, ordinal) GROUP BY e.line_no, e.col),
 {name} AS (SELECT '{name}' AS mode, line_no, col, md5(CASE WHEN {late} IS NULL THEN annotated ELSE xml END) AS annotated, {late} AS reject_reason
  FROM {name}_r JOIN {name}_c USING (line_no, col))"""


def marked(label: str) -> str:
    return f"CASE WHEN {label} = 'GEN' THEN 'g' ELSE '' END"


GIVEN = "CASE WHEN line_no % 3 = 0 THEN xml ELSE replace(replace(xml, '<a ', '<a type=\"\" '), '<a>', '<a type=\"\">') END"
LEXICAL = f"t[1:-2] || ' type=\"' || {marked('plain')} || '\">'"
SQL["annotate_job"] = f"""WITH {cascade(FOUND_A, 'jobin')},
 told AS (SELECT fd.*, a.prediction AS plain, b.prediction AS decoded FROM fd LEFT JOIN res a ON fd.text = a.input LEFT JOIN res b ON fd.lead = b.input),
 {job('lexical', 'SELECT line_no, col, xml FROM cl', LEXICAL, 'NULL::VARCHAR')},
 {job('dom', 'SELECT line_no, col, xml FROM cl', f"CASE WHEN lead = '' THEN t ELSE t[1:-2] || ' type=' || chr(34) || {marked('decoded')} || chr(34) || '>' END",
      "CASE WHEN (line_no, col) IN (SELECT (line_no, col) FROM fd WHERE bad) THEN 'malformed' END")},
 {job('existing', f'SELECT line_no, col, {GIVEN} AS xml FROM cl', f"CASE WHEN plain = 'GEN' THEN replace(t, 'type=' || chr(34) || chr(34), 'type=' || chr(34) || 'g' || chr(34)) ELSE t END",
      "CASE WHEN line_no % 3 = 0 AND (line_no, col) IN (SELECT (line_no, col) FROM fa) THEN 'missing_attr' END")},
 {CHECKS.replace(FRAG + ',', "fr AS (SELECT line_no AS page_id, col AS part, xml FROM cl),")},
 {job('checked', 'SELECT line_no, col, xml FROM cl', LEXICAL, '(SELECT any_value(reject_reason) FROM vr WHERE vr.page_id = line_no AND vr.part = col)')}
 SELECT * FROM lexical UNION ALL SELECT * FROM dom UNION ALL SELECT * FROM existing UNION ALL SELECT * FROM checked"""
FILL = f"""xf AS ({extracted('pages', 'page_id', 'html', ('p', 'b'))}), cf AS (SELECT page_id, ordinal, CASE WHEN ordinal % 4 = 1 THEN '' ELSE substr(text, 1, 30) END AS input FROM xf),
 fin AS (SELECT input FROM cf WHERE input <> '')"""
SQL["filled_labels"] = f"""WITH {cascade(FILL, 'fin')} SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal,
 CASE WHEN input = '' THEN '' ELSE prediction END AS prediction FROM cf LEFT JOIN res USING (input)"""
