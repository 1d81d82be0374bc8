"""DuckDB SQL for the queries of the learnt parts.

Features are derived again from the tables.  The optimum of the linear model is unique, so SQL finds it
by its own method: accelerated gradient steps as a recursive query.
"""

from __future__ import annotations

from namesieve import fixed
from namesieve.operators.features import FeatureOptions
from namesieve.plans.learned import COST, LANDMARKS, MODEL, OPTIONS
from namesieve.plans.oracle import PIECE, TAGS, UP, cascade, lit, prf, words

SQL: dict[str, str] = {}

LN = (
    "ln AS (SELECT *, CASE WHEN md5(conv_id::VARCHAR || ':5') < '8' THEN 'train' ELSE 'dev' END AS part FROM"
    " (SELECT conv_id, CASE WHEN role = 'assistant' THEN 'GEN' ELSE 'SPE' END AS label, (turn + 1)::DOUBLE AS w,"
    f" unnest(string_split_regex(text, {lit(PIECE)})) AS input FROM conversations))"
)
MERGED = (
    f"mg AS (SELECT input, label, sum(w * CASE WHEN label = 'GEN' THEN {fixed.CLASS_WEIGHT['GEN']} ELSE"
    f" {fixed.CLASS_WEIGHT['SPE']} END) AS weight, count(*) AS rows FROM ln WHERE part = 'train' GROUP BY input, label)"
)
SIGNED = MERGED.replace("mg AS", "m0 AS") + (
    ", mg AS (SELECT input, CASE WHEN s > 0 THEN 'GEN' ELSE 'SPE' END AS label, abs(s) AS weight, rows FROM"
    " (SELECT input, sum(CASE WHEN label = 'GEN' THEN weight ELSE -weight END) AS s, sum(rows) AS rows FROM m0 GROUP BY input)"
    " WHERE s <> 0)"
)


def sequences(name: str, kept: str | None, table: str, default: str) -> str:
    """One tag array per string, runs of equal tags collapsed."""
    own = f"coalesce(g.tag, {lit(default)})"
    if kept:
        own = f"CASE WHEN k.token IS NOT NULL THEN t.token ELSE {own} END"
        kept = f" LEFT JOIN (SELECT token FROM kf ORDER BY cnt DESC, token LIMIT {kept}) k ON t.token = k.token"
    return f"""{name}_m AS (SELECT input, i, {own} AS tag FROM t LEFT JOIN {table} g ON t.token = g.token{kept or ''}),
 {name}_d AS (SELECT *, lag(tag) OVER (PARTITION BY input ORDER BY i) AS prev FROM {name}_m),
 {name}_o AS (SELECT input, list(tag ORDER BY i) AS {name} FROM {name}_d WHERE prev IS NULL OR prev <> tag GROUP BY input)"""


RULES = [f"rule_{k:02d}" for k in OPTIONS.rules]
NUMBERS = ("char_len", "word_len", "freq_capitals", "freq_all_caps", "min_freq", "max_freq", "mean_freq")


def raw(merged: str = MERGED) -> str:
    """CTEs up to ``raw``: the raw features of every string; ``kp`` are those trained on."""
    return f"""WITH {cascade(LN, 'ln')}, {merged},
 st AS (SELECT input, sum(rows) AS rows FROM mg GROUP BY input),
 kp AS MATERIALIZED (SELECT input, rows FROM st JOIN res USING (input) WHERE list_prediction IS NULL),
 freq AS (SELECT token, sum(rows) AS cnt FROM (SELECT rows, unnest({words('lower(input)')}) AS token FROM st) GROUP BY token),
 kf AS (SELECT token, sum(rows) AS cnt FROM (SELECT rows, unnest({words('lower(input)')}) AS token FROM kp) GROUP BY token),
 {TAGS}, tl AS (SELECT DISTINCT token, '{fixed.TAG_TOP_LEVEL}' AS tag FROM (SELECT term AS token FROM terms
  WHERE list IN ('company_name', 'university', 'company_type') UNION ALL SELECT unnest(string_split(lower(term), ' ')) FROM terms WHERE list = 'type')),
 u AS (SELECT input, {words('lower(input)')} AS ws FROM res),
 t AS (SELECT input, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM u),
 {sequences('tags', None, 'tg', fixed.TAG_UNKNOWN)}, {sequences('tags_top', str(OPTIONS.top_words), 'tg', fixed.TAG_UNKNOWN)},
 {sequences('tags_level', str(OPTIONS.top_level_words), 'tl', fixed.TAG_OTHER)},
 ft0 AS (SELECT input, unnest({words("lower(translate(input, '(),', ''))")}) AS token FROM res),
 fs AS (SELECT input, min(coalesce(cnt, 0)) AS lo, max(coalesce(cnt, 0)) AS hi, sum(coalesce(cnt, 0)) AS tot, count(*) AS n
  FROM ft0 LEFT JOIN freq USING (token) GROUP BY input),
 raw AS MATERIALIZED (SELECT res.input, length(res.input) AS char_len, len(string_split(res.input, ' ')) AS word_len,
  CASE WHEN res.input = '' THEN 0.0::DOUBLE ELSE len(regexp_extract_all(res.input, '\\p{{Lu}}')) / length(res.input) END AS freq_capitals,
  CASE WHEN len({words('res.input')}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({words('res.input')}, lambda w: {UP})) / len({words('res.input')}) END AS freq_all_caps,
  least(1, coalesce(lo, 1)) AS min_freq, greatest(1, coalesce(hi, 1)) AS max_freq, (coalesce(tot, 0)::BIGINT + 1) / (coalesce(n, 0) + 1) AS mean_freq,
  coalesce(tags, []) AS tags, coalesce(tags_top, []) AS tags_top, coalesce(tags_level, []) AS tags_level,
  {', '.join(f"coalesce({r}, 'None') AS {r}" for r in RULES)}, coalesce({', '.join(RULES)}, 'None') AS rule_first, list_prediction
  FROM res LEFT JOIN fs USING (input) LEFT JOIN tags_o USING (input) LEFT JOIN tags_top_o USING (input) LEFT JOIN tags_level_o USING (input))"""


def features(merged: str = MERGED, opts: FeatureOptions = OPTIONS) -> str:
    """CTEs up to ``vocab`` and ``en``, the numbered features of every string."""
    shares = ", ".join(str(k / opts.n_bins) for k in range(1, opts.n_bins))
    quantiles = ", ".join(
        f"quantile_cont({c}::DOUBLE, [{shares}]) AS q_{c}, min({c}::DOUBLE) AS lo_{c}, max({c}::DOUBLE) AS hi_{c}" for c in opts.binned
    )
    edges = ", ".join(
        f"list_filter(list_sort(list_distinct(q_{c})), lambda e: e > lo_{c} AND e < hi_{c}) AS e_{c}" for c in opts.binned
    )
    parts = [f"SELECT input, '{c}.value' AS grp, {c}::BIGINT::VARCHAR AS term FROM raw" for c in opts.frequent]
    parts += [
        f"SELECT input, '{c}.bin', len(list_filter(e_{c}, lambda e: {c}::DOUBLE >= e))::VARCHAR FROM raw, ed" for c in opts.binned
    ]
    parts += [f"SELECT input, '{c}', {c} FROM raw" for c in (*RULES, "rule_first")]
    least = ""
    for c, ((low, high), joined) in opts.tagged.items():
        if joined:
            parts.append(f"SELECT input, '{c}.joined', array_to_string({c}, '_') FROM raw")
            least += f" WHEN '{c}.joined' THEN {opts.min_df_joined} WHEN '{c}.ngram' THEN {opts.min_df_ngrams}"
        parts.append(
            f"SELECT DISTINCT input, '{c}.ngram', array_to_string({c}[i:i + n - 1], ' ') FROM (SELECT input, {c}, n,"
            f" unnest(generate_series(1, len({c}) - n + 1)) AS i FROM raw, (SELECT unnest(generate_series({low}, {high})) AS n))"
        )
    return f"""{raw(merged)},
 xr AS (SELECT raw.*, unnest(generate_series(1, rows::BIGINT)) AS copy FROM raw JOIN kp USING (input)),
 e0 AS (SELECT {quantiles} FROM xr), ed AS MATERIALIZED (SELECT {edges} FROM e0),
 ft AS MATERIALIZED ({' UNION ALL '.join(parts)}),
 vc AS (SELECT grp, term, sum(rows)::BIGINT AS df FROM ft JOIN kp USING (input) GROUP BY grp, term),
 vk AS (SELECT * FROM vc WHERE grp NOT LIKE '%.value' AND df >= CASE grp{least} ELSE 1 END UNION ALL
  SELECT grp, term, df FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY df DESC, term::BIGINT) AS r FROM vc WHERE grp LIKE '%.value') WHERE r <= 20),
 vocab AS MATERIALIZED (SELECT grp, term, df, row_number() OVER (ORDER BY grp, term) - 1 AS id FROM vk),
 en AS MATERIALIZED (SELECT input, id FROM ft JOIN vocab USING (grp, term))"""


FEATURES = features()
SQL["tag_vocabulary"] = f"{FEATURES} SELECT * FROM vocab WHERE grp LIKE 'tags%'"
SQL["frequent_values"] = f"{FEATURES} SELECT grp, term::BIGINT AS value, df, id FROM vocab WHERE grp LIKE '%.value'"
SQL["fitted_state"] = (
    f"{FEATURES} SELECT grp, id AS position, term, df, NULL::DOUBLE AS edge FROM vocab"
    + "".join(
        f" UNION ALL SELECT '{c}.edge', i, NULL, NULL, round(e, 9) FROM (SELECT unnest(e_{c}) AS e, generate_subscripts(e_{c}, 1) - 1 AS i FROM ed)"
        for c in OPTIONS.binned
    )
)
SQL["idf_weights"] = (
    f"{FEATURES} SELECT id, grp, term, round(ln((1 + (SELECT sum(rows) FROM kp)) / (1 + df)) + 1, 9) AS weight FROM vocab"
)
DEV = "dv AS (SELECT DISTINCT input FROM ln WHERE part = 'dev')"
SQL["feature_vectors"] = f"""{FEATURES}, {DEV}
 SELECT input, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS ids FROM dv JOIN en USING (input) GROUP BY input"""
SQL["feature_overhead"] = f"""{FEATURES}, c AS (SELECT input, count(*) AS n FROM kp JOIN en USING (input) GROUP BY input), s AS (SELECT count(*) AS size FROM vocab)
 SELECT round(avg(n), 9) AS mean_nonzero, round(stddev_pop(n), 9) AS std_nonzero, round(sum(n) / sum(size), 9) AS density, max(size) AS n_features FROM c, s"""

STEPS = 1500


def examples(merged: str = MERGED) -> str:
    """CTEs up to ``xl``: features of the merged training rows, the constant one under -1."""
    return f"""{features(merged, MODEL)},
 ex AS MATERIALIZED (SELECT row_number() OVER (ORDER BY input, label) AS eid, input, CASE WHEN label = 'GEN' THEN 1 ELSE -1 END AS y, weight AS s
  FROM mg JOIN kp USING (input) WHERE weight > 0),
 xl AS MATERIALIZED (SELECT eid, id FROM ex JOIN en USING (input) UNION ALL SELECT eid, -1 FROM ex)"""


def optimum(merged: str = MERGED) -> str:
    """CTEs up to ``co``: the coefficients at the optimum, the intercept under -1."""
    return f"""{examples(merged)},
 nz AS (SELECT eid, count(*) AS n FROM xl GROUP BY eid),
 lc AS MATERIALIZED (SELECT 1 + 2 * {COST} * max(b) AS l FROM (SELECT sum(s * n) AS b FROM xl JOIN ex USING (eid) JOIN nz USING (eid) GROUP BY id)),
 it AS (SELECT 0 AS k, id, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM (SELECT DISTINCT id FROM xl)
  UNION ALL
  SELECT k + 1, id, nw, nw + (sqrt(l) - 1) / (sqrt(l) + 1) * (nw - w) FROM (
   SELECT it.k, it.id, it.w, l, it.v - (it.v - coalesce(g, 0)) / l AS nw FROM it LEFT JOIN (
    SELECT x.id, sum(pull) AS g FROM (
     SELECT ex.eid, 2 * {COST} * any_value(s) * any_value(y) * greatest(0, 1 - any_value(y) * sum(v)) AS pull
     FROM it JOIN xl USING (id) JOIN ex USING (eid) GROUP BY ex.eid) m JOIN xl x USING (eid) GROUP BY x.id) gr ON it.id = gr.id, lc
   WHERE it.k < {STEPS})),
 co AS MATERIALIZED (SELECT id, w FROM it WHERE k = {STEPS}), {DEV},
 mr AS (SELECT input, coalesce(sum(w), 0) + (SELECT w FROM co WHERE id = -1) AS margin FROM dv LEFT JOIN en USING (input) LEFT JOIN co USING (id) GROUP BY input),
 pd AS MATERIALIZED (SELECT input, margin, coalesce(list_prediction, CASE WHEN margin > 0 THEN 'GEN' ELSE 'SPE' END) AS prediction FROM mr JOIN res USING (input))"""


SQL["svm_coefficients"] = f"""{optimum()} SELECT co.id, grp, term, round(w, 2) + 0.0 AS weight FROM co LEFT JOIN vocab ON co.id = vocab.id"""
SQL["svm_gradient"] = f"{examples()} SELECT DISTINCT id, 0.0::DOUBLE AS gradient FROM xl"
SQL["svm_predictions"] = f"{optimum()} SELECT input, prediction, round(margin, 2) + 0.0 AS margin FROM pd"
SQL["svm_quality"] = f"""{optimum()}, c AS (SELECT coalesce(sum(w) FILTER (label = 'GEN' AND prediction = 'GEN'), 0) AS tp,
 coalesce(sum(w) FILTER (prediction = 'GEN'), 0) AS p, coalesce(sum(w) FILTER (label = 'GEN'), 0) AS a FROM ln JOIN pd USING (input) WHERE part = 'dev'),
 r AS (SELECT {prf('tp', 'p', 'a')}, a AS support FROM c)
 SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f_score, 9) AS f_score, round(support, 9) AS support FROM r"""
SQL["stored_pipeline"] = f"{optimum(SIGNED)} SELECT input, prediction, round(margin, 2) + 0.0 AS margin FROM pd"

# ---------------------------------------------------------------- vectors
SQL["similar_strings"] = f"""{features(opts=MODEL)}, sd AS (SELECT input, min(label) AS lo FROM ln WHERE part = 'dev' GROUP BY input HAVING min(label) = max(label)),
 wt AS (SELECT id, power(ln((1 + (SELECT sum(rows) FROM kp)) / (1 + df)) + 1, 2) AS q FROM vocab),
 sv AS (SELECT input, lo, id, q FROM sd JOIN en USING (input) JOIN wt USING (id)),
 pr AS (SELECT a.input AS x, b.input AS y, sum(a.q) AS dot FROM sv a JOIN sv b USING (id) WHERE a.lo = 'GEN' AND b.lo = 'SPE' GROUP BY 1, 2),
 bt AS (SELECT dot FROM pr ORDER BY dot DESC LIMIT 50) SELECT count(*) AS n, round(max(dot), 6) AS best, round(min(dot), 6) AS last FROM bt"""
SQL["kernel_values"] = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 lm AS (SELECT vec_id, v, CAST(row_number() OVER (ORDER BY md5(vec_id || ':0'), vec_id) - 1 AS INTEGER) AS no FROM e QUALIFY no < {LANDMARKS}),
 d AS (SELECT e.vec_id, no, list_dot_product(e.v, lm.v) AS dot, list_dot_product(e.v, e.v) AS a, list_dot_product(lm.v, lm.v) AS b, len(e.v) AS n FROM e, lm)
 SELECT 'rbf' AS kind, vec_id, no, round(exp(-greatest(a + b - 2 * dot, 0) / n), 6) AS kernel FROM d
 UNION ALL SELECT 'poly', vec_id, no, round(power(dot / n + 1, 2), 6) FROM d"""
