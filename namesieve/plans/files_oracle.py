"""DuckDB SQL for the queries that go through files: what the files have to hold."""

from __future__ import annotations

from namesieve.plans.oracle import LAB, LSEG, PIECE, TERMS, lit

SQL: dict[str, str] = {}

SQL["line_numbers"] = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS f FROM orders)
 SELECT row_number() OVER (ORDER BY f, o_orderkey) - 1 AS line_no, row_number() OVER (PARTITION BY f ORDER BY o_orderkey) - 1 AS file_line, o_orderkey FROM o"""
SQL["tagged_file"] = """WITH p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS line_no, regexp_replace(html, '[\\t\\n\\r]', ' ', 'g') AS xml FROM pages),
 c AS (SELECT line_no, 2 AS col, xml FROM p WHERE page_id % 2 = 0 UNION ALL SELECT line_no, 3, '<li><a>' || page_id || '</a></li>' FROM p WHERE page_id % 2 = 0
  UNION ALL SELECT line_no, 3, xml FROM p WHERE page_id % 2 <> 0 UNION ALL SELECT line_no, 4, 'x' FROM p WHERE page_id % 2 <> 0)
 SELECT line_no, col, md5(xml) AS xml FROM c"""
SQL["word_list_files"] = f"""WITH {TERMS} SELECT list, CASE WHEN length(term) % 2 = 0 THEN 'fr' ELSE 'en' END AS lang,
 upper(term) AS term FROM terms WHERE list IN ('type', 'subject', 'location')"""
SQL["labelled_file"] = f"""WITH {LSEG} SELECT doc_id::VARCHAR AS id, label, count(*) AS n,
 sum(CASE WHEN pos % 3 > 0 THEN numdocs::DOUBLE ELSE 1.0 END) AS numdocs, sum(length(input))::BIGINT AS n_chars FROM lseg GROUP BY 1, 2"""
SQL["chunk_sizes"] = """WITH c AS (SELECT count(*) AS n FROM orders), s AS (SELECT unnest(generate_series(0, (n - 1) // 500)) AS k, n FROM c)
 SELECT least(500, n - 500 * k) AS records, count(*) AS files FROM s GROUP BY 1"""
SQL["gold_file"] = f"""WITH {LAB} SELECT label AS verified_label, prediction AS label, 'x' AS flag, 'say "' || doc_id AS input FROM lab"""
SQL["line_file"] = f"""SELECT input, count(*) AS n FROM (SELECT unnest(string_split_regex(text, {lit(PIECE)})) AS input FROM conversations) GROUP BY input"""
SQL["mapping_file"] = """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS no FROM orders)
 SELECT lower(o_orderpriority) AS abbreviation, max_by(o_orderstatus || ', ' || o_custkey, (no % 4 > 0)::INT * 1000000000 + no) AS replacement FROM o GROUP BY 1"""
SQL["result_file"] = """SELECT o_orderpriority AS dataset, o_orderstatus AS classifier, count(*) AS num_queries,
 sum(CAST(trunc(o_totalprice * 100) AS BIGINT))::BIGINT AS durations, 0.5::DOUBLE AS precision, NULL::DOUBLE AS recall FROM orders GROUP BY 1, 2"""
SQL["ragged_file"] = """WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '[\\r\\n]', ' ', 'g'), ' ')[1:12] AS w FROM documents WHERE length(text) > 0)
 SELECT doc_id::VARCHAR AS id1, w[1] AS id2, w[2] AS freq, w[3] AS org_xml1, w[4] AS org_xml2,
 CASE WHEN len(w) >= 5 THEN array_to_string(w[5:], ' ') END AS matched_id, NULL::VARCHAR AS matched_name FROM d"""
SQL["sorted_lines"] = """WITH t AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS token FROM benchmark)
 SELECT row_number() OVER (ORDER BY token) - 1 AS line_no, token FROM t"""
SQL["prediction_file"] = f"WITH {LAB} SELECT doc_id, prediction FROM lab"
SQL["libsvm_file"] = """WITH l AS (SELECT label, dense_rank() OVER (ORDER BY 'c' || label) - 1 AS no, embedding::DOUBLE[] AS v FROM embeddings)
 SELECT no::DOUBLE AS label, 1 AS first_index, round(v[1], 3) + 0.0 AS first_value, CAST(len(v) + 1 AS INTEGER) AS n_fields, count(*) AS n FROM l GROUP BY ALL"""
SQL["translation_file"] = "SELECT 'l' || n_regionkey AS lang, n_name AS source, lower(n_name) AS target FROM nation"
SQL["resample"] = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':3'), doc_id) - 1 AS k FROM documents),
 d AS (SELECT CAST(i // 250 AS INTEGER) AS file_no, ('0x' || substr(md5((i // 250) || ':' || (i % 250) || ':3'), 1, 15))::BIGINT % (SELECT count(*) FROM documents) AS k
  FROM (SELECT unnest(generate_series(0, 999)) AS i))
 SELECT file_no, doc_id, count(*) AS n FROM d JOIN r USING (k) GROUP BY ALL"""
