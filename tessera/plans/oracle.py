"""ANSI SQL of each catalogue query, as DuckDB runs it."""

from __future__ import annotations

SQL: dict[str, str] = {
    "q00": r"""SELECT count(*) AS count FROM lineitem""",
    "q01": r"""SELECT count(*) AS count FROM lineitem WHERE l_linenumber <> 1""",
    "q02": r"""SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum, count(*) AS count, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS total FROM lineitem""",
    "q03": r"""SELECT CAST(sum(l_orderkey) // count(*) AS BIGINT) AS total FROM lineitem""",
    "q04": r"""SELECT count(DISTINCT l_orderkey) AS "distinct" FROM lineitem""",
    "q05": r"""SELECT count(DISTINCT p_name) AS "distinct" FROM part""",
    "q06": r"""SELECT min(CAST(l_shipdate AS DATE)) AS min, max(CAST(l_shipdate AS DATE)) AS max FROM lineitem""",
    "q07": r"""SELECT l_linenumber, count(*) AS count FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1 ORDER BY count DESC, l_linenumber""",
    "q08": r"""SELECT l_suppkey, count(DISTINCT l_orderkey) AS u FROM lineitem GROUP BY 1 ORDER BY u DESC, l_suppkey LIMIT 10""",
    "q09": r"""SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS sum_adv, count(*) AS c, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS avg_res, count(DISTINCT l_orderkey) AS distinct_u FROM lineitem GROUP BY 1 ORDER BY c DESC, l_suppkey LIMIT 10""",
    "q10": r"""SELECT event_type, count(DISTINCT user_id) AS u FROM events WHERE event_type <> 'error' GROUP BY 1 ORDER BY u DESC, event_type LIMIT 10""",
    "q11": r"""SELECT l_linenumber, l_returnflag, count(DISTINCT l_orderkey) AS u FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 ORDER BY u DESC, 1, 2 LIMIT 10""",
    "q12": r"""SELECT p_name, count(*) AS c FROM part WHERE p_name <> '' GROUP BY 1 ORDER BY c DESC, p_name LIMIT 10""",
    "q13": r"""SELECT props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY 1 ORDER BY u DESC, props LIMIT 10""",
    "q14": r"""SELECT l_suppkey, l_returnflag, count(*) AS c FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10""",
    "q15": r"""SELECT user_id, count(*) AS c FROM events GROUP BY 1 ORDER BY c DESC, user_id LIMIT 10""",
    "q16": r"""SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10""",
    "q17": r"""SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10""",
    "q18": r"""SELECT user_id, CAST(extract(minute FROM ts) AS SMALLINT) AS m, event_type, count(*) AS c FROM events GROUP BY 1, 2, 3 ORDER BY c DESC, 1, 2, 3 LIMIT 10""",
    "q19": r"""SELECT l_orderkey FROM lineitem WHERE l_orderkey = 201""",
    "q20": r"""SELECT count(*) AS c FROM pages WHERE url LIKE '%utm_source%'""",
    "q21": r"""SELECT source, min(text) AS min_url, count(*) AS c FROM documents WHERE text LIKE '%ing%' AND source <> '' GROUP BY 1 ORDER BY c DESC, source LIMIT 10""",
    "q22": r"""SELECT source, min(text) AS min_url, min(lang) AS min_title, count(*) AS c, count(DISTINCT doc_id) AS distinct_u FROM documents WHERE text LIKE '%th%' AND text NOT LIKE '%http%' AND source <> '' GROUP BY 1 ORDER BY c DESC, source LIMIT 10""",
    "q23": r"""SELECT event_id, ts, event_type, props FROM events WHERE props LIKE '%7%' ORDER BY ts, event_id LIMIT 10""",
    "q24": r"""SELECT event_type, ts FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 10""",
    "q25": r"""SELECT p_name FROM part WHERE p_name <> '' ORDER BY p_name LIMIT 10""",
    "q26": r"""SELECT event_type, ts FROM events WHERE event_type <> 'error' ORDER BY ts, event_type LIMIT 10""",
    "q27": r"""SELECT lang, CAST(sum(strlen(text)) // count(*) AS BIGINT) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 10 ORDER BY l DESC, lang LIMIT 25""",
    "q28": r"""SELECT regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1', 'g') AS k, CAST(sum(strlen(url)) // count(*) AS BIGINT) AS l, count(*) AS c, min(url) AS min_ref FROM pages WHERE url <> '' GROUP BY 1 HAVING count(*) >= 1 ORDER BY l DESC, k LIMIT 25""",
    "q30": r"""SELECT l_linenumber, l_suppkey, count(*) AS c, CAST(sum(l_partkey) AS BIGINT) AS sum_refresh, CAST(sum(l_partkey) // count(*) AS BIGINT) AS avg_width FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10""",
    "q31": r"""SELECT l_orderkey, l_suppkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS sum_refresh, CAST(sum(l_partkey) // count(*) AS BIGINT) AS avg_width FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10""",
    "q32": r"""SELECT l_orderkey, l_suppkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS sum_refresh, CAST(sum(l_partkey) // count(*) AS BIGINT) AS avg_width FROM lineitem GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10""",
    "q33": r"""SELECT p_type, count(*) AS c FROM part GROUP BY 1 ORDER BY c DESC, p_type LIMIT 10""",
    "q34": r"""SELECT CAST(1 AS BIGINT) AS const_1, p_type, count(*) AS c FROM part GROUP BY 1, 2 ORDER BY c DESC, p_type LIMIT 10""",
    "q35": r"""SELECT p_size, p_size - 1 AS p_size_1, p_size - 2 AS p_size_2, p_size - 3 AS p_size_3, count(*) AS c FROM part GROUP BY 1, 2, 3, 4 ORDER BY c DESC, p_size LIMIT 10""",
    "q36": r"""SELECT l_partkey, count(*) AS PageViews FROM lineitem WHERE l_suppkey = 7 AND CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) <= DATE '1997-12-31' AND l_linenumber <> 7 AND l_linestatus = 'O' AND l_returnflag <> '' GROUP BY 1 ORDER BY PageViews DESC, l_partkey LIMIT 10""",
    "q37": r"""SELECT l_returnflag, count(*) AS PageViews FROM lineitem WHERE l_suppkey = 7 AND CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) <= DATE '1997-12-31' AND l_linestatus = 'O' AND l_returnflag <> '' GROUP BY 1 ORDER BY PageViews DESC, l_returnflag LIMIT 10""",
    "q38": r"""SELECT l_partkey, count(*) AS PageViews FROM lineitem WHERE l_suppkey = 7 AND CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) <= DATE '1998-12-31' AND l_linenumber <> 0 GROUP BY 1 ORDER BY PageViews DESC, l_partkey LIMIT 10 OFFSET 20""",
    "q39": r"""SELECT l_linenumber, l_returnflag, CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN l_linestatus ELSE '' END AS src, l_partkey AS dst, count(*) AS PageViews FROM lineitem WHERE l_suppkey = 7 AND CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) <= DATE '1998-12-31' GROUP BY 1, 2, 3, 4 ORDER BY PageViews DESC, 1, 2, 3, 4 LIMIT 10 OFFSET 20""",
    "q40": r"""SELECT l_partkey, CAST(l_shipdate AS DATE) AS d, count(*) AS PageViews FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) <= DATE '1998-12-31' AND l_linenumber IN (-1, 6) AND l_suppkey = 7 GROUP BY 1, 2 ORDER BY PageViews DESC, 1, 2 LIMIT 10 OFFSET 5""",
    "q41": r"""SELECT p_size, p_brand, count(*) AS PageViews FROM part WHERE p_type = 'ECONOMY' GROUP BY 1, 2 ORDER BY PageViews DESC, 1, 2 LIMIT 10 OFFSET 10""",
    "q42": r"""SELECT date_trunc('minute', ts) AS m, count(*) AS PageViews FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND CAST(ts AS DATE) <= DATE '2024-01-20' AND event_type <> 'error' GROUP BY 1 ORDER BY m LIMIT 10 OFFSET 100""",
    "f_not": r"""SELECT count(*) AS c FROM lineitem WHERE NOT (l_linenumber < 3 OR l_returnflag = 'N')""",
    "f_cmp": r"""SELECT count(*) FILTER (WHERE l_linenumber < 3) AS lt, count(*) FILTER (WHERE l_linenumber <= 3) AS le, count(*) FILTER (WHERE l_linenumber > 3) AS gt, count(*) FILTER (WHERE l_linenumber >= 3) AS ge, count(*) FILTER (WHERE l_linenumber = 3) AS eq, count(*) FILTER (WHERE l_linenumber <> 3) AS ne FROM lineitem""",
    "f_arith": r"""SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS s, l_orderkey * l_partkey AS m, CAST((l_partkey - l_orderkey) // 7 AS BIGINT) AS d FROM lineitem WHERE l_orderkey <= 50""",
    "f_strlen": r"""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents""",
    "f_contains_literal": r"""SELECT count(*) FILTER (WHERE contains(url, '?')) AS q, count(*) FILTER (WHERE NOT contains(url, 'page=')) AS n FROM pages""",
    "f_regex_all": r"""SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS u FROM pages""",
    "f_minute": r"""SELECT event_id, CAST(extract(minute FROM ts) AS SMALLINT) AS m, date_trunc('minute', ts) AS t FROM events""",
    "f_case": r"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS src FROM orders""",
    "a_minmax_types": r"""SELECT min(l_linenumber) AS mn_i32, max(l_orderkey) AS mx_i64, min(l_returnflag) AS mn_s, max(CAST(l_shipdate AS DATE)) AS mx_d, max(l_shipdate) AS mx_ts, min(l_linenumber > 3) AS mn_b FROM lineitem""",
    "a_sum_wide": r"""SELECT CAST(sum(CAST(l_orderkey AS HUGEINT) * 1000000007) AS DECIMAL(38,0)) AS s FROM lineitem""",
    "a_distinct_types": r"""SELECT count(DISTINCT l_shipdate) AS d_ts, count(DISTINCT l_returnflag) AS d_s, count(DISTINCT CAST(l_shipdate AS DATE)) AS d_d FROM lineitem""",
    "o_hconcat": r"""SELECT a.s AS sum_lines, b.c AS n_orders FROM (SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem) a CROSS JOIN (SELECT count(*) AS c FROM orders) b""",
    "o_sort_full": r"""SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey""",
    "o_scan_prune": r"""SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey BETWEEN 10 AND 20""",
    "o_values": r"""SELECT * FROM (VALUES (1::BIGINT, 'abc'), (2, 'qwe'), (3, 'def')) t(a, c)""",
}

SQL["q29"] = "SELECT " + ", ".join(f"CAST(sum(p_size + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM part"
