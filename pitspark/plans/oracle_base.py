"""The same tables as DuckDB common table expressions, for the oracle."""

from pitspark import params

LINES = "lines AS (SELECT l.*, CAST(l_shipdate AS DATE) AS d, s_nationkey AS firm FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey)"
PRICES = LINES + ", prices AS (SELECT firm, d, avg(l_extendedprice / l_quantity) AS px, count(*) AS ntrades FROM lines GROUP BY firm, d)"
ESTIMATES = """ord AS (SELECT o.*, CAST(o_orderdate AS DATE) AS anndats, c_nationkey AS firm, c_name FROM orders o JOIN customer ON o_custkey = c_custkey),
ord2 AS (SELECT *, last_day(CAST(date_trunc('quarter', anndats - 20) AS DATE) + INTERVAL 2 MONTH) AS fpe FROM ord),
estimates AS (SELECT o_orderkey AS row_id, firm, c_name AS cname, o_custkey AS analyst, fpe, anndats,
  CASE o_orderstatus WHEN 'F' THEN anndats WHEN 'O' THEN anndats + 30 END AS revdats,
  CASE WHEN o_orderkey % 5 = 0 THEN anndats + 60 END AS stopdats,
  CAST(6 + o_orderkey % 2 AS INTEGER) AS fpi,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'EPS' ELSE 'SAL' END AS measure,
  o_totalprice AS value,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(fpe + CAST(20 + o_orderkey % 15 AS INTEGER) AS VARCHAR) END AS anndats_act
  FROM ord2)"""
CELLS = ESTIMATES + """, earnings AS (SELECT DISTINCT firm, fpe, CAST(fpe + 20 + firm % 15 AS DATE) AS ed FROM estimates),
cells AS (SELECT *, CAST(ed - 14 AS DATE) AS t FROM earnings)"""
MACRO = "macro AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS d, avg(l_extendedprice / l_quantity) AS oil, count(*) AS rigs FROM lineitem GROUP BY 1)"
FUNDQ_ONLY = """fq AS (SELECT firm, last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) AS datadate, sum(l_extendedprice) AS sp,
  sum(l_extendedprice * l_discount) AS spd, sum(l_extendedprice * l_tax) AS spt, sum(l_quantity) AS sq, sum(l_extendedprice * l_discount * l_tax) AS spdt
  FROM lines GROUP BY 1, 2),
fundq AS (SELECT firm, datadate, CASE WHEN firm % 7 <> 0 THEN datadate + 30 + firm + CASE WHEN month(datadate) = 6 AND firm % 3 = 0 THEN 100 ELSE 0 END END AS rdq,
  sp / 1e6 AS saleq, spd / 1e6 AS oibdpq, (spd - sp * 0.03) / 1e6 AS niq,
  CASE WHEN NOT (month(datadate) = 12 AND firm % 4 = 1) THEN spt / 1e6 END AS oancfy,
  CASE WHEN firm % 9 <> 8 THEN spdt / 1e6 END AS capxy,
  sq / 500 - CASE WHEN firm % 11 = 10 THEN sq ELSE 0 END AS ceqq,
  CASE WHEN firm % 5 <> 0 THEN sp * 0.2 / 1e6 END AS dlttq, spt * 0.1 / 1e6 AS dlcq,
  CASE WHEN firm % 6 <> 0 THEN sq / 1000 END AS cheq FROM fq)"""
FUNDQ = LINES + ", " + FUNDQ_ONLY
PERMITS_ONLY = """pm AS (SELECT l_suppkey, firm, CAST(min(d) + CAST(l_suppkey * 37 % 2000 AS INTEGER) AS DATE) AS permit_date FROM lines GROUP BY 1, 2),
permits AS (SELECT l_suppkey AS pad_id, firm, permit_date, CASE WHEN l_suppkey % 8 <> 3 THEN permit_date + 120 END AS spud_date,
  CASE WHEN l_suppkey % 6 <> 0 THEN permit_date + 300 END AS completion_date,
  31.0::DOUBLE + (l_suppkey % 200) / 100.0::DOUBLE AS lat, -104.0::DOUBLE + ((l_suppkey // 200) % 200) / 100.0::DOUBLE AS lon FROM pm)"""
PERMITS = LINES + ", " + PERMITS_ONLY
SAR = """sar_obs AS (SELECT l_suppkey AS pad_id, l_orderkey * 10 + l_linenumber AS scene_id, CAST(l_shipdate AS DATE) AS acq,
  0.01::DOUBLE + l_discount + l_tax AS vv, 10 * log10(0.01::DOUBLE + l_discount + l_tax) AS vv_db, CASE WHEN l_tax > 0 THEN l_tax / 2 END AS vh FROM lineitem)"""
ARTICLES = "articles AS (SELECT source AS outlet, doc_id AS article_id, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS publish_date, text AS body FROM documents)"
OUTLET_CELLS = """outlet_cells AS (SELECT outlet, fpe, CAST(fpe + 6 AS DATE) AS t, CAST(last_day(fpe - INTERVAL 3 MONTH) + 20 AS DATE) AS prev_ed
  FROM (SELECT DISTINCT source AS outlet FROM documents), (VALUES (DATE '2024-03-31'), (DATE '2024-06-30'), (DATE '2024-09-30'), (DATE '2024-12-31')) q(fpe))"""
NEWS = ARTICLES + ", " + OUTLET_CELLS + ", registry(i, ticker, phrase) AS (VALUES " + ", ".join(f"({i}, '{t}', '{p.lower()}')" for i, (t, p) in enumerate(params.NEWS_PHRASES.items())) + r"""),
named AS (SELECT article_id, publish_date, body, CASE article_id % 12 WHEN 10 THEN 'Diamondbacks Energy' WHEN 11 THEN 'Devon Energetic' ELSE NAMES[CAST(article_id % 12 + 1 AS INTEGER)] END AS name FROM articles),
company_news AS (SELECT article_id, publish_date, coalesce(body, '') || chr(10) || CASE article_id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ' ', ' ' || chr(10)) ELSE name || '''s' END
  || CASE WHEN article_id % 5 = 4 THEN ' oil' ELSE ' Drilling for (oil)' END AS body FROM named),
padded AS (SELECT article_id, publish_date, ' ' || regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS body FROM company_news),
ticker_cells AS (SELECT DISTINCT ticker, fpe, t, prev_ed FROM outlet_cells, registry),
hits AS (SELECT c.ticker, c.fpe, a.article_id, a.publish_date, CAST(row_number() OVER (PARTITION BY c.ticker, c.fpe ORDER BY a.publish_date, a.article_id) AS INTEGER) AS "position" FROM ticker_cells c JOIN registry r USING (ticker)
  JOIN padded a ON a.publish_date BETWEEN c.prev_ed AND c.t AND contains(a.body, ' ' || r.phrase || ' ') AND contains(a.body, ' oil ') AND contains(a.body, ' drilling ') QUALIFY "position" <= 75)""".replace("NAMES", "['" + "', '".join(params.NEWS_PHRASES.values()) + "']")
VERDICTS = """verdicts AS (SELECT o_orderkey AS verdict_id, c_nationkey AS firm, last_day(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE) - 20) AS DATE) + INTERVAL 2 MONTH) AS fpe,
  CASE o_orderstatus WHEN 'F' THEN ' Long ' WHEN 'O' THEN 'BUY' ELSE 'hold' END AS decision,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Strong' WHEN '2-HIGH' THEN ' high' WHEN '3-MEDIUM' THEN 'moderate' WHEN '5-LOW' THEN 'weak' END AS conviction_tier,
  o_totalprice / 250000.0::DOUBLE - 0.1::DOUBLE AS weight, regexp_split_to_array(o_orderpriority, '[-E]') AS evidence,
  o_orderpriority || ', status ' || o_orderstatus AS reasoning, o_custkey % 4 = 0 AS disclosed
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
TRUTH = """truth_labels AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'idle' WHEN quality = 1 THEN 'newly_active' ELSE 'continuously_active' END AS truth,
  CASE n_chars % 3 WHEN 0 THEN 'newly_active' WHEN 1 THEN 'continuously_active' ELSE 'idle' END AS observed FROM documents JOIN labels USING (doc_id))"""
ACTIVE = """, active AS (SELECT c.firm, c.fpe, c.t, e.analyst, e.value, e.anndats, e.row_id FROM cells c JOIN estimates e ON c.firm = e.firm AND c.fpe = e.fpe
  WHERE e.anndats <= c.t AND (e.revdats IS NULL OR e.revdats = e.anndats OR e.revdats > c.t)),
latest AS (SELECT * FROM active QUALIFY row_number() OVER (PARTITION BY firm, fpe, t, analyst ORDER BY anndats DESC, row_id) = 1),
consensus AS (SELECT c.firm, c.fpe, c.t, count(l.value) AS n_analysts, median(l.value) AS median_value, avg(l.value) AS mean_value,
  CASE WHEN count(l.value) > 0 THEN coalesce(stddev_samp(l.value), 0.0) END AS dispersion
  FROM cells c LEFT JOIN latest l ON c.firm = l.firm AND c.fpe = l.fpe AND c.t = l.t GROUP BY c.firm, c.fpe, c.t)"""
