"""The cube model over the given tables, as plain SQL for the checks.

``with_views`` prepends every view a query names, directly or through another
view, as a common table expression.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def with_views(sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _needs(VIEWS[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    body = sql.strip()
    for name in _needs(body):
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


view("dim_geo", """
SELECT CAST(81 + r_regionkey AS BIGINT) AS kode, 1 AS niveau, r_name AS titel,
       CAST(NULL AS BIGINT) AS parent_kode, CAST(r_regionkey * 1000 AS BIGINT) AS sekvens FROM region
UNION ALL
SELECT CAST(101 + n_nationkey AS BIGINT), 2, n_name, CAST(81 + n_regionkey AS BIGINT),
       CAST(n_regionkey * 1000 + 1 + n_nationkey AS BIGINT) FROM nation
""")

view("fact_raw", """
SELECT CAST(101 + c_nationkey AS VARCHAR) AS omrade, o_orderstatus AS status,
       CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR) || 'K' || CAST(EXTRACT(QUARTER FROM o_orderdate) AS VARCHAR) AS tid,
       CASE WHEN o_orderkey % 97 = 0 THEN '..'
            ELSE REPLACE(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END AS indhold
FROM orders JOIN customer ON o_custkey = c_custkey
""")

view("fact_clean", """
SELECT omrade, status, tid,
       MAKE_DATE(CAST(SUBSTR(tid, 1, 4) AS BIGINT), CAST(SUBSTR(tid, 6, 1) AS BIGINT) * 3 - 2, 1) AS tid_date,
       CAST(REPLACE(indhold, ',', '.') AS DECIMAL(18,2)) AS indhold
FROM fact_raw WHERE indhold <> '..'
""")

view("fact_cube", """
SELECT COALESCE(omrade, '0') AS omrade, COALESCE(status, 'TOT') AS status, tid, tid_date,
       SUM(indhold) AS indhold
FROM fact_clean GROUP BY CUBE(omrade, status), tid, tid_date
""")

view("fact_supply", """
SELECT CAST(101 + s_nationkey AS VARCHAR) AS omrade,
       CAST(EXTRACT(YEAR FROM l_shipdate) AS VARCHAR) || 'K' || CAST(EXTRACT(QUARTER FROM l_shipdate) AS VARCHAR) AS tid,
       SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS indhold
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
""")

view("order_days", """
SELECT DISTINCT c_nationkey AS n, CAST(o_orderdate AS DATE) AS d,
       CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m
FROM orders JOIN customer ON o_custkey = c_custkey
""")

view("period_codes", """
SELECT DISTINCT 'DAY' || n AS table_id,
       y || 'M' || LPAD(CAST(m AS VARCHAR), 2, '0') || 'D' || LPAD(CAST(DAY(d) AS VARCHAR), 2, '0') AS tid FROM order_days
UNION ALL SELECT DISTINCT 'WEEK' || n, y || 'U' || LPAD(CAST(WEEK(d) AS VARCHAR), 2, '0') FROM order_days
UNION ALL SELECT DISTINCT 'MONTH' || n, y || 'M' || LPAD(CAST(m AS VARCHAR), 2, '0') FROM order_days
UNION ALL SELECT DISTINCT 'QUARTER' || n, y || 'K' || CAST((m + 2) // 3 AS BIGINT) FROM order_days
UNION ALL SELECT DISTINCT 'HALF' || n, y || 'H' || CASE WHEN m <= 6 THEN '1' ELSE '2' END FROM order_days
UNION ALL SELECT DISTINCT 'YEAR' || n, CAST(y AS VARCHAR) FROM order_days
UNION ALL SELECT DISTINCT 'SPLIT' || n, y || '/' || (y + 1) FROM order_days
UNION ALL SELECT DISTINCT 'SPAN' || n, y || ':' || (y + 2) FROM order_days
""")

view("period_lists", """
SELECT table_id, CAST(ROW_NUMBER() OVER (PARTITION BY table_id ORDER BY tid) - 1 AS BIGINT) AS pos, tid FROM period_codes
""")

view("meta_values", """
SELECT table_id, variable, pos, id, label FROM (
  SELECT 'TAB' || n AS table_id, variable, CAST(ROW_NUMBER() OVER (PARTITION BY n, variable ORDER BY id) - 1 AS BIGINT) AS pos, id,
         'label ' || id AS label
  FROM (
    SELECT DISTINCT c_nationkey AS n, 'OMRÅDE' AS variable, c_mktsegment AS id FROM customer
    UNION ALL
    SELECT DISTINCT c_nationkey, 'STATUS', o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT DISTINCT c_nationkey, 'ALDER', CAST(EXTRACT(MONTH FROM o_orderdate) AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT DISTINCT c_nationkey, 'Tid', CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR) || 'K' || CAST(EXTRACT(QUARTER FROM o_orderdate) AS VARCHAR)
    FROM orders JOIN customer ON o_custkey = c_custkey))
""")

view("period_lists_open", """
SELECT table_id, pos, tid FROM period_lists
UNION ALL
SELECT table_id, MAX(pos) + 1, '' FROM period_lists
WHERE CAST(REGEXP_EXTRACT(table_id, '[0-9]+$') AS INTEGER) IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'AFRICA')
GROUP BY table_id
""")

view("frequency_overrides", """
SELECT 'MONTH' || n_nationkey AS table_id, 'weekly' AS frequency FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'AMERICA'
UNION ALL SELECT 'YEAR' || n_nationkey, 'hourly' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'
""")

view("local_periods_held", """
SELECT table_id, tid FROM closed_codes
WHERE CAST(REGEXP_EXTRACT(table_id, '[0-9]+$') AS INTEGER) NOT IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')
""")

view("frequency_of", """
SELECT table_id, CASE
    WHEN regexp_full_match(s, '[0-9]{4}M[0-9]{2}D[0-9]{2}') THEN 'daily'
    WHEN regexp_full_match(s, '[0-9]{4}U[0-9]{2}') THEN 'weekly'
    WHEN regexp_full_match(s, '[0-9]{4}M[0-9]{2}') THEN 'monthly'
    WHEN regexp_full_match(s, '[0-9]{4}K[1-4]') THEN 'quarterly'
    WHEN regexp_full_match(s, '[0-9]{4}H[12]') THEN 'half_yearly'
    WHEN regexp_full_match(s, '[0-9]{4}') THEN 'yearly' ELSE 'other' END AS frequency, s AS sample
FROM (SELECT table_id, ARG_MAX(tid, pos) FILTER (WHERE tid <> '') AS s FROM period_lists_open GROUP BY table_id)
""")

view("picked_periods", """
SELECT l.table_id, l.pos, l.tid, CASE WHEN h.table_id IS NULL THEN 'bootstrap' WHEN p.tid IS NULL THEN 'new' ELSE 'revision' END AS reason
FROM period_lists l
JOIN (SELECT i.table_id, COALESCE(o.frequency, i.frequency) AS frequency FROM frequency_of i
      LEFT JOIN (SELECT * FROM frequency_overrides WHERE frequency = 'weekly') o ON o.table_id = i.table_id) f ON f.table_id = l.table_id
JOIN (SELECT table_id, COUNT(*) AS n FROM period_lists GROUP BY table_id) c ON c.table_id = l.table_id
LEFT JOIN (SELECT DISTINCT table_id FROM local_periods_held) h ON h.table_id = l.table_id
LEFT JOIN local_periods_held p ON p.table_id = l.table_id AND p.tid = l.tid
WHERE h.table_id IS NULL OR p.tid IS NULL OR l.pos >= c.n - CASE f.frequency
  WHEN 'daily' THEN 7 WHEN 'weekly' THEN 4 WHEN 'monthly' THEN 3 ELSE 2 END
""")

view("table_catalog", """
SELECT 'T' || c_custkey AS table_id, CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS updated
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")

view("table_state", """
SELECT 'T' || o_custkey AS table_id, CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS updated, 'quarterly' AS frequency
FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
""")

view("sync_outcomes", """
SELECT c.table_id, c.updated, 'monthly' AS frequency,
       CASE WHEN c.updated IS NOT DISTINCT FROM s.updated THEN 'skipped'
            WHEN k.c_acctbal < 0 THEN 'failed' ELSE 'synced' END AS status
FROM table_catalog c JOIN customer k ON c.table_id = 'T' || k.c_custkey LEFT JOIN table_state s ON s.table_id = c.table_id
""")

view("fact_tables", """
SELECT 'F' || SUBSTR(o_orderpriority, 1, 1) AS table_id, CAST(101 + c_nationkey AS VARCHAR) AS omrade, o_orderstatus AS status,
       CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR) || 'K' || CAST(EXTRACT(QUARTER FROM o_orderdate) AS VARCHAR) AS tid,
       CASE WHEN o_orderkey % 97 = 0 THEN '..'
            ELSE REPLACE(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END AS indhold
FROM orders JOIN customer ON o_custkey = c_custkey
""")

view("fact_tables_clean", """
SELECT table_id, omrade, status, tid,
       CAST(MAKE_DATE(CAST(SUBSTR(tid, 1, 4) AS BIGINT), CAST(SUBSTR(tid, 6, 1) AS BIGINT) * 3 - 2, 1) AS VARCHAR) AS tid_text,
       CAST(REPLACE(indhold, ',', '.') AS DOUBLE) AS indhold
FROM fact_tables WHERE indhold <> '..'
""")

view("table_quarters", """
SELECT table_id, tid, ROW_NUMBER() OVER (PARTITION BY table_id ORDER BY tid DESC) AS rk FROM (SELECT DISTINCT table_id, tid FROM fact_tables)
""")

view("stored_facts", """
SELECT c.* FROM fact_tables_clean c JOIN table_quarters q ON q.table_id = c.table_id AND q.tid = c.tid
WHERE q.rk > 2 AND c.table_id <> 'F3'
""")

view("disk_manifest", """
SELECT table_id, tid FROM table_quarters WHERE table_id <> 'F5' AND NOT (table_id = 'F4' AND rk = 1)
""")

view("changed_quarters", """
SELECT table_id, 4 - rk AS pos, tid,
       CAST(MAKE_DATE(CAST(SUBSTR(tid, 1, 4) AS BIGINT), CAST(SUBSTR(tid, 6, 1) AS BIGINT) * 3 - 2, 1) AS VARCHAR) AS tid_text
FROM table_quarters WHERE rk <= 4
""")

view("reloaded_facts", """
SELECT c.table_id, c.omrade, c.status, c.tid_text, c.indhold + 1 AS indhold
FROM fact_tables_clean c JOIN disk_manifest m ON m.table_id = c.table_id AND m.tid = c.tid
""")

view("period_stored", """
SELECT table_id, pos, tid, tid_form, tid_date, lo, hi,
       CASE WHEN tid_date IS NOT NULL THEN tid_date WHEN lo IS NOT NULL THEN '[' || lo || ',' || hi || ')' ELSE tid END AS tid_text
FROM (SELECT table_id, pos, tid, tid_form,
  CAST(CASE tid_form
    WHEN 'quarter' THEN MAKE_DATE(y, CAST(SUBSTR(tid, 6, 1) AS BIGINT) * 3 - 2, 1)
    WHEN 'day' THEN MAKE_DATE(y, CAST(SUBSTR(tid, 6, 2) AS BIGINT), CAST(SUBSTR(tid, 9, 2) AS BIGINT))
    WHEN 'half' THEN MAKE_DATE(y, CAST(SUBSTR(tid, 6, 1) AS BIGINT) * 6 - 5, 1)
    WHEN 'month' THEN MAKE_DATE(y, CAST(SUBSTR(tid, 6, 2) AS BIGINT), 1)
    WHEN 'year' THEN MAKE_DATE(y, 1, 1) END AS VARCHAR) AS tid_date,
  CASE WHEN tid_form = 'span' THEN CAST(SUBSTR(tid, 1, 4) AS INTEGER) END AS lo,
  CASE WHEN tid_form = 'span' THEN CAST(SUBSTR(tid, 6, 4) AS INTEGER) + 1 END AS hi
FROM (SELECT *, CAST(SUBSTR(tid, 1, 4) AS BIGINT) AS y, CASE
    WHEN table_id LIKE 'QUA%' THEN 'quarter' WHEN table_id LIKE 'DAY%' THEN 'day' WHEN table_id LIKE 'HALF%' THEN 'half'
    WHEN table_id LIKE 'MON%' THEN 'month' WHEN table_id LIKE 'SPAN%' THEN 'span' WHEN table_id LIKE 'YEAR%' THEN 'year'
    ELSE 'text' END AS tid_form FROM period_lists))
""")

view("dims_raw", """
SELECT 'geo' AS dim_id, sekvens, CAST(kode AS VARCHAR) AS kode, niveau, titel FROM dim_geo
UNION ALL SELECT 'gap', sekvens, CAST(kode AS VARCHAR), niveau * 2 - 1, titel FROM dim_geo
UNION ALL SELECT 'amb', CAST(n_nationkey * 2 AS BIGINT), CAST(n_nationkey AS VARCHAR), 1, n_name FROM nation
UNION ALL SELECT 'amb', CAST(n_nationkey * 2 + 1 AS BIGINT), (n_nationkey // 10) || '.' || (n_nationkey % 10), 1, n_name FROM nation
UNION ALL SELECT 'prod', seq, CASE niveau WHEN 1 THEN p_type WHEN 2 THEN p_type || '.' || LPAD(CAST(b AS VARCHAR), 2, '0')
            ELSE p_type || '.' || LPAD(CAST(b AS VARCHAR), 2, '0') || '.' || p_partkey END, niveau, titel FROM part_tree
UNION ALL SELECT 'kn', seq, CASE niveau WHEN 1 THEN CAST(t AS VARCHAR) WHEN 2 THEN t || '.' || LPAD(CAST(b AS VARCHAR), 2, '0')
            ELSE t || '.' || LPAD(CAST(b AS VARCHAR), 2, '0') || '.' || LPAD(CAST(p_partkey AS VARCHAR), 12, '0') END, niveau, titel FROM part_tree
""")

view("part_tree", """
SELECT 3 AS niveau, p_type, t, b, p_partkey, p_name AS titel, (t * 100 + b) * 1000000000 + p_partkey + 1 AS seq FROM part_nodes
UNION ALL SELECT DISTINCT 2, p_type, t, b, 0, p_brand, (t * 100 + b) * 1000000000 FROM part_nodes
UNION ALL SELECT DISTINCT 1, p_type, t, 0, 0, p_type, t * 100 * 1000000000 FROM part_nodes
""")

view("part_nodes", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(ASCII(SUBSTR(p_type, 1, 1)) AS BIGINT) * 26 + ASCII(SUBSTR(p_type, 2, 1)) AS t,
       CAST(REGEXP_EXTRACT(p_brand, '[0-9]+') AS BIGINT) + 1 AS b
FROM part
""")

view("dim_decision", """
SELECT dim_id, BOOL_AND(n_null = 0 AND n_text = n_int) AS kode_is_int FROM (
  SELECT dim_id, niveau, COUNT(DISTINCT kode) AS n_text, COUNT(DISTINCT TRY_CAST(REPLACE(kode, '.', '') AS BIGINT)) AS n_int,
         COUNT(*) FILTER (WHERE TRY_CAST(REPLACE(kode, '.', '') AS BIGINT) IS NULL) AS n_null
  FROM dims_raw GROUP BY dim_id, niveau) GROUP BY dim_id
""")

view("dims_parented", """
SELECT dim_id, sekvens, kode, niveau, titel,
       CASE WHEN niveau = 2 THEN k1 WHEN niveau = 3 AND s2 > COALESCE(s1, -1) THEN k2 END AS parent_kode
FROM (SELECT *,
  LAST_VALUE(CASE WHEN niveau = 1 THEN kode END IGNORE NULLS) OVER w AS k1,
  LAST_VALUE(CASE WHEN niveau = 1 THEN sekvens END IGNORE NULLS) OVER w AS s1,
  LAST_VALUE(CASE WHEN niveau = 2 THEN kode END IGNORE NULLS) OVER w AS k2,
  LAST_VALUE(CASE WHEN niveau = 2 THEN sekvens END IGNORE NULLS) OVER w AS s2
  FROM dims_raw
  WINDOW w AS (PARTITION BY dim_id ORDER BY sekvens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""")

view("dims_clean", """
SELECT p.dim_id, CASE WHEN d.kode_is_int THEN CAST(CAST(REPLACE(p.kode, '.', '') AS BIGINT) AS VARCHAR) ELSE p.kode END AS kode,
       p.niveau, p.titel,
       CASE WHEN d.kode_is_int THEN CAST(CAST(REPLACE(p.parent_kode, '.', '') AS BIGINT) AS VARCHAR) ELSE p.parent_kode END AS parent_kode,
       d.kode_is_int
FROM dims_parented p JOIN dim_decision d ON d.dim_id = p.dim_id
""")

view("age_rows", """
SELECT p_partkey, tab AS table_id, CASE tab
   WHEN 'single' THEN CASE WHEN p_size >= 40 THEN '40-' ELSE CAST(p_size AS VARCHAR) END
   WHEN 'bands' THEN CASE WHEN p_size >= 40 THEN '40OV' ELSE band END
   WHEN 'total' THEN CASE WHEN p_size = 7 THEN 'IALT' ELSE band END
   WHEN 'holes' THEN CASE WHEN p_size = 9 THEN NULL ELSE CAST(p_size AS VARCHAR) END END AS alder
FROM (SELECT p_partkey, p_size, ((p_size // 5) * 5) || '-' || ((p_size // 5) * 5 + 4) AS band FROM part)
CROSS JOIN (SELECT UNNEST(['single', 'bands', 'total', 'holes']) AS tab)
""")

view("fact_links", """
SELECT table_id, column_name, dim_id FROM (SELECT DISTINCT table_id FROM fact_tables)
CROSS JOIN (SELECT 'omrade' AS column_name, 'geo' AS dim_id UNION ALL SELECT 'status', 'states')
""")

view("fact_codes", """
SELECT DISTINCT table_id, 'omrade' AS column_name, omrade AS id FROM fact_tables
UNION ALL SELECT DISTINCT table_id, 'status', status FROM fact_tables
UNION ALL SELECT DISTINCT table_id, 'omrade', '0' FROM fact_tables
""")

view("dims_linked", """
SELECT 'geo' AS dim_id, CAST(kode AS VARCHAR) AS kode, niveau, titel, CAST(parent_kode AS VARCHAR) AS parent_kode FROM dim_geo
UNION ALL SELECT DISTINCT 'states', o_orderstatus, 1, 'state ' || o_orderstatus, NULL FROM orders WHERE o_orderstatus <> 'P'
""")

view("features_raw", """
SELECT CASE c_custkey % 10 WHEN 0 THEN 'kommuner' WHEN 1 THEN 'regioner' WHEN 2 THEN 'landsdele' WHEN 3 THEN 'politikredse' WHEN 4 THEN 'retskredse'
         WHEN 5 THEN 'sogne' WHEN 6 THEN 'postnumre' WHEN 7 THEN 'storkredse' WHEN 8 THEN 'valgkredse' ELSE 'afstemningsomraader' END AS layer,
       c_custkey, CAST(c_custkey + 1000 AS VARCHAR) AS kode, CAST(c_custkey + 2 AS VARCHAR) AS nr, CAST(c_custkey + 3 AS VARCHAR) AS nummer,
       CAST(c_custkey + 4 AS VARCHAR) AS dagi_id, c_name AS navn, 'POINT(' || c_nationkey || ' ' || c_custkey || ')' AS geometry
FROM customer
""")

view("closed_days", """
SELECT DISTINCT c_nationkey AS n, CAST(o_orderdate AS DATE) AS d,
       CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
""")

view("closed_codes", """
SELECT DISTINCT 'DAY' || n AS table_id,
       y || 'M' || LPAD(CAST(m AS VARCHAR), 2, '0') || 'D' || LPAD(CAST(DAY(d) AS VARCHAR), 2, '0') AS tid FROM closed_days
UNION ALL SELECT DISTINCT 'WEEK' || n, y || 'U' || LPAD(CAST(WEEK(d) AS VARCHAR), 2, '0') FROM closed_days
UNION ALL SELECT DISTINCT 'MONTH' || n, y || 'M' || LPAD(CAST(m AS VARCHAR), 2, '0') FROM closed_days
UNION ALL SELECT DISTINCT 'QUARTER' || n, y || 'K' || CAST((m + 2) // 3 AS BIGINT) FROM closed_days
UNION ALL SELECT DISTINCT 'HALF' || n, y || 'H' || CASE WHEN m <= 6 THEN '1' ELSE '2' END FROM closed_days
UNION ALL SELECT DISTINCT 'YEAR' || n, CAST(y AS VARCHAR) FROM closed_days
UNION ALL SELECT DISTINCT 'SPLIT' || n, y || '/' || (y + 1) FROM closed_days
UNION ALL SELECT DISTINCT 'SPAN' || n, y || ':' || (y + 2) FROM closed_days
""")

view("segment_rows", """
SELECT LEFT(c_mktsegment, 1) || LEFT(o_orderpriority, 1) AS table_id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day,
       CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR) || 'K' || CAST(EXTRACT(QUARTER FROM o_orderdate) AS VARCHAR) AS tid,
       REPLACE(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
         || CASE WHEN o_orderpriority LIKE '2%' AND c_mktsegment LIKE 'B%' THEN ' kr' ELSE '' END AS indhold
FROM orders JOIN customer ON o_custkey = c_custkey
""")

view("segment_quarters", """
SELECT table_id, tid, COUNT(*) AS rows, ROW_NUMBER() OVER (PARTITION BY table_id ORDER BY tid DESC) AS rk FROM segment_rows GROUP BY table_id, tid
""")

view("segment_picked", """
SELECT q.* FROM segment_quarters q
WHERE table_id[1] = 'A' OR rk <= CASE WHEN table_id = 'H1' THEN 4 ELSE 2 END
""")

view("segment_outcomes", """
SELECT c.table_id, c.updated, CASE WHEN same THEN 'skipped' WHEN message IS NOT NULL THEN 'failed' ELSE 'synced' END AS status,
       CASE WHEN same THEN 'unchanged' ELSE message END AS reason,
       CASE WHEN same OR c.table_id = 'F5' THEN NULL WHEN c.table_id = 'H1' THEN 'weekly' ELSE 'quarterly' END AS frequency,
       CASE WHEN NOT same AND message IS NULL THEN p.n END AS periods_fetched, CASE WHEN NOT same AND message IS NULL THEN CAST(p.rows AS BIGINT) END AS rows_written,
       CASE WHEN NOT same AND message IS NULL THEN p.n END AS files_written, CASE WHEN NOT same AND message IS NULL THEN c.table_id[1] = 'A' END AS bootstrap
FROM (SELECT table_id, CAST(MAX(day) AS VARCHAR) AS updated, table_id[1] = 'M' AS same FROM segment_rows GROUP BY table_id ORDER BY table_id LIMIT 22) c
LEFT JOIN (SELECT table_id, COUNT(*) AS n, SUM(rows) AS rows FROM segment_picked GROUP BY table_id) p ON p.table_id = c.table_id
LEFT JOIN (SELECT 'F5' AS table_id, 'no period values' AS message
           UNION ALL SELECT r.table_id, MIN('not a measure: ' || indhold) FROM segment_rows r JOIN segment_picked p ON p.table_id = r.table_id AND p.tid = r.tid
           WHERE indhold LIKE '% kr' GROUP BY r.table_id) m ON m.table_id = c.table_id
""")
