"""SQL fragments shared by the reference queries."""

USER_DAYS = (
    "occ AS (SELECT DISTINCT {change} AS change_id, CAST(ts AS DATE) AS tp FROM events)"
)
USER_HOURS = (
    "occ AS (SELECT DISTINCT {change} AS change_id, strftime(ts, '%Y-%m-%dT%H') AS tp FROM events)"
)
USER_TYPE = "user_id || '_' || event_type"
PAGE_CHANGE = "'infobox_' || event_type || '_' || user_id || '_u'"
PUBLISHER_CHANGE = "'s' || lpad(CAST(user_id AS VARCHAR), 8, '0') || '_' || event_type"
OBSERVED = (
    "tps AS (SELECT tp, row_number() OVER (ORDER BY tp) - 1 AS idx FROM (SELECT DISTINCT tp FROM occ))"
)
ORDER_DAYS = """
occ AS (SELECT DISTINCT o_custkey || '_' || substr(o_orderpriority, 1, 1) AS change_id, CAST(o_orderdate AS DATE) AS tp
        FROM orders)
"""
# first years of the four-year periods that lie within the orders' years
ORDER_PERIODS = """
years AS (SELECT unnest(generate_series(lo, hi - 3)) AS y FROM (
  SELECT min(year(CAST(o_orderdate AS DATE))) AS lo, max(year(CAST(o_orderdate AS DATE))) AS hi FROM orders))
"""
EVENT_YEARS = """
event_years AS (SELECT unnest(generate_series(lo, hi)) AS y FROM (
  SELECT min(year(ts)) AS lo, max(year(ts)) AS hi FROM events))
"""
ORDER_MONTHS = """
occ AS (SELECT DISTINCT o_custkey || '_' || substr(o_orderpriority, 1, 1) AS change_id,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS tp
        FROM orders)
"""
NATION_DAYS = """
nation_days AS (
  SELECT DISTINCT replace(n_name, '_', '-') || '_' || substr(o_orderpriority, 1, 1) AS change_id,
         CAST(o_orderdate AS DATE) AS tp
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def profile(low: float, high: float, group: str = "''") -> str:
    """``prof(g, change_id, idx, n, np, min_abs)`` from ``occ`` and ``tps``, within the support bounds."""
    return f"""
np AS (SELECT count(*) AS np FROM tps),
cnt AS (SELECT change_id, count(*) AS n FROM occ GROUP BY 1),
prof AS (
  SELECT {group} AS g, change_id, idx, n, np, CAST(ceil(CAST({low} AS DOUBLE) * np) AS BIGINT) AS min_abs
  FROM occ JOIN cnt USING (change_id) LEFT JOIN tps USING (tp) CROSS JOIN np
  WHERE n >= ceil(CAST({low} AS DOUBLE) * np) AND n <= floor(CAST({high} AS DOUBLE) * np))
"""


def rules(bins: int, conf: float, boundary: bool = True, tail: bool = True, suffix: str = "") -> str:
    """``rules(g, antecedent, consequent, support, confidence, lift, bin_0 …)`` from ``prof``."""
    s = suffix
    active = "(rn - run) % 2 = 0" if boundary else "true"
    first = f"AND min(t) <= min(np) - {bins}" if tail else ""
    hist = ", ".join(f"count(*) FILTER (lag = {k}) AS bin_{k}" for k in range(bins))
    return f"""
st{s} AS (
  SELECT *, lag(idx) OVER w AS prev, lead(idx) OVER w AS nxt, row_number() OVER w AS rn
  FROM prof WHERE idx IS NOT NULL WINDOW w AS (PARTITION BY g, change_id ORDER BY idx)),
steps{s} AS (
  SELECT *, coalesce(idx - prev, {bins}) AS gap,
         max(CASE WHEN prev IS NULL OR idx - prev <> {bins} THEN rn END)
           OVER (PARTITION BY g, change_id ORDER BY idx) AS run
  FROM st{s}),
cover{s} AS (
  SELECT g, change_id, n, np, min_abs, idx AS t0,
         unnest(generate_series(idx, least(idx + {bins}, coalesce(nxt, np), np) - 1)) AS t
  FROM steps{s} WHERE {active}),
met{s} AS (
  SELECT a.g, a.change_id AS antecedent, c.change_id AS consequent, a.n AS n_a, c.n AS n_c, a.np, a.min_abs, a.t,
         a.t - a.t0 AS lag
  FROM cover{s} a JOIN steps{s} c
    ON a.g = c.g AND a.t = c.idx AND a.t - a.t0 < c.gap AND a.change_id <> c.change_id
   AND CAST(c.n AS DOUBLE) / a.n >= CAST({conf} AS DOUBLE)),
rules{s} AS (
  SELECT g, antecedent, consequent, count(*) AS support, CAST(count(*) AS DOUBLE) / n_a AS confidence,
         CAST(count(*) AS DOUBLE) / (n_a * n_c) AS lift, {hist}
  FROM met{s} GROUP BY g, antecedent, consequent, n_a, n_c
  HAVING count(*) >= greatest(1, min(min_abs)) AND CAST(count(*) AS DOUBLE) / n_a >= CAST({conf} AS DOUBLE) {first})
"""


def bins(n: int) -> str:
    return ", ".join(f"bin_{k}" for k in range(n))


# a supplier's month as a table; g holds every cell, val is JSON text
SNAPSHOTS = """
cell AS (
  SELECT 's' || l_suppkey AS table_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS v,
         CAST(l_linenumber AS VARCHAR) AS row_id, l_returnflag || l_linestatus AS column_id,
         CASE WHEN max(l_discount) = 0 THEN '"-"' ELSE CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) END AS val
  FROM lineitem GROUP BY 1, 2, 3, 4),
ver AS (
  SELECT table_id, v, lag(v) OVER (PARTITION BY table_id ORDER BY v) AS pv
  FROM (SELECT DISTINCT table_id, v FROM cell)),
att AS (SELECT DISTINCT table_id, v, column_id FROM cell),
rws AS (SELECT DISTINCT table_id, v, row_id FROM cell),
grid AS (
  SELECT r.table_id, r.v, r.row_id, a.column_id, coalesce(c.val, 'null') AS val
  FROM rws r JOIN att a ON r.table_id = a.table_id AND r.v = a.v
  LEFT JOIN cell c ON c.table_id = r.table_id AND c.v = r.v AND c.row_id = r.row_id AND c.column_id = a.column_id),
whole AS (
  SELECT table_id, v, row_id, string_agg(val, '|' ORDER BY column_id) AS txt FROM grid GROUP BY 1, 2, 3)
"""


def field_changes(typed: str = "'update'", where: str = "true") -> str:
    """``fc(date, change_type, table_id, column_id, row_id)`` from ``SNAPSHOTS``; ``where`` filters ``ver``."""
    return f"""
rep AS (SELECT * FROM ver WHERE {where}),
pairs AS (
  SELECT r.table_id, r.v, r.pv, n.row_id, n.txt AS new_txt, o.txt AS old_txt
  FROM rep r JOIN whole n ON n.table_id = r.table_id AND n.v = r.v
  LEFT JOIN whole o ON o.table_id = r.table_id AND o.v = r.pv AND o.row_id = n.row_id),
fc AS (
  SELECT p.v AS date, 'insert' AS change_type, p.table_id, g.column_id, p.row_id
  FROM pairs p JOIN grid g ON g.table_id = p.table_id AND g.v = p.v AND g.row_id = p.row_id
  WHERE p.old_txt IS NULL
  UNION
  SELECT r.v, 'delete', r.table_id, g.column_id, g.row_id
  FROM rep r JOIN grid g ON g.table_id = r.table_id AND g.v = r.pv
  LEFT JOIN rws n ON n.table_id = r.table_id AND n.v = r.v AND n.row_id = g.row_id
  LEFT JOIN att a ON a.table_id = r.table_id AND a.v = r.v AND a.column_id = g.column_id
  WHERE n.row_id IS NULL OR a.column_id IS NULL
  UNION
  SELECT date, change_type, table_id, column_id, row_id FROM (
    SELECT p.v AS date, CASE WHEN o.val IS NULL THEN 'insert' WHEN n.val <> o.val THEN {typed} END AS change_type,
           p.table_id, n.column_id, p.row_id
    FROM pairs p
    JOIN grid n ON n.table_id = p.table_id AND n.v = p.v AND n.row_id = p.row_id
    LEFT JOIN grid o ON o.table_id = p.table_id AND o.v = p.pv AND o.row_id = p.row_id AND o.column_id = n.column_id
    WHERE p.old_txt IS NOT NULL AND p.old_txt <> p.new_txt)
  WHERE change_type IS NOT NULL)
"""


NULL_TYPED = """CASE WHEN n.val IN ('null', '"-"') AND o.val IN ('null', '"-"') THEN NULL
  WHEN n.val IN ('null', '"-"') THEN 'delete' WHEN o.val IN ('null', '"-"') THEN 'insert' ELSE 'update' END"""

# events(date, level, change_type, table_id, item_id) from SNAPSHOTS
ENTITY_EVENTS = """
ev AS (
  SELECT r.v AS date, 'column' AS level, 'insert' AS change_type, r.table_id, a.column_id AS item_id
  FROM ver r JOIN att a ON a.table_id = r.table_id AND a.v = r.v
  LEFT JOIN att o ON o.table_id = r.table_id AND o.v = r.pv AND o.column_id = a.column_id WHERE o.column_id IS NULL
  UNION ALL
  SELECT r.v, 'column', 'delete', r.table_id, a.column_id
  FROM ver r JOIN att a ON a.table_id = r.table_id AND a.v = r.pv
  LEFT JOIN att o ON o.table_id = r.table_id AND o.v = r.v AND o.column_id = a.column_id WHERE o.column_id IS NULL
  UNION ALL
  SELECT r.v, 'row', 'insert', r.table_id, a.row_id
  FROM ver r JOIN rws a ON a.table_id = r.table_id AND a.v = r.v
  LEFT JOIN rws o ON o.table_id = r.table_id AND o.v = r.pv AND o.row_id = a.row_id WHERE o.row_id IS NULL
  UNION ALL
  SELECT r.v, 'row', 'delete', r.table_id, a.row_id
  FROM ver r JOIN rws a ON a.table_id = r.table_id AND a.v = r.pv
  LEFT JOIN rws o ON o.table_id = r.table_id AND o.v = r.v AND o.row_id = a.row_id WHERE o.row_id IS NULL
  UNION ALL
  SELECT v, 'table', 'insert', table_id, NULL FROM ver WHERE pv IS NULL)
"""

# fixed event log as infobox edits; box holds the edits that count
EDITS = """
raw AS (
  SELECT *, user_id || '.' || event_type AS key,
         'p' || user_id || CASE WHEN day(ts) <= 15 THEN 'a' ELSE 'b' END AS page_id,
         'infobox-' || event_type || CASE WHEN value > 50 THEN '-plus' ELSE '' END AS template,
         'Infobox ' || event_type || CASE WHEN value > 50 THEN '_plus' ELSE ' ' END AS raw_template,
         'User ' || user_id || CASE WHEN value > 50 THEN ' (high)' ELSE '' END AS title,
         CASE WHEN value < 20 THEN NULL ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS val
  FROM events),
ordered AS (
  SELECT *, row_number() OVER w AS place, lag(val) OVER w AS old_val, lag(props) OVER w AS old_props
  FROM raw WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
box AS (SELECT * FROM ordered WHERE place > 1),
latest AS (
  SELECT page_id, key, arg_max(template, place) AS latest FROM box GROUP BY 1, 2),
props AS (
  SELECT page_id, key, ts, 'Value-of-entry' AS property, old_val AS old, val AS new FROM box
  UNION ALL
  SELECT page_id, key, ts, 'props', nullif(trim(old_props), ''), nullif(trim(props), '') FROM box),
prop_changes AS (
  SELECT latest AS template, property, p.key, strftime(ts, '%Y-%m-%dT%H') AS tp,
         CASE WHEN old IS NULL AND new IS NOT NULL THEN 'insert' WHEN old IS NOT NULL AND new IS NULL THEN 'delete'
              WHEN old <> new THEN 'update' END AS change_type
  FROM props p JOIN latest l ON p.page_id = l.page_id AND p.key = l.key)
"""
