"""Rule mining, sweeps, domains, interestingness, merging, clusters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolag.operators import classes, domains, interest, merge, mining, sweep, timeline, validation
from echolag.session import materialize

from . import data, sql

QUERIES = {}
SQL = {}


def query(statement: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if statement is not None:
            SQL[function.__name__] = statement
        return function

    return register


def flat(rules, bins: int):
    """The histogram as columns ``bin_0 …``."""
    others = [c for c in rules.columns if c != "hist"]
    return rules.select(*others, *[F.get("hist", F.lit(k)).alias(f"bin_{k}") for k in range(bins)])


def _int_bins(n: int) -> str:
    return ", ".join(f"CAST(bin_{k} AS INTEGER) AS bin_{k}" for k in range(n))


_DAILY = f"{sql.USER_DAYS.format(change=sql.USER_TYPE)}, {sql.OBSERVED}, {sql.profile(0.05, 0.5)}"


@query(
    f"""
WITH {_DAILY}, {sql.rules(7, 0.9)}
SELECT antecedent, consequent, support, confidence, lift, lift * np AS lift_n, {_int_bins(7)} FROM rules, np
"""
)
def rules_daily(spark, sf):
    """All ordered pairs of (user, event type): which follows which within a week."""
    occurrences = data.user_days(spark, sf)
    points = timeline.observed_domain(occurrences)
    rules = mining.mine_rules(occurrences, points, num_bins=7, min_sup=0.05, max_sup=0.5, min_conf=0.9)
    return flat(rules.withColumn("lift_n", mining.lift_by_domain(F.col("lift"), points.count())), 7)


@query(
    f"""
WITH {sql.USER_DAYS.format(change=sql.USER_TYPE)}, {sql.OBSERVED},
{sql.profile(0.05, 0.6, "split_part(change_id, '_', 2)")}, {sql.rules(7, 0.8, boundary=False, tail=False)}
SELECT g AS event_type, antecedent, consequent, support, confidence, lift, {_int_bins(7)} FROM rules
"""
)
def rules_per_event_type(spark, sf):
    """Pairs within an event type, with every occurrence active and late first matches allowed."""
    occurrences = data.user_days(spark, sf)
    points = timeline.observed_domain(occurrences)
    typed = occurrences.withColumn("event_type", F.substring_index("change_id", "_", -1))
    rules = mining.mine_rules(
        typed,
        points,
        num_bins=7,
        min_sup=0.05,
        max_sup=0.6,
        min_conf=0.8,
        by=["event_type"],
        boundary_expiry=False,
        tail_prune=False,
    )
    return flat(rules, 7)


_HOURLY_WHITELISTED = f"""
{sql.USER_HOURS.format(change="event_type || '_' || user_id")},
{sql.OBSERVED},
wl AS (
  SELECT event_type AS template FROM events GROUP BY event_type
  HAVING sum(CAST(round(value * 100) AS BIGINT)) / count(*)
      >= (SELECT sum(CAST(round(value * 100) AS BIGINT)) / count(*) FROM events)),
np AS (SELECT count(*) AS np FROM tps),
cnt AS (SELECT change_id, count(*) AS n FROM occ GROUP BY 1),
prof AS (
  SELECT '' AS g, change_id, idx, n, np, CAST(ceil(CAST(0.01 AS DOUBLE) * np) AS BIGINT) AS min_abs
  FROM occ JOIN cnt USING (change_id) JOIN tps USING (tp) CROSS JOIN np
  WHERE n >= ceil(CAST(0.01 AS DOUBLE) * np) AND n <= floor(CAST(0.05 AS DOUBLE) * np)
    AND split_part(change_id, '_', 1) IN (SELECT template FROM wl))
"""


@query(
    f"""
WITH {_HOURLY_WHITELISTED}, {sql.rules(24, 0.5)}
SELECT antecedent, consequent, support, confidence, lift, {_int_bins(24)} FROM rules
"""
)
def rules_hourly_whitelisted(spark, sf):
    """Hours as time points, a day as window, and only event types on a whitelist."""
    occurrences = data.user_hours(spark, sf, F.concat_ws("_", "event_type", "user_id"))
    points = timeline.observed_domain(occurrences)
    listed = mining.whitelist_templates(occurrences, data.valued_event_types(spark, sf))
    rules = mining.mine_rules(listed, points, num_bins=24, min_sup=0.01, max_sup=0.05, min_conf=0.5)
    return flat(rules, 24)


def sweep_sql(source: str, points: str, hourly: bool, windows: tuple[int, ...], conf: float) -> str:
    scale = "(CAST(1 AS DOUBLE) / 24)" if hourly else "CAST(1 AS DOUBLE)"
    parts = ", ".join(sql.rules(b, conf, suffix=f"_{b}") for b in windows)
    widest = max(windows)

    def hist(b: int) -> str:
        return ", ".join(f"CAST({f'bin_{k}' if k < b else 'NULL'} AS INTEGER) AS bin_{k}" for k in range(widest))

    unions = " UNION ALL ".join(
        f"SELECT g.period, g.category, g.band, antecedent, consequent, support, confidence, lift, "
        f"CAST({b} AS INTEGER) AS num_bins, {hist(b)} FROM rules_{b}"
        for b in windows
    )
    return f"""
WITH {source}, {points},
sizes AS (SELECT period, count(*) AS np, any_value(days) AS days FROM tps GROUP BY 1),
cnt AS (SELECT period, category, change_id, count(*) AS n FROM occ GROUP BY 1, 2, 3),
bands(band, low, high) AS (VALUES (0, 0.025, 0.05), (1, 0.05, 0.1), (2, 0.1, 0.15), (3, 0.15, 0.2), (4, 0.2, 0.25),
  (5, 0.25, 0.3), (6, 0.3, 0.35), (7, 0.35, 0.4)),
bounds AS (
  SELECT period, np, band,
         CAST(ceil({scale} * (CASE WHEN band = 0 THEN least(CAST(low AS DOUBLE), CAST(20 AS DOUBLE) / days)
                                   ELSE CAST(low AS DOUBLE) END) * np) AS BIGINT) AS least,
         CAST(floor({scale} * CAST(high AS DOUBLE) * np) AS BIGINT) AS most
  FROM sizes, bands),
prof AS (
  SELECT {{'period': o.period, 'category': o.category, 'band': CAST(band AS INTEGER)}} AS g, o.change_id, idx, n, np,
         least AS min_abs
  FROM occ o JOIN cnt c ON o.period = c.period AND o.category = c.category AND o.change_id = c.change_id
  JOIN bounds b ON b.period = o.period AND n >= least AND n <= most
  LEFT JOIN tps t ON t.period = o.period AND t.tp = o.tp),
{parts}
{unions}
"""


_PERIOD_SPAN = f"""
{sql.ORDER_PERIODS.strip()},
occ AS (
  SELECT y || '-' || (y + 3) AS period, r_name AS category, d.change_id, d.tp
  FROM nation_days d JOIN years ON year(tp) BETWEEN y AND y + 3
  JOIN nation ON replace(n_name, '_', '-') = split_part(change_id, '_', 1) JOIN region ON n_regionkey = r_regionkey)
"""
_PERIOD_POINTS = """
tps AS (
  SELECT period, CAST(tp AS DATE) AS tp, row_number() OVER (PARTITION BY period ORDER BY tp) - 1 AS idx,
         count(*) OVER (PARTITION BY period) AS days
  FROM (SELECT y || '-' || (y + 3) AS period,
               unnest(generate_series(make_date(y, 1, 1), make_date(y + 3, 12, 31), INTERVAL 1 DAY)) AS tp FROM years))
"""


@query(sweep_sql(f"{sql.NATION_DAYS}, {_PERIOD_SPAN}", _PERIOD_POINTS, False, (7, 31), 0.3))
def rules_sweep_daily(spark, sf):
    """Orders of a nation by priority: four-year periods × regions × support bands × windows of 7 and 31 days."""
    years = data.order_years(spark, sf)
    split = timeline.split_by_period(data.nation_days(spark, sf), *years, 4)
    points = timeline.period_domain(spark, *years, 4)
    rules = sweep.mine_sweep(split, points, whitelist=data.nation_whitelist(spark, sf), min_conf=0.3)
    return flat(rules, 31)


_HOURLY_SPAN = f"""
{sql.USER_HOURS.format(change="event_type || '_' || user_id").replace('occ AS', 'hours AS')},
{sql.EVENT_YEARS.strip()},
occ AS (SELECT substr(tp, 1, 4) || '-' || substr(tp, 1, 4) AS period, split_part(change_id, '_', 1) AS category, change_id, tp
        FROM hours)
"""
HOURLY_POINTS = """
tps AS (
  SELECT y || '-' || y AS period, strftime(d, '%Y-%m-%d') || 'T' || lpad(CAST(hr AS VARCHAR), 2, '0') AS tp,
         row_number() OVER (PARTITION BY y ORDER BY d, hr) - 1 AS idx,
         date_diff('day', make_date(y, 1, 1), make_date(y, 12, 31)) + 1 AS days
  FROM (SELECT y, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS d FROM event_years),
       (SELECT unnest(generate_series(0, 24)) AS hr))
"""


@query(sweep_sql(_HOURLY_SPAN, HOURLY_POINTS, True, (24,), 0.5))
def rules_sweep_hourly(spark, sf):
    """Hours of each year with 25 hours per day: event types × hourly support bands, window of 24 hours."""
    occurrences = data.user_hours(spark, sf, F.concat_ws("_", "event_type", "user_id"))
    years = data.event_years(spark, sf)
    split = timeline.split_by_period(occurrences, *years, 1)
    points = timeline.period_domain(spark, *years, 1, hours_per_day=25)
    types = data.table(spark, sf, "events").select("event_type").distinct()
    whitelist = types.select(F.col("event_type").alias("category"), F.col("event_type").alias("template"))
    rules = sweep.mine_sweep(split, points, whitelist=whitelist, granularity="h", min_conf=0.5)
    return flat(rules, 24)


# -- domains -----------------------------------------------------------------------------------------------------------

_LOG = """
dom AS (SELECT DISTINCT r_name AS domain, 's' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS table_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query(f"WITH {_LOG} SELECT table_id, max(domain) AS domain FROM dom GROUP BY 1")
def table_domain(spark, sf):
    return domains.table_domain(domains.domain_tables(data.download_log(spark, sf)))


@query(f"WITH {_LOG} SELECT domain, count(*) AS tables FROM dom GROUP BY 1")
def tables_per_domain(spark, sf):
    return domains.tables_per_domain(domains.domain_tables(data.download_log(spark, sf)))


@query(
    f"""
WITH {_LOG}, {sql.USER_DAYS.format(change=sql.PUBLISHER_CHANGE)}, {sql.OBSERVED}, {sql.profile(0.05, 0.4)},
{sql.rules(5, 0.9)}
SELECT antecedent, consequent, support, confidence, lift, a.domain, {_int_bins(5)}
FROM rules JOIN dom a ON a.table_id = substr(antecedent, 1, 9) JOIN dom c ON c.table_id = substr(consequent, 1, 9)
WHERE a.domain = c.domain
"""
)
def rules_same_domain(spark, sf):
    return flat(domain_rules(spark, sf), 5)


def domain_rules(spark, sf):
    occurrences = data.user_days(spark, sf, data.publisher_change())
    rules = mining.mine_classes(
        occurrences, timeline.observed_domain(occurrences), num_bins=5, min_sup=0.05, max_sup=0.4, min_conf=0.9
    )
    tables = domains.table_domain(domains.domain_tables(data.download_log(spark, sf)))
    return domains.same_domain_rules(rules, tables)


# -- interestingness ---------------------------------------------------------------------------------------------------

_SCORED_RULES = f"{sql.USER_DAYS.format(change=sql.USER_TYPE)}, {sql.OBSERVED}, {sql.profile(0.1, 0.4)}, {sql.rules(7, 0.9)}"


def _scored_rules(spark, sf):
    occurrences = data.user_days(spark, sf)
    points = timeline.observed_domain(occurrences)
    rules = mining.mine_rules(occurrences, points, num_bins=7, min_sup=0.1, max_sup=0.4, min_conf=0.9)
    return rules, points.count()


def _scored_classes(spark, sf):
    occurrences = data.user_days(spark, sf)
    points = timeline.observed_domain(occurrences)
    return mining.mine_classes(occurrences, points, num_bins=7, min_sup=0.1, max_sup=0.4, min_conf=0.9), points.count()


def _sample(rules, n_points):
    best_first = F.struct((-F.col("support")).alias("s"), "consequent")
    return interest.sample_rules(rules, n_points, 0.9, 0.1, 0.4, rank=best_first)


_PDF = """
inside AS (
  SELECT *, row_number() OVER (PARTITION BY antecedent ORDER BY support DESC, consequent) AS rn
  FROM rules, np WHERE confidence > 0.9 AND CAST(support AS DOUBLE) / np > CAST(0.1 AS DOUBLE)
                   AND CAST(support AS DOUBLE) / np < CAST(0.4 AS DOUBLE)),
lagged AS (
  SELECT k, sum(CASE k WHEN 0 THEN bin_0 WHEN 1 THEN bin_1 WHEN 2 THEN bin_2 WHEN 3 THEN bin_3 WHEN 4 THEN bin_4
                WHEN 5 THEN bin_5 ELSE bin_6 END) AS c
  FROM inside, (SELECT unnest(generate_series(0, 6)) AS k) WHERE rn = 1 GROUP BY k),
pdf AS (SELECT k, CAST(c AS DOUBLE) / CAST((SELECT sum(c) FROM lagged) AS DOUBLE) AS p FROM lagged)
"""


@query(f"WITH {_SCORED_RULES}, {_PDF} SELECT CAST(k AS INTEGER) AS bin, round(p, 9) AS p FROM pdf")
def general_pdf(spark, sf):
    rules, n_points = _scored_classes(spark, sf)
    pdf = interest.general_pdf(classes.sample_class_rules(rules, n_points, 0.9, 0.1, 0.4), 7)
    return pdf.select("bin", F.round("p", 9).alias("p"))


@query(
    f"""
WITH {_SCORED_RULES}, {_PDF},
long AS (
  SELECT antecedent, consequent, support, k,
         CAST(CASE k WHEN 0 THEN bin_0 WHEN 1 THEN bin_1 WHEN 2 THEN bin_2 WHEN 3 THEN bin_3 WHEN 4 THEN bin_4
              WHEN 5 THEN bin_5 ELSE bin_6 END AS DOUBLE) / support AS q
  FROM rules, np, (SELECT unnest(generate_series(0, 6)) AS k)
  WHERE confidence >= 0.9 AND CAST(support AS DOUBLE) / np >= CAST(0.1 AS DOUBLE)
    AND CAST(support AS DOUBLE) / np <= CAST(0.4 AS DOUBLE))
SELECT antecedent, consequent, row_number() OVER (ORDER BY round(
         sum(0.5 * p * (p / greatest(1e-9, 0.5 * (p + q))) + 0.5 * q * (q / greatest(1e-9, 0.5 * (p + q)))), 6) DESC,
         antecedent, consequent) - 1 AS rank,
       round(sum(0.5 * p * (p / greatest(1e-9, 0.5 * (p + q))) + 0.5 * q * (q / greatest(1e-9, 0.5 * (p + q)))), 6)
         AS score,
       round(sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / greatest(1e-9, 0.5 * (p + q))) ELSE 0 END
                 + CASE WHEN q > 0 THEN 0.5 * q * ln(q / greatest(1e-9, 0.5 * (p + q))) ELSE 0 END), 6) AS divergence
FROM long JOIN pdf USING (k) GROUP BY 1, 2
"""
)
def rule_scores(spark, sf):
    """Score of each rule against the general lag distribution, and the Jensen-Shannon divergence next to it."""
    rules, n_points = _scored_classes(spark, sf)
    general = interest.general_pdf(classes.sample_class_rules(rules, n_points, 0.9, 0.1, 0.4), 7)
    scored = classes.score_class_rules(rules, general, n_points, 0.9, 0.1, 0.4, method=("triangular", "jensen_shannon"))
    rounded = scored.expand().select(
        "antecedent", "consequent", F.round("triangular", 6).alias("score"), F.round("jensen_shannon", 6).alias("divergence")
    )
    return interest.rank_rules(rounded)


def scored_with_general(spark, sf):
    rules, n_points = _scored_rules(spark, sf)
    # the rules are worked out again wherever they are read; this is one row per bin
    general = materialize(interest.general_pdf(_sample(rules, n_points), 7), "general")
    return interest.score_rules(rules, general, n_points, 0.9, 0.1, 0.4), general


_MONTHLY = f"{sql.ORDER_MONTHS}, {sql.OBSERVED}, {sql.profile(0.0, 0.05)}, {sql.rules(3, 0.9)}"
_MONTHLY_PDF = _PDF.replace("CAST(0.1 AS DOUBLE)", "CAST(0.0 AS DOUBLE)").replace("CAST(0.4 AS DOUBLE)", "CAST(0.06 AS DOUBLE)").replace(
    """CASE k WHEN 0 THEN bin_0 WHEN 1 THEN bin_1 WHEN 2 THEN bin_2 WHEN 3 THEN bin_3 WHEN 4 THEN bin_4
                WHEN 5 THEN bin_5 ELSE bin_6 END""",
    "CASE k WHEN 0 THEN bin_0 WHEN 1 THEN bin_1 ELSE bin_2 END",
).replace("generate_series(0, 6)", "generate_series(0, 2)")


def _monthly_classes(spark, sf):
    """Customers' rare order months: few classes of many copies."""
    occurrences = data.order_months(spark, sf)
    points = timeline.observed_domain(occurrences)
    return mining.mine_classes(occurrences, points, num_bins=3, min_sup=0.0, max_sup=0.05, min_conf=0.9), points.count()


@query(f"WITH {_MONTHLY} SELECT count(*) AS rules FROM rules")
def class_rule_count(spark, sf):
    """How many rules there are, without writing any of them out."""
    return classes.count_rules(_monthly_classes(spark, sf)[0])


@query(
    f"""
WITH {_MONTHLY}, {_MONTHLY_PDF},
long AS (
  SELECT antecedent, consequent, k, CAST(CASE k WHEN 0 THEN bin_0 WHEN 1 THEN bin_1 ELSE bin_2 END AS DOUBLE) / support AS q
  FROM rules, (SELECT unnest(generate_series(0, 2)) AS k)),
scores AS (
  SELECT round(sum(0.5 * p * (p / greatest(1e-9, 0.5 * (p + q))) + 0.5 * q * (q / greatest(1e-9, 0.5 * (p + q)))), 6) AS score
  FROM long JOIN pdf USING (k) GROUP BY antecedent, consequent)
SELECT score, count(*) AS rules FROM scores GROUP BY 1
"""
)
def class_score_counts(spark, sf):
    """How many rules have which score, from the scores of classes."""
    rules, n_points = _monthly_classes(spark, sf)
    general = interest.general_pdf(classes.sample_class_rules(rules, n_points, 0.9, 0.0, 0.06), 3)
    return classes.count_scores(classes.score_class_rules(rules, general, n_points, 0.9, 0.0, 0.06))


_GROUP_CHANGE = "'s' || lpad(o_custkey::VARCHAR, 8, '0') || '_' || substr(o_orderpriority, 1, 1)"
_GROUP_MONTHS = f"""
occ AS (SELECT DISTINCT {_GROUP_CHANGE} AS change_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS tp FROM orders)
"""


@query(
    f"""
WITH {_LOG}, {_GROUP_MONTHS}, {sql.OBSERVED}, {sql.profile(0.0, 0.04)}, {sql.rules(3, 0.9)}
SELECT a.domain, count(*) AS rules, sum(support)::BIGINT AS support
FROM rules JOIN dom a ON a.table_id = substr(antecedent, 1, 9) JOIN dom c ON c.table_id = substr(consequent, 1, 9)
WHERE a.domain = c.domain GROUP BY 1
"""
)
def class_rules_per_domain(spark, sf):
    """Rules within a domain, counted by classes split by the domains of their members."""
    change = F.concat(F.format_string("s%08d", "o_custkey"), F.lit("_"), F.substring("o_orderpriority", 1, 1))
    orders = data.table(spark, sf, "orders").select(change.alias("change_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("tp"))
    occurrences = orders.distinct()
    rules = mining.mine_classes(
        occurrences, timeline.observed_domain(occurrences), num_bins=3, min_sup=0.0, max_sup=0.04, min_conf=0.9
    )
    tables = domains.table_domain(domains.domain_tables(data.download_log(spark, sf)))
    kept = classes.same_domain_classes(rules, tables).rules
    pairs = classes.pair_count()
    return kept.groupBy("domain").agg(
        F.sum(pairs).cast("long").alias("rules"), F.sum(pairs * F.col("support")).cast("long").alias("support")
    )


@query(
    f"""
WITH {_SCORED_RULES},
inside AS (
  SELECT *, row_number() OVER (PARTITION BY antecedent ORDER BY md5('42|' || antecedent || '|' || consequent), consequent) AS rn
  FROM rules, np WHERE confidence > 0.9 AND CAST(support AS DOUBLE) / np > CAST(0.1 AS DOUBLE)
                   AND CAST(support AS DOUBLE) / np < CAST(0.4 AS DOUBLE))
SELECT antecedent, consequent, {_int_bins(7)} FROM inside WHERE rn = 1
"""
)
def sampled_rules(spark, sf):
    """One rule per antecedent, drawn by a seeded hash."""
    rules, n_points = _scored_rules(spark, sf)
    return flat(interest.sample_rules(rules, n_points, 0.9, 0.1, 0.4, seed=42), 7)


# -- merging and clusters ----------------------------------------------------------------------------------------------

_MERGED = f"""
{sql.USER_HOURS.format(change=sql.PAGE_CHANGE)}, {sql.OBSERVED}, {sql.profile(0.01, 0.05)}, {sql.rules(24, 0.7)},
merged AS (
  SELECT antecedent, CAST(a.c_nationkey AS VARCHAR) AS antecedent_page_id, an.n_name AS antecedent_page_name,
         consequent, CAST(c.c_nationkey AS VARCHAR) AS consequent_page_id, cn.n_name AS consequent_page_name,
         support, confidence, lift, {sql.bins(24)}
  FROM rules JOIN customer a ON CAST(a.c_custkey AS VARCHAR) = split_part(antecedent, '_', -2)
  JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = split_part(consequent, '_', -2)
  JOIN nation an ON an.n_nationkey = a.c_nationkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey)
"""


def _page_occurrences(spark, sf):
    return data.user_hours(spark, sf, data.page_change())


def page_rules(spark, sf):
    occurrences = _page_occurrences(spark, sf)
    points = timeline.observed_domain(occurrences)
    return mining.mine_rules(occurrences, points, num_bins=24, min_sup=0.01, max_sup=0.05, min_conf=0.7)


def page_classes(spark, sf):
    occurrences = _page_occurrences(spark, sf)
    points = timeline.observed_domain(occurrences)
    return mining.mine_classes(occurrences, points, num_bins=24, min_sup=0.01, max_sup=0.05, min_conf=0.7)


def merged_classes(spark, sf):
    """Rules between classes of one page each, for what asks for pairs and pages only."""
    return classes.merge_classes(page_classes(spark, sf), *data.user_pages(spark, sf), wanted=[])


def merged(spark, sf):
    return merge.merge_rules(page_classes(spark, sf), *data.user_pages(spark, sf))


def merged_set(spark, sf):
    return merge.merge_set(page_classes(spark, sf), *data.user_pages(spark, sf))


@query(
    f"""
WITH {_MERGED}
SELECT antecedent, antecedent_page_id, antecedent_page_name, consequent, consequent_page_id, consequent_page_name,
       support, confidence, lift, {_int_bins(24)} FROM merged
"""
)
def merged_rules(spark, sf):
    return flat(merged(spark, sf), 24)


@query(
    f"""
WITH {_MERGED}, c AS (
  SELECT count(*) AS rules, count(*) FILTER (antecedent_page_id <> consequent_page_id) AS external FROM merged)
SELECT rules, external, CASE WHEN rules = 0 THEN 0 ELSE round(CAST(external AS DOUBLE) / rules * 100, 2) END AS percent
FROM c
"""
)
def external_rate(spark, sf):
    return classes.external_rate(merged_classes(spark, sf))


_DAYS = "list_aggregate(list_sort(list_distinct(list(substr(tp, 1, length(tp) - 3)))), 'string_agg', ',')"


@query(
    f"""
WITH {_MERGED}, days AS (SELECT change_id, {_DAYS} AS days FROM occ GROUP BY 1)
SELECT antecedent, consequent, 'http://en.wikipedia.org/?curid=' || antecedent_page_id AS antecedent_link,
       'http://en.wikipedia.org/?curid=' || consequent_page_id AS consequent_link, support, confidence,
       CAST(support - bin_0 AS DOUBLE) / support AS delayed, a.days AS antecedent_days, c.days AS consequent_days
FROM merged JOIN days a ON a.change_id = antecedent JOIN days c ON c.change_id = consequent
WHERE antecedent_page_id <> consequent_page_id
"""
)
def external_listing(spark, sf):
    listed = merge.list_external(merged_set(spark, sf), _page_occurrences(spark, sf))
    return listed.select(
        "antecedent",
        "consequent",
        "antecedent_link",
        "consequent_link",
        "support",
        "confidence",
        "delayed",
        F.concat_ws(",", "antecedent_days").alias("antecedent_days"),
        F.concat_ws(",", "consequent_days").alias("consequent_days"),
    )


_CLUSTERS = f"""
{_MERGED}, ext AS (SELECT DISTINCT antecedent AS a, consequent AS b FROM merged
                   WHERE antecedent_page_id <> consequent_page_id),
links AS (SELECT a, b FROM ext UNION SELECT b, a FROM ext),
reach(vertex, label) AS (
  SELECT a, a FROM links
  UNION
  SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.vertex WHERE r.label < l.b),
comp AS (SELECT vertex, min(label) AS component FROM reach GROUP BY 1),
pages AS (
  SELECT DISTINCT component, CAST(c_nationkey AS VARCHAR) AS page_id, n_name AS page_name
  FROM comp JOIN customer ON CAST(c_custkey AS VARCHAR) = split_part(vertex, '_', -2)
  JOIN nation ON n_nationkey = c_nationkey)
"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM comp")
def rule_clusters(spark, sf):
    return classes.rule_clusters(merged_classes(spark, sf))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM pages")
def cluster_pages(spark, sf):
    rules = merged_set(spark, sf)
    return merge.cluster_pages(rules, merge.rule_clusters(rules))


@query(
    f"""
WITH RECURSIVE {_CLUSTERS}, sizes AS (SELECT component, count(*) AS size FROM pages GROUP BY 1)
SELECT size, count(*) AS clusters FROM sizes GROUP BY 1
"""
)
def cluster_sizes(spark, sf):
    pages = classes.cluster_pages(merged_classes(spark, sf))
    return merge.cluster_size_counts(merge.cluster_sizes(pages))


@query(
    """
WITH RECURSIVE links AS (
  SELECT DISTINCT a, b FROM (
    SELECT 'c' || o_custkey AS a, 'd' || CAST(o_orderdate AS DATE) || '_' || CAST(floor(o_totalprice) AS BIGINT) % 1000 AS b
    FROM orders)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(vertex, label) AS (
  SELECT a, a FROM both_ways WHERE a LIKE 'c%'
  UNION
  SELECT l.b, r.label FROM reach r JOIN both_ways l ON l.a = r.vertex)
SELECT vertex, min(label) AS component FROM reach GROUP BY 1
"""
)
def order_components(spark, sf):
    """Customers connected by orders of the same day and price ending."""
    from echolag.operators.components import connected_components

    orders = data.table(spark, sf, "orders")
    ending = F.floor("o_totalprice").cast("long") % 1000
    edges = orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("d"), F.to_date("o_orderdate").cast("string"), F.lit("_"), ending.cast("string")).alias("dst"),
    )
    return connected_components(edges)


# -- validation --------------------------------------------------------------------------------------------------------

_LOOSE = sql.rules(7, 0.9, boundary=False, tail=False, suffix="_loose")
_VALIDATED = f"{_DAILY}, {sql.rules(7, 0.9)}, {_LOOSE}"


def _strict_and_loose(spark, sf):
    """Rules under both readings of the window's end; the loose ones serve as expected rules."""
    occurrences = data.user_days(spark, sf)
    points = timeline.observed_domain(occurrences)
    bounds = {"num_bins": 7, "min_sup": 0.05, "max_sup": 0.5, "min_conf": 0.9}
    strict = mining.mine_rules(occurrences, points, **bounds)
    loose = mining.mine_rules(occurrences, points, boundary_expiry=False, tail_prune=False, **bounds)
    return materialize(strict, "strict"), materialize(loose, "loose")


_BINS_EQUAL = " AND ".join(f"l.bin_{k} = r.bin_{k}" for k in range(7))


@query(
    f"""
WITH {_VALIDATED}
SELECT l.antecedent, l.consequent, CAST(CASE WHEN r.support IS NULL THEN 0 ELSE 1 END AS BIGINT) AS found,
       CASE WHEN r.support IS NULL THEN 'count' WHEN l.support <> r.support THEN 'support'
            WHEN l.confidence <> r.confidence THEN 'confidence' WHEN NOT ({_BINS_EQUAL}) THEN 'histogram'
            ELSE 'ok' END AS status
FROM rules_loose l LEFT JOIN rules r ON l.antecedent = r.antecedent AND l.consequent = r.consequent
"""
)
def expected_rules(spark, sf):
    strict, loose = _strict_and_loose(spark, sf)
    return validation.check_injected(strict, loose)


@query(
    f"""
WITH {_VALIDATED}
SELECT antecedent, consequent, support, confidence, lift, {_int_bins(7)} FROM rules
WHERE (antecedent, consequent) IN (SELECT (antecedent, consequent) FROM rules_loose WHERE bin_0 = 0)
"""
)
def unwanted_rules(spark, sf):
    """Rules found among those that should not be: here the ones without an immediate match."""
    strict, loose = _strict_and_loose(spark, sf)
    return flat(validation.check_rejected(strict, loose.where(F.get("hist", F.lit(0)) == 0)), 7)


@query(
    f"""
WITH {_DAILY}, {sql.rules(7, 0.9)},
top AS (SELECT * FROM rules ORDER BY confidence DESC, antecedent, consequent
        LIMIT (SELECT count(*) FROM rules WHERE bin_0 = 0))
SELECT antecedent, consequent, confidence AS score FROM top WHERE bin_0 = 0
"""
)
def expected_in_top(spark, sf):
    """Of the k expected rules (those without an immediate match), the ones among the k best by confidence."""
    occurrences = data.user_days(spark, sf)
    rules = mining.mine_rules(
        occurrences, timeline.observed_domain(occurrences), num_bins=7, min_sup=0.05, max_sup=0.5, min_conf=0.9
    )
    rules = materialize(rules, "rules")
    ranked = rules.select("antecedent", "consequent", F.col("confidence").alias("score"))
    return validation.injected_in_top(ranked, rules.where(F.get("hist", F.lit(0)) == 0))


@query(
    f"""
WITH {sql.USER_DAYS.format(change=sql.USER_TYPE)},
drawn AS (SELECT change_id, row_number() OVER (ORDER BY md5('42|' || change_id), change_id) AS rn, count(*) OVER () AS n
          FROM (SELECT DISTINCT change_id FROM occ))
SELECT change_id, tp FROM occ WHERE change_id IN (SELECT change_id FROM drawn WHERE rn <= n // 2)
"""
)
def drawn_changes(spark, sf):
    """A seeded draw of half of the changes."""
    occurrences = data.user_days(spark, sf)
    half = occurrences.select("change_id").distinct().count() // 2
    return validation.keep_changes(occurrences, half, seed=42)
