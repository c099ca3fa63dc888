"""The flow from edits to merged rules, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolag.plans import rules_from_edits

from . import data, mined, sql

_LETTER = "substr(change_type, 1, 1)"
_EDIT_HOURS = f"""
{sql.EDITS},
{sql.EVENT_YEARS.strip()},
listed AS (SELECT DISTINCT event_type AS category, 'infobox-' || event_type || plus AS template
           FROM events, (VALUES (''), ('-plus')) marks(plus)),
occ AS (
  SELECT DISTINCT substr(tp, 1, 4) || '-' || substr(tp, 1, 4) AS period, category, template || '_' || property || '_' || key || '_' || {_LETTER} AS change_id, tp
  FROM prop_changes JOIN listed USING (template) WHERE change_type IS NOT NULL)
"""
_PAGES = """
pages AS (SELECT key, arg_max(page_id, place) AS page_id FROM box GROUP BY 1),
names AS (SELECT page_id, max(title) AS page_name FROM box GROUP BY 1)
"""
_BODY, _UNION = mined.sweep_sql(_EDIT_HOURS, mined.HOURLY_POINTS, True, (24,), 0.5).rsplit("SELECT g.period", 1)


def edit_rules(spark, sf):
    """Rules between property changes of each year, merged with the pages of both sides."""
    first, last = data.event_years(spark, sf)
    types = data.table(spark, sf, "events").select("event_type").distinct()
    names = F.array(*[F.concat(F.lit("infobox-"), "event_type", F.lit(plus)) for plus in ("", "-plus")])
    whitelist = types.select(F.col("event_type").alias("category"), F.explode(names).alias("template"))
    found = rules_from_edits(
        data.edits(spark, sf),
        whitelist=whitelist,
        first_year=first,
        last_year=last,
        period_years=1,
        hours_per_day=25,
        min_conf=0.5,
        num_bins=24,
    )
    return mined.flat(
        found.merged.select(
            "period",
            "category",
            "band",
            *[f"{side}{part}" for side in ("antecedent", "consequent") for part in ("", "_page_id", "_page_name")],
            "support",
            "confidence",
            "hist",
        ),
        24,
    )


QUERIES = {"edit_rules": edit_rules}
SQL = {
    "edit_rules": f"""
{_BODY.rstrip()}, {_PAGES},
found AS (SELECT g.period{_UNION})
SELECT period, category, band, antecedent, a.page_id AS antecedent_page_id, an.page_name AS antecedent_page_name,
       consequent, c.page_id AS consequent_page_id, cn.page_name AS consequent_page_name, support, confidence,
       {', '.join(f'bin_{k}' for k in range(24))}
FROM found JOIN pages a ON a.key = split_part(antecedent, '_', -2) JOIN pages c ON c.key = split_part(consequent, '_', -2)
JOIN names an ON an.page_id = a.page_id JOIN names cn ON cn.page_id = c.page_id
"""
}
