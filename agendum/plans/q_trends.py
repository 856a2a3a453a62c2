"""Queries over group trends and comparisons."""

from __future__ import annotations

from agendum.operators import trends as T
from agendum.operators.metrics import hourly_pattern
from agendum.plans.common import rounded
from agendum.plans.q_metrics import (HOUR, realtime_scores, score_cte, ticket_metrics_df,
                                     ticket_metrics_sql)
from agendum.plans.registry import query
from agendum.plans.sqlviews import MEETINGS, TICKET_EVENTS, with_views


def trends_df(spark, d, period):
    from agendum.sources import testdata as td
    return rounded(T.group_trends(realtime_scores(spark, d, HOUR), ticket_metrics_df(spark, d, HOUR),
                                  td.meetings(spark, d), period))


def _trends_sql(start: str, step: str) -> str:
    return score_cte(HOUR) + f"""
, tm AS ({ticket_metrics_sql(HOUR)})
, m AS ({MEETINGS})
, j AS (SELECT *, {start} AS period_start FROM rt JOIN tm USING (meeting_id, window_start, window_end)
        JOIN m USING (meeting_id))
, tr AS (SELECT group_id, period_start, period_start + INTERVAL '{step}' AS period_end,
                round(avg(productivity_score), 6) AS avg_productivity,
                round(avg(actionable_items_count), 6) AS avg_actionable_items,
                round(avg(status_updates_count), 6) AS avg_status_updates,
                count(meeting_id) AS meeting_count, count(DISTINCT meeting_id) AS distinct_meetings
         FROM j GROUP BY group_id, period_start)
"""


_WEEK = _trends_sql("time_bucket(INTERVAL '7 days', window_start)", "7 days")
_MONTH = _trends_sql("CAST(date_trunc('month', window_start) AS TIMESTAMP)", "1 month")


@query("group_trends_weekly", sql=_WEEK + "SELECT * FROM tr")
def q_group_trends_weekly(spark, d):
    return trends_df(spark, d, "week")


@query("group_trends_monthly", sql=_MONTH + "SELECT * FROM tr")
def q_group_trends_monthly(spark, d):
    return trends_df(spark, d, "month")


@query("rank_groups", sql=_WEEK + """
SELECT group_id, period_start, avg_productivity,
       CAST(rank() OVER (PARTITION BY period_start ORDER BY avg_productivity DESC) AS INTEGER) AS rank
FROM tr""")
def q_rank_groups(spark, d):
    return T.rank_groups(trends_df(spark, d, "week"))


@query("productivity_decline", sql=_WEEK + """
, l AS (SELECT *, lag(avg_productivity) OVER w AS prev_productivity,
               lag(avg_actionable_items) OVER w AS prev_actionable, lag(meeting_count) OVER w AS prev_meetings
        FROM tr WINDOW w AS (PARTITION BY group_id ORDER BY period_start))
SELECT group_id, period_start, avg_productivity, prev_productivity,
       round(avg_productivity - prev_productivity, 6) AS delta_productivity,
       round(avg_actionable_items - prev_actionable, 6) AS delta_actionable,
       meeting_count - prev_meetings AS delta_meetings
FROM l WHERE avg_productivity < prev_productivity""")
def q_productivity_decline(spark, d):
    return rounded(T.productivity_decline(trends_df(spark, d, "week")))


@query("kpi_change", sql=with_views("""
, daily AS (SELECT CAST(ts AS DATE) AS period, CAST(count(DISTINCT meeting_id) AS DOUBLE) AS meetings,
                   CAST(count(*) AS DOUBLE) AS tickets,
                   CAST(sum(CASE WHEN status <> 'TODO' THEN 1 ELSE 0 END) AS DOUBLE) AS actionable
            FROM te GROUP BY 1)
, s AS (SELECT 'meetings' AS kpi, period, meetings AS value FROM daily
        UNION ALL SELECT 'tickets', period, tickets FROM daily
        UNION ALL SELECT 'actionable', period, actionable FROM daily)
, l AS (SELECT *, lag(value) OVER (PARTITION BY kpi ORDER BY period) AS prev_value FROM s)
SELECT kpi, period, value, prev_value,
       round(CASE WHEN prev_value <> 0 THEN (value - prev_value) / prev_value * 100.0 END, 6) AS pct_change
FROM l""", te=TICKET_EVENTS))
def q_kpi_change(spark, d):
    from agendum.sources import testdata as td
    return rounded(T.kpi_change(T.kpi_series(td.ticket_events(spark, d))))


@query("best_hours", sql=score_cte(HOUR) + """
SELECT CAST(hour(window_start) AS INTEGER) AS hour_of_day, round(avg(productivity_score), 6) AS avg_score,
       count(meeting_id) AS meeting_count, count(DISTINCT meeting_id) AS distinct_meetings
FROM rt GROUP BY ALL ORDER BY avg_score DESC, hour_of_day LIMIT 3""")
def q_best_hours(spark, d):
    return T.best_hours(rounded(hourly_pattern(realtime_scores(spark, d, HOUR))), k=3)
