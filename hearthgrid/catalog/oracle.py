"""DuckDB statements for the registered queries, written from the definitions of the
operators and not from their Spark plans (long tables and joins, no day vectors, no
prefix sums)."""

from __future__ import annotations

import re

# Shared views. A statement gets the views it names, and those they name.
VIEWS: dict[str, str] = {
    "readings": """
        SELECT CAST(floor(user_id / 30) AS INT) AS household_id,
               CASE event_type WHEN 'click' THEN 'Washing Machine' WHEN 'view' THEN 'Tumble Dryer'
                    WHEN 'purchase' THEN 'Dishwasher' WHEN 'signup' THEN 'Kettle'
                    ELSE 'Television' END AS appliance,
               ts, value * 10 AS watts
        FROM events""",
    "prices": """
        SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(slot AS INT)) AS ts,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
                 / CAST(count(*) * 100000 AS DOUBLE) AS price
        FROM (SELECT o_orderkey % 768 AS slot, o_totalprice FROM orders) GROUP BY slot""",
    "weather": """
        SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(slot AS INT)) AS ts,
               CASE WHEN slot % 11 <> 3 THEN CAST(sum(l_quantity) AS DOUBLE) / count(*) END AS temp,
               CASE WHEN slot % 7 <> 2 THEN CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) END AS dwpt,
               CASE WHEN slot % 13 <> 5 THEN CAST(sum(CAST(round(l_tax * 1000) AS BIGINT)) AS DOUBLE) / count(*) END AS rhum,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 10000 AS DOUBLE) AS wdir,
               CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS wspd
        FROM (SELECT l_orderkey % 768 AS slot, * FROM lineitem) GROUP BY slot""",
    "scores": """
        SELECT l.doc_id, l.quality AS label, round((d.n_chars % 100) / 100.0, 2) AS score
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "quartiles": """
        SELECT household_id, appliance, quantile_cont(watts, 0.25) AS q1,
               quantile_cont(watts, 0.75) AS q3
        FROM readings WHERE watts <> 0 GROUP BY ALL""",
    "bounds": """
        SELECT household_id, appliance, q1, q3, q1 - 1.5 * (q3 - q1) AS lower,
               q3 + 1.5 * (q3 - q1) AS upper FROM quartiles""",
    "cleaned": """
        SELECT r.household_id, r.appliance, r.ts,
               CASE WHEN watts <> 0 AND watts > upper THEN trunc(upper)
                    WHEN watts <> 0 AND watts < lower THEN trunc(lower) ELSE watts END AS watts
        FROM readings r LEFT JOIN bounds b
          ON r.household_id = b.household_id AND r.appliance = b.appliance""",
    "scaled": """
        SELECT *, CASE WHEN mx > mn THEN (watts - mn) / (mx - mn) WHEN watts IS NOT NULL THEN 0 END AS scaled
        FROM (SELECT *, min(watts) OVER (PARTITION BY household_id, appliance) AS mn,
                     max(watts) OVER (PARTITION BY household_id, appliance) AS mx FROM cleaned)""",
    "hours": """
        SELECT household_id, appliance, date_trunc('hour', ts) AS ts, avg(watts) AS watts,
               avg(scaled) AS scaled FROM scaled GROUP BY ALL""",
    "spans": """
        SELECT household_id, min(ts) AS lo, max(ts) AS hi FROM hours GROUP BY household_id""",
    "members": "SELECT DISTINCT household_id, appliance FROM hours",
    "grid": """
        SELECT m.household_id, m.appliance, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
        FROM members m JOIN spans s ON m.household_id = s.household_id""",
    "hourly": """
        SELECT g.household_id, g.appliance, g.ts, coalesce(h.watts, 0) AS watts,
               coalesce(h.scaled, 0) AS scaled
        FROM grid g LEFT JOIN hours h ON g.household_id = h.household_id
          AND g.appliance = h.appliance AND g.ts = h.ts""",
    "activity": """
        SELECT household_id, ts, CAST(max(CASE WHEN scaled > 0.5 THEN 1 ELSE 0 END) AS INT) AS activity
        FROM hourly GROUP BY household_id, ts""",
    "usage": """
        SELECT u.household_id, u.day, u.device, u.usage, a.activity
        FROM (SELECT household_id, CAST(ts AS DATE) AS day, appliance AS device,
                     CAST(max(CASE WHEN scaled > 0.8 THEN 1 ELSE 0 END) AS INT) AS usage
              FROM hourly WHERE appliance IN ('Washing Machine', 'Tumble Dryer', 'Dishwasher')
              GROUP BY ALL) u
        JOIN (SELECT household_id, CAST(ts AS DATE) AS day, max(activity) AS activity
              FROM activity GROUP BY ALL) a ON u.household_id = a.household_id AND u.day = a.day""",
    "device_load": """
        SELECT household_id, appliance AS device, ts,
               CASE WHEN scaled > 0.05 THEN watts ELSE 0 END AS load
        FROM hourly WHERE appliance IN ('Washing Machine', 'Tumble Dryer', 'Dishwasher')""",
    "first_days": """
        SELECT household_id, CAST(min(ts) AS DATE) AS day,
               sum(CASE WHEN CAST(ts AS DATE) = first_day THEN 1 ELSE 0 END) AS n
        FROM (SELECT DISTINCT household_id, ts,
                     CAST(min(ts) OVER (PARTITION BY household_id) AS DATE) AS first_day
              FROM device_load) GROUP BY household_id""",
    "whole_load": """
        SELECT l.* FROM device_load l JOIN first_days f ON l.household_id = f.household_id
        WHERE f.n >= 24 OR CAST(l.ts AS DATE) > f.day""",
    # hours of runs on all data
    "stretches": """
        SELECT *, sum(CASE WHEN load > 0 THEN 0 ELSE 1 END) OVER w AS island,
               lag(load, 1, 0) OVER w AS prev, row_number() OVER w AS rn
        FROM device_load WINDOW w AS (PARTITION BY household_id, device ORDER BY ts)""",
    "run_hours": """
        SELECT household_id, device, start_ts, ts, off, load FROM (
          SELECT *, first_value(ts) OVER w AS start_ts, first_value(rn) OVER w AS start_rn,
                 row_number() OVER w - 1 AS off
          FROM stretches WHERE load > 0
          WINDOW w AS (PARTITION BY household_id, device, island ORDER BY ts))
        WHERE off < 24 AND (start_rn > 1 OR off = 0)""",
    # the same after a partial first day is dropped
    "whole_stretches": """
        SELECT *, sum(CASE WHEN load > 0 THEN 0 ELSE 1 END) OVER w AS island,
               row_number() OVER w AS rn
        FROM whole_load WINDOW w AS (PARTITION BY household_id, device ORDER BY ts)""",
    "whole_run_hours": """
        SELECT household_id, device, start_ts, ts, off, load FROM (
          SELECT *, first_value(ts) OVER w AS start_ts, first_value(rn) OVER w AS start_rn,
                 row_number() OVER w - 1 AS off
          FROM whole_stretches WHERE load > 0
          WINDOW w AS (PARTITION BY household_id, device, island ORDER BY ts))
        WHERE off < 24 AND (start_rn > 1 OR off = 0)""",
    "target_days": "SELECT DISTINCT household_id, device, CAST(ts AS DATE) AS day FROM whole_load",
    "offsets": "SELECT CAST(range AS INT) AS off FROM range(24)",
    "run_counts": """
        SELECT d.household_id, d.device, d.day, count(r.start_ts) AS n_runs
        FROM target_days d LEFT JOIN (SELECT * FROM whole_run_hours WHERE off = 0) r
          ON d.household_id = r.household_id AND d.device = r.device
         AND CAST(r.start_ts AS DATE) < d.day GROUP BY ALL""",
    "profile_sums": """
        SELECT d.household_id, d.device, d.day, r.off, sum(r.load) AS total
        FROM target_days d JOIN whole_run_hours r
          ON d.household_id = r.household_id AND d.device = r.device
         AND CAST(r.ts AS DATE) < d.day GROUP BY ALL""",
    "profiles": """
        SELECT c.household_id, c.device, c.day, c.n_runs, o.off,
               CASE WHEN n_runs > 0 THEN coalesce(total, 0) / n_runs ELSE 0 END AS load
        FROM run_counts c CROSS JOIN offsets o LEFT JOIN profile_sums s
          ON c.household_id = s.household_id AND c.device = s.device AND c.day = s.day
         AND o.off = s.off""",
    "price_days": """
        SELECT d.day, CAST(date_diff('hour', CAST(d.day AS TIMESTAMP), p.ts) AS INT) AS slot, p.ts, p.price
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM prices
              UNION SELECT DISTINCT CAST(ts AS DATE) - 1 FROM prices) d
        JOIN prices p ON p.ts >= d.day AND p.ts < d.day + INTERVAL 2 DAY
        QUALIFY count(*) OVER (PARTITION BY d.day) = 48""",
    "costs": """
        SELECT f.household_id, f.device, f.day, s.off AS start_hour, sum(p.price * f.load) AS cost
        FROM profiles f CROSS JOIN offsets s
        JOIN price_days p ON p.day = f.day AND p.slot = s.off + f.off GROUP BY ALL""",
    "p_activity": """
        SELECT household_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, activity,
               avg(activity) OVER (PARTITION BY household_id, hour(ts) ORDER BY ts
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
        FROM activity""",
    "p_usage": """
        SELECT household_id, device, day, avg(usage) OVER (PARTITION BY household_id, device
               ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM usage""",
    "known_days": """
        SELECT household_id, day FROM p_activity GROUP BY ALL HAVING count(p) = 24""",
    "inputs": """
        SELECT c.household_id, c.device, c.day, u.p AS p_usage,
               CASE WHEN c.day NOT IN (SELECT day FROM price_days) THEN 'missing prices'
                    WHEN k.day IS NULL THEN 'missing activity probability'
                    WHEN u.p IS NULL THEN 'missing usage probability' END AS reason
        FROM run_counts c
        LEFT JOIN p_usage u ON c.household_id = u.household_id AND c.device = u.device AND c.day = u.day
        LEFT JOIN known_days k ON c.household_id = k.household_id AND c.day = k.day""",
    "thresholds": "SELECT unnest([0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]::DOUBLE[]) AS thr",
    "best_hours": """
        SELECT i.household_id, i.device, i.day, t.thr, i.p_usage,
               min_by(c.start_hour, {'c': c.cost, 'h': c.start_hour}) FILTER (WHERE a.p >= t.thr) AS best
        FROM inputs i CROSS JOIN thresholds t
        JOIN costs c ON c.household_id = i.household_id AND c.device = i.device AND c.day = i.day
        JOIN p_activity a ON a.household_id = i.household_id AND a.day = i.day AND a.hour = c.start_hour
        WHERE i.reason IS NULL GROUP BY ALL""",
    "recs": """
        SELECT household_id, device, day, a.thr AS activity_threshold, u.thr AS usage_threshold,
               CAST(coalesce(best, 0) AS INT) AS best_launch_hour,
               CAST(best IS NULL AS INT) AS no_recommend_flag_activity,
               CAST(p_usage < u.thr AS INT) AS no_recommend_flag_usage,
               CAST(CASE WHEN p_usage >= u.thr THEN best END AS INT) AS recommendation
        FROM best_hours a CROSS JOIN thresholds u""",
    "day_starts": """
        SELECT household_id, device, CAST(start_ts AS DATE) AS day, CAST(hour(start_ts) AS INT) AS hour
        FROM run_hours WHERE off = 0""",
    "relevant": """
        SELECT r.household_id, r.device, r.day, r.activity_threshold, r.usage_threshold,
               r.recommendation,
               min_by(s.hour, {'d': coalesce(abs(s.hour - r.recommendation), 0), 'h': s.hour}) AS relevant_start
        FROM recs r LEFT JOIN day_starts s
          ON r.household_id = s.household_id AND r.device = s.device AND r.day = s.day
        GROUP BY ALL""",
    "run_costs": """
        SELECT s.household_id, s.device, s.day, s.hour AS run_hour, h.off AS at_hour,
               sum(r.load * p.price) AS cost
        FROM day_starts s CROSS JOIN offsets h
        JOIN run_hours r ON r.household_id = s.household_id AND r.device = s.device
          AND r.start_ts = CAST(s.day AS TIMESTAMP) + to_hours(s.hour)
        JOIN price_days p ON p.day = s.day AND p.slot = h.off + r.off
        GROUP BY ALL""",
    "evaluated": """
        SELECT r.household_id, r.device, r.day, r.activity_threshold, r.usage_threshold,
               r.recommendation, u.usage * a.activity AS acceptable, r.relevant_start,
               c0.cost AS cost_no_recommendation,
               CASE WHEN r.recommendation IS NULL THEN NULL WHEN r.relevant_start IS NULL THEN 0
                    ELSE c1.cost END AS cost_recommendation
        FROM relevant r
        LEFT JOIN usage u ON u.household_id = r.household_id AND u.device = r.device AND u.day = r.day
        LEFT JOIN activity a ON a.household_id = r.household_id
          AND a.ts = CAST(r.day AS TIMESTAMP) + to_hours(r.recommendation)
        LEFT JOIN run_costs c0 ON c0.household_id = r.household_id AND c0.device = r.device
          AND c0.day = r.day AND c0.run_hour = r.relevant_start AND c0.at_hour = r.relevant_start
        LEFT JOIN run_costs c1 ON c1.household_id = r.household_id AND c1.device = r.device
          AND c1.day = r.day AND c1.run_hour = r.relevant_start AND c1.at_hour = r.recommendation""",
    "savings": """
        SELECT *, cost_no_recommendation - cost_recommendation AS savings,
               (cost_no_recommendation - cost_recommendation) / nullif(cost_no_recommendation, 0)
                 AS relative_savings FROM evaluated""",
    "summary": """
        SELECT household_id, activity_threshold, usage_threshold,
               count(recommendation) AS n_recommendations, avg(acceptable) AS acceptable,
               sum(acceptable * savings) AS total_savings,
               avg(relative_savings) AS relative_savings_mean,
               median(relative_savings) AS relative_savings_median
        FROM savings GROUP BY ALL""",
    "activity_lags": """
        SELECT household_id, ts, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS wd, activity,
               lag(activity, 24) OVER w AS lag24, lag(activity, 48) OVER w AS lag48,
               lag(activity, 72) OVER w AS lag72
        FROM activity WINDOW w AS (PARTITION BY household_id ORDER BY ts)""",
    "surrogates": """
        SELECT p.household_id, l.ts, p.activity AS label, p.p AS model,
               (lag24 + lag48 + lag72) / 3.0 AS surrogate
        FROM p_activity p JOIN activity_lags l ON p.household_id = l.household_id
          AND l.ts = CAST(p.day AS TIMESTAMP) + to_hours(p.hour)
        WHERE p.p IS NOT NULL AND lag72 IS NOT NULL""",
    "last_profiles": """
        SELECT household_id, device, off, load FROM profiles
        QUALIFY day = max(day) OVER (PARTITION BY household_id, device)""",
    "distances": """
        SELECT p.household_id, p.device, p.day,
               sqrt(sum((p.load - l.load) * (p.load - l.load))) / nullif(sqrt(sum(l.load * l.load)), 0) AS distance
        FROM profiles p JOIN last_profiles l ON p.household_id = l.household_id
          AND p.device = l.device AND p.off = l.off GROUP BY ALL""",
    "weather_days": """
        SELECT CAST(ts AS DATE) AS day, avg(temp) AS temp, avg(dwpt) AS dwpt, avg(rhum) AS rhum,
               avg(wdir) AS wdir, avg(wspd) AS wspd FROM weather GROUP BY ALL""",
}


def _named(text: str) -> set[str]:
    return {v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN|IN \(SELECT day FROM)\s+{v}\b", text)}


def statement(body: str) -> str:
    """Put the views a statement needs in front of it, in definition order."""
    needed, todo = set(), _named(body)
    while todo:
        view = todo.pop()
        if view not in needed:
            needed.add(view)
            todo |= _named(VIEWS[view])
    ctes = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed]
    return (f"WITH {', '.join(ctes)} {body}" if ctes else body).strip()
