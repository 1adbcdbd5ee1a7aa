"""DuckDB SQL for every registered query (the correctness oracle), straight from the contracts.

One chain of common tables per query: raw shapes (FIXTURES.md part B), staging, marts,
query. The marts are computed by other means than the Spark plans: months are integers,
neighbouring rows are found by numbering and joining, movements are looked up in a
table, ratios are scalar subqueries per key, medians are read from sorted lists.

* Money stays exact (DECIMAL) and becomes DOUBLE at the end.
* DuckDB divides decimals in floating point, so a half-up rounded ratio uses integers:
  ``round(a/b, k)`` for a >= 0, b > 0 is ``(2 * a * 10^k + b) // (2 * b)`` units of 10^-k.
"""

from __future__ import annotations

import re
import textwrap

from revlens.plans.quality import BROKEN_RULES, RULES  # the rule tables are data

# -- raw shapes (FIXTURES.md part B) ---------------------------------------------------
RAW_CTES = {
    "acct_base": """
        SELECT c.c_custkey AS account_id, c.c_name AS account_name,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Enterprise'
                    WHEN c.c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'Mid-Market'
                    ELSE 'SMB' END AS segment,
               CASE WHEN c.c_acctbal < 2500 THEN '1-50' WHEN c.c_acctbal < 5000 THEN '51-200'
                    WHEN c.c_acctbal < 8000 THEN '201-1000' ELSE '1000+' END AS company_size,
               r.r_name AS region,
               CASE c.c_custkey % 5 WHEN 0 THEN 'Google Ads' WHEN 1 THEN 'LinkedIn'
                    WHEN 2 THEN 'Content Marketing' WHEN 3 THEN 'Events' ELSE 'Referral' END AS acquisition_channel,
               o.first_order AS created_at,
               CASE WHEN c.c_custkey % 50 = 0 THEN 'Inactive' ELSE 'Active' END AS status,
               o.last_order
        FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
        JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
              FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "raw_accounts": """
        SELECT account_id, account_name, segment, company_size, region, acquisition_channel,
               created_at, status FROM acct_base""",
    "raw_users": """
        SELECT user_id, user_id // 3 AS account_id, 'u' || CAST(user_id AS VARCHAR) || '@example.test' AS email,
               CASE user_id % 5 WHEN 0 THEN 'Admin' WHEN 4 THEN 'Viewer' ELSE 'User' END AS role,
               min(ts) AS created_at
        FROM events GROUP BY user_id""",
    "raw_subscriptions": """
        SELECT account_id AS subscription_id, account_id,
               CASE account_id % 4 WHEN 0 THEN 'Starter' WHEN 1 THEN 'Professional'
                    WHEN 2 THEN 'Business' ELSE 'Enterprise' END AS plan_tier,
               CAST(created_at AS DATE) AS start_date,
               CASE WHEN account_id % 7 = 0
                     AND CAST(last_order AS DATE) > CAST(created_at AS DATE) + INTERVAL 90 DAY
                    THEN CAST(last_order AS DATE) END AS end_date,
               CASE WHEN account_id % 7 = 0
                     AND CAST(last_order AS DATE) > CAST(created_at AS DATE) + INTERVAL 90 DAY
                    THEN 'Cancelled' ELSE 'Active' END AS status
        FROM acct_base""",
    "inv_months": """
        SELECT s.account_id, CAST(m.m AS DATE) AS invoice_date
        FROM raw_subscriptions s,
             LATERAL (SELECT unnest(generate_series(
                 CAST(CASE WHEN day(s.start_date) = 1 THEN s.start_date
                           ELSE date_trunc('month', s.start_date) + INTERVAL 1 MONTH END AS TIMESTAMP),
                 CAST(date_trunc('month', coalesce(s.end_date, (SELECT open_end FROM horizon))) AS TIMESTAMP),
                 INTERVAL 1 MONTH)) AS m) m""",
    "raw_invoices": """
        SELECT account_id * 1000 + (year(invoice_date) - 1995) * 12 + month(invoice_date) AS invoice_id,
               account_id AS subscription_id, account_id, invoice_date,
               CAST(CAST(CASE account_id % 4 WHEN 0 THEN 99 WHEN 1 THEN 299 WHEN 2 THEN 799 ELSE 2499 END AS DECIMAL(10,2))
                    * CASE WHEN (account_id * 31 + month(invoice_date) * 17 + year(invoice_date) * 13) % 20 = 0
                           THEN CAST(1.2 AS DECIMAL(2,1)) ELSE CAST(1 AS DECIMAL(2,1)) END AS DOUBLE) AS amount,
               CASE (account_id * 7 + month(invoice_date) * 5 + year(invoice_date) * 3) % 29
                    WHEN 0 THEN 'Failed' WHEN 1 THEN 'Pending' ELSE 'Paid' END AS status
        FROM inv_months""",
    "raw_payments": """
        SELECT invoice_id AS payment_id, invoice_id,
               CAST(invoice_date + CAST(1 + invoice_id % 10 AS INTEGER) AS DATE) AS payment_date, amount,
               CASE invoice_id % 3 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'ACH' ELSE 'Wire Transfer' END AS payment_method
        FROM raw_invoices WHERE status = 'Paid'""",
    "raw_crm_deals": """
        SELECT o.o_orderkey AS deal_id,
               CASE WHEN o.o_orderstatus <> 'O' THEN o.o_custkey END AS account_id,
               CAST(floor(o.o_totalprice) AS BIGINT) AS deal_value,
               CASE o.o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'Closed Lost'
                    WHEN 'P' THEN CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Negotiation'
                        WHEN '2' THEN 'Proposal' WHEN '3' THEN 'SQL' WHEN '4' THEN 'MQL' WHEN '5' THEN 'Lead' END
               END AS stage,
               CAST(o.o_orderdate AS DATE) AS created_date,
               CASE WHEN o.o_orderstatus IN ('F', 'O')
                    THEN CAST(CAST(o.o_orderdate AS DATE) + CAST(20 + o.o_orderkey % 71 AS INTEGER) AS DATE) END AS closed_date,
               CAST(20 + o.o_orderkey % 71 AS BIGINT) AS sales_cycle_days,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Enterprise'
                    WHEN c.c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'Mid-Market'
                    ELSE 'SMB' END AS segment
        FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "raw_product_events": """
        SELECT event_id, user_id, user_id // 3 AS account_id,
               CASE event_type WHEN 'view' THEN 'login' WHEN 'click' THEN 'feature_use'
                    WHEN 'purchase' THEN 'weekly_active'
                    WHEN 'signup' THEN CASE WHEN value >= 120 THEN 'activation' ELSE 'feature_use' END
               END AS event_type,
               ts AS event_timestamp
        FROM events WHERE event_type <> 'error'""",
    "tickets_base": """
        SELECT event_id, user_id, ts,
               CASE WHEN event_id % 20 < 10 THEN 'Low' WHEN event_id % 20 < 16 THEN 'Medium'
                    WHEN event_id % 20 < 19 THEN 'High' ELSE 'Critical' END AS severity,
               CAST(CASE WHEN event_id % 20 < 10 THEN 48 WHEN event_id % 20 < 16 THEN 24
                    WHEN event_id % 20 < 19 THEN 8 ELSE 2 END AS BIGINT) AS sla_hours,
               (event_id * 7919) % 1000 AS h
        FROM events WHERE event_type = 'error'""",
    "raw_support_tickets": """
        SELECT event_id AS ticket_id, user_id // 3 AS account_id,
               CASE event_id % 4 WHEN 0 THEN 'Technical' WHEN 1 THEN 'Billing'
                    WHEN 2 THEN 'Feature Request' ELSE 'Bug Report' END AS category,
               severity, ts AS created_at,
               ts + to_milliseconds(sla_hours * (500 + h) * 3600) AS resolved_at,
               sla_hours,
               ((sla_hours * (500 + h) + 50) // 100) / 10.0 AS resolution_hours,
               h > 500 AS sla_breached
        FROM tickets_base""",
    "raw_marketing_spend": """
        SELECT month,
               CASE bucket WHEN 0 THEN 'Google Ads' WHEN 1 THEN 'LinkedIn' WHEN 2 THEN 'Content Marketing'
                    WHEN 3 THEN 'Events' WHEN 4 THEN 'Referral' ELSE 'Partner' END AS channel,
               CAST(CAST(spend_units AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS spend,
               leads_generated,
               CASE bucket WHEN 0 THEN 'Google Ads' WHEN 1 THEN 'LinkedIn' WHEN 2 THEN 'Content Marketing'
                    WHEN 3 THEN 'Events' WHEN 4 THEN 'Referral' ELSE 'Partner' END
                 || ' ' || strftime(month, '%b %Y') AS campaign_name
        FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_suppkey % 6 AS bucket,
                     sum(floor(l_extendedprice)) AS spend_units, count(*) AS leads_generated
              FROM lineitem GROUP BY 1, 2) t""",
}

# staged name -> (raw name, changed columns)
STAGED = {
    "stg_accounts": ("raw_accounts", {"created_at": "TIMESTAMP"}),
    "stg_users": ("raw_users", {"created_at": "TIMESTAMP"}),
    "stg_subscriptions": ("raw_subscriptions", {"start_date": "DATE", "end_date": "DATE"}),
    "stg_invoices": ("raw_invoices", {"invoice_date": "DATE", "amount": "DECIMAL(18,2)"}),
    "stg_payments": ("raw_payments", {"payment_date": "DATE", "amount": "DECIMAL(18,2)"}),
    "stg_crm_deals": ("raw_crm_deals", {"created_date": "DATE", "closed_date": "DATE"}),
    "stg_product_events": ("raw_product_events", {"event_timestamp": "TIMESTAMP"}),
    "stg_support_tickets": ("raw_support_tickets", {"created_at": "TIMESTAMP", "resolved_at": "TIMESTAMP"}),
    "stg_marketing_spend": ("raw_marketing_spend", {"month": "DATE", "spend": "DECIMAL(18,2)"}),
}
STAGING_CTES = {
    name: f"SELECT * REPLACE ({', '.join(f'{c}::{t} AS {c}' for c, t in casts.items())}) FROM {raw}"
    for name, (raw, casts) in STAGED.items()
}

HORIZON = """
    SELECT make_date(year(min(o_orderdate)), 1, 1) AS first_day,
           make_date(greatest(year(max(o_orderdate)), (SELECT year(max(l_shipdate)) FROM lineitem)), 12, 31) AS last_day,
           date_trunc('month', max(o_orderdate))::DATE AS open_end
    FROM orders"""


def month_no(day: str) -> str:
    """Months since year 0."""
    return f"(year({day}) * 12 + month({day}) - 1)"


def month_of(number: str) -> str:
    return f"make_date(({number} // 12)::INTEGER, ({number} % 12 + 1)::INTEGER, 1)"


def half_up(num: str, den: str, k: int) -> str:
    """Exact ``round(num/den, k)`` for num >= 0, den > 0 integers, as units of 10^-k."""
    return f"((2 * CAST({num} AS HUGEINT) * {10 ** k} + ({den})) // (2 * CAST({den} AS HUGEINT)))"


def half_up_signed(num: str, den: str, k: int) -> str:
    """Exact half-away-from-zero ``round(num/den, k)`` for den > 0 and any sign of num."""
    return f"(sign({num}) * {half_up(f'abs({num})', den, k)})"


def units_dec(units: str, k: int) -> str:
    """Exact DECIMAL value ``units * 10^-k`` (DuckDB multiplies decimals exactly)."""
    if k == 0:
        return f"CAST({units} AS DECIMAL(30,0))"
    return f"(CAST({units} AS DECIMAL(30,0)) * CAST('{10 ** -k:.{k}f}' AS DECIMAL({k + 1},{k})))"


def rate(num: str, den: str, k: int = 3) -> str:
    """``round(num / nullif(den, 0), k)`` as an exact DECIMAL."""
    return f"(CASE WHEN ({den}) <> 0 THEN {units_dec(half_up(num, den, k), k)} END)"


def cents(x: str) -> str:
    """Exact integer cents of a 2-decimal money value."""
    return f"CAST(({x}) * 100 AS HUGEINT)"


def list_median(values: str) -> str:
    """Median read from the sorted list of the non-null values."""
    s = f"list_sort(list({values}) FILTER (WHERE {values} IS NOT NULL))"
    low, high = f"{s}[(len({s}) + 1) // 2]", f"{s}[len({s}) // 2 + 1]"
    return f"({low} + ({high} - {low}) * 0.5::DOUBLE)"


MART_CTES = {
    "dim_date": "SELECT d::DATE AS date FROM horizon, generate_series(first_day::TIMESTAMP, last_day::TIMESTAMP, INTERVAL 1 DAY) g(d)",
    # accounts with a subscription, then those without
    "dim_account": """
        SELECT a.*, s.plan_tier AS current_plan_tier, s.start_date AS subscription_start_date,
               (coalesce(s.status, '') = 'Active')::INTEGER AS is_active_subscriber
        FROM stg_subscriptions s, stg_accounts a WHERE s.account_id = a.account_id
        UNION ALL
        SELECT a.*, NULL, NULL, 0 FROM stg_accounts a ANTI JOIN stg_subscriptions s ON s.account_id = a.account_id""",
    # month numbers of each subscription: those up to its last less those before its first
    "sub_months_no": f"""
        SELECT account_id, subscription_id, end_date, unnest(list_filter(
                   range({month_no('first_day')}::BIGINT, {month_no('last_day')}::BIGINT + 1),
                   lambda m: m >= {month_no('start_date')}
                         AND m <= coalesce({month_no('end_date')}, {month_no('open_end')}))) AS m
        FROM stg_subscriptions, horizon""",
    "sub_months": f"SELECT account_id, subscription_id, {month_of('m')} AS revenue_month, end_date FROM sub_months_no",
    "paid_no": f"""
        SELECT account_id, {month_no('invoice_date')} AS m, sum(amount) AS paid
        FROM stg_invoices WHERE status = 'Paid' GROUP BY ALL""",
    # each active row brings the account's paid total of its month
    "month_no_mrr": """
        SELECT s.account_id, s.m, sum(coalesce(p.paid, 0)) AS mrr, max(s.end_date) AS subscription_end_date,
               row_number() OVER (PARTITION BY s.account_id ORDER BY s.m) AS k
        FROM sub_months_no s LEFT JOIN paid_no p ON (p.account_id, p.m) = (s.account_id, s.m)
        GROUP BY s.account_id, s.m""",
    "rev_monthly": f"""
        SELECT account_id, {month_of('m')} AS revenue_month, mrr::DECIMAL(38,2) AS mrr, subscription_end_date
        FROM month_no_mrr""",
    "neighbours": """
        SELECT x.account_id, x.m, x.mrr, x.subscription_end_date, b.mrr AS before_mrr, a.mrr AS after_mrr,
               b.k IS NULL AS is_first, a.k IS NULL AS is_last
        FROM month_no_mrr x
        LEFT JOIN month_no_mrr b ON b.account_id IS NOT DISTINCT FROM x.account_id AND b.k + 1 = x.k
        LEFT JOIN month_no_mrr a ON a.account_id IS NOT DISTINCT FROM x.account_id AND a.k - 1 = x.k""",
    "movement": """
        SELECT * FROM (VALUES (1, false, 'expansion'), (1, true, 'expansion'), (-1, false, 'contraction'),
                              (-1, true, 'contraction'), (0, true, 'churned'), (0, false, 'maintained')) v(direction, ends, label)""",
    "fct_revenue_monthly": f"""
        SELECT {month_of('n.m')} AS revenue_month, n.account_id, n.mrr::DECIMAL(38,2) AS mrr,
               (n.mrr * 12)::DECIMAL(38,2) AS arr, p.was::DECIMAL(38,2) AS prior_month_mrr,
               p.diff::DECIMAL(38,2) AS revenue_change, t.label AS revenue_type,
               (CASE t.label WHEN 'new' THEN n.mrr ELSE 0 END)::DECIMAL(38,2) AS new_mrr,
               (CASE t.label WHEN 'expansion' THEN p.diff ELSE 0 END)::DECIMAL(38,2) AS expansion_mrr,
               (CASE t.label WHEN 'contraction' THEN p.diff ELSE 0 END)::DECIMAL(38,2) AS contraction_mrr,
               (CASE t.label WHEN 'churned' THEN p.was ELSE 0 END)::DECIMAL(38,2) AS churned_mrr,
               CASE WHEN p.was > 0
                    THEN (n.mrr - p.was + CASE t.label WHEN 'expansion' THEN p.diff WHEN 'contraction' THEN -p.diff ELSE 0 END)::DOUBLE
                         / p.was::DOUBLE END AS nrr
        FROM neighbours n
        CROSS JOIN LATERAL (SELECT coalesce(n.before_mrr, 0) AS was, abs(n.mrr - coalesce(n.before_mrr, 0)) AS diff) p
        CROSS JOIN LATERAL (
            SELECT coalesce(max(v.label), 'new') AS label FROM movement v
            WHERE NOT n.is_first AND v.direction = sign(n.mrr - n.before_mrr)
              AND v.ends = (n.is_last AND n.subscription_end_date IS NOT NULL)) t
        WHERE n.mrr > 0 OR t.label = 'churned'""",
    "fct_pipeline": f"""
        SELECT g.*, {rate("(w.x).won", "(w.x).won + (w.x).lost")} AS win_rate,
               CASE WHEN (w.x).won + (w.x).lost > 0 THEN (w.x).won END AS won_deals,
               CASE WHEN (w.x).won + (w.x).lost > 0 THEN (w.x).lost END AS lost_deals
        FROM (SELECT segment, stage, count(*) AS deal_count, sum(deal_value)::DOUBLE / count(deal_value) AS avg_deal_value,
                     sum(deal_value)::BIGINT AS total_deal_value,
                     sum(sales_cycle_days)::DOUBLE / count(sales_cycle_days) AS avg_sales_cycle_days
              FROM stg_crm_deals GROUP BY ALL) g
        CROSS JOIN LATERAL (
            SELECT {{'won': count(*) FILTER (d.stage = 'Closed Won'), 'lost': count(*) FILTER (d.stage = 'Closed Lost')}} AS x
            FROM stg_crm_deals d WHERE d.segment = g.segment) w""",
    "user_activation": """
        SELECT DISTINCT u.user_id, u.account_id, u.created_at AS user_created_at,
               (SELECT e.event_timestamp FROM stg_product_events e
                WHERE e.user_id = u.user_id AND e.event_type = 'activation'
                ORDER BY e.event_timestamp LIMIT 1) AS activation_timestamp
        FROM stg_users u""",
    "fct_activation": f"""
        SELECT a.account_id, da.segment, da.acquisition_channel, a.total_users, a.activated_users,
               {rate('a.activated_users', 'a.total_users')} AS activation_rate,
               round(a.med::DECIMAL(38,10), 1) AS median_days_to_activate
        FROM (SELECT account_id, count(*) AS total_users, count(days) AS activated_users, {list_median('days')} AS med
              FROM (SELECT account_id, date_diff('microsecond', user_created_at, activation_timestamp)::DOUBLE
                                       / 86400000000::DOUBLE AS days FROM user_activation)
              GROUP BY account_id) a, dim_account da
        WHERE da.account_id = a.account_id""",
    "account_cohorts": "SELECT account_id, date_trunc('month', created_at)::DATE AS cohort_month FROM stg_accounts",
    "cohort_activity": """
        SELECT c.cohort_month, i.account_id, i.amount AS revenue,
               (date_diff('day', c.cohort_month, date_trunc('month', i.invoice_date)::DATE) / 30).floor()::INTEGER AS months_since_cohort
        FROM stg_invoices i, account_cohorts c WHERE i.account_id = c.account_id AND i.status = 'Paid'""",
    # for every cohort and bucket seen: the accounts of the cohort with a payment in it
    "fct_retention": f"""
        SELECT g.cohort_month, z.cohort_size, g.months_since_cohort, g.active AS active_accounts, g.revenue AS cohort_revenue,
               {rate('g.active', 'z.cohort_size')} AS retention_rate, 1 - {rate('g.active', 'z.cohort_size')} AS churn_rate
        FROM (SELECT cohort_month, months_since_cohort, sum(revenue) AS revenue,
                     len(list_distinct(list(account_id))) + (count(*) > count(account_id))::INTEGER AS active
              FROM cohort_activity GROUP BY ALL) g
        CROSS JOIN LATERAL (SELECT count(*) AS cohort_size FROM account_cohorts c WHERE c.cohort_month = g.cohort_month) z""",
    "fct_support": f"""
        SELECT s.account_id, da.segment, da.region, s.total_tickets, s.critical_tickets, s.high_tickets, s.sla_breached_tickets,
               {rate('s.sla_breached_tickets', 's.total_tickets')} AS sla_breach_rate,
               CASE WHEN s.n > 0 THEN {units_dec(half_up('s.fine', "s.n * 10000000000::HUGEINT", 1), 1)} END AS avg_resolution_hours,
               round(s.med::DECIMAL(38,10), 1) AS median_resolution_hours,
               (s.total_tickets * 100)::DECIMAL(20,2) AS tickets_per_100_accounts
        FROM (SELECT account_id, count(*) AS total_tickets, count(*) FILTER (severity = 'Critical') AS critical_tickets,
                     count(*) FILTER (severity = 'High') AS high_tickets, count(*) FILTER (sla_breached) AS sla_breached_tickets,
                     count(resolution_hours) AS n, {list_median('resolution_hours')} AS med,
                     (sum(resolution_hours::DECIMAL(28,10)) * 10000000000)::HUGEINT AS fine
              FROM stg_support_tickets GROUP BY account_id) s, dim_account da
        WHERE da.account_id = s.account_id""",
    # paid invoices counted per account, accounts folded per channel
    "channel_attribution": """
        SELECT acquisition_channel, sum(p.n)::BIGINT AS accounts_acquired, sum(p.total) AS total_revenue
        FROM stg_accounts a, (SELECT account_id, count(*) AS n, sum(amount) AS total FROM stg_invoices
                              WHERE status = 'Paid' GROUP BY account_id) p
        WHERE p.account_id = a.account_id GROUP BY acquisition_channel""",
    "channel_facts": f"""
        SELECT channel, max(spent) AS total_spend, max(leads) AS total_leads, max(n) AS n, max(rev) AS rev,
               {cents('max(spent)')} AS sp_c, {cents('max(rev)')} AS rev_c
        FROM (SELECT channel, sum(spend) AS spent, sum(leads_generated)::BIGINT AS leads, NULL AS n, NULL AS rev
              FROM stg_marketing_spend GROUP BY channel
              UNION ALL
              SELECT acquisition_channel, NULL, NULL, accounts_acquired, total_revenue FROM channel_attribution
              WHERE acquisition_channel IS NOT NULL)
        GROUP BY channel HAVING count(leads) > 0""",
    "channel_units": f"""
        SELECT *, CASE WHEN n > 0 THEN {half_up('sp_c', 'n', 0)} END AS cac_c, CASE WHEN n > 0 THEN {half_up('rev_c', 'n', 0)} END AS ltv_c
        FROM channel_facts""",
    "fct_cac_ltv": f"""
        SELECT channel, total_spend, total_leads, ifnull(n, 0) AS accounts_acquired, ifnull(rev, 0) AS total_revenue,
               {units_dec('cac_c', 2)} AS cac, {units_dec('ltv_c', 2)} AS rough_ltv,
               CASE WHEN sp_c > 0 THEN {units_dec(half_up('rev_c', 'sp_c', 2), 2)} END AS roas,
               CASE WHEN n > 0 AND sp_c > 0 THEN {units_dec(half_up('rev_c', 'sp_c', 1), 1)} END AS ltv_cac_ratio,
               CASE WHEN least(cac_c, ltv_c) > 0 AND ltv_c IS NOT NULL THEN {units_dec(half_up('20 * cac_c', 'ltv_c', 1), 1)} END AS cac_payback_months
        FROM channel_units""",
    "monthly_metrics": """
        SELECT revenue_month AS metric_month, u.name AS metric_name, sum(u.value) AS metric_value
        FROM fct_revenue_monthly,
             LATERAL (SELECT unnest(['MRR', 'Churned MRR', 'New MRR']) AS name, unnest([mrr, churned_mrr, new_mrr]) AS value) u
        GROUP BY ALL""",
    "metric_changes": f"""
        SELECT x.metric_month, x.metric_name, x.metric_value, y.metric_value AS prev_month_value,
               CASE WHEN y.metric_value > 0 THEN
                    {half_up_signed('(' + cents('x.metric_value') + ' - ' + cents('y.metric_value') + ') * 100', cents('y.metric_value'), 2)} END AS pct_units
        FROM monthly_metrics x ASOF LEFT JOIN monthly_metrics y
          ON x.metric_name = y.metric_name AND x.metric_month > y.metric_month""",
    "fct_anomalies": f"""
        SELECT metric_month, metric_name, metric_value, prev_month_value, {units_dec('pct_units', 2)} AS pct_change,
               ['Moderate Change', 'High Change'][1 + (abs(pct_units) > 2000)::INTEGER] AS anomaly_severity,
               ['Drop', 'Normal', 'Spike'][2 + (pct_units > 2000)::INTEGER - (pct_units < -2000)::INTEGER] AS anomaly_type
        FROM metric_changes WHERE abs(pct_units) > 1000""",
    "paid_by_month": f"""
        SELECT x.account_id, {month_of('x.m')} AS month, x.paid, y.paid AS prev_paid
        FROM paid_no x ASOF LEFT JOIN paid_no y ON x.account_id = y.account_id AND x.m > y.m""",
    "filter_values": """
        SELECT DISTINCT u.dimension, u.value FROM dim_account,
               LATERAL (SELECT unnest(['segment', 'region', 'acquisition_channel']) AS dimension,
                               unnest([segment, region, acquisition_channel]) AS value) u
        WHERE u.value IS NOT NULL""",
    "recent_anomalies": """
        SELECT * FROM fct_anomalies QUALIFY row_number() OVER (ORDER BY metric_month DESC, abs(pct_change) DESC, metric_name) <= 50""",
}


def with_ctes(body: str, ctes: dict[str, str]) -> str:
    """``WITH`` the tables that ``body`` needs, directly or through others, followed by ``body``."""
    needed, texts = set(), [body]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        texts += [ctes[name] for name in words & ctes.keys() - needed]
        needed |= words & ctes.keys()
    parts = [f"{name} AS (\n{textwrap.dedent(sql).strip()}\n)" for name, sql in ctes.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + textwrap.dedent(body).strip()


ALL_CTES = {"horizon": HORIZON} | RAW_CTES | STAGING_CTES | MART_CTES


def q(body: str) -> str:
    return with_ctes(body, ALL_CTES)


DIM_DATE_SQL = """
    SELECT CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
           CAST(quarter(d) AS INTEGER) AS quarter, CAST(day(d) AS INTEGER) AS day,
           CAST(dayofweek(d) AS INTEGER) AS day_of_week,
           rpad(strftime(d, '%B'), 9, ' ') AS month_name, rpad(strftime(d, '%A'), 9, ' ') AS day_name,
           CAST(week(d) AS INTEGER) AS week_of_year,
           CAST(date_trunc('month', d) AS DATE) AS month_start_date, last_day(CAST(d AS DATE)) AS month_end_date,
           CAST(date_trunc('quarter', d) AS DATE) AS quarter_start_date, CAST(dayofyear(d) AS INTEGER) AS day_of_year
    FROM calendar_days"""


def as_double(table: str, columns: list[str]) -> str:
    """``SELECT *`` with the decimal columns turned into doubles."""
    return f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in columns)}) FROM {table}" if columns else f"FROM {table}"


def weights(segment=None, region=None, channel=None) -> str:
    """account_id, da_segment, da_region, w: how many dimension rows of each account are chosen."""
    chosen = {"segment": segment, "region": region, "acquisition_channel": channel}
    where = " AND ".join(f"{c} = '{v}'" for c, v in chosen.items() if v) or "true"
    return f"""(SELECT account_id, segment AS da_segment, region AS da_region, count(*) AS w
                FROM dim_account WHERE {where} GROUP BY ALL)"""


def weighted_mean(x: str) -> str:
    return f"(sum({x} * w)::DOUBLE / nullif(sum(w) FILTER ({x} IS NOT NULL), 0)::DOUBLE)"


def mean(x: str) -> str:
    return f"(sum({x})::DOUBLE / nullif(count({x}), 0)::DOUBLE)"


def earlier(value: str) -> str:
    """The cells of negative buckets as text, ``bucket:value`` in order of the bucket; null without any."""
    return f"string_agg(months_since_cohort || ':' || ({value})::DECIMAL(38,1), ',' ORDER BY months_since_cohort) FILTER (months_since_cohort < 0)"


LATEST = "(SELECT revenue_month FROM fct_revenue_monthly ORDER BY revenue_month DESC LIMIT 1)"


def kpis(**chosen) -> str:
    a = weights(**chosen)
    return f"""
        SELECT r.*, x.avg_activation_rate, c.avg_cac, ifnull(r.avg_nrr * 100, 0.0) AS nrr_pct,
               ifnull(x.avg_activation_rate * 100, 0.0) AS activation_pct
        FROM (SELECT sum(mrr * w)::DOUBLE AS current_mrr, sum(arr * w)::DOUBLE AS current_arr,
                     round(avg(ifnull(nrr, 0.0)), 10) + 0.0 AS avg_nrr, sum(churned_mrr * w)::DOUBLE AS churned_mrr,
                     count(DISTINCT account_id) AS active_accounts
              FROM fct_revenue_monthly JOIN {a} USING (account_id), range(w) copies WHERE revenue_month = {LATEST}) r,
             (SELECT {weighted_mean('activation_rate')} AS avg_activation_rate
              FROM (SELECT account_id, activation_rate FROM fct_activation) JOIN {a} USING (account_id)) x,
             (SELECT {mean('cac')} AS avg_cac FROM fct_cac_ltv) c"""


def mrr_trend(**chosen) -> str:
    sums = ", ".join(f"sum({c} * w)::DOUBLE AS {n}" for n, c in
                     [("total_mrr", "mrr"), ("new_mrr", "new_mrr"), ("expansion_mrr", "expansion_mrr"), ("churned_mrr", "churned_mrr")])
    return f"SELECT revenue_month, {sums} FROM fct_revenue_monthly JOIN {weights(**chosen)} USING (account_id) GROUP BY ALL"


def segment_revenue(**chosen) -> str:
    return f"""
        SELECT da_segment AS segment, sum(mrr * w)::DOUBLE AS total_mrr
        FROM fct_revenue_monthly JOIN {weights(**chosen)} USING (account_id) WHERE revenue_month = {LATEST} GROUP BY ALL"""


def activation_vs_retention(**chosen) -> str:
    return f"""
        SELECT x.segment, {weighted_mean('x.activation_rate')} AS avg_activation, {weighted_mean('r.retention_rate')} AS avg_retention
        FROM fct_activation x JOIN {weights(**chosen)} USING (account_id), stg_accounts a, fct_retention r
        WHERE a.account_id = x.account_id AND r.months_since_cohort = 6 AND r.cohort_month = date_trunc('month', a.created_at)::DATE
        GROUP BY x.segment"""


def support_summary(**chosen) -> str:
    return f"""
        SELECT sum(total_tickets * w)::BIGINT AS total_tickets, {weighted_mean('sla_breach_rate')} AS avg_sla_breach_rate,
               {weighted_mean('avg_resolution_hours')} AS avg_resolution_hours
        FROM fct_support JOIN {weights(**chosen)} USING (account_id)"""


def tickets_by_segment(**chosen) -> str:
    return f"""
        SELECT da_segment AS segment, sum(total_tickets * w)::BIGINT AS tickets, sum(critical_tickets * w)::BIGINT AS critical,
               sum(high_tickets * w)::BIGINT AS high
        FROM fct_support JOIN {weights(**chosen)} USING (account_id) GROUP BY ALL"""


def sla_by_region(**chosen) -> str:
    return f"""
        SELECT da_region AS region, {weighted_mean('sla_breach_rate')} AS breach_rate,
               {weighted_mean('median_resolution_hours')} AS median_res_hours
        FROM fct_support JOIN {weights(**chosen)} USING (account_id) GROUP BY da_region"""


def metric_trend(metric: str) -> str:
    return f"""
        SELECT metric_month, metric_value::DOUBLE AS metric_value, pct_change::DOUBLE AS pct_change
        FROM fct_anomalies WHERE metric_name = {metric}"""


STAGES = ["Lead", "MQL", "SQL", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
DASH_SQL = {
    "dash_filter_options": """
        SELECT dimension, value, row_number() OVER (PARTITION BY dimension ORDER BY value)::INTEGER AS position FROM filter_values
        UNION ALL SELECT dimension, 'All', 0 FROM filter_values GROUP BY dimension""",
    "dash_kpis": kpis(),
    "dash_mrr_trend": mrr_trend(),
    "dash_segment_revenue": segment_revenue(),
    "dash_win_rate": "SELECT segment, win_rate::DOUBLE AS win_rate, won_deals, lost_deals FROM fct_pipeline WHERE won_deals + lost_deals > 0",
    "dash_sales_cycle": "SELECT segment, avg_sales_cycle_days FROM fct_pipeline WHERE stage = 'Closed Won'",
    "dash_deal_value": "SELECT segment, stage, avg_deal_value, deal_count FROM fct_pipeline WHERE starts_with(stage, 'Closed ')",
    "dash_cohort_heatmap": "SELECT cohort_month, " + ", ".join(
        f"(max(retention_rate) FILTER (months_since_cohort = {k}) * 100)::DOUBLE AS \"{k}\"" for k in range(13)
    ) + ", " + earlier("retention_rate * 100") + " AS before FROM fct_retention WHERE months_since_cohort <= 12 GROUP BY cohort_month",
    "dash_activation_vs_retention": activation_vs_retention(),
    "dash_churn_by_cohort": f"""
        SELECT cohort_month, {mean('churn_rate')} AS avg_churn_rate FROM fct_retention
        WHERE months_since_cohort IN (3, 4, 5, 6) GROUP BY cohort_month""",
    "dash_support_summary": support_summary(),
    "dash_tickets_by_segment": tickets_by_segment(),
    "dash_sla_by_region": sla_by_region(),
    "dash_recent_anomalies": as_double("recent_anomalies", ["metric_value", "prev_month_value", "pct_change"]),
    "dash_anomaly_type_counts": "SELECT anomaly_type, count(*) AS count FROM recent_anomalies GROUP BY ALL",
    "dash_anomaly_severity_counts": "SELECT anomaly_severity, count(*) AS count FROM recent_anomalies GROUP BY ALL",
    "dash_metric_trend": metric_trend(
        "(SELECT metric_name FROM recent_anomalies ORDER BY metric_month DESC, abs(pct_change) DESC, metric_name LIMIT 1)"
    ),
    "dash_chosen_metric_trend": metric_trend("'New MRR'"),
    "dash_metric_choices": "SELECT DISTINCT metric_name FROM recent_anomalies",
    "dash_filtered_mrr_trend": mrr_trend(segment="Enterprise", region="EUROPE"),
    "dash_filtered_kpis": kpis(segment="Mid-Market", channel="Referral"),
    "dash_filtered_tickets_by_segment": tickets_by_segment(region="ASIA"),
    "dash_filtered_sla_by_region": sla_by_region(segment="SMB", channel="LinkedIn"),
    "dash_filtered_segment_revenue": segment_revenue(region="AMERICA"),
    "dash_filtered_activation_vs_retention": activation_vs_retention(channel="Events"),
    "dash_filtered_support_summary": support_summary(segment="Enterprise", region="AFRICA"),
    "sql_segment_mrr": f"""
        SELECT revenue_month, sum(mrr * w)::DOUBLE AS total_mrr, count(DISTINCT account_id) AS accounts
        FROM fct_revenue_monthly JOIN {weights(segment='Mid-Market')} USING (account_id) GROUP BY revenue_month""",
}


BELOW_ZERO = """
    SELECT invoice_id, account_id, invoice_date, amount::DOUBLE AS amount FROM stg_invoices WHERE sign(amount) = -1
    UNION ALL BY NAME
    SELECT account_id, revenue_month AS invoice_date, mrr::DOUBLE AS amount FROM fct_revenue_monthly WHERE sign(mrr) = -1"""
WRONG_DATES = """
    SELECT 'subscription_dates' AS "check", subscription_id, account_id, start_date, end_date
    FROM stg_subscriptions WHERE end_date < start_date
    UNION ALL BY NAME
    SELECT 'invoice_dates' AS "check", i.account_id, s.start_date, s.end_date, i.invoice_date
    FROM stg_invoices i, stg_subscriptions s
    WHERE i.subscription_id = s.subscription_id
      AND i.invoice_date NOT BETWEEN s.start_date AND coalesce(s.end_date, i.invoice_date)"""
# Staged tables in which both find something: ids ending in 3 are billed below zero, those in 7 end
# before they start, those in 4 start 40 days late.
DAMAGED_CTES = {
    "stg_invoices": f"""
        SELECT * REPLACE (CASE account_id % 10 WHEN 3 THEN -amount ELSE amount END AS amount) FROM ({STAGING_CTES['stg_invoices']})""",
    "stg_subscriptions": f"""
        SELECT * REPLACE (CASE account_id % 10 WHEN 7 THEN coalesce(end_date, start_date) WHEN 4 THEN start_date + 40 ELSE start_date END AS start_date,
                          CASE WHEN account_id % 10 = 7 AND end_date IS NOT NULL THEN start_date ELSE end_date END AS end_date)
        FROM ({STAGING_CTES['stg_subscriptions']})""",
}


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def failures(model, column, rule, arg) -> str:
    """Scalar query: what the rule counts."""
    if rule == "unique":
        return f"SELECT count(*) FROM (SELECT {column} FROM {model} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1)"
    if rule == "not_null":
        return f"SELECT count(*) - count({column}) FROM {model}"
    if rule == "accepted_values":
        return f"SELECT count(DISTINCT {column}) FROM {model} WHERE {column} NOT IN ({quoted(arg)})"
    return f"SELECT count({column}) FROM {model} WHERE {column} NOT IN (SELECT {arg[1]} FROM {arg[0]} WHERE {arg[1]} IS NOT NULL)"


def summary(rules) -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT '{m}' AS model, '{c}' AS \"column\", '{r}' AS rule, ({failures(m, c, r, a)})::BIGINT AS failures" for m, c, r, a in rules
    )
    return f"SELECT *, ['pass', 'warn'][1 + (failures > 0)::INTEGER] AS status FROM ({rows})"


def found(rules, kind) -> str:
    """model, column, value, rows of the violations of one kind of rule."""
    parts = []
    for model, column, rule, arg in rules:
        if rule != kind:
            continue
        head = f"SELECT '{model}' AS model, '{column}' AS \"column\","
        if rule == "not_null":
            parts.append(f"{head} NULL::VARCHAR AS value, count(*) AS \"rows\" FROM {model} WHERE {column} IS NULL HAVING count(*) > 0")
            continue
        bad = {
            "unique": "true",
            "accepted_values": f"{column} NOT IN ({quoted(arg or [])})",
            "relationships": f"{column} NOT IN (SELECT {arg[1]} FROM {arg[0]} WHERE {arg[1]} IS NOT NULL)" if arg else "",
        }[rule]
        having = "HAVING count(*) > 1" if rule == "unique" else ""
        parts.append(
            f"{head} {column}::VARCHAR AS value, count(*) AS \"rows\" FROM {model} WHERE {column} IS NOT NULL AND {bad} GROUP BY {column} {having}"
        )
    return "\nUNION ALL ".join(parts)


DQ_SQL = {
    "dq_generic_summary": q(summary(RULES)),
    "dq_broken_summary": q(summary(BROKEN_RULES)),
    **{f"dq_{k}": q(found(RULES, k)) for k in ("unique", "not_null", "accepted_values", "relationships")},
    **{f"dq_broken_{k}": q(found(BROKEN_RULES, k)) for k in ("unique", "not_null", "accepted_values", "relationships")},
    "dq_enforced": q(f'SELECT model, "column", rule, failures FROM ({summary(BROKEN_RULES)}) WHERE failures > 0'),
    "dq_repeated_lines": """
        SELECT 'lineitem' AS model, 'l_orderkey,l_linenumber' AS "column", l_orderkey || '|' || l_linenumber AS value,
               count(*) AS "rows"
        FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "dq_unlabelled_documents": """
        SELECT 'documents' AS model, 'doc_id' AS "column", doc_id::VARCHAR AS value, count(*) AS "rows"
        FROM documents ANTI JOIN labels USING (doc_id) WHERE doc_id IS NOT NULL GROUP BY doc_id""",
    "dq_negative_balances": "SELECT c_custkey, c_acctbal FROM customer WHERE sign(c_acctbal) = -1",
    "dq_shipped_before_order": """
        SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) AS items,
               (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) AS first_shipped
        FROM orders WHERE items > 0""",
    "dq_non_negative_amounts": q(BELOW_ZERO),
    "dq_valid_subscription_dates": q(WRONG_DATES),
    "dq_broken_amounts": with_ctes(BELOW_ZERO, ALL_CTES | DAMAGED_CTES),
    "dq_broken_dates": with_ctes(WRONG_DATES, ALL_CTES | DAMAGED_CTES),
}


OP_SQL = {
    "op_distinct": "SELECT DISTINCT segment, region, acquisition_channel FROM dim_account",
    "op_filter_predicates": """
        SELECT deal_id, account_id, stage, deal_value, sales_cycle_days FROM stg_crm_deals
        WHERE stage IN ('Closed Won', 'Closed Lost') AND account_id IS NOT NULL
          AND sales_cycle_days BETWEEN 30 AND 60 AND deal_value <= 250000 AND NOT (deal_value - 1000 < 0)
          AND segment = 'SMB'""",
    "op_post_window_filter": """
        SELECT account_id, month, CAST(paid AS DOUBLE) AS paid, CAST(prev_paid AS DOUBLE) AS prev_paid
        FROM paid_by_month WHERE prev_paid IS NULL OR paid <> prev_paid""",
    "op_abs_filter": """
        SELECT account_id, month, CAST(coalesce(paid - prev_paid, 0) AS DOUBLE) AS change
        FROM paid_by_month WHERE abs(coalesce(paid - prev_paid, 0)) > 100""",
    "op_scalar_subquery": """
        SELECT max(revenue_month) AS month, CAST(sum(mrr) AS DOUBLE) AS total_mrr, count(*) AS accounts
        FROM fct_revenue_monthly WHERE revenue_month = (SELECT max(revenue_month) FROM fct_revenue_monthly)""",
    "op_dynamic_filter": """
        SELECT account_id, segment, region, acquisition_channel FROM dim_account
        WHERE segment = 'SMB' AND region = 'ASIA' AND acquisition_channel = 'Events'""",
    "op_left_join": "SELECT * FROM user_activation",
    "op_left_join_residual": "SELECT account_id, revenue_month, CAST(mrr AS DOUBLE) AS mrr, subscription_end_date FROM rev_monthly",
    "op_left_to_inner": """
        SELECT acquisition_channel, accounts_acquired, CAST(total_revenue AS DOUBLE) AS total_revenue
        FROM channel_attribution""",
    "op_small_side_left_join": """
        SELECT cs.channel, CAST(cs.total_spend AS DOUBLE) AS total_spend, cs.total_leads, ca.accounts_acquired,
               CAST(ca.total_revenue AS DOUBLE) AS total_revenue
        FROM channel_facts cs LEFT JOIN channel_attribution ca ON cs.channel = ca.acquisition_channel""",
    "op_inner_join_residual": """
        SELECT i.account_id, count(*) AS invoices, CAST(sum(i.amount) AS DOUBLE) AS amount
        FROM stg_invoices i JOIN stg_subscriptions s ON i.subscription_id = s.subscription_id
        WHERE i.status = 'Paid' AND i.invoice_date >= s.start_date
          AND (s.end_date IS NULL OR i.invoice_date <= s.end_date)
        GROUP BY 1""",
    "op_subscription_months": "SELECT account_id, subscription_id, revenue_month, end_date FROM sub_months",
    "op_cross_one_row": """
        SELECT a.accounts, d.deals, t.tickets
        FROM (SELECT count(*) AS accounts FROM stg_accounts) a
        CROSS JOIN (SELECT count(*) AS deals FROM stg_crm_deals) d
        CROSS JOIN (SELECT count(*) AS tickets FROM stg_support_tickets) t""",
    "op_function_key_join": """
        SELECT a.account_id, r.cohort_month, CAST(r.retention_rate AS DOUBLE) AS retention_rate
        FROM stg_accounts a JOIN fct_retention r ON CAST(date_trunc('month', a.created_at) AS DATE) = r.cohort_month
        WHERE r.months_since_cohort = 1""",
    "op_anti_join": """
        SELECT u.user_id, u.account_id FROM stg_users u
        WHERE NOT EXISTS (SELECT 1 FROM stg_accounts a WHERE a.account_id = u.account_id)""",
    "op_anti_join_found": "SELECT account_id, segment FROM stg_accounts WHERE account_id NOT IN (SELECT account_id FROM stg_support_tickets)",
    "op_agg_basic": """
        SELECT segment, count(*) AS deals, count(account_id) AS with_account,
               CAST(sum(deal_value) AS BIGINT) AS total_value, max(deal_value) AS max_value,
               CAST(sum(deal_value) AS DOUBLE) / count(deal_value) AS avg_value,
               CAST(sum(CASE WHEN stage = 'Closed Won' THEN deal_value ELSE 0 END) AS BIGINT) AS won_value,
               CAST(sum(CASE WHEN stage = 'Closed Lost' THEN deal_value ELSE 0 END) AS BIGINT) AS lost_value
        FROM stg_crm_deals GROUP BY 1""",
    "op_count_distinct": """
        SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, count(DISTINCT account_id) AS paying_accounts
        FROM stg_invoices WHERE status = 'Paid' GROUP BY 1""",
    "op_filtered_agg": """
        SELECT account_id, count(*) FILTER (WHERE severity = 'Critical') AS critical,
               count(*) FILTER (WHERE sla_breached) AS breached,
               min(created_at) FILTER (WHERE severity = 'High') AS first_high
        FROM stg_support_tickets GROUP BY 1""",
    "op_null_as_zero_avg": """
        SELECT revenue_month, round(avg(coalesce(nrr, 0.0)), 10) + 0.0 AS avg_nrr
        FROM fct_revenue_monthly GROUP BY 1""",
    "op_median": """
        SELECT segment, stage, quantile_cont(deal_value, 0.5) AS median_deal_value
        FROM stg_crm_deals WHERE deal_value IS NOT NULL GROUP BY 1, 2""",
    "op_two_level_agg": """
        SELECT cohort_month, months_since_cohort, count(DISTINCT account_id) AS active_accounts,
               CAST(sum(revenue) AS DOUBLE) AS cohort_revenue
        FROM cohort_activity GROUP BY 1, 2""",
    "op_safe_rate": f"""
        SELECT segment, won, closed, CAST({rate('won', 'closed')} AS DOUBLE) AS win_rate
        FROM (SELECT segment, count(*) FILTER (WHERE stage = 'Closed Won') AS won,
                     count(*) FILTER (WHERE stage IN ('Closed Won', 'Closed Lost')) AS closed
              FROM stg_crm_deals GROUP BY 1) t""",
    "op_value_counts": "SELECT stage, count(*) AS count FROM stg_crm_deals GROUP BY 1",
    "op_pivot": "SELECT segment, " + ", ".join(
        f"nullif(count(*) FILTER (stage = '{s}'), 0) AS \"{s}\"" for s in STAGES
    ) + f", nullif(count(*) FILTER (stage NOT IN ({quoted(STAGES)})), 0) AS other FROM stg_crm_deals WHERE stage IS NOT NULL GROUP BY segment",
    "op_duplicate_keys": """
        SELECT 'stg_crm_deals' AS model, 'account_id,created_date' AS "column",
               concat_ws('|', CAST(account_id AS VARCHAR), CAST(created_date AS VARCHAR)) AS value,
               count(*) AS "rows"
        FROM stg_crm_deals WHERE account_id IS NOT NULL AND created_date IS NOT NULL
        GROUP BY account_id, created_date HAVING count(*) > 1""",
    "op_lag_lead": f"""
        SELECT account_id, revenue_month, CAST(mrr AS DOUBLE) AS mrr, CAST(prev_mrr AS DOUBLE) AS prev_mrr,
               CAST(next_mrr AS DOUBLE) AS next_mrr
        FROM (SELECT account_id, {month_of('m')} AS revenue_month, mrr, before_mrr AS prev_mrr, after_mrr AS next_mrr FROM neighbours)""",
    "op_pct_change": f"""
        SELECT metric_month, metric_name, CAST(metric_value AS DOUBLE) AS metric_value,
               CAST(prev_month_value AS DOUBLE) AS prev_month_value,
               CAST({units_dec('pct_units', 2)} AS DOUBLE) AS pct_change
        FROM metric_changes""",
    "op_top_k": """
        SELECT revenue_month, account_id, CAST(mrr AS DOUBLE) AS mrr, CAST(revenue_change AS DOUBLE) AS revenue_change,
               revenue_type
        FROM fct_revenue_monthly ORDER BY revenue_month DESC, abs(revenue_change) DESC, account_id LIMIT 50""",
    "op_union_all": """
        SELECT invoice_id, account_id, invoice_date, CAST(amount AS DOUBLE) AS amount
        FROM stg_invoices WHERE status = 'Failed'
        UNION ALL
        SELECT NULL, account_id, revenue_month, CAST(churned_mrr AS DOUBLE)
        FROM fct_revenue_monthly WHERE revenue_type = 'churned'""",
    "op_metric_unpivot": "SELECT metric_month, metric_name, CAST(metric_value AS DOUBLE) AS metric_value FROM monthly_metrics",
    "op_tagged_union": """
        SELECT 'subscription' AS kind, subscription_id, account_id, start_date, end_date, CAST(NULL AS DATE) AS invoice_date
        FROM stg_subscriptions WHERE end_date IS NOT NULL
        UNION ALL
        SELECT 'invoice', NULL, i.account_id, s.start_date, s.end_date, i.invoice_date
        FROM stg_invoices i JOIN stg_subscriptions s ON i.subscription_id = s.subscription_id
        WHERE s.end_date IS NOT NULL
          AND date_trunc('month', i.invoice_date) = date_trunc('month', s.end_date)""",
    "op_calendar_fns": DIM_DATE_SQL.replace("FROM calendar_days",
                                            "FROM (SELECT DISTINCT created_date AS d FROM stg_crm_deals) t"),
    "op_elapsed_and_bucket": """
        SELECT deal_id,
               CAST(date_diff('microsecond', CAST(created_date AS TIMESTAMP), CAST(closed_date AS TIMESTAMP)) AS DOUBLE)
                 / CAST(86400000000 AS DOUBLE) AS elapsed_days,
               CAST(floor(date_diff('day', CAST(date_trunc('month', created_date) AS DATE),
                                    CAST(date_trunc('month', closed_date) AS DATE)) / 30) AS INTEGER) AS months_bucket
        FROM stg_crm_deals WHERE closed_date IS NOT NULL""",
    "op_round_case_cast": """
        SELECT segment, stage, CAST(round(CAST(avg_sales_cycle_days AS DECIMAL(38,10)), 1) AS DOUBLE) AS cycle_1dp,
               CASE WHEN deal_count >= 2000 THEN 'large' WHEN deal_count >= 500 THEN 'medium' ELSE 'small' END
                 AS size_class,
               CAST(deal_count AS VARCHAR) AS deal_count_text,
               CAST(coalesce(win_rate * 100, 0) AS DOUBLE) AS win_pct
        FROM fct_pipeline""",
}


# Decimal columns of the staged tables and marts.
MONEY = {
    "stg_invoices": ["amount"],
    "stg_payments": ["amount"],
    "stg_marketing_spend": ["spend"],
    "fct_revenue_monthly": ["mrr", "arr", "prior_month_mrr", "revenue_change", "new_mrr", "expansion_mrr", "contraction_mrr", "churned_mrr"],
    "fct_pipeline": ["win_rate"],
    "fct_activation": ["activation_rate", "median_days_to_activate"],
    "fct_retention": ["cohort_revenue", "retention_rate", "churn_rate"],
    "fct_support": ["sla_breach_rate", "avg_resolution_hours", "median_resolution_hours", "tickets_per_100_accounts"],
    "fct_cac_ltv": ["total_spend", "total_revenue", "cac", "rough_ltv", "roas", "ltv_cac_ratio", "cac_payback_months"],
    "fct_anomalies": ["metric_value", "prev_month_value", "pct_change"],
}


def row_counts(names) -> str:
    counts = "\nUNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS \"rows\" FROM {n}" for n in names)
    return q(f'SELECT coalesce("table", \'total\') AS "table", sum("rows")::BIGINT AS "rows" FROM ({counts}) GROUP BY ROLLUP ("table")')


ORACLE_SQL: dict[str, str] = {
    **{name: q(as_double(name, MONEY.get(name, []))) for name in [*STAGING_CTES, "dim_account", *[m for m in MONEY if m.startswith("fct_")]]},
    "dim_date": with_ctes(DIM_DATE_SQL, {"horizon": HORIZON, "calendar_days": "SELECT date::TIMESTAMP AS d FROM (" + MART_CTES["dim_date"] + ")"}),
    **{name: q(sql) for name, sql in DASH_SQL.items()},
    **DQ_SQL,
    "src_csv_roundtrip": q("FROM stg_support_tickets"),
    "src_rebuilt_mart": q("FROM dim_account"),
    "src_partial_export": row_counts(["raw_users", "raw_marketing_spend"]),
    "src_second_load": row_counts(["raw_accounts", "raw_subscriptions", "raw_marketing_spend"]),
    "load_observed_counts": row_counts(["raw_accounts", "raw_subscriptions", "raw_support_tickets"]),
    "src_catalog_rebuild": q("FROM dim_account"),
    "src_dirty_export": q("""
        SELECT coalesce(problem, 'read') AS problem, count(*)::BIGINT AS "rows"
        FROM (SELECT CASE WHEN subscription_id % 11 = 0 THEN 'unreadable line'
                          WHEN subscription_id % 7 = 0 AND subscription_id % 5 = 0 AND end_date IS NOT NULL THEN 'start_date, end_date'
                          WHEN subscription_id % 7 = 0 THEN 'start_date'
                          WHEN subscription_id % 5 = 0 AND end_date IS NOT NULL THEN 'end_date'
                          ELSE 'staged' END AS problem FROM stg_subscriptions)
        GROUP BY ROLLUP (problem)"""),
    "sql_published_views": q("""
        SELECT a.segment, s.plan_tier, count(*)::BIGINT AS subscriptions, min(s.start_date) AS first_start, max(s.end_date) AS last_end
        FROM stg_subscriptions s JOIN stg_accounts a ON a.account_id = s.account_id GROUP BY ALL"""),
    "sql_month_series": q("SELECT account_id, subscription_id, revenue_month, end_date FROM sub_months"),
    "dash_bucketed_mrr_trend": q(DASH_SQL["dash_mrr_trend"]),
    "dash_built_kpis": q(DASH_SQL["dash_kpis"]),
    "dash_built_segment_revenue": q(DASH_SQL["dash_segment_revenue"]),
    "op_pivot_before": q("SELECT cohort_month, " + ", ".join(f"max(n) FILTER (months_since_cohort = {k}) AS \"{k}\"" for k in range(4))
        + ", " + earlier("n") + """ AS before
        FROM (SELECT cohort_month, months_since_cohort, count(DISTINCT account_id) AS n
              FROM (SELECT date_trunc('month', s.end_date)::DATE AS cohort_month, i.account_id,
                           floor(date_diff('day', date_trunc('month', s.end_date)::DATE, date_trunc('month', i.invoice_date)::DATE) / 30)::INTEGER
                             AS months_since_cohort
                    FROM stg_invoices i JOIN stg_subscriptions s ON s.account_id = i.account_id
                    WHERE i.status = 'Paid' AND s.end_date IS NOT NULL)
              GROUP BY ALL)
        WHERE months_since_cohort <= 3 GROUP BY cohort_month"""),
    "load_row_counts": row_counts([n for n in RAW_CTES if n.startswith("raw_")]),
    **{name: q(sql) for name, sql in OP_SQL.items()},
}
