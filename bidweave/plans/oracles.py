"""DuckDB SQL with the rows of the queries, written independently of them, over the same bound tables."""

from __future__ import annotations

from bidweave.operators.text import STOP_TERMS
from bidweave.plans.bindings import ctes

KEYS = "platform, entity_type, product_id, keyword"
NOW = "TIMESTAMP '2001-11-08 00:00:00'"


def _number(c: str) -> str:
    return f"try_cast(regexp_replace(trim({c}), '[,円%]', '', 'g') AS DOUBLE)"


def _ratio(a: str, b: str, factor: str = "") -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b}{factor} END"


def _window(name: str, target: int, longer: bool) -> str:
    extra = f" + CASE WHEN window_days < {target} THEN 5 ELSE 0 END" if longer else ""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY abs(window_days - {target}){extra}, period_end DESC, ord) AS rn FROM o_fresh) WHERE rn = 1)"""


_METRICS = "impressions clicks cost actual_cpc sales_short orders_short sales_attr orders_attr ctr_pct".split()
_CHAIN = [
    "o_perf AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, entity_key ORDER BY ord DESC) AS rn FROM performance) WHERE rn = 1)",
    "o_fresh AS (SELECT * EXCLUDE (latest) FROM (SELECT *, max(period_end) OVER (PARTITION BY entity_key) AS latest FROM o_perf) WHERE latest - period_end <= 1)",
    _window("o_short", 90, False),
    _window("o_long", 365, True),
    "o_win0 AS (SELECT s.platform, s.entity_type, s.product_id, s.keyword, s.entity_key, s.snapshot_id AS snapshot_id_shortwin, l.snapshot_id AS snapshot_id_longwin, s.snapshot_id <> l.snapshot_id AS trend_available, s.registered_bid_report AS registered_bid_report_shortwin, s.period_start AS period_start_shortwin, s.period_end AS period_end_shortwin, s.executed_at AS executed_at_shortwin, "
    + ", ".join(f"s.{m} AS {m}, l.{m} AS {m}_long" for m in _METRICS) + " FROM o_short s JOIN o_long l USING (entity_key))",
    "o_win AS (SELECT *, " + ", ".join(
        f"{_ratio('orders_attr' + x, 'clicks' + x)} AS cvr_attr{x}, {_ratio('sales_attr' + x, 'cost' + x, ' * 100')} AS roas_attr_pct{x}, {_ratio('sales_attr' + x, 'orders_attr' + x)} AS aov_attr{x}" for x in ("", "_long")
    ) + " FROM o_win0)",
    f"o_item_set AS (SELECT 'rakuten' AS platform, 'ITEM' AS entity_type, product_id, '' AS keyword, registered_cpc FROM (SELECT product_id, {_number('item_cpc')} AS registered_cpc, row_number() OVER (PARTITION BY product_id ORDER BY {_number('item_cpc')} IS NULL, ord) AS rn FROM settings) WHERE rn = 1)",
    f"o_kw_set AS (SELECT 'rakuten' AS platform, 'KEYWORD' AS entity_type, product_id, keyword, registered_cpc FROM (SELECT product_id, keyword, {_number('keyword_cpc')} AS registered_cpc, row_number() OVER (PARTITION BY product_id, keyword ORDER BY ord DESC) AS rn FROM settings WHERE keyword <> '') WHERE rn = 1)",
    "o_set AS (SELECT *, true AS setting_row_exists FROM o_item_set UNION ALL SELECT *, true FROM o_kw_set)",
    f"o_applied AS (SELECT {KEYS}, applied_cpc AS state_applied_cpc, effective_at AS state_effective_at, source AS state_source FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY effective_at DESC NULLS LAST, ord DESC) AS rn FROM applied) WHERE rn = 1)",
    f"o_planned AS (SELECT {KEYS}, planned_cpc, planned_at, run_id AS planned_run_id FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY planned_at DESC NULLS LAST, ord DESC) AS rn FROM planned WHERE upper(planned_status) = 'PENDING') WHERE rn = 1)",
    f"o_hist AS (SELECT {KEYS}, clicks AS prev_clicks, cvr_attr AS prev_cvr_attr, roas_attr_pct AS prev_roas_attr_pct, actual_cpc AS prev_actual_cpc FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY period_end DESC NULLS FIRST, captured_at DESC NULLS FIRST, ord DESC) AS rn FROM history) WHERE rn = 1)",
    f"o_over AS (SELECT {KEYS}, upper(override_mode) AS override_mode, override_cpc FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY effective_from DESC NULLS FIRST, ord DESC) AS rn FROM overrides WHERE lower(active) IN ('1','true','yes','y','on') AND (effective_from IS NULL OR effective_from <= {NOW}) AND (effective_until IS NULL OR effective_until >= {NOW})) WHERE rn = 1)",
    f"o_master AS (SELECT 'rakuten' AS platform, product_id, '' AS common_product_id, product_name, category, product_group, CASE WHEN {_number('gross_margin_rate')} > 1 THEN {_number('gross_margin_rate')} / 100 ELSE {_number('gross_margin_rate')} END AS gross_margin_rate, CASE WHEN {_number('other_promo_cost_rate')} > 1 THEN {_number('other_promo_cost_rate')} / 100 ELSE {_number('other_promo_cost_rate')} END AS other_promo_cost_rate, {_number('item_min_cpc')} AS item_min_cpc, {_number('item_max_cpc')} AS item_max_cpc, {_number('stock_qty')} AS stock_qty, CASE WHEN product_status = '' THEN 'ACTIVE' ELSE upper(product_status) END AS product_status, CAST(launch_date AS DATE) AS launch_date, 'PROFIT' AS role FROM master)",
    "o_errs AS (SELECT *, array_to_string(list_filter([CASE WHEN trim(product_id) = '' THEN 'MISSING_PRODUCT_ID' END, "
    + ", ".join(f"CASE WHEN {x} IS NULL THEN 'MISSING_{x.upper()}' WHEN {x} < 0 THEN 'NEGATIVE_{x.upper()}' END" for x in ("clicks", "cost", "sales_attr", "orders_attr"))
    + ", CASE WHEN period_start IS NULL OR period_end IS NULL THEN 'MISSING_PERIOD' END], lambda x: x IS NOT NULL), '|') AS errors FROM o_perf)",
    f"o_ent0 AS (SELECT w.*, s.registered_cpc, s.setting_row_exists, a.state_applied_cpc AS prior_cpc, a.state_effective_at AS prior_at, p.planned_cpc, p.planned_at, p.planned_run_id, h.* EXCLUDE ({KEYS}), v.override_mode, v.override_cpc, m.product_name, coalesce(m.common_product_id, w.product_id) AS common_product_id, coalesce(m.category, 'UNKNOWN') AS category, coalesce(m.product_group, 'UNKNOWN') AS product_group, m.gross_margin_rate, coalesce(m.other_promo_cost_rate, 0) AS other_promo_cost_rate, m.item_min_cpc, m.item_max_cpc, m.stock_qty, coalesce(m.product_status, 'ACTIVE') AS product_status, m.launch_date, coalesce(m.role, 'PROFIT') AS role, w.entity_key IN (SELECT entity_key FROM o_errs WHERE errors <> '') AS row_quality_block "
    f"FROM o_win w LEFT JOIN o_set s USING ({KEYS}) LEFT JOIN o_applied a USING ({KEYS}) LEFT JOIN o_planned p USING ({KEYS}) LEFT JOIN o_hist h USING ({KEYS}) LEFT JOIN o_over v USING ({KEYS}) LEFT JOIN o_master m USING (platform, product_id))",
    f"o_ent1 AS (SELECT *, CASE WHEN registered_cpc IS NULL THEN NULL WHEN abs(registered_cpc - planned_cpc) < 1 THEN 'PLAN_CONFIRMED' WHEN prior_cpc IS NULL THEN 'INITIAL_BASELINE' WHEN abs(registered_cpc - prior_cpc) >= 1 THEN 'EXTERNAL_MANUAL_CHANGE' WHEN abs(registered_cpc - planned_cpc) >= 1 AND coalesce(epoch({NOW} - planned_at) / 86400, 999) >= 1 THEN 'PLAN_NOT_APPLIED' END AS event_type FROM o_ent0)",
    f"o_ent AS (SELECT *, CASE WHEN event_type IS NOT NULL AND event_type <> 'PLAN_NOT_APPLIED' THEN registered_cpc ELSE prior_cpc END AS state_applied_cpc, CASE event_type WHEN 'PLAN_CONFIRMED' THEN coalesce(planned_at, {NOW}) WHEN 'INITIAL_BASELINE' THEN NULL WHEN 'EXTERNAL_MANUAL_CHANGE' THEN {NOW} ELSE prior_at END AS state_effective_at FROM o_ent1)",
    "o_pri0 AS (SELECT *, sum(clicks) OVER g AS gc, sum(orders_attr) OVER g AS go, sum(sales_attr) OVER g AS gs, sum(clicks) OVER m AS mc, sum(orders_attr) OVER m AS mo, sum(sales_attr) OVER m AS ms FROM o_ent WINDOW g AS (PARTITION BY platform, entity_type, category, product_group), m AS (PARTITION BY platform, entity_type))",
    "o_pri AS (SELECT * EXCLUDE (gc, go, gs, mc, mo, ms), coalesce(CASE WHEN gc > 0 THEN coalesce(go, 0) / gc END, CASE WHEN mc > 0 THEN coalesce(mo, 0) / mc END, 0) AS group_cvr, coalesce(CASE WHEN go > 0 THEN coalesce(gs, 0) / go END, CASE WHEN mo > 0 THEN coalesce(ms, 0) / mo END, 3000) AS prior_aov FROM o_pri0)",
    "o_par AS (SELECT platform, product_id, arg_max(cvr_attr, entity_key) AS parent_cvr FROM o_pri WHERE entity_type = 'ITEM' AND cvr_attr IS NOT NULL GROUP BY ALL)",
    "o_e1 AS (SELECT p.*, CASE WHEN entity_type = 'KEYWORD' THEN coalesce(parent_cvr, group_cvr) ELSE group_cvr END AS prior_cvr, CASE WHEN item_min_cpc > 0 THEN item_min_cpc ELSE 24 END AS min_cpc, greatest(CASE WHEN item_min_cpc > 0 THEN item_min_cpc ELSE 24 END, CASE WHEN item_max_cpc > 0 THEN item_max_cpc ELSE 100 END) AS max_cpc, coalesce(override_mode, '') AS md, coalesce(clicks, 0) AS c, least(greatest(coalesce(orders_attr, 0), 0), greatest(coalesce(clicks, 0), 0)) AS o FROM o_pri p LEFT JOIN o_par USING (platform, product_id))",
    "o_e2 AS (SELECT *, CASE WHEN md IN ('LOCK_CPC', 'BASELINE') AND override_cpc > 0 THEN 'MANUAL_OVERRIDE' WHEN registered_cpc > 0 THEN 'UPLOADED_SETTING' WHEN state_applied_cpc > 0 THEN 'PRIOR_STATE' WHEN registered_bid_report_shortwin > 0 THEN 'REPORT_REGISTERED_BID' WHEN actual_cpc > 0 THEN 'ACTUAL_CPC_FALLBACK' ELSE 'POLICY_MIN_FALLBACK' END AS current_bid_source, least(greatest(prior_cvr, 0.000001::DOUBLE), 1 - 0.000001::DOUBLE) AS pr FROM o_e1)",
    "o_e3 AS (SELECT *, greatest(min_cpc, least(max_cpc, CASE current_bid_source WHEN 'MANUAL_OVERRIDE' THEN override_cpc WHEN 'UPLOADED_SETTING' THEN registered_cpc WHEN 'PRIOR_STATE' THEN state_applied_cpc WHEN 'REPORT_REGISTERED_BID' THEN registered_bid_report_shortwin WHEN 'ACTUAL_CPC_FALLBACK' THEN actual_cpc ELSE 24 END)) AS bid, o + pr * 20 AS a, greatest(c, 0) - o + (1 - pr) * 20 AS b FROM o_e2)",
    "o_e4 AS (SELECT *, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd, CASE WHEN aov_attr > 0 THEN aov_attr ELSE prior_aov END AS aov, least(greatest(coalesce(gross_margin_rate, 0.35::DOUBLE), 0), 1) AS margin, least(greatest(other_promo_cost_rate, 0), 1) AS promo FROM o_e3)",
    "o_e5 AS (SELECT *, greatest(0, mean - 1.2816::DOUBLE * sd) AS low, greatest(margin - promo, 0) AS contribution, CASE WHEN trend_available AND cvr_attr_long > 0 THEN greatest(0.75::DOUBLE, least(1.15::DOUBLE, sqrt(mean / greatest(cvr_attr_long, 0.000001::DOUBLE)))) ELSE 1 END AS trend FROM o_e4)",
    "o_e6 AS (SELECT *, mean * aov * contribution AS exp_c, low * aov * contribution AS low_c, mean * aov * contribution * 0.9::DOUBLE AS profit_guard, mean * aov / 4.5::DOUBLE AS roas_guard FROM o_e5)",
    "o_e7 AS (SELECT *, greatest(min_cpc, least(max_cpc, least(profit_guard, roas_guard) * trend)) AS raw, greatest(3, bid * 0.1::DOUBLE) AS deadband FROM o_e6)",
    "o_e8 AS (SELECT *, CAST(greatest(min_cpc, least(max_cpc, ceil(greatest(min_cpc, least(max_cpc, CASE WHEN raw > bid THEN least(raw, least(bid * 1.5::DOUBLE, bid + 30, max_cpc)) ELSE greatest(raw, greatest(bid * 0.5::DOUBLE, bid - 30, min_cpc)) END))))) AS BIGINT) AS step, "
    f"list_sum(list_transform(range(0, period_end_shortwin - period_start_shortwin + 1), lambda i: least(greatest((i + greatest(epoch(executed_at_shortwin - CAST(period_end_shortwin AS TIMESTAMP)) / 86400, 0)) / 30, 0), 1))) / (period_end_shortwin - period_start_shortwin + 1) AS mat, "
    "CASE WHEN c >= 20 AND prev_clicks >= 20 THEN list_filter([CASE WHEN prev_cvr_attr > 0 AND cvr_attr <= prev_cvr_attr * 0.5::DOUBLE THEN 'CVR_DROP' END, CASE WHEN prev_roas_attr_pct > 0 AND roas_attr_pct <= prev_roas_attr_pct * 0.5::DOUBLE THEN 'ROAS_DROP' END, CASE WHEN prev_actual_cpc > 0 AND actual_cpc >= prev_actual_cpc * 1.5::DOUBLE THEN 'CPC_RISE' END], lambda x: x IS NOT NULL) ELSE [] END AS sig FROM o_e7)",
    f"""o_rule AS (SELECT *, CASE
        WHEN row_quality_block THEN 1 WHEN md = 'EXCLUDE' THEN 2
        WHEN md = 'FORCE_STOP' OR product_status IN ('OUT_OF_STOCK', 'DISCONTINUED', 'RESERVED', 'INACTIVE', 'STOP') OR coalesce(stock_qty <= 0, false) THEN 3
        WHEN md = 'LOCK_CPC' THEN 4 WHEN len(sig) >= 2 THEN 5 WHEN epoch({NOW} - state_effective_at) / 86400 < 7 THEN 6 WHEN epoch({NOW} - CAST(launch_date AS TIMESTAMP)) / 86400 < 14 THEN 8
        WHEN c = 0 THEN 9 WHEN c < 10 THEN 10 WHEN coalesce(orders_attr, 0) <= 0 AND c >= 50 THEN 11 WHEN raw <= min_cpc AND exp_c <= bid THEN 12
        WHEN abs(step - bid) < deadband THEN 13 WHEN step < bid THEN 14 WHEN low_c > step THEN 15 ELSE 16 END AS rule FROM o_e8)""",
    """o_dec0 AS (SELECT *, ['MANUAL_REVIEW', 'EXCLUDE', 'STOP_OR_MIN_CPC', 'KEEP', 'MANUAL_REVIEW', 'OBSERVE', '', 'OBSERVE', 'MANUAL_REVIEW', 'OBSERVE', 'STOP_OR_MIN_CPC', 'STOP_OR_MIN_CPC', 'KEEP', 'SCALE_DOWN', 'SCALE_UP', 'KEEP'][rule] AS action,
        CASE WHEN rule = 14 AND mat < 0.5 THEN 'SCALE_DOWN_REVIEW_PROVISIONAL_ATTRIBUTION' WHEN rule = 15 AND gross_margin_rate IS NULL THEN 'SCALE_UP_REVIEW_MISSING_MARGIN' ELSE
        ['BLOCKED_DATA_QUALITY', 'EXCLUDED_MANUAL', 'STOP_AUTO_READY', 'MANUAL_LOCK', 'ANOMALY_MANUAL_INTERVENTION', 'OBSERVE_AFTER_CHANGE', '', 'OBSERVE_NEW_PRODUCT', 'NO_TRAFFIC_REVIEW', 'HOLD_INSUFFICIENT_DATA', 'STOP_AUTO_READY', 'STOP_AUTO_READY', 'KEEP', 'SCALE_DOWN_AUTO_READY', 'SCALE_UP_REVIEW_REQUIRED', 'KEEP_UNCERTAIN_UPSIDE'][rule] END AS status,
        CASE WHEN rule = 5 THEN array_to_string(sig, '+') ELSE ['ROW_DATA_ERROR', 'MANUAL_EXCLUDE', 'HARD_STOP', 'MANUAL_CPC_LOCK', '', 'MEASUREMENT_LOCK', '', 'NEW_PRODUCT', 'ZERO_CLICK_NOT_PERFORMANCE_STOP', 'INSUFFICIENT_CLICKS', 'NO_ORDER_STOP_THRESHOLD', 'NON_POSITIVE_UNIT_ECONOMICS', 'WITHIN_DEADBAND', 'PROFIT_OR_ROAS_GUARD_DOWN', 'LOWER_BOUND_PROFITABLE', 'UNCERTAIN_SCALE_UP'][rule] END AS reason,
        CASE WHEN rule IN (3, 11, 12) THEN CAST(trunc(min_cpc) AS BIGINT) WHEN rule IN (14, 15) THEN step ELSE CAST(round_even(bid, 0) AS BIGINT) END AS rec,
        gross_margin_rate IS NOT NULL AND (rule IN (3, 11, 12) OR rule = 14 AND mat >= 0.5) AS auto FROM o_rule)""",
    "o_dec AS (SELECT *, c * 0.5::DOUBLE * ((rec - bid) / greatest(bid, 1)) * (exp_c - rec) AS inc FROM o_dec0)",
    "o_pa AS (SELECT platform, product_id, action AS p_action, rec AS p_rec, auto AS p_auto FROM o_dec WHERE entity_type = 'ITEM')",
    "o_h0 AS (SELECT *, entity_type = 'KEYWORD' AND p_action IS NOT NULL AS child, CASE WHEN entity_type = 'KEYWORD' AND p_action = 'STOP_OR_MIN_CPC' THEN 1 WHEN entity_type = 'KEYWORD' AND p_action = 'SCALE_DOWN' AND action = 'SCALE_UP' THEN 2 ELSE 0 END AS h FROM o_dec LEFT JOIN o_pa USING (platform, product_id))",
    """o_h1 AS (SELECT * EXCLUDE (action, status, reason, rec, auto), CASE h WHEN 1 THEN CAST(trunc(min_cpc) AS BIGINT) WHEN 2 THEN CAST(round_even(least(bid, p_rec), 0) AS BIGINT) ELSE rec END AS rec,
        CASE h WHEN 1 THEN 'STOP_OR_MIN_CPC' WHEN 2 THEN CASE WHEN p_rec < bid THEN 'SCALE_DOWN' ELSE 'KEEP' END ELSE action END AS action,
        CASE h WHEN 1 THEN CASE WHEN p_auto THEN 'PARENT_STOP_AUTO_READY' ELSE 'PARENT_STOP_REVIEW' END WHEN 2 THEN 'PARENT_PRODUCT_CAP' ELSE status END AS status,
        CASE h WHEN 1 THEN 'PARENT_PRODUCT_STOP' WHEN 2 THEN 'PARENT_PRODUCT_PRIORITY' ELSE reason END AS reason, CASE h WHEN 1 THEN p_auto WHEN 2 THEN p_rec < bid ELSE auto END AS auto FROM o_h0)""",
    "o_hier AS (SELECT *, CASE WHEN auto THEN 'ACCEPT' ELSE 'PENDING' END AS answer FROM o_h1)",
    "o_f0 AS (SELECT * EXCLUDE (answer), CASE WHEN action = 'SCALE_UP' AND n % 2 = 0 THEN 'ACCEPT' WHEN n % 23 = 0 THEN 'LOCK' WHEN n % 29 = 0 THEN 'FORCE_STOP' WHEN n % 31 = 0 THEN 'REJECT' ELSE answer END AS answer FROM (SELECT *, length(entity_key) + CAST(coalesce(clicks, 0) AS BIGINT) AS n FROM o_hier))",
    "o_f1 AS (SELECT *, answer IN ('ACCEPT', 'MODIFY', 'LOCK', 'FORCE_STOP') AS approved, CAST(ceil(greatest(min_cpc, least(max_cpc, CASE WHEN answer = 'FORCE_STOP' THEN min_cpc WHEN answer IN ('ACCEPT', 'MODIFY', 'LOCK') THEN rec ELSE bid END))) AS BIGINT) AS fin FROM o_f0)",
    "o_fin AS (SELECT *, approved AND fin <> ceil(bid) AS changed, coalesce(setting_row_exists, false) AS matched, approved AND fin <> ceil(bid) AND coalesce(setting_row_exists, false) AS eligible FROM o_f1)",
    "o_kw AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(keyword), '[\\s,.\\-_]+', ' ', 'g')), ' '), lambda t: length(t) >= 2)) AS terms, trim(regexp_replace(lower(keyword), '[\\s,.\\-_]+', ' ', 'g')) AS norm FROM o_win WHERE entity_type = 'KEYWORD')",
    "o_ed0 AS (SELECT product_id, keyword AS norm, CASE WHEN sum(sum(sales_attr)) OVER () > 0 THEN sum(sales_attr) ELSE greatest(coalesce(sum(clicks), 0), 1) END AS v, coalesce(sum(clicks), 0) AS clicks, sum(sales_attr) AS sales_attr, avg(roas_attr_pct) AS roas FROM o_hier WHERE entity_type = 'KEYWORD' GROUP BY product_id, keyword)",
    "o_topp AS (SELECT product_id FROM o_ed0 GROUP BY product_id ORDER BY sum(v) DESC, product_id LIMIT 48)",
    "o_topk AS (SELECT norm FROM o_ed0 GROUP BY norm ORDER BY sum(v) DESC, norm LIMIT 110)",
    "o_ed1 AS (SELECT * FROM o_ed0 WHERE product_id IN (SELECT product_id FROM o_topp) AND norm IN (SELECT norm FROM o_topk))",
    "o_ed AS (SELECT *, 'P|' || product_id AS source, 'K|' || norm AS target, 0.25::DOUBLE + ln(1 + v) / ln(1 + max(v) OVER ()) * 2.75::DOUBLE AS w FROM o_ed1)",
    "o_deg AS (SELECT node_id, count(*) AS degree, sum(w) AS wd FROM (SELECT source AS node_id, w FROM o_ed UNION ALL SELECT target, w FROM o_ed) GROUP BY node_id)",
]


def chained(body: str) -> str:
    """The body after the tables that the queries' SQL shares."""
    return ctes() + ",\n" + ",\n".join(_CHAIN) + "\n" + body


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0 AS {n.split(' AS ')[-1]}" for n in names)


_SETTINGS_OUT = """SELECT 'item' AS file, CASE WHEN i.fin IS NOT NULL THEN 'u' ELSE '' END AS control, s.product_id, '' AS keyword, {item} AS item_cpc, '' AS keyword_cpc
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY keyword, ord) AS rn FROM settings) WHERE rn = 1) s LEFT JOIN (SELECT product_id, fin FROM o_fin WHERE eligible AND entity_type = 'ITEM') i USING (product_id)
UNION ALL SELECT 'keyword', CASE WHEN k.fin IS NOT NULL THEN 'u' ELSE '' END, s.product_id, s.keyword, s.item_cpc, {keyword} FROM settings s LEFT JOIN (SELECT product_id, keyword, fin FROM o_fin WHERE eligible AND entity_type = 'KEYWORD') k USING (product_id, keyword) WHERE s.keyword <> ''"""
_GRAMS = """g_n AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(text) - n + 2), lambda i: substr(text, i, n))))) AS gram FROM g_docs) GROUP BY id, gram),
g_idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM g_docs))::DOUBLE / (1 + count(*))) + 1 AS idf FROM g_n GROUP BY gram),
g_raw AS (SELECT id, gram, (1 + ln(n)) * idf AS w FROM g_n JOIN g_idf USING (gram)),
g_vec AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM g_raw)"""
_PRODUCT_VALUES = "o_pval AS (SELECT e.product_id, coalesce(i.sales_attr, e.v) AS value FROM (SELECT product_id, sum(v) AS v FROM o_ed GROUP BY product_id) e LEFT JOIN (SELECT product_id, sales_attr FROM o_hier WHERE entity_type = 'ITEM') i USING (product_id))"
_STOPS = ", ".join(f"'{t}'" for t in STOP_TERMS)
_MEANS = "(CASE WHEN sum(clicks) <> 0 THEN {0} ELSE 0 END)"

ORACLES = {
    "kpi_summary": chained("SELECT round(sum(clicks), 6) + 0 AS clicks, round(sum(cost), 6) + 0 AS cost, round(sum(sales_attr), 6) + 0 AS sales_attr, round(sum(orders_attr), 6) + 0 AS orders_attr, round(sum(sales_attr) / sum(cost) * 100, 6) + 0 AS roas_attr_pct, round(sum(orders_attr) / sum(clicks), 6) + 0 AS cvr_attr, round(sum(cost) / sum(clicks), 6) + 0 AS actual_cpc FROM o_win WHERE entity_type = 'ITEM'"),
    "top_products_by_roas": chained("SELECT product_id, " + _rounded("clicks", "cost", "sales_attr", "roas_attr_pct", "share AS sales_share_pct") + " FROM (SELECT *, sales_attr * 100 / sum(sales_attr) OVER () AS share FROM o_win WHERE entity_type = 'ITEM' AND cost > 0) ORDER BY roas_attr_pct DESC NULLS LAST, product_id LIMIT 10"),
    "ratio_metrics": chained("SELECT entity_key, " + _rounded("cvr_attr", "roas_attr_pct", "aov_attr", "cvr_attr_long", "roas_attr_pct_long", "aov_attr_long") + " FROM o_win"),
    "clean_numeric": chained(f"SELECT product_id, keyword, ord, {_number('item_cpc')} AS item_cpc, {_number('keyword_cpc')} AS keyword_cpc, CAST('1' || price AS DOUBLE) AS price FROM settings"),
    "clean_text": "SELECT p_partkey, p_name || ' x' AS cleaned, CASE WHEN p_partkey % 3 = 0 THEN 'NONE' ELSE upper(p_type) END AS kind, CASE WHEN length(p_name) > 6 THEN substr(p_name, 1, 5) || '…' ELSE p_name END AS label FROM part",
    "entity_keys": chained("SELECT snapshot_id, ord, platform || '|' || entity_type || '|' || product_id || '|' || keyword AS entity_key, substr(sha256(source_hash), 1, 16) AS digest FROM o_perf"),
    "date_periods": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND year(o_orderdate) >= 2000 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS period_start, CASE WHEN o_orderkey % 7 <> 0 AND year(o_orderdate) >= 2000 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS VARCHAR) END AS period_end, CASE WHEN o_orderkey % 7 <> 0 AND year(o_orderdate) >= 2000 THEN CAST(o_orderkey % 40 + 1 AS INT) END AS window_days, round(epoch(TIMESTAMP '2002-01-01' - o_orderdate) / 86400, 6) + 0 AS age_days FROM orders",
    "quality_row_errors": chained("SELECT snapshot_id, entity_key, errors FROM o_errs WHERE errors <> ''"),
    "quality_run_gate": chained("SELECT 'BLOCK' AS status, round(greatest(0, 100 - e * 100::DOUBLE / n - CASE WHEN dropped THEN 20 ELSE 0 END - least(10, dup * 0.1::DOUBLE)), 1) AS score, n AS rows, e AS row_error_count, round(e / n, 6) + 0 AS row_error_rate, dup AS duplicate_rows, dropped AS row_count_drop FROM (SELECT count(*) AS n, count(*) FILTER (WHERE errors <> '') AS e, (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM performance GROUP BY snapshot_id, entity_key HAVING count(*) > 1)) AS dup, true AS dropped FROM o_errs)"),
    "dedupe_snapshot": chained("SELECT snapshot_id, entity_key, ord, orders_attr FROM o_perf"),
    "snapshot_short": chained("SELECT entity_key, snapshot_id, clicks, CAST(period_end AS VARCHAR) AS period_end FROM o_short"),
    "snapshot_long": chained("SELECT entity_key, snapshot_id, clicks, CAST(period_end AS VARCHAR) AS period_end FROM o_long"),
    "analysis_windows": chained("SELECT entity_key, snapshot_id_shortwin, snapshot_id_longwin, trend_available, clicks, clicks_long, sales_attr, sales_attr_long FROM o_win"),
    "settings_item_pick": chained("SELECT * FROM o_item_set"),
    "settings_keyword_pick": chained("SELECT * FROM o_kw_set"),
    "master_enrich": chained("SELECT DISTINCT product_id, common_product_id, category, product_group, gross_margin_rate, CAST(other_promo_cost_rate AS DOUBLE) AS other_promo_cost_rate, item_min_cpc, stock_qty, product_status, CAST(launch_date AS VARCHAR) AS launch_date, role FROM o_ent0"),
    "latest_setting": chained("SELECT * FROM o_applied"),
    "latest_pending_plan": chained("SELECT * FROM o_planned"),
    "latest_metric_history": chained("SELECT * FROM o_hist"),
    "active_overrides": chained("SELECT * FROM o_over"),
    "reconcile_events": chained(f"SELECT {KEYS}, event_type, registered_cpc AS setting_cpc, prior_cpc, planned_cpc, state_effective_at AS effective_at FROM o_ent WHERE event_type IS NOT NULL"),
    "planned_status_update": chained("SELECT p.product_id, p.planned_cpc, coalesce(CASE e.event_type WHEN 'PLAN_CONFIRMED' THEN 'CONFIRMED' WHEN 'PLAN_NOT_APPLIED' THEN 'NOT_APPLIED' WHEN 'EXTERNAL_MANUAL_CHANGE' THEN 'SUPERSEDED' END, p.planned_status) AS planned_status, p.run_id FROM planned p LEFT JOIN (SELECT * FROM o_ent WHERE event_type IS NOT NULL) e ON e.product_id = p.product_id AND e.entity_type = p.entity_type AND e.keyword = p.keyword AND e.planned_run_id = p.run_id"),
    "input_hash": chained("SELECT sha256(string_agg(source_hash, '|' ORDER BY source_hash)) AS input_hash FROM (SELECT DISTINCT source_hash FROM performance)"),
    "group_priors": chained("SELECT entity_key, round(group_cvr, 6) + 0 AS prior_cvr, round(prior_aov, 6) + 0 AS prior_aov FROM o_pri"),
    "inherited_cvr": chained("SELECT entity_key, round(prior_cvr, 6) + 0 AS prior_cvr FROM o_e1 WHERE entity_type = 'KEYWORD'"),
    "beta_posterior": chained("SELECT entity_key, " + _rounded("mean AS smoothed_cvr", "low AS cvr_lower_bound", "sd AS cvr_posterior_sd", "aov AS expected_aov") + " FROM o_e5"),
    "current_bid": chained("SELECT entity_key, bid AS current_bid, current_bid_source, min_cpc, max_cpc FROM o_e3"),
    "attribution_maturity": chained("SELECT entity_key, round(mat, 6) + 0 AS attribution_maturity FROM o_e8"),
    "anomaly_signals": chained("SELECT entity_key, array_to_string(sig, '|') AS anomaly_signals FROM o_e8"),
    "dual_guard_cpc": chained("SELECT entity_key, CASE WHEN gross_margin_rate IS NULL THEN 'ASSUMED' ELSE 'PRODUCT_MASTER' END AS margin_source, " + _rounded("margin AS margin_rate_used", "profit_guard AS profit_guard_cpc", "roas_guard AS roas_guard_cpc", "CAST(trend AS DOUBLE) AS trend_multiplier".replace("CAST(trend AS DOUBLE)", "trend"), "raw AS raw_target_cpc") + " FROM o_e8"),
    "step_limited_cpc": chained("SELECT entity_key, step AS stepped_cpc, round(deadband, 6) + 0 AS deadband FROM o_e8"),
    "decision_case": chained("SELECT entity_key, action, status AS decision_status, reason AS reason_code, rec AS recommended_cpc, auto AS auto_approved_default, CASE WHEN auto THEN 'ACCEPT' ELSE 'PENDING' END AS operator_action, round(inc, 6) + 0 AS expected_incremental_profit FROM o_dec"),
    "parent_child_hierarchy": chained("SELECT entity_key, action, status AS decision_status, reason AS reason_code, rec AS recommended_cpc, auto AS auto_approved_default, round(rec - bid, 6) + 0 AS delta_cpc, round((rec - bid) / bid, 6) + 0 AS delta_pct FROM o_hier"),
    "duplicate_input_hold": chained("SELECT entity_key, status || CASE WHEN auto THEN '_DUPLICATE_INPUT' ELSE '' END AS decision_status, 'PENDING' AS operator_action, false AS auto_approved_default FROM o_hier"),
    "finalize_ops": chained("SELECT entity_key, answer AS operator_action, approved AS final_approved, fin AS final_cpc, changed AS final_changed, matched AS upload_match, eligible AS upload_eligible FROM o_fin"),
    "upload_validation": chained("SELECT entity_key, fin AS final_cpc, CASE WHEN NOT approved THEN 'NOT_APPROVED' WHEN NOT changed THEN 'APPROVED_NO_CHANGE' WHEN NOT matched THEN 'NO_SETTING_ROW' ELSE 'OUTPUT_INCLUDED' END AS upload_validation_status FROM o_fin"),
    "review_table": chained(f"SELECT {KEYS}, round(bid, 6) + 0 AS current_bid, rec AS recommended_cpc, fin AS final_cpc, approved AS final_approved, action, status AS decision_status, reason AS reason_code FROM o_fin"),
    "setting_full_output": chained(_SETTINGS_OUT.format(item="coalesce(CAST(i.fin AS VARCHAR), s.item_cpc)", keyword="coalesce(CAST(k.fin AS VARCHAR), s.keyword_cpc)")),
    "rollback_output": chained(_SETTINGS_OUT.format(item="s.item_cpc", keyword="s.keyword_cpc")),
    "status_counts": chained("SELECT status AS decision_status, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) + 0 AS share_pct FROM o_hier GROUP BY status"),
    "treemap_rollup": chained("SELECT coalesce(category, '') AS category, coalesce(product_id, '') AS product_id, round(coalesce(sum(sales_attr), 0), 6) + 0 AS value, round(coalesce(CASE WHEN sum(sales_attr) <> 0 THEN sum(sales_attr * coalesce(roas_attr_pct, 0)) / sum(sales_attr) END, 0), 6) + 0 AS roas_attr_pct, CAST(GROUPING(category, product_id) AS BIGINT) AS level FROM o_ent WHERE entity_type = 'ITEM' GROUP BY ROLLUP (category, product_id)"),
    "run_profile": chained("SELECT count(DISTINCT CASE WHEN entity_type = 'ITEM' THEN product_id END) AS products, count(DISTINCT CASE WHEN entity_type = 'KEYWORD' THEN keyword END) AS keywords, count(*) AS rows, count(*) FILTER (WHERE approved) AS approved, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE changed AND NOT matched) AS unmatched FROM o_fin"),
    "spearman_matrix": chained("SELECT \"left\", \"right\", round(coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0), 6) + 0 AS rho FROM (SELECT \"left\", \"right\", corr(rx, ry) AS r FROM (SELECT \"left\", \"right\", rank() OVER (PARTITION BY \"left\", \"right\" ORDER BY x) + (count(*) OVER (PARTITION BY \"left\", \"right\", x) - 1) / 2 AS rx, rank() OVER (PARTITION BY \"left\", \"right\" ORDER BY y) + (count(*) OVER (PARTITION BY \"left\", \"right\", y) - 1) / 2 AS ry FROM ("
        + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {a} AS x, {b} AS y FROM o_win WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in ("clicks", "cost", "sales_attr", "orders_attr") for b in ("clicks", "cost", "sales_attr", "orders_attr")) + ")) GROUP BY \"left\", \"right\")"),
    "term_frequency": chained("SELECT term, n AS keyword_count, round(v, 6) + 0 AS weighted_value, round(v / sum(v) OVER () * 100, 6) + 0 AS share_pct FROM (SELECT term, count(*) AS n, sum(coalesce(sales_attr, 0)) AS v FROM (SELECT sales_attr, unnest(terms) AS term FROM o_kw) WHERE term NOT IN (" + _STOPS + ") GROUP BY term) QUALIFY row_number() OVER (ORDER BY v DESC, n DESC, term) <= 30"),
    "term_cooccurrence": chained("SELECT a.term AS term_i, b.term AS term_j, round(CASE WHEN a.term = b.term THEN 1 ELSE sum(a.w) / sqrt(max(x.own) * max(y.own)) END, 6) + 0 AS score FROM o_tk a JOIN o_tk b USING (entity_key) JOIN o_own x ON x.term = a.term JOIN o_own y ON y.term = b.term GROUP BY a.term, b.term").replace("\nSELECT a.term AS term_i", ",\no_all AS (SELECT * FROM (SELECT entity_key, coalesce(clicks, 0) AS w, unnest(terms) AS term FROM o_kw) WHERE term NOT IN (" + _STOPS + ")),\no_own AS (SELECT term, sum(w) AS own FROM o_all GROUP BY term ORDER BY own DESC, count(*) DESC, term LIMIT 16),\no_tk AS (SELECT o_all.* FROM o_all JOIN o_own USING (term))\nSELECT a.term AS term_i"),
    "keyword_similarity": "WITH g_docs AS (SELECT DISTINCT lower(p_name) AS id, lower(p_name) AS text FROM part),\n" + _GRAMS + "\nSELECT a.id AS \"left\", b.id AS \"right\", round(sum(a.w * b.w), 6) + 0 AS similarity FROM g_vec a JOIN g_vec b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.34",
    "paired_similarity": "WITH g_docs AS (SELECT CAST(p_partkey AS VARCHAR) || '|0' AS id, lower(p_name) AS text FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR) || '|1', lower(p_type || ' ' || p_name) FROM part),\n" + _GRAMS + "\nSELECT p_partkey AS id, round(least(1, greatest(0, coalesce(s, 0))), 6) + 0 AS similarity FROM part LEFT JOIN (SELECT split_part(a.id, '|', 1) AS k, sum(a.w * b.w) AS s FROM g_vec a JOIN g_vec b ON a.gram = b.gram AND a.id = split_part(b.id, '|', 1) || '|0' AND b.id LIKE '%|1' GROUP BY 1) ON k = CAST(p_partkey AS VARCHAR)",
    "bipartite_edges": chained("SELECT source, target, round(v, 6) + 0 AS edge_value, round(clicks, 6) + 0 AS clicks, round(w, 6) + 0 AS layout_weight FROM o_ed"),
    "product_nodes": chained("SELECT 'P|' || product_id AS node_id, CASE WHEN length(label) > 24 THEN substr(label, 1, 23) || '…' ELSE label END AS label, i.action, i.status AS decision_status, i.rec AS recommended_cpc, round(coalesce(i.sales_attr, v), 6) + 0 AS value, round(coalesce(i.clicks, e.clicks), 6) + 0 AS clicks FROM (SELECT product_id, sum(v) AS v, sum(clicks) AS clicks FROM o_ed GROUP BY product_id) e LEFT JOIN (SELECT *, coalesce(product_name, product_id) AS label FROM o_hier WHERE entity_type = 'ITEM') i USING (product_id)"),
    "keyword_nodes": chained("SELECT 'K|' || norm AS node_id, CASE WHEN length(norm) > 18 THEN substr(norm, 1, 17) || '…' ELSE norm END AS label, count(*) AS product_count, round(sum(v), 6) + 0 AS value, round(sum(clicks), 6) + 0 AS clicks, round(sum(sales_attr), 6) + 0 AS sales_attr FROM o_ed GROUP BY norm"),
    "product_similarity": chained("SELECT 'P|' || a AS source, 'P|' || b AS target, round(s, 6) + 0 AS similarity, round(j, 6) + 0 AS shared_keyword_jaccard, round(0.25::DOUBLE + s * 4, 6) + 0 AS layout_weight FROM (SELECT *, 0.7::DOUBLE * j + 0.3::DOUBLE * m AS s FROM (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(j, 0) AS j, coalesce(m, 0) AS m FROM g_j x FULL JOIN g_m y ON x.a = y.a AND x.b = y.b)) WHERE s >= 0.18").replace("\nSELECT 'P|' || a AS source", """,
g_top AS (SELECT product_id FROM o_hier WHERE entity_type = 'KEYWORD' GROUP BY product_id ORDER BY sum(sales_attr) DESC NULLS LAST, product_id LIMIT 80),
g_set AS (SELECT DISTINCT product_id, keyword FROM o_hier WHERE entity_type = 'KEYWORD' AND product_id IN (SELECT product_id FROM g_top)),
g_size AS (SELECT product_id, count(*) AS n FROM g_set GROUP BY product_id),
g_j AS (SELECT a, b, k / (x.n + y.n - k) AS j FROM (SELECT p.product_id AS a, q.product_id AS b, count(*) AS k FROM g_set p JOIN g_set q ON p.keyword = q.keyword AND p.product_id < q.product_id GROUP BY ALL) JOIN g_size x ON x.product_id = a JOIN g_size y ON y.product_id = b),
g_docs AS (SELECT product_id AS id, trim(regexp_replace(lower(coalesce(i.product_name, product_id)), '[\\s#]+', '#', 'g')) AS text FROM g_top LEFT JOIN (SELECT product_id, product_name FROM o_hier WHERE entity_type = 'ITEM') i USING (product_id)),
""" + _GRAMS + """,
g_m AS (SELECT p.id AS a, q.id AS b, sum(p.w * q.w) AS m FROM g_vec p JOIN g_vec q ON p.gram = q.gram AND p.id < q.id GROUP BY ALL)
SELECT 'P|' || a AS source"""),
    "weighted_degree": chained("SELECT node_id, degree, round(wd, 6) + 0 AS weighted_degree FROM o_deg"),
    "roas_bands": chained("SELECT entity_key, CASE WHEN roas_attr_pct IS NULL THEN 'NONE' WHEN roas_attr_pct / 450 < 0.55 THEN 'LOW' WHEN roas_attr_pct / 450 < 0.9 THEN 'BELOW' WHEN roas_attr_pct / 450 < 1.2 THEN 'NEAR' ELSE 'ABOVE' END AS band, CASE WHEN regexp_matches(t, 'STOP|PAUSE|MIN_BID|TERMINATED') THEN 'STOP' WHEN regexp_matches(t, 'SCALE_UP|INCREASE|RAISE|UP_BID') THEN 'SCALE_UP' WHEN regexp_matches(t, 'SCALE_DOWN|DECREASE|LOWER|DOWN_BID') THEN 'SCALE_DOWN' WHEN regexp_matches(t, 'KEEP|HOLD|UNCHANGED') THEN 'KEEP' WHEN regexp_matches(t, 'OBSERVE|EXPLORE|INSUFFICIENT|REVIEW|PENDING|UNKNOWN') THEN 'OBSERVE' ELSE 'NEUTRAL' END AS action_class FROM (SELECT *, action || ' ' || status AS t FROM o_hier)"),
    "ego_network": chained("SELECT source, target, round(v, 6) + 0 AS edge_value FROM o_ed WHERE source = (SELECT source FROM o_ed GROUP BY source ORDER BY sum(v) DESC, source LIMIT 1) ORDER BY v DESC, target LIMIT 12"),
    "search_neighbourhood": chained("SELECT node_id, bool_or(hit) AS hit FROM (SELECT target AS node_id, true AS hit FROM o_ed WHERE contains(norm, 'bolt') UNION ALL SELECT source, false FROM o_ed WHERE contains(norm, 'bolt')) GROUP BY node_id"),
    "keyword_nearest": chained("SELECT least(a, b) AS source, greatest(a, b) AS target, round(max(s), 6) + 0 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rn FROM (SELECT p.id AS a, q.id AS b, sum(p.w * q.w) AS s FROM g_vec p JOIN g_vec q ON p.gram = q.gram AND p.id <> q.id GROUP BY ALL HAVING sum(p.w * q.w) >= 0.34)) WHERE rn <= 3 GROUP BY 1, 2").replace("\nSELECT least(a, b)", ",\ng_docs AS (SELECT norm AS id, norm AS text FROM o_kw GROUP BY norm ORDER BY coalesce(sum(sales_attr), 0) DESC, norm LIMIT 120),\n" + _GRAMS + "\nSELECT least(a, b)"),
    "graph_components": chained("SELECT node_id, min(m) AS component FROM reach GROUP BY node_id").replace("\nSELECT node_id, min(m)", ",\nlinks AS (SELECT source AS a, target AS b FROM o_ed UNION ALL SELECT target, source FROM o_ed),\nreach AS (SELECT DISTINCT a AS node_id, a AS m FROM links UNION SELECT reach.node_id, links.b FROM reach JOIN links ON links.a = reach.m)\nSELECT node_id, min(m)").replace("WITH ", "WITH RECURSIVE ", 1),
    "next_plans": chained(f"SELECT {KEYS}, CAST(fin AS DOUBLE) AS planned_cpc, 'PENDING' AS planned_status, answer AS source, 'run_1' AS run_id FROM o_fin WHERE eligible"),
    "metric_append": chained(f"SELECT {KEYS}, clicks, cost, sales_attr, orders_attr, " + _rounded("cvr_attr", "roas_attr_pct", "bid AS registered_cpc") + ", CAST(period_start_shortwin AS VARCHAR) AS period_start FROM o_fin"),
    "action_append": chained(f"SELECT {KEYS}, round(bid, 6) + 0 AS previous_cpc, rec AS recommended_cpc, fin AS final_cpc, action, status AS decision_status, answer AS operator_action, CASE WHEN eligible THEN 'PLANNED' ELSE 'NOT_APPLIED' END AS outcome_status, '2001-11-15' AS outcome_due_date FROM o_fin"),
    "next_overrides": chained(f"SELECT {KEYS}, CASE answer WHEN 'LOCK' THEN 'LOCK_CPC' ELSE 'FORCE_STOP' END AS override_mode, CAST(fin AS DOUBLE) AS override_cpc, true AS active, 'run_1' AS created_run_id FROM o_fin WHERE answer IN ('LOCK', 'FORCE_STOP')"),
    "run_append": chained("SELECT 'run_1' AS run_id, repeat('0', 64) AS input_hash, 'BLOCK' AS quality_status, count(*) FILTER (WHERE entity_type = 'ITEM') AS item_rows, count(*) FILTER (WHERE entity_type = 'KEYWORD') AS keyword_rows, false AS duplicate_input FROM o_fin"),
    "network_totals": chained("SELECT p AS products, k AS keywords, e AS edges, round(CASE WHEN p + k > 1 THEN 2::DOUBLE * e / ((p + k) * (p + k - 1)) ELSE 0 END, 6) + 0 AS density, round(CASE WHEN total > 0 THEN top * 100::DOUBLE / total ELSE 0 END, 6) + 0 AS top10_share_pct FROM (SELECT count(DISTINCT source) AS p, count(DISTINCT target) AS k, count(*) AS e FROM o_ed), (SELECT sum(value) AS total, sum(value) FILTER (WHERE rn <= 10) AS top FROM (SELECT value, row_number() OVER (ORDER BY value DESC, product_id) AS rn FROM o_pval))").replace("\nSELECT p AS products", f",\n{_PRODUCT_VALUES}\nSELECT p AS products"),
    "top_entities": chained("SELECT node_id, round(wd, 6) + 0 AS weighted_degree, round(value, 6) + 0 AS value FROM o_deg JOIN o_pval ON node_id = 'P|' || product_id ORDER BY wd DESC, value DESC, node_id LIMIT 10").replace("\nSELECT node_id, round(wd", f",\n{_PRODUCT_VALUES}\nSELECT node_id, round(wd"),
    "semantic_edges": chained("SELECT source, target, round(v, 6) + 0 AS edge_value, round(w, 6) + 0 AS layout_weight, round(least(1, greatest(0, coalesce(s, 0))), 6) + 0 AS semantic_relevance FROM o_ed LEFT JOIN (SELECT split_part(a.id, '^', 1) AS sp, split_part(a.id, '^', 2) AS sn, sum(a.w * b.w) AS s FROM g_vec a JOIN g_vec b ON a.gram = b.gram AND ends_with(a.id, '^0') AND ends_with(b.id, '^1') AND left(a.id, length(a.id) - 1) = left(b.id, length(b.id) - 1) GROUP BY 1, 2) ON sp = product_id AND sn = norm").replace("LIMIT 48", "LIMIT 50").replace("\nSELECT source, target", ",\ng_name AS (SELECT product_id, norm, trim(regexp_replace(lower(coalesce(nullif(trim(n), ''), product_id)), '[\\s\\-_]+', ' ', 'g')) AS name FROM o_ed LEFT JOIN (SELECT product_id, keyword AS norm, min(product_name) AS n FROM o_hier WHERE entity_type = 'KEYWORD' GROUP BY ALL) USING (product_id, norm)),\ng_docs AS (SELECT product_id || '^' || norm || '^0' AS id, name AS text FROM g_name UNION ALL SELECT product_id || '^' || norm || '^1', norm FROM g_name),\n" + _GRAMS + "\nSELECT source, target"),
    "normalised_phrases": "SELECT p_partkey, lower(p_name) AS phrase FROM part",
    "keyword_graph_nodes": chained("SELECT 'K|' || norm AS node_id, 'KEYWORD' AS node_type, norm AS keyword, round(coalesce(sum(sales_attr), 0), 6) + 0 AS value FROM o_kw GROUP BY norm ORDER BY coalesce(sum(sales_attr), 0) DESC, norm LIMIT 120"),
    "keyword_graph_edges": chained("SELECT 'K|' || least(a, b) AS source, 'K|' || greatest(a, b) AS target, round(max(s), 6) + 0 AS similarity, round(0.25::DOUBLE + max(s) * 3.5::DOUBLE, 6) + 0 AS layout_weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rn FROM (SELECT p.id AS a, q.id AS b, sum(p.w * q.w) AS s FROM g_vec p JOIN g_vec q ON p.gram = q.gram AND p.id <> q.id GROUP BY ALL HAVING sum(p.w * q.w) >= 0.34)) WHERE rn <= 4 GROUP BY least(a, b), greatest(a, b)").replace("\nSELECT 'K|' || least(a, b)", ",\ng_docs AS (SELECT norm AS id, norm AS text FROM o_kw GROUP BY norm ORDER BY coalesce(sum(sales_attr), 0) DESC, norm LIMIT 120),\n" + _GRAMS + "\nSELECT 'K|' || least(a, b)"),
    "decision_view": chained("SELECT entity_key, status AS decision_status, round(inc, 6) + 0 AS expected_incremental_profit, round(sales_attr, 6) + 0 AS sales_attr FROM o_hier WHERE entity_type = 'KEYWORD' AND status IN ('KEEP', 'KEEP_UNCERTAIN_UPSIDE', 'SCALE_DOWN_AUTO_READY', 'SCALE_UP_REVIEW_REQUIRED', 'PARENT_STOP_AUTO_READY') AND coalesce(inc, 0) >= -500 AND contains(lower(product_id || ' ' || coalesce(product_name, '') || ' ' || keyword), 'bolt')"),
    "decisions_in_order": chained("SELECT entity_key, status AS decision_status, round(inc, 6) + 0 AS expected_incremental_profit, round(cost, 6) + 0 AS cost FROM o_hier WHERE entity_type = 'ITEM' ORDER BY status, inc DESC NULLS LAST, o_hier.cost DESC NULLS LAST, entity_key LIMIT 100"),
    "report_files": chained("SELECT entity_key, CAST(period_end AS VARCHAR) AS period_end, CAST(window_days AS BIGINT) AS window_days, " + _rounded("clicks", "cost", "sales_attr", "orders_attr", "impressions", "actual_cpc") + " FROM performance_once"),
    "file_profiles": "SELECT CAST(n_regionkey AS BIGINT) AS region, 'rakuten_rpp_setting' AS kind, 'utf-8-sig' AS encoding, 9 AS columns, count(*) AS rows FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey",
    "state_appended": chained(f"SELECT {KEYS}, planned_cpc, planned_status, run_id, 1 AS place FROM planned UNION ALL SELECT {KEYS}, planned_cpc, 'PENDING', 'run_1', 2 FROM planned"),
    "store_latest_plan": chained("SELECT product_id, planned_cpc, CASE WHEN planned_cpc < 90 THEN 'run_1' ELSE 'run_0' END AS planned_run_id FROM planned WHERE upper(planned_status) = 'PENDING'"),
    "payload_nodes": chained("SELECT 'P|' || product_id AS node_id, 'PRODUCT' AS node_type, product_id AS label, product_id, coalesce(category, '') AS category, round(coalesce(i.sales_attr, v), 6) + 0 AS value, round(coalesce(i.sales_attr, e.sales), 6) + 0 AS sales, round(coalesce(i.clicks, e.clicks), 6) + 0 AS clicks, CAST(0 AS BIGINT) AS product_count, CASE WHEN regexp_matches(t, 'STOP|PAUSE|MIN_BID|TERMINATED') THEN 'STOP' WHEN regexp_matches(t, 'SCALE_UP|INCREASE|RAISE|UP_BID') THEN 'SCALE_UP' WHEN regexp_matches(t, 'SCALE_DOWN|DECREASE|LOWER|DOWN_BID') THEN 'SCALE_DOWN' WHEN regexp_matches(t, 'KEEP|HOLD|UNCHANGED') THEN 'KEEP' WHEN regexp_matches(t, 'OBSERVE|EXPLORE|INSUFFICIENT|REVIEW|PENDING|UNKNOWN') THEN 'OBSERVE' ELSE 'NEUTRAL' END AS action_class, coalesce(status, '') AS decision_status, CAST(coalesce(rec, 0) AS DOUBLE) AS recommended_cpc FROM (SELECT product_id, sum(v) AS v, sum(clicks) AS clicks, sum(sales_attr) AS sales FROM o_ed GROUP BY product_id) e LEFT JOIN (SELECT *, action || ' ' || status AS t FROM o_hier WHERE entity_type = 'ITEM') i USING (product_id) WHERE 'P|' || product_id <> (SELECT source FROM o_ed GROUP BY source ORDER BY sum(v) DESC, source LIMIT 1) UNION ALL SELECT 'K|' || norm, 'KEYWORD', norm, '', '', round(sum(v), 6) + 0, round(sum(sales_attr), 6) + 0, round(sum(clicks), 6) + 0, count(*), NULL, NULL, NULL FROM o_ed GROUP BY norm"),
    "payload_edges": chained("SELECT source, target, round(v, 6) + 0 AS value, round(sales_attr, 6) + 0 AS sales, round(clicks, 6) + 0 AS clicks FROM o_ed WHERE source <> (SELECT source FROM o_ed GROUP BY source ORDER BY sum(v) DESC, source LIMIT 1)"),
}
