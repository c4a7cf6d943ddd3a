"""Every branch of the decision chain, on one-row tables."""

import pytest
from pyspark.sql import functions as F

from bidweave.operators import decide
from bidweave.schema import Policy

#: A lamp that earns a bid of about 58 (a conversion of 0.075, 3500 a sale, 450 % of return), registered at 56.
BASE = {
    "entity_key": "rakuten|ITEM|lamp-7|", "platform": "rakuten", "entity_type": "ITEM", "product_id": "lamp-7", "keyword": "", "category": "lighting", "product_group": "indoor", "role": "GROWTH", "product_status": "ACTIVE",
    "registered_cpc": 56.0, "registered_bid_report_shortwin": 51.0, "actual_cpc": 36.0, "clicks": 240.0, "orders_attr": 18.0, "sales_attr": 63000.0, "cost": 8640.0, "cvr_attr": 0.075, "aov_attr": 3500.0, "roas_attr_pct": 729.2, "cvr_attr_long": 0.075,
    "gross_margin_rate": 0.32, "other_promo_cost_rate": 0.0, "item_min_cpc": 26.0, "item_max_cpc": 90.0, "stock_qty": 12.0, "launch_date": "2024-11-30", "trend_available": False,
    "period_start_shortwin": "2026-01-12", "period_end_shortwin": "2026-01-18", "executed_at_shortwin": "2026-03-20 00:00:00", "row_quality_block": False, "setting_row_exists": True, "override_mode": None, "override_cpc": None,
    "state_applied_cpc": None, "state_effective_at": None, "prev_clicks": None, "prev_cvr_attr": None, "prev_roas_attr_pct": None, "prev_actual_cpc": None,
}
TYPES = {"launch_date": "date", "period_start_shortwin": "date", "period_end_shortwin": "date", "executed_at_shortwin": "timestamp", "state_effective_at": "timestamp"}


def as_of():
    return F.lit("2026-03-20 00:00:00").cast("timestamp")


def table(spark, *rows):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) or v is None and k not in ('override_mode', 'state_effective_at') else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in BASE.items())
    full = [{**BASE, **r} for r in rows]
    df = spark.createDataFrame([tuple(r[k] for k in BASE) for r in full], schema)
    return df.withColumns({k: F.col(k).cast(t) for k, t in TYPES.items()})


def one(spark, policy=Policy(), **overrides):
    return decide.decisions(table(spark, overrides), policy, as_of()).first()


ZERO = {"clicks": 0.0, "cost": 0.0, "sales_attr": 0.0, "orders_attr": 0.0, "cvr_attr": 0.0}
NO_ORDERS = {**ZERO, "clicks": 64.0, "cost": 2304.0}
DROP = {"cvr_attr": 0.02, "roas_attr_pct": 150.0, "actual_cpc": 70.0, "prev_clicks": 310.0, "prev_cvr_attr": 0.08, "prev_roas_attr_pct": 700.0, "prev_actual_cpc": 35.0}
POOR = {"sales_attr": 1800.0, "orders_attr": 2.0, "cvr_attr": 2 / 240, "aov_attr": 900.0, "roas_attr_pct": 20.8}
RICH = {"clicks": 900.0, "orders_attr": 90.0, "sales_attr": 315000.0, "cvr_attr": 0.1, "registered_cpc": 40.0}


@pytest.mark.parametrize(
    "overrides, action, status, cpc",
    [
        ({"row_quality_block": True}, "MANUAL_REVIEW", "BLOCKED_DATA_QUALITY", 56),
        ({"override_mode": "EXCLUDE"}, "EXCLUDE", "EXCLUDED_MANUAL", 56),
        ({"override_mode": "force_stop"}, "STOP_OR_MIN_CPC", "STOP_AUTO_READY", 26),
        ({"product_status": "discontinued"}, "STOP_OR_MIN_CPC", "STOP_AUTO_READY", 26),
        ({"stock_qty": 0.0}, "STOP_OR_MIN_CPC", "STOP_AUTO_READY", 26),
        ({"override_mode": "LOCK_CPC", "override_cpc": 61.0}, "KEEP", "MANUAL_LOCK", 61),
        (DROP, "MANUAL_REVIEW", "ANOMALY_MANUAL_INTERVENTION", 56),
        ({"state_effective_at": "2026-03-17 00:00:00"}, "OBSERVE", "OBSERVE_AFTER_CHANGE", 56),
        ({"launch_date": "2026-03-10"}, "OBSERVE", "OBSERVE_NEW_PRODUCT", 56),
        (ZERO, "MANUAL_REVIEW", "NO_TRAFFIC_REVIEW", 56),
        ({**ZERO, "clicks": 8.0}, "OBSERVE", "HOLD_INSUFFICIENT_DATA", 56),
        (NO_ORDERS, "STOP_OR_MIN_CPC", "STOP_AUTO_READY", 26),
        (POOR, "STOP_OR_MIN_CPC", "STOP_AUTO_READY", 26),
        ({"registered_cpc": 60.0}, "KEEP", "KEEP", 60),
        ({"registered_cpc": 85.0}, "SCALE_DOWN", "SCALE_DOWN_AUTO_READY", 59),
        ({"registered_cpc": 85.0, "period_end_shortwin": "2026-03-19", "period_start_shortwin": "2026-03-13"}, "SCALE_DOWN", "SCALE_DOWN_REVIEW_PROVISIONAL_ATTRIBUTION", 59),
        (RICH, "SCALE_UP", "SCALE_UP_REVIEW_REQUIRED", 60),
        ({**RICH, "gross_margin_rate": None}, "SCALE_UP", "SCALE_UP_REVIEW_MISSING_MARGIN", 60),
    ],
)
def test_branches(spark, overrides, action, status, cpc):
    r = one(spark, **overrides)
    assert (r["action"], r["decision_status"], r["recommended_cpc"]) == (action, status, cpc)


def test_settings_come_before_actual_cost(spark):
    r = one(spark, actual_cpc=19.0)
    assert (r["current_bid"], r["current_bid_source"]) == (56.0, "UPLOADED_SETTING")
    assert one(spark, registered_cpc=None, state_applied_cpc=33.0)["current_bid_source"] == "PRIOR_STATE"
    assert one(spark, registered_cpc=None, registered_bid_report_shortwin=None, actual_cpc=None)["current_bid"] == 26.0


def test_anomaly_names_its_signals(spark):
    r = one(spark, **DROP)
    assert r["anomaly_signals"] == "CVR_DROP|ROAS_DROP|CPC_RISE" and r["reason_code"] == "CVR_DROP+ROAS_DROP+CPC_RISE"


def test_assumed_margins_are_not_approved_by_themselves(spark):
    r = one(spark, gross_margin_rate=None, **NO_ORDERS)
    assert r["auto_approved_default"] is False and r["operator_action"] == "PENDING" and r["margin_source"] == "ASSUMED"
    assert one(spark, Policy(allow_assumed_margin_for_simulation=False), gross_margin_rate=None)["decision_status"] == "HOLD_MISSING_MARGIN"
    assert one(spark, **NO_ORDERS)["auto_approved_default"] is True


def test_parents_stop_and_cap_their_keywords(spark):
    def pair(parent, child):
        rows = table(spark, parent, {"entity_type": "KEYWORD", "keyword": "k", "entity_key": "rakuten|KEYWORD|lamp-7|k", **child})
        out = decide.with_hierarchy(decide.decisions(rows, Policy(), as_of())).where("entity_type = 'KEYWORD'").first()
        return out["action"], out["decision_status"], out["recommended_cpc"], out["operator_cpc"], out["delta_cpc"]

    assert pair(NO_ORDERS, RICH) == ("STOP_OR_MIN_CPC", "PARENT_STOP_AUTO_READY", 26, 26, -14.0)
    assert pair({**NO_ORDERS, "gross_margin_rate": None}, RICH)[1] == "PARENT_STOP_REVIEW"
    assert pair({"registered_cpc": 85.0}, {**RICH, "registered_cpc": 70.0})[:3] == ("SCALE_DOWN", "PARENT_PRODUCT_CAP", 59)
    assert pair({}, RICH)[1] == "SCALE_UP_REVIEW_REQUIRED"


def test_answers_are_final(spark):
    rows = decide.decisions(table(spark, {"registered_cpc": 85.0}, {"setting_row_exists": False, "registered_cpc": 85.0}), Policy(), as_of())

    def final(action, cpc=None, **kw):
        changed = rows.withColumns({"operator_action": F.lit(action), "operator_cpc": F.lit(cpc).cast("long") if cpc is not None or kw.pop("none", False) else F.col("operator_cpc")})
        return decide.upload_validation(decide.finalise(changed, **kw)).orderBy(F.desc("setting_row_exists")).collect()

    a, b = final("accept")
    assert (a["final_cpc"], a["upload_eligible"], a["upload_validation_status"]) == (59, True, "OUTPUT_INCLUDED")
    assert (b["upload_match"], b["upload_validation_status"]) == (False, "NO_SETTING_ROW")
    assert final("MODIFY", 300)[0]["final_cpc"] == 90 and final("FORCE_STOP")[0]["final_cpc"] == 26
    assert final("REJECT")[0]["upload_validation_status"] == "NOT_APPROVED" and final("LOCK", 85)[0]["upload_validation_status"] == "APPROVED_NO_CHANGE"
    assert final("ACCEPT", none=True)[0]["operator_cpc_missing"] is True and final("ACCEPT", none=True)[0]["upload_eligible"] is False
    assert final("ACCEPT", blocked=True)[0]["final_approved"] is False


def test_duplicates_are_held(spark):
    r = decide.hold_duplicates(decide.decisions(table(spark, NO_ORDERS), Policy(), as_of()), True).first()
    assert (r["operator_action"], r["decision_status"], r["auto_approved_default"]) == ("PENDING", "STOP_AUTO_READY_DUPLICATE_INPUT", False)


@pytest.mark.parametrize("bid", [26.0, 33.0, 47.5, 62.0, 89.0])
def test_steps_stay_within_their_limits(spark, bid):
    for r in (one(spark, registered_cpc=bid), one(spark, **{**RICH, "registered_cpc": bid}), one(spark, **{**POOR, "registered_cpc": bid})):
        step = r["stepped_cpc"]
        assert 26 <= step <= 90 and step <= min(bid * 1.5, bid + 30) + 1 and step >= min(bid, max(bid * 0.5, bid - 30)) - 1e-9
