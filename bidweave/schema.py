"""Keys, schemas and the policy that decisions follow."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


KEYS = ["platform", "entity_type", "product_id", "keyword"]



PERFORMANCE = (
    "platform string, entity_type string, product_id string, keyword string, registered_bid_report double, impressions double, clicks double, cost double, "
    "actual_cpc double, sales_short double, orders_short double, sales_attr double, orders_attr double, ctr_pct double, period_start date, period_end date, "
    "source_name string, source_hash string, snapshot_id string, executed_at timestamp, window_days int, entity_key string, ord long"
)
#: A raw settings row and a raw master row, for runs that have none.
SETTING_ROW = "control string, product_id string, product_name string, price string, url string, item_cpc string, keyword string, keyword_cpc string, guide_cpc string, ord long"
MASTER_COLUMNS = "product_id string, ord long"
_KEY = "platform string, entity_type string, product_id string, keyword string"
#: The state that one run leaves to the next.
STATE_TABLES = {
    "applied_settings": f"{_KEY}, applied_cpc double, applied_status string, effective_at timestamp, source string, run_id string",
    "planned_settings": f"{_KEY}, planned_cpc double, planned_status string, planned_at timestamp, source string, run_id string",
    "manual_overrides": f"override_id string, {_KEY}, override_mode string, override_cpc double, effective_from timestamp, effective_until timestamp, active boolean, reason string, created_run_id string",
    "action_history": f"run_id string, {_KEY}, period_start date, period_end date, previous_cpc double, recommended_cpc long, operator_cpc double, final_cpc long, action string, decision_status string, operator_action string, operator_reason string, applied_at timestamp, outcome_due_date date, outcome_status string",
    "metric_history": f"run_id string, {_KEY}, period_start date, period_end date, clicks double, cost double, sales_attr double, orders_attr double, actual_cpc double, cvr_attr double, roas_attr_pct double, registered_cpc double, captured_at timestamp",
    "run_history": "run_id string, created_at timestamp, input_hash string, policy_hash string, quality_status string, quality_score double, item_rows long, keyword_rows long, duplicate_input boolean",
}
#: What of the state the next run joins, divided by keys: the last rows of applied and metric history, open plans, and overrides that can still count.
CURRENT_TABLES = {
    "current_applied": f"{_KEY}, applied_cpc double, effective_at timestamp, source string",
    "current_planned": f"{_KEY}, planned_cpc double, planned_status string, planned_at timestamp, run_id string",
    "current_metrics": f"{_KEY}, period_end date, captured_at timestamp, clicks double, cvr_attr double, roas_attr_pct double, actual_cpc double",
    "current_overrides": f"{_KEY}, override_mode string, override_cpc double, effective_from timestamp, effective_until timestamp, active boolean",
}
#: Statuses of a product that stop its bids.
HARD_STOP = ["OUT_OF_STOCK", "DISCONTINUED", "RESERVED", "INACTIVE", "STOP"]
#: What an operator can answer to a decision, and which answers approve it.
OPERATOR_ACTIONS = ["PENDING", "ACCEPT", "MODIFY", "LOCK", "FORCE_STOP", "REJECT"]
APPROVING = ["ACCEPT", "MODIFY", "LOCK", "FORCE_STOP"]


@dataclass(frozen=True)
class Policy:
    """Names and defaults of the decision's parameters."""

    schema_version: int = 2
    objective: str = "CONTRIBUTION_PROFIT"
    target_roas_pct: float = 450.0
    default_margin_rate: float = 0.35
    allow_assumed_margin_for_simulation: bool = True
    allow_assumed_margin_for_upload: bool = False
    other_promo_cost_rate_default: float = 0.0
    profit_safety_buffer_rate: float = 0.10
    min_cpc_default: float = 24.0
    max_cpc_default: float = 100.0
    max_raise_pct: float = 0.50
    max_down_pct: float = 0.50
    max_absolute_change_yen: float = 30.0
    deadband_pct: float = 0.10
    deadband_yen: float = 3.0
    round_mode: str = "CEIL"
    short_window_days: int = 7
    long_window_days: int = 28
    min_clicks_for_judgement: int = 10
    no_order_stop_clicks: int = 50
    new_product_observation_days: int = 14
    change_observation_days: int = 7
    bayes_prior_clicks: float = 20.0
    data_missing_block_rate: float = 0.01
    row_count_drop_block_rate: float = 0.20
    anomaly_min_clicks: int = 20
    anomaly_cvr_drop_rate: float = 0.50
    anomaly_roas_drop_rate: float = 0.50
    anomaly_cpc_rise_rate: float = 0.50
    anomaly_required_signals: int = 2
    auto_ready_scale_down: bool = True
    auto_ready_stop: bool = True
    scale_up_requires_manual: bool = True
    auto_rollback: bool = False
    platform: str = "rakuten"
    attribution_hours_rakuten: int = 720
    attribution_hours_yahoo: int = 24

    @classmethod
    def from_dict(cls, raw: dict | None) -> Policy:
        """Unknown names are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (raw or {}).items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)
