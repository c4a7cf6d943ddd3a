"""Bid decisions as projections: economics, the rules in order, the parent's precedence, and the operator's answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions.columns import beta_posterior, clip, days_between, maturity, truthy
from bidweave.schema import APPROVING, HARD_STOP, Policy
from bidweave.session import written

GROUP = ["platform", "entity_type", "category", "product_group"]


def group_priors(rows: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Adds prior_cvr and prior_aov: of the category and group, else of the platform and entity type, else 0 and 3000.

    Sums are made a group, in part before the shuffle, written, and joined back: as their size is known then, the rows aren't dealt out
    by their few groups. products: rows that have been added up by product and kind already, with their category and group, instead of
    the rows themselves.
    """
    sums = ["clicks", "orders_attr", "sales_attr"]
    groups = written((rows if products is None else products).groupBy(*GROUP).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"__{c}") for c in sums]), "groups")
    market = groups.groupBy(*GROUP[:2]).agg(*[F.sum(f"__{c}").alias(f"__all_{c}") for c in sums])

    def rates(df: DataFrame, prefix: str, cvr: str, aov: str, keys: list[str]) -> DataFrame:
        clicks, orders, sales = (F.col(f"{prefix}{c}") for c in sums)
        return df.select(*[F.col(k).alias(f"{cvr}_{k}") for k in keys], F.when(clicks > 0, orders / clicks).alias(cvr), F.when(orders > 0, sales / orders).alias(aov))

    out = _joined(_joined(rows, rates(groups, "__", "__cvr", "__aov", GROUP), GROUP, "__cvr"), rates(market, "__all_", "__mcvr", "__maov", GROUP[:2]), GROUP[:2], "__mcvr")
    return out.withColumns({"prior_cvr": F.coalesce("__cvr", "__mcvr", F.lit(0.0)), "prior_aov": F.coalesce("__aov", "__maov", F.lit(3000.0))}).drop("__cvr", "__aov", "__mcvr", "__maov")


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """rows with their group's row of the table; null is a group like any other."""
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}_{k}")) for k in keys])
    return rows.join(table, same, "left").drop(*[f"{prefix}_{k}" for k in keys])


def inherit_parent_cvr(rows: DataFrame) -> DataFrame:
    """Keywords take their product's own conversion rate as prior, where it has one."""
    items = written(rows.where("entity_type = 'ITEM' AND cvr_attr IS NOT NULL").groupBy("platform", "product_id").agg(F.max_by("cvr_attr", "entity_key").alias("__parent")), "rates")
    out = rows.join(items, ["platform", "product_id"], "left")
    return out.withColumn("prior_cvr", F.when((F.col("entity_type") == "KEYWORD") & F.col("__parent").isNotNull(), F.col("__parent")).otherwise(F.col("prior_cvr"))).drop("__parent")


def bid_bounds(policy: Policy) -> tuple[Column, Column]:
    """The product's bounds where they are positive, else the policy's; the upper is at least the lower."""
    low = F.when(F.col("item_min_cpc") > 0, F.col("item_min_cpc")).otherwise(policy.min_cpc_default)
    high = F.when(F.col("item_max_cpc") > 0, F.col("item_max_cpc")).otherwise(policy.max_cpc_default)
    return low, F.greatest(low, high)


def current_bid(policy: Policy) -> Column:
    """struct<value, source>: the first positive of the sources in order of trust."""
    pinned = F.upper(F.coalesce("override_mode", F.lit(""))).isin("LOCK_CPC", "BASELINE")
    sources = [
        (F.when(pinned, F.col("override_cpc")), "MANUAL_OVERRIDE"),
        (F.col("registered_cpc"), "UPLOADED_SETTING"),
        (F.col("state_applied_cpc"), "PRIOR_STATE"),
        (F.col("registered_bid_report_shortwin"), "REPORT_REGISTERED_BID"),
        (F.col("actual_cpc"), "ACTUAL_CPC_FALLBACK"),
        (F.lit(policy.min_cpc_default), "POLICY_MIN_FALLBACK"),
    ]
    return F.coalesce(*[F.when(c > 0, F.struct(c.alias("value"), F.lit(name).alias("source"))) for c, name in sources])


def anomaly_signals(policy: Policy) -> Column:
    """Which metrics have moved sharply against the last run, where both runs have clicks enough."""
    enough = (F.coalesce("clicks", F.lit(0.0)) >= policy.anomaly_min_clicks) & (F.col("prev_clicks") >= policy.anomaly_min_clicks)
    signals = F.array_compact(F.array(
        F.when((F.col("prev_cvr_attr") > 0) & (F.col("cvr_attr") <= F.col("prev_cvr_attr") * (1 - policy.anomaly_cvr_drop_rate)), F.lit("CVR_DROP")),
        F.when((F.col("prev_roas_attr_pct") > 0) & (F.col("roas_attr_pct") <= F.col("prev_roas_attr_pct") * (1 - policy.anomaly_roas_drop_rate)), F.lit("ROAS_DROP")),
        F.when((F.col("prev_actual_cpc") > 0) & (F.col("actual_cpc") >= F.col("prev_actual_cpc") * (1 + policy.anomaly_cpc_rise_rate)), F.lit("CPC_RISE")),
    ))
    return F.when(enough, signals).otherwise(F.array().cast("array<string>"))


def economics(rows: DataFrame, policy: Policy, as_of: Column) -> DataFrame:
    """Adds the current bid, the smoothed conversion, the guards and the recommended bid before any rule."""
    low, high = bid_bounds(policy)
    out = rows.withColumns({"min_cpc": low, "max_cpc": high, "__bid": current_bid(policy)})
    out = out.withColumns({"current_bid": clip(F.col("__bid.value"), F.col("min_cpc"), F.col("max_cpc")), "current_bid_source": F.col("__bid.source")}).drop("__bid")
    mean, lower, sd = beta_posterior(F.col("orders_attr"), F.col("clicks"), F.col("prior_cvr"), policy.bayes_prior_clicks)
    zero, one = F.lit(0.0), F.lit(1.0)
    out = out.withColumns({
        "smoothed_cvr": mean, "cvr_lower_bound": lower, "cvr_posterior_sd": sd,
        "expected_aov": F.when(F.col("aov_attr") > 0, F.col("aov_attr")).otherwise(F.col("prior_aov")),
        "margin_rate_used": clip(F.coalesce("gross_margin_rate", F.lit(policy.default_margin_rate)), zero, one),
        "margin_source": F.when(F.col("gross_margin_rate").isNull(), "ASSUMED").otherwise("PRODUCT_MASTER"),
        "promo_cost_rate_used": clip(F.coalesce("other_promo_cost_rate", F.lit(policy.other_promo_cost_rate_default)), zero, one),
    })
    contribution = F.greatest(F.col("margin_rate_used") - F.col("promo_cost_rate_used"), zero)
    out = out.withColumns({
        "expected_sales_per_click": F.col("smoothed_cvr") * F.col("expected_aov"),
        "expected_contribution_before_ad_per_click": F.col("smoothed_cvr") * F.col("expected_aov") * contribution,
        "lower_contribution_before_ad_per_click": F.col("cvr_lower_bound") * F.col("expected_aov") * contribution,
    })
    out = out.withColumns({
        "profit_guard_cpc": F.col("expected_contribution_before_ad_per_click") * (1 - policy.profit_safety_buffer_rate),
        "roas_guard_cpc": F.col("expected_sales_per_click") / max(policy.target_roas_pct / 100, 0.01),
        "trend_multiplier": F.when(
            truthy(F.col("trend_available")) & (F.col("cvr_attr_long") > 0), F.greatest(F.lit(0.75), F.least(F.lit(1.15), F.sqrt(F.col("smoothed_cvr") / F.greatest(F.col("cvr_attr_long"), F.lit(1e-6))))),
        ).otherwise(1.0),
    })
    out = out.withColumn("raw_target_cpc", clip(F.least("profit_guard_cpc", "roas_guard_cpc") * F.col("trend_multiplier"), F.col("min_cpc"), F.col("max_cpc")))
    bid = F.col("current_bid")
    up = F.least(bid * (1 + policy.max_raise_pct), bid + policy.max_absolute_change_yen, F.col("max_cpc"))
    down = F.greatest(bid * (1 - policy.max_down_pct), bid - policy.max_absolute_change_yen, F.col("min_cpc"))
    bounded = clip(F.when(F.col("raw_target_cpc") > bid, F.least("raw_target_cpc", up)).otherwise(F.greatest("raw_target_cpc", down)), F.col("min_cpc"), F.col("max_cpc"))
    whole = F.ceil(bounded) if policy.round_mode.upper() == "CEIL" else F.bround(bounded, 0)
    return out.withColumns({
        "stepped_cpc": clip(whole.cast("double"), F.col("min_cpc"), F.col("max_cpc")).cast("long"),
        "deadband": F.greatest(F.lit(policy.deadband_yen), bid * policy.deadband_pct),
        "attribution_maturity": maturity(F.col("platform"), F.col("period_start_shortwin"), F.col("period_end_shortwin"), F.col("executed_at_shortwin"), as_of, policy.attribution_hours_rakuten, policy.attribution_hours_yahoo),
        "signals": anomaly_signals(policy),
    })


def decision_rules(policy: Policy, as_of: Column) -> list[tuple]:
    """The rules in order, of rows with the override's mode in capitals as __mode: condition, action, status, reason, bid and whether it is approved by itself. Texts are constants or columns."""
    bid, step, mode = F.col("current_bid"), F.col("stepped_cpc"), F.col("__mode")
    clicks, orders = F.coalesce("clicks", F.lit(0.0)), F.coalesce("orders_attr", F.lit(0.0))
    assumed = F.col("gross_margin_rate").isNull()
    no = F.lit(False)

    def young(c: str, days: int) -> Column:
        return days_between(as_of, F.col(c).cast("timestamp")) < days

    ripe = F.col("attribution_maturity") >= 0.5
    return [
        (truthy(F.col("row_quality_block")), "MANUAL_REVIEW", "BLOCKED_DATA_QUALITY", "ROW_DATA_ERROR", "keep"),
        (mode == "EXCLUDE", "EXCLUDE", "EXCLUDED_MANUAL", "MANUAL_EXCLUDE", "keep"),
        ((mode == "FORCE_STOP") | F.upper(F.coalesce("product_status", F.lit("ACTIVE"))).isin(HARD_STOP) | F.coalesce(F.col("stock_qty") <= 0, no), "STOP_OR_MIN_CPC", "STOP_AUTO_READY", "HARD_STOP", "least"),
        (mode == "LOCK_CPC", "KEEP", "MANUAL_LOCK", "MANUAL_CPC_LOCK", "keep"),
        (F.size("signals") >= policy.anomaly_required_signals, "MANUAL_REVIEW", "ANOMALY_MANUAL_INTERVENTION", F.array_join("signals", "+"), "keep"),
        (young("state_effective_at", policy.change_observation_days), "OBSERVE", "OBSERVE_AFTER_CHANGE", "MEASUREMENT_LOCK", "keep"),
        (assumed & F.lit(not policy.allow_assumed_margin_for_simulation), "MANUAL_REVIEW", "HOLD_MISSING_MARGIN", "MISSING_MARGIN", "keep"),
        (young("launch_date", policy.new_product_observation_days), "OBSERVE", "OBSERVE_NEW_PRODUCT", "NEW_PRODUCT", "keep"),
        (clicks == 0, "MANUAL_REVIEW", "NO_TRAFFIC_REVIEW", "ZERO_CLICK_NOT_PERFORMANCE_STOP", "keep"),
        (clicks < policy.min_clicks_for_judgement, "OBSERVE", "HOLD_INSUFFICIENT_DATA", "INSUFFICIENT_CLICKS", "keep"),
        ((orders <= 0) & (clicks >= policy.no_order_stop_clicks), "STOP_OR_MIN_CPC", "STOP_AUTO_READY", "NO_ORDER_STOP_THRESHOLD", "least"),
        ((F.col("raw_target_cpc") <= F.col("min_cpc")) & (F.col("expected_contribution_before_ad_per_click") <= bid), "STOP_OR_MIN_CPC", "STOP_AUTO_READY", "NON_POSITIVE_UNIT_ECONOMICS", "least"),
        (F.abs(step - bid) < F.col("deadband"), "KEEP", "KEEP", "WITHIN_DEADBAND", "keep"),
        (step < bid, "SCALE_DOWN", F.when(ripe, "SCALE_DOWN_AUTO_READY").otherwise("SCALE_DOWN_REVIEW_PROVISIONAL_ATTRIBUTION"), "PROFIT_OR_ROAS_GUARD_DOWN", "down"),
        (F.col("lower_contribution_before_ad_per_click") > step, "SCALE_UP", F.when(assumed, "SCALE_UP_REVIEW_MISSING_MARGIN").otherwise("SCALE_UP_REVIEW_REQUIRED"), "LOWER_BOUND_PROFITABLE", "up"),
        (F.lit(True), "KEEP", "KEEP_UNCERTAIN_UPSIDE", "UNCERTAIN_SCALE_UP", "keep"),
    ]


def decision_case(rows: DataFrame, policy: Policy, as_of: Column) -> DataFrame:
    """Adds action, decision_status, reason_code, recommended_cpc and auto_approved_default of the first rule that applies.

    The rule's number is found first and the rest looked up by it: with every rule's answers written out in each branch, the code that
    Spark makes of a row is too long for the JVM to compile.
    """
    rules = decision_rules(policy, as_of)
    number = reduce(lambda case, rule: case.when(rule[1][0], rule[0]), enumerate(rules[1:], 2), F.when(rules[0][0], 1))
    rule = F.col("__rule")

    def said(k: int) -> Column:
        """The rules' answers of this place: constants are taken from a list."""
        known = F.element_at(F.array(*[F.lit(None if isinstance(r[k], Column) else r[k]) for r in rules]), rule)
        return reduce(lambda out, n: F.when(rule == n, rules[n - 1][k]).otherwise(out), [n for n, r in enumerate(rules, 1) if isinstance(r[k], Column)], known)

    def of(*kinds: str) -> Column:
        return rule.isin([n for n, r in enumerate(rules, 1) if r[4] in kinds])

    assumed, ripe = F.col("gross_margin_rate").isNull(), F.col("attribution_maturity") >= 0.5
    down = F.lit(policy.auto_ready_scale_down) & (~assumed | F.lit(policy.allow_assumed_margin_for_upload)) & ripe
    bid = F.when(of("least"), F.col("min_cpc").cast("long")).when(of("down", "up"), F.col("stepped_cpc").cast("long")).otherwise(F.bround("current_bid", 0).cast("long"))
    auto = F.when(of("least"), F.lit(policy.auto_ready_stop)).when(of("down"), down).otherwise(False)
    return rows.withColumn("__rule", number).withColumns({"action": said(1), "decision_status": said(2), "reason_code": said(3), "recommended_cpc": bid, "auto_approved_default": auto}).drop("__rule", "__mode")


def decisions(rows: DataFrame, policy: Policy, as_of: Column, products: DataFrame | None = None) -> DataFrame:
    """rows (windows with settings, state, master, history and overrides) with their decisions, before the parent's word. products: see `group_priors`."""
    # Made before the rules, of which several ask for it.
    rows = rows.withColumn("__mode", F.upper(F.coalesce("override_mode", F.lit(""))))
    out = decision_case(economics(inherit_parent_cvr(group_priors(rows, products)), policy, as_of), policy, as_of)
    # What depends on an assumed margin is never uploaded by itself, unless the policy lets it.
    auto = F.col("auto_approved_default") & (F.col("gross_margin_rate").isNotNull() | F.lit(policy.allow_assumed_margin_for_upload))
    out = out.withColumns({"auto_approved_default": auto, "anomaly_signals": F.array_join("signals", "|")}).drop("signals")
    moved = F.col("recommended_cpc") - F.col("current_bid")
    profit = F.col("expected_contribution_before_ad_per_click") - F.col("recommended_cpc")
    return out.withColumns({
        "delta_cpc": moved, "delta_pct": F.when(F.col("current_bid") != 0, moved / F.col("current_bid")),
        "expected_unit_profit_current": F.col("expected_contribution_before_ad_per_click") - F.col("current_bid"), "expected_unit_profit_recommended": profit,
        "expected_incremental_profit": F.coalesce("clicks", F.lit(0.0)) * 0.5 * (moved / F.greatest("current_bid", F.lit(1.0))) * profit,
        "operator_action": F.when(F.col("auto_approved_default"), "ACCEPT").otherwise("PENDING"), "operator_cpc": F.col("recommended_cpc"), "operator_reason": F.lit(""),
    })


def with_hierarchy(decided: DataFrame) -> DataFrame:
    """A product's stop stops its keywords, and a product that scales down caps keywords that would scale up.

    The products' decisions are written: as their size is known then, keywords are moved to them only where they are many.
    """
    parent = written(decided.where("entity_type = 'ITEM'").groupBy("platform", "product_id").agg(F.min_by(F.struct("action", "recommended_cpc", "auto_approved_default"), "entity_key").alias("__parent")), "parents")
    out = decided.join(parent, ["platform", "product_id"], "left")
    keyword, above = (F.col("entity_type") == "KEYWORD") & F.col("__parent").isNotNull(), F.col("__parent.action")
    # What the parent says, as a number that all answers are looked up by.
    word = F.when(keyword & (above == "STOP_OR_MIN_CPC"), 1).when(keyword & (above == "SCALE_DOWN") & (F.col("action") == "SCALE_UP"), 2).when(keyword, 3).otherwise(0)
    out = out.withColumn("__word", word)
    stopped, capped, child = F.col("__word") == 1, F.col("__word") == 2, F.col("__word") > 0
    cap, auto = F.least(F.col("current_bid"), F.col("__parent.recommended_cpc").cast("double")), F.col("__parent.auto_approved_default")
    lower = cap < F.col("current_bid")

    def pick(c: str, if_stopped: Column, if_capped: Column) -> Column:
        return F.when(stopped, if_stopped).when(capped, if_capped).otherwise(F.col(c))

    out = out.withColumns({
        "recommended_cpc": pick("recommended_cpc", F.col("min_cpc").cast("long"), F.bround(cap, 0).cast("long")),
        "action": pick("action", F.lit("STOP_OR_MIN_CPC"), F.when(lower, "SCALE_DOWN").otherwise("KEEP")),
        "decision_status": pick("decision_status", F.when(auto, "PARENT_STOP_AUTO_READY").otherwise("PARENT_STOP_REVIEW"), F.lit("PARENT_PRODUCT_CAP")),
        "reason_code": pick("reason_code", F.lit("PARENT_PRODUCT_STOP"), F.lit("PARENT_PRODUCT_PRIORITY")),
        "auto_approved_default": pick("auto_approved_default", auto, lower),
        "operator_action": pick("operator_action", F.when(auto, "ACCEPT").otherwise("PENDING"), F.when(lower, "ACCEPT").otherwise("PENDING")),
    })
    moved = F.col("recommended_cpc") - F.col("current_bid")
    return out.withColumns({
        "delta_cpc": F.when(child, moved).otherwise(F.col("delta_cpc")), "delta_pct": F.when(child, F.when(F.col("current_bid") != 0, moved / F.col("current_bid"))).otherwise(F.col("delta_pct")),
        "operator_cpc": F.when(child, F.col("recommended_cpc")).otherwise(F.col("operator_cpc")),
    }).drop("__parent", "__word")


def decision_view(decided: DataFrame, *, entity_types: list[str] | None = None, statuses: list[str] | None = None, least_profit: float | None = None, text: str = "") -> DataFrame:
    """The decisions of these kinds and states with a profit of at least so much, whose product, name or keyword has the text.

    The text is taken as it is, blind to case. Rows come by expected profit and sales, the greatest first.
    """
    out = decided
    if entity_types is not None:
        out = out.where(F.col("entity_type").isin(entity_types))
    if statuses is not None:
        out = out.where(F.col("decision_status").isin(statuses))
    if least_profit is not None:
        out = out.where(F.coalesce("expected_incremental_profit", F.lit(0.0)) >= least_profit)
    if text.strip():
        names = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("product_id", "product_name", "keyword") if c in decided.columns])
        out = out.where(F.contains(F.lower(names), F.lit(text.strip().lower())))
    return out.orderBy(F.desc_nulls_last("expected_incremental_profit"), F.desc_nulls_last("sales_attr"), "entity_key")


def decision_order() -> list[Column]:
    """By state, then the greatest expected profit and the greatest cost."""
    return [F.asc("decision_status"), F.desc_nulls_last("expected_incremental_profit"), F.desc_nulls_last("cost"), F.asc("entity_key")]


def hold_duplicates(decided: DataFrame, duplicate: bool | Column) -> DataFrame:
    """Nothing of an input that was seen before is approved by itself."""
    held = (F.lit(duplicate) if isinstance(duplicate, bool) else duplicate) & (F.col("operator_action") == "ACCEPT")
    return decided.withColumn("decision_status", F.when(held, F.concat("decision_status", F.lit("_DUPLICATE_INPUT"))).otherwise(F.col("decision_status"))).withColumns({
        "auto_approved_default": F.col("auto_approved_default") & ~held, "operator_action": F.when(held, "PENDING").otherwise(F.col("operator_action")),
    })


def finalise(decided: DataFrame, *, blocked: bool = False) -> DataFrame:
    """Adds final_approved, final_cpc, final_changed, upload_match and upload_eligible from the operator's answers.

    An approval without a bid is not eligible and is marked operator_cpc_missing. A blocked run approves nothing.
    """
    out = decided.withColumn("operator_action", F.upper(F.coalesce("operator_action", F.lit("PENDING"))))
    answer, approved = F.col("operator_action"), F.col("final_approved")
    out = out.withColumn("final_approved", answer.isin(APPROVING) & ~F.lit(blocked))
    cpc = F.when(answer == "FORCE_STOP", F.col("min_cpc")).when(approved, F.col("operator_cpc").cast("double")).otherwise(F.col("current_bid"))
    out = out.withColumn("final_cpc", F.ceil(clip(cpc, F.col("min_cpc"), F.col("max_cpc"))))
    out = out.withColumn("operator_cpc_missing", F.col("final_approved") & F.col("final_cpc").isNull())
    out = out.withColumns({
        "final_changed": F.coalesce(F.col("final_approved") & (F.col("final_cpc") != F.ceil("current_bid")), F.lit(False)),
        "upload_match": F.when(F.lower("platform") == "rakuten", truthy(F.col("setting_row_exists"))).otherwise(True),
    })
    return out.withColumn("upload_eligible", F.col("final_changed") & F.col("upload_match"))


def upload_validation(finalised: DataFrame) -> DataFrame:
    status = F.when(~F.col("final_approved"), "NOT_APPROVED").when(~F.col("final_changed"), "APPROVED_NO_CHANGE").when(~F.col("upload_match"), "NO_SETTING_ROW").when(F.col("upload_eligible"), "OUTPUT_INCLUDED").otherwise("REVIEW")
    return finalised.withColumn("upload_validation_status", status)


def review_table(finalised: DataFrame) -> DataFrame:
    """The columns that a platform without an upload layout is reviewed by."""
    wanted = ["platform", "entity_type", "product_id", "keyword", "current_bid", "recommended_cpc", "operator_cpc", "final_cpc", "final_approved", "action", "decision_status", "reason_code", "reason"]
    return finalised.select(*[c for c in wanted if c in finalised.columns])


def full_outputs(settings: DataFrame, finalised: DataFrame) -> dict[str, DataFrame]:
    """Four tables of whole setting rows: items and keywords with their new bids marked `u`, and both with their old bids.

    settings: control, product_id, product_name, price, url, item_cpc, keyword, keyword_cpc, guide_cpc as text and ord.
    """
    ready = finalised.where("upload_eligible").select("entity_type", "product_id", "keyword", F.col("final_cpc").cast("string").alias("new_cpc"))
    items = ready.where("entity_type = 'ITEM'").select("product_id", "new_cpc")
    keywords = ready.where("entity_type = 'KEYWORD'").select("product_id", "keyword", "new_cpc")
    columns = [c for c in settings.columns if c != "ord"]
    empty = F.lit("")
    one = settings.withColumn("__n", F.row_number().over(Window.partitionBy("product_id").orderBy("keyword", "ord"))).where("__n = 1").drop("__n", "ord")
    one = one.withColumns({"keyword": empty, "keyword_cpc": empty, "guide_cpc": empty}).join(items, "product_id", "left")
    words = settings.where("keyword <> ''").drop("ord").join(keywords, ["product_id", "keyword"], "left")
    mark = F.when(F.col("new_cpc").isNotNull(), "u").otherwise("")

    def changed(df: DataFrame, bid: str) -> DataFrame:
        return df.withColumns({"control": mark, bid: F.coalesce("new_cpc", bid)}).select(*columns)

    return {
        "item_full": changed(one, "item_cpc"), "keyword_full": changed(words, "keyword_cpc"),
        "item_rollback": one.withColumn("control", mark).select(*columns), "keyword_rollback": words.withColumn("control", mark).select(*columns),
    }
