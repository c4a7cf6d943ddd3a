"""Column expressions that the operators share. All treat null as absent and let no NaN through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that text fields are trimmed of, with the ideographic space.
SPACE = " \t\n\v\f\r\u3000\u00a0"
#: Normal quantile for the one-sided 90 % lower bound.
Z = 1.2816


def clean_text(c: Column) -> Column:
    """Null becomes empty; ideographic spaces become spaces; both ends are trimmed."""
    return F.btrim(F.translate(F.coalesce(c.cast("string"), F.lit("")), "　", " "), F.lit(SPACE))


def clean_number(c: Column) -> Column:
    """Text such as `1,234円` or `12.5%` as double; empty, dashes and anything else that is no finite decimal number as null."""
    text = F.translate(clean_text(c), ",円%", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def finite(c: Column, default: float | None = None) -> Column:
    """Null, NaN and infinities become the default."""
    x = c.cast("double")
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x), F.lit(default).cast("double"))


def truthy(c: Column) -> Column:
    """Text booleans: 1, true, yes, y and on are true."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def ratio(num: Column, den: Column, factor: float = 1.0) -> Column:
    """num / den * factor, null unless den is positive."""
    return F.when(den > 0, num / den * factor if factor != 1.0 else num / den)


def clip(v: Column, low: Column, high: Column) -> Column:
    """Within the bounds; low wins if they cross. Null stays null."""
    return F.when(v.isNotNull(), F.greatest(low, F.least(high, v)))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000


def entity_key() -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("platform", "entity_type", "product_id", "keyword")])


def spread(*names: str) -> Column:
    """A number of these columns to sort and join by ahead of them: keys that begin alike, as an entity's do, are told apart by one comparison."""
    return F.xxhash64(*names)


def spread_of(performance: DataFrame) -> Column:
    """The entity key's spread: the rows' own, where they have one as __spread, so that steps in a row sort by the same column."""
    return F.col("__spread") if "__spread" in performance.columns else spread("entity_key")


def period_from_text(c: Column) -> tuple[Column, Column]:
    """First and last date of `YYYY年MM月DD日～YYYY年MM月DD日`."""
    pattern = r"(20\d{2})年(\d{2})月(\d{2})日[～~-](20\d{2})年(\d{2})月(\d{2})日"
    part = [F.regexp_extract(F.coalesce(c, F.lit("")), pattern, i) for i in range(1, 7)]
    return F.concat_ws("-", *part[:3]).try_cast("date"), F.concat_ws("-", *part[3:]).try_cast("date")


def window_days(start: Column, end: Column) -> Column:
    """Both days count."""
    return F.datediff(end, start) + 1


def rate(c: Column) -> Column:
    """35 and 0.35 are the same rate."""
    return F.when(c > 1, c / 100).otherwise(c)


def or_default(c: Column, default: str) -> Column:
    """Cleaned text, or the default if it is empty."""
    return F.coalesce(F.nullif(clean_text(c), F.lit("")), F.lit(default))


def first_filled(*cs: Column) -> Column:
    """The first text that isn't blank, else empty."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cs], F.lit(""))


def short_label(c: Column, limit: int) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


#: The words in an action and its status that put it into a class, the first class that has one winning.
ACTION_WORDS = {
    "STOP": ["STOP", "PAUSE", "MIN_BID", "FORCE_STOP", "OUT_OF_STOCK", "TERMINATED"],
    "SCALE_UP": ["SCALE_UP", "INCREASE", "RAISE", "UP_BID"],
    "SCALE_DOWN": ["SCALE_DOWN", "DECREASE", "LOWER", "DOWN_BID"],
    "KEEP": ["KEEP", "HOLD", "UNCHANGED"],
    "OBSERVE": ["OBSERVE", "EXPLORE", "INSUFFICIENT", "REVIEW", "PENDING", "UNKNOWN"],
}


def action_class(action: Column, status: Column) -> Column:
    """The class of an action and its status; NEUTRAL if they have none of the words."""
    text = F.upper(F.concat_ws(" ", F.coalesce(action, F.lit("")), F.coalesce(status, F.lit(""))))
    return F.coalesce(*[F.when(text.rlike("|".join(words)), F.lit(name)) for name, words in ACTION_WORDS.items()], F.lit("NEUTRAL"))


def log_weight(value: Column, largest: Column, base: float = 0.25, span: float = 2.75) -> Column:
    """base, and up to span more by the logarithm of the value against the largest; nulls and zeros in largest give base."""
    return base + F.coalesce(F.try_divide(F.log1p(value), F.log1p(largest)), F.lit(0.0)) * span


def beta_posterior(orders: Column, clicks: Column, prior: Column, strength: float) -> tuple[Column, Column, Column]:
    """Mean, lower bound and standard deviation of a conversion rate, from a Beta prior worth `strength` clicks."""
    clicks = F.greatest(F.coalesce(clicks, F.lit(0.0)), F.lit(0.0))
    orders = F.greatest(F.least(F.coalesce(orders, F.lit(0.0)), clicks), F.lit(0.0))
    prior = F.greatest(F.least(F.coalesce(prior, F.lit(0.0)), F.lit(1 - 1e-6)), F.lit(1e-6))
    a, b = orders + prior * strength, (clicks - orders) + (1 - prior) * strength
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return mean, F.greatest(F.lit(0.0), mean - Z * sd), sd


def maturity(platform: Column, start: Column, end: Column, executed: Column, as_of: Column, rakuten_hours: int, other_hours: int) -> Column:
    """The mean share of its attribution period that each day of the window has behind it; 0.5 without a window."""
    horizon = F.when(F.lower(platform) == "rakuten", max(rakuten_hours / 24, 1.0)).otherwise(max(other_hours / 24, 1.0))
    days = F.greatest(F.datediff(end, start) + 1, F.lit(1))
    lag = F.greatest(days_between(F.coalesce(executed, as_of), end.cast("timestamp")), F.lit(0.0))
    # The day that lies i before the last has the share (i + lag) / horizon, 1 at most: an arithmetic series, then ones.
    young = F.least(F.greatest(F.ceil(horizon - lag), F.lit(0)), days).cast("double")
    total = (days - young) + (young * (young - 1) / 2 + young * lag) / horizon
    return F.when(start.isNull() | end.isNull(), 0.5).otherwise(total / days)


def latest_by(df: DataFrame, keys: list[str], order: list[str], values: list[str], *, where: Column | None = None) -> DataFrame:
    """One row a key with the values of its last row, by the order's columns; nulls in them are before all else."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last")).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values])
