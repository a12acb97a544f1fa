"""Data-quality constraints as queries that return the rows which break them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import scoring


def expect(df: DataFrame, keys: Sequence[str], rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Violations (keys, rule, detail) of all rules in one pass. A rule is a condition that must hold
    and the detail to report; an unknown condition counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (ok, detail) in rules.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("v")).select(*keys, "v.rule", "v.detail")


def activity_violations(activity: DataFrame, keys: Sequence[str], pads: DataFrame | None = None) -> DataFrame:
    """Counts are non-negative and add up, the share matches them, and, where pad rows are supplied,
    their composition matches."""
    new, cont, idle, active, share = (F.col(c) for c in ("n_new", "n_cont", "n_idle", "absolute_active", "share_active"))
    total = new + cont + idle
    rules = {
        "counts_non_negative": (F.least(new, cont, idle, active) >= 0, F.least(new, cont, idle, active)),
        "active_is_sum": (active == new + cont, active - new - cont),
        "share_in_unit": (share.between(0.0, 1.0), share),
        "share_matches_counts": ((total <= 0) | (F.abs(F.try_divide(new + cont, total) - share) <= 1e-6), share),
    }
    rows = activity
    if pads is not None:
        per = pads.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(f"_p{i}") for i, s in enumerate(params.STATES)])
        rows = activity.join(per, list(keys), "left")
        absent = F.col("_p0").isNull()
        for i, (name, c) in enumerate(zip(("new", "cont", "idle"), (new, cont, idle))):
            rules[f"pads_match_{name}"] = (absent | (F.col(f"_p{i}") == c), F.col(f"_p{i}"))
    return expect(rows, keys, rules)


def divergence_violations(df: DataFrame, keys: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """The stored class must follow from the stored, rounded percentage; a percentage within rounding
    distance of a threshold may fall on either side."""
    pct, cls = F.col("divergence_pct"), F.col("divergence_class")
    near = (cls == scoring.divergence_class(pct - tolerance)) | (cls == scoring.divergence_class(pct + tolerance)) | (cls == scoring.divergence_class(pct))
    return expect(df, keys, {"class_matches_pct": (near, F.concat_ws("/", cls, pct.cast("string")))})


def size_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size is one of the locked sizes, zero without a trade, and the tier's size with one."""
    size, long = F.col("size"), F.col("decision") == "long"
    return expect(df, keys, {
        "size_locked": (size.isin(*sorted(params.TIER_SIZE.values())), size),
        "no_trade_is_flat": (long | (size == 0), size),
        "long_matches_tier": (~long | (F.abs(size - scoring.tier_size(F.col("conviction_tier"))) <= 1e-9), size),
    })


def completeness(cells: DataFrame, outputs: DataFrame, results: DataFrame, keys: Sequence[str], stages: int = 5) -> DataFrame:
    """A cell is complete when every stage has a row, all are valid and without error, and the cell has
    a result."""
    keys = list(keys)
    per = outputs.groupBy(*keys).agg(F.count_distinct("stage").alias("_n"), F.bool_and(F.col("valid") & (F.coalesce("error", F.lit("")) == "")).alias("_ok"))
    done = results.select(*keys).distinct().withColumn("_r", F.lit(True))
    rows = cells.select(*keys).join(per, keys, "left").join(done, keys, "left")
    return rows.select(*keys, F.coalesce((F.col("_n") == stages) & F.col("_ok") & F.col("_r"), F.lit(False)).alias("complete"))


def leaks(df: DataFrame, availability: str, t: str = "t") -> DataFrame:
    """Rows that became available only after the decision date they were used for; must be empty."""
    return df.where(F.col(availability) > F.col(t))


def canonical_text(col: str, dtype: str) -> Column:
    """A value as text that other engines write alike: numbers with a fraction to 13 digits, times as
    microseconds, the elements of an array in billionths one after the other."""
    if dtype in ("double", "float"):
        return F.format_string("%.12e", F.col(col).cast("double"))
    if dtype.startswith("timestamp"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("string")
    if dtype in ("array<double>", "array<float>"):
        return F.array_join(F.transform(col, lambda x: F.floor(x.cast("double") * 1e9).cast("string")), ",")
    return F.col(col).cast("string")


def row_hash(df: DataFrame) -> Column:
    """A 60-bit hash of a row as a decimal. A row's text has each column's name and its value with the value's
    length, or "null", so no two rows read alike."""
    texts = [(c, canonical_text(c, t)) for c, t in df.dtypes]
    text = F.concat(*[F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("null"))) for c, t in texts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and order-free content hash of a table over all its columns: row hashes are summed as
    decimals, so neither order nor partitioning matters and the sum cannot overflow."""
    total = F.coalesce(F.sum(row_hash(df)), F.lit(0).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("content_hash")).select(F.lit(name).alias("table_name"), "n_rows", "content_hash")
