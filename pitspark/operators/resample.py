"""Clustered resampling and tests.

Trades are reduced to one row of sums per cluster before any replicate is drawn, so the work is
(replicates x clusters) and not (replicates x trades). Draws are hashes of (seed, replicate, slot):
the same whatever the partitioning, and the same after a lost executor."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions.hashing import hash_prefix, index_draw
from pitspark.operators.core import block_scan, dense_index, range_blocks

ALL = "_all"


def _by(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group columns, with a constant one where there are none."""
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(1)), [ALL])


def _replicates(clusters: DataFrame, by: list[str], cluster: str, sums: Sequence[str], n_iter: int, seed: int) -> DataFrame:
    """Sums of each replicate: k clusters drawn with replacement out of k, repeats counted again."""
    indexed = dense_index(clusters, by, cluster)
    size = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    slots = indexed.select(*by, F.col("idx").alias("slot")).join(size, by).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    drawn = slots.select(*by, "rep", index_draw(F.concat_ws("|", F.lit(str(seed)), "rep", "slot"), F.col("k")).alias("idx"))
    return drawn.join(indexed.select(*by, "idx", *sums), [*by, "idx"]).groupBy(*by, "rep").agg(*[F.sum(s).alias(s) for s in sums])


def replicate_stats(trades: DataFrame, cluster: str, n_iter: int = 1000, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Hit rate, mean and mean/deviation of every replicate (0 without spread)."""
    trades, by = _by(trades, by)
    r = F.col("net_return")
    clusters = trades.groupBy(*by, cluster).agg(
        F.count(r).alias("n"), F.count_if(r > 0).alias("wins"), F.sum(r).alias("s"), F.sum(r * r).alias("ss"),
    )
    reps = _replicates(clusters, by, cluster, ["n", "wins", "s", "ss"], n_iter, seed)
    mean = F.col("s") / F.col("n")
    var = (F.col("ss") - F.col("s") * mean) / (F.col("n") - 1)
    flat = (F.col("n") < 2) | (F.col("ss") - F.col("s") * mean <= F.col("ss") * 1e-12)
    return reps.select(*by, "rep", (F.col("wins") / F.col("n")).alias("hit_rate"), mean.alias("mean_return"), F.when(flat, 0.0).otherwise(mean / F.sqrt(var)).alias("sharpe"))


def cluster_bootstrap(trades: DataFrame, cluster: str, n_iter: int = 1000, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Mean and 95 % percentile interval of hit rate, mean return and Sharpe over the replicates."""
    reps = replicate_stats(trades, cluster, n_iter, seed, by)
    metrics = ["hit_rate", "mean_return", "sharpe"]
    keys = list(by) or [ALL]
    long = reps.unpivot(keys, metrics, "metric", "x")
    out = long.groupBy(*keys, "metric").agg(
        F.avg("x").alias("mean"), F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"), F.count("x").alias("n_iter"),
    )
    return out.drop(ALL)


def primary_test(trades: DataFrame, cluster: str, n_iter: int = 1000, seed: int = 0, by: Sequence[str] = (), null: float = 0.5) -> DataFrame:
    """One-sided test that the hit rate exceeds the null: replicates are shifted to the null's mean and
    p is the share at or above the observed rate. The interval is that of the unshifted replicates.
    ``p_exact`` is the tail of a fair coin for the same wins and trades."""
    reps = replicate_stats(trades, cluster, n_iter, seed, by)
    tagged, keys = _by(trades, by)
    observed = tagged.groupBy(*keys).agg(F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate_obs"), F.count_if(F.col("net_return") > 0).alias("wins"), F.count("net_return").alias("n"))
    return binomial_tail(_centred(reps, observed, keys, "hit_rate", "hit_rate_obs", null), keys, "wins", "n").drop(ALL)


def _centred(reps: DataFrame, observed: DataFrame, keys: list[str], stat: str, obs: str, null: float) -> DataFrame:
    """Interval, and the share of replicates at or above the observed value once their mean is moved to
    the null. The list per group holds ``n_iter`` numbers, so the replicates are computed once."""
    centre = reps.groupBy(*keys).agg(
        F.avg(stat).alias("_m"), F.percentile(stat, F.lit(0.025)).alias("ci_low"), F.percentile(stat, F.lit(0.975)).alias("ci_high"),
        F.count(stat).alias("n_iter"), F.collect_list(stat).alias("_xs"),
    )
    base = observed.join(centre, keys)
    # Compared at twelve digits: the shifted value and the observed one come from different sums.
    beyond = F.filter("_xs", lambda x: F.round(x - F.col("_m") + F.lit(null) - F.col(obs), 12) >= 0)
    p = F.size(beyond) / F.col("n_iter")
    return base.withColumns({"p_value": p, "reject": p < 0.05}).drop("_m", "_xs")


def block_diff_test(a: DataFrame, b: DataFrame, cluster: str = "fpe", threshold: float = 0.03, n_iter: int = 1000, seed: int = 0) -> DataFrame:
    """Does a's hit rate exceed b's by more than the threshold? Clusters are those of either side, a
    replicate with an empty side is left out, and the shift is to the threshold."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(F.lit(1).alias(ALL), F.col(cluster), F.lit(s).alias("_side"), (F.col("net_return") > 0).alias("_win"))

    both = side(a, "a").unionByName(side(b, "b"))

    def count(s: str, won: bool) -> Column:
        cond = F.col("_side") == s
        return F.count_if(cond & F.col("_win") if won else cond)

    sums = {"na": count("a", False), "wa": count("a", True), "nb": count("b", False), "wb": count("b", True)}
    clusters = both.groupBy(ALL, cluster).agg(*[c.alias(k) for k, c in sums.items()])
    diff = F.col("wa") / F.col("na") - F.col("wb") / F.col("nb")
    reps = _replicates(clusters, [ALL], cluster, list(sums), n_iter, seed).where("na > 0 AND nb > 0").withColumn("diff", diff)
    totals = clusters.groupBy(ALL).agg(*[F.sum(k).alias(k) for k in sums]).where("na > 0 AND nb > 0")
    observed = totals.select(ALL, (F.col("wa") / F.col("na")).alias("hit_rate_a"), (F.col("wb") / F.col("nb")).alias("hit_rate_b"), diff.alias("diff_obs"))
    return _centred(reps, observed, [ALL], "diff", "diff_obs", threshold).drop(ALL)


def binomial_tail(df: DataFrame, keys: Sequence[str], k: str, n: str, out: str = "p_exact") -> DataFrame:
    """Exact P(X >= k) of a fair coin. ln C(n, i) is a running sum of logarithms; the terms are rows
    cut into blocks, so n may be large."""
    step = 4096
    rows = df.select(*keys, F.col(k).alias("_k"), F.col(n).alias("_n"))
    blocks = rows.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_n") / step))))
    terms = blocks.withColumn("_i", F.explode(F.sequence(F.col("_blk") * step, F.least(F.col("_blk") * step + (step - 1), F.col("_n")))))
    increment = F.when(F.col("_i") == 0, 0.0).otherwise(F.ln((F.col("_n") - F.col("_i") + 1) / F.when(F.col("_i") > 0, F.col("_i"))))
    scanned = block_scan(terms, keys, ["_blk"], ["_i"], sums={"_lc": increment})
    tail = scanned.where(F.col("_i") >= F.col("_k")).groupBy(*keys).agg(F.sum(F.exp(F.col("_lc") - F.col("_n") * F.ln(F.lit(2.0)))).alias(out))
    named = tail.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], out)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], F.lit(True))
    joined = df.join(named, same, "left").select(*df.columns, out)
    # Past n there is nothing to sum: the tail is 0. A missing k or n leaves it unknown.
    return joined.withColumn(out, F.when(F.col(k) > F.col(n), 0.0).otherwise(F.col(out)))


def holm_bonferroni(df: DataFrame, family: Sequence[str], p: str = "p", out: str = "p_adjusted") -> DataFrame:
    """Step-down family-wise p-values: running maximum of (m - i + 1) p(i), at most 1."""
    family = list(family)
    # Equal p-values get the same adjusted value, so only distinct ones are ranked: the rank of the
    # first of them is one more than the number of smaller ones.
    distinct = range_blocks(df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("_c")), [*family, p])
    sizes = df.groupBy(*family).agg(F.count(p).alias("_m"))
    counted = block_scan(distinct.join(sizes, family), family, ["_block"], [p], sums={"_upto": F.col("_c")})
    scaled = (F.col("_m") - (F.col("_upto") - F.col("_c"))) * F.col(p)
    stepped = block_scan(counted, family, ["_block"], [p], maxes={out: scaled}).select(*family, p, F.least(out, F.lit(1.0)).alias(out))
    return df.join(stepped, [*family, p], "left")


def placebo_shuffle(df: DataFrame, item: str, cols: Sequence[str], seed: str = "placebo") -> DataFrame:
    """Give each item another item's columns: two hash orders of the same items are matched by position."""
    rest = [c for c in df.columns if c not in cols]
    own, _ = _by(df.select(*rest), ())
    other, _ = _by(df.select(item, *cols), ())
    own = dense_index(own, [ALL], item)
    salted = F.concat_ws("|", F.lit(seed), F.col(item).cast("string"))
    order = [hash_prefix(salted), F.md5(salted), item]
    shuffled = block_scan(range_blocks(other, order), [ALL], ["_block"], order, sums={"_i": F.lit(1).cast("bigint")})
    donor = shuffled.select((F.col("_i") - 1).alias("idx"), F.col(item).alias("donor"), *cols)
    return own.join(donor, "idx").drop("idx", ALL)


def placebo_shift(cells: DataFrame, days: int = 90) -> DataFrame:
    """Cells that may see ``days`` more than was knowable: a check that the real ones do not."""
    return cells.withColumn("t", F.date_add("t", days))


def control_universe(df: DataFrame, key: str, control: Sequence) -> DataFrame:
    """Rows of a control group of firms for which the signal should say nothing."""
    return df.where(F.col(key).isin(*control))


def _det(m: list[list[Column]]) -> Column:
    """Determinant as a sum over permutations; for the small systems below."""
    if not m:
        return F.lit(1.0)
    total = None
    for perm in permutations(range(len(m))):
        odd = sum(perm[i] > perm[j] for i in range(len(perm)) for j in range(i + 1, len(perm))) % 2
        term = m[0][perm[0]]
        for i in range(1, len(perm)):
            term = term * m[i][perm[i]]
        total = (-term if odd else term) if total is None else (total - term if odd else total + term)
    return total


def residual_alpha(df: DataFrame, keys: Sequence[str], order: str, y: str, xs: Sequence[str], lags: int = 4) -> DataFrame:
    """Intercept of y on xs with a Newey-West t statistic. Covariances are one aggregate; the normal
    equations are solved on the aggregated row; lagged products of scores need one window over the
    periods of a key. A key whose factors depend on each other has NULL estimates."""
    keys, size = list(keys), range(len(xs))
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *xs]))
    # Spark's covariances are centred as they are summed, so a factor with a large mean and little spread stays exact.
    agg = rows.groupBy(*keys).agg(
        *[F.covar_pop(xs[i], xs[j]).alias(f"_x{i}{j}") for i in size for j in size if i <= j], *[F.covar_pop(c, y).alias(f"_y{i}") for i, c in enumerate(xs)],
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(xs)], F.avg(y).alias("_my"), F.count(F.lit(1)).alias("n"),
    )
    xx = [[F.col(f"_x{min(i, j)}{max(i, j)}") for j in size] for i in size]

    def cofactor(i: int, j: int) -> Column:
        return (1 if (i + j) % 2 == 0 else -1) * _det([[xx[r][c] for c in size if c != j] for r in size if r != i])

    # A determinant is small against the product of its diagonal when columns nearly depend on each other.
    usable = F.abs("_det") > 1e-10 * reduce(Column.__mul__, [xx[i][i] for i in size])
    det = agg.withColumns({"_det": _det(xx), **{f"_c{i}{j}": cofactor(i, j) for i in size for j in size}}).withColumn("_det", F.when(usable, F.col("_det")))

    def solved_for(side: str, i: int) -> Column:
        return reduce(Column.__add__, [F.col(f"_c{j}{i}") * F.col(f"{side}{j}") for j in size]) / F.col("_det")

    solved = det.select(*keys, "n", "_my", *[f"_m{i}" for i in size], *[solved_for("_y", i).alias(f"_b{i}") for i in size], *[solved_for("_m", i).alias(f"_w{i}") for i in size])
    dot = lambda a, b: reduce(Column.__add__, [a(i) * b(i) for i in size])
    solved = solved.withColumn("_b", F.col("_my") - dot(lambda i: F.col(f"_b{i}"), lambda i: F.col(f"_m{i}")))
    fitted = rows.join(solved.where("_b IS NOT NULL"), keys)
    resid = F.col(y) - F.col("_b") - dot(lambda i: F.col(f"_b{i}"), lambda i: F.col(xs[i]))
    load = (1.0 - dot(lambda i: F.col(xs[i]) - F.col(f"_m{i}"), lambda i: F.col(f"_w{i}"))) / F.col("n")
    scored = fitted.withColumn("_g", resid * load)
    w = Window.partitionBy(*keys).orderBy(order)
    weight = [(lag, 1.0 - lag / (lags + 1)) for lag in range(1, lags + 1)]
    cross = sum((F.coalesce(F.lag("_g", lag).over(w), F.lit(0.0)) * (2.0 * wt) for lag, wt in weight[1:]), F.coalesce(F.lag("_g", 1).over(w), F.lit(0.0)) * (2.0 * weight[0][1]))
    var = scored.withColumn("_v", F.col("_g") * (F.col("_g") + cross)).groupBy(*keys).agg(F.sum("_v").alias("_var"))
    out = solved.join(var, keys, "left")
    return out.select(*keys, "n", F.col("_b").alias("alpha"), *[F.col(f"_b{i}").alias(f"beta_{x}") for i, x in enumerate(xs)], F.when(F.col("_var") > 0, F.col("_b") / F.sqrt("_var")).alias("t_stat"))


def field_agreement(responses: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Whether repeated responses agree per field. Lists compare as sorted lists; missing is a value."""
    types = dict(responses.dtypes)

    def text(f: str) -> Column:
        return F.to_json(F.array_sort(f)) if types[f].startswith("array") else F.col(f).cast("string")

    def same(f: str) -> Column:
        t = text(f)
        return (F.count(t) == 0) | ((F.count(t) == F.count(F.lit(1))) & (F.min(t) == F.max(t)))

    out = responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), *[same(f).alias(f"{f}_match") for f in fields])
    return out.withColumn("passed", F.forall(F.array(*[F.col(f"{f}_match") for f in fields]), lambda x: x))
