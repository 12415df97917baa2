"""Matched-cohort study of joining a first pack: risk-set controls, features, matching, effects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

Z95 = 1.959963984540054
CONTROL_OFFSET = 1_000_000_000
FEATURES = ["pre_in_degree", "pre_out_degree", "pre_followers_30", "pre_following_30", "account_age_days"]
DAYS = (7, 30, 90)


@dataclass(frozen=True)
class Config:
    data_start: str = "1995-01-01"
    min_treatment_date: str = "1996-01-01"
    horizon_days: int = 90
    min_account_age_days: int = 30
    max_degree: int = 100_000
    treatment_rows: int | None = 400
    control_multiplier: int = 10
    control_permille: int = 1000
    caliper: float = 0.25
    max_reuse: int = 10
    seed: int = 15

    def check(self) -> Config:
        if self.treatment_rows is not None and self.treatment_rows < 100:
            raise ValueError("treatment_rows must be at least 100")
        if self.horizon_days < 90 or self.caliper <= 0 or self.max_reuse < 1:
            raise ValueError("horizon_days >= 90, caliper > 0 and max_reuse >= 1 are required")
        return self


def order_key(node: Column, seed: int) -> Column:
    """A pseudo-random order that any engine can compute."""
    return (node * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(4294967296)


def membership_exposure(memberships: DataFrame, packs: DataFrame) -> DataFrame:
    rows = memberships.join(packs, "pack_id").groupBy("pack_id", F.col("member_id").alias("node_id"))
    return rows.agg(
        F.greatest(F.min("date_added"), F.min("date_created")).alias("exposure_date"),
        F.max("member_count").alias("pack_size"),
        F.bool_or(F.col("creator_id") == F.col("member_id")).alias("self_curated"),
    )


def first_treatment(exposure: DataFrame) -> DataFrame:
    return exposure.groupBy("node_id").agg(F.min("exposure_date").alias("first_exposure"), F.count_distinct("pack_id").alias("packs"))


def horizon_bound(follows: DataFrame, c: Config) -> DataFrame:
    last = follows.where(F.col("date_followed") >= F.lit(c.data_start).cast("date")).agg(F.max("date_followed").alias("data_end"))
    return last.select("data_end", F.date_sub("data_end", c.horizon_days).alias("last_index"))


def _capped(nodes: DataFrame, degrees: DataFrame, c: Config) -> DataFrame:
    return nodes.join(degrees, "node_id").where((F.col("in_degree") <= c.max_degree) & (F.col("out_degree") <= c.max_degree)).select("node_id", F.col("date_created").alias("account_created"))


def eligible(first: DataFrame, nodes: DataFrame, degrees: DataFrame, bound: DataFrame, c: Config) -> DataFrame:
    rows = first.join(_capped(nodes, degrees, c), "node_id").crossJoin(F.broadcast(bound.select("last_index")))  # one row
    inside = F.col("first_exposure").between(F.lit(c.min_treatment_date).cast("date"), F.col("last_index"))
    old = F.col("account_created") <= F.date_sub("first_exposure", c.min_account_age_days)
    return rows.where(inside & old).select("node_id", "first_exposure", "packs", "account_created")


def _numbered(rows: DataFrame, limit: int | None, seed: int, name: str) -> DataFrame:
    """1-based numbers in order-key order. With a limit the rows are that few; without one,
    ranks inside key ranges plus the ranges' offsets, so no window spans all rows."""
    keyed = rows.withColumn("_key", order_key(F.col("node_id"), seed))
    if limit is not None:
        return keyed.orderBy("_key", "node_id").limit(limit).withColumn(name, F.row_number().over(Window.orderBy("_key", "node_id")).cast("long")).drop("_key")
    parts = durable(keyed.repartitionByRange("_key", "node_id").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_key", "node_id"))
    return parts.withColumn(name, rank.cast("long")).join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_key", "_part", "_before")


def treated_sample(rows: DataFrame, c: Config) -> DataFrame:
    return _numbered(rows, c.treatment_rows, c.seed, "treatment_id")


def control_pool(nodes: DataFrame, degrees: DataFrame, treated: DataFrame, c: Config) -> DataFrame:
    rows = _capped(nodes, degrees, c).join(treated.select("node_id"), "node_id", "left_anti")
    rows = rows.where(order_key(F.col("node_id"), c.seed + 1) % 1000 < c.control_permille)
    return _numbered(rows, None if c.treatment_rows is None else c.treatment_rows * c.control_multiplier, c.seed + 2, "control_id")


def risk_set_controls(pool: DataFrame, treated: DataFrame, first: DataFrame, n_treated: int, c: Config) -> DataFrame:
    """Each control borrows a treated index date and stays if it was old enough and unexposed through the horizon."""
    index = treated.select("treatment_id", F.col("first_exposure").alias("index_date"))
    rows = pool.withColumn("treatment_id", 1 + (F.col("control_id") - 1) % F.lit(max(1, n_treated))).join(index, "treatment_id")
    rows = rows.join(first.select("node_id", "first_exposure"), "node_id", "left")
    old = F.col("account_created") <= F.date_sub("index_date", c.min_account_age_days)
    free = F.col("first_exposure").isNull() | (F.col("first_exposure") > F.date_add("index_date", c.horizon_days))
    return rows.where(old & free).select("control_id", "treatment_id", "node_id", "index_date", "account_created")


def observations(treated: DataFrame, controls: DataFrame) -> DataFrame:
    a = treated.select(F.col("treatment_id").alias("obs_id"), F.lit(1).alias("treated"), "node_id", F.col("first_exposure").alias("index_date"), "account_created", "treatment_id")
    b = controls.select((F.col("control_id") + CONTROL_OFFSET).alias("obs_id"), F.lit(0).alias("treated"), "node_id", "index_date", "account_created", "treatment_id")
    return a.unionByName(b)


def _windows(obs: DataFrame, follows: DataFrame, end: str, counts: dict[str, tuple[int | None, bool]], c: Config) -> DataFrame:
    """Counts of edges at ``end`` before or after the index date; the day itself never counts."""
    edges = follows.select(F.col(end).alias("node_id"), "date_followed").where(F.col("date_followed") >= F.lit(c.data_start).cast("date"))
    rows = obs.select("obs_id", "node_id", "index_date").join(edges, "node_id", "left")
    d = F.datediff("date_followed", "index_date")
    aggs = [F.count_if(F.coalesce((d > 0) & (d <= n) if after else (d < 0) & (d >= -n) if n else d < 0, F.lit(False))).alias(name) for name, (n, after) in counts.items()]
    return rows.groupBy("obs_id").agg(*aggs)


def incoming_features(obs: DataFrame, follows: DataFrame, c: Config) -> DataFrame:
    counts = {"pre_in_degree": (None, False)} | {f"pre_followers_{n}": (n, False) for n in DAYS} | {f"post_followers_{n}": (n, True) for n in DAYS}
    return _windows(obs, follows, "dst", counts, c)


def outgoing_features(obs: DataFrame, follows: DataFrame, c: Config) -> DataFrame:
    counts = {"pre_out_degree": (None, False), "pre_following_30": (30, False)} | {f"post_following_{n}": (n, True) for n in DAYS}
    return _windows(obs, follows, "src", counts, c)


def treatment_attributes(treated: DataFrame, exposure: DataFrame) -> DataFrame:
    rows = treated.select("treatment_id", "node_id", "first_exposure").join(exposure, "node_id")
    day = F.datediff("exposure_date", "first_exposure")
    on_day = lambda x: F.when(day == 0, x)
    return rows.groupBy("treatment_id").agg(
        F.count_if(day == 0).alias("packs_first_day"),
        F.count_if((day >= 0) & (day <= 30)).alias("packs_30_days"),
        F.avg(on_day(F.col("pack_size"))).alias("mean_pack_size"),
        F.max(on_day(F.col("pack_size"))).alias("max_pack_size"),
        F.bool_or(F.coalesce(on_day(F.col("self_curated")), F.lit(False))).alias("self_curated"),
    )


def features(obs: DataFrame, incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    rows = obs.join(incoming, "obs_id").join(outgoing, "obs_id")
    return rows.withColumn("account_age_days", F.datediff("index_date", "account_created").cast("long"))


def stratum(index_date: Column, age: Column) -> Column:
    bin_ = F.when(age <= 90, 0).when(age <= 365, 1).when(age <= 730, 2).otherwise(3)
    return (F.floor(F.unix_date(index_date) / 7) * 10 + bin_).cast("long")


def propensity_scores(table: DataFrame, columns: list[str] = FEATURES, ridge: float = 1e-4, steps: int = 25) -> DataFrame:
    return propensity_fit(table, columns, ridge, steps)[0]


def propensity_fit(table: DataFrame, columns: list[str] = FEATURES, ridge: float = 1e-4, steps: int = 25) -> tuple[DataFrame, bool]:
    """(obs_id, treated, score) and whether the steps converged: ridge logistic regression on standardised log1p features.

    Newton steps; each is one aggregate of (features + 1)^2 sums, so the data stay
    where they are. Standard deviations are of the population, constants become 0,
    the intercept is not penalised, scores are clipped to [1e-8, 1 - 1e-8].
    """
    logs = table.select("obs_id", "treated", *[F.log1p(F.col(c).cast("double")).alias(c) for c in columns])
    stats = logs.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns], F.count("*").alias("n")).first()
    scale = lambda c: F.lit(0.0) if not stats[f"s_{c}"] else (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]
    x = durable(logs.select("obs_id", "treated", F.lit(1.0).alias("x0"), *[scale(c).alias(f"x{k + 1}") for k, c in enumerate(columns)]))
    size = len(columns) + 1
    beta, penalty = np.zeros(size), np.diag([0.0] + [ridge] * (size - 1))
    converged = False
    for _ in range(steps):
        eta = reduce(lambda a, b: a + b, [F.col(f"x{k}") * float(beta[k]) for k in range(size)])
        p = 1 / (1 + F.exp(-eta))
        rows = x.withColumn("p", p)
        sums = [F.sum((F.col("treated") - F.col("p")) * F.col(f"x{k}")) for k in range(size)]
        sums += [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(size) for j in range(i, size)]
        got = [v or 0.0 for v in rows.agg(*sums).first()]
        g = np.array(got[:size]) - penalty @ beta
        h = np.zeros((size, size))
        h[np.triu_indices(size)] = got[size:]
        h = h + np.triu(h, 1).T + penalty + 1e-9 * np.eye(size)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            converged = True
            break
    eta = reduce(lambda a, b: a + b, [F.col(f"x{k}") * float(beta[k]) for k in range(size)])
    score = F.least(F.greatest(1 / (1 + F.exp(-eta)), F.lit(1e-8)), F.lit(1 - 1e-8))
    return x.select("obs_id", "treated", score.alias("score")), converged


def greedy_match(logits, treated, ids, node, caliper: float, reuse: int) -> list[tuple[int, int, float]]:
    """Nearest control by logit for every treated id in order; the lower one on ties; a control serves ``reuse`` times."""
    is_control = treated == 0
    controls = np.lexsort((ids[is_control], logits[is_control]))
    at, cid, cnode = logits[is_control][controls], ids[is_control][controls], node[is_control][controls]
    order = np.argsort(ids[~is_control], kind="stable")
    wanted = zip(logits[~is_control][order].tolist(), ids[~is_control][order].tolist(), node[~is_control][order].tolist(), strict=True)
    n = len(at)
    used = np.zeros(n, dtype=np.int64)
    # Where to go on from a control that is used up; places are shifted by one, so that both ends have one.
    below, above = list(range(n + 2)), list(range(n + 2))

    def free(steps, i):
        while steps[i] != i:
            steps[i] = steps[steps[i]]
            i = steps[i]
        return i

    out = []
    for z, t, own in wanted:
        right = int(np.searchsorted(at, z))
        left, right = free(below, right) - 1, free(above, right + 1) - 1
        while left >= 0 and z - at[left] <= caliper and cnode[left] == own:
            left = free(below, left) - 1
        while right < n and at[right] - z <= caliper and cnode[right] == own:
            right = free(above, right + 2) - 1
        best = left if left >= 0 and z - at[left] <= caliper else None
        if right < n and at[right] - z <= caliper and (best is None or at[right] - z < z - at[left]):
            best = right
        if best is not None:
            used[best] += 1
            if used[best] >= reuse:
                below[best + 1], above[best + 1] = best, best + 2
            out.append((t, int(cid[best]), float(abs(at[best] - z))))
    return out


def match(table: DataFrame, scores: DataFrame, c: Config) -> DataFrame:
    """(match_id, treated_obs, control_obs, distance). A control belongs to one stratum (a week
    of index dates and an age band), so strata are matched apart; the caliper is global."""
    logit = F.ln(F.col("score") / (1 - F.col("score")))
    rows = table.select("obs_id", "node_id", stratum(F.col("index_date"), F.col("account_age_days")).alias("stratum")).join(scores, "obs_id").withColumn("logit", logit)
    width = rows.agg(F.stddev_pop("logit")).first()[0] or 0.0
    caliper, reuse = c.caliper * width, c.max_reuse

    def run(pdf):
        import pandas as pd

        found = greedy_match(pdf["logit"].to_numpy(), pdf["treated"].to_numpy(), pdf["obs_id"].to_numpy(), pdf["node_id"].to_numpy(), caliper, reuse)
        return pd.DataFrame(found, columns=["treated_obs", "control_obs", "distance"])

    pairs = rows.groupBy("stratum").applyInPandas(run, "treated_obs long, control_obs long, distance double")
    return numbered_matches(pairs)


def numbered_matches(pairs: DataFrame) -> DataFrame:
    """Treated observations are numbered already; their number is the match's."""
    return pairs.withColumn("match_id", F.col("treated_obs"))


def least_matches(treated: int) -> int:
    """Fewer matches than this are too few for a study of ``treated`` rows: a fifth, from 100 to 1,000."""
    return max(100, min(1000, treated // 5))


def enough_matches(matches: DataFrame, treated: int) -> DataFrame:
    """``matches``, which is written already; an error if they are too few."""
    found = matches.count()
    if found < least_matches(treated):
        raise ValueError(f"{found} matches of {treated} treated rows; a study needs {least_matches(treated)}")
    return matches


def index_pairs(obs: DataFrame) -> DataFrame:
    """The first control that borrowed each treated observation's date."""
    controls = obs.where("treated = 0").groupBy("treatment_id").agg(F.min("obs_id").alias("control_obs"))
    return controls.select(F.col("treatment_id").alias("match_id"), F.col("treatment_id").alias("treated_obs"), "control_obs")


def matched_cohort(matches: DataFrame, table: DataFrame) -> DataFrame:
    """One row per match with t_ and c_ columns of every feature."""
    cols = [x for x in table.columns if x not in ("obs_id", "treated", "treatment_id")]
    side = lambda p, k: table.select(F.col("obs_id").alias(k), *[F.col(x).alias(f"{p}_{x}") for x in cols])
    return matches.select("match_id", "treated_obs", "control_obs").join(side("t", "treated_obs"), "treated_obs").join(side("c", "control_obs"), "control_obs")


def _smd(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    t, k = F.col("treated") == 1, F.col("treated") == 0
    values = F.inline(F.array(*[F.struct(F.lit(x).alias("variable"), F.log1p(F.col(x).cast("double")).alias("v")) for x in columns]))
    rows = df.select("treated", values)
    pooled = F.sqrt((F.var_pop(F.when(t, F.col("v"))) + F.var_pop(F.when(k, F.col("v")))) / 2)
    diff = F.avg(F.when(t, F.col("v"))) - F.avg(F.when(k, F.col("v")))
    return rows.groupBy("variable").agg(F.when(pooled == 0, 0.0).otherwise(diff / pooled).alias(name))


def balance(table: DataFrame, matches: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """(variable, smd_before, smd_after) of log1p features; a control counts once per match."""
    ends = F.inline(F.array(F.struct(F.col("treated_obs").alias("obs_id")), F.struct(F.col("control_obs").alias("obs_id"))))
    after = matches.select(ends).join(table, "obs_id")
    return _smd(table, columns, "smd_before").join(_smd(after, columns, "smd_after"), "variable")


def paired_effect(rows: DataFrame, keys: list[str], clustered: bool = True) -> DataFrame:
    """Effect columns per ``keys`` from rows (t, c, control): mean difference with a 95 % interval.

    The clustered standard error adds residuals per control first; sums per control
    of d, d^2 and counts are enough for it, so one pass with two levels does.
    """
    d = F.col("t") - F.col("c")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.avg("t").alias("treated_mean"),
        F.avg("c").alias("control_mean"),
        F.avg(d).alias("mean_difference"),
        F.percentile("t", 0.5).alias("treated_median"),
        F.percentile("c", 0.5).alias("control_median"),
        F.stddev_samp(d).alias("sd"),
    )
    if clustered:
        own = rows.groupBy(*keys, "control").agg(F.sum(d).alias("_s"), F.count("*").alias("_k"))
        square = lambda x, y: F.sum(F.col(x) * F.col(y))
        own = own.groupBy(*keys).agg(F.count("*").alias("_g"), square("_s", "_s").alias("_ss"), square("_s", "_k").alias("_sk"), square("_k", "_k").alias("_kk"))
        base = base.join(own, keys) if keys else base.crossJoin(own)  # one row each without keys
        m = F.col("mean_difference")
        total = F.greatest(F.col("_ss") - 2 * m * F.col("_sk") + m * m * F.col("_kk"), F.lit(0.0))
        factor = F.when(F.col("_g") > 1, F.col("_g") / (F.col("_g") - 1)).otherwise(1.0)
        se, method = F.sqrt(factor * total) / F.col("pairs"), "control-cluster-robust"
    else:
        se, method = F.col("sd") / F.sqrt("pairs"), "paired"
    out = base.withColumn("standard_error", se)
    return out.select(
        *keys,
        "pairs",
        "treated_mean",
        "control_mean",
        "mean_difference",
        (F.col("mean_difference") - Z95 * F.col("standard_error")).alias("ci_low"),
        (F.col("mean_difference") + Z95 * F.col("standard_error")).alias("ci_high"),
        "standard_error",
        (F.col("treated_mean") / F.nullif(F.col("control_mean"), F.lit(0.0))).alias("mean_ratio"),
        "treated_median",
        "control_median",
        F.lit(method).alias("standard_error_method"),
    )


def _long(cohort: DataFrame, outcomes: list[tuple[str, int, str, Column, Column]], *more: str) -> DataFrame:
    items = [F.struct(F.lit(o).alias("outcome"), F.lit(n).alias("horizon_days"), F.lit(e).alias("estimand"), t.cast("double").alias("t"), k.cast("double").alias("c")) for o, n, e, t, k in outcomes]
    return cohort.select(F.col("c_node_id").alias("control"), *more, F.inline(F.array(*items)))


def effects(cohort: DataFrame) -> DataFrame:
    """Means, winsorised means (pooled 99th percentile), shares above 0 and difference in differences."""
    caps = {}
    for n in DAYS:
        both = cohort.select(F.explode(F.array(f"t_post_followers_{n}", f"c_post_followers_{n}")).alias("v"))
        caps[n] = both.agg(F.percentile("v", 0.99)).first()[0] or 0.0
    rows = []
    for n in DAYS:
        for outcome, col in (("new_followers", f"post_followers_{n}"), ("new_following", f"post_following_{n}")):
            rows.append((outcome, n, "mean", F.col(f"t_{col}"), F.col(f"c_{col}")))
        t, k = F.col(f"t_post_followers_{n}"), F.col(f"c_post_followers_{n}")
        rows.append(("new_followers", n, "winsorized_p99", F.least(t.cast("double"), F.lit(caps[n])), F.least(k.cast("double"), F.lit(caps[n]))))
        rows.append(("new_followers", n, "any", (t > 0).cast("int"), (k > 0).cast("int")))
    rows.append(("new_followers", 90, "difference_in_differences", F.col("t_post_followers_90") - F.col("t_pre_followers_90"), F.col("c_post_followers_90") - F.col("c_pre_followers_90")))
    return paired_effect(_long(cohort, rows), ["outcome", "horizon_days", "estimand"])


def age_band(c: Column) -> Column:
    return F.when(c < 91, "30-90 days").when(c < 366, "91-365 days").when(c < 731, "366-730 days").otherwise("over 730 days")


def degree_band(c: Column) -> Column:
    return F.when(c < 10, "0-9").when(c < 100, "10-99").when(c < 1000, "100-999").otherwise("1000+")


def size_band(c: Column) -> Column:
    return F.when(c <= 50, "small (<=50)").when(c <= 150, "medium (51-150)").otherwise("large (>150)")


def packs_band(c: Column) -> Column:
    return F.when(c <= 2, "1-2").when(c <= 4, "3-4").otherwise("5+")


def subgroup_effects(cohort: DataFrame, attributes: DataFrame, least: int = 200) -> DataFrame:
    """Follower effects at 30 and 90 days per band with at least ``least`` pairs."""
    rows = cohort.join(attributes.withColumnRenamed("treatment_id", "treated_obs"), "treated_obs")
    dims = {"account_age": age_band(F.col("t_account_age_days")), "in_degree": degree_band(F.col("t_pre_in_degree")), "pack_size": size_band(F.col("mean_pack_size")), "packs_30_days": packs_band(F.col("packs_30_days"))}
    rows = rows.withColumn("band", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), b.alias("subgroup")) for d, b in dims.items()]))).withColumns({"dimension": F.col("band.dimension"), "subgroup": F.col("band.subgroup")})
    long = _long(rows, [("new_followers", n, "mean", F.col(f"t_post_followers_{n}"), F.col(f"c_post_followers_{n}")) for n in (30, 90)], "dimension", "subgroup")
    return paired_effect(long, ["dimension", "subgroup", "horizon_days"]).where(F.col("pairs") >= least)


def event_dynamics(cohort: DataFrame, follows: DataFrame, days: int = 90) -> DataFrame:
    """(relative_day, treated_mean, control_mean, mean_difference): new followers per match on each day but 0."""
    n = cohort.count()
    ends = F.inline(F.array(*[F.struct(F.lit(p).alias("role"), F.col(f"{p}_node_id").alias("dst"), F.col(f"{p}_index_date").alias("index_date")) for p in ("t", "c")]))
    rows = cohort.select(ends).join(follows.select("dst", "date_followed"), "dst").withColumn("relative_day", F.datediff("date_followed", "index_date"))
    rows = rows.where((F.abs("relative_day") <= days) & (F.col("relative_day") != 0))
    counts = rows.groupBy("relative_day").agg(F.count_if(F.col("role") == "t").alias("t"), F.count_if(F.col("role") == "c").alias("c"))
    grid = cohort.sparkSession.range(-days, days + 1).where("id <> 0").select(F.col("id").cast("int").alias("relative_day"))
    mean = lambda k: F.coalesce(F.col(k), F.lit(0)) / F.lit(max(1, n))
    return grid.join(counts, "relative_day", "left").select(F.col("relative_day").cast("long").alias("relative_day"), mean("t").alias("treated_mean"), mean("c").alias("control_mean"), (mean("t") - mean("c")).alias("mean_difference"))


def network_quality(cohort: DataFrame, follows: DataFrame, labels: DataFrame, days: int = 90) -> DataFrame:
    """Per role: distinct new followers, those followed back, and those of the same community."""
    ends = F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{p}_node_id").alias("node_id"), F.col(f"{p}_index_date").alias("index_date")) for r, p in (("treated", "t"), ("control", "c"))]))
    people = cohort.select("match_id", ends)
    edges = follows.select(F.col("dst").alias("node_id"), F.col("src").alias("follower"), "date_followed")
    new = people.join(edges, "node_id").where((F.datediff("date_followed", "index_date") > 0) & (F.datediff("date_followed", "index_date") <= days))
    new = new.groupBy("match_id", "role", "node_id", "index_date", "follower").agg(F.count("*").alias("rows"))
    # Only the cohort's own follows can answer a new follower.
    own = follows.join(people.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")
    back = own.groupBy(F.col("src").alias("node_id"), F.col("dst").alias("follower")).agg(F.min("date_followed").alias("back"))
    mine, theirs = labels.select("node_id", F.col("community").alias("mine")), labels.select(F.col("node_id").alias("follower"), F.col("community").alias("theirs"))
    rows = new.join(back, ["node_id", "follower"], "left").join(mine, "node_id", "left").join(theirs, "follower", "left")
    mutual = F.coalesce(F.col("back") <= F.date_add("index_date", days), F.lit(False))
    known = F.col("mine").isNotNull() & F.col("theirs").isNotNull()
    return rows.groupBy("role").agg(
        F.count("*").alias("new_followers_90"),
        F.count_if(mutual).alias("reciprocal_new_followers_90"),
        F.avg(mutual.cast("double")).alias("reciprocal_share"),
        F.count_if(known).alias("community_known_pairs"),
        F.avg(F.when(known, (F.col("mine") == F.col("theirs")).cast("double"))).alias("same_final_community_share"),
    )


def dynamics_report(dynamics: DataFrame) -> DataFrame:
    """The day of the greatest lift after the index date, that lift, and the mean before it."""
    after, before = F.col("relative_day") > 0, F.col("relative_day") < 0
    best = F.max(F.when(after, F.struct(F.round("mean_difference", 12).alias("d"), (-F.col("relative_day")).alias("neg"))))
    return dynamics.agg((-best["neg"]).alias("peak_day"), best["d"].alias("peak_difference"), F.avg(F.when(before, F.col("mean_difference"))).alias("mean_before"))


def integrity_checks(
    cohort: DataFrame, matches: DataFrame, c: Config, first: DataFrame, after: DataFrame, dynamics: DataFrame, found: DataFrame, converged: bool
) -> DataFrame:
    """(check, ok) over the matched cohort; first: ``first_treatment``, after: its ``balance``,
    dynamics: its ``event_dynamics``, found: its ``effects``, converged: of ``propensity_fit``."""
    reuse = matches.groupBy("control_obs").agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) <= c.max_reuse).alias("reuse_cap"))
    none = lambda bad: F.count_if(bad) == 0
    falls = lambda p: (F.col(f"{p}_post_followers_7") > F.col(f"{p}_post_followers_30")) | (F.col(f"{p}_post_followers_30") > F.col(f"{p}_post_followers_90"))
    week = lambda p: F.floor(F.unix_date(f"{p}_index_date") / 7)
    row = cohort.agg(
        (F.count("*") == F.count_distinct("match_id")).alias("unique_match_ids"),
        (F.count("*") == F.count_distinct("treated_obs")).alias("unique_treated"),
        none(F.col("t_node_id") == F.col("c_node_id")).alias("no_self_match"),
        none((week("t") != week("c")) | (F.abs(F.datediff("t_index_date", "c_index_date")) > 6)).alias("same_seven_days"),
        none(falls("t")).alias("monotone_treated_outcomes"),
        none(falls("c")).alias("monotone_control_outcomes"),
        none(F.col("t_account_age_days") < c.min_account_age_days).alias("treated_age"),
        none(F.col("c_account_age_days") < c.min_account_age_days).alias("control_age"),
        F.count("*").alias("n"),
    )
    later = cohort.select(F.col("c_node_id").alias("node_id"), "c_index_date").join(first.select("node_id", "first_exposure"), "node_id")
    parts = [
        reuse,
        later.agg(none(F.col("first_exposure") <= F.date_add("c_index_date", c.horizon_days)).alias("controls_unexposed")),
        after.agg((F.coalesce(F.max(F.abs("smd_after")), F.lit(0.0)) < 0.1).alias("balance_below_a_tenth")),
        dynamics.agg(none(F.col("relative_day") == 0).alias("no_day_zero")),
        found.agg(F.min("pairs").alias("least"), F.max("pairs").alias("most")),
    ]
    for part in parts:
        row = row.crossJoin(part)  # one row each
    row = row.withColumn("effects_of_all_matches", F.coalesce((F.col("least") == F.col("n")) & (F.col("most") == F.col("n")), F.lit(True))).drop("n", "least", "most")
    row = row.withColumn("propensity_converged", F.lit(converged))
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("ok")) for k in row.columns])))


def extreme_pairs(cohort: DataFrame, limit: int = 100) -> DataFrame:
    d = F.col("t_post_followers_90") - F.col("c_post_followers_90")
    return cohort.select("match_id", "t_node_id", "c_node_id", d.alias("difference")).orderBy(F.desc("difference"), "match_id").limit(limit)
