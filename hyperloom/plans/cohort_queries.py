"""Registered queries of the cohort study, with DuckDB SQL.

Sparse memberships leave unexposed nodes. Effects with SQL use index pairs (the
first control that borrowed a treated date); propensity matching is registered
beside them without SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import cohort as c
from ..operators import network
from ..sources.crosswalk import Tables

CONFIG = c.Config().check()
#: The full-population variant: all eligible nodes are treated rows, all others may be controls.
FULL = c.Config(treatment_rows=None).check()
N, MOST = CONFIG.treatment_rows, CONFIG.treatment_rows * CONFIG.control_multiplier


class Study:
    """The study's lazy steps over the domain tables."""

    def __init__(self, t: Tables, config: c.Config = CONFIG):
        self.t, self.config = t, config

    @cached_property
    def exposure(self):
        return c.membership_exposure(self.t.memberships_sparse, self.t.packs)

    @cached_property
    def first(self):
        return c.first_treatment(self.exposure)

    @cached_property
    def degrees(self):
        return network.follow_degrees(self.t.follows)

    @cached_property
    def bound(self):
        return c.horizon_bound(self.t.follows, self.config)

    @cached_property
    def eligible(self):
        return c.eligible(self.first, self.t.nodes, self.degrees, self.bound, self.config)

    @cached_property
    def treated(self):
        return c.durable(c.treated_sample(self.eligible, self.config))

    @cached_property
    def pool(self):
        return c.control_pool(self.t.nodes, self.degrees, self.treated, self.config)

    @cached_property
    def controls(self):
        return c.risk_set_controls(self.pool, self.treated, self.first, self.treated.count(), self.config)

    @cached_property
    def obs(self):
        return c.durable(c.observations(self.treated, self.controls))

    @cached_property
    def incoming(self):
        return c.incoming_features(self.obs, self.t.follows, self.config)

    @cached_property
    def outgoing(self):
        return c.outgoing_features(self.obs, self.t.follows, self.config)

    @cached_property
    def attributes(self):
        return c.treatment_attributes(self.treated, self.exposure)

    @cached_property
    def table(self):
        return c.durable(c.features(self.obs, self.incoming, self.outgoing))

    @cached_property
    def fit(self):
        return c.propensity_fit(self.table)

    @cached_property
    def scores(self):
        return self.fit[0]

    @cached_property
    def matches(self):
        return c.enough_matches(c.durable(c.match(self.table, self.scores, self.config)), self.treated.count())

    @cached_property
    def pairs(self):
        return c.index_pairs(self.obs)

    @cached_property
    def cohort(self):
        return c.durable(c.matched_cohort(self.pairs, self.table))


KEY = lambda node, seed: f"(({node} * 2654435761 + {seed * 40503}) % 4294967296)"
EXPOSURE = """, ex AS (SELECT pack_id, member_id AS node_id, greatest(min(date_added), min(date_created)) AS exposure_date, max(member_count) AS pack_size,
  bool_or(creator_id = member_id) AS self_curated FROM memberships_sparse JOIN packs USING (pack_id) GROUP BY 1, 2)"""
FIRST = EXPOSURE + ", ft AS (SELECT node_id, min(exposure_date) AS first_exposure, count(DISTINCT pack_id) AS packs FROM ex GROUP BY 1)"
BOUND = f", hb AS (SELECT max(date_followed) AS data_end, (max(date_followed) - INTERVAL {CONFIG.horizon_days} DAY)::DATE AS last_index FROM follows WHERE date_followed >= DATE '{CONFIG.data_start}')"
DEG = """, dg AS (SELECT node_id, count(*) FILTER (k = 1) AS in_degree, count(*) FILTER (k = 0) AS out_degree FROM (SELECT dst AS node_id, 1 AS k FROM follows UNION ALL SELECT src, 0 FROM follows) GROUP BY 1)"""
ELIGIBLE = (
    FIRST + BOUND + DEG + f""", el AS (SELECT ft.node_id, first_exposure, packs, date_created AS account_created FROM ft JOIN nodes USING (node_id) JOIN dg USING (node_id), hb
  WHERE first_exposure BETWEEN DATE '{CONFIG.min_treatment_date}' AND last_index AND date_created <= first_exposure - {CONFIG.min_account_age_days}
  AND in_degree <= {CONFIG.max_degree} AND out_degree <= {CONFIG.max_degree})"""
)
TREATED = ELIGIBLE + f""", tr AS (SELECT *, row_number() OVER (ORDER BY {KEY("node_id", CONFIG.seed)}, node_id) AS treatment_id FROM el ORDER BY treatment_id LIMIT {N})"""
POOL = TREATED + f""", cp AS (SELECT node_id, date_created AS account_created, row_number() OVER (ORDER BY {KEY("node_id", CONFIG.seed + 2)}, node_id) AS control_id
  FROM nodes JOIN dg USING (node_id) WHERE node_id NOT IN (SELECT node_id FROM tr) AND in_degree <= {CONFIG.max_degree} AND out_degree <= {CONFIG.max_degree}
  AND {KEY("node_id", CONFIG.seed + 1)} % 1000 < {CONFIG.control_permille} ORDER BY control_id LIMIT {MOST})"""
CONTROLS = POOL + f""", rc AS (SELECT control_id, tr.treatment_id, cp.node_id, tr.first_exposure AS index_date, cp.account_created FROM cp
  JOIN tr ON tr.treatment_id = 1 + (control_id - 1) % (SELECT count(*) FROM tr) LEFT JOIN ft ON ft.node_id = cp.node_id
  WHERE cp.account_created <= tr.first_exposure - {CONFIG.min_account_age_days} AND (ft.first_exposure IS NULL OR ft.first_exposure > tr.first_exposure + {CONFIG.horizon_days}))"""
OBS = CONTROLS + f""", ob AS (SELECT treatment_id AS obs_id, 1 AS treated, node_id, first_exposure AS index_date, account_created, treatment_id FROM tr
  UNION ALL SELECT control_id + {c.CONTROL_OFFSET}, 0, node_id, index_date, account_created, treatment_id FROM rc)"""
W = "count(*) FILTER (date_followed {0} AND date_followed {1})"
INCOMING = OBS + ", fi AS (SELECT obs_id, count(*) FILTER (date_followed < index_date) AS pre_in_degree, " + ", ".join(
    [W.format("< index_date", f">= index_date - {n}") + f" AS pre_followers_{n}" for n in c.DAYS] + [W.format("> index_date", f"<= index_date + {n}") + f" AS post_followers_{n}" for n in c.DAYS]
) + f" FROM ob LEFT JOIN follows ON dst = node_id AND date_followed >= DATE '{CONFIG.data_start}' GROUP BY 1)"
OUT = ", fo AS (SELECT obs_id, count(*) FILTER (date_followed < index_date) AS pre_out_degree, " + ", ".join(
    [W.format("< index_date", ">= index_date - 30") + " AS pre_following_30"] + [W.format("> index_date", f"<= index_date + {n}") + f" AS post_following_{n}" for n in c.DAYS]
) + f" FROM ob LEFT JOIN follows ON src = node_id AND date_followed >= DATE '{CONFIG.data_start}' GROUP BY 1)"
TABLE = INCOMING + OUT + ", tb AS (SELECT ob.*, fi.* EXCLUDE (obs_id), fo.* EXCLUDE (obs_id), date_diff('day', account_created, index_date) AS account_age_days FROM ob JOIN fi USING (obs_id) JOIN fo USING (obs_id))"
ATTR = """, ta AS (SELECT treatment_id, count(*) FILTER (exposure_date = first_exposure) AS packs_first_day, count(*) FILTER (exposure_date BETWEEN first_exposure AND first_exposure + 30) AS packs_30_days,
  avg(pack_size) FILTER (exposure_date = first_exposure) AS mean_pack_size, max(pack_size) FILTER (exposure_date = first_exposure) AS max_pack_size,
  coalesce(bool_or(self_curated) FILTER (exposure_date = first_exposure), false) AS self_curated FROM tr JOIN ex USING (node_id) GROUP BY 1)"""
PAIRS = TABLE + ", mp AS (SELECT treatment_id AS match_id, treatment_id AS treated_obs, min(obs_id) AS control_obs FROM ob WHERE treated = 0 GROUP BY 1)"
COHORT = PAIRS + ", mc AS (SELECT match_id, t, k FROM mp JOIN tb t ON t.obs_id = treated_obs JOIN tb k ON k.obs_id = control_obs)"
EFFECT = """g AS (SELECT {keys}, control, sum(t - c) AS s, count(*) AS k FROM lg GROUP BY ALL),
h AS (SELECT {keys}, count(*) AS g, sum(s * s) AS ss, sum(s * k) AS sk, sum(k * k) AS kk FROM g GROUP BY ALL),
b AS (SELECT {keys}, count(*) AS pairs, avg(t) AS treated_mean, avg(c) AS control_mean, avg(t - c) AS m, quantile_cont(t, 0.5) AS treated_median, quantile_cont(c, 0.5) AS control_median FROM lg GROUP BY ALL),
z AS (SELECT b.*, sqrt(CASE WHEN g > 1 THEN g / (g - 1) ELSE 1 END * greatest(ss - 2 * m * sk + m * m * kk, 0)) / pairs AS se FROM b JOIN h USING ({keys}))
SELECT {keys}, pairs, round(treated_mean, 6) AS treated_mean, round(control_mean, 6) AS control_mean, round(m, 6) AS mean_difference, round(m - 1.959963984540054 * se, 6) AS ci_low,
  round(m + 1.959963984540054 * se, 6) AS ci_high, round(se, 6) AS standard_error, round(treated_mean / nullif(control_mean, 0), 6) AS mean_ratio, treated_median, control_median,
  'control-cluster-robust' AS standard_error_method FROM z {where}"""
ITEMS = []
for _n in c.DAYS:
    for _o, _c in (("new_followers", f"post_followers_{_n}"), ("new_following", f"post_following_{_n}")):
        ITEMS.append((_o, _n, "mean", f"t.{_c}", f"k.{_c}"))
    _p = f"post_followers_{_n}"
    _cap = f"(SELECT quantile_cont(v, 0.99) FROM (SELECT t.{_p} AS v FROM mc UNION ALL SELECT k.{_p} FROM mc))"
    ITEMS.append(("new_followers", _n, "winsorized_p99", f"least(t.{_p}, {_cap})", f"least(k.{_p}, {_cap})"))
    ITEMS.append(("new_followers", _n, "any", f"(t.{_p} > 0)::INT", f"(k.{_p} > 0)::INT"))
ITEMS.append(("new_followers", 90, "difference_in_differences", "t.post_followers_90 - t.pre_followers_90", "k.post_followers_90 - k.pre_followers_90"))
LONG = ", lg AS (" + " UNION ALL ".join(f"SELECT k.node_id AS control, '{o}' AS outcome, {n} AS horizon_days, '{e}' AS estimand, ({t})::DOUBLE AS t, ({k})::DOUBLE AS c FROM mc" for o, n, e, t, k in ITEMS) + "), "
BANDS = {
    "account_age": "CASE WHEN t.account_age_days < 91 THEN '30-90 days' WHEN t.account_age_days < 366 THEN '91-365 days' WHEN t.account_age_days < 731 THEN '366-730 days' ELSE 'over 730 days' END",
    "in_degree": "CASE WHEN t.pre_in_degree < 10 THEN '0-9' WHEN t.pre_in_degree < 100 THEN '10-99' WHEN t.pre_in_degree < 1000 THEN '100-999' ELSE '1000+' END",
    "pack_size": "CASE WHEN mean_pack_size <= 50 THEN 'small (<=50)' WHEN mean_pack_size <= 150 THEN 'medium (51-150)' ELSE 'large (>150)' END",
    "packs_30_days": "CASE WHEN packs_30_days <= 2 THEN '1-2' WHEN packs_30_days <= 4 THEN '3-4' ELSE '5+' END",
}
SUB = ", lg AS (" + " UNION ALL ".join(
    f"SELECT k.node_id AS control, '{d}' AS dimension, {b} AS subgroup, {n} AS horizon_days, t.post_followers_{n}::DOUBLE AS t, k.post_followers_{n}::DOUBLE AS c FROM mc JOIN ta ON ta.treatment_id = match_id" for d, b in BANDS.items() for n in (30, 90)
) + "), "
SMD = ", sv AS (" + " UNION ALL ".join(f"SELECT obs_id, treated, '{f}' AS variable, ln(1 + {f}::DOUBLE) AS v FROM tb" for f in c.FEATURES) + """),
sa AS (SELECT sv.* FROM mp JOIN sv ON sv.obs_id IN (treated_obs, control_obs)),
f AS (SELECT variable, 'before' AS k, * EXCLUDE (variable) FROM sv UNION ALL SELECT variable, 'after', * EXCLUDE (variable) FROM sa),
q AS (SELECT variable, k, avg(v) FILTER (treated = 1) - avg(v) FILTER (treated = 0) AS d, sqrt((var_pop(v) FILTER (treated = 1) + var_pop(v) FILTER (treated = 0)) / 2) AS p FROM f GROUP BY 1, 2)
SELECT variable, round(max(CASE WHEN p = 0 THEN 0 ELSE d / p END) FILTER (k = 'before'), 6) AS smd_before, round(max(CASE WHEN p = 0 THEN 0 ELSE d / p END) FILTER (k = 'after'), 6) AS smd_after FROM q GROUP BY 1"""
DYN = """, dy AS (SELECT r AS relative_day, (SELECT count(*) FROM mc JOIN follows ON dst = t.node_id WHERE date_diff('day', t.index_date, date_followed) = r) / (SELECT count(*) FROM mc)::DOUBLE AS a,
  (SELECT count(*) FROM mc JOIN follows ON dst = k.node_id WHERE date_diff('day', k.index_date, date_followed) = r) / (SELECT count(*) FROM mc)::DOUBLE AS b FROM (SELECT unnest(range(-90, 91)) AS r) WHERE r <> 0)"""
QUALITY = """, pp AS (SELECT match_id, 'treated' AS role, t.node_id AS node_id, t.index_date AS index_date FROM mc UNION ALL SELECT match_id, 'control', k.node_id, k.index_date FROM mc),
nf AS (SELECT DISTINCT match_id, role, node_id, index_date, src AS follower FROM pp JOIN follows ON dst = node_id WHERE date_followed > index_date AND date_followed <= index_date + 90),
x AS (SELECT nf.*, (SELECT min(date_followed) FROM follows WHERE src = nf.node_id AND dst = nf.follower) <= index_date + 90 AS mutual, a.community AS mine, b.community AS theirs
  FROM nf LEFT JOIN node_labels a ON a.node_id = nf.node_id LEFT JOIN node_labels b ON b.node_id = follower)
SELECT role, count(*) AS new_followers_90, count(*) FILTER (mutual) AS reciprocal_new_followers_90, round(avg(coalesce(mutual, false)::INT), 6) AS reciprocal_share,
  count(*) FILTER (mine IS NOT NULL AND theirs IS NOT NULL) AS community_known_pairs, round(avg((mine = theirs)::INT), 6) AS same_final_community_share FROM x GROUP BY 1"""

ROUNDED = ["treated_mean", "control_mean", "mean_difference", "ci_low", "ci_high", "standard_error", "mean_ratio"]


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _s(step):
    build = lambda t, config=CONFIG: step(Study(t, config))
    return build


def checks(s: Study):
    matches = s.matches
    cohort = c.durable(c.matched_cohort(matches, s.table))
    found, dynamics = c.effects(cohort), c.event_dynamics(cohort, s.t.follows)
    return c.integrity_checks(cohort, matches, s.config, s.first, c.balance(s.table, matches), dynamics, found, s.fit[1])


def _full(build):
    return lambda t: build(t, FULL)


DEFS: dict[str, tuple] = {
    "membership_exposure": (_s(lambda s: s.exposure), EXPOSURE + " SELECT * FROM ex"),
    "first_treatment": (_s(lambda s: s.first), FIRST + " SELECT * FROM ft"),
    "horizon_bound": (_s(lambda s: s.bound), BOUND + " SELECT * FROM hb"),
    "treatment_eligible": (_s(lambda s: s.eligible), ELIGIBLE + " SELECT * FROM el"),
    "treated_sample": (_s(lambda s: s.treated), TREATED + " SELECT * FROM tr"),
    "treated_full_population": (
        lambda t: c.treated_sample(Study(t).eligible, c.Config(treatment_rows=None)),
        ELIGIBLE + f" SELECT *, row_number() OVER (ORDER BY {KEY('node_id', CONFIG.seed)}, node_id) AS treatment_id FROM el",
    ),
    "control_pool": (_s(lambda s: s.pool), POOL + " SELECT * FROM cp"),
    "risk_set_controls": (_s(lambda s: s.controls), CONTROLS + " SELECT * FROM rc"),
    "observations": (_s(lambda s: s.obs), OBS + " SELECT * FROM ob"),
    "incoming_features": (_s(lambda s: s.incoming), INCOMING + " SELECT * FROM fi"),
    "outgoing_features": (_s(lambda s: s.outgoing), OBS + OUT + " SELECT * FROM fo"),
    "treatment_attributes": (_s(lambda s: _r(s.attributes, "mean_pack_size")), TREATED + ATTR + " SELECT * REPLACE (round(mean_pack_size, 6) AS mean_pack_size) FROM ta"),
    "cohort_features": (_s(lambda s: s.table), TABLE + " SELECT * FROM tb"),
    "strata": (
        _s(lambda s: s.table.select("obs_id", c.stratum(F.col("index_date"), F.col("account_age_days")).alias("stratum"))),
        TABLE + " SELECT obs_id, (floor(date_diff('day', DATE '1970-01-01', index_date) / 7)::BIGINT * 10 + CASE WHEN account_age_days <= 90 THEN 0 WHEN account_age_days <= 365 THEN 1 WHEN account_age_days <= 730 THEN 2 ELSE 3 END)::BIGINT AS stratum FROM tb",
    ),
    "propensity_scores": (_s(lambda s: _r(s.scores, "score")), None),
    "matched_pairs": (_s(lambda s: _r(s.matches, "distance")), None),
    "matched_balance": (_s(lambda s: _r(c.balance(s.table, s.matches), "smd_before", "smd_after")), None),
    "matched_effects": (_s(lambda s: _r(c.effects(c.durable(c.matched_cohort(s.matches, s.table))), *ROUNDED)), None),
    "index_pairs": (_s(lambda s: s.pairs), PAIRS + " SELECT * FROM mp"),
    "smd_balance": (_s(lambda s: _r(c.balance(s.table, s.pairs), "smd_before", "smd_after")), PAIRS + SMD),
    "paired_effects": (_s(lambda s: _r(c.effects(s.cohort), *ROUNDED)), COHORT + LONG + EFFECT.format(keys="outcome, horizon_days, estimand", where="")),
    "subgroup_effects": (_s(lambda s: _r(c.subgroup_effects(s.cohort, s.attributes, 20), *ROUNDED)), COHORT + ATTR + SUB + EFFECT.format(keys="dimension, subgroup, horizon_days", where="WHERE pairs >= 20")),
    "event_dynamics": (
        _s(lambda s: _r(c.event_dynamics(s.cohort, s.t.follows), "treated_mean", "control_mean", "mean_difference")),
        COHORT + DYN + " SELECT relative_day, round(a, 6) AS treated_mean, round(b, 6) AS control_mean, round(a - b, 6) AS mean_difference FROM dy",
    ),
    "network_quality": (_s(lambda s: _r(c.network_quality(s.cohort, s.t.follows, s.t.labels), "reciprocal_share", "same_final_community_share")), COHORT + QUALITY),
    "dynamics_report": (
        _s(lambda s: _r(c.dynamics_report(c.event_dynamics(s.cohort, s.t.follows)), "peak_difference", "mean_before")),
        COHORT + DYN + " SELECT arg_max(relative_day, (round(a - b, 12), -relative_day)) FILTER (relative_day > 0) AS peak_day, round(max(a - b) FILTER (relative_day > 0), 6) AS peak_difference, round(avg(a - b) FILTER (relative_day < 0), 6) AS mean_before FROM dy",
    ),
    "cohort_checks": (_s(checks), None),
    "extreme_pairs": (
        _s(lambda s: c.extreme_pairs(s.cohort)),
        COHORT + " SELECT match_id, t.node_id AS t_node_id, k.node_id AS c_node_id, t.post_followers_90 - k.post_followers_90 AS difference FROM mc ORDER BY 4 DESC, 1 LIMIT 100",
    ),
}

#: Steps that hold no more than the sample; each has a variant ``<name>_full`` without SQL.
SAMPLED = """treated_sample control_pool risk_set_controls observations incoming_features outgoing_features treatment_attributes cohort_features strata
propensity_scores matched_pairs matched_balance matched_effects index_pairs smd_balance paired_effects subgroup_effects event_dynamics network_quality
dynamics_report cohort_checks extreme_pairs""".split()
DEFS |= {f"{name}_full": (_full(DEFS[name][0]), None) for name in SAMPLED}
