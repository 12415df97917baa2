"""Registered queries over the follow graph and the pack hypergraph, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import persons
from ..operators import community, hyper, kcore, leiden, network, ranking, scc
from ..operators.components import components_on_arrays, connected_components
from ..sources.crosswalk import Tables
from ..storage import durable

#: A person with many follows at every scale, and a second one.
A, B = 7, 11

#: Least labels along edges e(a, b), both ways, until none falls.
LEAST = """, comp(node, component) USING KEY (node) AS (SELECT a, a FROM e UNION
(SELECT DISTINCT ON (u.node) u.node, v.component FROM recurring.comp u JOIN e ON e.a = u.node JOIN comp v ON v.node = e.b WHERE v.component < u.component ORDER BY u.node, v.component))"""
REACH = """, e AS (SELECT src AS a, dst AS b FROM follows UNION SELECT dst, src FROM follows)""" + LEAST
#: The component of the busiest source by reach in both directions, then all reach among the rest.
REACH_DIRECTED = """, e AS (SELECT DISTINCT src AS a, dst AS b FROM follows),
p AS (SELECT a FROM e GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
f(node) AS (SELECT a FROM p UNION SELECT e.b FROM f JOIN e ON e.a = f.node),
g(node) AS (SELECT a FROM p UNION SELECT e.a FROM g JOIN e ON e.b = g.node),
big AS (SELECT node FROM f JOIN g USING (node)),
n AS (SELECT node FROM (SELECT a AS node FROM e UNION SELECT b FROM e) WHERE node NOT IN (SELECT node FROM big)),
e2 AS (SELECT * FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)),
r(node, root) AS (SELECT node, node FROM n UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.node),
comp AS (SELECT x.node, min(x.root) AS component FROM r x JOIN r y ON x.node = y.root AND x.root = y.node GROUP BY x.node
  UNION ALL SELECT node, (SELECT min(node) FROM big) FROM big)"""
PACK_REACH = """, s AS (SELECT pack_id, min(member_id) AS a FROM memberships GROUP BY pack_id),
e AS (SELECT a, member_id AS b FROM memberships JOIN s USING (pack_id) UNION SELECT member_id, a FROM memberships JOIN s USING (pack_id))""" + LEAST
SIZES = """ SELECT component_size, count(*) AS component_count FROM (SELECT count(*) AS component_size FROM comp GROUP BY component) GROUP BY 1"""

PAIRS = """, p AS (SELECT x.member_id AS node_a, y.member_id AS node_b, count(*) AS cooccurrence
  FROM unique_memberships x JOIN unique_memberships y ON x.pack_id = y.pack_id AND x.member_id < y.member_id GROUP BY 1, 2)"""
DEGREES = """, d AS (SELECT node_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (
  SELECT dst AS node_id, 1 AS i, 0 AS o FROM follows UNION ALL SELECT src, 0, 1 FROM follows) GROUP BY 1)"""
STATS = PAIRS + """, st AS (SELECT node_id, count(*) AS degree, sum(cooccurrence)::BIGINT AS strength FROM (
  SELECT node_a AS node_id, cooccurrence FROM p UNION ALL SELECT node_b, cooccurrence FROM p) GROUP BY 1)"""


def s_line_sql(source: str, s_max: int) -> str:
    return f""", o AS (SELECT x.pack_id AS a, y.pack_id AS b, count(*) AS overlap FROM {source} x JOIN {source} y ON x.member_id = y.member_id AND x.pack_id < y.pack_id GROUP BY 1, 2),
t AS (SELECT range AS s FROM range(1, {s_max + 1})),
m AS (SELECT pack, max(overlap) AS overlap FROM (SELECT a AS pack, overlap FROM o UNION ALL SELECT b, overlap FROM o) GROUP BY 1)
SELECT s, (SELECT count(*) FROM o WHERE overlap >= s) AS edges, (SELECT count(*) FROM m WHERE overlap >= s) AS nodes FROM t WHERE (SELECT count(*) FROM o) > 0"""


def degrees(t: Tables):
    return network.follow_degrees(t.follows)


def projection(t: Tables):
    return hyper.pair_weights(t.unique_memberships)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def person_sql(query: str):
    return lambda t: persons.call(t.spark, t.follows, query)


def configuration(t: Tables):
    """Entropy of the randomised memberships; ``configuration_invariants`` has what must hold."""
    return community.edge_entropy(community.configuration_rounds(t.unique_memberships), t.labels)


def communities(t: Tables):
    return community.communities(projection(t))


def wcc(t: Tables):
    return connected_components(network.check_endpoints(t.follows, t.nodes), "src", "dst")


def invariants(t: Tables):
    before = durable(t.unique_memberships)
    return community.configuration_invariants(before, community.configuration_rounds(before))


def projection_giant(t: Tables):
    return giant_of(t.unique_memberships)


def giant_of(unique, most_exact: int | None = None):
    """Where all pairs of a pack are links, components are those of the packs and only the giant one is projected;
    with ``most_exact`` larger packs are sampled, so the whole projection is searched."""
    unique = durable(unique)
    if most_exact is None or unique.groupBy("pack_id").count().where(F.col("count") > most_exact).isEmpty():
        giant = community.giant_nodes(durable(kcore.pack_components(unique, components_on_arrays)))
        return hyper.pair_weights(unique.join(giant.withColumnRenamed("node", "member_id"), "member_id", "left_semi")).select("node_a", "node_b")
    edges = durable(hyper.pair_weights(unique, most_exact).select("node_a", "node_b"))
    return community.giant_component(edges, connected_components(edges, "node_a", "node_b"))


def leiden_giant(t: Tables):
    return leiden.leiden(projection_giant(t))


def leiden_summary(t: Tables):
    """Modularity of the communities and their agreement with the labels, one row."""
    edges = durable(projection_giant(t))
    labels = durable(leiden.leiden(edges))
    alike = community.agreement(community.label_contingency(labels, t.labels))
    return _round(community.modularity(edges, labels).crossJoin(alike), "modularity", "nmi", "ari", digits=9)  # one row each


DEFS: dict[str, tuple] = {
    # name: (function of Tables, SQL after the shared CTEs or None, recursive)
    "node_creation_volume": (lambda t: network.node_creation_volume(t.nodes), "SELECT date_created, count(*) AS account_count FROM nodes WHERE date_created IS NOT NULL GROUP BY 1"),
    "node_status_counts": (lambda t: network.node_status_counts(t.nodes), "SELECT active, status, count(*) AS account_count FROM nodes GROUP BY 1, 2"),
    "node_summary": (
        lambda t: network.node_summary(t.nodes),
        "SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (active OR active IS NULL) AS extant, count(*) FILTER (active IS NULL) AS unknown FROM nodes",
    ),
    "status_rollup": (
        lambda t: network.status_rollup(t.nodes),
        "SELECT CASE WHEN active IS NULL THEN 'Unknown' WHEN active THEN 'Active' ELSE 'Inactive' END AS label, count(*) AS account_count FROM nodes GROUP BY 1",
    ),
    "follow_volume": (lambda t: network.follow_volume(t.follows), "SELECT date_followed, count(*) AS follow_count FROM follows GROUP BY 1"),
    "follow_sample_volume": (
        lambda t: network.follow_volume(network.sample_follows(t.follows, 1000)),
        "SELECT date_followed, count(*) AS follow_count FROM (SELECT * FROM follows ORDER BY src, dst, date_followed LIMIT 1000) GROUP BY 1",
    ),
    "follow_degrees": (degrees, DEGREES + " SELECT * FROM d"),
    "follow_degree_distribution": (
        lambda t: network.follow_degree_distribution(degrees(t)),
        DEGREES + " SELECT degree, sum(i)::BIGINT AS in_node_count, sum(o)::BIGINT AS out_node_count FROM (SELECT in_degree AS degree, 1 AS i, 0 AS o FROM d UNION ALL SELECT out_degree, 0, 1 FROM d) WHERE degree > 0 GROUP BY 1",
    ),
    "follow_time_std": (
        lambda t: _round(network.follow_time_std(t.follows), "in_std_days", "out_std_days"),
        """, x AS (SELECT dst AS node_id, epoch(date_followed) / 86400 AS i, NULL AS o FROM follows UNION ALL SELECT src, NULL, epoch(date_followed) / 86400 FROM follows)
        SELECT node_id, round(stddev_samp(i), 6) AS in_std_days, round(stddev_samp(o), 6) AS out_std_days FROM x GROUP BY 1""",
    ),
    "follow_impossible_timestamps": (
        lambda t: network.impossible_timestamps(t.follows, t.nodes),
        "SELECT count(*) AS impossible FROM follows f LEFT JOIN nodes s ON f.src = s.node_id LEFT JOIN nodes d ON f.dst = d.node_id WHERE f.date_followed < s.date_created OR f.date_followed < d.date_created",
    ),
    "follow_summary": (lambda t: network.follow_summary(degrees(t)), DEGREES + " SELECT sum(out_degree)::BIGINT AS edges, count(*) AS nodes, max(in_degree) AS max_in_degree, max(out_degree) AS max_out_degree FROM d"),
    "pack_degree_distribution": (lambda t: hyper.pack_degree_distribution(t.memberships), "SELECT degree, count(*) AS node_count FROM (SELECT count(*) AS degree FROM memberships GROUP BY member_id) GROUP BY 1"),
    "pack_size_distribution": (lambda t: hyper.pack_size_distribution(t.packs), "SELECT member_count AS pack_size, count(*) AS pack_count FROM packs GROUP BY 1"),
    "pack_creation_volume": (lambda t: hyper.pack_creation_volume(t.packs), "SELECT date_created, count(*) AS pack_count FROM packs GROUP BY 1"),
    "packs_per_creator": (lambda t: hyper.packs_per_creator(t.packs), "SELECT creator_id, count(*) AS packs_created FROM packs GROUP BY 1"),
    "creator_ages": (
        lambda t: hyper.creator_ages(t.packs, t.nodes),
        "SELECT pack_id, date_diff('day', n.date_created, p.date_created) AS account_age_days FROM packs p JOIN nodes n ON p.creator_id = n.node_id WHERE n.date_created IS NOT NULL",
    ),
    "pack_summary": (
        lambda t: _round(hyper.pack_summary(t.packs, t.memberships, hyper.creator_ages(t.packs, t.nodes)), "mean_size", "mean_degree"),
        """, g AS (SELECT count(*) AS d FROM memberships GROUP BY member_id)
        SELECT count(*) AS packs, min(member_count) AS min_size, max(member_count) AS max_size, round(avg(member_count), 6) AS mean_size,
          (SELECT min(d) FROM g) AS min_degree, (SELECT max(d) FROM g) AS max_degree, round((SELECT avg(d) FROM g), 6) AS mean_degree, (SELECT count(*) FROM g) AS members,
          (SELECT count(*) FROM packs p JOIN nodes n ON p.creator_id = n.node_id WHERE p.date_created < n.date_created) AS negative_ages FROM packs""",
    ),
    "pair_cooccurrence": (
        lambda t: hyper.pair_cooccurrence(t.packs, t.memberships, 10),
        """SELECT cooccurrence, count(*) AS pair_count FROM (SELECT count(*) AS cooccurrence FROM memberships x JOIN memberships y ON x.pack_id = y.pack_id AND x.member_id < y.member_id
        JOIN packs k ON k.pack_id = x.pack_id WHERE member_count BETWEEN 2 AND 10 GROUP BY x.member_id, y.member_id) GROUP BY 1""",
    ),
    "pair_cooccurrence_distinct": (lambda t: hyper.cooccurrence_histogram(projection(t)), PAIRS + " SELECT cooccurrence, count(*) AS pair_count FROM p GROUP BY 1"),
    "pair_cooccurrence_sampled": (lambda t: hyper.cooccurrence_histogram(hyper.pair_weights(t.unique_memberships, 6, 5)), None),
    "clique_projection": (projection, PAIRS + " SELECT * FROM p"),
    "projection_node_stats": (lambda t: hyper.projection_node_stats(projection(t)), STATS + " SELECT * FROM st"),
    "projection_degree_distribution": (lambda t: hyper.projection_degree_distribution(hyper.projection_node_stats(projection(t))), STATS + " SELECT degree, count(*) AS node_count FROM st GROUP BY 1"),
    "projection_edge_lookup": (
        lambda t: hyper.projection_edge(projection(t), B, A),
        PAIRS + f" SELECT coalesce(max(cooccurrence), 0) AS cooccurrence FROM p WHERE node_a = {A} AND node_b = {B}",
    ),
    "s_line_filtered": (
        lambda t: hyper.s_line_filtered(t.memberships, 5, 30),
        s_line_sql("(SELECT * FROM memberships WHERE member_id IN (SELECT member_id FROM memberships GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30))", 5),
    ),
    "s_line_full": (lambda t: hyper.s_line_full(t.unique_memberships, 20), s_line_sql("unique_memberships", 20)),
    # The two ways that rows can go, at any size.
    "s_line_full_blocks": (lambda t: hyper.s_line_full(t.unique_memberships, 20, blocks=6), s_line_sql("unique_memberships", 20)),
    "s_line_full_pairs": (lambda t: hyper.s_line_full(t.unique_memberships, 20, blocks=0), s_line_sql("unique_memberships", 20)),
    "projection_check": (
        lambda t: hyper.projection_check(projection(t), hyper.cooccurrence_histogram(projection(t))),
        PAIRS + " SELECT count(*) AS edges, count(*) AS pairs, true AS ok FROM p",
    ),
    "projection_giant_component": (
        projection_giant,
        PAIRS + ", e AS (SELECT node_a AS a, node_b AS b FROM p UNION SELECT node_b, node_a FROM p)" + LEAST + """, best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT node_a, node_b FROM p JOIN comp ON node_a = node JOIN best USING (component)""",
        True,
    ),
    "s_line_density": (
        lambda t: _round(hyper.s_line_density(hyper.s_line_full(t.unique_memberships, 3), t.packs.count()), "density", digits=12),
        s_line_sql("unique_memberships", 3).replace("SELECT s, (SELECT count(*) FROM o WHERE overlap >= s) AS edges", ", z AS (SELECT s, (SELECT count(*) FROM o WHERE overlap >= s) AS edges")
        + ") SELECT s, round(edges / ((SELECT count(*) FROM packs)::DOUBLE * ((SELECT count(*) FROM packs) - 1) / 2), 12) AS density FROM z",
    ),
    "edge_entropy": (
        lambda t: _round(community.edge_entropy(t.unique_memberships, t.labels), "normalized_entropy"),
        """, c AS (SELECT pack_id, community, count(*) AS n FROM unique_memberships LEFT JOIN node_labels ON member_id = node_id GROUP BY 1, 2),
        g AS (SELECT pack_id, sum(n)::BIGINT AS member_count, count(community) AS communities_present, count(*) FILTER (community IS NULL) AS u FROM c GROUP BY 1)
        SELECT pack_id, member_count, communities_present, round(CASE WHEN member_count <= 1 OR communities_present <= 1 THEN 0.0
          ELSE (SELECT -sum((n / member_count) * ln(n / member_count)) FROM c WHERE c.pack_id = g.pack_id) / ln(member_count) END, 6) AS normalized_entropy FROM g WHERE u = 0""",
    ),
    "modularity": (
        lambda t: _round(community.modularity(projection(t), t.labels), "modularity"),
        PAIRS + """, x AS (SELECT a.community AS ca, b.community AS cb FROM p JOIN node_labels a ON node_a = a.node_id JOIN node_labels b ON node_b = b.node_id),
        y AS (SELECT c, count(*) AS d, sum(same) / 2 AS inside FROM (SELECT ca AS c, (ca = cb)::INT AS same FROM x UNION ALL SELECT cb, (ca = cb)::INT FROM x) GROUP BY 1)
        SELECT round(sum(inside / m - (d / (2 * m)) ** 2), 6) AS modularity, count(*) AS communities FROM y, (SELECT sum(d) / 2 AS m FROM y)""",
    ),
    "label_contingency": (
        lambda t: community.label_contingency(t.labels, t.labels.withColumn("community", F.expr("node_id % 5"))),
        "SELECT community AS community_a, node_id % 5 AS community_b, count(*) AS n FROM node_labels GROUP BY 1, 2",
    ),
    "label_agreement": (
        lambda t: _round(community.agreement(community.label_contingency(t.labels, t.labels.withColumn("community", F.expr("node_id % 5")))), "nmi", "ari", digits=9),
        """, x AS (SELECT community AS a, node_id % 5 AS b, count(*) AS n FROM node_labels GROUP BY 1, 2), ra AS (SELECT sum(n) AS n FROM x GROUP BY a), rb AS (SELECT sum(n) AS n FROM x GROUP BY b),
        s AS (SELECT (SELECT sum(n) FROM x)::DOUBLE AS t, (SELECT sum(n * (n - 1) / 2) FROM x) AS px, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb,
          (SELECT sum(n * ln(n)) FROM x) AS hx, (SELECT sum(n * ln(n)) FROM ra) AS ha, (SELECT sum(n * ln(n)) FROM rb) AS hb)
        SELECT round(2 * ((ln(t) - ha / t) + (ln(t) - hb / t) - (ln(t) - hx / t)) / ((ln(t) - ha / t) + (ln(t) - hb / t)), 9) AS nmi,
          round((px - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 9) AS ari FROM s""",
    ),
    "community_sizes": (lambda t: community.community_sizes(t.labels), "SELECT community, count(*) AS node_count FROM node_labels GROUP BY 1"),
    "top_communities": (lambda t: community.top_communities(t.labels), "SELECT community, count(*) AS node_count FROM node_labels GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "follow_wcc": (lambda t: kcore.size_histogram(wcc(t)), REACH + SIZES, True),
    "pack_components": (lambda t: kcore.size_histogram(kcore.pack_components(t.unique_memberships)), PACK_REACH + SIZES, True),
    "follow_scc": (lambda t: kcore.size_histogram(scc.strongly_connected_components(t.follows)), REACH_DIRECTED + SIZES, True),
    # No part of it in one task, at any size.
    "follow_scc_distributed": (lambda t: kcore.size_histogram(scc.strongly_connected_components(t.follows, most_local_edges=0)), REACH_DIRECTED + SIZES, True),
    "giant_component": (
        lambda t: community.giant_component(t.follows.selectExpr("src AS node_a", "dst AS node_b").distinct(), connected_components(t.follows, "src", "dst")),
        REACH + """, best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT DISTINCT src AS node_a, dst AS node_b FROM follows JOIN comp ON src = node JOIN best USING (component)""",
        True,
    ),
    "kcore": (lambda t: kcore.removal_core(t.unique_memberships), None),
    "kcore_distribution": (lambda t: kcore.core_distribution(kcore.removal_core(t.unique_memberships)), None),
    "kcore_monotone": (lambda t: kcore.monotone_core(t.unique_memberships), None),
    "kcore_local_updates": (lambda t: kcore.local_updates(t.unique_memberships), None),
    "configuration_model": (configuration, None),
    "configuration_invariants": (invariants, "SELECT unnest(['pack_sizes', 'member_degrees', 'distinct_memberships']) AS invariant, true AS kept"),
    "communities": (communities, None),
    "leiden": (leiden_giant, None),
    "leiden_summary": (leiden_summary, None),
    "communities_agreement": (lambda t: _round(community.agreement(community.label_contingency(communities(t), t.labels)), "nmi", "ari", digits=9), None),
    "kendall_topk": (
        lambda t: ranking.top_common(degrees(t), t.memberships, 1000),
        DEGREES + """ SELECT node_id, follow_degree, pack_degree FROM (SELECT node_id, in_degree + out_degree AS follow_degree FROM d ORDER BY 2 DESC, 1 LIMIT 1000)
        JOIN (SELECT member_id AS node_id, count(*) AS pack_degree FROM memberships GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000) USING (node_id)""",
    ),
    "kendall_tau": (lambda t: ranking.kendall_prefixes(ranking.top_common(degrees(t), t.memberships, 1_000_000), 500), None),
    "kendall_bins": (lambda t: ranking.log_bins(ranking.kendall_prefixes(ranking.top_common(degrees(t), t.memberships, 1_000_000), 500)), None),
    "follows_of": (person_sql(f"SELECT * FROM follows_of({A})"), f"SELECT dst AS node_id, date_followed FROM follows WHERE src = {A}"),
    "followers_of": (person_sql(f"SELECT * FROM followers_of({A})"), f"SELECT src AS node_id, date_followed FROM follows WHERE dst = {A}"),
    "is_following": (
        person_sql(f"SELECT b, is_following({A}, b) AS following FROM (SELECT explode(sequence(0L, 199L)) AS b)"),
        f"SELECT b, EXISTS (SELECT 1 FROM follows WHERE src = {A} AND dst = b) AS following FROM (SELECT unnest(range(0, 200)) AS b)",
    ),
    "mutual_follows": (
        person_sql(f"SELECT * FROM mutual_follows_of({A})"),
        f"SELECT o.dst AS node_id, o.date_followed AS followed, i.date_followed AS followed_by FROM follows o JOIN follows i ON o.dst = i.src WHERE o.src = {A} AND i.dst = {A}",
    ),
    "common_follows": (
        person_sql(f"SELECT * FROM common_follows_of({A}, {B})"),
        f"SELECT x.dst AS node_id, x.date_followed AS followed_by_a, y.date_followed AS followed_by_b FROM follows x JOIN follows y ON x.dst = y.dst WHERE x.src = {A} AND y.src = {B}",
    ),
    "indexed_follows": (
        lambda t: persons.Adjacency(t.follows, 16).query(f"SELECT * FROM mutual_follows_of({A})"),
        f"SELECT o.dst AS node_id, o.date_followed AS followed, i.date_followed AS followed_by FROM follows o JOIN follows i ON o.dst = i.src WHERE o.src = {A} AND i.dst = {A}",
    ),
    "degree_counts": (
        lambda t: network.degree_counts(t.follows, A),
        f"SELECT (SELECT count(*) FROM follows WHERE src = {A}) AS following, (SELECT count(*) FROM follows WHERE dst = {A}) AS followers",
    ),
    "recent_follows": (lambda t: network.recent_follows(t.follows, A), f"SELECT dst AS node_id, date_followed FROM follows WHERE src = {A} ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20"),
    "recent_followers": (lambda t: network.recent_follows(t.follows, A, True), f"SELECT src AS node_id, date_followed FROM follows WHERE dst = {A} ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20"),
    "person_card": (
        lambda t: network.person_card(t.nodes, degrees(t), A),
        DEGREES + f" SELECT node_id, date_created, active, status, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM nodes LEFT JOIN d USING (node_id) WHERE node_id = {A}",
    ),
    "people_followed": (
        lambda t: network.with_profiles(network.recent_follows(t.follows, A), t.nodes),
        f"SELECT node_id, date_followed, date_created, active, status FROM (SELECT dst AS node_id, date_followed FROM follows WHERE src = {A} ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20) LEFT JOIN nodes USING (node_id)",
    ),
    "followers_with_profile": (
        lambda t: network.with_profiles(network.recent_follows(t.follows, A, True), t.nodes),
        f"SELECT node_id, date_followed, date_created, active, status FROM (SELECT src AS node_id, date_followed FROM follows WHERE dst = {A} ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20) LEFT JOIN nodes USING (node_id)",
    ),
    "monthly_activity": (lambda t: network.monthly_activity(t.follows, A), f"SELECT date_trunc('month', date_followed)::DATE AS month, count(*) AS follows FROM follows WHERE src = {A} GROUP BY 1"),
    "packs_of_person": (
        lambda t: hyper.packs_of_person(t.packs, t.memberships, A),
        f"SELECT pack_id, creator_id, date_created, member_count, date_added FROM memberships JOIN packs USING (pack_id) WHERE member_id = {A}",
    ),
    "comembers": (
        lambda t: hyper.comembers(t.memberships, A),
        f"SELECT y.member_id, count(DISTINCT x.pack_id) AS shared_packs FROM memberships x JOIN memberships y ON x.pack_id = y.pack_id AND y.member_id <> {A} WHERE x.member_id = {A} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "top_out_degree": (lambda t: network.top_nodes(degrees(t), "out_degree"), DEGREES + " SELECT node_id, out_degree FROM d ORDER BY 2 DESC, 1 LIMIT 20"),
    "top_in_degree": (lambda t: network.top_nodes(degrees(t), "in_degree"), DEGREES + " SELECT node_id, in_degree FROM d ORDER BY 2 DESC, 1 LIMIT 20"),
    "busiest_days": (lambda t: network.busiest_days(network.follow_volume(t.follows)), "SELECT date_followed, count(*) AS follow_count FROM follows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
}
