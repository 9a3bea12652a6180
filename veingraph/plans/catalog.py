"""Every operator by its names, for the command line and for callers that choose by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from veingraph.operators import clustering, components, degree, diffusion, pagerank, profile, summary, traversal, triangles, walk

#: Shell defaults: the first ten rows, the first predicate, directed flow.
SHELL_LIMIT = 10

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "degree_distribution": degree.degree_distribution,
    "degree_dist": degree.degree_dist,
    "degree_dist_label": degree.degree_dist_label,
    "triangle_count_undirected": triangles.triangle_count_undirected,
    "triangle_count_undirected_per_node": triangles.triangle_count_undirected_per_node,
    "triangle_count_directed": triangles.triangle_count_directed,
    "triangle_count_multithread": triangles.triangle_count_directed,
    "triangle_count_directed_parts": triangles.triangle_count_directed_parts,
    "triangle_dist": triangles.triangle_dist,
    "triangle_dist_label": triangles.triangle_dist_label,
    "eccentricity": traversal.eccentricity,
    "diameter": traversal.diameter,
    "radius": traversal.radius,
    "connected_components": components.connected_components,
    "pagerank": lambda t, **o: pagerank.pagerank(t, **o).ranks,
    "pagerank_no_update_max": lambda t, **o: pagerank.pagerank(t, only_large_updates=True, **o).ranks,
    "test_algorithm": lambda t, **o: pagerank.pagerank(t, directed=True, **o).ranks,
    "shell_pagerank": lambda t, **o: pagerank.shell_pagerank(t, **o).ranks,
    "shell_badrank": lambda t, **o: pagerank.shell_badrank(t, **o).ranks,
    "peer_pressure": lambda t, **o: clustering.peer_pressure(t, **o).labels,
    "graph_diffusion": diffusion.graph_diffusion,
    "random_walk": lambda t, **o: walk.random_walk(t, **o).ranks,
    "path_rank": lambda t, **o: walk.path_rank(walk.random_walk(t, **o)),
    "random_node": walk.random_node,
    "count_graph": profile.count_graph,
    "count_type": profile.count_type,
    "count_preds": profile.count_preds,
    "count_types": profile.count_types,
    "pred_stats_all": profile.pred_stats_all,
    "pred_stats_number": profile.pred_stats_number,
    "pred_stats_nan": profile.pred_stats_nan,
    "show_all": profile.show_all,
    "ask_nothing": profile.ask_nothing,
    "profile_named_graphs": profile.profile_named_graphs,
    "profile_types": profile.profile_types,
    "profile_predicates": profile.profile_predicates,
    "network_stats": profile.network_stats,
    "predicates": profile.distinct_predicates,
    "predicate_graph": profile.predicate_graph,
    **summary.METRICS,
    **summary.ALIASES,
}

#: The shell's short names, with its defaults.
SHELL: dict[str, Callable[..., DataFrame]] = {
    "degree": lambda t, limit=SHELL_LIMIT: degree.degree_dist(t, limit),
    "triangles": lambda t, limit=SHELL_LIMIT: triangles.triangle_dist(t, limit),
    "pagerank": lambda t, limit=SHELL_LIMIT, **o: pagerank.shell_pagerank(t, limit=limit, **o).ranks,
    "badrank": lambda t, limit=SHELL_LIMIT, **o: pagerank.shell_badrank(t, limit=limit, **o).ranks,
    "peerpressure": lambda t, limit=SHELL_LIMIT, max_iterations=20, predicate=None, percent_threshold=0.01, vertices_threshold=4: (
        clustering.peer_pressure(t, max_iterations, predicate, predicate, percent_threshold, vertices_threshold).labels.orderBy("node").limit(limit)
    ),
}
SHELL |= {
    "dg": SHELL["degree"], "ta": SHELL["triangles"], "triangle": SHELL["triangles"], "pr": SHELL["pagerank"],
    "br": SHELL["badrank"], "pp": SHELL["peerpressure"],
}
#: Names that the shell listed without any behaviour.
NOT_IMPLEMENTED = (
    "trustrank", "closeness", "betweeness", "rankclus", "ngons", "snowball", "subdue", "collaborativefiltering",
    "fusionpower", "shortestpath", "beliefpropagation", "beliefdiffusion", "discovery",
)


def run(name: str, triples: DataFrame, shell: bool = False, **options) -> DataFrame:
    """The result of an operator by name, with the shell's names and defaults if ``shell``."""
    table = SHELL if shell else OPERATORS
    if name not in table:
        known = "not implemented" if name in NOT_IMPLEMENTED else "unknown"
        raise KeyError(f"{name} is {known}; there are {', '.join(sorted(table))}")
    return table[name](triples, **options)
