"""Golden values of a small graph."""

import pytest

from veingraph.operators import clustering, components, degree, diffusion, pagerank, traversal, triangles, walk


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_degrees(ring):
    assert pairs(degree.degree_distribution(ring)) == {(2, 3), (3, 2), (4, 3)}
    assert [tuple(r) for r in degree.degree_dist(ring, 2).collect()] == [(2, 3), (3, 2)]


def test_triangles(ring):
    assert triangles.triangle_count_undirected(ring).first()[0] == 4
    assert pairs(triangles.triangle_count_undirected_per_node(ring)) == {("node:1", 1), ("node:3", 1), ("node:5", 1), ("node:6", 1)}
    assert tuple(triangles.triangle_count_directed_parts(ring).first()) == (2, 0, 2)
    assert triangles.triangle_count_directed(ring).first()[0] == 4
    assert [tuple(r) for r in triangles.triangle_dist(ring).collect()] == [(1, 4), (2, 4)]


def test_eccentricities(ring):
    found = dict(pairs(traversal.eccentricities(ring, traversal.all_sources(ring))))
    assert [found[f"node:{i}"] for i in range(1, 9)] == [2, 3, 3, 3, 2, 2, 3, 3]
    assert traversal.diameter(ring).first()[0] == 3
    assert traversal.radius(ring).first()[0] == 2
    assert tuple(traversal.eccentricity(ring, "node:99").first()) == ("node:99", 0)


def test_components(ring):
    assert {r["label"] for r in components.connected_components(ring).collect()} == {"node:1"}


def ranks(found, key, value):
    by = {r[key]: r[value] for r in found.ranks.collect()}
    return [by[f"node:{i}"] for i in range(1, 9)]


DIRECTED = [0.0341223090, 0.0332519813, 0.0496332780, 0.0943482861, 0.1440191466, 0.0934779584, 0.0620793864, 0.1246684668]
UNDIRECTED = [0.1264074090, 0.0899215210, 0.1614915602, 0.0883768263, 0.1607265279, 0.1603040643, 0.0886207309, 0.1241513604]
LARGE = [0.0413723958, 0.0417708333, 0.0542552083, 0.0997405382, 0.1543958333, 0.1019514974, 0.0718750000, 0.1329687500]
LARGE_BOTH = [0.1250000000, 0.0938997396, 0.1675055339, 0.0925716146, 0.1604166667, 0.1692708333, 0.0807291667, 0.1250000000]
SHELL = [0.0318369998, 0.0322810631, 0.0461894109, 0.0813574228, 0.1163642835, 0.0818014862, 0.0535769646, 0.0992250066]
SHELL_BOTH = [0.1255742130, 0.0890694734, 0.1634927766, 0.0875306031, 0.1602088672, 0.1612463400, 0.0882801095, 0.1245976171]
SHELL_MAX = [0.0318367746, 0.0322806638, 0.0461886162, 0.0811514370, 0.1159662842, 0.0815953262, 0.0534540055, 0.0989184712]


@pytest.mark.parametrize(
    "options, rounds, expected",
    [
        ({"directed": True}, 5, DIRECTED),
        ({"directed": False}, 4, UNDIRECTED),
        ({"directed": True, "only_large_updates": True}, 5, LARGE),
        ({"directed": False, "only_large_updates": True}, 4, LARGE_BOTH),
    ],
)
def test_pagerank(ring, options, rounds, expected):
    found = pagerank.pagerank(ring, **options)
    assert ranks(found, "vertex", "pagerank") == pytest.approx(expected, rel=1e-7)
    assert found.rounds == rounds


@pytest.mark.parametrize(
    "options, rounds, expected",
    [
        ({"directed": True}, 16, SHELL),
        ({"directed": False}, 9, SHELL_BOTH),
        ({"directed": True, "diff_type": "maxDiff"}, 19, SHELL_MAX),
    ],
)
def test_shell_pagerank(ring, options, rounds, expected):
    found = pagerank.shell_pagerank(ring, **options)
    assert ranks(found, "s", "newPR") == pytest.approx(expected, rel=1e-7)
    assert found.rounds == rounds


def test_badrank_equals_pagerank_unless_reversed(ring):
    assert ranks(pagerank.shell_badrank(ring, max_iterations=3), "s", "newBR") == pytest.approx(ranks(pagerank.shell_pagerank(ring, max_iterations=3), "s", "newPR"))
    other = ranks(pagerank.shell_badrank(ring, max_iterations=3, reverse=True), "s", "newBR")
    assert other != pytest.approx(ranks(pagerank.shell_pagerank(ring, max_iterations=3), "s", "newPR"))


def test_peer_pressure(ring):
    found = clustering.peer_pressure(ring)
    assert found.changed == [8, 7, 2, 0]
    assert {r["label"] for r in found.labels.collect()} == {"node:1"}


def test_diffusion(ring):
    first = dict(pairs(diffusion.graph_diffusion(ring, "node:1", max_iterations=1)))
    assert first == pytest.approx({"node:2": 95 / 3, "node:3": 95 / 3, "node:6": 95 / 3})
    second = dict(pairs(diffusion.graph_diffusion(ring, "node:1", max_iterations=2)))
    assert second["node:1"] == pytest.approx(9.025) and second["node:5"] == pytest.approx(6.016667, rel=1e-6) and "node:6" not in second
    fifth = dict(pairs(diffusion.graph_diffusion(ring, "node:1")))
    assert [fifth[f"node:{i}"] for i in range(1, 9)] == pytest.approx(
        [0.006716848, 0.006716848, 0.01276201, 0.007164638, 0.009403588, 0.01320980, 0.004477899, 0.008731903], rel=1e-5
    )
    with pytest.raises(ValueError):
        diffusion.graph_diffusion(ring, "node:1", max_iterations=0)


def test_diffusion_variants(ring):
    paper = dict(pairs(diffusion.graph_diffusion(ring, "node:1", max_iterations=1, variant="paper")))
    assert paper == pytest.approx({"node:2": 95.0, "node:3": 95.0, "node:6": 95.0})
    beta = dict(pairs(diffusion.graph_diffusion(ring, "node:1", max_iterations=2, variant="beta")))
    assert beta["node:1"] < 9.025  # three equal gifts count once


def test_random_walk(ring):
    found = walk.random_walk(ring, length=4, n_paths=5, max_iterations=1, seed=3)
    assert found.rounds == 2
    assert sum(r["percentage"] for r in found.ranks.collect()) == pytest.approx(1.0)
    edges = {(r["s"], r["o"]) for r in ring.collect()}
    paths = {}
    for r in found.visits.collect():
        paths.setdefault(r["path"], {})[r["step"]] = r["v"]
    assert len(paths) == 10
    for steps in paths.values():
        nodes = [steps[i] for i in range(len(steps))]
        assert len(nodes) <= 5 and all(e in edges for e in zip(nodes, nodes[1:]))
    again = walk.random_walk(ring, length=4, n_paths=5, max_iterations=1, seed=3)
    assert pairs(again.visits) == pairs(found.visits)
    best = walk.path_rank(found, 3).collect()
    assert len(best) == 3 and best[0]["score"] >= best[1]["score"] and "->" in best[0]["nodes"]
    assert walk.random_node(ring, 1).first()[0].startswith("node:")
