"""Vector operators against brute force in double precision."""

import math

import numpy as np
import pytest

from graphloom.llm import embedding_dedup, vector_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.18 * rng.standard_normal((n, dim))
    return x.astype(np.float32).astype(float).tolist()


def fixture():
    rows = [(i, v, 0) for i, v in enumerate(clustered(300))]
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]  # copies
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [None] + [1.0] * 15, 0), (2005, [float("inf")] * 16, 0), (None, rows[7][1], 0)]
    rows += [(2100, [1.0, 2.0], 0), (2101, [2.0, 4.0], 0), rows[5]]  # another length; a repeated row
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def directions(vectors):
    x = np.array(vectors, dtype=float)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def brute_links(rows):
    """Links by row number, every row a vector of its own."""
    links = {k: set() for k, (i, v, _) in enumerate(rows) if i is not None and usable(v)}
    for dim in {len(rows[k][1]) for k in links}:
        own = [k for k in links if len(rows[k][1]) == dim]
        x = directions([rows[k][1] for k in own])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.9)):
            if a != b:
                links[own[a]].add(own[b])
    return links


def expected_rows(rows):
    """(vec_id, n_links, component_id, kept) of every row."""
    links = brute_links(rows)
    name = component(links)
    least = {}
    for k, c in name.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = least[name[k]] if k in name else i
        out.append((i, len(links.get(k, ())), c, c == i))
    return sorted(out, key=repr)


def component(links):
    name = {}
    for i in sorted(links):
        stack = [i] if i not in name else []
        while stack:
            j = stack.pop()
            if j not in name:
                name[j] = i
                stack += links[j]
    return name


def found_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rows = fixture()
    df = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA))
    assert found_rows(df) == expected_rows(rows)
    assert {r["n_copies"] for r in df.where("vec_id = 7").collect()} == {31}


def test_dense_groups_and_extreme_sizes(spark):
    """Thousands of multiples and of noisy copies of one vector keep all links; very small and large vectors keep theirs."""
    rng = np.random.default_rng(2)
    base, other = rng.standard_normal((2, 16))
    rows = [(i, (base * (i + 1)).tolist(), 0) for i in range(1500)]
    rows += [(5000 + i, (other + 0.02 * rng.standard_normal(16)).tolist(), 0) for i in range(1500)]
    rows += [(9000 + k, v, 0) for k, v in enumerate(([1e-200, 1e-200], [0.99, 0.14], [1e200, 2e200], [1.0, 2.0], [5e-324, 5e-324], [-1e308, 1e308]))]
    rows += [(9003, [2.0, -1.0], 0), (9003, [1.0, 2.0], 0)]  # other rows with an id that is there
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found_rows(embedding_dedup.near_duplicate_vectors(df)) == expected_rows(rows)


def test_small_windows_still_find_the_links(spark):
    rows = [(i, v, 0) for i, v in enumerate(clustered(1500, seed=5))]
    found = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), window=32).collect()
    links = brute_links(rows)
    total = sum(map(len, links.values()))
    assert all(r["n_links"] <= len(links[r["vec_id"]]) for r in found)  # none below the threshold, none twice
    assert sum(r["n_links"] for r in found) >= 0.99 * total > 0


def test_near_copies_longer_than_many_windows(spark):
    """All links of distinct near copies that fill many windows are counted, and they stay one component."""
    rng = np.random.default_rng(11)
    dense = (rng.standard_normal(16) + 0.02 * rng.standard_normal((700, 16))).astype(np.float32).astype(float).tolist()
    rows = [(i, v, 0) for i, v in enumerate(clustered(600, seed=9))] + [(5000 + i, v, 0) for i, v in enumerate(dense)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), window=8).collect()}
    expected = {i: (n, c) for i, n, c, _ in expected_rows(rows)}
    assert min(expected[i][0] for i in range(5000, 5700)) >= 699
    assert all((got[i]["n_links"], got[i]["component_id"]) == expected[i] for i in range(5000, 5700))
    assert all(r["n_links"] <= expected[i][0] for i, r in got.items())


@pytest.mark.parametrize("blocks", [(4096, 512), (37, 11)])
def test_nearest_equal_brute_force(spark, blocks):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    got = vector_search.nearest_vectors(df, df.where("vec_id % 25 = 0"), 10, candidate_rows=blocks[0], query_rows=blocks[1]).collect()
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and usable(v)]
    expected = []
    for q, x in {(i, tuple(v)): (i, v) for i, v in good if i % 25 == 0}.values():
        near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(x))
        expected += [(q, k + 1, i, d) for k, (d, i) in enumerate(near[:10])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(x[:3] for x in expected)
    assert {(r["query_id"], r["rank"]): pytest.approx(r["score"], rel=1e-12) for r in got} == {x[:2]: x[3] for x in expected}


def test_nearest_of_very_small_and_large_vectors(spark):
    rows = [(100, [1.0, 1.0]), (1, [5e-324, 5e-324]), (2, [1e160, 1e160]), (3, [3.0, 1.0]), (4, [1e308, -1e308]), (5, [1e-200, 2e-200]), (200, [2e160, 2e160]), (6, [1.0, 1.5]), (100, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.nearest_vectors(df, df.where("vec_id % 100 = 0"), 3).collect()
    far = lambda x, y: math.hypot(*(a - b for a, b in zip(x, y)))
    expected = []
    for q, x in rows:
        if q % 100 == 0:
            expected += [(q, k + 1, i, d) for k, (d, i) in enumerate(sorted((far(x, v), i) for i, v in rows if i != q)[:3])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert [x[:3] for x in got] == [x[:3] for x in sorted(expected)]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in sorted(expected)], rel=1e-12)
