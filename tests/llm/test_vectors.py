"""Operators on embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann, covertree, vectors
from larkspur.llm.labels import Labels

SCHEMA = "vec_id bigint, embedding array<float>"
ODD = [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [1.0, None] + [0.0] * 6), (9005, [1.0] * 3), (9006, [float("inf")] * 8), (None, [1.0] * 8), (9007, [])]


def clusters(seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + rng.normal(size=(120, 8)) * 0.35 for c in centres] + [np.repeat(centres[:1], 40, 0)]).astype(np.float32)
    return rng.permutation(len(x)) * 5, x


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "n", "root", "cell", "part", "weight", "label")})


@pytest.mark.parametrize("cell_rows", [32, 4096])
def test_near_duplicates(spark, cell_rows):
    ids, x = clusters()
    found = {r.vec_id: r for r in covertree.near_duplicates(frame(spark, ids, x, ODD), 0.9, cell_rows).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    labels = Labels(len(ids))
    labels.link(*np.nonzero(near))
    for i, v in enumerate(ids):
        r = found[int(v)]
        least = int(ids[labels.of == labels.of[i]].min())
        assert (r.n_links, r.component_id, r.kept) == (int(near[i].sum()) - 1, least, least == v)
    for v in (9001, 9002, 9003, 9004, 9005, 9006, 9007):
        assert (found[v].n_links, found[v].component_id, found[v].kept) == (0, v, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)


def test_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0])]
    found = sorted(tuple(r) for r in covertree.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert covertree.near_duplicates(none).count() == 0 and ann.search(none, none).count() == 0
    assert covertree.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA)).count() == 2


def test_huge_and_tiny_vectors(spark):
    rows = [(1, [1e30, 1e30]), (2, [1e-30, 1e-30]), (3, [1.0, -1.0])]
    found = {r.vec_id: r.component_id for r in covertree.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def brute(ids, x, query, k):
    gap = x - x[query]
    score = np.sqrt((gap * gap).sum(1))
    order = [j for j in np.lexsort((ids, score)) if ids[j] != ids[query]][:k]
    return [(int(ids[j]), score[j]) for j in order]


def test_search_has_recall(spark, sf_dir):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = rows.toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    found = ann.search(rows, rows.where("vec_id % 20 = 0")).toPandas()
    hits = []
    for q, g in found.groupby("query_id"):
        wanted = dict(brute(ids, x, int(np.flatnonzero(ids == q)[0]), 10))
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 11)) and q not in set(g.vec_id)
        hits.append(len(wanted.keys() & set(g.vec_id)) / 10)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_search_ties_and_few_rows(spark):
    ids, x = clusters(7)
    found = ann.search(frame(spark, ids, x, ODD), frame(spark, ids[-40:], x[-40:], ODD)).toPandas()
    copies = sorted(int(i) for i in ids[-40:])
    for q, g in found.groupby("query_id"):
        wanted = [i for i in copies if i != q][:10]
        assert g.sort_values("rank").vec_id.tolist() == wanted and set(g.score) == {0.0}
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(7, None)], SCHEMA)
    got = ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_probes_come_in_order_and_once():
    hashed = ann.Hash(6, 1.0, 2, 4, 1.0)
    place = hashed.places(np.random.default_rng(0).normal(size=(1, 6)), 0)[0]
    own = hashed.bucket(np.floor(place).astype(int), 0)
    few, more = set(hashed.probes(place, 0, 1).tolist()), set(hashed.probes(place, 0, 20).tolist())
    assert few == {int(own)} and few <= more and len(more) == 20
    assert len(hashed.probes(place, 0, 10_000)) == 3**4


@pytest.mark.parametrize("cell_rows", [32, 4096])
def test_rescaled_copies(spark, cell_rows):
    rng = np.random.default_rng(7)
    x = rng.normal(size=48)
    rows = [(i, [float(v) for v in x * s]) for i, s in enumerate(rng.uniform(0.1, 9, 500))]
    found = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.9, cell_rows).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(499, 0)} and len(found) == 500


def test_cover_tree_of_one_direction_ends():
    rng = np.random.default_rng(1)
    for seed in range(40):
        x = rng.normal(size=48) * rng.uniform(0.1, 9, (200, 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert len(covertree.build(x).rows) == 200


def test_packed_vectors_come_back():
    x = np.random.default_rng(3).normal(size=(10, 7))
    column = vectors.packed(x)
    assert (vectors.unpacked(column, 7) == x).all() and (vectors.unpacked(column.slice(4, 3), 7) == x[4:7]).all()
    assert column[2].as_py() == x[2].tobytes() and vectors.unpacked(column.slice(10), 7).shape == (0, 7)


def unstructured(n, seed=11):
    """Unit vectors without structure and pairs of rows planted at cosines just above and below 0.9."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planted = []
    for i in range(0, n - 1, 40):
        other = rng.normal(size=64)
        other -= (other @ x[i]) * x[i]
        cosine = 0.9 + (1e-9 if i % 80 else -1e-9)
        x[i + 1] = cosine * x[i] + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
        if i % 80:
            planted.append((i, i + 1))
    return x, planted


@pytest.mark.parametrize("cell_rows", [300, None])
def test_planted_links_in_vectors_without_structure(spark, cell_rows):
    x, planted = unstructured(2000)
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(rows, 0.9, cell_rows).collect()}
    other = {b: a for a, b in planted}
    linked = set(other) | set(other.values())
    assert len(planted) == 25
    assert found == {i: (int(i in linked), other.get(i, i)) for i in range(2000)}


def test_few_pairs_are_compared_on_whole_vectors():
    x, _ = unstructured(2000)
    short = covertree.shadow(x, covertree.basis(x))
    assert np.allclose((short * short).sum(1), 1, atol=1e-5)
    products = short @ short.T
    assert (products >= x @ x.T - 1e-5).all()  # never farther apart than the vectors themselves
    assert (products >= 0.9 - 1e-4).mean() < 0.01
