"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from turnloom.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, id string"


def brute(rows):
    """n, deviations, components, variances and trace of (id, entries) by dense double arithmetic."""
    width = max(len(v) for _, v in rows)
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] + [100000] * (width - len(v)) for _, v in rows])
    n, total = len(x), x.sum(0)
    off = n * x.astype(object) - total.astype(object)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, (off**2).sum(1), centred, values[::-1], vectors[:, ::-1]


def check(rows, found, most=8):
    n, deviations, centred, values, vectors = brute(rows)
    kept = min(most, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == len(rows) * kept
    by = {}
    for r in found:
        by.setdefault(r["id"], {})[r["component"]] = r
    for k in range(kept):
        wanted = centred @ vectors[:, k] / np.sqrt(values[k])
        got = np.array([by[i][k + 1]["whitened"] for i, _ in rows])
        sign = np.sign(got @ wanted)
        assert np.allclose(got, sign * wanted, atol=1e-9, rtol=1e-9)
        assert by[rows[0][0]][k + 1]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10)
    for (i, _), d in zip(rows, deviations):
        assert {(r["n"], r["deviation"]) for r in by[i].values()} == {(n, int(d))}
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("width,count", [(3, 40), (12, 300), (24, 500)])
def test_components_of_random_vectors(spark, width, count):
    draw = np.random.default_rng(width)
    data = draw.normal(size=(count, width)) * np.linspace(1, 3, width)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(7)
    check(rows, whitening.whitened(table).collect())


def test_left_out_and_short_vectors(spark):
    draw = np.random.default_rng(5)
    good = [(i, [float(c) for c in draw.normal(size=4)]) for i in range(30)] + [(90, [0.5, 0.25]), (91, [])]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [1.0, float("nan"), 0.0, 0.0]), (53, [float("-inf"), 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, None, None) for i, v in good + bad], SCHEMA)
    check(good, whitening.whitened(table).collect())


def test_flat_directions_and_equal_vectors_are_no_components(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(a), 1.0, float(a), float(b)]) for i, (a, b) in enumerate(draw.normal(size=(50, 2)))]
    found = whitening.whitened(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)).collect()
    check(rows, found)
    assert {r["component"] for r in found} == {1, 2}
    for same in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]):
        table = spark.createDataFrame([(i, v, "", "") for i, v in same], SCHEMA)
        assert whitening.whitened(table).collect() == []


def test_equal_variances_are_all_found(spark):
    rows = [(i, [float(3 * ((i == 2 * k) - (i == 2 * k + 1))) for k in range(5)]) for i in range(10)]
    found = whitening.whitened(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)).collect()
    assert {r["component"] for r in found} == {1, 2, 3, 4, 5} and found[0]["identity_error"] < 1e-9


def test_repeated_and_null_ids_keep_their_rows(spark):
    rows = [(i, [float(k), float(k * k % 7)], "", "") for k, i in enumerate((1, 1, 2, None, None, 3))]
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).count() == 12


def test_deviations_beyond_64_bits_are_refused():
    model = whitening.Fit(1 << 22, np.array([0]), np.zeros((1, 0)), np.zeros(0), 1.0)
    with pytest.raises(OverflowError):
        model.deviations(np.array([[100000]]))


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    check(rows, queries.op11_whitening(spark, sf_dir).withColumnRenamed("vec_id", "id").collect())
