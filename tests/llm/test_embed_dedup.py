import numpy as np

from quern.llm import embed_dedup as E
from tests.llm import cases
from tests.llm.test_simhash import classes

SCHEMA = "vec_id long, embedding array<float>, label int"


def want(rows, threshold=0.93):
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if not (good(*a[1:]) and good(*b[1:]) and a[2] == b[2] and len(a[1]) == len(b[1])):
            return False
        x, y = (np.array(np.float32(v), np.float64) for v in (a[1], b[1]))
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold

    comp = classes(rows, linked)
    n = [sum(linked(a, b) for j, b in enumerate(rows) if j != i) for i, a in enumerate(rows)]
    return sorted([(a[0], k, c, a[0] is not None and a[0] == c) for a, k, c in zip(rows, n, comp, strict=True)], key=repr)


EDGE = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [], 1),
        (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.3], 1), (13, [1.0, 0.6], 1), (14, [1.0, 0.0], 1), (14, [1.0, 0.0], 1), (15, [1e-30, 0.0], 1), (16, [-1.0, 0.0], 1)]


def test_edge_rows(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    assert cases.same_with_clashes(E.embedding_near_duplicates, df) == want(EDGE)


def test_clouds_over_many_tiles(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.4])).astype(np.float32).tolist(), int(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert cases.rows(E.embedding_near_duplicates(df, tile=16)) == want(rows)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 24)) * rng.choice([1e-3, 1, 1e3], size=(200, 1))
    x[::5] = x[1::5] + rng.normal(size=(40, 24)) * 0.2 * np.abs(x[1::5])
    q = E.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.93), strict=True)}
    maybe = set(zip(*E.possible_pairs(q, q, 0.93), strict=True))
    assert true <= maybe and len(maybe) < 5 * len(true)


def test_no_rows(spark):
    assert E.embedding_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
