import numpy as np
import pytest

from graindeck.operators import retrieval
from graindeck.schema import ConstraintError


def ranks(spark, scores, positives, block_bytes=1 << 20):
    """Ranks for a score matrix: queries are unit vectors, candidates the matrix's columns."""
    n, m = np.array(scores).shape
    out = []
    for i in range(n):  # positives differ by query, so each query is its own call
        q = spark.createDataFrame([(i, 1, [float(i == j) for j in range(n)])], "qid long, grp int, vec array<double>")
        c = spark.createDataFrame(
            [(j, int(j in positives[i]), [float(scores[k][j]) for k in range(n)]) for j in range(m)], "idx long, grp int, vec array<double>"
        )
        out.append(retrieval.best_positive_ranks(q, c, block_bytes=block_bytes).collect()[0]["rank"])
    return out


def test_partial_ties(spark):
    scores = [[1, 1, 1, 0, 1], [1, 1, 0.5, 1, 0], [0.2, 0.1, 0, 0, 0.2]]
    assert ranks(spark, scores, [{4, 2}, {3, 1}, {0, 4}]) == [3, 2, 1]


def test_near_tie(spark):
    assert ranks(spark, [[1, 1 + 1e-12, 1 - 1e-12, 0.5]], [{0, 3}]) == [2]


def test_no_positive_is_null_and_no_recall(spark):
    assert ranks(spark, [[1, 2]], [set()]) == [None] and ranks(spark, [[1, 2]], [set()], block_bytes=1) == [None]
    some = spark.createDataFrame([(0, "a", 1), (1, "a", None)], "qid int, grp string, rank long")
    for summary in (retrieval.recall_summary, retrieval.group_balanced):
        with pytest.raises(Exception, match="no positive"):
            summary(some).collect()


@pytest.mark.parametrize("vec", [[], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], None])
def test_bad_vectors_are_errors(spark, vec):
    q = spark.createDataFrame([(0, 1, [1.0, 0.0])], "qid long, grp int, vec array<double>")
    c = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, vec)], "idx long, grp int, vec array<double>")
    for a, b in ((q, c), (q, c.limit(0)), (c.withColumnRenamed("idx", "qid"), q.withColumnRenamed("qid", "idx"))):
        with pytest.raises(ConstraintError):
            retrieval.best_positive_ranks(a, b)


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 20])
def test_all_tied_one_to_one(spark, block_bytes):
    q = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in range(12)], "qid long, grp long, vec array<double>")
    r = retrieval.best_positive_ranks(q, q.selectExpr("qid as idx", "grp", "vec"), block_bytes=block_bytes)
    s = retrieval.recall_summary(r).collect()[0]
    assert (s.r1, s.r5, s.r10, s.mean_rank) == pytest.approx((1 / 12, 5 / 12, 10 / 12, 6.5))


def test_group_balance(spark):
    r = spark.createDataFrame([(i, "a", 20) for i in range(5)] + [(5, "b", 1)], "qid int, grp string, rank long")
    assert retrieval.recall_summary(r).collect()[0].r1 == pytest.approx(1 / 6)
    assert retrieval.group_balanced(r).collect()[0].r1 == 0.5


def test_multi_positive_ties(spark):
    q = spark.createDataFrame([(0, 0, [1.0]), (1, 1, [1.0])], "qid long, grp int, vec array<double>")
    t = spark.createDataFrame([(0, 0, [1.0]), (1, 0, [1.0]), (2, 1, [1.0])], "idx long, grp int, vec array<double>")
    i2t = retrieval.recall_summary(retrieval.best_positive_ranks(q, t)).collect()[0]
    assert i2t.r1 == 0.5 and i2t.mean_rank == 2.0  # ranks 1 and 3
    back = retrieval.best_positive_ranks(t.selectExpr("idx as qid", "grp", "vec"), q.selectExpr("qid as idx", "grp", "vec"))
    s = retrieval.recall_summary(back).collect()[0]
    assert (s.r1, s.mean_rank) == pytest.approx((2 / 3, 4 / 3))


def test_random_against_sort(spark):
    rng = np.random.default_rng(1)
    v, g = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(0, 5, 40)
    df = spark.createDataFrame([(i, int(g[i]), v[i].tolist()) for i in range(40)], "qid long, grp int, vec array<double>").repartition(7)
    got = {r.qid: r["rank"] for r in retrieval.best_positive_ranks(df, df.selectExpr("qid as idx", "grp", "vec"), True, block_bytes=100).collect()}
    for i in range(40):
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-float(v[i] @ v[j]), j))
        assert got[i] == next((k + 1 for k, j in enumerate(order) if g[j] == g[i]), None)
