import math
import random

from pyspark.sql import functions as F

from termweave.functions import stats as S
from termweave.operators.enrich import false_discovery


def exact_tail(k, n, m, total):
    ways = math.comb(total, n)
    return sum(math.comb(m, x) * math.comb(total - m, n - x) for x in range(k, min(n, m) + 1)) / ways


def test_tail_against_exact_fractions(spark):
    pick = random.Random(1)
    rows = []
    for _ in range(300):
        total = pick.randint(2, 400)
        n, m = pick.randint(1, total), pick.randint(1, total)
        rows.append((pick.randint(max(0, n + m - total), min(n, m)), n, m, total))
    rows += [(44, 396, 137, 21521), (0, 5, 5, 10), (5, 5, 5, 5)]
    frame = spark.createDataFrame(rows, "k long, n long, m long, t long")
    for r in frame.select("*", S.hypergeometric_tail(*[F.col(c) for c in "knmt"]).alias("p")).collect():
        assert math.isclose(r.p, exact_tail(r.k, r.n, r.m, r.t), rel_tol=1e-8, abs_tol=1e-13), r


def test_tail_of_a_published_row(spark):
    """Forty-four of 396 against 137 of 21,521: fold 17.454 and p 1.421e-42 are published."""
    frame = spark.createDataFrame([(44, 396, 137, 21521)], "k long, n long, m long, t long")
    assert math.isclose(frame.select(S.hypergeometric_tail(*[F.col(c) for c in "knmt"])).first()[0], 1.421183151909268e-42, rel_tol=1e-9)
    assert round((44 / 396) / (137 / 21521), 3) == 17.454


def test_tail_does_not_underflow(spark):
    frame = spark.createDataFrame([(5000, 40000, 25000, 100000)], "k long, n long, m long, t long")
    assert frame.select(S.hypergeometric_tail(*[F.col(c) for c in "knmt"])).first()[0] == 1.0


def test_npmi(spark):
    got = spark.range(1).select(S.npmi(F.lit(6), F.lit(6), F.lit(6), F.lit(60)).alias("a"), S.npmi(F.lit(60), F.lit(60), F.lit(60), F.lit(60)).alias("b")).first()
    assert math.isclose(got.a, 1.0) and got.b is None


def test_false_discovery_by_set_with_ties_and_untested(spark):
    rows = [("a", p, True) for p in (0.01, 0.02, 0.02, 0.5, 1.0)] + [("b", 0.04, True), ("b", 0.01, False)]
    out = {(r.set_id, r.p_value, r.tested): r.fdr for r in false_discovery(spark.createDataFrame(rows, "set_id string, p_value double, tested boolean")).collect()}
    assert math.isclose(out["a", 0.02, True], 0.02 * 5 / 3) and math.isclose(out["a", 0.01, True], 0.02 * 5 / 3)
    assert math.isclose(out["a", 0.5, True], 0.625) and out["b", 0.04, True] == 0.04 and out["b", 0.01, False] == 1.0
