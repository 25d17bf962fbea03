"""Rows on which queries left their SQL: of no length, on a tolerance or an edge, and exact shares."""

import os

import duckdb
import pytest
from test_queries import bag

from stillframe.plans import catalog

SF = "/root/testdata/sf0.1"


@pytest.fixture
def small(spark, tmp_path):
    """Compares a query with its twin on the tables that are given as SQL over those of sf0.1."""
    def check(name, **tables):
        duck = duckdb.connect()
        for t, sql in tables.items():
            duck.sql(f"copy ({sql.replace('{}', f"'{SF}/{t}.parquet'")}) to '{tmp_path}/{t}.parquet' (format parquet)")
        for f in os.listdir(tmp_path):
            duck.sql(f"create or replace view {f.removesuffix('.parquet')} as select * from '{tmp_path}/{f}'")
        df = catalog.queries()[name](spark, str(tmp_path))
        want = duck.sql(catalog.oracle_sql()[name])
        got = bag(df.collect(), df.columns)
        assert got == bag(want.fetchall(), want.columns)
        return got

    return check


#: Frame 61 has a peak of no length; peaks of frame 787 lie on the tolerance.
FRAMES = "select * from {} where l_suppkey in (61, 787)"


@pytest.mark.parametrize("name", ["prj04_match_count", "flt05_strict_gate", "flt05_floor_gate", "flt06_live_gate", "flt07_gate_pair", "agg26_null_margin", "top10_size_batches", "agg37_null_quantiles", "exp01_strict_gate", "krn12_known_batches"])
def test_rows_of_no_length_and_ties(small, name):
    small(name, lineitem=FRAMES)


def test_exact_shares(spark):
    """A count that is just a share reaches it, as decimals say."""
    from pyspark.sql import functions as F

    from stillframe.functions import lattice as L

    n = [k for k in range(100, 2000, 100) if 28 * k // 100 < 0.28 * k]
    assert n
    rows = spark.createDataFrame([(k, 28 * k // 100) for k in n], "n long, k long")
    assert rows.where(F.col("k") >= L.part(0.28, F.col("n"))).count() == len(n)
    assert rows.where(F.col("k") - 1 >= L.part(0.28, F.col("n"))).count() == 0


def test_triplets_are_counted_not_made(spark, small):
    """A frame of some thousand candidates in many ranges; rows of one place make no triplet."""
    import random

    from pyspark.sql import functions as F

    from stillframe.operators.ranking import ordered_triplets

    small("join14_triplets", part="select * replace (p_partkey * 977 as p_partkey) from {} where p_partkey % 120 in (7, 31)")
    r = random.Random(5)
    rows = [(g, r.randrange(-40, 40), r.choice([1.0, 2.0, 3.5]), r.choice([1.0, 4.0])) for g in (1, 2) for _ in range(60)]
    want = {g: sum(a[2] * b[3] > c[2] for a in part for b in part if a[1] < b[1] for c in part if b[1] < c[1]) for g in (1, 2) for part in [[x for x in rows if x[0] == g]]}
    df = spark.createDataFrame(rows, "g long, o long, u double, v double")
    got = ordered_triplets(df, "g", "o", ["u"], ["v"], ["u"], lambda a, b, c: a * b > c, width=7)
    assert {x.g: x.n for x in got.collect()} == want
    assert got.where(F.col("n") > 0).count() == 2


def test_binomial_terms_by_logarithms(spark, small):
    """Every term of a large test, and a small one."""
    import math

    from pyspark.sql import functions as F

    from stillframe.operators.ranking import log_factorial

    got = spark.createDataFrame([(n,) for n in (0, 1, 5, 20, 21, 22, 1000, 3_000_000)], "n long").select("n", log_factorial(F.col("n")).alias("v"))
    for row in got.collect():
        assert math.isclose(row.v, math.lgamma(row.n + 1), rel_tol=1e-14, abs_tol=1e-14)
    ((discordant, p),) = small("agg35_mcnemar", events="select * replace (case when event_id < 18 then 2 else 3 end as value) from {} where event_id < 40")
    assert discordant == 40 and 0.6 < p < 0.7
    small("agg35_mcnemar", events="select * from {}")


def test_fourier_search_says_every_frame(small):
    """A row a frame, not two counts; and the maxima of a volume against all 27 neighbours."""
    import numpy as np

    from stillframe.kernels import fourier

    rows = small("krn16_fourier_search", lineitem="select * from {} where l_suppkey in (9, 11, 12, 24)")
    assert len(rows) == 4
    vol = np.random.default_rng(1).integers(0, 9, (16, 16, 16)).astype(float)
    p = np.pad(vol, 1, constant_values=-1)
    top = np.max([p[i : i + 16, j : j + 16, k : k + 16] for i, j, k in np.ndindex(3, 3, 3)], axis=0)
    v, h = fourier.maxima(vol, 1.0, 0.0, 0.05, 10_000)
    want = np.argwhere((vol == top) & (vol > 0.05 * vol.max())) - 8
    assert sorted(map(tuple, v)) == sorted(map(tuple, want))
    q = np.random.default_rng(2).normal(size=(40, 3)) / 50
    whole, _ = fourier.volume(q, 32)
    assert np.allclose(whole[1:, 1:, 1:], whole[1:, 1:, 1:][::-1, ::-1, ::-1])


def test_halved_axis_of_blurred_frames(small):
    """Peaks that the doubled cell meets by chance do not keep its axis doubled."""
    rows = small("krn07_primitive", lineitem="select * from {} where l_suppkey in (180, 697, 962)")
    assert len(rows) == 3


def test_seeds_of_dense_frames(small):
    """A frame ten times denser has its clusters' nodes too."""
    assert len(small("krn09_cluster_seeds", lineitem="select * from {} where l_suppkey % 17 in (0, 4)")) == 2


def test_points_on_an_edge_come_back_to_their_panel(small):
    """Projected points of panels' edges, rounded as the SQL rounds them."""
    small("prj03_project_q", lineitem="select * from {} where abs((l_extendedprice*3.1 + l_quantity*11.7) % 1100 - 512) < 1e-6 or abs((l_extendedprice*7.3) % 1100 - 512) < 1e-6")
