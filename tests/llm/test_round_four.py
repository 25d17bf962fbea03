"""What a step leaves on disk."""

import time

import numpy as np
from pyspark.sql import functions as F


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") and files.apply(i).getName().endswith(".data") for i in range(files.size()))


def test_shuffles_go_with_their_query(spark):
    """op1's shuffles stayed on disk until the driver's memory was collected."""
    from stillframe.llm.common import checkpoint, shuffles_go

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name, None), shuffle_files(spark)
    with shuffles_go(spark):
        got = checkpoint(spark.range(50_000).repartition(3, "id").groupBy((F.col("id") % 1000).alias("k")).count())
    assert spark.conf.get(name, None) == was
    for _ in range(50):  # they are deleted behind the query's back
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert got.count() == 1000 and got.where("count = 50").count() == 1000


def test_keys_of_a_bucket_are_quotients():
    """What the buckets share of a key is not sent; sums and answers are those of whole keys."""
    from stillframe.llm import lm_score as M

    rng, buckets = np.random.default_rng(3), 97
    pool = np.unique(rng.integers(0, 1 << 52, 4000, dtype=np.uint64))
    chunks = [np.sort(rng.choice(pool, 2500, replace=False)) for _ in range(3)]
    counts = [rng.integers(0, 5, 2500) for _ in chunks]
    notes = M.pa.concat_tables([M.requests(i, buckets, k, n) for i, (k, n) in enumerate(zip(chunks, counts))])
    longest = max(int(M.unpack_sorted(x).max()) for x in notes["a"].to_pylist())
    assert longest <= int(pool.max()) // buckets
    told = M.pa.concat_tables([M.add_grams(notes.filter(M.pc.equal(notes["bucket"], b))) for b in sorted(set(notes["bucket"].to_pylist()))])
    for i, keys in enumerate(chunks):
        got = M.answers(told.filter(M.pc.equal(told["chunk"], i)), keys, buckets)
        want = [sum(int(n[np.searchsorted(k, x)]) for k, n in zip(chunks, counts) if x in set(k.tolist())) for x in keys[:60]]
        assert got[:60].tolist() == want


def test_scores_reach_their_own_threshold():
    """A kind's threshold is one of its scores as a probability; rounding kept that score below it."""
    from stillframe.llm.pii import least_logit

    scores = np.r_[np.linspace(-6, 27, 5000), 5.549076034703404, 40.0]
    bounds = np.array([least_logit(float(p)) for p in 1 / (1 + np.exp(-scores))])
    assert (bounds <= scores).all() and (scores - bounds)[scores < 20].max() < 1e-6
