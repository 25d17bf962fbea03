"""Near copies of the pipeline against all pairs by brute force, at exactly 0.8."""

import brute


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def check(spark, texts, **more):
    from stillframe.llm.simhash import keep_one

    sets = [shingle_set(t) for t in texts]
    roots = brute.roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    want = sorted({min(j for j, r in enumerate(roots) if r == g) for g in roots})
    got = keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_keep_one_finds_shortened_copies(spark):
    """A text of distinct words and its beginning, at similarities of 0.8 to 0.85."""
    texts = []
    for k in range(120):
        words = [f"word{k}x{i}" for i in range(104)]
        n = 100 * (80 + k % 6) // 100
        texts += [" ".join(words), " ".join(words[: n + 4])]
        assert 0.8 <= jaccard(*map(shingle_set, texts[-2:])) <= 0.85
    check(spark, texts)


def test_keep_one_decides_by_the_sets(spark):
    """Pairs just below the similarity stay, pairs of exactly it link; so in large groups."""
    texts = []
    for k in range(150):
        words = [f"word{k}x{i}" for i in range(104)]
        texts += [" ".join(words), " ".join(words[: (79 if k % 2 else 80) + 4])]
    family = [f"family{i}" for i in range(104)]
    texts += [" ".join([*family[:84], *(f"own{k}x{i}" for i in range(20))]) for k in range(30)]
    texts += [" ".join(family[: 104 - k]) for k in range(30)]
    check(spark, texts)
    check(spark, texts, heavy=4)


def test_keep_one_on_documents(spark):
    """All test documents of one size against all pairs: the same rows stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [r.text or "" for r in sorted(table, key=lambda r: r.doc_id)])


def test_hot_fingerprints(spark, monkeypatch):
    from pyspark.sql import functions as F

    from stillframe.llm import simhash as S

    rows = [(i, None if i % 3 else "") for i in range(60)] + [(100 + i, f"some words of text {i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, S.near_duplicates(docs).collect()))
    monkeypatch.setattr(S, "HOT_ROWS", 5)
    assert sorted(map(tuple, S.near_duplicates(docs).collect())) == want
    assert S.near_duplicates(docs.where(F.col("doc_id") < 60)).agg(F.max("component_id")).first()[0] == 0


def test_keep_one_goes_by_simhash(spark, monkeypatch):
    """Fingerprints bring long near copies together by themselves, without a band of min-hashes."""
    from stillframe.llm import simhash as S

    monkeypatch.setattr(S, "sketch_links", lambda nodes, *_: nodes.select(*(nodes["node"].alias(c) for c in "ab")).limit(0))
    words = [f"word{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:1999], "other"]), "something else of six words or more"]
    rows = S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows) == [0, 2]
