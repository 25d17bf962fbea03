"""Filter audit, language identification and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([*brute.edge_rows(), (900050, "twin text " * 60, "en", "s8"), (900049, "twin text " * 60, "en", None), (900051, "twin text " * 60, "en", ""), (None, "twin text " * 60, "en", "s8")], SCHEMA)
    clash = ("_text", "_row", "n_chars", "mask", "part", "rank", "weight", "score", "_h", "at", "times", "n_features", "lang_pred", "_lang", "blocks")
    return real.unionByName(odd).withColumns({n: F.lit("x") for n in clash}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


# --- importance resampling ---------------------------------------------------------------

RUN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, most=2):
    words = RUN_WORD.findall(brute.lower(text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def resampled(rows, target, percent=25, least=20, seed=7, buckets=10_000, most=2):
    codes = lambda t: [zlib.crc32(x.encode()) % buckets for x in runs_of(t, most)[0]]
    s, t = Counter(c for r in rows for c in codes(r[1])), Counter(c for x in target for c in codes(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for doc_id, text, *_ in rows:
        c = codes(text)
        weight = sum(map(gain, c)) // len(c) if c else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = [o for o, r in zip(out, rows) if runs_of(r[1])[1] >= least]
    enough.sort(key=lambda o: (-o[3], o[0] is None, o[0] or 0, -o[2], -o[1]))
    for i, o in enumerate(enough[: percent * len(enough) // 100]):
        o[4] = i + 1
    return Counter(map(tuple, out))


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_resample(spark, docs, rows):
    from stillframe.llm.importance import resample

    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    assert got(resample(docs, target)) == resampled(rows, texts)
    assert got(resample(docs.select("doc_id", "text"), target.select("text"), percent=100, least_words=1, seed=3, buckets=50, run=3)) == resampled(rows, texts, 100, 1, 3, 50, 3)


def test_resample_empty(spark, docs):
    from stillframe.llm.importance import bucket_counts, resample

    assert resample(docs.limit(0), docs.limit(3)).count() == 0
    none = resample(docs, docs.where("false"))
    assert none.count() == docs.count() and none.where("rank is not null").count() > 0
    assert bucket_counts(docs.where("false")).sum() == 0


def test_equal_rows_are_spread(spark):
    """A third of all rows agree in everything: ranks are still 1, 2, 3... and no range holds them all."""
    from stillframe.llm.importance import ranked

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100).alias("score"))
    out = ranked(df.repartition(4), [F.col("score").desc(), F.col("doc_id")], 2000)
    by = sorted((r["rank"], -r.score, r.doc_id) for r in out.where("rank is not null").collect())
    assert [b[0] for b in by] == list(range(1, 2001)) and [b[1:] for b in by] == sorted(b[1:] for b in by)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1500


@pytest.mark.parametrize("run", [1, 2, 4])
def test_pieces_of_long_texts(run):
    from stillframe.llm.importance import feature_codes

    rng = random.Random(run)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", "7", " ", "  ", ".", "\n", "é", "ż", "-", "word", "x" * 9000 if rng.random() < 0.02 else "q"]) for _ in range(rng.randrange(60)))
        want = Counter(zlib.crc32(x.encode()) for x in runs_of(text, run)[0])
        for piece in (1, 3, 16, 1 << 20):
            assert Counter(int(c) for some in feature_codes(text.encode(), run, piece) for c in some) == want


# --- filter audit ------------------------------------------------------------------------


def masks(rows):
    ids = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            ids.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, _, source in rows:
        x = text or ""
        w = brute.WORD.findall(x)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in x) > 5 * len(x), any(c in "#$%&*|" for c in x), doc_id is not None and min(ids[x]) < doc_id)
        out.append((doc_id, source or "", sum(1 << i for i, f in enumerate(fails) if f)))
    return out


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    found = masks(rows)
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {m[1] for m in found}:
            rest = [m for m in found if m[1] == part]
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [m for m in rest if m[2] & bit]
                failing = sum(1 for m in found if m[1] == part and m[2] & bit)
                rest = [m for m in rest if not m[2] & bit]
                out[part, order, step] = [len(rest), len(gone), failing - len(gone), sum(1 for m in found if m[1] == part and m[2] == bit), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_masks(docs, rows):
    from stillframe.llm.audit import filter_masks

    want = Counter(masks(rows))
    bag = lambda df: Counter(tuple(r) for r in df.select("doc_id", "part", "mask").collect())
    assert bag(filter_masks(docs)) == want
    # a key that many texts share: only the comparison of the texts tells them apart
    assert bag(filter_masks(docs, key=lambda t: (F.length(t) % 3).cast("long"))) == want
    assert bag(filter_masks(docs, key=lambda t: F.length(F.regexp_replace(t, "[^a]", "")).cast("long"))) == want


def test_audit(spark, docs, rows):
    from stillframe.llm.audit import audit

    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    labels += [(900050, 1, 0), (900050, 0, 1), (900051, None, 1), (None, 1, 1), (900002, 1, 1), (123456789, 1, 1)]
    out = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in out.collect()} == audited(rows, labels)


def test_audit_of_equal_blocks(spark):
    """Texts that agree in length and in all blocks but the last, and a large group of copies."""
    from stillframe.llm.audit import filter_masks

    long = "abc def " * 1000
    texts = [long + "x", long + "y", long + "x", "z" + long] + ["copy"] * 300 + [""] * 50 + [None] * 5
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: bool(r["mask"] & 16) for r in filter_masks(df).collect()}
    assert [i for i, e in sorted(got.items()) if not e] == [0, 1, 3, 4, 304]


def test_audit_empty(docs):
    from stillframe.llm.audit import audit

    assert audit(docs.limit(0), docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).count() == 0


def test_words_in_pieces():
    from stillframe.llm.audit import block_hashes, word_counts

    data = ("one two\tone  three\n" * 50 + "x" * 200 + " two").encode()
    assert {word_counts(data, p) for p in (1, 7, 64, 1 << 20)} == {(202, 4)}
    assert len(block_hashes(data)) == 2 and block_hashes(b"") == [] and block_hashes(data) != block_hashes(data + b" ")


# --- language identification -------------------------------------------------------------


def test_language(spark, docs, rows):
    from stillframe.llm.language import with_language

    out = with_language(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r for r in rows}
    right, n = 0, 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        _, t, lang, _ = text[r.doc_id]
        if r.doc_id is None:
            continue
        assert (r.lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
        if r.held_out and r.doc_id < 900000:
            right, n = right + (r.lang_pred == lang), n + 1
    assert n > 30 and right / n >= 0.97
    equal = {}
    for r in got:
        if r.doc_id is not None:
            equal.setdefault(text[r.doc_id][1], set()).add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in equal.values())


def test_language_without_labels(spark, docs):
    from stillframe.llm.language import with_language

    assert with_language(docs.limit(0)).count() == 0
    out = with_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in out.collect()} == {("und", 0.0)}
    one = with_language(docs.withColumn("lang", F.lit("la")))
    assert {r.lang_pred for r in one.collect()} == {"und", "la"}


def test_gram_pieces():
    from stillframe.llm.language import gram_counts, has_letter

    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice(["a", "É", "ß", " ", "  ", "1", ".", "日", "😀", "n", "\n"]) for _ in range(rng.randrange(40)))
        whole = gram_counts(text)
        for piece in (1, 2, 3, 7):
            part = gram_counts(text, piece=piece)
            assert all(np.array_equal(a, b) for a, b in zip(whole, part))
        spelled = " " + "".join(c if c.isalpha() else " " for c in text.lower())
        spelled = re.sub(" +", " ", spelled)
        n = len(spelled)
        assert whole[1].sum() == (n - 1) + (n - 1) + max(0, n - 2)
    assert not has_letter("12 ² Ⅻ _ ...") and has_letter("... é")


def test_follow_the_leader_is_sparse_and_calibrated():
    from stillframe.llm.language import follow_the_leader, softmax, temperature

    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 600)
    rows = []
    for k in y:  # three telling features a class, and noise among 200
        at = np.unique(np.r_[rng.choice(np.arange(3 * k, 3 * k + 3), 2), rng.integers(9, 200, 6)])
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
    w, b = follow_the_leader(rows, y, 200, 3, l1=2.0)
    assert (w[9:] == 0).mean() > 0.8 and (w[:9] != 0).any(axis=1).all()
    z = np.array([x @ w[at] + b for at, x in rows])
    assert (z.argmax(axis=1) == y).mean() > 0.97
    noisy = np.where(rng.random(600) < 0.2, rng.integers(0, 3, 600), y)
    t = temperature(10 * z, noisy)
    p = softmax(10 * z / t)
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == noisy).mean()) < 0.05
    assert temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0
