"""LM scoring, training order, SentencePiece codec and the pipeline."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(brute.edge_rows(), SCHEMA)
    return real.unionByName(odd).withColumns({n: F.lit(1) for n in ("chunk", "held", "ids", "slot", "words", "n_tokens")}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_lm_base_scores(docs, rows):
    from pyspark.sql import functions as F

    from stillframe.llm.lm_score import score

    tokens = [[*brute.WORD.findall(brute.lower(t or "")), None] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, tokens) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (d, _), ws in zip(rows, tokens))
    for chunk in (12 << 20, 50_000):
        out = score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, chunk_bytes=chunk).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
        assert {r.train_tokens for r in out} == {n} and all(r.score < 0 for r in out)
    assert score(docs.limit(0), F.lit(False)).count() == 0
    nothing = score(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.score == r.base_score for r in nothing)


def test_lm_states_by_brute_force(docs, rows):
    """Scores equal those of a tree of plain dictionaries, for any cutting into chunks."""
    from pyspark.sql import functions as F

    from stillframe.llm.lm_score import score

    want, states = brute.suffix_scores([t for _, t in rows], [held(d) for d, _ in rows])
    for chunk in (12 << 20, 50_000):
        out = score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, chunk_bytes=chunk).collect()
        assert {r.n_states for r in out} == {states} and states > 50
        got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in out)
        for g, w in zip(got, sorted((str(d), len(brute.WORD.findall(brute.lower(t or ""))) + 1, s) for (d, t), s in zip(rows, want))):
            assert g[:2] == w[:2] and abs(g[2] - w[2]) <= 1e-5 * abs(w[2])


def test_lm_helps_and_grows(spark):
    """On text with real dependence held-out text scores far better than the base, and more
    training text gives more states; each state's probabilities add up to one."""
    from pyspark.sql import functions as F

    from stillframe.llm import lm_score as M

    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(40)]
    step = (rng.dirichlet(np.full(40, 0.05), size=(1, 40)) + rng.dirichlet(np.full(40, 0.05), size=(40, 40))) / 2

    def text():
        a, b, out = 0, 0, []
        for _ in range(120):
            a, b = b, rng.choice(40, p=step[a, b])
            out.append(words[b])
        return " ".join(out)

    table = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    few, many = (M.score(table.where(F.col("doc_id") < n), F.col("doc_id") % 5 == 1) for n in (30, 300))
    s = many.where("held_out").agg(F.avg(F.col("score") / F.col("n_tokens")).alias("s"), F.avg(F.col("base_score") / F.col("n_tokens")).alias("b")).first()
    assert s.s > s.b + 0.25
    assert many.first().n_states > 2 * few.first().n_states

    n, p = np.array([3.0, 1.0, 0.0, 0.0]), np.array([0.1, 0.2, 0.3, 0.4])
    assert abs(((n + M.KAPPA * p) / (n.sum() + M.KAPPA)).sum() - 1) < 1e-12
    x = np.array([1e-6, 0.3, 1.0, 2.5, 7.9, 30.0, 1e6])
    assert np.allclose(M.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_packed_numbers():
    from stillframe.llm import common as M

    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.int64), np.array([0]), rng.integers(0, 300, 999), rng.integers(-5, 5, 10), rng.random(7).astype(np.float32)):
        assert (M.unpack(M.pack(a)) == a).all()
    keys = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert (M.unpack_sorted(M.pack_sorted(keys)) == keys).all()
    assert M.unbundle(M.bundle({"a": b"xy", "b": b""})) == {"a": b"xy", "b": b""}


def test_feistel_is_a_permutation():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from stillframe.llm.materialise import permute

    @settings(max_examples=60, deadline=None)
    @given(st.integers(1, 3000), st.integers(0, 2**70))
    def check(n, key):
        assert sorted(permute(np.arange(n), n, key)) == list(range(n))

    check()
    assert (permute(np.arange(1000), 1000, 1) != permute(np.arange(1000), 1000, 2)).any()


def test_training_order(spark, docs, rows, tmp_path):
    """Files equal those of a stream made in plain Python, for any partitioning; a reader goes on
    from any slot."""
    import public_tokenizers as P
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from stillframe.llm import materialise as M
    from stillframe.llm.common import row_key

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    order = docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.coalesce("text", F.lit("")))).collect()
    stream, firsts = [], []
    for r in sorted(order, key=lambda r: (r["_k1"], r["_k2"])):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        stream += ids
        firsts += [(r.doc_id, i) for i in range(len(ids))]
    n = -(-len(stream) // 64)
    want = np.zeros((n, 64), "<u2")
    slots = M.permute(np.arange(n), n, 5)
    for j, s in enumerate(slots):
        part = stream[64 * j : 64 * j + 64]
        want[s, : len(part)] = part
    files = None
    for k, table in enumerate((docs, docs.repartition(1), docs.repartition(7, "text"))):
        folder = str(tmp_path / f"shards{k}")
        shards = M.materialise(table, path, key=5, length=64, per_shard=32, folder=folder, range_rows=50)
        got = shards.orderBy("shard").collect()
        assert [r.first_slot for r in got] == list(range(0, n, 32)) and sum(r.n_slots for r in got) == n
        data = [open(f"{folder}/{r.file}", "rb").read() for r in got]
        assert b"".join(data) == want.tobytes() and [zlib.crc32(d) for d in data] == [r.crc32 for r in got]
        assert files in (None, data)
        files = data
        used = [x for r in got for x in r.n_ids]
        assert sorted(used)[1:] == [64] * (n - 1) and sum(used) == len(stream)
        where = [x for r in got for x in zip(r.first_doc, r.first_start)]
        assert all(where[s] == firsts[64 * j] for j, s in enumerate(slots))
    again = list(M.read_from(folder, 40, n, 128, 2, per_shard=32, most=7))
    assert [s for s, _ in again] == list(range(40, n)) and all((x == want[s]).all() for s, x in again)
    spread = M.read_shards(spark, shards, folder, 2, first=40).collect()
    assert sorted((r.slot, bytes(r.ids)) for r in spread) == [(s, want[s].tobytes()) for s in range(40, n)]
    assert M.materialise(docs.limit(0), path, key=5).count() == 0
    text_ids = M.materialise(docs.select(F.concat(F.lit("a.b/"), "doc_id").alias("doc id"), F.col("text").alias("the.text")), path, key=5, length=64, doc_id="doc id", text="the.text").collect()
    assert all(zlib.crc32(r.payload) == r.crc32 and len(r.payload) == r.n_bytes for r in text_ids) and {type(x) for r in text_ids for x in r.first_doc} <= {str, type(None)}


def _field(number, kind, payload):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | kind) + (varint(payload) if kind == 0 else varint(len(payload)) + payload if kind == 2 else payload)


def _fields(data):
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, 0, varint()
        elif tag & 7 == 5:
            yield tag >> 3, 5, data[i : i + 4]
            i += 4
        elif tag & 7 == 1:
            yield tag >> 3, 1, data[i : i + 8]
            i += 8
        else:
            n = varint()
            yield tag >> 3, 2, data[i : i + n]
            i += n


def as_unigram(path, scores):
    """The model file with other scores and the unigram type, for the library to read."""
    import struct

    out, i = b"", 0
    for number, kind, payload in _fields(open(path, "rb").read()):
        if number == 1:
            parts = b"".join(_field(n, k, p) for n, k, p in _fields(payload) if n != 2)
            payload = parts + _field(2, 5, struct.pack("<f", scores.get(i, 0.0)))
            i += 1
        elif number == 2:
            payload = b"".join(_field(n, k, p) for n, k, p in _fields(payload) if n != 3) + _field(3, 0, 1)
        out += _field(number, kind, payload)
    return out


def test_viterbi_equals_the_library_on_a_unigram_model(rows):
    import public_tokenizers as P
    import sentencepiece

    from stillframe.llm import viterbi as V

    path = P.path("piece_bpe_32k.model")
    c = V.Codec(path)
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(path, c.v.scores))
    texts = ["Hello world, this is a test.", "déjà vu naïve", "日本語のテキスト", "a  b   c", "😀 mixed\ttabs\nlines", "x" * 300, "  leading", "trailing  ", "12345 67.89", "ﬁ Ⅻ"]
    texts += [t[:600] for _, t in rows if t][:60]
    for t in texts:
        ours = np.frombuffer(c.encode(t), "<u4").tolist()
        theirs = library.encode(t)
        value = lambda ids: sum(c.v.scores.get(i, 0.0) for i in ids)
        assert ours == theirs or abs(value(ours) - value(theirs)) < 1e-3 * max(1, len(t)), t


def test_stream_commits_early_and_finds_the_best_path():
    import random

    from stillframe.llm import viterbi as V

    class Toy(V.Vocabulary):
        def __init__(self, scores):
            self.scores = dict(enumerate(scores.values()))
            self.unknown, self.unknown_score, self.bytes = 99, -30.0, {}
            self.longest = max(map(len, scores))
            self.root = [{}, None]
            for i, (p, s) in enumerate(scores.items()):
                node = self.root
                for ch in p:
                    node = node[0].setdefault(ch, [{}, None])
                node[1] = (i, s)

    pieces = {"a": -3.0, "b": -3.1, "ab": -4.0, "aba": -5.5, "bab": -5.2, "aa": -4.9, "abab": -7.7}
    v, names = Toy(pieces), list(pieces)
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 700)))
        best = [0.0] + [-1e18] * len(t)
        for i in range(len(t)):
            single = False
            for p, s in pieces.items():
                if t.startswith(p, i):
                    best[i + len(p)] = max(best[i + len(p)], best[i] + s)
                    single = single or len(p) == 1
            if not single:
                best[i + 1] = max(best[i + 1], best[i] - 30.0)
        runs = list(V.stream(v, t))
        ids = [x for r in runs for x in r]
        assert "".join(names[i] if i != 99 else "c" for i in ids) == t
        assert abs(sum(v.scores.get(i, -30.0) for i in ids) - best[-1]) < 1e-9
        assert len(runs) > 1 or len(t) < 300


def test_codec_round_trip(spark, docs, rows):
    import public_tokenizers as P

    from stillframe.llm import viterbi as V

    path = P.path("piece_bpe_32k.model")
    out = V.round_trip(docs, path).collect()
    assert len(out) == len(rows) and all(r.exact and r.n_unknown == 0 for r in out)
    some = V.encode(docs.where("doc_id in (900005, 900010, 900012)"), path)
    text = {r.doc_id: r.text for r in V.decode(some, path).collect()}
    assert text[900010].startswith("😀😀 +1 (552)")
    assert V.encode(docs.limit(0), path).count() == 0


def test_pipeline_by_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = C.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    base = {r.doc_id: brute.quality_base(r.text)[-1] for r in docs.collect()}
    assert not any(base[i] for i in ids)
    good = [i for i, r in labels.items() if r.quality == 1 and not base[i]]
    assert sum(i in ids for i in good) >= 0.98 * len(good)
    one = C.near_duplicates(spark, kept, sf).cache()
    rows = kept.collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (brute.WORD.findall(brute.lower(r.text or "")) for r in rows)]
    met = Counter()
    where = {}
    for i, x in enumerate(sets):
        for sh in x:
            where.setdefault(sh, []).append(i)
    for v in where.values():
        met.update((a, b) for a in v for b in v if a < b)
    alike = {p: n / len(sets[p[0]] | sets[p[1]]) for p, n in met.items()}
    left = {r.doc_id for r in one.select("doc_id").collect()}
    group = brute.roots(len(rows), [p for p, s in alike.items() if s >= 0.8])
    n_left = Counter()
    for r, g in zip(rows, group):
        n_left[g] += r.doc_id in left
    assert set(n_left.values()) == {1}
    least = {i: i for i in left}
    clean = C.personal_data(spark, one, sf)
    assert clean.columns == docs.columns
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert not brute.pii(r.text)
        assert r.n_chars == len(r.text)
        if not brute.pii(before[r.doc_id]):
            assert r.text == before[r.doc_id]
    packed = C.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(least.values())


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, extra columns of clashing names, and an empty table."""
    import corpus_pipeline as C
    from pyspark.sql import functions as F

    good = " ".join(f"word{i}" for i in range(40)) + " call me at a@b.org"
    rows = [*brute.edge_rows(), (1, good, "en", "s"), (1, good, "en", "s"), (None, good + " more", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({n: F.lit(1) for n in ("_k1", "length", "start", "sequence_id", "spans", "_q_n_words")})
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = C.run(spark, folder).collect()
        kept = [r for r in rows if not brute.quality_base(r[1])[-1]] if name == "odd" else []
        assert {r.doc_id for r in out} <= {r[0] for r in kept}
        assert (1 in {r.doc_id for r in out}) == (name == "odd")
        assert sum(r.doc_id == 1 and r.start == 0 for r in out) == (name == "odd")
