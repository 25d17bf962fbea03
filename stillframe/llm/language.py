"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillframe.llm.common import checkpoint, text_or_empty
from stillframe.llm.vectors import merge, partition_vectors

#: Buckets that n-grams are hashed into, as a power of two.
BITS = 16
#: Longest n-gram.
ORDER = 3
#: Labelled documents that the classifier is fitted to, shared evenly by the languages; no more
#: languages than this are learned.  Document frequencies cover all documents to learn from.
SAMPLE = 2000
#: Code points of a text that are looked at together.
PIECE = 1 << 18
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """The pattern also finds number signs, which are no letters."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str, bits: int = BITS, order: int = ORDER, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's character n-grams of 1 to ``order``, in lower case; every run
    of other characters than letters is one blank.  A long text is taken in pieces, each
    behind the last characters of the one before, so memory stays bounded."""
    total = np.zeros(1 << bits, dtype=np.int64)
    tail = np.array([32], dtype=np.uint32)
    for at in range(0, len(text), piece):
        codes = np.frombuffer(text[at : at + piece].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.r_[tail, np.where(_alphabetic()[codes], codes, 32).astype(np.uint32)]
        fresh = np.ones(len(codes), dtype=bool)
        fresh[len(tail) :] = (codes[len(tail) :] != 32) | (codes[len(tail) - 1 : -1] != 32)
        codes, old = codes[fresh], len(tail)
        h = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, order + 1):
            # grams that end behind the tail
            h = (h[: len(codes) - n + 1] if n == 1 else h[:-1]) * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            if len(h) == 0:
                break
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
            total += np.bincount(mixed[max(0, old - n + 1) :], minlength=len(total))
        tail = codes[-(order - 1) :] if order > 1 else codes[-1:]
    at = np.flatnonzero(total)
    return at, total[at]


def weights_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text's grams, of length 1: TF grows as the logarithm of the count."""
    x = (1 + np.log(counts)) * idf
    return x / np.sqrt((x * x).sum())


def document_frequencies(df: DataFrame, text: str = "text", bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts each bucket has a gram, and how many texts there are: over the whole table."""
    size = 1 << bits

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for x in batch.column(0):
            total[gram_counts(x.as_py(), bits)[0]] += 1
            total[size] += 1

    texts = df.select(text_or_empty(F.col(f"`{text}`")))
    total = merge(partition_vectors(texts, add, size + 1), size + 1)
    return total[:size], int(total[size])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weights_of(counts, self.idf[at]) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its calibrated probability; of a text without a letter ``und`` and 0."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*gram_counts(text, int(np.log2(len(self.idf))))) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 5, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size, classes) and bias of softmax regression on sparse rows (indices, values).

    Follow-the-regularised-leader by coordinate: sums of gradients ``z`` and of their squares
    ``n`` give each weight in closed form as its row comes up; a weight whose ``z`` stays
    within ``l1`` is exactly 0, ``l2`` shrinks the others.  The bias has no penalty.
    """
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    penalty1, penalty2 = np.full((size + 1, 1), l1), np.full((size + 1, 1), l2)
    penalty1[size] = penalty2[size] = 0

    def leader(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty1[at], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + penalty2[at])

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.r_[rows[i][0], size], np.r_[rows[i][1], 1.0]
            w = leader(at)
            p = softmax(x @ w)
            p[label[i]] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = leader(np.arange(size + 1))
    return w[:size], w[size]


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """What logits are divided by for the least log loss on held rows, by golden section.

    As many rows as there are leave room for one more that is of another class: each has
    that small share of the others', so rows that are all right don't ask for certainty.
    """
    share = 1.0 / (len(logits) + 2)

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        top = s.max(axis=1)
        each = top[:, None] + np.log(np.exp(s - top[:, None]).sum(axis=1))[:, None] - s
        own = each[np.arange(len(s)), label]
        others = (each.sum(axis=1) - own) / max(1, s.shape[1] - 1)
        return float(((1 - share) * own + share * others).mean())

    low, high, cut = -4.0, 3.0, (5**0.5 - 1) / 2
    if not len(logits):
        return 1.0
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sample(df: DataFrame, label: str, doc_id: str, text: str, most: int = SAMPLE) -> DataFrame:
    """(_lang, _h, _text): at most ``most`` labelled rows, as many of each language as there are or
    its even share, by row hash.  Of equal rows one is taken.

    Hashes below a threshold of 1.5 shares are kept first, so no task sorts more of a language
    than that.
    """
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{label}`").alias("_lang"), F.xxhash64(F.lit(12), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("_h"), text_or_empty(F.col(f"`{text}`")).alias("_text")
    )
    langs = rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(most)
    langs = checkpoint(langs)
    share = max(1, most // max(1, langs.count()))
    limits = langs.select("_lang", F.least(F.lit(1.0), (1.5 * share + 20) / F.col("n")).alias("_most"))
    near = rows.join(F.broadcast(limits), "_lang").where(F.pmod("_h", F.lit(1 << 40)) < F.col("_most") * float(1 << 40))  # `most` rows at most
    order = Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 40)), "_h")
    picked = near.select("_lang", "_h").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= share)
    picked = checkpoint(picked.select("_lang", "_h"))
    return near.join(F.broadcast(picked), ["_lang", "_h"]).dropDuplicates(["_lang", "_h"]).select("_lang", "_h", "_text")


def fit(df: DataFrame, label: str = "lang", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE, bits: int = BITS) -> Model:
    """Learns the languages of the labelled rows of ``df``.

    Document frequencies come from all labelled texts.  The classifier is fitted on the
    driver to the grams (not the texts) of at most ``most`` of them; every fifth of these is held back
    for the temperature.  Ids only choose the sample.  Null texts are empty, equal rows
    count once in the sample; texts without letters teach nothing; a table without labels gives a model
    without languages, which answers ``und``.
    """
    learn = df.where(F.col(f"`{label}`").isNotNull())
    often, n = document_frequencies(learn, text, bits)
    idf = np.log((1.0 + n) / (1.0 + often)) + 1.0

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            got = [gram_counts(texts[i].as_py(), bits) if has_letter(texts[i].as_py()) else None for i in range(len(texts))]
            have = [i for i, x in enumerate(got) if x is not None]
            at = pa.array([got[i][0].astype("<u4").tobytes() for i in have], pa.binary())
            times = pa.array([got[i][1].astype("<u4").tobytes() for i in have], pa.binary())
            index = pa.array(have, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), at, times], names=["_lang", "_h", "at", "times"])

    rows = sample(learn, label, doc_id, text, most).mapInArrow(counts, "_lang string, _h long, at binary, times binary").collect()
    rows = sorted(rows, key=lambda r: (r["_h"], r["_lang"]))
    langs = sorted({r["_lang"] for r in rows})
    grams = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["times"], "<u4")) for r in rows]
    sparse = [(at, weights_of(times, idf[at])) for at, times in grams]
    y = np.array([langs.index(r["_lang"]) for r in rows], dtype=int)
    held = np.arange(len(rows)) % 5 == 4
    model = Model(langs, idf, *follow_the_leader([x for x, h in zip(sparse, held) if not h], y[~held], len(idf), max(1, len(langs))))
    if held.any():
        model.temperature = temperature(np.array([model.logits(*g) for g, h in zip(grams, held) if h]), y[held])
    return model


def identify(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score of every row, from the whole text alone.  Map-only."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    plain = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    schema = plain.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = [m.predict(texts[i].as_py()) for i in range(len(texts))]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *cols], names=[*keep, "lang_pred", "score"])

    return plain.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fourth of the ids that nothing is learned from; a null id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def with_language(df: DataFrame, label: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``df``: learned from the labelled rows
    that are not held out, applied to all.  Texts that are null or have no letter are ``und`` with
    score 0; equal texts get equal answers; an empty table gives an empty one."""
    model = fit(df.where(~held_out(F.col(f"`{doc_id}`"))), label, doc_id, text)
    found = identify(df, model, [doc_id], text)
    return found.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), "lang_pred", "score")
