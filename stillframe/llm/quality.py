"""Quality rules: text statistics and a learned decision list over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillframe.llm.common import text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Integer statistics of a text, in the order in which ``statistics`` gives them.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_marks"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found twice or more.

    Equal windows are found exactly: windows of 2, 4, 8 words are numbered by the
    pair of numbers of their halves.
    """
    n = len(words)
    if n <= window:
        return 0
    ids = np.fromiter(map({}.setdefault, words, range(n)), dtype=np.int64, count=n)
    size = 1
    while True:
        pair = ids[:-size] * n + ids[size:]
        size *= 2
        _, ids, times = np.unique(pair, return_inverse=True, return_counts=True)
        if len(times) == len(pair):
            return 0
        if size == window:
            break
    hit = np.flatnonzero(times[ids] > 1)
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(set(words)),
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".,;:!?")),
    )


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "_q_") -> DataFrame:
    """``keep`` columns of ``df`` (all by default) and the statistics of its texts, named
    ``prefix`` + name.  Null texts have none of anything.  Map-only."""
    keep = df.columns if keep is None else keep
    plain = df.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(F.col(f"`{text}`")).alias(f"{prefix}text"))
    schema = plain.drop(f"{prefix}text").schema
    for c in COUNTS:
        schema = schema.add(f"{prefix}{c}", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, *(prefix + c for c in COUNTS)]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = [statistics(texts[i].as_py()) for i in range(len(texts))]
            cols = zip(*rows) if rows else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(c, pa.int64()) for c in cols], names=names
            )

    return plain.mapInArrow(run, schema)


def base_failed(prefix: str = "_q_") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


def features(prefix: str = "_q_") -> dict[str, Column]:
    """Ratios that rules test: never null."""
    c = {k: F.col(prefix + k).cast("double") for k in COUNTS}

    def per(a: str, b: str) -> Column:
        return c[a] / F.greatest(c[b], F.lit(1.0))

    return {
        "words": c["n_words"],
        "mean_word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "distinct_share": per("n_distinct_words", "n_words"),
        "digits_per_char": per("n_digits", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is lower bound, threshold), and what it covered in training."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    hits: int

    def expression(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, lower, bound in self.conditions:
            out = out & (values[name] >= bound if lower else values[name] <= bound)
        return out


def _covers(rule: list, x: np.ndarray, names: list[str]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for name, lower, bound in rule:
        column = x[:, names.index(name)]
        ok &= column >= bound if lower else column <= bound
    return ok


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], fold: np.ndarray, most_rules: int = 24, most_conditions: int = 4, precision: float = 0.97, least: int = 5) -> list[Rule]:
    """Sequential covering: an ordered list of conjunctions that cover the ``bad`` rows.

    A rule is grown on the rows of ``fold`` by the condition of the largest FOIL gain
    until it covers bad rows only or nothing gains; then its last conditions are pruned
    while that does not lower (p + 1) / (p + n + 2) on the other rows.  It stays if at
    least ``least`` bad rows and a share of ``precision`` are right on either part;
    what it covers is removed and the next rule is grown.  Else the bad rows it grew on are
    set aside, so that other kinds of bad rows get their rules.  All edges are tried.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    given_up = np.zeros(len(x), dtype=bool)
    order = [np.argsort(x[:, k], kind="stable") for k in range(x.shape[1])]
    while len(rules) < most_rules:
        grow, prune = left & fold & ~given_up, left & ~fold & ~given_up
        if not (grow & bad).any():
            break
        rule: list[tuple[str, bool, float]] = []
        inside = grow.copy()
        while len(rule) < most_conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best = (0.0, None)
            for k, name in enumerate(names):
                o = order[k][inside[order[k]]]
                v, up = x[o, k], np.cumsum(bad[o])
                seen = np.arange(1, len(v) + 1)
                edge = np.flatnonzero(v[1:] > v[:-1])
                for lower, p, n in ((False, up[edge], seen[edge]), (True, up[-1] - up[edge], len(v) - seen[edge])):
                    e = np.flatnonzero(p >= least)
                    if not len(e):
                        continue
                    gain = p[e] * (np.log2(p[e] / n[e]) - np.log2(p0 / (p0 + n0)))
                    top = int(np.argmax(gain))
                    if gain[top] > best[0] + 1e-9:
                        at = edge[e[top]]
                        best = (gain[top], (name, lower, float((v[at] + v[at + 1]) / 2)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= _covers(rule[-1:], x, names)

        grown = list(rule)

        def worth(r: list) -> float:
            hit = prune & _covers(r, x, names)
            return ((hit & bad).sum() + 1) / (hit.sum() + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = left & _covers(rule, x, names)
        right = [(hit & part & bad).sum() / max(1, (hit & part).sum()) for part in (fold, ~fold)]
        if not rule:
            break
        if (hit & bad).sum() < least or right[0] < precision or ((hit & ~fold).any() and right[1] < precision):
            given_up |= left & bad & _covers(grown, x, names)
            continue
        rules.append(Rule(tuple(rule), int(hit.sum()), int((hit & bad).sum())))
        left &= ~hit
    return rules


#: Labelled documents that the rules are learned from, at most: those of the smallest id hashes.
SAMPLE = 20_000


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules that reject what ``labels`` (doc_id, label 0/1) calls bad (0).

    Learned from a bounded sample: ``sample`` labelled ids of the smallest hashes.  Ids
    with null or differing labels are left out; no labels or one class give no rules.
    The list has at most ``most_rules`` rules of ``most_conditions`` conditions, see
    ``learn_rules``.
    """
    spark = df.sparkSession
    chosen = (
        labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).where("_label is not null and _id is not null")
        .groupBy("_id").agg(F.min("_label").alias("_low"), F.max("_label").alias("_high")).where("_low = _high")
        .orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", "_low")
    )
    picked = F.broadcast(spark.createDataFrame(chosen.collect(), chosen.schema))  # `sample` rows
    texts = df.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(picked, "_id")
    stats = with_statistics(texts, "_text", ["_id", "_low"]).where(~base_failed())
    values = features()
    rows = (
        stats.groupBy("_id").agg(F.first("_low").alias("_low"), F.min(F.struct(*(v.alias(k) for k, v in values.items()))).alias("v"))
        .select("_id", "_low", "v.*", (F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(3)) > 0).alias("_grow")).orderBy("_id").collect()
    )
    if not rows:
        return []
    x = np.array([[r[k] for k in values] for r in rows], dtype=float)
    return learn_rules(x, np.array([r["_low"] == 0 for r in rows]), list(values), np.array([r["_grow"] for r in rows]))


def verdict(rules: list[Rule], prefix: str = "_q_") -> Column:
    """True for documents to keep: base failures go, then the first rule that holds
    rejects, and what no rule covers stays."""
    values = features(prefix)
    out = F.when(base_failed(prefix), F.lit(False))
    for rule in rules:
        out = out.when(rule.expression(values), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(df: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, the base statistics, base_failed and kept.

    A null or empty text has no words and so fails the base rule.  Repeated rows are
    judged alike, each by itself; an empty table gives an empty one.
    """
    stats = with_statistics(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select("doc_id", *(F.col(f"_q_{n}").alias(n) for n in names), base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns.  Null and empty texts fail the base
    rule; repeated rows stay or go together; an empty table gives an empty one."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # own names cannot clash
    kept = with_statistics(plain, f"c{df.columns.index(text)}").where(verdict(rules))
    return kept.select(*plain.columns).toDF(*df.columns)
