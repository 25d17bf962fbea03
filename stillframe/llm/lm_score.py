"""Language-model scores by a probabilistic suffix tree over words, kept as tables.

The tree's contexts are the last 1, 2, ... words of a text (and its start).  A context of
one length is a state if it was seen twice or more in training and the words that follow
it diverge from what its longest suffix foretells; only states are made longer, so the
test ends the growth and the depth follows the data.  A state's distribution is smoothed
by its suffix's, and a token is scored in the longest state before it.

Nothing of the tree is on the driver.  Documents are tokenized once into chunks of a few
MB of text, whose numbers are files in the shared folder.  Chunks ask for sums: each sends
its distinct keys (words, then hashes of a context and the next word, then hashes of
contexts) with its own numbers to the keys' buckets, which add up over all chunks and
send the sums back to those that asked.  So a key that every chunk has is one entry per
chunk, packed in columns of numbers, and no group of rows is longer than the number of
chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillframe.llm.common import Files, bundle, checkpoint, pack, pack_sorted, row_key, shuffles_go, shared_folder, shuffle_parts, text_or_empty, unbundle, unpack, unpack_sorted

#: Text bytes of a chunk of documents.
CHUNK_BYTES = 12 << 20
#: Keys (words, grams or contexts, counted for each chunk) that one bucket adds up, about.
BUCKET_KEYS = 2_000_000
#: Weight of the suffix's distribution in a state's, in observations.
KAPPA = 5.0
#: A state's own distribution must foretell its training words this many times better than its
#: suffix's, the odds of a Dirichlet prior of that mean and weight KAPPA, which is a divergence
#: test that holds for few observations too.
ODDS = 1000.0
#: ... and by this many nats an occurrence at least, so that ever weaker contexts do not become
#: states only because more text makes them certain.
DIVERGENCE = 0.5
#: Parts of a nat in which chunks say what they add to the log odds of a context: whole numbers, so
#: that sums do not depend on their order.
PARTS = 1024
#: Least training occurrences of a state.
LEAST = 2


@dataclass
class Tokens:
    """Words of some texts: codes into ``words`` with the end (the empty word) after each text."""

    words: pa.Array
    codes: np.ndarray
    firsts: np.ndarray
    text_of: np.ndarray


def tokenize(texts: pa.Array) -> Tokens:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    who = np.repeat(np.arange(len(sizes)), sizes)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, who = flat.filter(pa.array(full)), who[full]
    coded = pc.dictionary_encode(flat)
    n = len(sizes)
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""], pa.string())])
    codes = np.full(len(own) + n, len(words) - 1, dtype=np.int64)
    at = np.arange(len(own)) + who
    codes[at] = own
    per = np.bincount(who, minlength=n) + 1 if n else np.zeros(0, dtype=np.int64)
    firsts = np.r_[0, np.cumsum(per)[:-1]] if n else np.zeros(0, dtype=np.int64)
    return Tokens(words, codes, firsts.astype(np.int64), np.repeat(np.arange(n), per))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x243F6A8885A308D3)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers (Stirling's series from 8 on)."""
    x = np.array(x, dtype=float)
    less = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        less[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - less


def evidence(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What a next word seen ``n`` times, foretold as ``p``, adds to the log odds of a state."""
    out = np.where(n > 0, math.log(KAPPA), 0.0)
    often = np.flatnonzero(n > 1)
    times, p = n[often], p[often].astype(float)
    out[often] = log_gamma(times + KAPPA * p) - log_gamma(KAPPA * p) - times * np.log(p)
    return out


def log_odds(added: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of states with ``n`` occurrences from their next words' summed ``evidence``."""
    return added - log_gamma(n + KAPPA) + log_gamma(np.full(len(n), KAPPA))


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bucket of each in that order): keys by bucket, then by size."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, bucket[order]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else []
    for a, b in zip(edge, [*edge[1:], len(values)]):
        yield int(values[a]), int(a), int(b)


#: What chunks and buckets send each other: keys or words with numbers, and the answers.
NOTE = "chunk long, bucket long, a binary, b binary, c binary, total long, distinct long"
_FIELDS = [(n, {"long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in NOTE.split(", "))]


def notes(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])


def requests(chunk: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> pa.Table:
    """Notes that ask for the sums of ``values`` over all chunks, for distinct keys; a bucket's note holds
    its keys divided by the number of buckets."""
    order, bucket = in_buckets(keys, buckets)
    keys, values = keys[order], [v[order] for v in values]
    # a chunk that has nothing to ask asks for nothing, so that it stays in the round
    runs = list(_runs(bucket)) or [(0, 0, 0)]
    # keys of a bucket have the same remainder, so they are told apart by their quotients, which are shorter
    return notes([(chunk, b, pack_sorted(keys[i:j] // np.uint64(buckets)), *(pack(v[i:j]) for v in values), *[None] * (2 - len(values)), 0, 0) for b, i, j in runs])


def _same_bytes(cells: list[bytes]) -> tuple[pa.Array, list[int]]:
    """Words of all cells (each word ends in a newline) as one array, and the cells' sizes."""
    data = b"".join(cells)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10).astype(np.int64)
    n = [c.count(b"\n") for c in cells]
    flat = np.frombuffer(data, np.uint8)
    keep = flat[flat != 10].tobytes()
    edge = np.r_[0, ends + 1] - np.arange(len(ends) + 1)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(keep)]), n


def add_words(table: pa.Table) -> pa.Table:
    """Corpus counts for the words of one bucket, exact by the words' bytes; the last row
    has the bucket's sums."""
    chunks, cells = table.column("chunk").to_pylist(), [pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in table.column("a").to_pylist()]
    words, sizes = _same_bytes(cells)
    coded = pc.dictionary_encode(words)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.concatenate([unpack(x).astype(np.int64) for x in table.column("b").to_pylist()])
    sums = np.zeros(len(coded.dictionary), dtype=np.int64)
    np.add.at(sums, codes, n)
    each, edge, bucket = sums[codes], np.r_[0, np.cumsum(sizes)], table.column("bucket")[0].as_py()
    rows = [(c, bucket, pack(each[i:j]), None, None, 0, 0) for c, i, j in zip(chunks, edge, edge[1:])]
    return notes([*rows, (-1, bucket, None, None, None, int(sums.sum()), int((sums > 0).sum()))])


def _summed(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Chunks, their edges, the group of each entry, firsts and sorted values of a bucket's notes."""
    keys = [unpack_sorted(x) for x in table.column("a").to_pylist()]
    values = [np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in ("b", "c") if table.column(c).null_count < len(keys)]
    edge = np.r_[0, np.cumsum([len(k) for k in keys])]
    flat = np.concatenate(keys)
    del keys
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = np.r_[True, flat[1:] != flat[:-1]][: len(flat)]
    group = np.empty(len(flat), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return table.column("chunk").to_pylist(), edge, group, np.flatnonzero(new), [v[order] for v in values]


def add_grams(table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's grams, to every chunk that asked."""
    chunks, edge, group, firsts, (n,) = _summed(table)
    each = (np.add.reduceat(n.astype(np.int64), firsts) if len(n) else n)[group]
    bucket = table.column("bucket")[0].as_py()
    return notes([(c, bucket, pack(each[i:j]), None, None, 0, 0) for c, i, j in zip(chunks, edge, edge[1:])])


def add_contexts(table: pa.Table) -> pa.Table:
    """Training occurrences of a bucket's contexts that are states, zero for the others; the
    last row has the number of states."""
    chunks, edge, group, firsts, (n, added) = _summed(table)
    if len(n):
        n, added = np.add.reduceat(n.astype(np.int64), firsts), np.add.reduceat(added.astype(np.int64), firsts) / PARTS
    state = (n >= LEAST) & (log_odds(added, n) > np.maximum(math.log(ODDS), DIVERGENCE * n))
    each = np.where(state, n, 0)[group]
    bucket = table.column("bucket")[0].as_py()
    rows = [(c, bucket, pack(each[i:j]), None, None, 0, 0) for c, i, j in zip(chunks, edge, edge[1:])]
    return notes([*rows, (-1, bucket, None, None, None, int(state.sum()), 0)])


def answers(told: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers for a chunk's keys, in their order; ``told`` has a note a bucket."""
    out = np.zeros(len(keys), dtype=np.int64)
    got = [unpack(x).astype(np.int64) for x in told.sort_by("bucket").column("a").to_pylist()]
    if got:
        out[in_buckets(keys, buckets)[0]] = np.concatenate(got)
    return out


@dataclass
class Corpus:
    """What all chunks share: the folder of their files, buckets, bits of the keys of grams and
    contexts, training texts, and the sums of the words."""

    files: Files
    buckets: int
    bits: int
    starts: int
    total: int = 0
    distinct: int = 0


class Chunk:
    """A chunk's tokens, counts and, at one context length, its tokens in question."""

    def __init__(self, corpus: Corpus, number: int):
        self.corpus, self.number = corpus, number
        own = unbundle(corpus.files.get(f"tokens/{number}"))
        self.codes, self.hashes = unpack(own["codes"]).astype(np.int32), unpack(own["hashes"]).astype(np.uint64)
        sizes = unpack(own["sizes"]).astype(np.int64)
        self.firsts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        self.text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.held = unpack(own["held"]).astype(bool)
        self.train = ~self.held[self.text_of]
        self.ids = own["ids"]

    def take(self, level: int, told: pa.Table) -> None:
        """Takes the answers that come before contexts of length ``level`` are looked at: the
        counts of the words, or the states of the length before."""
        if level == 1:
            self.corpus.files.put(f"counts/{self.number}", pack(answers(told, self.hashes, self.corpus.buckets)))
        self.load()
        if level > 1:
            self.longer(level, told)

    def load(self) -> None:
        self.counts = unpack(self.corpus.files.get(f"counts/{self.number}")).astype(np.int64)
        self.base = (self.counts + 0.5) / (self.corpus.total + 0.5 * (self.corpus.distinct + 1))

    def contexts(self, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, which): distinct hashes of the ``level`` words before each token (the start
        counts as one) and the one of each token."""
        first = self.firsts[self.text_of[at]]
        if level == 1:  # as many as words
            n = len(self.hashes)
            before = np.where(at > first, self.codes[np.maximum(at - 1, 0)], n)
            used = np.flatnonzero(np.bincount(before, minlength=n + 1))
            place = np.zeros(n + 1, dtype=np.int64)
            place[used] = np.arange(len(used))
            return self._key(mix(_STEP + np.r_[self.hashes, _START][used])), place[before]
        h = np.full(len(at), np.uint64(level), dtype=np.uint64)
        for k in range(1, level + 1):
            inside = at - k >= first
            h = mix(h * _STEP + np.where(inside, self.hashes[self.codes[np.maximum(at - k, 0)]], _START))
        return np.unique(self._key(h), return_inverse=True)

    def _key(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.corpus.bits)

    def grams(self, at: np.ndarray, keys: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Keys of each token with its context."""
        return self._key(mix(mix(keys)[which] + self.hashes[self.codes[at]]))

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, their probability so far, sums of the logarithms of the others by text):
        tokens whose context of one word may be a state."""
        p = self.base[self.codes]
        before = np.r_[0, self.counts[self.codes[:-1]]]
        before[self.firsts] = self.corpus.starts
        out = before < LEAST
        return np.flatnonzero(~out), p[~out], np.bincount(self.text_of[out], np.log10(p[out]), len(self.firsts))

    def alive(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``first`` for contexts of any length, from the chunk's file."""
        if level == 1:
            return self.first()
        own = unbundle(self.corpus.files.get(f"alive{level}/{self.number}"))
        return np.cumsum(unpack(own["at"]).astype(np.int64)), unpack(own["p"]).astype(float), np.frombuffer(own["sums"])

    def longer(self, level: int, told: pa.Table) -> None:
        """The tokens whose context of length ``level`` - 1 is a state, with its probability."""
        at, p, sums = self.alive(level - 1)
        seen = unpack(self.corpus.files.get(f"seen{level - 1}/{self.number}")).astype(np.int64)
        keys, which = self.contexts(at, level - 1)
        times = answers(told, keys, self.corpus.buckets)[which]
        state = times > 0
        p = np.where(state, (seen + KAPPA * p) / (times + KAPPA), p)
        more = state & (at - level >= self.firsts[self.text_of[at]] - 1)
        # the longer context is the gram of the token before, where that was asked for; and if
        # its first word is too rare to be asked about, so is the context
        bound = np.full(len(self.codes), LEAST if level > 2 else 0)
        bound[at] = seen
        more &= bound[np.maximum(at - 1, 0)] >= LEAST
        sums = sums + np.bincount(self.text_of[at[~more]], np.log10(p[~more]), len(self.firsts))
        parts = {"at": pack(np.diff(at[more], prepend=0)), "p": pack(p[more].astype(np.float32)), "sums": sums.tobytes()}
        self.corpus.files.put(f"alive{level}/{self.number}", bundle(parts))

    def ask_grams(self, level: int) -> pa.Table:
        """Distinct grams of the tokens in question with their training counts."""
        at, _, _ = self.alive(level)
        both = np.sort(self.grams(at, *self.contexts(at, level)) << np.uint64(1) | self.train[at].astype(np.uint64))
        keys = both >> np.uint64(1)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        n = np.add.reduceat((both & np.uint64(1)).astype(np.int64), new) if len(new) else np.zeros(0, dtype=np.int64)
        return requests(self.number, self.corpus.buckets, keys[new], n)

    def ask_contexts(self, level: int, told: pa.Table) -> pa.Table:
        """Distinct contexts with their training counts and what their next words add to the
        log odds; the counts of the tokens' grams are kept."""
        at, p, _ = self.alive(level)
        contexts, which = self.contexts(at, level)
        keys, gram = np.unique(self.grams(at, contexts, which), return_inverse=True)
        n = answers(told, keys, self.corpus.buckets)
        foretold = np.zeros(len(keys))
        foretold[gram] = p
        each = (evidence(n, foretold) / np.maximum(n, 1))[gram]
        self.corpus.files.put(f"seen{level}/{self.number}", pack(n[gram]))
        train = self.train[at]
        times = np.bincount(which[train], minlength=len(contexts))
        added = np.rint(PARTS * np.bincount(which[train], each[train], len(contexts))).astype(np.int64)
        return requests(self.number, self.corpus.buckets, contexts, times, added)

    def scores(self, level: int) -> np.ndarray:
        """Sums by text when no token has a longer state."""
        at, p, sums = self.alive(level)
        return sums + np.bincount(self.text_of[at], np.log10(p), len(self.firsts))


def words_asked(files: Files, t: Tokens, held: np.ndarray, ids: bytes, chunk: int, buckets: int, bits: int) -> pa.Table:
    """Writes a chunk's tokens and gives its notes that ask for words."""
    import xxhash

    often = np.argsort(-np.bincount(t.codes, minlength=len(t.words)), kind="stable")
    rank = np.empty(len(often), dtype=np.int64)
    rank[often] = np.arange(len(often))
    words = t.words.take(pa.array(often))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words)) >> np.uint64(64 - bits)
    codes = rank[t.codes]
    sizes = np.diff(np.r_[t.firsts, len(codes)])
    files.put(f"tokens/{chunk}", bundle({"codes": pack(codes), "hashes": pack(hashes), "sizes": pack(sizes), "held": pack(held.astype(np.uint8)), "ids": ids}))
    n = np.bincount(codes[~held[t.text_of]], minlength=len(words))
    order, bucket = in_buckets(hashes, buckets)
    runs = list(_runs(bucket))
    lists = pa.ListArray.from_arrays(pa.array([0, *(j for _, _, j in runs)], pa.int32()), words.take(pa.array(order)))
    rows = []
    for (b, i, j), joined in zip(runs, pc.binary_join(lists, "\n").to_pylist()):
        data = (joined + "\n").encode()
        rows.append((chunk, b, len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True), pack(n[order[i:j]]), None, 0, 0))
    return notes(rows)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of rows of about ``most`` text bytes (column text); a longer text is its own."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, i
            size += int(n)
        if at < len(batch):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def score(df: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probabilities of the whole text and its end), n_states of the tree.

    The model learns from rows whose ``held_out`` is not true.  Null texts are empty (the
    end alone); rows may share ids and repeated rows are scored each; an empty table
    gives an empty one; other columns are not looked at.  If nothing is there to learn
    from, every token has the probability of an unknown one.

    Chunks are made of the rows of an input partition, sorted by hash, so that a task run
    again makes the same ones and writes the same files.  Answers to words and the states
    of each length are checkpointed, as are the scores, so lost executors cost one step;
    the files are deleted at the end.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count_if(~F.col("held"))).first()
    n_bytes, starts = size[0] or 0, size[1] or 0
    #: About a word in seven bytes, half of the pairs of words distinct in a chunk; a key is
    #: another one's too with a chance of about one in a million at most.
    buckets = max(shuffle_parts(spark), n_bytes // 14 // BUCKET_KEYS)
    parts = max(shuffle_parts(spark), n_bytes // chunk_bytes)
    bits = min(62, max(52, 20 + int(n_bytes // 8).bit_length()))
    files = Files(shared_folder(spark))
    corpus = Corpus(files, buckets, bits, starts)
    kind = df.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        for k, table in enumerate(_chunks(batches, chunk_bytes)):
            ids = pa.BufferOutputStream()
            column = table.select(["doc_id"])
            with pa.ipc.new_stream(ids, column.schema) as out:
                out.write_table(column)
            t = tokenize(table.column("text").combine_chunks())
            yield from words_asked(files, t, table.column("held").to_numpy(), ids.getvalue().to_pybytes(), first + k, buckets, bits).to_batches()

    placed = docs.withColumns(dict(zip(("_k1", "_k2"), row_key(F.col("doc_id"), F.col("text")))))
    placed = placed.sortWithinPartitions("_k1", "_k2", "held").select("doc_id", "held", "text")
    with shuffles_go(spark):
        told = checkpoint(placed.mapInArrow(cut, NOTE).groupBy("bucket").applyInArrow(add_words, NOTE))
    sums = told.where("chunk < 0").agg(F.sum("total"), F.sum("distinct")).first()
    corpus.total, corpus.distinct = sums[0] or 0, sums[1] or 0

    def asking(level: int):
        def grams(key, note):
            chunk = Chunk(corpus, key[0].as_py())
            chunk.take(level, note)
            return chunk.ask_grams(level)

        def contexts(key, note):
            chunk = Chunk(corpus, key[0].as_py())
            chunk.load()
            return chunk.ask_contexts(level, note)

        return grams, contexts

    def each(rows: DataFrame, key: str, work, schema: str = NOTE) -> DataFrame:
        # as many tasks as chunks: their notes are small but what they do with them is not
        return rows.repartition(parts, key).groupBy(key).applyInArrow(work, schema)

    level, n_states = 1, 0
    while n_bytes:
        grams, contexts = asking(level)
        with shuffles_go(spark):
            # the grams' shuffle is the largest, and gone before the next ones
            counted = checkpoint(each(each(told.where("chunk >= 0"), "chunk", grams), "bucket", add_grams))
            told = checkpoint(each(each(counted, "chunk", contexts), "bucket", add_contexts))
        found = told.where("chunk < 0").agg(F.sum("total")).first()[0] or 0
        for name in ("alive", "seen"):
            files.drop(f"{name}{level - 1}")
        n_states += found
        level += 1
        if not found:
            break

    def rate(key, note):
        c = Chunk(corpus, key[0].as_py())
        c.take(level, note)
        per_text = lambda x: np.add.reduceat(x, c.firsts)  # noqa: E731  each text has its end
        return pa.table({
            "doc_id": pa.ipc.open_stream(c.ids).read_all().column("doc_id"), "held_out": pa.array(c.held),
            "n_tokens": pa.array(per_text(np.ones(len(c.codes), dtype=np.int64))), "n_known": pa.array(per_text((c.counts > 0)[c.codes].astype(np.int64))),
            "base_score": pa.array(per_text(np.log10(c.base)[c.codes])), "score": pa.array(c.scores(level)),
        })

    out = checkpoint(each(told.where("chunk >= 0"), "chunk", rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    files.drop()
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.total).cast("long").alias("train_tokens"), "base_score", "score", F.lit(n_states).cast("long").alias("n_states"))
