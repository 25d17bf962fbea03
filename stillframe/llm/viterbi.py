"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation under a file's piece scores, found with a window: states older
than the longest piece take no part in later steps, and as soon as all surviving
backpointer paths pass one boundary, the ids before it are given out and forgotten.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillframe.llm import tokens
from stillframe.llm.common import text_or_empty

SPACE = "▁"
#: What an unknown character's score lies below the least piece score (fixed value).
UNKNOWN_PENALTY = 10.0
#: Segments whose ids a worker remembers, at most.
MEMO = 600_000
#: Positions without a certain boundary after which paths are followed back to find one.
LOOK_BACK = 256
#: Characters that a run of ids has at least, unless the text ends: less is not worth a step.
LEAST_RUN = 32


class Vocabulary:
    """Pieces and scores of a .model file.

    Scores of unigram files are their log probabilities.  BPE files have ranks instead
    (0, -1, -2, ...); for those a piece of rank r has the score -log(r + 2), a
    Zipf-like log probability.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        raw = {i: model.get_score(i) for i in plain}
        ranks = all(s <= 0 and s == int(s) for s in raw.values()) and len(set(raw.values())) > 1
        score = {i: -math.log(2.0 - s) if ranks else s for i, s in raw.items()}
        self.scores = score
        #: Where the scores come from; ids found with scores from ranks are this operator's own
        #: segmentation, not the library's for that file.
        self.kind = "ranks" if ranks else "unigram"
        self.unknown = model.unk_id()
        self.unknown_score = min(score.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {b: i for b in range(256) for i in [model.piece_to_id(f"<0x{b:02X}>")] if i != self.unknown and model.is_byte(i)}
        pieces = {model.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, pieces), default=1)
        #: Whether blanks stand only in front of pieces, so that the place before a blank
        #: that follows another character is a boundary of every segmentation.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        #: A trie: the next nodes by character, and the id and score of the piece that ends here.
        self.root: list = [{}, None]
        for piece, i in pieces.items():
            node = self.root
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = (i, score[i])

    def normalize(self, text: str) -> str:
        """The library's normal form, blanks as their symbol, with the leading one."""
        return self.model.normalize(text).replace(" ", SPACE)

    def unknown_ids(self, character: str) -> list[int]:
        data = character.encode()
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unknown]


def stream(v: Vocabulary, text: str) -> Iterator[list[int]]:
    """Ids of a normal form, in runs that are final when they are given out.

    Ties go to the path found first (the piece that starts earliest).  An empty text has no runs.
    """
    n = len(text)
    best: dict[int, float] = {0: 0.0}
    back: dict[int, tuple[int, int]] = {}
    done = reach = 0

    def commit(to: int) -> list[int]:
        nonlocal done
        out: list[list[int]] = []
        at = to
        while at > done:
            start, piece = back[at]
            out.append(v.unknown_ids(text[start:at]) if piece < 0 else [piece])
            at = start
        for i in range(done, to):
            back.pop(i, None)
            best.pop(i, None)
        back.pop(to, None)
        done = to
        return [x for ids in reversed(out) for x in ids]

    root, longest, lost = v.root[0], v.longest, v.unknown_score
    score_of = best.get
    for i in range(n):
        if reach == i and i - done >= LEAST_RUN:
            yield commit(i)
        elif i - done >= LOOK_BACK and (i - done) % LOOK_BACK == 0:
            ends = {e for e in range(i, reach + 1) if e in back}
            while len(ends) > 1:
                last = max(ends)
                ends.remove(last)
                ends.add(back[last][0] if last > done else done)
            common = ends.pop()
            if common > done:
                yield commit(common)
        here = best[i]
        nodes = root
        single = False
        end = i
        for c in text[i : i + longest]:
            end += 1
            node = nodes.get(c)
            if node is None:
                break
            nodes, found = node
            if found is not None:
                single = single or end == i + 1
                s = here + found[1]
                known = score_of(end)
                if known is None or s > known:
                    best[end] = s
                    back[end] = (i, found[0])
                    if end > reach:
                        reach = end
        if not single:
            s = here + lost
            if i + 1 not in best or s > best[i + 1]:
                best[i + 1] = s
                back[i + 1] = (i, -1)
                reach = max(reach, i + 1)
    if n > done:
        yield commit(n)


class Codec:
    """Encodes and decodes texts; equal segments are searched once while remembered."""

    def __init__(self, path: str):
        self.v = v = Vocabulary(path)
        self.memo: dict[str, bytes] = {}
        raw = {i: bytes([b]) for b, i in v.bytes.items()}
        #: What each id stands for; unknown and control ids for nothing.
        self.table = [raw.get(i, v.model.id_to_piece(i).encode() if i in v.scores else b"") for i in range(v.model.vocab_size())]
        self.leads = v.normalize("a").startswith(SPACE)

    def _segment(self, s: str) -> bytes:
        got = self.memo.get(s)
        if got is None:
            got = np.array([x for run in stream(self.v, s) for x in run], dtype="<u4").tobytes()
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(s) <= 64:
                self.memo[s] = got
        return got

    def segments(self, form: str) -> list[str]:
        """The form cut at boundaries that no piece spans."""
        if not self.v.splits or not form:
            return [form] if form else []
        first, *rest = form.split(SPACE)
        out = [first] if first else []
        blanks = ""
        for w in rest:
            blanks += SPACE
            if w:
                out.append(blanks + w)
                blanks = ""
        if blanks:
            out.append(blanks)
        return out

    def encode_form(self, form: str) -> bytes:
        """Ids of a normal form as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._segment, self.segments(form)))

    def encode(self, text: str) -> bytes:
        return self.encode_form(self.v.normalize(text)) if text else b""

    def decode(self, ids: bytes) -> str:
        """The text of ids: byte pieces joined and read as UTF-8, blanks restored, the
        leading one taken off."""
        out = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = out.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if self.leads and text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, ids (binary, little-endian unsigned 32 bits).  Null and
    empty texts have no ids; repeated rows are encoded each; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for first, texts in tokens.by_bytes(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(map(c.encode, texts), pa.binary())], names=["doc_id", "ids"])

    plain = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, path: str, ids: str = "ids", keep: str = "doc_id") -> DataFrame:
    """``keep`` and the text of each row's ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[keep, "text"])

    return df.select(keep, ids).mapInArrow(run, f"{keep} {df.schema[keep].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every row: doc_id, n_chars, n_ids, n_unknown, ids_crc32,
    exact (the decoded text is the text's normal form), scores (``unigram``: ids are the library's;
    ``ranks``: the file has no probabilities, ids are those of scores made from its ranks).  Null and empty texts have no ids and
    are exact; repeated rows are rows of their own; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        names = ["doc_id", "n_chars", "n_ids", "n_unknown", "ids_crc32", "exact", "scores"]
        for batch in batches:
            for first, texts in tokens.by_bytes(batch.column(1)):
                rows = []
                for t in texts:
                    form = c.v.normalize(t) if t else ""
                    ids = c.encode_form(form)
                    lost = int((np.frombuffer(ids, "<u4") == c.v.unknown).sum())
                    plain_form = form.replace(SPACE, " ")
                    again = c.decode(ids)
                    rows.append((len(t), len(ids) >> 2, lost, zlib.crc32(ids), again in (plain_form, plain_form[1:] if plain_form.startswith(" ") else plain_form), c.v.kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *(pa.array(x) for x in zip(*rows))], names=names)

    plain = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_chars long, n_ids long, n_unknown long, ids_crc32 long, exact boolean, scores string")
