"""Subword encoding inside Arrow functions: batches of about equal bytes, long texts
cut at boundaries that no token crosses."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: The split pattern of byte-level tokenizers (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern takes a blank only at the start of a match or within a run of blanks,
#: so no match spans the place before a blank that follows a visible character.
_SAFE = re.compile(r"(?<=\S)(?= )")
#: Characters of a text given to the library at once; longer texts are cut.
PART_CHARS = 1 << 18


def safe_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` cut at the first safe boundary after each ``most`` characters."""
    parts, at = [], 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:] if at else text)
    return parts


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level files write each byte as one letter: visible Latin-1 characters stand
    for themselves, the other bytes for characters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as the library of the file gives them: ``tokenizers`` for .json,
    ``sentencepiece`` for .model; no begin, end or other tokens are added.

    A byte-level .json whose merges stand in the order of their ids is run by
    tiktoken's matching engine, which gives the same ids at several times the speed;
    strings of special tokens keep the library's default, one id each.
    """

    def __init__(self, path: str):
        self.cut = lambda text: (text,)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: _buffer(model.encode(text))
            self.sizes = lambda texts: map(len, model.encode(texts))
            return
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        plain = (
            spec.get("normalizer") is None
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        ranks = self._ranks(model, {t["content"] for t in added}) if plain else None
        if ranks:
            import tiktoken

            special = {t["content"]: t["id"] for t in added}
            core = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            allowed = set(special)
            self.ids = lambda text: core._core_bpe.encode_to_tiktoken_buffer(text, allowed)
            self.sizes = lambda texts: (memoryview(self.ids(x)).nbytes >> 2 for x in texts)
            self.cut = safe_parts
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.ids = lambda text: _buffer(library.encode(text, add_special_tokens=False).ids)
            self.sizes = lambda texts: map(len, library.encode_batch_fast(texts, add_special_tokens=False))

    @staticmethod
    def _ranks(model: dict, special: set[str]) -> dict[bytes, int] | None:
        """{bytes: id}, or None unless every merge makes an id above those of all merges before."""
        letters, vocab = _bytes_of_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        single = [vocab.get(c, -1) for c in letters]
        if min(single) < 0 or any(x >= y for x, y in zip(made, made[1:])) or made and max(single) > made[0]:
            return None
        if len(set(vocab) - special) != len(made) + 256:
            return None
        return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids, self.cut(text))) if text else b""

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Ids of each text: all safe parts of the texts are one batch, of which only the
        lengths are looked at."""
        parts = [(i, part) for i, text in enumerate(texts) if text for part in self.cut(text)]
        out = np.zeros(len(texts), dtype=np.int64)
        if parts:
            np.add.at(out, [i for i, _ in parts], list(self.sizes([part for _, part in parts])))
        return out


def _buffer(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str) -> int:
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])]
    return max(ids) + 1


def by_bytes(column, most: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of an Arrow string column, each of about ``most`` bytes: (first row,
    texts, nulls as empty).  A single longer text is a run of its own."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, [x or "" for x in column.slice(start, stop - start).to_pylist()]
        start = stop
