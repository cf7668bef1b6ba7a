"""Byte-level BPE: encoding by forced boundaries, and decoding.

A token's bytes stand in the vocabulary, so two bytes that follow each other inside no token are never joined by one. Where
such a pair occurs in a text there is a certain cut: the fragments on both sides are encoded independently by the
tokenizer itself, and their ids are concatenated. The tokenizer also cuts a text into words by a pattern before it
merges; a cut between fragments must not change how that pattern reads on. It looks at nothing before its place, and
beyond it only behind white space and an apostrophe. So a forced pair is taken unless the first byte ends a
white-space character, one of the two is an apostrophe, or the second one is inside a character. Runs of letters,
digits or signs may be cut anywhere else: the rest of a run is read as a run again.

Fragments are mostly words with the space before them. Each is known by a 64-bit hash of its bytes and encoded once per
task; the memo is bounded and goes with the task. Because fragments are independent, a text of any length is read in
slices that end at a certain cut, so working arrays do not grow with the text.

Ids are binary columns of little-endian unsigned 32-bit integers.

Defined cases: a null or empty text has no ids, and no ids decode to the empty text; the strings of special tokens in a
text become those tokens, as the library does; ids whose bytes are no UTF-8 decode with replacement characters;
repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.llm import text as T
from txrisk.llm.common import worker_slot
from txrisk.llm.memo import ABSENT, Memo

SLICE = 1 << 20  # bytes of a text or of several texts that are looked at together
_APOSTROPHE = 0x27

# Byte-level models write a byte as a character, printable Latin-1 as itself, the others from U+0100 up.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {
    chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))
}
# The characters that Unicode calls white space (and four controls that only some call so).
_SPACES = [
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each token id."""
    vocab = spec["model"]["vocab"]
    tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for name, at in vocab.items():
        tokens[at] = bytes(_BYTE_OF[c] for c in name)
    for t in spec["added_tokens"]:
        tokens[t["id"]] = t["content"].encode()
    return tokens


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether the second byte follows the first one inside some token."""
    data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    together = np.flatnonzero(owner[:-1] == owner[1:])
    table = np.zeros((256, 256), bool)
    table[data[together], data[together + 1]] = True
    return table


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether a text may be cut between these two bytes, as far as the two can tell."""
    table = ~pairs_inside(tokens)
    table[:, 0x80:0xC0] = False
    table[_APOSTROPHE, :] = table[:, _APOSTROPHE] = False
    for c in _SPACES:
        if ord(c) < 0x80:
            table[ord(c), :] = False
    return table


def ends_space() -> np.ndarray:
    """256 x 256: whether the two bytes are the end of a white-space character beyond ASCII."""
    table = np.zeros((256, 256), bool)
    for c in _SPACES:
        raw = c.encode()
        if len(raw) > 1:
            table[raw[-2], raw[-1]] = True
    return table


def provable(spec: dict) -> bool:
    """Whether the tokenizer is of the kind for which forced boundaries are certain."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    return model["type"] == "BPE" and plain and whole and not spec.get("normalizer") and not any(model.get(k) for k in odd)


class Codec:
    """The tokenizer of a file, its cut table and the bytes of its tokens; the same for all tasks of a worker."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its parallelism
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as file:
            spec = json.load(file)
        if not provable(spec):
            raise ValueError(f"{tokenizer_file}: forced boundaries are certain for plain byte-level BPE only")
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        tokens = token_bytes(spec)
        self.forced, self.space = forced_pairs(tokens), ends_space()
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Places 1..len-1 of the certain cuts inside ``raw``, a part of one text or of several."""
        if len(raw) < 2:
            return np.zeros(0, np.int64)
        yes = self.forced[raw[:-1], raw[1:]]
        if len(raw) > 2:
            yes[1:] &= ~self.space[raw[:-2], raw[1:-1]]
        return np.flatnonzero(yes) + 1

    def encode_fragments(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each fragment, and all ids in order."""
        found = self.tokenizer.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)
        ids = [e.ids for e in found]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((i for one in ids for i in one), np.uint32, int(sizes.sum()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens one after the other."""
        low = self.starts[ids]
        size = self.starts[ids.astype(np.int64) + 1] - low
        total = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.arange(total[-1]) + np.repeat(low - total[:-1], size)].tobytes()


def codec(tokenizer_file: str) -> Codec:
    """One for each worker process, of fixed size, until another operator needs the room."""
    return worker_slot(("byte-level", tokenizer_file), lambda: Codec(tokenizer_file))


class Encoder:
    """Encodes the texts of one task: the codec and a memo of fragments."""

    def __init__(self, of: Codec):
        self.codec, self.memo = of, Memo()

    def slice_ids(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``raw`` in order, and for each of ``starts`` (places where a text begins) the ids before it."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[self.codec.cuts(raw)] = True
        cut[0] = cut[len(raw)] = True
        cut[starts] = True
        bounds = np.flatnonzero(cut)
        begin, end = bounds[:-1], bounds[1:]
        code = T.run_hashes(raw, begin, end)
        entry = self.memo.find(code)
        missing = np.flatnonzero(entry == ABSENT)
        if len(missing):
            if self.memo.full(len(missing)):
                self.memo.empty()
                missing = np.arange(len(code))
            new, first = np.unique(code[missing], return_index=True)
            data, at = raw.tobytes(), missing[first]
            pieces = [data[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())]
            self.memo.add(new, *self.codec.encode_fragments(pieces))
            entry = self.memo.find(code)
        ids, total = self.memo.gather(entry)
        return ids, total[np.searchsorted(begin, starts)]

    def encode(self, column: pa.Array, size: int = SLICE) -> list[bytes]:
        """The ids of each text of a column, as little-endian bytes."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        parts: list[list[bytes]] = [[] for _ in range(len(column))]
        low, last = int(offsets[0]), int(offsets[-1])
        while low < last:
            high = self._slice_end(raw, offsets, low, last, size)
            # Texts that have bytes in this slice, and where they begin in it.
            one = int(np.searchsorted(offsets, low, "right")) - 1
            two = int(np.searchsorted(offsets, high, "left"))
            starts = np.maximum(offsets[one:two] - low, 0)
            ids, before = self.slice_ids(raw[low:high], starts)
            ids = ids.astype("<u4", copy=False)
            for k, (a, b) in enumerate(zip(before, np.append(before[1:], len(ids)))):
                if b > a:
                    parts[one + k].append(ids[a:b].tobytes())
            low = high
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]

    def _slice_end(self, raw: np.ndarray, offsets: np.ndarray, low: int, last: int, size: int) -> int:
        """The furthest certain cut or start of a text within ``size`` bytes, or the next one beyond."""
        if low + size >= last:
            return last
        while True:
            high = min(low + size, last)
            start = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            inside = self.codec.cuts(raw[max(low, start) : high])
            best = max(start, max(low, start) + int(inside[-1]) if len(inside) else 0)
            if best > low:
                return best
            if high == last:
                return last
            size *= 2


def encoded(text: Column, tokenizer_file: str) -> Column:
    """Token ids of a text column as binary; the file has to be at the same path on every worker."""

    @F.arrow_udf("binary")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(codec(tokenizer_file))
        for column in columns:
            yield pa.array(encoder.encode(column), pa.binary())

    return encode(text.cast("string"))


def decoded(ids: Column, tokenizer_file: str) -> Column:
    """The text of a binary column of token ids, special tokens as their strings; null stays null."""

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = codec(tokenizer_file)
        for column in columns:
            out = []
            for value in column:
                found = None
                if value.is_valid:
                    raw = np.frombuffer(value.as_buffer(), "<u4")
                    found = b"".join(known.decode(raw[k : k + SLICE]) for k in range(0, len(raw), SLICE)).decode("utf-8", "replace")
                out.append(found)
            yield pa.array(out, pa.string())

    return decode(ids)


def n_ids(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
