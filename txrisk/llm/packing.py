"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Tokens. A document's ids come from the named tokenizer without special tokens, followed by one end id. Tokens never
span white space, so a text is cut into pieces, each distinct piece is encoded once, and ids are gathered from that memo.
The memo is flat arrays of at most about 40 MB in a worker process; it is emptied when full, which costs time and changes
nothing.

Packing. Only documents longer than a sequence are cut. Best-fit decreasing looks at lengths alone, so it runs on the
histogram of lengths, which has at most ``capacity`` entries however many documents there are. A segment tree over
remaining capacities finds the tightest open bin in logarithmic time. The outcome is a plan, "the k-th piece of this
length goes to that bin at that offset", and Spark gives each piece its rank within its length and looks it up.

Defined cases: a null or empty text is one piece that holds only the end id; equal lengths are told apart by document
id and piece; repeated rows are packed once each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm import text as T
from txrisk.llm.common import materialise, worker_slot
from txrisk.llm.memo import ABSENT, Memo

CAPACITY = 4096
END_ID = 1
CELLS = 256  # parts into which the pieces of one length are dealt for ranking
_SPECIAL = "<|startoftext|>"

_PIECES_SQL = "array<struct<length:int,ids_crc32:bigint,ids:array<int>>>"


def small_latin(raw: np.ndarray) -> np.ndarray:
    """Bytes of the letters a-z and of the small letters from U+00DF to U+00FF."""
    tail = (raw >= 0x9F) & (raw <= 0xBF) & (raw != 0xB7)
    lead = raw == 0xC3
    pair = lead[:-1] & tail[1:]
    yes = (raw >= 0x61) & (raw <= 0x7A)
    yes[:-1] |= pair
    yes[1:] |= pair
    return yes


# Byte-level models name a byte by a character: printable Latin-1 by itself, the others by U+0100 and up, in order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARS = [chr(b) if b in _PRINTABLE else chr(0x100 + _OTHERS.index(b)) for b in range(256)]


class Merges:
    """Byte-pair merges of a tokenizer file, applied to many words at once.

    In each round every unfinished word merges its pair of least rank, the leftmost of equals; a word is finished when
    no neighbours are a pair. Only byte-level models with a mark at word ends are taken; for others ``usable`` is false.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, tokenizer):
        spec = json.loads(tokenizer.to_str())
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix")
        self.usable = bool(end) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        self.usable = self.usable and all(c in vocab and c + end in vocab for c in BYTE_CHARS)
        if not self.usable:
            return
        self.inner = np.array([vocab[c] for c in BYTE_CHARS], np.int64)
        self.last = np.array([vocab[c + end] for c in BYTE_CHARS], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.table = Memo(bits=2 + max(8, len(keys).bit_length()))  # pair → rank; mixing keeps keys apart
        self.table.add(T.mix(keys.astype(np.uint64)), np.zeros(len(keys), np.int64), np.zeros(0, np.uint32))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.table.find(T.mix((left << 20 | right).astype(np.uint64)))
        return np.where(rank == ABSENT, self.NONE, rank)

    def apply(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in order; the words are the bytes of ``data``, cut into ``sizes``."""
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        token = self.inner[data]
        token[np.cumsum(sizes) - 1] = self.last[data[np.cumsum(sizes) - 1]]
        rank = np.full(len(token), self.NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.ranks(token[inside], token[inside + 1])
        owners, tokens = [], []
        while len(token):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(token))))
            going = least < self.NONE
            if not going.all():
                owners.append(owner[~going])
                tokens.append(token[~going])
                token, owner, rank, least = token[going], owner[going], rank[going], least[going]
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if len(at) else at
            token[at] = self.made[rank[at]]
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            token, owner, rank = token[stays], owner[stays], rank[stays]
            at = at - np.arange(len(at))
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < len(token))
                ok[ok] = owner[left[ok]] == owner[left[ok] + 1]
                over = left[(left >= 0) & ~ok]
                rank[over] = self.NONE
                rank[left[ok]] = self.ranks(token[left[ok]], token[left[ok] + 1])
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(sizes)), token[order].astype(np.uint32)


def encoder(tokenizer_file: str) -> "Encoder":
    """One for each worker process, until another operator needs the room."""
    return worker_slot(("packing", tokenizer_file), lambda: Encoder(tokenizer_file))


class Encoder:
    """Token ids of texts, through a bounded memo of the pieces of text that tokens never span.

    A text is cut at ASCII white space, and where an ASCII letter and one of ``SIGNS`` meet: the tokenizer cuts at
    all these places too, whatever stands around them. A piece is known by a 64-bit hash of its bytes.
    """

    SIGNS = ".,!?;:*#$%&-()/\""  # without apostrophes, which may start a token with letters, and marks of special tokens

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.mark = self.tokenizer.token_to_id(_SPECIAL)
        self.merges = Merges(self.tokenizer)
        self.letters = T.byte_class((0x61, 0x7A))
        self.signs = T.byte_class(*[(ord(c), ord(c)) for c in self.SIGNS])
        self.memo = Memo()

    def _learn(self, codes: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode new pieces.

        Latin letters alone are one word to the tokenizer, and its merges are applied to all such pieces at once.
        Others go through the tokenizer, many in one call, parted by a special token that none of them contains.
        """
        other = np.concatenate([[0], np.cumsum(~small_latin(raw))])
        latin = (other[end] == other[begin]) & self.merges.usable
        simple, rest = np.flatnonzero(latin), np.flatnonzero(~latin)
        size = end[simple] - begin[simple]
        first = np.cumsum(size) - size
        size, ids = self.merges.apply(raw[np.arange(size.sum()) + np.repeat(begin[simple] - first, size)], size)
        lengths, found = [size], [ids]
        data = raw.tobytes()
        pieces = {k: data[a:b] for k, a, b in zip(rest.tolist(), begin[rest].tolist(), end[rest].tolist())}
        plain = [k for k, piece in pieces.items() if b"<|" not in piece]
        odd = [k for k, piece in pieces.items() if b"<|" in piece]
        for low in range(0, len(plain), 200):
            ids = np.array(self._encode(_SPECIAL.join(pieces[k].decode() for k in plain[low : low + 200])), np.uint32)
            cut = ids == self.mark
            lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1)
            found.append(ids[~cut])
        for k in odd:
            found.append(np.array(self._encode(pieces[k].decode()), np.uint32))
            lengths.append(np.array([len(found[-1])]))
        order = np.concatenate([simple, np.array(plain + odd, np.int64)])
        self.memo.add(codes[order], np.concatenate(lengths), np.concatenate(found))

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: T.Texts) -> list[np.ndarray]:
        """The ids of each text."""
        # A-Z are lower-cased before, as the tokenizer does anyway, but for texts with marks of special tokens.
        marked = b"<|" in texts.raw.tobytes()
        raw = texts.raw if marked else T.LOWER[texts.raw]
        piece = T.words(T.Texts(raw, texts.starts), T.SPACED, lower=False, parts=None if marked else (self.letters, self.signs))
        entry = self.memo.find(piece.hash)
        missing = np.flatnonzero(entry == ABSENT)
        if len(missing):
            if self.memo.full(len(missing)):
                self.memo.empty()
                missing = np.arange(len(entry))
            codes, first = np.unique(piece.hash[missing], return_index=True)
            self._learn(codes, raw, piece.begin[missing[first]], piece.end[missing[first]])
            entry = self.memo.find(piece.hash)
        ids, total = self.memo.gather(entry)
        bounds = total[piece.first]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def tokenise(tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False):
    """A column function: text → pieces of at most ``capacity`` ids, each with length, checksum and perhaps its ids.

    The tokenizer file has to be at the same path on every worker, as the installed package of vocabularies is.
    """

    @F.arrow_udf(_PIECES_SQL)
    def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(tokenizer_file)
        for column in columns:
            first, length, crc, ids = [0], [], [], []
            for texts in T.chunks(column):
                for found in known.encode(texts):
                    whole = np.append(found, np.uint32(end_id)).astype("<u4")
                    for low in range(0, len(whole), capacity):
                        part = whole[low : low + capacity]
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        ids.append(part.astype(np.int32) if with_ids else None)
                    first.append(len(length))
            of = pa.StructArray.from_arrays(
                [pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["length", "ids_crc32", "ids"],
            )
            yield pa.ListArray.from_arrays(pa.array(first, pa.int32()), of)

    return pieces


class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the runs of bins with that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)  # bins below each node
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room → (first bin, bins)

    def _add(self, room: int, bins: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += bins
            node >>= 1

    def push(self, room: int, first: int, bins: int) -> None:
        if bins and room:
            runs = self.runs[room]
            if runs and sum(runs[-1]) == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + bins)
            else:
                runs.append((first, bins))
            self._add(room, bins)

    def pop(self, room: int, bins: int) -> tuple[int, int]:
        """Take at most ``bins`` bins of the first run with this room."""
        first, there = self.runs[room].popleft()
        taken = min(bins, there)
        if taken < there:
            self.runs[room].appendleft((first + taken, there - taken))
        self._add(room, -taken)
        return first, taken

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open bin has."""
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on a histogram of lengths: rows (length, rank, pieces, per bin, first bin, offset).

    ``pieces`` pieces of this length, from rank ``rank`` on, go to consecutive bins from ``first bin``, ``per bin``
    in each, starting at ``offset``. It is what placing pieces one by one gives: the tightest bin takes as many
    equal pieces in a row as fit, for its room only shrinks.
    """
    bins, made, rows = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            each = (capacity if room is None else room) // length
            want = max(1, left // each)  # bins that get their fill, or one that gets the rest
            each = min(each, left)
            if room is None:
                room, first, taken = capacity, made, want
                made += want
            else:
                first, taken = bins.pop(room, want)
            rows.append((length, rank, taken * each, each, first, capacity - room))
            bins.push(room - each * length, first, taken)
            rank += taken * each
            left -= taken * each
    return rows


def _place(rows: list[tuple[int, int, int, int, int, int]], spark):
    """A column function: (length, rank) → (sequence, offset), by looking the rank up in the plan."""
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        of, at = length.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64)
        known = shared.value
        key = known[:, 0] << 44 | known[:, 1]  # lengths are small and ranks stay below 2**44
        row = known[np.searchsorted(key, of << 44 | at, "right") - 1]
        nth = at - row[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * of)],
            ["sequence_id", "offset"],
        )

    return place


def _ranked(pieces: DataFrame, cell: Column) -> DataFrame:
    """Add ``rank``, the place of a piece among all of its length.

    Pieces of one length are dealt to cells; the cells are counted, the counts of at most
    ``capacity * CELLS`` cells are summed up, and a window ranks inside each cell.
    """
    celled = pieces.withColumn("cell", cell)
    counts = celled.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = celled.withColumn("nth", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["length", "cell"]).withColumn("rank", F.col("nth") + F.col("before"))


def pack(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    The tokenised pieces (without texts) are written once to the work folder, because their lengths are needed
    twice: for the histogram, which is all that reaches the driver, and for the placement.
    """
    spark = docs.sparkSession
    split = tokenise(tokenizer_file, capacity, end_id, with_ids)
    listed = docs.select(F.col(id_col).alias("doc_id"), split(F.col(text_col).cast("string")).alias("pieces"))
    pieces = materialise(
        listed.select("doc_id", F.posexplode("pieces").alias("piece", "of")).select(
            "doc_id", "piece", F.col("of.length").alias("length"), F.col("of.ids_crc32").alias("ids_crc32"),
            *([F.col("of.ids").alias("ids")] if with_ids else []),
        ),
        "pieces",
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = _place(plan(histogram, capacity), spark)
    # Full pieces fill a sequence each, whichever it is: they are ranked like all others.
    ranked = _ranked(pieces, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(CELLS)).cast("int"))
    placed = ranked.withColumn("to", place(F.col("length").cast("long"), F.col("rank").cast("long")))
    return placed.select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("length").cast("long").alias("length"),
        "ids_crc32", F.col("to.sequence_id").alias("sequence_id"), F.col("to.offset").alias("offset"),
        *(["ids"] if with_ids else []),
    )
