"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES`` bytes, each with the units (lines, with their
line ends) and code points that end before it. The store is a table of its own, written once; nothing after it reads the
texts again.

Selection. Two seeded rolls of the document id name the units at which prefix and middle end. The cumulative counts tell
which frame holds such a cut, and only that frame is decompressed to find its place.

Output. ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm) is a list
of frames again: frames without a cut are taken as they are, frames with one are split. Frames are streamed in order
for digests, and restoring looks for the marks in that stream, so no step holds more of a text than its compressed frames
and one frame of plain bytes.

Defined cases: a null text counts as empty; an empty text, and one that holds a mark already, stays as it is (form
``plain``); a null id is rolled as the empty text; rows that share an id are transformed each for itself with the same
rolls; an empty table gives no rows; further columns are ignored; a single line of any length may span many frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import materialise

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100  # percent of the documents that are transformed
SPM = 50  # percent of those in suffix-prefix-middle order
FRAME_BYTES = 1 << 16
LEVEL = 3
_NEWLINE = 10

_FRAME = pa.struct([("units_before", pa.int64()), ("chars_before", pa.int64()), ("data", pa.binary())])
_STORED = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(_FRAME))])
_STORED_SQL = "struct<units:bigint,chars:bigint,marked:boolean,frames:array<struct<units_before:bigint,chars_before:bigint,data:binary>>>"
_FILLED = pa.struct([("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])
_FILLED_SQL = "struct<form:string,prefix_chars:bigint,middle_chars:bigint,output:array<binary>>"


# ------------------------------------------------------------------ frames

def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def split_frames(raw: bytes | memoryview, size: int = FRAME_BYTES) -> Iterator[memoryview]:
    """Parts of at most ``size`` bytes (a code point more where it would be cut)."""
    view, first = memoryview(raw), 0
    while first < len(view):
        last = min(first + size, len(view))
        while last < len(view) and view[last] & 0xC0 == 0x80:
            last += 1
        yield view[first:last]
        first = last


def store_text(raw: bytes, compress, size: int = FRAME_BYTES) -> dict:
    """A text as frames with cumulative counts; a unit counts in the frame that holds its line end."""
    units = chars = 0
    frames = []
    for part in split_frames(raw, size):
        frames.append({"units_before": units, "chars_before": chars, "data": compress(part)})
        seen = np.frombuffer(part, np.uint8)
        units += int(np.count_nonzero(seen == _NEWLINE))
        chars += code_points(seen)
    open_line = bool(raw) and raw[-1] != _NEWLINE
    return {"units": units + open_line, "chars": chars, "marked": any(m.encode() in raw for m in MARKS), "frames": frames}


def framed(text: Column, size: int = FRAME_BYTES, level: int = LEVEL) -> Column:
    """Column: units, code points, whether a mark occurs, and the frames of a text."""

    @F.arrow_udf(_STORED_SQL)
    def store(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = zstandard.ZstdCompressor(level=level).compress
        for column in columns:
            texts = column.cast(pa.large_binary())
            yield pa.array([store_text(t.as_py() or b"", compress, size) for t in texts], _STORED)

    return store(text.cast("string"))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """The written table of frames: doc_id, units, chars, marked, frames."""
    rows = docs.select(F.col(id_col).alias("doc_id"), framed(F.col(text_col), size, level).alias("of"))
    return materialise(rows.select("doc_id", "of.*"), "frames")


# --------------------------------------------------------------- selection

def rolls(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers from the digest of seed and id: two cuts, whether to transform, and the order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


class Stored:
    """The frames of one text, opened one at a time."""

    def __init__(self, frames: Sequence[dict], units: int, chars: int, decompress):
        self.frames, self.units, self.chars, self.decompress = frames, units, chars, decompress
        self.before = [f["units_before"] for f in frames]

    def cut(self, units: int) -> tuple[int, int, int]:
        """Frame, byte in it and code points before the place where ``units`` units have ended."""
        if units == 0:
            return 0, 0, 0
        if units == self.units:
            return len(self.frames), 0, self.chars
        at = int(np.searchsorted(self.before, units, "left")) - 1
        raw = _array(self.decompress(self.frames[at]["data"]))
        end = int(np.flatnonzero(raw == _NEWLINE)[units - self.before[at] - 1]) + 1
        return at, end, self.frames[at]["chars_before"] + code_points(raw[:end])

    def between(self, low: tuple[int, int, int], high: tuple[int, int, int], compress) -> list[bytes]:
        """Frames of the text from one cut to the other; those without a cut are not opened."""
        out = []
        for at in range(low[0], min(high[0] + 1, len(self.frames))):
            first, last = low[1] if at == low[0] else 0, high[1] if at == high[0] else None
            if first == 0 and last is None:
                out.append(self.frames[at]["data"])
            elif last is None or last > first:
                part = self.decompress(self.frames[at]["data"])[first:last]
                if part:
                    out.append(compress(part))
        return out


def transformed(stored: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, level: int = LEVEL) -> DataFrame:
    """doc_id, units, form, prefix_chars, middle_chars and ``output``, the frames of the new text in order."""
    one, two, chance, order = rolls(F.col("doc_id"), seed)
    places = [h % (F.col("units") + 1) for h in (one, two)]
    plain = (F.col("units") == 0) | F.col("marked") | (chance % 100 >= rate)
    form = F.when(plain, "plain").when(order % 100 < spm, "spm").otherwise("psm")

    @F.arrow_udf(_FILLED_SQL)
    def fill(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        compress = zstandard.ZstdCompressor(level=level).compress
        decompress = zstandard.ZstdDecompressor().decompress
        mark = {m: compress(m.encode()) for m in MARKS}
        for frames, units, chars, low, high, forms in batches:
            rows = []
            for f, u, c, a, b, how in zip(frames, units.to_pylist(), chars.to_pylist(), low.to_pylist(), high.to_pylist(), forms.to_pylist()):
                f = f.as_py()
                if how == "plain":
                    rows.append({"form": how, "prefix_chars": None, "middle_chars": None, "output": [x["data"] for x in f]})
                    continue
                text = Stored(f, u, c, decompress)
                start, end = text.cut(0), text.cut(u)
                first, last = text.cut(a), text.cut(b)
                prefix = [mark[PREFIX], *text.between(start, first, compress)]
                suffix = [mark[SUFFIX], *text.between(last, end, compress)]
                middle = [mark[MIDDLE], *text.between(first, last, compress)]
                rows.append({
                    "form": how, "prefix_chars": first[2], "middle_chars": last[2] - first[2],
                    "output": (suffix + prefix if how == "spm" else prefix + suffix) + middle,
                })
            yield pa.array(rows, _FILLED)

    made = fill("frames", "units", "chars", F.least(*places), F.greatest(*places), form)
    return stored.select("doc_id", "units", made.alias("of")).select("doc_id", "units", "of.*")


# ------------------------------------------------------------- using output

class Stream:
    """Plain bytes of a list of frames, by ranges of bytes."""

    def __init__(self, frames: Sequence[bytes], decompress):
        self.frames, self.decompress = frames, decompress
        sizes = [zstandard.frame_content_size(f) for f in frames]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def read(self, low: int, high: int) -> Iterator[bytes]:
        """The bytes from ``low`` to ``high``, one frame at a time; frames outside are not opened."""
        at = int(np.searchsorted(self.starts, low, "right")) - 1
        while at < len(self.frames) and self.starts[at] < high:
            raw, start = self.decompress(self.frames[at]), int(self.starts[at])
            yield raw[max(0, low - start) : high - start]
            at += 1

    def find(self, mark: bytes, start: int) -> int:
        """Place of the first ``mark`` at or after byte ``start``; marks may lie across frames."""
        kept, place = b"", start
        for part in self.read(start, int(self.starts[-1])):
            kept, place = kept + part, place - len(kept)
            found = kept.find(mark)
            if found >= 0:
                return place + found
            place += len(kept)
            kept = kept[-(len(mark) - 1) :]
        raise ValueError(f"no {mark.decode()} in a transformed text")

    def restored(self, form: str) -> Iterator[bytes]:
        """The text that was transformed, from the marks in the output."""
        size = int(self.starts[-1])
        if form == "plain":
            yield from self.read(0, size)
            return
        opening, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
        wide = len(MIDDLE)
        a = self.find(opening.encode(), 0)
        b = self.find(inner.encode(), a + wide)
        c = self.find(MIDDLE.encode(), b + wide)
        first, second, middle = (a + wide, b), (b + wide, c), (c + wide, size)
        for part in (second, middle, first) if form == "spm" else (first, middle, second):
            yield from self.read(*part)


def _each(of: str, work):
    """A column function of (output, form) that streams the frames of each row through ``work``."""

    @F.arrow_udf(of)
    def over(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        decompress = zstandard.ZstdDecompressor().decompress
        kind = pa.string() if of == "string" else pa.struct([("output", pa.string()), ("restored", pa.string())])
        for frames, forms in batches:
            yield pa.array([work(Stream(f.as_py(), decompress), how) for f, how in zip(frames, forms.to_pylist())], kind)

    return over


def _sha256(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def output_text(output: Column, form: Column) -> Column:
    """The transformed text."""
    return _each("string", lambda s, how: b"".join(s.read(0, int(s.starts[-1]))).decode())(output, form)


def restored_text(output: Column, form: Column) -> Column:
    """The original text, rebuilt from the transformed one and its form."""
    return _each("string", lambda s, how: b"".join(s.restored(how)).decode())(output, form)


def digests(output: Column, form: Column) -> Column:
    """SHA-256 (lowercase hex) of the transformed text and of the text rebuilt from it, frame by frame."""
    return _each(
        "struct<output:string,restored:string>",
        lambda s, how: {"output": _sha256(s.read(0, int(s.starts[-1]))), "restored": _sha256(s.restored(how))},
    )(output, form)
