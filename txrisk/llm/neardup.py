"""MinHash near-duplicate detection with sequential Bayesian verification.

A document's set holds its distinct ``SHINGLE``-word shingles (the whole text as one, if it has fewer words). Documents
with equal sets form a class and only classes are compared. Two classes are linked if
``100 * intersection >= PERCENT * union`` on their full sets; components of links are the groups of near-duplicates.

1. Signatures: ``BANDS * ROWS`` minima per set; classes that agree on all rows of a band share a bucket. A pair at the
   threshold meets in no bucket with probability ``(1 - 0.8**ROWS)**BANDS``, about 1e-7.
2. Buckets are sorted runs of a range-partitioned table, so one of any size spreads over tasks. Its first member
   leads it, and all others are compared with the leader: as many pairs as members, not their square.
3. Comparison is sequential: signatures are compared a batch at a time, and a pair is dropped as soon as the posterior
   probability that it reaches the threshold is below ``MISS``. Survivors are verified on full sets.
4. A bucket whose members are all in one component by then is done. In others, the members outside the bucket's largest
   component meet all members of other components, block by block, with signatures and full sets, which covers every
   pair of the bucket that could still add a link. A block verifies its survivors itself, the likeliest first, and
   only those whose components it has not joined yet: it gives back fewer links than it has members.

Shingles stand for themselves by 64-bit hashes; a set is named by a 128-bit one.

Defined cases: a null, empty or wordless text has an empty set and is linked with nothing; repeated rows are in one
class; a null id never names a component while another id does; rows that share an id are judged by their texts; an empty
table gives no rows; further columns are carried along by ``drop_near_duplicates`` and otherwise ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm import text as T
from txrisk.llm.common import batches_of, fresh, materialise, salt_of, spread_join, with_group_facts
from txrisk.llm.components import components
from txrisk.llm.lines import text_digest

SHINGLE = 5
PERCENT = 80
ROWS = 5
BANDS = 40
STEP = 25  # signature places that are compared before the next decision
MISS = 1e-7
PIVOTS, OTHERS = 256, 1024  # sizes of blocks in which members of a bucket meet
BLOCK_SHINGLES = 2_000_000  # and of their full sets together, where members are long
HOT = 512  # pairs of one leader that are joined in one place
FILTER_BITS = (16, 24)  # least and largest size of the filter that finds the documents to verify, as powers of two
PAIR_ROWS, TEXT_ROWS = 128, 1000  # pairs of full sets, and texts, that go to Python at once
_PLACES = ROWS * BANDS

_SIGNED = "struct<n:bigint,key:binary,bands:array<bigint>,signature:binary>"
_SIGNED_ARROW = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: T.Texts, length: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    word = T.words(texts, T.SPACED)
    first, code = T.windows(word, length)
    bounds = np.searchsorted(first, word.first)
    out = []
    for k, count in enumerate(word.counts()):
        if 0 < count < length:
            low, high = word.first[k], word.first[k + 1]
            alone = T.Words(word.begin[low:high], word.end[low:high], word.hash[low:high], np.array([0, count]))
            out.append(T.windows(alone, int(count))[1])
        else:
            out.append(np.unique(code[bounds[k] : bounds[k + 1]]))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band codes and one-byte signatures of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joined = np.concatenate(sets)
    least = np.empty((len(sets), _PLACES), np.uint64)
    held = np.empty_like(joined)
    for place, factor in enumerate(_factors()):
        np.multiply(joined, factor, out=held)
        least[:, place] = np.minimum.reduceat(held, first)
    least = T.mix(least)
    codes = np.zeros((len(sets), BANDS), np.uint64)
    for row in range(ROWS):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + least[:, row::ROWS]
    codes = T.mix(codes + np.arange(BANDS, dtype=np.uint64))
    return codes.view(np.int64), (least & np.uint64(255)).astype(np.uint8)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(text: Column, length: int) -> Column:
    """Struct column: size of the set, its key, band codes and signature; all but the size null for an empty set."""

    @F.arrow_udf(_SIGNED)
    def sign(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows: list[dict] = []
            for texts in T.chunks(column):
                sets = shingle_sets(texts, length)
                full = [s for s in sets if len(s)]
                found = iter(zip(full, *signatures(full)) if full else ())
                for s in sets:
                    if len(s):
                        s, bands, signature = next(found)
                        rows.append({"n": len(s), "key": set_key(s), "bands": bands, "signature": signature.tobytes()})
                    else:
                        rows.append({"n": 0, "key": None, "bands": None, "signature": None})
            yield pa.array(rows, _SIGNED_ARROW)

    return sign(text.cast("string"))


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, key, leader) for all members of buckets with at least two; some rows may come twice.

    Rows are range-partitioned by (bucket, key) and sorted, so members of a bucket follow each other, and every row but
    the first of a run is led by that first one. A run at an end of a partition may go on in the next: the leaders of
    the first and the last run of each partition are noted, and a second, small pass leads those of one bucket to the least.
    """
    rows = classes.select(F.posexplode("bands").alias("band", "code"), "key").select(
        (F.shiftleft("code", 6) + F.col("band")).alias("bucket"), "key"  # the low six bits name the band
    )

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, None

        def out(bucket, key: pa.Array, led: pa.Array, edge: bool) -> pa.RecordBatch:
            flags = pa.array([edge] * len(key), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), key, led, flags], ["bucket", "key", "leader", "edge"])

        for batch in batches:
            bucket, key = batch.column("bucket").to_numpy(), batch.column("key")
            if not len(bucket):
                continue
            head = np.concatenate([[bucket[0] != last], bucket[1:] != bucket[:-1]])
            if last is None:
                yield out(bucket[:1], key[:1], key[:1], True)
            known = pa.concat_arrays([pa.array([leader], pa.binary()), key.take(pa.array(np.flatnonzero(head)))])
            led = known.take(pa.array(np.cumsum(head)))
            rest = np.flatnonzero(~head)
            yield out(bucket[rest], key.take(pa.array(rest)), led.take(pa.array(rest)), False)
            last, leader = bucket[-1], led[len(led) - 1].as_py()
        if last is not None:
            yield out([last], pa.array([leader], pa.binary()), pa.array([leader], pa.binary()), True)

    dealt = rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    runs = materialise(dealt.mapInArrow(lead, "bucket bigint, key binary, leader binary, edge boolean"), "buckets")
    led = runs.filter("not edge").select("bucket", "key", "leader")
    heads = led.select("bucket", "leader").distinct().select("bucket", F.col("leader").alias("key"), "leader")
    parts = runs.filter("edge").select("bucket", "leader").distinct()
    several = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("leader").alias("first")).filter("n > 1").drop("n")
    joined = parts.join(several, "bucket").select("bucket", F.col("leader").alias("key"), F.col("first").alias("leader"))
    return led.unionByName(heads).unionByName(joined)


@cache
def bounds() -> np.ndarray:
    """For each number of compared places, the most matches at which a pair is still dropped.

    With a flat prior on the similarity s, a place matches with probability s + (1 - s) / 256. The posterior
    probability of s at or above the threshold is summed over a grid.
    """
    s = (np.arange(4000) + 0.5) / 4000
    match = s + (1 - s) / 256
    out = []
    for n in range(STEP, _PLACES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(match) + (n - m) * np.log1p(-match)
        weight = np.exp(logs - logs.max(1, keepdims=True))
        above = weight[:, s >= PERCENT / 100].sum(1) / weight.sum(1)
        out.append(int(np.flatnonzero(above < MISS).max(initial=-1)))
    return np.array(out)


def compare(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Matches of signature pairs (rows), or -1 for pairs dropped by their sizes or by the posterior."""
    matches = np.full(len(one), -1)
    alive = np.flatnonzero(np.minimum(n_one, n_other) * 100 >= PERCENT * np.maximum(n_one, n_other))
    count = np.zeros(len(alive), np.int64)
    for k, most in enumerate(bounds()):
        places = slice(k * STEP, (k + 1) * STEP)
        count += (one[alive, places] == other[alive, places]).sum(1)
        good = count > most
        alive, count = alive[good], count[good]
    matches[alive] = count
    return matches


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), _PLACES)


def with_both(pairs: DataFrame, known: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pairs (a, b) with the columns of both keys: ``columns`` maps a column of ``known`` to a prefix.

    A member has few leaders, but a leader may have any number of members: the pairs of such a leader are dealt to cells of
    about ``HOT`` pairs, and its row is copied to each.
    """
    def of(side: str) -> DataFrame:
        return known.select(F.col("key").alias(side), *[F.col(c).alias(f"{p}_{side}") for c, p in columns.items()])

    counted = with_group_facts(pairs, ["b"], salt_of(F.col("a")), {"_n": F.count(F.lit(1))}, {"_n": F.sum("_n")}, F.col("_n") > HOT)
    cell = F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("_n") / HOT)), F.lit(0)).cast("int")
    dealt = counted.withColumn("_cell", cell).drop("_n")
    leaders = dealt.select("b", "_cell").distinct().join(of("b"), "b")
    return dealt.join(of("a"), "a").join(leaders, ["b", "_cell"]).drop("_cell")


def surviving_stars(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of members and their leaders that pass the sequential comparison, written once."""

    @F.arrow_udf("int")
    def matches(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, b, n_a, n_b in columns:
            yield pa.array(compare(_unpacked(a), _unpacked(b), n_a.to_numpy(), n_b.to_numpy()), pa.int32())

    pairs = members.filter("key != leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    found = with_both(pairs, classes, {"n": "n", "signature": "s"}).select("a", "b", matches("s_a", "s_b", "n_a", "n_b").alias("matches"))
    return materialise(found.filter("matches >= 0").select("a", "b"), "stars")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def full_sets(keys: DataFrame, classes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(key, shingles) of the classes in ``keys``, written once.

    Only one document of each class is shingled again; a bit filter of bounded size finds them in the scan. What it lets
    through beyond them, the join drops.
    """
    wanted = classes.join(keys, "key").select("key", "doc_id")
    roots = wanted.select("doc_id")
    count = roots.count()
    bits = 1 << min(max((16 * count).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = roots.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )
    filled = np.zeros(bits // 64, np.uint64)
    for row in words.collect():  # at most 2**24 / 64 rows
        filled[row["word"]] = np.uint64(row["bits"] & (2**64 - 1))
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("struct<key:binary,shingles:binary>")
    def shingled(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = shared.value
        for column, place in columns:
            at = place.to_numpy()
            wanted = (known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            chosen = pa.array(np.flatnonzero(wanted))
            rows: list[dict | None] = [None] * len(column)
            sets = (s for texts in T.chunks(column.take(chosen)) for s in shingle_sets(texts, length))
            for k, s in zip(chosen.to_pylist(), sets):
                if len(s):
                    rows[k] = {"key": set_key(s), "shingles": s.tobytes()}
            yield pa.array(rows, pa.struct([("key", pa.binary()), ("shingles", pa.binary())]))

    full = docs.select(shingled("text", bit).alias("of")).filter("of is not null").select("of.key", "of.shingles")
    full = full.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    with batches_of(docs.sparkSession, TEXT_ROWS):
        return materialise(full.select("key", "shingles"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets, as links (u, v), written once."""

    @F.arrow_udf("boolean")
    def close(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in columns:
            yield pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b)], pa.bool_())

    sided = with_both(pairs.select("a", "b"), sets, {"shingles": "x"})
    links = sided.filter(close("x_a", "x_b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    with batches_of(pairs.sparkSession, PAIR_ROWS):
        return materialise(links, "links")


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """Add the component of a node column; nodes without links are their own."""
    known = labels.select(F.col("node").alias(column), F.col("component").alias("_label"))
    return rows.join(known, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")


class Joined:
    """Components that a block has joined so far."""

    def __init__(self):
        self.parent: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: bytes, y: bytes) -> None:
        self.parent[self.root(x)] = self.root(y)


def meetings(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(place, home, key, component, mask): where the members of buckets with several components meet.

    The buckets of a cluster have much the same members in all bands. So of the buckets whose largest component (home) is the
    same, the largest one of each band share one place, and every other bucket has a place of its own. ``mask`` tells the
    bands by which a member came to its place.
    """
    placed = _labelled(members.select("bucket", "key").distinct(), "key", labels, "component")
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("home")
    ).filter("parts > 1").select("bucket", "all", F.col("home.component").alias("home"))
    first = mixed.groupBy("home", F.col("bucket").bitwiseAND(63)).agg(F.max(F.struct("all", "bucket")).alias("of"))
    shared = first.select(F.col("of.bucket").alias("bucket"), F.hex("home").alias("_shared"))
    places = mixed.join(shared, "bucket", "left").select(
        "bucket", "home", F.coalesce("_shared", F.concat(F.lit("bucket "), F.col("bucket").cast("string"))).alias("place")
    )
    rows = spread_join(placed, places, ["bucket"], salt_of(F.col("key")))
    band = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket").bitwiseAND(63).cast("int"))
    return rows.groupBy("place", "key").agg(F.first("home").alias("home"), F.first("component").alias("component"), F.bit_or(band).alias("mask"))


def links_across(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between members of one bucket in different components, fewer than a block has members.

    Where buckets have several components, the members outside the home (pivots) meet all members of other components.
    Both are dealt to blocks, and each block of pivots meets each block of members in a task of its own, which takes each
    pair in the first band that both share, compares signatures in place, and verifies the survivors on full sets, the
    likeliest first, as long as their components are apart.
    """
    rows = materialise(meetings(members, labels).join(classes.select("key", "n"), "key"), "meetings")
    away = F.col("component") != F.col("home")
    blocks = rows.groupBy("place").agg(
        F.greatest(F.ceil(F.count_if(away) / PIVOTS), F.ceil(F.sum(F.when(away, F.col("n"))) / BLOCK_SHINGLES)).cast("int").alias("pivot_blocks"),
        F.greatest(F.ceil(F.count(F.lit(1)) / OTHERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("other_blocks"),
    )
    rows = spread_join(rows, blocks, ["place"], salt_of(F.col("key"))).withColumn("away", away)
    rows = rows.join(classes.select("key", "signature"), "key").join(sets, "key")
    mine = lambda count: F.pmod(F.xxhash64("key"), F.col(count)).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # In a place of one block a pivot is there once, as one of the others.
    single = (F.col("pivot_blocks") == 1) & (F.col("other_blocks") == 1)
    pivots = rows.filter(away & ~single).select("*", F.lit(True).alias("pivot"), F.lit(False).alias("other"), mine("pivot_blocks").alias("i"), upto("other_blocks").alias("j"))
    others = rows.select("*", (single & away).alias("pivot"), F.lit(True).alias("other"), upto("pivot_blocks").alias("i"), mine("other_blocks").alias("j"))
    cells = pivots.unionByName(others).select(
        "place", "i", "j", "pivot", "other", "away", "key", "component", "mask", "n", "signature", "shingles"
    )

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pivot, away = table.column("pivot").to_numpy(), table.column("away").to_numpy()
        key, component = table.column("key").to_pylist(), table.column("component").to_pylist()
        names = {c: k for k, c in enumerate(sorted(set(component)))}
        group = np.array([names[c] for c in component])
        order = np.empty(len(key), np.int64)
        order[sorted(range(len(key)), key=key.__getitem__)] = np.arange(len(key))
        sizes, mask, sign = table.column("n").to_numpy(), table.column("mask").to_numpy(), _unpacked(table.column("signature").combine_chunks())
        bands = sign.reshape(len(key), BANDS, ROWS)
        other = np.flatnonzero(table.column("other").to_numpy())
        pairs: list[np.ndarray] = []
        for p in np.flatnonzero(pivot):
            # Two members away from home are both pivots: the lesser key keeps the pair.
            at = other[(group[other] != group[p]) & (~away[other] | (order[other] > order[p])) & ((mask[other] & mask[p]) != 0)]
            alike = (bands[at] == bands[p]).all(2)
            first = alike.argmax(1)
            at = at[alike.any(1) & ((mask[at] & mask[p]) >> first & 1 == 1)]
            got = compare(sign[np.full(len(at), p)], sign[at], sizes[np.full(len(at), p)], sizes[at])
            at, got = at[got >= 0], got[got >= 0]
            if len(at):
                pairs.append(np.stack([got, np.full(len(at), p), at]))
        u, v = [], []
        if pairs:
            matches, one, two = np.concatenate(pairs, axis=1)
            shingles, joined = table.column("shingles").combine_chunks(), Joined()
            held = lambda k: np.frombuffer(shingles[int(k)].as_buffer(), np.uint64)
            for k in np.lexsort((order[two], order[one], -matches)):
                a, b = one[k], two[k]
                if joined.root(component[a]) != joined.root(component[b]) and similar(held(a), held(b)):
                    joined.join(component[a], component[b])
                    u.append(key[a])
                    v.append(key[b])
        return pa.table({"u": u, "v": v}, schema=pa.schema([("u", pa.binary()), ("v", pa.binary())]))

    return materialise(cells.groupBy("place", "i", "j").applyInArrow(meet, "u binary, v binary"), "across")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, key (of its set), component_id, and digest (of its text)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), signed(F.col("text"), shingle).alias("of"))
    table = materialise(read.select("doc_id", "digest", "of.*"), "signed")
    classes = materialise(
        table.filter("key is not null").groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    members = materialise(buckets(classes), "members")
    sets = full_sets(members.select("key").distinct(), classes, docs, shingle)
    links = verified(surviving_stars(members, classes), sets)
    labels = materialise(components(links), "labels")
    across = links_across(members, labels, classes, sets)
    if not across.isEmpty():
        labels = materialise(components(links.unionByName(across)), "labels")
    named = _labelled(classes.select("key", "doc_id"), "key", labels, "component")
    least = with_group_facts(named, ["component"], salt_of(F.col("key")), {"component_id": F.min("doc_id")}, {"component_id": F.min("component_id")})
    of_class = materialise(least.select("key", "component_id"), "named")
    joined = spread_join(table.select("doc_id", "digest", "n", "key"), of_class, ["key"], salt_of(F.col("doc_id")), "left")
    return joined.select(
        "doc_id", "digest", F.col("n").alias("n_shingles"), "key",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def is_kept(doc_id: Column, component_id: Column) -> Column:
    """The document with the least id of its component stays; if no id is known there, all stay."""
    return F.coalesce(doc_id == component_id, component_id.isNull())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; all columns stay.

    A row is named by its id, null or not, and the digest of its text, so of rows that share an id only copies go.
    """
    found = near_duplicates(docs, id_col, text_col, shingle)
    lost = found.filter(~is_kept(F.col("doc_id"), F.col("component_id"))).select("doc_id", "digest").distinct()
    drop, digest = fresh(docs, "_drop"), fresh(docs, "_digest")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(drop)) & (text_digest(F.col(f"`{text_col}`").cast("string")) == F.col(digest))
    return docs.join(lost.select(F.col("doc_id").alias(drop), F.col("digest").alias(digest)), same, "left_anti")
