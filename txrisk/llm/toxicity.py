"""Toxicity scoring: Levenshtein automata over a lexicon trie, weighed by the context of each hit.

Lexicon. Terms are whole words, or stems that any ending may follow. They are learnt from labelled documents: words, and
word beginnings found at least twice in a text, that mark toxic and hardly any clean ones are chosen greedily, each
for the toxic documents that no earlier term explains. Words that only travel with a copied text are therefore not chosen once a real term explains
their documents. A few general terms are always in.

Hits. A word meets a term exactly, as a stem, or within one or two edits (long terms only): an automaton accepts what
lies within that distance of the word, and it walks the trie of terms, so all terms are tried at once and branches
that cannot match are cut.

Context. Hits in a window with quotation marks around them or a reporting verb near them count as quoted, hits near
a second-person pronoun as aimed at someone. A logistic model with a prior that holds without any labels turns the
counts into a score.

Fitting uses at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean labelled documents, those with the smallest hashes of
their ids: the documented bound of the sample. Scoring reads every whole text.

Defined cases: a null or empty text has no hits and gets the score of such texts; conflicting labels of one document
count as toxic; null labels are ignored; with no labels the general terms and the prior decide; repeated rows are scored
alike; a text of any length is read whole; terms of equal worth are taken words first, then the longest, then the last
by name; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm import text as T
from txrisk.llm.common import materialise, worker_slot

FIT_TOXIC = 4_000
FIT_CLEAN = 16_000
COUNTED = 500_000  # features a task counts before it passes them on
STEMS = range(4, 9)
MIN_SUPPORT = 3
PRECISION = 0.8
WINDOW = 8  # words on either side that make the context of a hit
THRESHOLD = 0.7
MEMO = 50_000  # looked-up words that a worker remembers

# General insults, reporting verbs and second-person words in the languages of the tables.
GENERAL = "idiot moron stupid scum loser pathetic worthless disgusting trash clown imbecile dumbass".split()
REPORTING = set("said says say called calls wrote writes quoted quote quotes word term sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
SECOND_PERSON = set("you your yours u ur du dich dir dein ihr euch tu toi te vous tes vos tú ti usted ustedes".split())
QUOTES = '"“”„«»‹›'

FEATURES = ("plain", "quoted", "one_edit", "two_edits", "aimed", "stem", "more_stems")
PRIOR_BIAS = -3.5
PRIOR = np.array([5.0, 1.0, 1.5, 0.7, 1.5, 1.0, 2.5])


def edits(length: int) -> int:
    """How many edits a whole term of this length may be away."""
    return 0 if length < 5 else 1 if length < 8 else 2


class Automaton:
    """Levenshtein automaton of a word: a state lists the reachable positions with the edits spent on them."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((k, k) for k in range(min(self.most, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        best: dict[int, int] = {}

        def reach(at: int, cost: int) -> None:
            if at <= len(self.word) and cost <= self.most and cost < best.get(at, self.most + 1):
                best[at] = cost

        for at, cost in state:
            reach(at, cost + 1)  # the term has a letter more
            if at < len(self.word):
                reach(at + 1, cost + (self.word[at] != char))
        for at in range(len(self.word)):  # the word has letters more
            if at in best:
                reach(at + 1, best[at] + 1)
        return tuple(sorted(best.items()))

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Edits between the word and what was read, if within the limit."""
        return dict(state).get(len(self.word))


@dataclass
class Node:
    children: dict[str, "Node"] = field(default_factory=dict)
    term: str | None = None
    whole: bool = False
    stem: bool = False


class Lexicon:
    """Terms in a trie, with cheap tests on bytes that decide which words are looked up at all."""

    def __init__(self, words: set[str], stems: set[str]):
        self.words, self.stems = set(words), set(stems)
        self.root = Node()
        for term in sorted(self.words | self.stems):
            node = self.root
            for char in term:
                node = node.children.setdefault(char, Node())
            node.term, node.whole, node.stem = term, term in self.words, term in self.stems
        self.heads = {4: set(), 3: set(), 2: set(), 1: set()}
        for term in self.words | self.stems:
            head = term.encode()[:4]
            self.heads[len(head)].add(int.from_bytes(head.ljust(4, b"\0"), "little"))
        masks: dict[tuple[int, int], set[int]] = {}
        for term in self.words:
            if edits(len(term)):
                masks.setdefault((len(term), edits(len(term))), set()).add(letter_mask(term))
        self.masks = {k: np.array(sorted(v), np.uint32) for k, v in masks.items()}
        self.name = hash((frozenset(self.words), frozenset(self.stems)))

    def lookup(self, word: str) -> int:
        """0: no hit; 1: a term; 2, 3: one or two edits from a term; 5: a stem and its ending."""
        node, best = self.root, 0
        for k, char in enumerate(word):
            node = node.children.get(char)
            if node is None:
                break
            if node.whole and k == len(word) - 1:
                return 1
            if node.stem:
                best = 5
        if best:
            return best
        automaton = Automaton(word, 2)
        todo = [(self.root, automaton.start())]
        while todo:
            node, state = todo.pop()
            if node.whole:
                far = automaton.distance(state)
                if far is not None and 0 < far <= edits(len(node.term)):
                    best = min(best or 9, 1 + far)
            for char, child in node.children.items():
                after = automaton.step(state, char)
                if after:
                    todo.append((child, after))
        return best

    def kinds(self, texts: T.Texts, word: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that hit, and the kind of each hit."""
        size = word.end - word.begin
        padded = np.concatenate([texts.raw, np.zeros(4, np.uint8)])
        head = np.zeros(len(size), np.uint32)
        near = np.zeros(len(size), bool)
        for k in range(4):
            byte = padded[word.begin + k].astype(np.uint32) << np.uint32(8 * k)
            head |= np.where(size > k, byte, 0).astype(np.uint32)
            if self.heads[k + 1]:
                near |= np.isin(head, np.array(sorted(self.heads[k + 1]), np.uint32)) & (size > k)
        if self.masks and len(size):
            mask = np.bitwise_or.reduceat(_LETTER_BIT[padded], word.begin)  # what lies between words adds no bits
            starts = np.concatenate([[0], np.cumsum((texts.raw & 0xC0) != 0x80)])  # an edit is one of letters, not of bytes
            letters = starts[word.end] - starts[word.begin]
            for (length, far), known in self.masks.items():
                close = np.flatnonzero((letters >= length - far) & (letters <= length + far))
                for m in known:
                    near[close[np.bitwise_count(mask[close] ^ m) <= 2 * far]] = True
        at = np.flatnonzero(near)
        kind = np.zeros(len(at), np.int8)
        memo: dict[bytes, int] = worker_slot(("toxicity", self.name), dict)
        if len(memo) > MEMO:
            memo.clear()
        for k, w in enumerate(at):
            key = texts.raw[word.begin[w] : word.end[w]].tobytes()
            found = memo.get(key)
            if found is None:
                found = memo[key] = self.lookup(key.decode("utf-8", "replace"))
            kind[k] = found
        return at[kind > 0], kind[kind > 0]


_LETTER_BIT = np.zeros(256, np.uint32)
_LETTER_BIT[97:123] = np.uint32(1) << np.arange(26, dtype=np.uint32)
_LETTER_BIT[48:58] = np.uint32(1 << 26)
_LETTER_BIT[128:] = np.uint32(1 << 27)


def letter_mask(term: str) -> int:
    return int(np.bitwise_or.reduce(_LETTER_BIT[np.frombuffer(term.encode(), np.uint8)]))


def features(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """Rows of damped counts, as ``FEATURES`` names them; a stem counts once, and its further hits apart."""
    out = np.zeros((len(column), len(FEATURES)))
    base = 0
    for texts in T.chunks(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
        word = T.words(texts, T.ALNUM, lower=False)
        at, kind = lexicon.kinds(texts, word)
        for w, k in zip(at, kind):
            text = int(np.searchsorted(word.first, w, "right")) - 1
            low, high = max(word.first[text], w - WINDOW), min(word.first[text + 1], w + WINDOW + 1)
            left = texts.raw[word.begin[low] : word.begin[w]].tobytes().decode("utf-8", "replace")
            right = texts.raw[word.end[w] : word.end[high - 1]].tobytes().decode("utf-8", "replace")
            quoted = is_quoted(left, right)
            around = set(left.split()) | set(right.split())
            row = out[base + text]
            if quoted:
                row[1] += 1
            elif k == 1:
                row[0] += 1
            else:
                row[k] += 1
            if not quoted and around & SECOND_PERSON:
                row[4] += 1
        base += len(texts)
    out[:, 6] = np.maximum(out[:, 5] - 1, 0)
    out[:, 5] = np.minimum(out[:, 5], 1)
    return np.log1p(np.minimum(out, 20))


def is_quoted(left: str, right: str) -> bool:
    """An odd number of quotation marks before and one after, or a reporting verb right before."""
    marks = sum(left.count(q) for q in QUOTES)
    words = left.split()
    return (marks % 2 == 1 and any(q in right for q in QUOTES)) or bool(REPORTING & {w.strip(QUOTES + ",.:;") for w in words[-3:]})


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(rows @ self.weights + self.bias)))


def _features_of(text: str) -> set[str]:
    """Words of a text, and ``stem*`` for beginnings of longer words that occur at least twice."""
    seen: Counter[str] = Counter()
    for texts in T.chunks(pc.utf8_lower(pa.array([text], pa.large_string()))):
        word = T.words(texts, T.ALNUM, lower=False)
        seen.update(texts.raw[b:e].tobytes().decode("utf-8", "replace") for b, e in zip(word.begin, word.end))
    found = {w for w in seen if 3 <= len(w) <= 40}
    for n in STEMS:
        begun: Counter[str] = Counter()
        for w in found:
            if len(w) > n and w[-1] != "*":
                begun[w[:n]] += seen[w]
        found = found | {f"{b}*" for b, k in begun.items() if k >= 2}
    return found


def _count_features(sample: DataFrame) -> DataFrame:
    """(feature, n): in how many texts each feature occurs; tasks add up first."""

    def rows(seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(_features_of(text or ""))
                if len(seen) >= COUNTED:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return sample.select("text").mapInArrow(count, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def _candidates(toxic: DataFrame, clean: DataFrame) -> dict[str, int]:
    """Every feature that marks toxic texts well enough to be chosen, with its count in clean ones."""
    there = _count_features(toxic).filter(F.col("n") >= MIN_SUPPORT)
    wrong = _count_features(clean).withColumnRenamed("n", "clean")
    both = there.join(wrong, "feature", "left").select("feature", "n", F.coalesce("clean", F.lit(0)).alias("clean"))
    good = both.filter(F.col("n") - 2 * F.col("clean") >= MIN_SUPPORT).filter(
        F.col("n") / (F.col("n") + F.col("clean") + F.lit(0.02)) >= PRECISION
    )
    return {r["feature"]: r["clean"] for r in good.collect()}  # of at most FIT_TOXIC texts


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of at most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled documents, chosen by a hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col(label_col) != 0).cast("int")).alias("toxic")
    )
    order = F.xxhash64(F.col("id").cast("string"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = []
    for y, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        # The least hashes lie below a bound that leaves about twice as many as are taken: little is sorted.
        bound = int(min(1.0, (2 * most + 1000) / max(1, totals.get(y, 0))) * 2**64) - 2**63
        mine = known.filter((F.col("toxic") == y) & (order <= min(bound, 2**63 - 1)))
        chosen.append(mine.orderBy(order, "id").limit(most))
    ids = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "id").select("text", "toxic")  # bounded: two limits


def _choose_terms(toxic: DataFrame, candidates: dict[str, int]) -> list[str]:
    """Greedy cover of the toxic texts by candidates; ``candidates`` has each one's count in clean texts."""
    names = sorted(candidates)
    at = {n: k for k, n in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(at[f] for f in _features_of(t or "") if f in at) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["has"])

    rows = [r["has"] for r in toxic.select("text").mapInArrow(present, "has array<int>").collect()]  # at most FIT_TOXIC rows
    holders: dict[int, set[int]] = {}
    for k, row in enumerate(rows):
        for c in row:
            holders.setdefault(c, set()).add(k)
    # Ties go to words, then to the longest, then to the last by name. Worths only fall, so an entry whose worth still
    # holds when it is on top is the best one.
    order = sorted(holders, key=lambda c: (not names[c].endswith("*"), len(names[c]), names[c]), reverse=True)
    heap = [(2 * candidates[names[c]] - len(holders[c]), place, c) for place, c in enumerate(order)]
    heapq.heapify(heap)
    chosen, open_rows = [], set(range(len(rows)))
    while heap and -heap[0][0] >= MIN_SUPPORT:
        was, place, c = heapq.heappop(heap)
        holders[c] &= open_rows
        now = 2 * candidates[names[c]] - len(holders[c])
        if now > was:
            heapq.heappush(heap, (now, place, c))
            continue
        chosen.append(names[c])
        open_rows -= holders[c]
    return chosen


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Lexicon and weights from labelled documents; ``labels`` has already been cut to those one may learn from."""
    sample = materialise(sample_labelled(docs, labels, id_col, text_col, label_col), "toxicity")
    toxic, clean = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    candidates = _candidates(toxic, clean)
    terms = _choose_terms(toxic, candidates) if candidates else []
    lexicon = Lexicon({t for t in terms if not t.endswith("*")} | set(GENERAL), {t[:-1] for t in terms if t.endswith("*")})
    rows = _with_features(sample, lexicon)
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r["toxic"] for r in rows], float)
    weights, bias = _logistic(x, y)
    return Model(lexicon, weights, bias)


def _with_features(sample: DataFrame, lexicon: Lexicon) -> list:
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("array<double>")
    def measure(column: pa.Array) -> pa.Array:
        return pa.array(list(features(shared.value, column)), pa.list_(pa.float64()))

    return sample.select("toxic", measure("text").alias("x")).collect()  # at most FIT_TOXIC + FIT_CLEAN short rows


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 2.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic model whose weights are pulled to the prior ones."""
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    if not len(y):
        return w[:-1], float(w[-1])
    full = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - y) + strength * (w - prior)
        hess = (full * (p * (1 - p))[:, None]).T @ full + strength * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move / max(1.0, float(np.abs(move).max()))
    w[:2] = np.maximum(w[:2], 0.0)
    return w[:-1], float(w[-1])


def scored(model: Model, text: Column, spark) -> Column:
    """Score column (0 to 1) for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for column in columns:
            yield pa.array(known.score(features(known.lexicon, column)))

    return score(text.cast("string"))
