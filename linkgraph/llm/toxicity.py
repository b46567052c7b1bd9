"""Toxicity scores: Levenshtein automata over a lexicon trie, and windows of context.

The lexicon holds whole words.  It starts from a short list and learns further ones from labelled
documents.  A word that isn't in it goes through the intersection of the lexicon's trie with the
Levenshtein automaton of the word: states are sets of (trie node, edits), made deterministic as words
need them, so that most words die after a few table look-ups.  The trie also holds learned stems
(beginnings of 5 to 8 letters, written ``stem*``), for languages that inflect: the automaton accepts a
word as soon as what it has read is within the edits of a stem, whatever follows.  A word takes the
nearest whole term, or else the stem that weighs most.

Each hit is weighed by the words around it: between quotation marks or near words of reporting it
counts less, next to a second person it counts more.  A logistic model over a document's hits gives
the score.  Terms and model are fitted on disjoint parts of the labelled sample, and fuzzy hits of
a term count by how often they were right there.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import fresh, held, map_arrow, materialize

#: Terms that the lexicon has without any labels, and the weight they have then.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard")
SEED_WEIGHT = 4.0
#: Words near a hit that make it a report of speech, and words that make it an address.
REPORTING = frozenset("said says say wrote writes quoted quote quotes called calls word words term terms example reported allegedly dit sagte schrieb dijo".split())
ADDRESS = frozenset("you your youre u ur yourself du dich tu te toi vous usted".split())
WINDOW, QUOTED, REPORTED, ADDRESSED = 5, 0.4, 0.7, 1.15
#: Labelled documents that a fit takes at most (those that a hash of doc_id puts first); documents a
#: term must be in, copies counted once; weight from which a term is learned; letters of a stem.
SAMPLE, SUPPORT, LEAST, STEM = 16_384, 8, 1.2, (5, 8)
#: Edits that stems allow, and the letters from which they do.
STEM_EDITS, STEM_FROM = 1, 7
#: Weight from which hits count as strong and words may get fuzzy matches; words that a worker remembers.
STRONG, REMEMBERED = 2.0, 300_000
#: Automaton states that a worker keeps, and (trie node, edits) pairs in them; when full, all are forgotten.
STATES, PAIRS = 20_000, 400_000
THRESHOLD = 0.3

WORD = regex.compile(r"[^\W_]+")
QUOTES = regex.compile("[\"“”«»„]")


class FuzzyTrie:
    """Levenshtein automata intersected with the trie of some terms, determinised step by step."""

    def __init__(self, terms: Iterable[str], weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.reach = [0]  # most edits of any term below a node
        self.stem: list[str | None] = [None]
        for t in terms:
            begins = t.endswith("*")
            allowed, node = self.edits(t), 0
            for ch in t.removesuffix("*"):
                self.reach[node] = max(self.reach[node], allowed)
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.children[node][ch]
            self.reach[node] = max(self.reach[node], allowed)
            (self.stem if begins else self.term)[node] = t
        self.alphabet = {ch for c in self.children for ch in c}
        self._begin()

    def _begin(self) -> None:
        """Forget all states but the first."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, str] | None] = []
        self.begun: list[list[tuple[int, str]]] = []
        self.pairs = 0
        self.start = self._state({(0, 0)})

    @staticmethod
    def edits(term: str) -> int:
        """The edits that a term allows; a stem, which says less, allows STEM_EDITS from STEM_FROM letters on."""
        if term.endswith("*"):
            return STEM_EDITS if len(term) > STEM_FROM else 0
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # skipping a letter of the term is an edit that reads nothing
            node, edits = todo.pop()
            if edits > self.reach[node] or least.get(node, 9) <= edits:
                continue
            least[node] = edits
            todo.extend((c, edits + 1) for c in self.children[node].values())
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.pairs += len(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= self.edits(self.term[n])]
            self.accept.append(min(ends) if ends else None)
            self.begun.append([(e, self.stem[n]) for n, e in key if self.stem[n] and e <= self.edits(self.stem[n])])
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        pairs = set()
        for node, edits in self.sets[state]:
            pairs.add((node, edits + 1))
            for c, child in self.children[node].items():
                pairs.add((child, edits + (c != ch)))
        to = self._state(pairs)
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest whole term within its allowed edits, ties to the first by name; where
        there is none, of the stem that the word begins with and that weighs most after its edits, exact ones
        before others."""
        if len(self.sets) > STATES or self.pairs > PAIRS:
            self._begin()
        state, alphabet, begun = self.start, self.alphabet, set()
        for ch in word:
            if ch not in alphabet:
                ch = "\0"
            to = self.moves[state].get(ch)
            if to is None:
                to = self._step(state, ch)
            if not self.sets[to]:
                break
            state = to
            begun.update(self.begun[state])
        else:
            if self.accept[state]:
                return self.accept[state]
        return min(begun, key=lambda b: (b[0], -self.weights.get(b[1], 0.0), b[1])) if begun else None


@dataclass
class Model:
    """What is shipped to the workers: the terms of a sample and some numbers.  ``key`` tells models apart."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_TERMS, SEED_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    fuzzy: tuple[str, ...] = SEED_TERMS
    trust: dict[str, float] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: intercept, then a coefficient for each feature
    coefficients: tuple[float, ...] = (-3.0, 0.5, 0.5, 0.5, 0.2, 0.0)


class Matcher:
    """Finds lexicon hits in texts."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = {w: model.words[w] for w in model.fuzzy if model.words.get(w, 0.0) >= STRONG} | {f"{t}*": w for t, w in model.stems.items()}
        self.fuzzy = FuzzyTrie(self.weights, self.weights)
        self.known: dict[str, tuple[float, str] | None] = {}

    def _lookup(self, word: str) -> tuple[float, str] | None:
        """(weight, '' or the term that it misspells) of a word."""
        exact = self.model.words.get(word, 0.0)
        if exact:
            return exact, ""
        found = self.fuzzy.match(word) if len(word) >= 4 else None
        if not found:
            return None
        edits, term = found
        # a stem that stands there as it is counts as the lexicon's own
        return self.weights[term] * 0.8**edits, "" if term.endswith("*") and not edits else term

    def hits(self, text: str) -> tuple[int, list[float], list[tuple[float, str]]]:
        """Words, weights of the exact hits, and (weight, term) of the fuzzy ones, in context."""
        lowered = text.lower()
        words = WORD.findall(lowered)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = {}
        for w in set(words):
            if w in known:
                hit = known[w]
            else:
                hit = known[w] = self._lookup(w)
            if hit:
                found[w] = hit
        if not found:
            return len(words), [], []
        exact, fuzzy = [], []
        spans = [m.span() for m in WORD.finditer(lowered)]
        marks = np.array([m.start() for m in QUOTES.finditer(lowered)])
        for i, w in enumerate(words):
            if w not in found:
                continue
            weight, term = found[w]
            low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            near = words[low:i] + words[i + 1 : high]
            if len(marks):
                s, e = spans[i]
                before = np.searchsorted(marks, s) - np.searchsorted(marks, spans[low][0] - 1)
                after = np.searchsorted(marks, spans[high - 1][1] + 1, "right") - np.searchsorted(marks, e)
                if before == 1 and after == 1:
                    weight *= QUOTED
            if not REPORTING.isdisjoint(near):
                weight *= REPORTED
            if not ADDRESS.isdisjoint(words[max(0, i - 2) : i + 3]):
                weight *= ADDRESSED
            if term:
                fuzzy.append((weight, term))
            else:
                exact.append(weight)
        return len(words), exact, fuzzy


def features(words: int, exact: Sequence[float], fuzzy: Sequence[tuple[float, str]], trust: dict[str, float]) -> list[float]:
    weights = [*exact, *(w * trust.get(t, 2 / 3) for w, t in fuzzy if trust.get(t, 2 / 3) >= 0.5)]
    strong = sum(w >= STRONG for w in weights)
    return [max(weights, default=0.0), math.log1p(sum(weights)), math.log1p(strong), min(10.0, 100.0 * strong / max(words, 1)), math.log1p(words)]


def probability(model: Model, hits: tuple[int, list[float], list[tuple[float, str]]]) -> float:
    z = model.coefficients[0] + sum(c * x for c, x in zip(model.coefficients[1:], features(*hits, model.trust), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, ...]:
    """Coefficients of a ridge logistic regression by Newton's method on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = penalty * np.diag([0.0, *[1.0] * x.shape[1]])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(b[0] - (b[1:] * mean / scale).sum()), *(b[1:] / scale).tolist())


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _train_ids(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic, part of the labelled rows that a fit may see, at most ``sample`` of them."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    return rows.orderBy(order, "doc_id").limit(sample).withColumn("part", F.pmod(F.shiftright(order, 7), F.lit(2)).cast("int"))


def _terms(text: str | None) -> set[str]:
    """The words of a text, each ended by a blank, and their beginnings of STEM letters."""
    out = set()
    for w in set(WORD.findall((text or "").lower())):
        out.add(w + " ")
        out.update(w[:n] for n in range(STEM[0], min(len(w), STEM[1]) + 1))
    return out


def signature(text: str | None) -> int:
    """The least hash of a text's words: copies, and most near copies, have one in common."""
    return min((xxhash.xxh64_intdigest(w) for w in set(WORD.findall((text or "").lower()))), default=0) >> 1


def _count_terms(only: frozenset[str] | None):
    """(term, signature) of each text, and ('', signature) for the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, signatures = [], []
            for text in batch.column(0):
                found = _terms(text.as_py())
                found = [*(found if only is None else found & only), ""]
                terms += found
                signatures += [signature(text.as_py())] * len(found)
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "signature": pa.array(signatures, pa.int64())})

    return run


def _counts(texts: DataFrame, only: frozenset[str] | None, least: int) -> dict[str, int]:
    """In how many texts, copies counted once, each term is, from ``least`` on; '' stands for all texts."""
    pairs = map_arrow(texts.select("text"), _count_terms(only), "term string, signature long").distinct()
    counted = pairs.groupBy("term").agg(F.count("*").alias("n"))
    return {r.term: r.n for r in counted.where((F.col("n") >= least) | (F.col("term") == "")).collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn terms and model from the labelled rows of ``docs`` outside the held-out fold.

    At most ``sample`` rows are taken, those that a hash puts first: one half teaches terms, the
    other the model.  They are written once, so the documents are read once here.  What comes to the
    driver is bounded by the sample: counts of the terms in SUPPORT or more of its toxic texts, and a
    few numbers a row.  With too few labels of either kind the list and default numbers stand.
    """
    ids = _train_ids(labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(F.broadcast(ids), "doc_id")  # sample rows of 16 bytes at most
    tasks = max(4, docs.sparkSession.sparkContext.defaultParallelism)
    rows = materialize(rows.select("text", F.col("toxic").cast("int").alias("toxic"), "part").repartition(tasks), "sample")
    model = Model()
    part = rows.where("part = 0")
    # a text that stands there a thousand times, or nearly so, says what it says once
    bad = _counts(part.where("toxic = 1"), None, SUPPORT)
    good = _counts(part.where("toxic = 0"), frozenset(bad), 1)
    toxic, clean = bad.pop("", 0), good.pop("", 0)
    if toxic < SUPPORT or clean < SUPPORT:
        return model
    rate = toxic / (toxic + clean)
    learned = {}
    for term, n in bad.items():
        odds = (n + 4 * rate) / (good.get(term, 0) + 4 * (1 - rate))
        weight = math.log(odds * (1 - rate) / rate)
        if weight >= LEAST and (odds >= 0.35 or weight >= STRONG):
            learned[term] = weight
    for t, weight in sorted(learned.items()):
        if t.endswith(" "):
            model.words[t[:-1]] = weight
        else:
            model.stems[t] = weight
    for t in SEED_TERMS:  # labels overrule the list where they know its terms
        n, m = bad.get(t + " ", 0), good.get(t + " ", 0)
        if n + m >= 10 and t + " " not in learned:
            del model.words[t]
    strong = [t[:-1] for t, weight in learned.items() if t.endswith(" ") and t[:-1].isalpha() and len(t) > 5 and weight >= STRONG]
    model.fuzzy = tuple(sorted({*SEED_TERMS, *strong}))
    fields = "toxic int, words int, exact array<double>, weights array<double>, terms array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            found = [matcher.hits(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.list_(pa.float64())),
                    pa.array([[w for w, _ in f[2]] for f in found], pa.list_(pa.float64())),
                    pa.array([[t for _, t in f[2]] for f in found], pa.list_(pa.string())),
                ],
                ["toxic", "words", "exact", "weights", "terms"],
            )

    second = map_arrow(rows.where("part = 1").select("text", "toxic"), run, fields).collect()  # sample / 2 rows or so
    y = np.array([r.toxic for r in second], float)
    if y.sum() < SUPPORT or (1 - y).sum() < SUPPORT:
        return model
    right: Counter[str] = Counter()
    all_: Counter[str] = Counter()
    for r in second:
        if not any(w >= STRONG for w in r.exact):
            for t in set(r.terms):
                all_[t] += 1
                right[t] += r.toxic
    model.trust = {t: (right[t] + 2) / (n + 3) for t, n in all_.items()}
    x = np.array([features(r.words, r.exact, list(zip(r.weights, r.terms, strict=True)), model.trust) for r in second])
    model.coefficients = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append ``out``: the probability (double) that a text is toxic.

    Whole texts count.  A null text scores like an empty one; other columns are carried as they are,
    and one named like ``out`` is replaced.  Repeated texts have equal scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # terms of the sample
    kept, last = [c for c in docs.columns if c.lower() != out.lower()], fresh(docs, "_text")
    slim = docs.select(*kept, F.col(text).alias(last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        matcher = held(f"matcher {model.key}", lambda: Matcher(model))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = [probability(matcher.model, matcher.hits(t.as_py() or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*kept, out])

    return map_arrow(slim, run, slim.drop(last).schema.add(out, "double"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted.  A null doc_id has no label and isn't held out."""
    rows = docs.select("doc_id", "text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return score(rows, fit(rows, labels)).select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns."""
    columns = docs.columns
    name = fresh(docs, "_score")
    return score(docs, fit(docs, labels), out=name).where(F.col(name) < threshold).select(*columns)
