"""Toxicity by a lexicon that is learned from labels and matched with spelling mistakes.

The lexicon holds words, and stems where many words share a beginning. Its trie is intersected with Levenshtein automata:
a state is the set of trie nodes that can be reached with so many edits, made deterministic as words are read. Hits count
by what their term, at that distance, tells about the labels. A window of words around each hit decides whether it stands
inside quotation marks; quoted and unquoted evidence are weighed apart by a small logistic regression.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.operators.settle import settle

# Labelled documents the model is fitted on, at most about so many: a sample by hash of the doc_id.
TRAIN_ROWS = 20_000
MAX_TERMS = 500
STEM_LENGTHS = range(4, 9)
LEAST_ODDS = 2.5
LEAST_DOCS = 3
WINDOW = 6

# Weights of unquoted, quoted and strongest evidence that the regression is drawn to where the labels say nothing.
PRIOR = np.array([-4.0, 8.0, 1.0, 5.0])

_OPEN, _CLOSE = "\"'“„«‹‘‚", "\"'”“»›’‘"
_CLOSING = frozenset(_CLOSE)
_STRIP = string.punctuation + "“”„«»‹›‘’‚…–—¿¡"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def bare(token: str) -> str:
    """A token as the lexicon has it: lower case, without the marks around it."""
    return token.lower().strip(_STRIP)


@dataclass
class Term:
    text: str
    stem: bool
    weights: list[float]  # by number of edits

    @property
    def edits(self) -> int:
        return len(self.weights) - 1


def most_edits(text: str, stem: bool) -> int:
    """Short terms have too many neighbours to be matched with mistakes."""
    size = len(text) - 2 * stem
    return 0 if size < 5 else 1 if size < 9 else 2


class Matcher:
    """The lexicon's trie under Levenshtein automata, made deterministic state by state as it is used."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]
        self.ends: dict[int, list[int]] = defaultdict(list)
        for k, term in enumerate(terms):
            node = 0
            self.budget[0] = max(self.budget[0], term.edits)
            for ch in term.text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], term.edits)
            self.ends[node].append(k)
        self.alphabet = set("".join(t.text for t in terms))
        self.numbers: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.at_end: list[list[tuple[int, int]]] = []
        self.anywhere: list[list[tuple[int, int]]] = []
        self.start = self._state({0: 0})
        self.known: dict[str, tuple[tuple[int, int], ...]] = {}

    def _state(self, reached: dict[int, int]) -> int:
        """The number of a set of (node, edits), after adding what can be reached by leaving letters out."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = reached[node] + 1
                if edits <= self.budget[child] and edits < reached.get(child, 99):
                    reached[child] = edits
                    todo.append(child)
        key = frozenset(reached.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(reached)
            self.next.append({})
            found = [(k, e) for n, e in reached.items() for k in self.ends.get(n, ()) if e <= self.terms[k].edits]
            self.at_end.append([(k, e) for k, e in found if not self.terms[k].stem])
            self.anywhere.append([(k, e) for k, e in found if self.terms[k].stem])
        return self.numbers[key]

    def _step(self, state: int, ch: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.states[state].items():
            if edits < self.budget[node]:
                reached[node] = min(edits + 1, reached.get(node, 99))
            for letter, child in self.children[node].items():
                cost = edits + (letter != ch)
                if cost <= self.budget[child]:
                    reached[child] = min(cost, reached.get(child, 99))
        return self._state(reached)

    def _read(self, word: str) -> tuple[tuple[int, int], ...]:
        state, best = self.start, {}
        for ch in word:
            ch = ch if ch in self.alphabet else ""
            following = self.next[state].get(ch)
            if following is None:
                following = self.next[state][ch] = self._step(state, ch)
            state = following
            if not self.states[state]:
                break
            for k, e in self.anywhere[state]:
                best[k] = min(e, best.get(k, 99))
        for k, e in self.at_end[state]:
            best[k] = min(e, best.get(k, 99))
        return tuple(sorted(best.items()))

    def match(self, token: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of all terms a token may be, each with its fewest edits."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[token] = self._read(bare(token)) if self.terms else ()
        return found


def _opens(token: str) -> bool:
    return token[0] in _OPEN


def _closes(token: str) -> bool:
    return len(token) > 1 and token.rstrip(".,;:!?")[-1:] in _CLOSING


def quoted(tokens: list[str], at: int) -> bool:
    """Whether the word stands inside quotation marks that open and close within the window around it."""
    inside = False
    for token in tokens[max(0, at - WINDOW) : at]:
        if all(c in _OPEN or c in _CLOSE for c in token):
            inside = not inside
        else:
            inside = (inside or _opens(token)) and not _closes(token)
    if not inside and not _opens(tokens[at]):
        return False
    for k, token in enumerate(tokens[at : at + WINDOW + 1]):
        if _closes(token) or all(c in _CLOSE for c in token):
            return True
        if k and _opens(token):
            return False
    return False


def evidence(text: str | None, matcher: Matcher) -> tuple[float, float, float]:
    """(sum of unquoted weights, sum of quoted ones, strongest single weight) of a text's hits."""
    tokens = (text or "").split()
    said = meant = strongest = 0.0
    match = matcher.match
    for at, token in enumerate(tokens):
        found = match(token)
        if found:
            weight = max(matcher.terms[k].weights[e] for k, e in found)
            if quoted(tokens, at):
                meant += weight
            else:
                said += weight
                strongest = max(strongest, weight)
    return said, meant, strongest


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    coefficients: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ self.coefficients, -30, 30)))


def _design(features: np.ndarray) -> np.ndarray:
    """A constant, and the weights in tens, so that long documents do not run away."""
    return np.column_stack([np.ones(len(features)), np.minimum(features, 30) / 10])


def _fit(features: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logistic regression drawn to PRIOR, by Newton steps that are halved until they gain; rows counts equal ones."""
    x, w = _design(features), PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(rows @ (np.logaddexp(0, z) - toxic * z) + ((w - PRIOR) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (rows * (p - toxic)) + (w - PRIOR)
        step = np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, before = w - step, now
        now = loss(w)
        if before - now < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fifth, about train_rows of them at most, by hash.

    A doc_id with several labels is toxic if any of them says so.
    """
    known = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    n = known.count()
    share = F.lit(int(2**32 * min(1.0, train_rows / max(n, 1))))
    sample = known.filter(F.xxhash64("doc_id").bitwiseAND(F.lit(2**32 - 1)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def _odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: in how many toxic and clean documents each word and each beginning of a word stands."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            words = {w for w in map(bare, set((text or "").split())) if len(w) > 2}
            stems = {w[:n] + "*" for w in words for n in STEM_LENGTHS if n <= len(w)}
            counts[int(toxic > 0)].update(words)
            counts[int(toxic > 0)].update(stems)
    words = list(counts[0].keys() | counts[1].keys())
    numbers = {name: np.array([counts[k][w] for w in words], np.int64) for k, name in ((1, "toxic"), (0, "clean"))}
    yield pd.DataFrame({"word": pd.Series(words, dtype=object)} | numbers)


def join_stems(candidates: list[tuple[str, int, int]]) -> list[str]:
    """(word or stem*, toxic docs, clean docs) -> stems and words worth trying.

    A stem is taken where no single word makes up most of it; of stems inside one another the shortest, lengthened as
    long as it loses next to no documents. Words that a stem covers are left out.
    """
    docs = {w: t for w, t, _ in candidates}
    words = [w for w in docs if not w.endswith("*")]
    top_word: dict[str, int] = defaultdict(int)
    for w in words:
        for n in STEM_LENGTHS:
            top_word[w[:n] + "*"] = max(top_word[w[:n] + "*"], docs[w])
    below: dict[str, list[str]] = defaultdict(list)
    for s in (w for w in docs if w.endswith("*")):
        for n in STEM_LENGTHS:
            below[s[:-1][:n]].append(s)
    stems: list[str] = []
    inside: set[str] = set()
    for s in sorted((w for w in docs if w.endswith("*")), key=lambda w: (len(w), w)):
        if top_word[s] > 0.6 * docs[s] or any(s[:n] in inside for n in STEM_LENGTHS):
            continue
        longer = [x for x in below[s[:-1]] if docs[x] >= 0.95 * docs[s]]
        inside.add(s[:-1])
        stems.append(max(longer, key=lambda x: (len(x), x)))
    covered = {s[:-1] for s in stems}
    return [*stems, *[w for w in words if not any(w[:n] in covered for n in STEM_LENGTHS)]]


def choose_terms(tried: list[str], odds: dict[str, float], toxic_docs: list[set[str]]) -> list[tuple[str, bool, float]]:
    """Terms (text, is stem, log odds) that cover the toxic documents.

    The term is taken that stands in most of them, a document counting half for each term it already has; so words that
    merely come with others, as in copies of one document, gain little and are left out.
    """
    where: dict[str, list[int]] = defaultdict(list)
    for k, doc in enumerate(toxic_docs):
        for w in doc:
            where[w].append(k)
    weight = np.ones(len(toxic_docs))
    least = max(LEAST_DOCS, 0.002 * len(toxic_docs))
    gain = {w: float(len(where[w])) for w in tried}
    chosen: list[tuple[str, bool, float]] = []
    while gain and len(chosen) < MAX_TERMS:
        best = max(gain, key=lambda w: (gain[w], odds[w], w))
        now = float(weight[where[best]].sum())
        if now < gain[best]:  # gains only fall, so an outdated one is put right when it comes up
            gain[best] = now
            continue
        if now < least:
            break
        chosen.append((best.rstrip("*"), best.endswith("*"), odds[best]))
        weight[where[best]] /= 2
        del gain[best]
    return chosen


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from documents (doc_id, text, ...) and labels (doc_id, toxic, ...).

    Only labels outside the held-out fifth are looked at. Without toxic or without clean documents there is nothing to
    learn, and the model finds nothing toxic.
    """
    rows = settle(training_rows(docs, labels, train_rows))
    sizes = {r["toxic"] > 0: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()
    counts = rows.mapInPandas(_count_words, "word string, toxic long, clean long").groupBy("word")
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    found = (
        counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .filter((F.col("t") >= LEAST_DOCS) & (odds >= LEAST_ODDS))
        .orderBy(F.desc("t"), "word")
        .limit(40 * MAX_TERMS)
        .collect()
    )
    tried = join_stems([tuple(r) for r in found])
    odds_of = {r["word"]: _odds(r["t"], r["c"], n_toxic, n_clean) for r in found}
    chosen = choose_terms(tried, odds_of, _toxic_docs(rows, set(tried)))
    terms = [Term(w, stem, [o, *[0.6 * o, 0.3 * o][: most_edits(w, stem)]]) for w, stem, o in chosen]
    _weigh_mistakes(rows, terms, n_toxic, n_clean)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms)
        for frame in frames:
            found = [evidence(t, matcher) for t in frame["text"]]
            yield pd.DataFrame(found, columns=["said", "meant", "strongest"]).assign(toxic=frame["toxic"].to_numpy())

    seen = rows.mapInPandas(features, "said double, meant double, strongest double, toxic int")
    table = seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(seen.columns)
    toxic = (table["toxic"] > 0).to_numpy(dtype=float)
    fitted = _fit(table[["said", "meant", "strongest"]].to_numpy(), toxic, table["n"].to_numpy(dtype=float))
    return Model(terms, fitted)


def _toxic_docs(rows: DataFrame, tried: set[str]) -> list[set[str]]:
    """Which of the words and stems tried stand in each toxic training document; at most the sample's documents."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = ({w for w in map(bare, set((t or "").split())) if len(w) > 2} for t in frame["text"])
            having = [sorted((ws | {w[:n] + "*" for w in ws for n in STEM_LENGTHS if n <= len(w)}) & tried) for ws in words]
            yield pd.DataFrame({"having": having})

    return [set(r["having"]) for r in rows.filter("toxic > 0").mapInPandas(found, "having array<string>").collect()]


def _weigh_mistakes(rows: DataFrame, terms: list[Term], n_toxic: int, n_clean: int) -> None:
    """Replace the assumed weights of misspelled hits by what the training documents say, where they say anything."""

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms)
        for frame in frames:
            out = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                found = {hit for t in set((text or "").split()) for hit in matcher.match(t) if hit[1]}
                out += [(k, e, int(toxic > 0)) for k, e in found]
            yield pd.DataFrame(out, columns=["term", "edits", "toxic"]).astype("int64")

    met = rows.mapInPandas(hits, "term long, edits long, toxic long").groupBy("term", "edits")
    counts = met.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()
    for r in counts:
        weights = terms[r["term"]].weights
        told = max(0.0, _odds(r["t"], r["c"], n_toxic, n_clean))
        n = r["t"] + r["c"]
        weights[r["edits"]] = min(weights[0], (2 * weights[r["edits"]] * (told > 0) + n * told) / (2 + n))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score double, predicted int), one row per row.

    Null and empty texts have the score of a text without hits. The model has at most MAX_TERMS terms and goes to the
    tasks as it is. Only doc_id and text are looked at.
    """
    schema_type = docs.schema["doc_id"].dataType.simpleString()
    terms, weights = model.terms, model.coefficients

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            found = [evidence(t, matcher) for t in batch.column(1).to_pylist()]
            values = Model(terms, weights).scores(np.array(found, float).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {schema_type}, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not call toxic, in one pass that keeps every column."""
    terms, weights = model.terms, model.coefficients
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            found = [evidence(t, matcher) for t in batch.column(at).to_pylist()]
            values = Model(terms, weights).scores(np.array(found, float).reshape(-1, 3))
            yield batch.filter(pa.array(values < 0.5))

    return docs.mapInArrow(kept, docs.schema)
