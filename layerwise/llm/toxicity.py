"""Toxicity: misspelled lexicon terms by Levenshtein automata over a trie, weighed by their context.

The lexicon's trie and the error counts of Levenshtein's automaton form one nondeterministic automaton;
it is made deterministic lazily, so that a word costs a table look-up for each letter until no term is
within reach. Each hit is looked at in a window of words: quotation marks, verbs of reporting and words
about words make it a quotation, words of address and exclamation marks make it abuse. A logistic
regression with a prior on its weights turns a document's sums into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold_of, stored, words
from .labelled import FOLDS, MAX_TRAIN, fitted_on, training_labels

#: Terms that the scan starts from; callers may pass their own.
LEXICON = (
    "bastard", "clown", "crap", "cretin", "degenerate", "disgusting", "dumb", "dumbass", "fool", "freak", "garbage", "idiot",
    "imbecile", "jerk", "loser", "maggot", "moron", "pathetic", "pig", "retard", "scum", "stupid", "trash", "vermin", "worthless",
)
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes claimed reported shouted term terms word words slur insult phrase comment".split())
ADDRESS = frozenset("you your you're youre yourself u ur he's she's they're such these those".split())
QUOTES = "\"“”„«»‘’`"
WINDOW = 8
_PART = re.compile(r"[^\W_]+")
_STATES = 20_000  # states kept of the lazy automaton
_MEMO = 300_000  # words kept with their match


@dataclass(frozen=True)
class Term:
    """A lexicon entry. stem: any ending may follow. edits: the letters that may be wrong."""

    text: str
    stem: bool = False
    edits: int = 0


def edits_for(text: str) -> int:
    """Edits that still count as this term: none under four letters, two from nine on."""
    return 0 if len(text) < 4 else 1 if len(text) < 9 else 2


SEEDS = tuple(Term(t, False, edits_for(t)) for t in LEXICON)


class LexiconAutomaton:
    """Words within each term's edit limit, by a lazily determinised product of trie and error counts.

    A state is a set of (trie node, errors so far); states are numbered as they come up.
    """

    def __init__(self, terms=SEEDS) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[Term | None] = [None]
        self.most = [0]  # the largest edit limit of any term below a node
        for term in sorted(set(terms), key=lambda t: (t.text, t.stem)):
            node = 0
            self.most[0] = max(self.most[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(-1)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], term.edits)
            self.ends[node] = term
        self.alphabet = {c for x in self.children for c in x}
        self.memo: dict[str, tuple[str, int] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.after: list[dict[str, int]] = []  # by state and letter; -1: no term is within reach
        self.stems: list[tuple[int, str] | None] = []  # the nearest stem that ends in a state
        self.wholes: list[tuple[int, str] | None] = []  # the nearest entry of any kind that ends there
        self._number(self._closed({0: 0}))

    def _closed(self, found: dict[int, int]) -> tuple:
        """Adds what is reached by leaving out letters of a term; drops what is beyond every limit."""
        queue = list(found.items())
        while queue:
            node, e = queue.pop()
            if found.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < found.get(child, 99):
                    found[child] = e + 1
                    queue.append((child, e + 1))
        return tuple(sorted((n, e) for n, e in found.items() if e <= self.most[n]))

    def _number(self, state: tuple) -> int:
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.after.append({})
            ended = [(e, t) for n, e in state if (t := self.ends[n]) and e <= t.edits]
            self.wholes.append(min(((e, t.text) for e, t in ended), default=None))
            self.stems.append(min(((e, t.text) for e, t in ended if t.stem), default=None))
        return self.numbers[state]

    def _step(self, number: int, c: str) -> int:
        found: dict[int, int] = {}
        for node, e in self.states[number]:
            if e + 1 <= self.most[node] and e + 1 < found.get(node, 99):
                found[node] = e + 1  # one letter too many
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < found.get(child, 99):
                    found[child] = cost
        got = self.after[number][c] = self._number(self._closed(found))
        return got

    def term(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its limit and its distance; of several, the first by spelling."""
        if len(self.states) > _STATES:
            self._clear()
        at, best, after, alphabet = 0, None, self.after, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""
            got = after[at].get(c)
            at = self._step(at, c) if got is None else got
            if at < 0:
                break
            stem = self.stems[at]
            if stem and (best is None or stem < best):
                best = stem
        else:
            whole = self.wholes[at]
            if whole and (best is None or whole < best):
                best = whole
        return best and (best[1], best[0])

    def match(self, word: str) -> tuple[str, int] | None:
        """As term(), for the best of the letter runs in a word of a text."""
        memo = self.memo
        if word in memo:
            return memo[word]
        best = None
        for part in _PART.findall(word.lower()):
            got = self.term(part)
            if got and (best is None or got[1] < best[1]):
                best = got
        if len(memo) >= _MEMO:
            memo.clear()
        memo[word] = best
        return best


FEATURES = ("exact", "misspelled", "quoted", "addressed", "density", "kinds", "any_exact", "any_misspelled")
#: The prior's mean: what the method says before any label is seen. The last is the constant.
PRIOR = np.array([1.0, 0.7, -0.7, 0.5, 0.5, 0.5, 2.5, 1.5, -3.0])


def hits(text: str | None, automaton: LexiconAutomaton) -> list[tuple[int, str, int, float, float]]:
    """(word's place, term, distance, quotation 0..1, abuse 0..1) of each hit; none in a null or empty text."""
    if not text:
        return []
    found, match, out = words(text), automaton.match, []
    memo = automaton.memo
    for i, w in enumerate(found):
        m = memo[w] if w in memo else match(w)
        if m is None:
            continue
        near = [x.lower() for x in found[max(0, i - WINDOW) : i + WINDOW + 1]]
        before, after = found[max(0, i - WINDOW) : i + 1], found[i : i + WINDOW + 1]
        marks = any(x[0] in QUOTES for x in before) and any(x.rstrip(".,;:!?")[-1:] in QUOTES and x.rstrip(".,;:!?") for x in after)
        bare = [x.strip(".,;:!?" + QUOTES) for x in near]
        reports = sum(x in REPORTING for x in bare)
        address = sum(x in ADDRESS for x in bare)
        loud = any(x.endswith("!") for x in after)
        quotation = min(1.0, 0.6 * marks + 0.3 * min(reports, 2))
        abuse = min(1.0, 0.5 * min(address, 2) + 0.3 * loud) * (1 - quotation)
        out.append((i, m[0], m[1], quotation, abuse))
    return out


def features(text: str | None, found: list[tuple[int, str, int, float, float]]) -> list[float]:
    """FEATURES of a text from its hits; all 0 if it has none."""
    if not found:
        return [0.0] * len(FEATURES)
    exact = sum(1 - q for _, _, d, q, _ in found if d == 0)
    wrong = sum(1 - q for _, _, d, q, _ in found if d > 0)
    return [
        math.log1p(exact),
        math.log1p(wrong),
        math.log1p(sum(q for *_, q, _ in found)),
        math.log1p(sum(a for *_, a in found)),
        min(1.0, 10 * (exact + wrong) / (len(text) / 6 + 1)),
        math.log1p(len({t for _, t, *_ in found})),
        float(exact >= 0.7),
        float(wrong >= 0.7),
    ]


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression around PRIOR by Newton's method. Without rows it is PRIOR."""
    x = np.hstack([x.reshape(len(y), len(FEATURES)), np.ones((len(y), 1))])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - PRIOR))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def word_stems(part: str) -> list[str]:
    """The beginnings of a word, from four letters to the whole word or its first ten letters."""
    return [part[:n] for n in range(4, min(len(part), 10) + 1)]


def mined(train: DataFrame, least: int = 5, contexts: int = 4, purity: float = 0.9) -> list[Term]:
    """Stems that the training rows (text, label) show to be toxic.

    A stem is taken if at least `least` toxic rows hold it, after at least `contexts` different words (so that
    one repeated passage proves nothing), and at least `purity` of the rows with it are toxic. Of nested stems
    the longest is taken that loses no more than a twentieth of the rows of the shortest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                before, seen = 0, {}
                for part in _PART.findall((text or "").lower()):
                    if len(part) >= 4:
                        for stem in word_stems(part):
                            seen[stem] = seen.get(stem, 0) | 1 << before
                    before = zlib.crc32(part.encode()) % 63
                for stem, bits in seen.items():
                    got = counts.setdefault(stem, [0, 0, 0])
                    got[label] += 1
                    if label:
                        got[2] |= bits
        rows = list(zip(*counts.values())) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(r, pa.int64()) for r in rows)], ["stem", "clean", "toxic", "bits"])

    added = (
        train.select("text", "label")
        .mapInArrow(run, "stem string, clean long, toxic long, bits long")
        .groupBy("stem")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("bits")).alias("contexts"))
        .where((F.col("toxic") >= least) & (F.col("contexts") >= contexts) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("clean"))))
    )
    # The training rows are bounded, and so is this.
    found = {r.stem: r.toxic for r in added.select("stem", "toxic").collect()}
    taken = []
    for stem in sorted(found, key=lambda x: (len(x), x)):
        if any(stem[:n] in found for n in range(4, len(stem))):
            continue
        while longer := [x for x in found if len(x) == len(stem) + 1 and x.startswith(stem) and found[x] >= 0.95 * found[stem]]:
            stem = max(longer, key=lambda x: (found[x], x))
        taken.append(Term(stem, True, edits_for(stem) if len(stem) > 4 else 0))
    return taken


def with_features(docs: DataFrame, terms, keep=("doc_id",)) -> DataFrame:
    """(keep..., FEATURES..., near: the terms met only misspelled) of every row's text."""
    chosen = docs.select(*keep, "text")
    kinds = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in keep)
    terms = tuple(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms)
        for b in batches:
            found = [hits(t, automaton) for t in b.column(len(keep)).to_pylist()]
            texts = b.column(len(keep)).to_pylist()
            rows = [features(t, h) for t, h in zip(texts, found)]
            columns = zip(*rows) if rows else [[] for _ in FEATURES]
            near = [sorted({t for _, t, d, *_ in h if d}) for h in found]
            arrays = [*(b.column(i) for i in range(len(keep))), *(pa.array(c, pa.float64()) for c in columns), pa.array(near, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *FEATURES, "near"])

    return chosen.mapInArrow(run, kinds + ", " + ", ".join(f"{f} double" for f in FEATURES) + ", near array<string>")


def trained(docs: DataFrame, labels: DataFrame, seeds=SEEDS, limit: int = MAX_TRAIN) -> tuple[list[Term], np.ndarray]:
    """The lexicon and the regression's weights, from at most `limit` labelled rows outside the held-out fold.

    A term that clean training rows meet misspelled (in more than one row of a thousand, two at least) is from
    then on matched exactly.
    """
    train = stored(fitted_on(docs.select("doc_id", "text"), training_labels(labels, "toxic", limit)), "toxic-train")
    stems = mined(train)
    known = {t.text for t in stems}
    terms = [t for t in seeds if t.text not in known] + stems
    rows = stored(with_features(train, terms, ("doc_id", "label")), "toxic-near")
    clean = rows.where("label = 0")
    most = max(2, clean.count() // 1000)
    loose = {r.t for r in clean.select(F.explode("near").alias("t")).groupBy("t").count().where(F.col("count") >= most).collect()}
    terms = [Term(t.text, t.stem, 0) if t.text in loose else t for t in terms]
    sample = with_features(train, terms, ("doc_id", "label")).orderBy("doc_id").toPandas()
    return terms, fit(sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, seeds=SEEDS, limit: int = MAX_TRAIN) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted, n_misspelled), a row a row.

    Only the text enters the score. Null and empty texts have no hits and get the model's constant. Null and
    repeated ids pass through (a null id counts as the empty text in held_out); an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    terms, w = trained(docs, labels, seeds, limit)
    rows = with_features(docs, terms)
    z = sum((F.col(f) * float(c) for f, c in zip(FEATURES, w)), F.lit(float(w[-1])))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-z)))
    return rows.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("near").cast("long").alias("n_misspelled"),
    )
