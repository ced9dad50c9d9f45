"""The two classifiers' scores against plain loops over small tables."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from layerwise.llm import quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(n=150):
    """(doc_id, text, label): texts of made-up words, some with insults whole, misspelled, quoted and shouted; odd rows."""
    r = random.Random(8)
    words = ["".join(r.choice("abdeimnorst") for _ in range(r.randint(2, 7))) for _ in range(120)]
    rows = []
    for i in range(n):
        w = [r.choice(words) + r.choice(["", "", "", ",", ".", "!"]) for _ in range(r.randint(5, 60))]
        for _ in range(r.randint(1, 4) if i % 3 == 0 else 0):
            w[r.randrange(len(w))] = r.choice(["idiot", "idoit", "IDIOT!", "worthles", "gnarfles", "gnarfle"])
        if i % 7 == 0:
            w[:4] = ['"you', "said", 'idiot"', "are"]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows + [(None, "nobody's text, idiot", 1), (900, None, 0), (901, "", 0), (902, " \n ", None), (3, rows[3][1], 1), (4, "another text of one id", 0)]


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, x, x) for i, _, x in rows], "doc_id long, toxic int, quality int")
    return docs, labels


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def context_sums(rows):
    at, sign = quality.index_vectors()
    sums, counts = np.zeros((quality.ROWS, quality.DIM)), np.zeros(quality.ROWS)
    for _, text, _ in rows:
        ids = quality.Vocabulary().ids(text).tolist()
        for i, x in enumerate(ids):
            counts[x] += 1
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if j != i:
                    for k in range(quality.NONZERO):
                        sums[x, at[ids[j], k]] += sign[ids[j], k]
    return sums, counts


def pooled(text, sums, counts):
    ids, total = quality.Vocabulary().ids(text).tolist(), max(counts.sum(), 1)
    plain, weighed, weights = np.zeros(quality.DIM), np.zeros(quality.DIM), 0.0
    for x in ids:
        unit = sums[x] / max(math.sqrt(sum(v * v for v in sums[x])), 1e-9)
        weight = 1e-3 / (1e-3 + counts[x] / total)
        plain, weighed, weights = plain + unit, weighed + weight * unit, weights + weight
    return np.concatenate([plain / max(len(ids), 1), weighed / max(weights, 1e-9)])


def test_quality_vectors_and_scores_against_loops(spark):
    rows = rows_of()
    docs, labels = tables(spark, rows)
    sums, counts = quality.context_sums(docs)
    want_sums, want_counts = context_sums(rows)
    assert np.array_equal(counts, want_counts) and np.allclose(sums, want_sums)

    got = quality.pooled(docs, quality.word_vectors(sums, counts)).collect()
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(pooled(t, want_sums, want_counts))
    assert len(got) == len(rows)
    for r in got:
        x = np.frombuffer(r.pooled, np.float32)
        assert any(np.allclose(x, w, atol=1e-4) for w in want[r.doc_id])

    # The fit, on the rows that it may see in the order of their ids; of an id's texts, the one that the operator drew.
    scores = {(r.doc_id, bytes(r._row)): r.score for r in quality.scored(docs, labels).collect()}
    vector = {(r.doc_id, bytes(r._row)): np.frombuffer(r.pooled, np.float32).astype(float) for r in got}
    seen = {i: x for i, _, x in rows if i is not None and x is not None and fold(i) != 0}
    seen = {i: max(x for j, _, x in rows if j == i and x is not None) for i in seen}
    choices = [[k for k in vector if k[0] == i] for i in sorted(seen)]
    fits = []
    for pick in range(max(map(len, choices))):
        chosen = [c[min(pick, len(c) - 1)] for c in choices]
        network = quality.Network().fit(np.array([vector[k] for k in chosen]), np.array([seen[k[0]] for k in chosen], float))
        fits.append({k: network.probability(x[None])[0] for k, x in vector.items()})
    assert any(all(abs(scores[k] - f[k]) < 1e-3 for k in scores) for f in fits)


def test_network_answers_and_temperature():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 6))
    y = (x[:, 0] + x[:, 1] + r.normal(0, 0.1, 4000) > 0).astype(float)
    net = quality.Network().fit(x, y)
    mean, spread, w1, b1, w2, b2 = net.weights
    for row, p in zip(x[:20], net.probability(x[:20])):
        hidden = [math.tanh(sum((row[i] - mean[i]) / spread[i] * w1[i, k] for i in range(6)) + b1[k]) for k in range(net.hidden)]
        assert abs(p - 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / net.temperature))) < 1e-9
    assert ((net.probability(x) >= 0.5) == y).mean() > 0.9
    kept_apart = np.random.default_rng(quality.SEED).permutation(len(y))[: len(y) // 10]
    found, losses = net.temperature, {}
    for net.temperature in np.geomspace(0.25, 8, 61):
        p = net.probability(x[kept_apart])
        losses[net.temperature] = -sum(math.log(a if b else 1 - a) for a, b in zip(p, y[kept_apart]))
    assert abs(min(losses, key=losses.get) - found) < 1e-9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def nearest_term(word, terms):
    found = []
    for part in toxicity._PART.findall(word.lower()):
        for t in terms:
            d = min((distance(part[:k], t.text) for k in range(len(part) + 1)), default=99) if t.stem else distance(part, t.text)
            if d <= t.edits:
                found.append((d, t.text))
    return min(((d, t) for d, t in found), default=None)


def test_mined_stems_against_loops(spark):
    rows = [(i, t, x) for i, t, x in rows_of() if x is not None]
    toxic, clean, before = defaultdict(set), defaultdict(set), defaultdict(set)
    for n, (_, text, label) in enumerate(rows):
        parts = toxicity._PART.findall((text or "").lower())
        for k, part in enumerate(parts):
            for size in range(4, min(len(part), 10) + 1):
                (toxic if label else clean)[part[:size]].add(n)
                if label:
                    before[part[:size]].add(zlib.crc32(parts[k - 1].encode()) % 63 if k else 0)
    good = {s: len(ns) for s, ns in toxic.items() if len(ns) >= 5 and len(before[s]) >= 4 and len(ns) >= 0.9 * (len(ns) + len(clean[s]))}
    table = spark.createDataFrame([(t, x) for _, t, x in rows], "text string, label int").repartition(3)
    got = toxicity.mined(table)
    assert got and {t.text for t in got} <= set(good)
    shortest = {s for s in good if not any(s[:n] in good for n in range(4, len(s)))}
    for s in shortest:  # each is taken once, or a longer form that nearly all of its rows have
        taken = [t for t in got if t.text.startswith(s)]
        assert len(taken) == 1 and good[taken[0].text] >= 0.95 ** (len(taken[0].text) - len(s)) * good[s]
    assert len(got) == len(shortest)


def test_toxicity_fit_and_scores_against_loops(spark):
    rows = rows_of()
    docs, labels = tables(spark, rows)
    terms, weights = toxicity.trained(docs, labels)
    automaton = toxicity.LexiconAutomaton(terms)
    want = defaultdict(list)
    for i, text, _ in rows:
        found = toxicity.hits(text, automaton)
        places = {}
        for k, w in enumerate(WORD.findall(text or "")):
            if near := nearest_term(w, terms):
                places[k] = near
        assert {h[0]: h[2] for h in found} == {k: d for k, (d, _) in places.items()}
        whole = sum(1 - q for _, _, d, q, _ in found if d == 0)
        wrong = sum(1 - q for _, _, d, q, _ in found if d)
        x = [math.log1p(whole), math.log1p(wrong), math.log1p(sum(h[3] for h in found)), math.log1p(sum(h[4] for h in found))]
        x += [min(1.0, 10 * (whole + wrong) / (len(text or "") / 6 + 1)), math.log1p(len({h[1] for h in found})), float(whole >= 0.7), float(wrong >= 0.7)]
        want[i].append(1 / (1 + math.exp(-sum(a * b for a, b in zip([*(x if found else [0.0] * 8), 1.0], weights)))))
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(abs(r.score - w) < 1e-9 for w in want[r.doc_id]) and r.held_out == (fold(r.doc_id) == 0)


def test_logistic_fit_is_the_least_penalised_loss():
    r = np.random.default_rng(2)
    x = r.random((200, len(toxicity.FEATURES)))
    y = (x[:, 0] + r.normal(0, 0.3, 200) > 0.5).astype(float)
    w = toxicity.fit(x, y)

    def loss(v):
        z = np.array([sum(a * b for a, b in zip([*row, 1.0], v)) for row in x])
        return np.logaddexp(0, np.where(y == 1, -z, z)).sum() + ((v - toxicity.PRIOR) ** 2).sum() / 2

    least = loss(w)
    for k in range(len(w)):
        for step in (-1e-3, 1e-3):
            moved = w.copy()
            moved[k] += step
            assert loss(moved) > least
