"""Language identification by Bayesian fusion of what a text, its markup and its address say.

The text's likelihoods come from character n-grams of its words. The declared language and the address
suffix get likelihoods, and hosts get priors, from the corpus itself: grouped sums of what the texts alone
say. A host's prior is smoothed towards its domain's, and that towards the corpus's; each row is left out
of the sums that it is judged by.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold_of, row_key, small, stored, words

FOLDS = 5
MAX_TRAIN = 4000  # labelled texts that fit the n-gram model
ORDERS = (1, 2, 3)
TRUST = 0.2  # n-grams overlap and words repeat, so each counts for less than an independent observation
WEIGHT = 5.0  # rows that the wider prior counts for
_MEMO = 200_000
_TAG = re.compile(r"(?i)<(html|meta)\b([^>]*)")
_LANG = re.compile(r"""(?i)\b(?:xml:)?lang\s*=\s*["']?([a-z]+)""")
_CONTENT = re.compile(r"""(?i)content\s*=\s*["']?([a-z]+)""")
_OPENS = re.compile(r"(?i)<(script|style)\b")
_CLOSES = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
# Three-letter codes (ISO 639-2 and 639-3) of languages that have a two-letter one.
_ALIASES = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl",
    "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "pol": "pl", "ces": "cs", "cze": "cs", "rus": "ru", "tur": "tr", "ell": "el", "gre": "el",
}


def declared_language(page: str | None, known: set[str]) -> str | None:
    """The language that a page's markup declares, by its whole primary subtag; `other` if it isn't known.

    The first html tag with a lang, or meta tag about content-language, counts. Each tag is read once.
    """
    for tag in _TAG.finditer(page or ""):
        rest = tag[2]
        if tag[1].lower() == "html":
            m = _LANG.search(rest)
        else:
            at = rest.lower().find("content-language")
            m = _CONTENT.search(rest, at + len("content-language")) if at >= 0 else None
        if m:
            said = m[1].lower()
            said = said if said in known else _ALIASES.get(said)
            return said if said in known else "other"
    return None


def grams(word: str) -> Iterator[str]:
    """Character n-grams of a lower-cased word between blanks."""
    w = f" {word.lower()} "
    for n in ORDERS:
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


class NgramModel:
    """Per language log-probabilities of character n-grams, smoothed by half a count; the last row is for unknown ones."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        self.languages = sorted(counts)
        every = sorted(set().union(*counts.values())) if counts else []
        self.place = {g: i for i, g in enumerate(every)}
        n = np.array([[counts[x][g] for x in self.languages] for g in every] + [[0] * len(self.languages)], np.float64)
        self.table = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * (len(every) + 1)))


class Scorer:
    """Log-likelihoods of texts, from a bounded memo of words."""

    def __init__(self, model: NgramModel) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((_MEMO, len(self.model.languages)))

    def _learn(self, new: set[str]) -> None:
        get, other, at, sizes = self.model.place.get, len(self.model.place), [], []
        for word in new:
            w = f" {word.lower()} "
            k = [get(w[i : i + n], other) for n in ORDERS for i in range(len(w) - n + 1)]
            at += k
            sizes.append(len(k))
        first = len(self.memo)
        if first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((first + len(new), self.rows.shape[1]))])
        starts = np.cumsum([0, *sizes[:-1]])
        self.rows[first : first + len(new)] = np.add.reduceat(self.model.table[at], starts)
        self.memo.update(zip(new, range(first, first + len(new))))

    def likelihoods(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and for each language TRUST times the log-likelihood less the best one's."""
        found = words(text or "")
        if not found:
            return 0, np.zeros(len(self.model.languages))
        if len(self.memo) > _MEMO:
            self._clear()
        if new := set(found).difference(self.memo):
            self._learn(new)
        total = TRUST * self.rows[list(map(self.memo.__getitem__, found))].sum(axis=0)
        return len(found), total - total.max()


def trained(labelled: DataFrame, limit: int = MAX_TRAIN) -> NgramModel:
    """The model of at most `limit` different rows of labelled(doc_id, text, lang), outside the held-out fold 0."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != 0))
    rows = rows.select("lang", "text", row_key(rows).alias("_row"))
    chosen = rows.select("_row").distinct().orderBy("_row").limit(limit)  # few enough to broadcast
    rows = rows.join(F.broadcast(chosen), "_row").groupBy("_row").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, times in Counter(words(text)).items():
                    for g in grams(word):
                        counts[lang, g] += times
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])

    out: dict[str, Counter] = {}
    for lang, gram, n in rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n")).toLocalIterator():
        out.setdefault(lang, Counter())[gram] = n  # what `limit` texts hold
    return NgramModel(out)


def visible(page: str | None) -> str:
    """A page's text without markup, scripts, styles and comments.

    What has an end is skipped up to it: a comment to -->, a script or style to its closing tag, any tag to >. An end
    that isn't found once isn't looked for again, so a page is read in time that follows its length.
    """
    page, out, at, missing = page or "", [], 0, set()
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        end = -1
        if page.startswith("<!--", start):
            if "-->" not in missing and (end := page.find("-->", start + 4)) >= 0:
                end += 3
            elif end < 0:
                missing.add("-->")
        elif m := _OPENS.match(page, start):
            name = m[1].lower()
            closing = None if name in missing else _CLOSES[name].search(page, m.end())
            if closing:
                end = closing.end()
            else:
                missing.add(name)
        if end < 0:
            end = page.find(">", start + 1) + 1
            if not end:  # no tag ends any more
                at = start
                break
        at = end
    return markup.unescape(" ".join([*out, page[at:]]))


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix): the host, its last two labels and its last one; nothing of an address without a host."""
    m = _HOST.match(url or "")
    if not m:
        return None, None, None
    labels = m[1].lower().strip(".").split(".")
    return ".".join(labels), ".".join(labels[-2:]), labels[-1]


def evidence(rows: DataFrame, model: NgramModel, keys: list[str]) -> DataFrame:
    """rows(keys..., text, html, url) -> (keys..., words, declared, host, domain, suffix, ll0, ll1, ...).

    A row with html is a page: its visible text counts. declared: the markup's language, `other` if the model
    doesn't know it, null if there is none.
    """
    chosen = rows.select(*keys, "text", "html", "url")
    kinds = [f"{k} {chosen.schema[k].dataType.simpleString()}" for k in keys]
    lls = [f"ll{i}" for i in range(len(model.languages))]
    shared = rows.sparkSession.sparkContext.broadcast(model)  # what MAX_TRAIN texts hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known, n = Scorer(shared.value), set(shared.value.languages), len(keys)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            ll = []
            for text, page, url in zip(*(b.column(n + i).to_pylist() for i in range(3))):
                count, x = scorer.likelihoods(text if page is None else visible(page))
                for column, value in zip(out, (count, declared_language(page, known), *address(url))):
                    column.append(value)
                ll.append(x)
            ll_columns = np.array(ll).reshape(len(ll), len(lls)).T
            arrays = [pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:]), *(pa.array(c) for c in ll_columns)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *arrays], [*keys, "words", "declared", "host", "domain", "suffix", *lls])

    return chosen.mapInArrow(run, ", ".join([*kinds, "words long, declared string, host string, domain string, suffix string", *(f"{x} double" for x in lls)]))


def fused(rows: DataFrame, model: NgramModel, keys: list[str]) -> DataFrame:
    """rows(keys..., text, html, url) -> (keys..., lang, probability, text_lang, declared), a row a row.

    text: plain text; html and url: a page and its address; any may be null. Rows without words, declared
    language and address have a null language, as has everything if the model knows none. Keys may be null
    or repeat; an empty table gives none.
    """
    bounded_batches(rows.sparkSession)
    n = len(model.languages)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(*keys, none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"))
    found = evidence(rows, model, keys)
    total = sum((F.exp(f"ll{i}") for i in range(n)), F.lit(0.0))
    found = stored(found.select("*", *[(F.exp(f"ll{i}") / total).alias(f"t{i}") for i in range(n)]), "language-evidence")
    told = F.col("words") > 0  # a text without words says nothing about its host
    sums = lambda prefix: [F.sum(F.when(told, F.col(f"t{i}")).otherwise(0.0)).alias(f"{prefix}{i}") for i in range(n)]
    grouped = found.groupBy("declared").agg(*sums("c")).collect()  # a row for each language of the model, other, and null
    overall = [sum(r[f"c{i}"] for r in grouped) for i in range(n)]
    by_declared = {r.declared: [r[f"c{i}"] for i in range(n)] for r in grouped if r.declared is not None}
    declared_of = [sum(c[i] for c in by_declared.values()) for i in range(n)]

    hosts = stored(found.where(F.col("host").isNotNull()).groupBy("host", "domain", "suffix").agg(*sums("h")), "hosts")
    up = lambda key, prefix: hosts.groupBy(key).agg(*[F.sum(f"h{i}").alias(f"{prefix}{i}") for i in range(n)])
    per_host = hosts.join(up("domain", "d"), "domain").join(up("suffix", "s"), "suffix").drop("domain", "suffix")
    per_host = stored(per_host, "host-sums")
    n_hosts = per_host.count()
    addressed = hosts.groupBy().agg(*[F.coalesce(F.sum(f"h{i}"), F.lit(0.0)).alias(f"a{i}") for i in range(n)]).first()
    n_suffixes = hosts.select("suffix").distinct().count()
    # Rows without a host stay out of the join, where they would all meet in one task.
    named = found.where(F.col("host").isNotNull()).join(small(per_host, n_hosts, 64 + 24 * n), "host", "left")
    rows = named.unionByName(found.where(F.col("host").isNull()), allowMissingColumns=True)

    def own(i: int) -> Column:
        return F.when(told, F.col(f"t{i}")).otherwise(0.0)

    one = F.when(told, 1.0).otherwise(0.0)
    add = lambda prefix: sum((F.col(f"{prefix}{i}") for i in range(n)), F.lit(0.0))
    less = lambda total, own: F.greatest(F.lit(float(total)) - own, F.lit(0.0))
    scores = []
    for i in range(n):
        share = (less(overall[i], own(i)) + 1) / (less(sum(overall), one) + n)
        domain = (F.greatest(F.col(f"d{i}") - own(i), F.lit(0.0)) + WEIGHT * share) / (F.greatest(add("d") - one, F.lit(0.0)) + WEIGHT)
        host = (F.greatest(F.col(f"h{i}") - own(i), F.lit(0.0)) + WEIGHT * domain) / (F.greatest(add("h") - one, F.lit(0.0)) + WEIGHT)
        suffix = (F.greatest(F.col(f"s{i}") - own(i), F.lit(0.0)) + 0.5) / (less(addressed[i], own(i)) + 0.5 * (n_suffixes + 1))
        markup_said = F.lit(0.0)
        for said, c in by_declared.items():
            p = (less(c[i], own(i)) + 0.5) / (less(declared_of[i], own(i)) + 0.5 * (n + 2))
            markup_said = F.when(F.col("declared") == said, F.log(p)).otherwise(markup_said)
        prior = F.when(F.col("host").isNull(), F.log(share)).otherwise(F.log(host) + F.log(suffix))
        scores.append((F.col(f"ll{i}") + prior + markup_said).alias(f"z{i}"))
    keep = [*keys, "declared", F.when(told | F.col("declared").isNotNull() | F.col("host").isNotNull(), True).alias("any"), "words", *[f"t{i}" for i in range(n)]]
    out = rows.select(*keep, *scores)
    top = F.greatest(*[F.col(f"z{i}") for i in range(n)]) if n > 1 else F.col("z0")
    best = lambda prefix: F.greatest(*[F.struct(F.col(f"{prefix}{i}").alias("v"), F.lit(-i).alias("o"), F.lit(x).alias("lang")) for i, x in enumerate(model.languages)])["lang"] if n > 1 else F.lit(model.languages[0])
    spread = sum((F.exp(F.col(f"z{i}") - top) for i in range(n)), F.lit(0.0))
    return out.select(
        *keys,
        F.when(F.col("any"), best("z")).alias("lang"),
        F.when(F.col("any"), 1 / spread).alias("probability"),
        F.when(F.col("words") > 0, best("t")).alias("text_lang"),
        "declared",
    )
