"""Language-model scoring with an n-gram trie that is sharded by the n-grams' first words.

Texts become blocks of about BLOCK_TOKENS tokens, kept in the shared folder as numbers of each block's own words.
First the blocks' words are counted: each gets a number, small ones for frequent words. Then a block asks for
each of its distinct n-grams once. Requests are tries themselves: a context is sent once, with its successors
below it. They go to the shard of the n-gram's first word, with the counts from training texts; frequent first
words, and pairs of frequent words, are split by what follows them. A shard adds up the counts, builds its
Elias-Fano trie of all lengths, answers every request from it, and forgets it. Blocks put the answers together
into the scores of their documents. No machine ever holds the whole model.

The model interpolates: p(w | h) = (1 - b) * c(hw) / c(h) + b * p(w | shorter h) with b = LEAVES * c(h)^-FADE, down
to p(w) = (c + 0.1) / (N + 0.1 * (V + 1)); a context that training never met leaves all to the shorter one. It needs
no more than counts of an n-gram and of its context, so that a split context gets the same answers in each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold_of_value, hashed_runs, mixed, stored
from .eliasfano import Quantiser, Trie

ORDER = 3
FOLDS = 10
BLOCK_TOKENS = 1_000_000
SHARD_TOKENS = 1_500_000
LEAVES, FADE = 0.75, 0.1
_PART = 1 << 21  # bytes of text that are hashed at a time
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
END = 0x5851F42D4C957F2D
_DEAL = np.uint64(40)  # 24 bits of a word's hash choose its shard
UNKNOWN, START, FIRST = 0, 1, 2  # numbers of words: those that training never met, what stands before a text, real ones


def hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, parted by spaces, and where they begin; a part of the text at a time."""
    found, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = text.rfind(b" ", at, at + _PART) + 1 if at + _PART < len(text) else len(text)
        if not end:  # one long word
            end = text.find(b" ", at + _PART) + 1 or len(text)
        piece = np.frombuffer(text, np.uint8, end - at, at)
        inside = piece != 32
        starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        if len(starts):
            ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
            sizes = ends - starts
            found.append(hashed_runs(piece[inside], np.cumsum(sizes) - sizes, sizes))
            begins.append(starts + at)
        at = end
    return np.concatenate(found), np.concatenate(begins)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, A-Z lower-cased, and END after each text's last one; the number of tokens of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES) for t in texts]
    found, begins = hashes(b" ".join(raw))
    edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
    sizes = np.diff(np.searchsorted(begins, edges)) + 1
    out = np.full(sizes.sum(), END, np.uint64)
    last = np.cumsum(sizes) - 1
    words = np.ones(len(out), bool)
    words[last] = False
    out[words] = found
    return out, sizes


def _planes(x: np.ndarray) -> np.ndarray:
    """Numbers as their first bytes, then their second ones, and so on: what is small compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _from_planes(raw: bytes, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    """n numbers out of their planes from byte `at` on, and where those end."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind), at + n * size


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def blocks(docs: DataFrame, folds: int = FOLDS, size: int = BLOCK_TOKENS) -> DataFrame:
    """(block, ids, held, sizes, n_words, words, deal, tokens): whole documents, `size` tokens or little more at a time.

    words: the block's words with their counts in training texts; deal: the bits of them that choose their shards.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, sizes, parts, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flushed() -> pa.RecordBatch:
            words, tokens, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers; equally frequent ones stay in order
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            words, tokens = words[order], rank[tokens]
            training = np.repeat([fold_of_value(i, folds) != 0 for i in ids], sizes)
            counts = np.bincount(tokens, training, len(words)).astype(np.uint32)
            columns = [
                pa.array([f"{task}-{n}"]),
                pa.array([ids], pa.list_(id_type)),
                pa.array([[fold_of_value(i, folds) == 0 for i in ids]]),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([len(words)]),
                pa.array([_pack(_planes(np.diff(words, prepend=np.uint64(0))), _planes(counts))]),
                pa.array([_pack(_planes(np.diff((words >> _DEAL).astype(np.uint32), prepend=np.uint32(0))))]),
                pa.array([_pack(_planes(tokens))]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "held", "sizes", "n_words", "words", "deal", "tokens"])

        for b in batches:
            id_type = b.schema.field(0).type
            found, counted = tokens_of(b.column(1).to_pylist())
            edges = np.append(0, np.cumsum(counted))
            for i, key in enumerate(b.column(0).to_pylist()):
                ids.append(key)
                sizes.append(int(counted[i]))
                parts.append(found[edges[i] : edges[i + 1]])
                total += sizes[-1]
                if total >= size:
                    yield flushed()
                    ids, sizes, parts, total, n = [], [], [], 0, n + 1
        if ids:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(run, f"block string, ids array<{kind}>, held array<boolean>, sizes array<long>, n_words long, words binary, deal binary, tokens binary")


class Block:
    def __init__(self, held, sizes, n_words: int, deal: bytes, tokens: bytes) -> None:
        unpack = zstandard.decompress
        self.sizes, self.held = np.asarray(sizes, np.int64), np.asarray(held, bool)
        self.deal = np.cumsum(_from_planes(unpack(deal), 0, n_words, np.uint32)[0], dtype=np.uint32)
        self.tokens = _from_planes(unpack(tokens), 0, int(self.sizes.sum()), np.uint32)[0].astype(np.int32)
        self.starts = np.append(0, np.cumsum(self.sizes)[:-1]).astype(np.int64)


def _dealt(deal: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its words) for each shard that a block's words go to."""
    shard = deal % np.uint32(shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(s, order[edges[s] : edges[s + 1]]) for s in np.flatnonzero(np.diff(edges)).tolist()]


class Grams:
    """A block's distinct n-grams of known words, of each length up to `order`, and the shards that they go to.

    nodes[k - 1][i]: the n-gram of length k at place i of the block's texts, each with START before it; -1 where
    there is none. An n-gram can have several shards: if what follows it is split, they all need its count.
    """

    def __init__(self, block: Block, numbers: np.ndarray, counts: np.ndarray, starts: int, order: int, shards: int, split: int) -> None:
        """numbers, counts: of the block's words, in the whole corpus; starts: the number of training texts."""
        words, local = np.unique(np.append(numbers, np.uint64(START)), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        total[local] = np.append(counts, starts)
        spans = block.sizes + 1
        self.place = np.arange(len(block.tokens)) + np.repeat(np.arange(1, len(spans) + 1), block.sizes)  # of each token
        text = np.full(spans.sum(), local[-1], np.int32)
        text[self.place] = local[block.tokens]
        known = (words != UNKNOWN)[text]
        left = np.repeat(np.cumsum(spans), spans).astype(np.int32) - np.arange(len(text), dtype=np.int32)
        training = np.repeat(~block.held, spans)
        met = int(words[0] == UNKNOWN)  # all other words are in the texts, so their numbers are those of the n-grams of length 1
        self.nodes, self.last = [text - np.int32(met)], [np.arange(met, len(words))]
        self.parent, self.count = [np.zeros(len(words) - met, np.int64)], [total[met:]]
        for k in range(2, order + 1):
            above = self.nodes[-1]
            at = np.flatnonzero((above >= 0) & (left >= k))
            at = at[known[at + k - 1]]
            key = above[at].astype(np.int64) * len(words) + text[at + k - 1]
            grams, which = np.unique(key, return_inverse=True)
            node = np.full(len(text), -1, np.int32)
            node[at] = which
            self.nodes.append(node)
            self.count.append(np.bincount(which, training[at], len(grams)).astype(np.int64))
            self.parent.append(grams // len(words))
            self.last.append(grams - self.parent[-1] * len(words))
        self.words = words
        self._deal(total, shards, split)

    def _deal(self, total: np.ndarray, shards: int, split: int) -> None:
        factor, other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
        route = lambda w, a, b: (mixed(w * factor + a * other + b) % np.uint64(shards)).astype(np.int32)
        parts = lambda c: np.maximum(1, -(-c // split)).astype(np.uint64)
        first, order = self.words[self.last[0]], len(self.last)

        def rest(last: np.ndarray, of: np.ndarray, context: np.ndarray) -> np.ndarray:
            """Which part of its context, cut into so many, each n-gram belongs to."""
            out = np.zeros(len(last), np.uint64)
            many = np.flatnonzero((of > 1)[context])
            out[many] = self.words[last[many]] % of[context[many]]
            return out

        home = [route(first, np.uint64(0), np.uint64(0))]  # of each n-gram the shard that always gets it
        extra = [[] for _ in range(order)]  # (n-gram, another shard that gets it)
        if order > 1:
            up = self.parent[1]
            part = rest(self.last[1], parts(self.count[0]), up)
            home.append(route(first[up], part, np.uint64(0)))
            extra[0].append((up, home[1]))
        if order > 2:
            most = parts(np.minimum(self.count[0][up], total[self.last[1]]))
            cut = np.flatnonzero(most > 1)
            times = most[cut].astype(np.int64) - 1
            node = np.repeat(cut, times)
            place = np.arange(len(node)) - np.repeat(np.cumsum(times) - times, times) + 1
            other_home = route(first[up[node]], part[node], place.astype(np.uint64))
            extra[1].append((node, other_home))
            extra[0].append((up[node], other_home))
            pair = self.parent[2]
            home.append(route(first[up[pair]], part[pair], rest(self.last[2], most, pair)))
        for k in range(3, order):
            home.append(home[-1][self.parent[k]])
        self.node, self.edges, self.children = [], [], []
        for k in range(order):
            node, shard = np.arange(len(home[k])), home[k]
            if extra[k]:
                more, to = (np.concatenate(x) for x in zip(*extra[k]))
                far = np.flatnonzero(to != shard[more])
                n = max(1, len(node))
                key = np.unique(to[far].astype(np.int64) * n + more[far])
                node, shard = np.append(node, key % n), np.append(shard, (key // n).astype(np.int32))
            by = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            if extra[k]:  # in order of n-grams inside each shard
                by = by[np.lexsort((node[by], shard[by]))] if len(key) else by
            self.node.append(node[by])
            self.edges.append(np.searchsorted(shard[by], np.arange(shards + 1)))
            if k:
                owner, there = self.parent[k][node[by]], shard[by]
                at = at_home[owner]
                away = np.flatnonzero(home[k - 1][owner] != there)
                if len(away):
                    n = max(1, len(home[k - 1]))
                    at[away] = np.searchsorted(pairs, there[away].astype(np.int64) * n + owner[away])
                self.children.append(np.bincount(at, minlength=len(self.node[k - 1])).astype(np.uint32))
            at_home = np.empty(len(home[k]), np.int64)  # where each n-gram with its home is in the order by shards
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            at_home[:] = place[: len(home[k])]
            pairs = shard[by].astype(np.int64) * max(1, len(home[k])) + node[by]

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """For each shard: the numbers of n-grams of each length; then, length by length, how many successors
        each n-gram of the length before has, the last words as steps from the one before, and the counts."""
        for s in np.flatnonzero(np.diff(self.edges[0])).tolist():
            cut = [slice(*e[s : s + 2]) for e in self.edges]
            out = [np.array([c.stop - c.start for c in cut], np.uint64)]
            for k, c in enumerate(cut):
                node = self.node[k][c]
                word = self.words[self.last[k][node]]
                steps = np.diff(word, prepend=np.uint64(0))
                if k:
                    children = self.children[k - 1][cut[k - 1]]
                    heads = (np.cumsum(children) - children)[children > 0]
                    steps[heads] = word[heads]
                    out.append(_planes(children))
                out += [_planes(steps), _planes(self.count[k][node].astype(np.uint64 if k == 0 else np.uint32))]
            yield s, _pack(*out)

    def answered(self, answers: dict[int, bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codes of each length's n-grams: their weights, and what they leave, as contexts, to the shorter one."""
        order = len(self.last)
        weights, backs = ([np.zeros(len(w), np.uint8) for w in self.last] for _ in range(2))
        for s, raw in answers.items():
            at = 0
            for k in range(order):
                node = self.node[k][self.edges[k][s] : self.edges[k][s + 1]]
                for codes in (weights, backs) if k < order - 1 else (weights,):
                    codes[k][node] = np.frombuffer(raw, np.uint8, len(node), at)
                    at += len(node)
        return weights, backs


class Requests:
    """All requests of a shard, length by length: last words, counts, and the places of the contexts one length up."""

    def __init__(self, payloads: list[bytes], order: int) -> None:
        self.sizes = np.zeros((len(payloads), order), np.int64)
        found: list[list[tuple]] = [[] for _ in range(order)]
        offset = np.zeros(order, np.int64)
        for i, payload in enumerate(payloads):
            raw = zstandard.decompress(payload)
            self.sizes[i] = np.frombuffer(raw, np.uint64, order)
            n, at = self.sizes[i], 8 * order
            for k in range(order):
                up = np.zeros(0, np.int64)
                if k:
                    children, at = _from_planes(raw, at, n[k - 1], np.uint32)
                    up = np.repeat(np.arange(offset[k - 1], offset[k - 1] + n[k - 1]), children)
                steps, at = _from_planes(raw, at, n[k], np.uint64)
                word = np.cumsum(steps, dtype=np.uint64)
                if k:  # each context's successors start anew
                    sizes = children[children > 0]
                    heads = np.cumsum(sizes) - sizes
                    word -= np.repeat(word[heads] - steps[heads], sizes)
                count, at = _from_planes(raw, at, n[k], np.uint64 if k == 0 else np.uint32)
                found[k].append((word, count, up.astype(np.int32)))
            offset = offset + n
        self.words, self.counts, self.parents = [], [], []
        for level in found:
            for j, out in enumerate((self.words, self.counts, self.parents)):
                out.append(np.concatenate([f[j] for f in level]))
            level.clear()

    def split(self, k: int, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum(self.sizes[:, k])[:-1])


_LEAVES = LEAVES * np.maximum(np.arange(1 << 12), 1.0) ** -FADE


def left_over(count: np.ndarray) -> np.ndarray:
    """The share that contexts of these counts leave to the shorter one."""
    out, large = _LEAVES[np.minimum(count, len(_LEAVES) - 1)], count >= len(_LEAVES)
    out[large] = LEAVES * count[large] ** -FADE
    return out


def built(asked: Requests, below: float, quantiser: Quantiser) -> Trie:
    """The trie of the n-grams that training met, from all requests of a shard; below: N + 0.1 * (V + 1)."""
    first, at = np.unique(asked.words[0], return_inverse=True)
    total = np.zeros(len(first), np.int64)
    total[at] = asked.counts[0]  # every block sends the corpus's count
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *asked.words[1:]]))
    n = max(1, len(words))
    weights, backs = [quantiser.codes(np.log10((total + 0.1) / below))], [quantiser.codes(np.log10(left_over(total)))]
    levels = []
    for word, count, parent in zip(asked.words[1:], asked.counts[1:], asked.parents[1:]):
        owner = at[parent]
        some = np.flatnonzero(owner >= 0)
        key, which = np.unique(owner[some] * n + np.searchsorted(words, word[some]), return_inverse=True)
        sums = np.bincount(which, count[some], len(key)).astype(np.int64)
        met = sums > 0  # held-out texts ask for others too
        at = np.full(len(word), -1, np.int64)
        at[some] = np.where(met, np.cumsum(met) - 1, -1)[which]
        key, sums, owner = key[met], sums[met], key[met] // n
        levels.append((owner, key % n))
        weights.append(quantiser.codes(np.log10(sums / total[owner] * (1 - left_over(total[owner])))))
        backs.append(quantiser.codes(np.log10(left_over(sums))))
        total = sums
    return Trie(first, words, levels, weights, backs[:-1] if levels else [])


def numbered(held: DataFrame, shards: int) -> DataFrame:
    """blocks -> (block, shard, met, answer): numbers and training counts of a block's words, shard by shard.

    met: the shard's number of words that training met, in one of its rows, 0 in the others. Numbers go by
    frequency; a word that training never met is UNKNOWN.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, n, raw = b.column(0)[i].as_py(), b.column(1)[i].as_py(), zstandard.decompress(b.column(2)[i].as_py())
                steps, at = _from_planes(raw, 0, n, np.uint64)
                words, counts = np.cumsum(steps, dtype=np.uint64), _from_planes(raw, at, n, np.uint32)[0]
                rows = []
                for s, at in _dealt((words >> _DEAL).astype(np.uint32), shards):
                    steps = np.diff(words[at], prepend=np.uint64(0))
                    rows.append((s, _pack(np.array([len(at)]), _planes(steps), _planes(counts[at]))))
                s, p = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(s)), pa.array(s, pa.int32()), pa.array(p)], ["block", "shard", "payload"])

    def opened(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = zstandard.decompress(payload)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        steps, at = _from_planes(raw, 8, n, np.uint64)
        return np.cumsum(steps, dtype=np.uint64), _from_planes(raw, at, n, np.uint32)[0]

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        asked = list(map(opened, rows["payload"]))
        words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([a[1] for a in asked]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        number = np.where(counts > 0, FIRST + rank * shards + key[0], UNKNOWN)
        ends = np.cumsum([len(a[0]) for a in asked])[:-1]
        answers = [_pack(_planes(a), _planes(b)) for a, b in zip(np.split(number[at], ends), np.split(counts[at], ends))]
        return pd.DataFrame({"block": rows["block"], "shard": key[0], "met": [int((counts > 0).sum())] + [0] * (len(rows) - 1), "answer": answers})

    asked = held.select("block", "n_words", "words").mapInArrow(ask, "block string, shard int, payload binary")
    return asked.groupBy("shard").applyInPandas(count, "block string, shard int, met long, answer binary")


def _opened(row, shards: int) -> tuple[Block, np.ndarray, np.ndarray]:
    """A block with its words' numbers and training counts."""
    block = Block(row["held"], row["sizes"], int(row["n_words"]), row["deal"], row["tokens"])
    numbers, counts = np.zeros(len(block.deal), np.uint64), np.zeros(len(block.deal), np.int64)
    answer = {a["shard"]: a["answer"] for a in row["told"]}
    for s, at in _dealt(block.deal, shards):
        raw = zstandard.decompress(answer[s])
        numbers[at], end = _from_planes(raw, 0, len(at), np.uint64)
        counts[at] = _from_planes(raw, end, len(at), np.int64)[0]
    return block, numbers, counts


def score(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row a row.

    Rows whose crc32(doc_id as text) mod `folds` isn't 0 train; a null id counts as the empty text. Null and
    empty texts are one END. Repeated ids are documents of their own. An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = stored(blocks(docs, folds, block_tokens), "blocks")
    of = lambda n, over: F.aggregate(over, F.lit(0).cast("long"), lambda a, x: a + n(x))
    trains = F.zip_with("sizes", "held", lambda s, h: F.when(h, 0).otherwise(s))
    sums = held.agg(F.sum(of(lambda x: x, trains)), F.sum(of(lambda x: x, "sizes")), F.sum(of(lambda h: F.when(h, 0).otherwise(1), "held")), F.sum("n_words"))
    train_tokens, tokens, texts, words = (int(x or 0) for x in sums.first())
    shards, word_shards = max(1, round(tokens / shard_tokens)), max(1, round(words / shard_tokens))
    split = max(1, shard_tokens // 4)
    known = stored(numbered(held, word_shards), "words")
    below = train_tokens + 0.1 * (int(known.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]) + 1)
    quantiser = Quantiser(-np.log10(below + 10) - 1)

    def ask(own: pd.DataFrame) -> pd.DataFrame:
        block, numbers, counts = _opened(own.iloc[0], word_shards)
        rows = list(Grams(block, numbers, counts, texts, order, shards, split).requests())
        return pd.DataFrame({"block": own["block"].iat[0], "shard": [s for s, _ in rows], "payload": [p for _, p in rows]})

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = Requests(list(rows["payload"]), order)
        weights, backs = built(asked, below, quantiser).query(asked.words, asked.parents)
        columns = [asked.split(k, x) for k in range(order) for x in ((weights[k], backs[k]) if k < order - 1 else (weights[k],))]
        return pd.DataFrame({"block": rows["block"], "shard": int(key[0]), "answer": [_pack(*parts) for parts in zip(*columns)]})

    def combine(_: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        block, numbers, counts = _opened(own.iloc[0], word_shards)
        grams = Grams(block, numbers, counts, texts, order, shards, split)
        weights, backs = grams.answered({int(s): zstandard.decompress(a) for s, a in zip(got["shard"], got["answer"])})
        table = quantiser.table()
        left = np.append(1.0, table[1:])  # an unknown context leaves everything to the shorter one
        count = counts[block.tokens]
        base = (count + 0.1) / below
        at = grams.nodes[0][grams.place]
        p = np.where(at >= 0, table[weights[0][at]] if len(weights[0]) else 0, 0.1 / below)
        reach = np.arange(len(p)) - np.repeat(block.starts, block.sizes) + 1  # tokens and START before a token
        for k in range(2, order + 1):
            some = np.flatnonzero(reach >= k - 1)
            begin = grams.place[some] - k + 1
            context, node = grams.nodes[k - 2][begin], grams.nodes[k - 1][begin]
            back = np.where(context >= 0, left[backs[k - 2][context]] if len(backs[k - 2]) else 1.0, 1.0)
            weight = np.where(node >= 0, table[weights[k - 1][node]] if len(weights[k - 1]) else 0.0, 0.0)
            p[some] = weight + back * p[some]
        add = lambda x: np.add.reduceat(x, block.starts)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(list(own["ids"].iat[0]), dtype=object),
                "held_out": block.held,
                "n_tokens": block.sizes,
                "n_known": add((count > 0).astype(np.int64)),
                "train_tokens": train_tokens,
                "base_score": add(np.log10(base)),
                "score": add(np.log10(p)),
            }
        )

    # Both passes over the blocks read one and the same shuffle of them.
    told = known.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("told"))
    whole = held.select("block", "ids", "held", "sizes", "n_words", "deal", "tokens").join(told.hint("merge"), "block")
    asked = whole.groupBy("block").applyInPandas(ask, "block string, shard int, payload binary")
    replies = asked.groupBy("shard").applyInPandas(answer, "block string, shard int, answer binary")
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(combine, shape)
