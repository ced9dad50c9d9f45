"""Lexical retrieval packing: documents go into fixed windows beside their BM25 neighbours.

Texts are tokenised once and kept as ids in the shared folder. Documents are dealt into shards of about
SHARD_TOKENS ids by what they say: a tree of halving cuts, learned from a sample, sorts vectors of weighted words
into leaves, and near copies (by MinHash) go where the first of them goes. Leaves that are too big are dealt
by groups of near copies, and groups that are too big by hashes. Each shard has an inverted index of its documents' words; document frequencies come from the
whole corpus, over hashed words, and so have a fixed size. A window starts with a seed document; what is left
of it is filled by the seed's best unused neighbours, then by the next unused documents. The document that
meets the window's end is cut there, and its rest is the next window's seed. Only the last window of a shard
can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BYTES, bounded_batches, hashed_runs, measured, small, stored

TOKENIZER = "word_bpe_49k.json"
WINDOW = 4096
END = 2
_TERM_BITS = 18
TERMS = 1 << _TERM_BITS  # hashed words
SHARD_TOKENS = 600_000
K1, B = 1.2, 0.75
SAMPLE = 1 << 16  # documents that the tree is learned from
LEAVES = 1 << 14
DIMENSIONS = 32
COPY_KEYS, KEY_HASHES = 6, 3  # near copies share a key of so many MinHashes: of Jaccard 0.8 98.6 %, of 0.1 0.6 %
_PARTS = 1 << 14  # of a leaf, and of a group of near copies
_MEMO = 600_000
_SLOT_BITS = 20
_SEQUENCES = 1 << 20  # ids of sequences in a shard

_PART = 1 << 21  # bytes of text that are cut into runs at a time
_WORD_END = "</w>"
_ZSTD = zstandard.ZstdCompressor(1)
# What the tokenizer file does with plain texts: ASCII and the Latin-1 letters, which take two bytes in UTF-8.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3])  # in UTF-8 the ones from 0x80 on only follow 0xC3 then
_SIGNS = ("×".encode(), "÷".encode(), b"<|")  # no letters, and what may start a special token
_AFTER = np.zeros(256, bool)  # letters that an apostrophe before them joins
_AFTER[list(b"stmd")] = True


def runs_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and sizes of the runs that the tokenizer cuts a plain lower-cased text into.

    Runs are letters, single digits, or other signs; an apostrophe that starts a run takes s, t, m, d, re, ve or ll along.
    """
    found: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at = 0
    while at < len(text):
        end = text.rfind(b" ", at, at + _PART) + 1 if at + _PART < len(text) else len(text)
        if not end:  # one long word
            end = text.find(b" ", at + _PART) + 1 or len(text)
        piece = np.frombuffer(text, np.uint8, end - at, at)
        kind = _KIND[piece]
        begin = np.append(True, kind[1:] != kind[:-1]) | (kind == _DIGIT)
        mark = np.flatnonzero((piece == 39) & begin)
        if len(mark):
            padded = np.append(piece, np.zeros(3, np.uint8))
            one, two = padded[mark + 1], padded[mark + 2]
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            takes = np.where(_AFTER[one], 2, np.where(long, 3, 0))
            mark, takes = mark[takes > 0], takes[takes > 0]
            begin[mark + 1] = False
            begin[(mark + takes)[mark + takes < len(piece)]] = True
        inside = np.flatnonzero(kind != _SPACE)
        if len(inside):
            starts = np.flatnonzero(begin[inside])
            sizes = np.diff(np.append(starts, len(inside)))
            found.append((hashed_runs(piece[inside], starts, sizes), inside[starts] + at, sizes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


class Encoder:
    """Texts' ids. Plain texts are cut into runs by array operations, and each different run is encoded once; any
    other text goes word by word, as the tokenizer never joins letters across a space or line feed.

    New runs are encoded many at a time by byte pairs, with a zero byte for a word's end.
    """

    def __init__(self, name: str = TOKENIZER) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        marked = [i for t, i in vocabulary.items() if t.endswith(_WORD_END)]
        self.ends = np.full(max(vocabulary.values()) + 1, not marked)  # whether an id ends a word
        self.ends[marked] = True
        self.by_runs = name == TOKENIZER
        if self.by_runs:
            shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            byte = {chr(c): c for c in range(33, 127)}
            for c in map(chr, range(0xC0, 0x100)):
                byte |= dict(zip(shown.pre_tokenize_str(c)[0][0], c.encode()))
            ranks = {}
            for t, i in vocabulary.items():
                letters = t.removesuffix(_WORD_END)
                if letters and all(c in byte for c in letters):
                    ranks[bytes(byte[c] for c in letters) + b"\0" * t.endswith(_WORD_END)] = i
            ranks[b"\0"] = 1 << 20  # merged before anything else: a letter with a word's end has one of the first ids
            self.pairs = tiktoken.Encoding("runs", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of known runs, sorted; places in edges
        self.ids, self.edges = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.letters, self.bounds = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # of known runs, by their places
        self.slots = self.slot_places = np.zeros(0, np.int64)  # made when runs are met: the driver has no use for them

    def _learn(self, keys: np.ndarray, runs: list[bytes]) -> None:
        ids = np.array(self.pairs.encode_ordinary((b"\0".join(runs) + b"\0").decode()), self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        assert len(ends) == len(runs)
        self.bounds = np.append(self.bounds, np.cumsum(list(map(len, runs))) + len(self.letters))
        self.letters = np.append(self.letters, np.frombuffer(b"".join(runs), np.uint8))
        places = np.arange(len(runs)) + len(self.edges) - 1
        self.edges = np.append(self.edges, ends + len(self.ids))
        self.ids = np.append(self.ids, ids)
        keys, places = np.append(self.keys, keys), np.append(self.places, places)
        order = np.argsort(keys)
        self.keys, self.places = keys[order], places[order]

    def _same(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which runs of letters are the known ones at these places, letter by letter."""
        same = sizes == self.bounds[places + 1] - self.bounds[places]
        like = np.flatnonzero(same)
        if len(like):
            size = sizes[like]
            before = np.cumsum(size) - size
            inside = np.arange(size.sum()) - np.repeat(before, size)
            differ = letters[inside + np.repeat(starts[like], size)] != self.letters[inside + np.repeat(self.bounds[places[like]], size)]
            same[like] = ~np.logical_or.reduceat(differ, before)
        return same

    def _plain(self, raw: list[bytes]) -> list[np.ndarray]:
        letters = np.frombuffer(b" ".join(raw).lower(), np.uint8).copy()
        second = np.flatnonzero(letters == 0xC3) + 1
        letters[second[letters[second] < 0x9F]] += 32  # capitals: À to Þ
        text = letters.tobytes()
        hashes, starts, sizes = runs_of(text)
        if len(self.keys) > _MEMO:
            self._clear()
        if not len(self.slots):
            self.slots, self.slot_places = np.full(1 << _SLOT_BITS, ~np.uint64(0)), np.full(1 << _SLOT_BITS, -1)  # hashes last met, by their first bits
            self.slots[-1] = 0  # an empty slot holds a hash that belongs to another
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        met = np.flatnonzero(self.slots[slot] == hashes)
        place = np.full(len(hashes), -1)
        place[met] = self.slot_places[slot[met]]
        some = np.full(len(self.bounds) - 1, -1)  # one of the runs that are met at each place; its letters are compared
        some[place[met]] = met
        of_place = np.flatnonzero(some >= 0)
        some[of_place[self._same(letters, starts[some[of_place]], sizes[some[of_place]], of_place)]] = -1
        place[met[some[place[met]] >= 0]] = -1
        rest = np.flatnonzero(place < 0)
        order = np.argsort(hashes[rest])
        keys = hashes[rest[order]]
        fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(fresh) - 1
        keys, first = keys[fresh], rest[order[fresh]]
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        run_of = lambda places: [text[a:b] for a, b in zip(starts[places].tolist(), (starts[places] + sizes[places]).tolist())]
        old = np.flatnonzero(known)
        odd = old[~self._same(letters, starts[first[old]], sizes[first[old]], self.places[at[old]])]
        for i, run in zip(odd.tolist(), run_of(first[odd])):
            seed, other = 0, None
            while run != other:  # a stored run has the same hash
                seed += 1
                keys[i] = xxhash.xxh64_intdigest(run, seed)
                known[i] = keys[i] in self.keys
                p = self.places[np.searchsorted(self.keys, keys[i])] if known[i] else -1
                other = self.letters[self.bounds[p] : self.bounds[p + 1]].tobytes() if known[i] else run
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(keys[new], run_of(first[new]))
        found = self.places[np.searchsorted(self.keys, keys)]
        slot = (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slots[slot] = keys
        self.slot_places[slot] = found
        place[rest] = found[which]
        start, size = self.edges[place], self.edges[place + 1] - self.edges[place]
        after = np.cumsum(size)
        flat = self.ids[np.arange(after[-1] if len(after) else 0) + np.repeat(start - (after - size), size)]
        edges = np.append(0, after)[np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))]
        end = self.kind.type(END)
        return [np.append(flat[a:b], end) for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def _wordwise(self, text: str) -> np.ndarray:
        if len(self.words) > _MEMO:
            self.words.clear()
        found = []
        for word in text.replace("\n", " ").split(" "):
            if word not in self.words:
                self.words[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind)
            found.append(self.words[word])
        return np.concatenate([*found, np.array([END], self.kind)])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, then END."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, raw = [], []
        for i, text in enumerate(texts):
            b = text.encode("utf-8", "surrogatepass")
            if self.by_runs and not b.translate(None, _PLAIN) and not any(x in b for x in _SIGNS):
                plain.append(i)
                raw.append(b)
                continue
            out[i] = self._wordwise(text)
        if raw:
            for i, ids in zip(plain, self._plain(raw)):
                out[i] = ids
        return out


@lru_cache(1)
def encoder(name: str) -> Encoder:
    """One worker's encoder; its memos are bounded and outlive a task."""
    return Encoder(name)


def terms(ids: list[np.ndarray], ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document the hashed words of its ids, and how often each occurs. A word is the ids up to one that ends it."""
    out, sizes = [], np.array(list(map(len, ids)), np.int64)
    for cut in pieces(sizes):
        flat, edges = np.concatenate(ids[cut]), np.cumsum(sizes[cut])
        last = ends[flat]
        last[edges - 1] = True
        starts = np.append(0, np.flatnonzero(last)[:-1] + 1)
        place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
        factor = np.arange(place.max() + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9)
        h = (flat.astype(np.uint64) + np.uint64(1)) * factor[place]
        word = np.add.reduceat(h ^ (h >> np.uint64(29)), starts) * np.uint64(0x94D049BB133111EB)
        document = np.searchsorted(edges, starts, "right")
        key, counts = np.unique((document << _TERM_BITS) | (word >> np.uint64(64 - _TERM_BITS)).astype(np.int64), return_counts=True)
        at = np.searchsorted(key >> _TERM_BITS, np.arange(1, len(edges)))
        out += zip(np.split((key & (TERMS - 1)).astype(np.int32), at), np.split(counts, at))
    return out


_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, COPY_KEYS * KEY_HASHES, dtype=np.uint64) | np.uint64(1)


def copy_keys(words: list[np.ndarray]) -> np.ndarray:
    """A row a document of keys that near copies share, from their hashed words; each has one at least (END)."""
    out, sizes = [np.zeros((0, COPY_KEYS), np.int64)], np.array(list(map(len, words)), np.int64)
    for cut in pieces(sizes):
        flat, starts = np.concatenate(words[cut]).astype(np.uint64) + np.uint64(1), np.cumsum(sizes[cut]) - sizes[cut]
        least = []
        for f in _FACTORS:
            h = flat * f
            least.append(np.minimum.reduceat((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB), starts))
        h = np.array(least).T.reshape(-1, COPY_KEYS, KEY_HASHES)
        key = np.tile(np.arange(COPY_KEYS, dtype=np.uint64), (len(h), 1))
        for i in range(KEY_HASHES):
            key = (key ^ h[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        out.append(key.view(np.int64))
    return np.concatenate(out)


def pieces(sizes: np.ndarray, most: int = 1 << 19) -> Iterator[slice]:
    """Slices of documents with about `most` entries together, or one document with more."""
    group = np.cumsum(sizes) // most
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(sizes)) if len(sizes) else [0]
    for a, b in zip(edges, edges[1:]):
        yield slice(int(a), int(b))


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, order, n, ids, terms, counts, keys) of every row; order is a hash of doc_id and text, terms are differences."""
    chosen = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("order"), "text")
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(tokenizer)
        for b in batches:
            ids = one.encode_all([t or "" for t in b.column(2).to_pylist()])
            sizes = np.array(list(map(len, ids)), np.int64)
            found = terms(ids, one.ends)
            steps = pa.array([np.diff(t, prepend=np.int32(0)).tobytes() for t, _ in found], pa.binary())
            counts = pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())
            keys = pa.FixedSizeListArray.from_arrays(pa.array(copy_keys([t for t, _ in found]).ravel()), COPY_KEYS).cast(pa.list_(pa.int64()))
            ids = list(map(squeezed, ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(ids, pa.binary()), steps, counts, keys], ["doc_id", "order", "n", "ids", "terms", "counts", "keys"])

    return chosen.mapInArrow(run, f"doc_id {kind}, order long, n long, ids binary, terms binary, counts binary, keys array<long>")


def squeezed(ids: np.ndarray) -> bytes:
    """Ids in fewer bytes than a shuffle would need for them: first their low bytes, then their high ones, compressed."""
    return _ZSTD.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, ids.itemsize).T))


def unsqueezed(raw: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def unpacked_terms(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.int32))


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many rows each of the TERMS hashed words occurs. Each task adds up its own; TERMS sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.zeros(TERMS, np.int64)
        for b in batches:
            found = [unpacked_terms(x) for x in b.column(0).to_pylist()]
            if found:
                freq += np.bincount(np.concatenate(found), minlength=TERMS)
        full = np.flatnonzero(freq)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(freq[full])], ["term", "n"])

    got = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    freq = np.zeros(TERMS, np.int64)
    freq[got["term"].to_numpy(np.int64)] = got["n"]
    return freq


@lru_cache(1)
def _signs() -> np.ndarray:
    return np.random.default_rng(12).integers(0, 2, (TERMS, DIMENSIONS), dtype=np.int8) * 2 - 1


def vector(words: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A unit vector of a document's words, each with its weight and BM25's saturation; 0 without such words."""
    w = weights[words] * (counts * (K1 + 1) / (counts + K1))
    v = w.astype(np.float32) @ _signs().take(words, axis=0).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-9)


class Tree:
    """Halving cuts, each between two means, that deal the sampled vectors into `leaves` leaves of like sizes."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.directions, self.cuts, self.below = [], [], []
        self.leaves = 0
        self._grow(sample, leaves)
        self.directions = np.array(self.directions, np.float32).reshape(-1, DIMENSIONS)
        self.cuts, self.below = np.array(self.cuts, np.float32), np.array(self.below, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        """The node's number; of a leaf -1 - the leaf's number."""
        if leaves < 2 or len(x) < 2:
            self.leaves += 1
            return -self.leaves
        some = x[:: max(1, len(x) // 1024)]
        along = np.linalg.eigh(np.cov(some.T.astype(np.float64)))[1][:, -1]
        for _ in range(4):
            side = some @ along > np.median(some @ along)
            if side.all() or not side.any():
                break
            along = some[side].mean(axis=0) - some[~side].mean(axis=0)
        at = x @ along.astype(np.float32)
        left = leaves // 2
        cut = np.partition(at, len(x) * left // leaves)[len(x) * left // leaves]
        below = at < cut
        node = len(self.cuts)
        self.directions.append(along), self.cuts.append(cut), self.below.append((0, 0))
        self.below[node] = self._grow(x[below], left), self._grow(x[~below], leaves - left)
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.cuts) else np.full(len(x), -1)
        while (todo := np.flatnonzero(node >= 0)).size:
            n = node[todo]
            node[todo] = self.below[n, ((x[todo] * self.directions[n]).sum(axis=1) >= self.cuts[n]).astype(np.int64)]
        return -1 - node


def dealt(rows: DataFrame, freq: np.ndarray, idf: np.ndarray, n: int, shards: int, shard_tokens: int) -> DataFrame:
    """(order, shard) of every order in rows."""
    spark = rows.sparkSession
    weights = spark.sparkContext.broadcast(np.where(freq > 1, idf, 0).astype(np.float32))  # a word of one document links nothing
    docs = rows.select("order", "n", "terms", "counts")

    def vectors(b: pa.RecordBatch) -> np.ndarray:
        pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
        return np.array([vector(unpacked_terms(t), np.frombuffer(c, np.int32), weights.value) for t, c in pairs], np.float32).reshape(-1, DIMENSIONS)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.round(v * 127).astype(np.int8).tobytes() for v in vectors(b)], pa.binary())], ["order", "v"])

    step = -(-n // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("order"), F.lit(step)) == 0).mapInArrow(sampled, "order long, v binary").orderBy("order").toPandas()  # about SAMPLE rows at most
    tree = Tree(np.array([np.frombuffer(v, np.int8) for v in sample["v"]], np.float32).reshape(-1, DIMENSIONS) / 127, min(shards, LEAVES))
    shared = spark.sparkContext.broadcast(tree)  # at most LEAVES cuts

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.leaf(vectors(b)))], ["order", "n", "leaf"])

    placed = docs.mapInArrow(leaves, "order long, n long, leaf long").groupBy("order").agg(F.sum("n").alias("n"), F.min("leaf").alias("leaf"))
    placed = stored(placed, "leaves")
    keyed = rows.select("order", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("order").alias("lead"), F.count("*").alias("of")).where("of > 1").select("key", "lead")
    led = keyed.join(measured(first, n * COPY_KEYS, KEY_BYTES), "key").groupBy("order").agg(F.min("lead").alias("lead")).where("lead < order")
    led = stored(led, "leads")
    while True:  # a lead that has a lead itself gives way to it, so that all who are linked to the last one meet
        up = led.select(F.col("order").alias("lead"), F.col("lead").alias("top"))
        jumped = stored(led.join(measured(up, n, KEY_BYTES), "lead", "left").select("order", F.coalesce("top", "lead").alias("lead"), F.col("top").isNotNull().alias("moved")), "leads")
        led = jumped.select("order", "lead")
        if jumped.where("moved").isEmpty():
            break
    moved = led.join(measured(placed.select(F.col("order").alias("lead"), F.col("leaf").alias("lead_leaf")), n, KEY_BYTES), "lead")
    placed = placed.join(measured(moved, n, KEY_BYTES), "order", "left").select("order", "n", F.coalesce("lead_leaf", "leaf").alias("leaf"), F.coalesce("lead", "order").alias("lead"))
    placed = stored(placed, "led-leaves")
    # A leaf, or a part of one, of more than two shards' ids is cut; both tables have about a row a shard.
    parts = lambda df, by, name: df.groupBy(*by).agg(F.sum("n").alias("all")).select(*by, F.when(F.col("all") > 2 * shard_tokens, F.least(F.ceil(F.col("all") / shard_tokens), F.lit(_PARTS))).otherwise(1).cast("long").alias(name))
    placed = placed.join(small(parts(placed, ["leaf"], "of_leaf"), tree.leaves, 24), "leaf")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("lead"), F.col("of_leaf")))
    placed = placed.join(small(parts(placed, ["leaf", "part"], "of_part"), 2 * shards + tree.leaves, 32), ["leaf", "part"])
    return placed.select("order", ((F.col("leaf") * _PARTS + F.col("part")) * _PARTS + F.pmod(F.xxhash64("order"), F.col("of_part"))).alias("shard"))


class Index:
    """BM25 over one shard's documents, with the corpus's document frequencies."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> None:
        self.counted, self.n = counted, len(counted)
        size = np.array([c.sum() for _, c in counted], np.float64)
        norm = K1 * (1 - B + B * size / max(size.mean(), 1.0))
        term = np.concatenate([t for t, _ in counted])
        tf = np.concatenate([c for _, c in counted]).astype(np.float64)
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in counted])
        useful = idf[term] > 0  # a word in half of all documents or more weighs nothing
        term, tf, doc = term[useful], tf[useful], doc[useful]
        order = np.argsort(term, kind="stable")
        self.term, first = np.unique(term[order], return_index=True)
        self.edge = np.append(first, len(term))
        self.doc = doc[order]
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order]

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for the seed's words."""
        words = self.counted[seed][0]
        at = np.searchsorted(self.term, words)
        words, at = words[at < len(self.term)], at[at < len(self.term)]
        at = at[self.term[at] == words]
        lo, hi = self.edge[at], self.edge[at + 1]
        place = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange((hi - lo).sum())
        return np.bincount(self.doc[place], self.weight[place], self.n)


def pack(lengths: list[int], index: Index, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, in order of sequences."""
    left = np.array(lengths, np.int64)
    done, sequence, room, carried, following = np.zeros(len(left), np.int64), 0, window, -1, 0
    unused = np.ones(len(left), bool)

    def put(d: int) -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal room, sequence, carried
        take = int(min(room, left[d]))
        yield d, int(done[d]), take, sequence, window - room
        done[d] += take
        left[d] -= take
        room -= take
        unused[d] = False
        carried = d if left[d] else -1
        if not room:
            sequence, room = sequence + 1, window

    while True:
        if carried >= 0:
            seed = carried
        else:
            while following < len(left) and not unused[following]:
                following += 1
            if following == len(left):
                return
            seed = following
        yield from put(seed)
        if room == window:
            continue  # the seed alone has filled it
        score = index.scores(seed)
        score[~unused] = 0
        filling = sequence
        best = np.flatnonzero(score)
        for d in best[np.lexsort((best, -score[best]))]:
            yield from put(int(d))
            if sequence != filling:
                break


def packed(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece.

    A null text counts as empty; an empty text is the one id END. Ids may be null or repeat: each row is a
    document of its own. Pieces of one sequence are gapless from offset 0. An empty table gives no pieces.
    """
    bounded_batches(docs.sparkSession)
    rows = stored(tokenised(docs, tokenizer), "ids")
    n, total = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("n")).first())
    shards = max(1, round(total / shard_tokens))
    freq = document_frequencies(rows)
    idf = np.maximum(0, np.log((n - freq + 0.5) / (freq + 0.5))).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # TERMS numbers, whatever the corpus
    kind, id_kind, ends = rows.schema["doc_id"].dataType.simpleString(), encoder(tokenizer).kind, encoder(tokenizer).ends

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id"], kind="stable", ignore_index=True)
        ids = [unsqueezed(x, id_kind) for x in rows["ids"]]
        index = Index(terms(ids, ends), shared.value)  # cheaper than to shuffle them
        out = []
        for d, start, length, sequence, offset in pack([len(x) for x in ids], index, window):
            crc = zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes())
            out.append((rows["doc_id"].iat[d], start, length, crc, len(ids[d]), int(key[0]) * _SEQUENCES + sequence, offset))
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    chosen = rows.select("doc_id", "order", "ids")
    chosen = chosen.join(small(dealt(rows, freq, idf, n, shards, shard_tokens), n, 24), "order") if shards > 1 else chosen.withColumn("shard", F.lit(0).cast("long"))
    return chosen.groupBy("shard").applyInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
