"""The trie of conversations' prefixes against one built from dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from layerwise.llm import prefixes
from layerwise.llm.common import words

SHAPE = "conv_id long, turn long, role string, text string"


def by_hand(rows, stride=prefixes.STRIDE, heads=prefixes.HEADS):
    """(conv_id, depth) -> the rest of a node's row; rows must not tie in a conversation's turns unless they are equal."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for v in own.values():
        v.sort()
    made, nodes, below = {}, defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % stride) * (1 if c >= 0 else -1)
        made[c] = [x[2:] for x in own.get(base, [])[:h]] + [x[2:] for x in own[c][h:]]
        for d in range(len(made[c]) + 1):
            nodes[tuple(made[c][:d])].append(c)
    for n in nodes:
        if n:
            below[n[:-1]].append(n)
    sums = {}
    for n in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[n]) - 1) * (len(words(n[-1][1])) if n else 0)
        sums[n] = (sum(sums[k][0] for k in below[n]) or 1, saved + sum(sums[k][1] for k in below[n]))
    out = {}
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(n))
        out[min(members), len(n)] = (min(nodes[n[:-1]]) if n else None, len(members), len(below[n]), *sums[n], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(spark, rows, shape=SHAPE, **more):
    got = prefixes.prefix_trie(spark.createDataFrame(rows, shape), **more).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1))  # preorder places are dense
    spans = [(r.place, r.last_place) for r in got]
    assert all(a <= z for a, z in spans) and all(z1 <= z or a1 > z or a1 <= a for a, z in spans for a1, z1 in spans)  # intervals nest
    return out


@pytest.fixture()
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_tries_of_many_shapes(spark):
    rng = random.Random(5)
    rows = []
    for c in range(-25, 90):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "", "a  b\tc"])))
    assert found(spark, rows) == by_hand(rows)


def test_awkward_conversations(spark):
    rows = [
        (1, None, "user", "hi"), (1, 0, None, "x y"), (1, 1, "user", None), (1, 1, "user", None),  # null turn first; null role and text; a repeated row
        (21, 0, "u", "a"), (21, 1, "u", "b"), (22, 0, "ua", ""), (23, 0, "u", "a"), (23, 5, "u", "z"),  # without a first conversation; role and text kept apart
        (None, 0, "user", "nobody"), (40, 0, "u", "a " * 5000), (41, 3, "u", "q"), (42, 4, "u", "q"),
    ]
    assert found(spark, rows) == by_hand(rows)
    clashing = [(*r, 1, "x", "y") for r in rows]
    assert found(spark, clashing, SHAPE + ", digest long, pos string, place string") == by_hand(rows)


def test_no_conversations(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, 0, "a", "b")]) == {}


def test_long_and_common_conversations(spark, monkeypatch, many_ranges):
    """Blocks of names several levels deep, chunks, and a conversation that a third of all are copies of."""
    monkeypatch.setattr(prefixes, "CHUNK", 8)
    rows = [(c, t, "u", f"t{t % 3}") for c in (0, 300, 301) for t in range(200 + c % 7)]
    rows += [(c, t, "u", f"same {t}") for c in range(1000, 1120) for t in range(3)]
    monkeypatch.setattr(prefixes, "BLOCK", 4)
    monkeypatch.setattr(prefixes.ranked, "__defaults__", (4,))
    assert found(spark, rows) == by_hand(rows)


def test_running_sums_over_ranges(spark, many_ranges):
    rows = prefixes.laid_out(spark.range(1000).selectExpr("id % 7 AS a", "id"), "t", "a", "id")
    assert rows.selectExpr("_g >> 33 AS p").distinct().count() > 1
    got = prefixes.running(rows, at=prefixes.F.lit(1), total=prefixes.F.col("id")).orderBy("a", "id").collect()
    assert [r.at for r in got] == list(range(1, 1001))
    assert got[-1].total == sum(range(1000)) and all(b.total - a.total == b.id for a, b in zip(got, got[1:]))
