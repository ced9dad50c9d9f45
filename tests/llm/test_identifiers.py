"""Personal data against the plain regexes, and the bootstrap against loops."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from layerwise.llm import identifiers as I

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BLANK = "\x20\x09-\x0d"
SHAPE = "doc_id long, text string, source string, _key string, _text string, seed string, _base string, _spans int"


def luhn(digits):
    at = [int(c) for c in reversed(digits)]
    return sum(n if i % 2 == 0 else sum(map(int, str(2 * n))) for i, n in enumerate(at)) % 10 == 0


def is_one(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if is_one(k, m.group())]
    return [(a, z, k) for a, _, z, k in sorted(out)]


def spans(row):
    return [(s.start, s.end, s.kind) for s in row._spans]


def scanned(spark, texts, **more):
    rows = [(i, t, "s", "k", "t", "x", "y", 3) for i, t in enumerate(texts)]
    got = I.scan(spark.createDataFrame(rows, SHAPE).repartition(3), **more)
    assert sorted(got.columns) == sorted(x.split()[0] for x in SHAPE.split(", "))
    return {r.doc_id: spans(r) for r in got.collect()}


def test_base_kinds_of_random_texts(spark):
    rng = random.Random(4)
    parts = ["a@b.co", "x.y+z@h-1.example.com", "@", ".", "..", "-", " ", "  ", "+", "(", ")", "1.2.3.4", "255.0.1.256", "007.1.1.1", "4111 1111 1111 1111", "4111111111111111", "9", "12", "ü", "é4", "\n", "+1 (017) 555-7713", "+", "_", "%", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(600)]
    texts += ["".join(rng.choice("+-. ()0123456789@a") for _ in range(rng.randrange(0, 60))) for _ in range(900)]
    got = scanned(spark, texts, rounds=0)
    for i, t in enumerate(texts):
        assert got[i] == base(t), t


def test_awkward_texts(spark):
    texts = [None, "", " \t\n", "a@b.c" * 3, "😀 a@b.c 😀 1.2.3.4", "mail:a@b.c,b@c.d;+49 30 1234567.", "12345678901234567890 123", "a@b..c", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111", "41111111 11111111  1", "a@b.c " * 300]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[2] != I.CONTEXT] == base(t), (t or "")[:50]


def test_very_long_runs(spark):
    """What the plain regexes would take the square of a run's length for, or a stack as deep as it."""
    n = 50_000
    cases = {
        "a" * n: [], "1" * n: [], "1 " * n: [], "+1" + " " * n + "x": [], "+1" * n: [], "=" * n: [], "x!" * n + "9": [],
        "1." * n: [(8 * i, 8 * i + 7, "ip") for i in range(n // 4)], "a." * n + "@b.c": [(0, 2 * n + 4, "email")], "a@b" + ".c" * n: [(0, 2 * n + 3, "email")],
    }
    got = scanned(spark, list(cases))
    for i, (t, expected) in enumerate(cases.items()):
        assert [s for s in got[i] if s[2] != I.CONTEXT] == expected, t[:20]


def test_an_empty_table_and_null_ids(spark):
    assert I.scan(spark.createDataFrame([], SHAPE)).count() == 0
    rows = [(None, "a@b.c"), (None, "a@b.c"), (None, None), (1, "a@b.c")]
    got = I.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(len(r._spans) for r in got) == [0, 1, 1, 1]


TAKEN = re.compile(rf"[^{BLANK}:=]+")


def mentioned(text):
    """(start, end, instance, seed, patterns) by walking the text."""
    out, at, before = [], 0, ""
    while at < len(text):
        best = None
        for k in ("email", "phone", "card", "ip"):
            p = PLAIN[k] if k != "card" else re.compile(r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])")
            m = p.search(text, at)
            if m and (best is None or m.start() < best.start()):
                best = m
        for m in TAKEN.finditer(text, at):
            if re.search("[0-9]", m.group()) and (m.start() == 0 or m.start() == at and text[at - 1] in " \t\n\x0b\x0c\r:=" or m.start() > at):
                if best is None or m.start() < best.start():
                    best = m
                break
        if best is None:
            break
        gap, hit, at = before + text[at : best.start()], best.group(), best.end()
        before = hit
        seed = any(PLAIN[k].fullmatch(hit) and is_one(k, hit) for k in PLAIN)
        lead = 0 if seed else len(re.match(r"(?:(?![^\W_]|[+@#]).)*", hit, re.S).group())
        core = hit if seed else re.sub(r"(?<=[^\W_])[\W_]+$", "", hit)[lead:]
        words = ["^", "^", *re.findall(rf"[^{BLANK}]+", gap.lower())][-2:]
        words = ["0" if re.search("[0-9]", w) else w for w in words]
        if seed or len(core) >= I.LEAST_CHARS and len(re.sub("[^0-9]", "", core)) >= I.LEAST_DIGITS:
            start = best.start() + lead
            out.append((start, start + len(core), core.lower(), seed, ["1 " + words[1], "2 " + " ".join(words)]))
    return out


def by_hand(texts, rounds=I.ROUNDS, least=I.CONFIDENT):
    found = [[m for m in mentioned(t or "")] for t in texts]
    edges, times, total = defaultdict(dict), defaultdict(int), defaultdict(int)
    for m in (m for ms in found for m in ms):
        for p in m[4]:
            edges[p][m[2]] = edges[p].get(m[2], False) or m[3]
            times[p] += 1
    for t in texts:
        w = ["^", "^", *(("0" if re.search("[0-9]", x) else x) for x in re.findall(rf"[^{BLANK}]+", (t or "").lower()))]
        for i in range(2, len(w)):
            total["1 " + w[i - 1]] += 1
            total["2 " + w[i - 2] + " " + w[i - 1]] += 1
    sure = {}
    for _ in range(rounds):
        known = defaultdict(lambda: 1.0)
        for p, c in sure.items():
            for i in edges[p]:
                known[i] *= 1 - c
        new = {}
        for p, own in edges.items():
            score = sum(1.0 if seed else 1 - known[i] if i in known else 0.0 for i, seed in own.items())
            c = round(score / (len(own) + I.PRIOR) * times[p] / max(times[p], total[p]), 9)
            if c >= least and len(own) >= I.LEAST_SUPPORT:
                new[p] = c
        sure = new
    out = []
    for t, ms in zip(texts, found):
        own = base(t)
        more = {(a, z, I.CONTEXT) for a, z, _, seed, ps in ms if not seed and any(p in sure for p in ps) and not any(b < z and a < e for b, e, _ in own)}
        order = {k: i for i, k in enumerate((*PLAIN, I.CONTEXT))}
        out.append(sorted([*own, *more], key=lambda s: (s[0], order[s[2]], s[1])))
    return out


def planted(n=100, k=20):
    """`me at` is learnt from addresses; what else follows it teaches `badge no:`, which other instances follow."""
    rng = random.Random(9)
    word = lambda: rng.choice("the of and in on lorem ipsum dolor amet sed".split())
    fill = lambda k: " ".join(word() for _ in range(k))
    texts = []
    for i in range(n):
        texts.append(f"{fill(5)} reach me at user{i}@mail.example.com {fill(4)} in 2{i:03d}x{i} {fill(3)}")
    for i in range(k):
        texts.append(f"{fill(3)}. Reach me at emp-77{i:03d}, {fill(5)}")
        texts.append(f"{fill(3)} badge no: emp-77{i:03d}! {fill(5)} of 99{i:04d} {fill(2)}")
    texts += ["badge no: zz-1234567 is new", "see badge no: (qq-7654321).", "no: 12", None, "", "reach me at 10.0.0.1 or 10.0.0.300"]
    return texts


def test_the_bootstrap_finds_what_follows_learnt_words(spark):
    texts = planted()
    got, expected = scanned(spark, texts), by_hand(texts)
    for i, t in enumerate(texts):
        assert got[i] == expected[i], t
    late = texts.index("badge no: zz-1234567 is new")
    assert got[late] == [(10, 20, "context")]  # only by a pattern of the second round
    assert scanned(spark, texts, rounds=1)[late] == []
    assert got[texts.index("see badge no: (qq-7654321).")] == [(15, 25, "context")]
    assert not any(texts[i][a:z].startswith("99") for i, s in got.items() for a, z, k in s if texts[i])  # `of` stands before other words too


def test_chance_neighbours_teach_nothing(spark):
    """Identifiers at random places: whatever stands before them mostly stands before plain words."""
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = [" ".join(rng.choice([*vocabulary, f"a{rng.randrange(99)}@b.example.com", str(rng.randrange(10**9))]) for _ in range(80)) for _ in range(60)]
    got = scanned(spark, texts)
    assert all(k != "context" for s in got.values() for *_, k in s)


def test_many_matches_and_positions(spark):
    text = "1.2.3.4 " * 1000
    for block in (7, 256):
        got = spark.createDataFrame([(text,), ("none",), ("",)], "t string").select(F.transform(I.located(F.col("t"), I.IP.pattern, block), lambda x: x["end"]).alias("e")).collect()
        assert [list(r.e) for r in got] == [[7 + 8 * i for i in range(1000)], [], []]
