"""Personal data: four kinds by their form, and what stands where those stand; DataFrame functions only.

The base kinds (email, ip, card, phone) are regular expressions whose matches are tested. They seed a bootstrap:
words before an identifier are lexical patterns. Patterns and instances (the identifiers' texts) form a graph, in
which confidence goes back and forth for a fixed number of rounds: a pattern is as good as the instances that
follow it and as rare before anything else; an instance is as good as the patterns before it. What looks like an
identifier, is none of the base kinds and follows a confident pattern is found too, as kind `context`.

All steps are grouped sums and joins over the corpus. A pattern that can never reach the threshold is left out
of the rounds by a bound, not by a cap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, packed_row, row_key, small, stored, unpacked

# Each regex gives the leftmost matches that do not overlap, of which `tested` are kept. Quantifiers give nothing back,
# and a match can only start where a run of its first characters starts: so a long run is read once, and Java's matcher
# never recurses with its length.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    mark: str  # without a match of this there is none of the kind


EMAIL = Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++", "@")
IP = Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]")
#: A whole chain of digits, single blanks or hyphens between them, of 14 to 19 digits; longer and shorter ones fail anyway.
CARD = Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]")
BASE = (EMAIL, IP, CARD, PHONE)
CONTEXT = "context"

#: Something that may be an identifier: one of the base kinds, or what holds a digit between blanks, colons and equality signs.
_BLANK = r"\x20\x09-\x0D"
_MENTION = "|".join([EMAIL.pattern, PHONE.pattern, CARD.pattern, IP.pattern, rf"(?<![^{_BLANK}:=])[^{_BLANK}:=0-9]*+[0-9][^{_BLANK}:=]*+"])
LEAST_CHARS, LEAST_DIGITS = 5, 3
ROUNDS = 3
CONFIDENT = 0.8
PRIOR = 1.0  # instances of confidence 0 that every pattern is thought to have had
LEAST_SUPPORT = 4  # PRIOR and CONFIDENT demand as many instances of a pattern

_SPAN = "struct<start:int,end:int,kind:string>"
_NO_SPANS = f"array<{_SPAN}>"


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def located(text: Column, pattern: str, block: int = 256) -> Column:
    """array<struct<gap, hit, end>>: each match, the text between it and the one before, and where it ends in code points.

    Ends are running sums of the pieces' lengths: inside blocks, and over the blocks, so that many matches don't
    cost their square.
    """
    gap_hit = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    size = lambda x: F.length(x["gap"]) + F.length(x["hit"])

    def summed(x: Column, start: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            end = acc["at"] + size(piece)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(piece["gap"].alias("gap"), piece["hit"].alias("hit"), end.alias("end")))).alias("out"))

        return F.aggregate(x, F.struct(start.alias("at"), F.array().cast("array<struct<gap:string,hit:string,end:int>>").alias("out")), step, lambda acc: acc["out"])

    def ends(pieces: Column) -> Column:
        cut = lambda b: F.slice(pieces, b * block + 1, F.lit(block))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / block).cast("int")), cut)

        def starts(of: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                total = F.aggregate(x, F.lit(0), lambda n, piece: n + size(piece))
                return F.struct((acc["at"] + total).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

            return F.aggregate(of, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

        return let(blocks, lambda of: let(starts(of), lambda at: F.flatten(F.zip_with(of, at, summed))))

    none = F.array().cast("array<struct<gap:string,hit:string,end:int>>")
    # The piece after the last match has no match.
    return let(F.filter(gap_hit, lambda x: x["hit"].isNotNull()), lambda pieces: F.when(F.size(pieces) > 0, ends(pieces)).otherwise(none))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0: from the last on, every second one counts twice, as the sum of its digits."""
    def step(acc: Column, d: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.struct((acc["sum"] + F.when(acc["even"], twice).otherwise(n)).alias("sum"), (~acc["even"]).alias("even"))

    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("even")), step, lambda acc: acc["sum"] % 10 == 0)


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def tested(hit: Column, kind: str) -> Column:
    """Whether a match of a kind's regex is one of the kind."""
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind>> of the base kinds, by start and then in the order of BASE."""
    none = F.array().cast("array<struct<start:int,at:int,end:int,kind:string>>")

    def of(i: int, kind: Kind) -> Column:
        kept = F.filter(located(text, kind.pattern), lambda x: tested(x["hit"], kind.name))
        spans = F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(i).alias("at"), x["end"].alias("end"), F.lit(kind.name).alias("kind")))
        return F.when(text.rlike(kind.mark), spans).otherwise(none)

    every = F.sort_array(F.concat(*[of(i, kind) for i, kind in enumerate(BASE)]))
    return F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _seed(hit: Column) -> Column:
    """Whether a mention as a whole is one of the base kinds."""
    whole = lambda kind: hit.rlike(f"^(?:{kind.pattern})$") & tested(hit, kind.name)
    return F.coalesce(F.when(F.contains(hit, F.lit("@")), whole(EMAIL)).when(hit.startswith("+"), whole(PHONE)).otherwise(whole(CARD) | whole(IP)), F.lit(False))


def _patterns(before: Column) -> Column:
    """The lexical patterns of what stands before a mention: its last word, and its last two, in small letters.

    A text starts with words `^`. Words that hold digits are all one word, `0`.
    """
    words = F.regexp_extract_all(F.lower(before), F.lit(rf"[^{_BLANK}]+"), F.lit(0))
    last = F.transform(F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words), F.lit(-2), F.lit(2)), _plain)
    return let(last, lambda w: F.array(_one(w[1]), _two(w[0], w[1])))


def _plain(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), F.lit("0")).otherwise(word)


def _one(last: Column) -> Column:
    return F.concat(F.lit("1 "), last)


def _two(before: Column, last: Column) -> Column:
    return F.concat(F.lit("2 "), before, F.lit(" "), last)


def mentions(docs: DataFrame) -> DataFrame:
    """docs(_key, _text) -> (_key, start, end, instance, seed, patterns): what may be an identifier, and what is one.

    A word counts without the punctuation around it, and only if it then has LEAST_DIGITS digits and LEAST_CHARS
    characters. What stands before a mention goes back to the mention before it.
    """

    def read(pieces: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.concat(F.when(i > 0, F.element_at(pieces, F.greatest(i, F.lit(1)))["hit"]).otherwise(F.lit("")), x["gap"])
            return F.struct(before.alias("before"), x["hit"].alias("hit"), x["end"].alias("end"))

        return F.transform(pieces, one)

    found = docs.where(F.col("_text").rlike("[0-9@]")).select("_key", F.explode(let(located(F.col("_text"), _MENTION), read)).alias("m")).select("_key", "m.*")
    found = found.withColumn("seed", _seed(F.col("hit")))
    lead = F.regexp_extract("hit", r"^[^\p{L}\p{N}+@#]*+", 0)
    core = F.when(F.col("seed"), F.col("hit")).otherwise(F.substring(F.regexp_replace("hit", r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", ""), F.length(lead) + 1, F.length("hit")))
    start = F.col("end") - F.length("hit") + F.when(F.col("seed"), F.lit(0)).otherwise(F.length(lead))
    found = found.select("_key", "before", "seed", start.alias("start"), core.alias("core"))
    found = found.where(F.col("seed") | ((F.length("core") >= LEAST_CHARS) & (F.length(_digits(F.col("core"))) >= LEAST_DIGITS)))
    return found.select("_key", "start", (F.col("start") + F.length("core")).alias("end"), F.lower("core").alias("instance"), "seed", _patterns(F.col("before")).alias("patterns"))


def occurrences(docs: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """docs(_text), patterns(pattern, of which there are n) -> (pattern, total): before how many words of all texts each stands."""
    words = F.regexp_extract_all(F.lower("_text"), F.lit(rf"[^{_BLANK}]+"), F.lit(0))
    started = F.array(F.lit("^"), F.lit("^"))
    pairs = let(words, lambda w: let(F.concat(started, w), lambda all_: F.arrays_zip(F.slice(all_, F.lit(1), F.size(w)).alias("a"), F.slice(all_, F.lit(2), F.size(w)).alias("b"))))
    rows = docs.select(F.inline(pairs)).toDF("a", "b").select(_plain(F.col("a")).alias("a"), _plain(F.col("b")).alias("b"))
    both = F.explode(F.array(_one(F.col("b")), _two(F.col("a"), F.col("b")))).alias("pattern")
    if n * 64 <= BROADCAST_BYTES:  # few enough to leave all other words out before anything is shuffled
        lasts = patterns.select(F.element_at(F.split("pattern", " "), -1).alias("b")).distinct()
        rows = rows.join(F.broadcast(lasts), "b", "left_semi").select(both).join(F.broadcast(patterns.select("pattern")), "pattern", "left_semi")
        return rows.groupBy("pattern").agg(F.count("*").alias("total"))
    rows = rows.groupBy("a", "b").agg(F.count("*").alias("n")).select(both, "n").groupBy("pattern").agg(F.sum("n").alias("total"))
    return rows.join(patterns.select("pattern"), "pattern", "left_semi")


def confident(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS, least: float = CONFIDENT) -> tuple[DataFrame, int]:
    """The patterns before identifiers, (pattern, confidence) of at least `least`, and how many there are.

    A pattern's confidence is (the sum of its distinct instances' confidence) / (their number + PRIOR), times the share
    of all words after it that may be an identifier at all. An instance that is one of the base kinds has confidence 1,
    another 1 - the product of (1 - confidence) of the confident patterns before it; at first 0. Copies of a document
    add nothing to a pattern's instances.
    """
    edges = found.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = stored(edges, "pattern-instances")
    # Fewer instances than these can't give the confidence asked for, whatever they are.
    fewest = max(LEAST_SUPPORT, int(least * PRIOR / (1 - least) + 1 - 1e-9)) if least < 1 else LEAST_SUPPORT
    patterns = stored(edges.groupBy("pattern").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where(F.col("d") >= fewest), "patterns")
    edges = stored(edges.drop("n").join(small(patterns, patterns.count(), 128), "pattern"), "open-pattern-instances")
    sure, size, shares = None, 0, None
    for _ in range(rounds):
        rows = edges.withColumn("score", F.col("seed").cast("double"))
        if sure is not None:
            known = edges.where("not seed").join(small(sure, size, 128), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("known"))
            rows = rows.join(known, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("known", F.lit(0.0))))
        rated = rows.groupBy("pattern").agg((F.sum("score") / (F.max("d") + PRIOR)).alias("best"), F.max("n").alias("n"))
        rated = stored(rated.where(F.round("best", 9) >= least), "rated-patterns")  # the share can only lower it
        new = stored(rated if shares is None else rated.join(shares, "pattern", "left_anti"), "new-patterns")
        n_new = new.count()
        if n_new:
            share = F.col("n") / F.greatest("n", F.coalesce("total", F.lit(0)))
            more = stored(new.join(occurrences(docs, new, n_new), "pattern", "left").select("pattern", share.alias("share")), "pattern-shares")
            shares = more if shares is None else shares.unionByName(more)
        if shares is not None:
            rated = rated.join(shares, "pattern").select("pattern", F.round(F.col("best") * F.col("share"), 9).alias("confidence"))
        else:
            rated = rated.select("pattern", F.col("best").alias("confidence"))
        sure = stored(rated.where(F.col("confidence") >= least), "sure-patterns")
        before, size = size, sure.count()
        if size == before == 0:
            break  # nothing can change any more
    return sure, size


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, least: float = CONFIDENT) -> DataFrame:
    """Adds _spans, array<struct<start, end, kind>> by start and then kind, to every row of docs.

    Base kinds are always found. `context` spans never overlap those of a base kind. A null text counts as empty and
    gives no spans; an empty table an empty table. Rows with equal keys and texts get equal spans; null keys are no problem.
    All columns pass through; one named _spans is replaced.
    """
    columns = docs.columns
    rows = docs.select(packed_row(docs), row_key({"doc_id": F.col(f"`{key}`"), "text": F.col(f"`{text}`")}).alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    found = stored(mentions(rows.select("_key", "_text")), "mentions")
    sure, size = confident(rows.select("_text"), found, rounds, least)
    rows = rows.withColumn("_base", base_spans(F.col("_text"))).drop("_text")
    no_more = F.array().cast(_NO_SPANS)
    if size:
        more = found.where("not seed").select("_key", "start", "end", F.explode("patterns").alias("pattern")).join(small(sure, size, 128), "pattern")
        more = more.groupBy("_key").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(CONTEXT).alias("kind"))).alias("_more"))
        more = stored(more, "discovered")
        rows = rows.join(small(more, more.agg(F.sum(F.size("_more"))).first()[0] or 0, 64), "_key", "left")
    else:
        rows = rows.withColumn("_more", no_more)
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    place = F.create_map(*[F.lit(x) for i, k in enumerate((*[k.name for k in BASE], CONTEXT)) for x in (k, i)])
    every = F.concat("_base", F.filter(F.coalesce("_more", no_more), apart))
    keyed = F.sort_array(F.transform(every, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return unpacked(rows.withColumn("_spans", spans), columns, "_spans")
