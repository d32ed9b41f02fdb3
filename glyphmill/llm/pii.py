"""Personal data: four fixed patterns, and identifiers that their contexts give away.

The mentions of the fixed patterns are seeds, and so are long mixed strings: they speak for the contexts that they stand in, but
are reported only where such a context, with others in it, speaks for them.  Words that hold digits or ``@``, and groups of digits side by side, are candidate instances; the words around them, with the candidate's
shape, are lexical patterns.  Scores pass between patterns and instances a few times, and mentions of instances that
confident patterns agree on are added.  All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: The patterns.  Possessive quantifiers and the look-behind change no match: they stop Java from
#: trying again inside a run that has failed, and from recursion in long ones.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Digit groups side by side, or a word with a digit or @ in it.
CANDIDATE = r"(?<![^ \t-\r])(?:[+(]?[0-9][0-9().-]*+(?: [0-9().-]*+(?![^ \t-\r]))++|[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+)"
#: The form of a key, a token, a digest: a seed.
SECRET = "^[A-Za-z0-9+/_=-]{20,}$"
CHUNK = 128
LEAST = -(2**31) + 1


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def octet(x: Column) -> Column:
    plain = F.regexp_replace(x, "^0+", "")
    return (F.length(plain) <= 3) & (F.concat(F.lit("0"), F.substring(plain, 1, 3)).cast("int") <= 255)


def luhn(x: Column) -> Column:
    """Whether the digit string passes; the sum runs from the right."""
    back = F.reverse(x)

    def term(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(x)), term), F.lit(0), lambda a, d: a + d) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), octet),
    "card": lambda m: F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(False),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_before(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All values before each one put together by ``step``, from ``zero`` on.  In chunks, as an aggregate that makes a list copies it for each element."""
    run = lambda x: F.aggregate(x, F.array(zero), lambda a, n: F.concat(a, F.array(step(F.element_at(a, -1), n))))
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: run(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
    # of each chunk the last of its running values stands for all of it
    starts = lambda x: F.struct(x.alias("x"), run(F.transform(x, lambda c: F.element_at(c, -1))).alias("s"))
    spread = lambda z: F.flatten(F.transform(z["x"], lambda c, i: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda v: step(v, F.get(z["s"], i)))))
    made = bound(values, lambda v: F.when(F.size(v) > 0, bound(bound(chunks(v), starts), spread)))
    return F.coalesce(made, F.array().cast("array<int>"))


def sums_before(lens: Column) -> Column:
    """Sum of all values before each one."""
    return running_before(lens, F.lit(0), lambda a, n: a + n)


def largest_before(values: Column) -> Column:
    """The largest of the values before each one."""
    return running_before(values, F.lit(LEAST), lambda a, n: F.greatest(a, n))


MATCH = "array<struct<m:string,start:int,before:string,after:string>>"


def located(text: Column, pattern: str) -> Column:
    """All matches with their start: array of (match, start, piece before, piece after).  Linear in the number of matches."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    both = F.struct(found.alias("m"), F.split(text, pattern, -1).alias("between"))
    # one piece more than matches: the last row of the zipped list has none
    pairs = bound(both, lambda b: F.slice(F.arrays_zip(b["m"].alias("m"), b["between"].alias("before"), F.slice(b["between"], F.lit(2), F.size(b["between"])).alias("after")), F.lit(1), F.size(b["m"])))
    with_sums = lambda p: F.arrays_zip(p.alias("p"), sums_before(F.transform(p, lambda x: F.length(x["before"]) + F.length(x["m"]))).alias("s"))
    return F.transform(bound(pairs, with_sums), lambda z: F.struct(z["p"]["m"].alias("m"), (z["s"] + F.length(z["p"]["before"])).alias("start"), z["p"]["before"].alias("before"), z["p"]["after"].alias("after")))


def spans(text: Column, kind: str) -> Column:
    empty = F.array().cast("array<struct<start:int,end:int>>")
    valid = F.filter(located(text, PATTERNS[kind]), lambda x: VALID[kind](x["m"]))
    out = F.transform(valid, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end")))
    needed = F.contains(text, F.lit(NEEDS[kind])) & text.rlike("[0-9]") if kind != "email" else F.contains(text, F.lit("@"))
    return F.coalesce(F.when(needed, out), empty)


def plain(word: Column) -> Column:
    """A context word: lower-cased, numbers alike, without the punctuation around it unless it is nothing else."""
    low = F.regexp_replace(F.lower(word), "[0-9]+", "0")
    return F.coalesce(F.nullif(F.regexp_replace(low, r"^\p{Punct}+|\p{Punct}+$", ""), F.lit("")), low)


def shape(m: Column) -> Column:
    """What an instance looks like: numbers 0, words a, strings of both x."""
    mixed = F.regexp_replace(m, r"[0-9]+\p{L}[\p{L}0-9]*|\p{L}+[0-9][\p{L}0-9]*", "\u0001")
    return F.translate(F.regexp_replace(F.regexp_replace(mixed, "[0-9]+", "0"), r"\p{L}+", "a"), "\u0001", "x")


def is_secret(instance: Column) -> Column:
    return instance.rlike(SECRET) & (F.length(digits(instance)) >= 4) & (F.length(F.regexp_replace(instance, "[^A-Za-z]", "")) >= 4)


def extract(docs: DataFrame, rounds: int = 3, confident: float = 0.8, passing: float = 0.6, support: int = 3) -> DataFrame:
    """Spans of personal data of each row: email, ip, card, phone, and found (arrays of start, end in code points).

    A pattern is the word before an instance, the two words before it, or the word after it, with the instance's shape.  A
    pattern's confidence is the mean score of its instances, with one more of score 0;
    patterns below ``passing`` or with fewer than ``support`` instances pass nothing on.  An
    instance's score is 1 for seeds (a fixed span somewhere, or the form of a key), else the chance that at least one of its patterns
    is right.  Only that chance makes a found span, for seeds too: without rounds nothing is found.  Mentions of instances with a chance of at least ``confident`` are found spans unless they
    overlap a fixed one.  Null text is empty; rows that repeat both id and text give equal
    rows; no rows for an empty table; a very long text is one row as any other; instances that tie are all found; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("tag"), text.alias("text"))
    base = base.select("doc_id", "tag", *[spans(F.col("text"), k).alias(k) for k in PATTERNS], F.when(F.col("text").rlike("[0-9@]"), located(F.col("text"), CANDIDATE)).otherwise(F.array().cast(MATCH)).alias("cand"))
    last = lambda x: F.regexp_extract(x, r"([^ \t-\r]++)[ \t-\r]*$", 1)
    last_two = lambda x: F.regexp_extract(x, r"([^ \t-\r]++)[ \t-\r]++[^ \t-\r]++[ \t-\r]*$", 1)
    first = lambda x: F.regexp_extract(x, r"^[ \t-\r]*([^ \t-\r]++)", 1)
    none = F.array(F.lit(None).cast("string"))
    beside = F.arrays_zip(F.col("cand").alias("x"), F.concat(none, "cand.m").alias("left"), F.slice(F.concat("cand.m", none), F.lit(2), F.size("cand")).alias("right"))

    def mention(z: Column) -> Column:
        """Words beside it; of a candidate just after or before another, that one."""
        x = z["x"]
        left = F.when(F.length(last(x["before"])) > 0, last(x["before"])).otherwise(F.coalesce(z["left"], F.lit("")))
        right = F.when(F.length(first(x["after"])) > 0, first(x["after"])).otherwise(F.coalesce(z["right"], F.lit("")))
        instance = plain_token(x["m"])
        start = x["start"] + F.length(x["m"]) - F.length(F.regexp_replace(x["m"], r"^[\p{Punct}&&[^+]]+", ""))
        contexts = F.array(F.concat(F.lit("l:"), plain(left)), F.concat(F.lit("d:"), plain(last_two(x["before"])), F.lit(" "), plain(left)), F.concat(F.lit("r:"), plain(right)))
        return F.struct(start.alias("start"), (start + F.length(instance)).alias("end"), instance.alias("instance"), F.transform(contexts, lambda c: F.concat(c, F.lit("|"), shape(instance))).alias("patterns"))

    beside = F.slice(beside, F.lit(1), F.size("cand"))
    base = save(base.select("doc_id", "tag", *PATTERNS, F.filter(F.transform(beside, mention), lambda x: x["instance"] != "").alias("cand")))
    mentions = base.where(F.size("cand") > 0).select("doc_id", "tag", "cand", overlapping(F.concat(*PATTERNS), F.col("cand")).alias("fixed"))
    mentions = mentions.select("doc_id", "tag", F.explode(F.arrays_zip("cand", "fixed")).alias("x")).select("doc_id", "tag", "x.cand.*", "x.fixed")
    seed = F.col("fixed") | is_secret(F.col("instance"))
    mentions = save(mentions.withColumn("seed", seed.cast("double")))
    edges = save(mentions.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    scores = scored(edges, rounds, passing, support)
    good = scores.where(F.round("reached", 9) >= confident).select("instance")
    more = mentions.where(~F.col("fixed")).join(good, "instance").groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    out = base.drop("cand").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    return out.select("doc_id", *PATTERNS, F.coalesce("found", F.array().cast("array<struct<start:int,end:int>>")).alias("found"))


def overlapping(fixed: Column, cand: Column) -> Column:
    """Whether each candidate (start, end, in order of start) overlaps any of the fixed spans; both lists are merged, so it is linear in them."""
    marks = F.array_sort(F.concat(F.transform(fixed, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("who"), s["end"].alias("end"))), F.transform(cand, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("who"), x["end"].alias("end")))))

    def told(m: Column) -> Column:
        # the largest end of fixed spans before a mark, and the least start of those after it
        ends = largest_before(F.transform(m, lambda k: F.when(k["who"] == 0, k["end"]).otherwise(F.lit(LEAST))))
        starts = F.reverse(largest_before(F.reverse(F.transform(m, lambda k: F.when(k["who"] == 0, -k["start"]).otherwise(F.lit(LEAST))))))
        own = F.filter(F.arrays_zip(m.alias("m"), ends.alias("e"), starts.alias("s")), lambda z: z["m"]["who"] == 1)
        return F.transform(own, lambda z: (z["e"] > z["m"]["start"]) | (-z["s"] < z["m"]["end"]))

    return bound(marks, told)


def scored(edges: DataFrame, rounds: int, passing: float, support: int) -> DataFrame:
    """instance, score, reached after some rounds over the graph (pattern, instance, seed).

    ``reached`` is what the patterns say of an instance, 0 before the first round; its score, by which it speaks for its patterns, is that or its seed.
    """
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    scores = seeds.select("instance", F.col("seed").alias("score"), F.lit(0.0).alias("reached"))
    for _ in range(rounds):
        pattern = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"))
        pattern = pattern.where((F.col("n") >= support) & (F.round("confidence", 9) >= passing)).select("pattern", "confidence")
        reached = edges.join(pattern, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9)))))).alias("reached"))
        told = seeds.join(reached, "instance", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)))
        scores = save(told.select("instance", F.greatest("seed", "reached").alias("score"), "reached"))
    return scores


def plain_token(m: Column) -> Column:
    """A candidate without the punctuation around it."""
    return F.regexp_replace(m, r"^[\p{Punct}&&[^+]]+|\p{Punct}+$", "")


def listed(kinds: dict[str, str]) -> Column:
    """``kind:start:end`` of all spans of the given columns, by kind and start, comma-joined."""

    def of(kind: str, column: str) -> Column:
        return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    return F.array_join(F.concat(*[of(kind, column) for kind, column in kinds.items()]), ",")
