"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base entities (mail addresses, IP addresses, card and phone numbers) are found by
regular expressions. They are the seeds: the word before one and the kind of slot it
fills make a lexical pattern, such as a number of 8 to 15 digits after "call", and
patterns and instances form a graph. In rounds a pattern is scored by the share of its
instances that are trusted, and an instance by the patterns that extract it, so that
instances found in one round make patterns of their own in the next. Confident patterns
then mark identifiers that fill the same slot but that the base patterns do not accept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.staging import stage


@dataclass(frozen=True)
class Kind:
    """A base pattern and the same pattern for Java without repeated scans and recursion.

    Possessive repeats do not backtrack into runs that nothing after them could use. The look-behind
    starts at the first character of a run, where a match starts if there is one.
    """

    name: str
    base: str
    java: str
    sign: str  # what a text with a match has
    slot: str  # words that may be such an entity, whether or not the base pattern accepts them


# A slot begins and ends with a word, punctuation around it aside.
_BEGIN = r"(?<![^\x20\x09-\x0D(\[<\"'])"
_END = r"(?=[)\]>\"'.,;:!?]*(?:[\x20\x09-\x0D]|$))"
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         rf"{_BEGIN}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9]{_END}"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
         rf"{_BEGIN}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++{_END}"),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?+[0-9])++", "[0-9]",
         rf"{_BEGIN}[0-9](?:[\x20-]?[0-9]){{15,18}}{_END}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
         rf"{_BEGIN}\+?(?:[(](?=[0-9]{{1,4}}[)]))?[0-9](?:[\x20().-]{{0,2}}[0-9]){{7,14}}{_END}"),
)
NAMES = [k.name for k in KINDS]
#: Context of a slot that no word comes before.
START = "^"
ROUNDS = 3
#: A pattern is used when at least SUPPORT different instances back it and their mean trust is CONFIDENCE or more.
SUPPORT = 20
CONFIDENCE = 0.9


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _accepted(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern passes the kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    digits = _digits(match)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    n = F.length(digits)

    def luhn(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), luhn) % 10 == 0).otherwise(False)


def _places(text: Column, pattern: str) -> Column:
    """Matches of a pattern that never matches nothing: gap, value, start, end in code points.

    The gaps between matches and the matches alternate, so their lengths give the places.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<gap:string,value:string,start:int,end:int>>").alias("out"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["value"]), F.lit(0))
        match = F.struct(pair["gap"].alias("gap"), pair["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(pair["value"].isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(match))).alias("out"))

    return F.aggregate(pairs, state, step, lambda done: done["out"])


def _spans(kind: Kind, text: Column) -> Column:
    """Accepted matches as (kind, start, end, value)."""
    empty = "array<struct<kind:int,start:int,end:int,value:string>>"
    spans = F.transform(_places(text, kind.java), lambda m: F.struct(
        F.lit(NAMES.index(kind.name)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    some = F.when(text.rlike(kind.sign), F.filter(spans, lambda s: _accepted(kind.name, s["value"])))
    return F.coalesce(some, F.array().cast(empty))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: the base entities of every row, by kind and then by place; null text is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.withColumn("spans", F.concat(*(_spans(k, F.col("text")) for k in KINDS)))


def _slots(text: Column, spans: Column, kind: int) -> Column:
    """Words that fill the slot of a kind: start, end, value, context, shape (the slot's name), kind (null: no base entity there).

    The context is the word before, in lower case with 9 for every digit, also where it fills a slot itself. Where
    a base entity of another kind is, there is no slot.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,context:string,shape:string,kind:int>>")
    last_word = r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[^\x20\x09-\x0D]*+$"

    def step(done: Column, m: Column) -> Column:
        before = F.regexp_extract(F.concat(done["last"], m["gap"]), last_word, 1)
        context = F.when(before == "", START).otherwise(F.regexp_replace(F.lower(before), "[0-9]", "9"))
        found = F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), context.alias("context"),
                         F.lit(NAMES[kind]).alias("shape"), F.lit(None).cast("int").alias("kind"))
        tail = F.regexp_extract(m["value"], r"[^\x20\x09-\x0D]++$", 0)
        return F.struct(tail.alias("last"), F.concat(done["out"], F.array(found)).alias("out"))

    listed = F.aggregate(_places(text, KINDS[kind].slot), F.struct(F.lit("").alias("last"), empty.alias("out")), step, lambda done: done["out"])

    def known(c: Column) -> Column:
        over = F.filter(spans, lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
        seed = F.when(F.exists(over, lambda s: s["kind"] == kind), kind).when(F.size(over) > 0, -1)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), c["context"].alias("context"), c["shape"].alias("shape"), seed.alias("kind"))

    some = F.when(text.rlike("[0-9]" if kind else "@"), F.filter(F.transform(listed, known), lambda c: F.coalesce(c["kind"], F.lit(0)) >= 0))
    return F.coalesce(some, empty)


def _candidates(text: Column, spans: Column) -> Column:
    """Words of all slots."""
    return F.concat(*(_slots(text, spans, k) for k in range(len(KINDS))))


def confident_patterns(words: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """context, shape, kind, confidence of the patterns that ``support`` different values back with a mean trust of ``confidence``; staged.

    ``words`` has one row per candidate. Edges of the graph are the distinct (pattern, value);
    a value is trusted fully as a seed, else by the noisy-or of its patterns' confidence, with the kind
    of the most confident one. A pattern's confidence is the mean trust of its values, its kind the most trusted one.
    """
    edges = stage(words.groupBy("context", "shape", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    of_pattern = ["context", "shape"]

    def scored(rows: DataFrame) -> DataFrame:
        trusted = F.array_max(F.array(*(F.struct(F.sum(F.when(F.col("kind") == k, F.col("trust")).otherwise(0.0)).alias("trust"), F.lit(-k).alias("minus")) for k in range(len(NAMES)))))
        return stage(rows.groupBy(*of_pattern).agg(F.avg("trust").alias("confidence"), F.count(F.lit(1)).alias("support"), (-trusted["minus"]).alias("kind"))
                     .filter("confidence > 0"), "pii-patterns")

    patterns = scored(edges.withColumn("trust", F.col("kind").isNotNull().cast("double")))
    for _ in range(ROUNDS - 1):
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        likely = F.max(F.struct(F.col("confidence"), (-F.col("kind")).alias("minus")))
        values = stage(edges.filter("kind is null").drop("kind").join(patterns, of_pattern).groupBy("value")
                       .agg((1 - F.exp(doubt)).alias("by_pattern"), (-likely["minus"]).alias("by_kind")), "pii-values")
        trust = F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("by_pattern", F.lit(0.0)))
        patterns = scored(edges.join(values, "value", "left").select(*of_pattern, "value", trust.alias("trust"), F.coalesce("kind", "by_kind").alias("kind")))
    return patterns.filter((F.col("support") >= support) & (F.col("confidence") >= confidence)).select(*of_pattern, "kind", "confidence")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end) for every row of ``docs``.

    Places are code points, the end exclusive; kinds are numbered as in KINDS. ``added``
    are words that a confident pattern marks and no base entity touches; a small table,
    whose patterns have fewer than ``support`` values, gets none. Null text is
    empty; an empty table gives an empty result; rows that repeat an id are separate.
    Other columns are ignored.
    """
    found = base_spans(docs, id_col, text_col)
    bare = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = stage(found.select("doc_id", bare.alias("base"), _candidates(F.col("text"), F.col("spans")).alias("words"),
                              F.monotonically_increasing_id().alias("_row")), "pii-rows")
    words = rows.select("_row", F.explode("words").alias("w")).select("_row", "w.*")
    patterns = confident_patterns(words, support, confidence)
    open_ = words.filter("kind is null").drop("kind").join(patterns, ["context", "shape"])
    added = open_.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("_row", "doc_id", "base").join(added, "_row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base entities by kind, digest of the base spans, all spans as text."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(NAMES)]
    return find(docs).select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                             _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
