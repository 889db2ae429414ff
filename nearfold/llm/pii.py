"""Personal data in texts, with Spark's own functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for bank accounts), and words nearby
raise the score of each; kinds without a checksum that look like plain numbers need such a word.

A match's place comes from the pieces between matches: ``split`` and ``regexp_extract_all`` walk the same matches, so a
start is the length of all pieces up to it and of the matches before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a span that are searched for context words.
NEAR = 48
LEAST_SCORE = 0.5
#: Matches of a text that are gathered in one list.
RUN = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    holds: str  # only a text that contains this can match
    prior: float
    context: str  # words that raise the score
    base: bool


_LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed values. Look-behinds only save starts within a run that could not match; possessive loops need no stack.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "e-?mail|contact|write|mailto", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|address|host|server|login", True),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "", 0.8, "card|visa|mastercard|amex|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.8, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security|taxpayer", False),
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(match)), ""), lambda c: c.cast("int"))
    d = F.filter(d, lambda x: x.isNotNull())
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    s = F.regexp_replace(match, " ", "")
    chars = F.split(F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97)
    return rest == 1


def _valid(name: str, match: Column) -> Column:
    if name == "ip":
        # more digits than three can still be at most 255 if they lead with zeros
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255)
    if name == "card":
        return _luhn(match)
    if name == "phone":
        return F.length(_digits(match)).between(10, 15)
    if name == "iban":
        return _mod97(match)
    return F.lit(True)


def _runs(array: Column) -> Column:
    """``array`` cut into arrays of RUN; it is worked out once, as a variable of the outer function."""
    last = lambda f: F.floor((F.size(f) - 1) / RUN).cast("int")
    return F.get(F.transform(F.array(array), lambda f: F.transform(F.sequence(F.lit(0), last(f)), lambda b: F.slice(f, b * RUN + 1, RUN))), F.lit(0))


def _spans(k: int, kind: Kind, text: Column, matches: Column) -> Column:
    """array<struct<start, kind, end, score>> of the valid matches, by start.

    Places are sums over the pieces so far, and the NEAR characters before a match are carried along, so that no text is walked
    again for a match. A list grows by copying: matches are gathered in lists of RUN, and those in a list of lists.
    """
    found = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), matches.alias("match"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string>>)")
    nothing = F.expr("cast(array() as array<array<struct<start:int,end:int,match:string,before:string>>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(NEAR))
        tail = F.right(F.concat(acc["tail"], x["gap"], F.coalesce(x["match"], F.lit(""))), F.lit(NEAR))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), before.alias("before")))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["out"], one).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        here = F.aggregate(part, F.struct(acc["last"]["at"].alias("at"), acc["last"]["tail"].alias("tail"), none.alias("out")), step)
        return F.struct(here.alias("last"), F.concat(acc["done"], F.array(acc["last"]["out"])).alias("done"))

    start = F.struct(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")).alias("last"), nothing.alias("done"))
    placed = F.aggregate(_runs(found), start, run, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]["out"]))))
    valid = F.filter(placed, lambda s: s["match"].isNotNull() & _valid(kind.name, s["match"]))

    def scored(s: Column) -> Column:
        near = F.lower(s["before"]).rlike(rf"(?:^|[^a-z])(?:{kind.context})")
        score = F.lit(kind.prior) + F.when(near, 0.25).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    out = F.transform(valid, scored)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<struct<start, kind, end, score>>) for every row of ``docs``; ``kind`` is a place in KINDS.

    Spans are in code points, end exclusive, ordered by start and then kind. Base kinds: leftmost matches that do not
    overlap, each checked once. Null and empty texts have none. Rows that repeat come out as often; other columns are not
    read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    some = lambda k: F.regexp_extract_all(F.col("text"), F.lit(k.pattern), F.lit(0))
    raw = docs.select("doc_id", text.alias("text"))
    raw = raw.select("doc_id", "text", *(F.when(F.contains("text", F.lit(k.holds)), some(k)).alias(f"m_{k.name}") if k.holds else some(k).alias(f"m_{k.name}") for k in KINDS))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,score:double>>)")
    each = [F.when(F.size(f"m_{k.name}") > 0, _spans(i, k, F.col("text"), F.col(f"m_{k.name}"))).otherwise(none) for i, k in enumerate(KINDS)]
    return raw.select("doc_id", F.sort_array(F.concat(*each)).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
