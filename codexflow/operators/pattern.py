"""Token patterns such as ``[word="the"] [word=".*ing"]? "of"``, and simple queries such as ``said # Holmes``.

An item is a test on a token's attributes and a number of repetitions.  The end of the
greedy match from every place is found by a recurrence over windows from the last item
to the first: the end after item k is the end after item k + 1, read as many places
ahead as the item can be repeated, the longest first.  It is linear in tokens, items and
repetitions, without backtracking.  What a pattern matches at a place does not depend on
hits before; overlapping hits are then dropped from left to right."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MOST = 10  # repetitions of an item
# What a condition can ask for.  Columns of these names may be strings, lists of strings (of which
# any may fit) or, for event and quote, true or false, asked for by the words below.
ATTRIBUTES = ("word", "lemma", "pos", "tag", "dep", "ss", "ent", "prop", "char", "speaker", "event", "quote")
TRUE_WORDS = {"event": ("yes", "event", "true"), "quote": ("in", "yes")}


class PatternError(ValueError):
    pass


@dataclass
class Condition:
    attribute: str
    value: str
    negated: bool = False


@dataclass
class Item:
    conditions: list[Condition] = field(default_factory=list)
    low: int = 1
    high: int = 1


_PART = re.compile(r"""\s*(?:\[(?P<inner>(?:[^\]"']|"[^"]*"|'[^']*')*)\]|"(?P<quoted>[^"]*)"|(?P<bare>[^\s\[\]"{}?*+]+))(?P<times>\?|\*|\+|\{\d+(?:,\d*)?\})?""")
_CONDITION = re.compile(r"""\s*(\w+)\s*(!?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s&"']+))\s*""")


def parse_simple(text: str, match: str = "word", wildcards: bool = True) -> list[Item]:
    """Words, by their form or their lemma; ``#`` is any word, unless wildcards are off."""
    if match not in ("word", "lemma"):
        raise PatternError("words are matched by word or lemma")
    items = [Item([] if w == "#" and wildcards else [Condition(match, w)]) for w in text.split()]
    if not items:
        raise PatternError("the query is empty")
    return items


def parse(text: str, attributes: tuple[str, ...] = ATTRIBUTES) -> list[Item]:
    items, at = [], 0
    text = text.strip()
    while at < len(text):
        found = _PART.match(text, at)
        if not found or found.end() == at:
            raise PatternError(f"cannot read the pattern from {text[at:at + 20]!r}")
        at = found.end()
        item = Item()
        if found["inner"] is not None:
            rest = found["inner"].strip()
            while rest:
                c = _CONDITION.match(rest)
                if not c or c[1].lower() not in attributes:
                    raise PatternError(f"cannot read the condition {rest!r}")
                item.conditions.append(Condition(c[1].lower(), next(v for v in c.groups()[2:] if v is not None), c[2] == "!="))
                rest = rest[c.end() :]
                if rest and not rest.startswith("&"):
                    raise PatternError(f"& expected before {rest!r}")
                rest = rest[1:]
        else:
            item.conditions.append(Condition("word", found["quoted"] if found["quoted"] is not None else found["bare"]))
        times = found["times"]
        if times in ("?", "*", "+"):
            item.low, item.high = {"?": (0, 1), "*": (0, MOST), "+": (1, MOST)}[times]
        elif times:
            low, comma, high = times[1:-1].partition(",")
            item.low = int(low)
            item.high = min(MOST, int(high)) if high else MOST if comma else item.low
            if not item.low <= item.high <= MOST or item.high == 0:
                raise PatternError(f"bad repetition {times}")
        items.append(item)
    if not items:
        raise PatternError("the pattern is empty")
    if all(i.low == 0 for i in items):
        raise PatternError("every part of the pattern may be absent")
    return items


@dataclass(frozen=True)
class Matching:
    """How values are compared: as regular expressions, with letters' case (words only), with wildcards."""

    regex: bool = True
    case: bool = False
    wildcards: bool = True

    def expression(self, value: str) -> str:
        if self.regex:
            return value
        if not self.wildcards:
            return re.escape(value)
        parts = [p for p in value.split("|") if p] or [value]
        return "|".join(re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in parts)

    def test(self, column: Column, value: str, case: bool = False) -> Column:
        flags = "(?s)" if case else "(?ius)"
        return F.coalesce(column.rlike(f"{flags}^(?:{self.expression(value)})$"), F.lit(False))


def value_test(column: Column, value: str, regex: bool = True, case: bool = False, wildcards: bool = True) -> Column:
    """Whole value, any case unless asked for.  Without ``regex``, ``*`` and ``?`` are wildcards and ``|`` parts alternatives."""
    return Matching(regex, case, wildcards).test(column, value, case)


def test(item: Item, kinds: dict[str, str] | None = None, matching: Matching = Matching()) -> Column:
    """Whether a token fits an item; ``kinds`` are the types of the columns."""
    out = F.lit(True)
    for c in item.conditions:
        kind, column = (kinds or {}).get(c.attribute, "string"), F.col(c.attribute)
        case = matching.case and c.attribute == "word"
        if kind == "boolean":
            asked = any(re.fullmatch(matching.expression(c.value), w, re.IGNORECASE) for w in TRUE_WORDS.get(c.attribute, ("yes", "true")))
            one = F.coalesce(column, F.lit(False)) == F.lit(asked)
        elif kind.startswith("array"):
            one = F.coalesce(F.exists(column, lambda v: matching.test(v, c.value, case)), F.lit(False))  # noqa: B023
        else:
            one = matching.test(column, c.value, case)
        out = out & (~one if c.negated else one)
    return out


def ends(tokens: DataFrame, items: list[Item], matching: Matching = Matching()) -> DataFrame:
    """(book, i, end) of the greedy match from every place that has one; end is exclusive.

    A row after the last token of each book stands for its end."""
    last = tokens.groupBy("book").agg((F.max("i") + 1).alias("i"))
    rows = tokens.withColumn("inside", F.lit(True)).unionByName(last.withColumn("inside", F.lit(False)), allowMissingColumns=True)
    ahead = W.partitionBy("book").orderBy("i")
    back = W.partitionBy("book").orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    missing = {c.attribute for item in items for c in item.conditions} - set(kinds)
    if missing:
        raise PatternError(f"these tokens have no {', '.join(sorted(missing))}")
    tests = [(F.col("inside") & test(item, kinds, matching)).alias(f"t{k}") for k, item in enumerate(items)]
    rows = rows.select("book", "i", "inside", *tests)
    rows = rows.withColumn("r", F.col("i"))
    for k in range(len(items) - 1, -1, -1):
        item = items[k]
        stop = F.min(F.when(~F.col(f"t{k}"), F.col("i"))).over(back)
        rows = rows.withColumn("run", stop - F.col("i"))
        # the longest repetition whose rest matches
        choices = [F.when(F.col("run") >= n, F.lead("r", n).over(ahead) if n else F.col("r")) for n in range(item.high, item.low - 1, -1)]
        rows = rows.withColumn("r", F.coalesce(*choices))
    return rows.where(F.col("inside") & (F.col("r") > F.col("i"))).select("book", "i", F.col("r").alias("end"))


def leftmost(hits: DataFrame) -> DataFrame:
    """Drop hits that begin before the end of the last one that is kept, book by book.

    Hits come in islands: one that begins after all earlier ones have ended is kept whatever was
    before it.  So only the hits of an island are folded, in order, as one list."""
    before = W.partitionBy("book").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce(F.col("i") >= F.max("end").over(before), F.lit(True))
    rows = hits.select("book", "i", "end").withColumn("new", new.cast("long"))
    rows = rows.withColumn("island", F.sum("new").over(W.partitionBy("book").orderBy("i")))
    lists = rows.groupBy("book", "island").agg(F.array_sort(F.collect_list(F.struct("i", "end"))).alias("hits"))
    fold = lambda kept, h: F.when((F.size(kept) > 0) & (h["i"] < F.element_at(kept, -1)["end"]), kept).otherwise(F.concat(kept, F.array(h)))
    kept = F.aggregate("hits", F.slice("hits", 1, 0), fold)
    return lists.select("book", F.explode(kept).alias("h")).select("book", "h.i", "h.end")


def search(tokens: DataFrame, query: str, attributes: tuple[str, ...] = ATTRIBUTES, matching: Matching = Matching(), simple: bool = False, match: str = "word", accept: DataFrame | None = None) -> DataFrame:
    """Hits of a query; lines of a query are alternatives, the first that matches at a place counts.
    With ``simple``, lines are words.  ``accept`` (book, i, end) leaves only those hits, before
    overlapping ones are dropped."""
    found = None
    for line, text in enumerate(t for t in query.splitlines() if t.strip()):
        items = parse_simple(text, match, matching.wildcards) if simple else parse(text, attributes)
        how = Matching(False, matching.case, matching.wildcards) if simple else matching  # words are no regular expressions
        one = ends(tokens, items, how).withColumn("line", F.lit(line))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise PatternError("the query is empty")
    if accept is not None:
        found = found.join(accept.select("book", "i", "end"), ["book", "i", "end"], "left_semi")
    first = found.groupBy("book", "i").agg(F.min_by("end", "line").alias("end"))
    return leftmost(first)
