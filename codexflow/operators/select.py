"""Units and the specs that choose them.

A unit is a group of one book (``e:<book>:<coref>``) or a link of groups of several books
(``p:<n>``).  A spec is a small dict; ``resolve`` gives its members (book, coref)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import top_value

KINDS = ("unit", "group", "tag", "type", "others", "book", "gender")


class SpecError(ValueError):
    pass


def units(groups: DataFrame, links: DataFrame | None = None, least: dict[str, int] | None = None, per_book: bool = False) -> DataFrame:
    """(unit, book, coref, type, name, pronouns, mentions) for each member of a unit.

    ``groups`` is as ``books.groups`` gives it, ``links`` has owner and member.  A unit needs the least
    number of mentions for its type: all its members together, or each member by itself.  Its type is
    that of most mentions, its name that of its largest member."""
    key = F.concat_ws(":", F.lit("e"), "book", "coref")
    rows = groups.withColumn("key", key)
    if links is not None:
        rows = rows.join(links.select(F.col("member").alias("key"), "owner"), "key", "left").withColumn("unit", F.coalesce("owner", "key")).drop("owner")
    else:
        rows = rows.withColumn("unit", F.col("key"))
    minimum = F.lit(1)
    for kind, n in (least or {}).items():
        minimum = F.when(F.col("type") == kind, n).otherwise(minimum)
    if per_book:
        rows = rows.where(F.col("mentions") >= minimum)
    weight = rows.groupBy("unit", "type").agg(F.sum("mentions").alias("n"))
    kind = weight.groupBy("unit").agg(F.max(F.struct("n", "type"))["type"].alias("unit_type"), F.sum("n").alias("total"))
    name = rows.groupBy("unit").agg(F.max_by("name", F.struct("mentions", "key")).alias("unit_name"))
    out = rows.join(kind, "unit").join(name, "unit").select("unit", "book", "coref", F.col("unit_type").alias("type"), F.col("unit_name").alias("name"), "pronouns", "mentions", "total")
    return (out if per_book else out.where(F.col("total") >= minimum)).drop("total")


def gender(units_: DataFrame) -> DataFrame:
    """(unit, pronouns): the pronouns that most of a unit's mentions go with."""
    known = units_.where("pronouns is not null")
    weighted = known.groupBy("unit", "pronouns").agg(F.sum("mentions").alias("n"))
    return weighted.groupBy("unit").agg(F.max(F.struct("n", "pronouns"))["pronouns"].alias("pronouns"))


def resolve(units_: DataFrame, spec: dict, tags: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Members (book, coref) of a spec: {"kind": ..., "id": ..., "books": [...]}.

    unit: one unit; group: several (ids); tag: units with a tag; type: all of an entity type; others: all
    of the types that ``exclude`` has, without it; book: all of a book; gender: people with these pronouns."""
    kind, value = spec.get("kind"), spec.get("id")
    if kind not in KINDS:
        raise SpecError(f"unknown kind {kind!r}")
    rows = units_
    if kind == "unit":
        rows = rows.where(F.col("unit") == value)
    elif kind == "group":
        rows = rows.where(F.col("unit").isin(*value))
    elif kind == "tag":
        if tags is None:
            raise SpecError("tags are needed")
        rows = rows.join(tags.where(F.col("member") == value).select(F.col("owner").alias("unit")), "unit", "left_semi")
    elif kind == "type":
        rows = rows.where(F.col("type") == value)
    elif kind == "book":
        rows = rows.where(F.col("book") == value)
    elif kind == "gender":
        rows = rows.where("type = 'PER'").join(gender(units_).where(F.col("pronouns") == value).select("unit"), "unit", "left_semi")
    elif exclude is not None:
        kinds = rows.join(exclude, ["book", "coref"], "left_semi").select("type").distinct()
        rows = rows.join(kinds, "type", "left_semi")
    if spec.get("books"):
        rows = rows.where(F.col("book").isin(*spec["books"]))
    members = rows.select("book", "coref").distinct()
    return members.join(exclude, ["book", "coref"], "left_anti") if exclude is not None else members


def credit(mentions: DataFrame, plurals: DataFrame) -> DataFrame:
    """Mentions of a plural group count for its members too, but not for those who are named inside
    the mention.  ``plurals`` has book, coref (the group) and member; the result adds credited."""
    plural = mentions.join(plurals.select("book", "coref", "member"), ["book", "coref"])
    inner = mentions.select("book", F.col("coref").alias("member"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    named = plural.join(inner, ["book", "member"]).where((F.col("i_start") >= F.col("start")) & (F.col("i_end") <= F.col("end"))).select("book", "mi", "member").distinct()
    extra = plural.join(named, ["book", "mi", "member"], "left_anti")
    columns = [c for c in mentions.columns if c != "coref"]
    return mentions.withColumn("credited", F.lit(False)).unionByName(extra.select(*columns, F.col("member").alias("coref"), F.lit(True).alias("credited")))


def suggest_plurals(groups: DataFrame) -> DataFrame:
    """(book, coref, members): groups named "A and B" whose parts are the names of other groups, at least
    two of them and at least half."""
    parts = F.filter(F.split(F.lower("name"), r"\s*(?:,|&|\band\b)\s*"), lambda p: F.length(p) > 0)
    split = groups.select("book", "coref", parts.alias("parts")).where("size(parts) > 1").select("book", "coref", F.size("parts").alias("n"), F.explode("parts").alias("part"))
    owners = groups.select("book", F.lower("name").alias("part"), F.col("coref").alias("member"))
    first = owners.groupBy("book", "part").agg(F.min("member").alias("member"))
    found = split.join(first, ["book", "part"]).where("member != coref").groupBy("book", "coref", "n").agg(F.sort_array(F.collect_set("member")).alias("members"))
    return found.where("size(members) >= 2 and 2 * size(members) >= n").select("book", "coref", "members")


def majority(mentions: DataFrame, value: str) -> DataFrame:
    """The most frequent value of each group, ties to the first seen."""
    return top_value(mentions, ["book", "coref"], value, "mi")
