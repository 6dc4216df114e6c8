import pytest

from codexflow.operators import select


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("a", 1, "PER", "Ann", "she", 9), ("a", 2, "PER", "Bob", "he", 2), ("a", 3, "LOC", "the moor", None, 1), ("b", 1, "PER", "Anna", "she", 4), ("b", 2, "ORG", "Anna Ltd", None, 5), ("a", 4, "PER", "Ann and Bob", None, 3)]
    return spark.createDataFrame(rows, "book string, coref long, type string, name string, pronouns string, mentions long")


def members(df):
    return sorted((r.book, r.coref) for r in df.collect())


def test_units_of_links_and_thresholds(spark, groups):
    links = spark.createDataFrame([("p:1", "e:a:1"), ("p:1", "e:b:1")], "owner string, member string")
    got = {(r.book, r.coref): (r.unit, r.type, r.name) for r in select.units(groups, links, {"PER": 5}).collect()}
    assert got[("b", 1)] == ("p:1", "PER", "Ann") and ("a", 2) not in got and ("a", 3) in got
    assert ("b", 1) not in {(r.book, r.coref) for r in select.units(groups, links, {"PER": 5}, per_book=True).collect()}


def test_specs(spark, groups):
    u = select.units(groups)
    assert members(select.resolve(u, {"kind": "unit", "id": "e:a:1"})) == [("a", 1)]
    assert members(select.resolve(u, {"kind": "type", "id": "PER", "books": ["a"]})) == [("a", 1), ("a", 2), ("a", 4)]
    assert members(select.resolve(u, {"kind": "gender", "id": "she"})) == [("a", 1), ("b", 1)]
    tags = spark.createDataFrame([("e:a:2", "x")], "owner string, member string")
    assert members(select.resolve(u, {"kind": "tag", "id": "x"}, tags)) == [("a", 2)]
    ann = select.resolve(u, {"kind": "unit", "id": "e:a:1"})
    assert members(select.resolve(u, {"kind": "others"}, exclude=ann)) == [("a", 2), ("a", 4), ("b", 1)]
    with pytest.raises(select.SpecError):
        select.resolve(u, {"kind": "nothing"})


def test_plurals(spark, groups):
    assert [(r.coref, r.members) for r in select.suggest_plurals(groups).collect()] == [(4, [1, 2])]
    mentions = spark.createDataFrame([("a", 0, 4, 0, 2), ("a", 1, 1, 0, 0), ("a", 2, 4, 9, 9)], "book string, mi long, coref long, start long, end long")
    plurals = spark.createDataFrame([("a", 4, 1), ("a", 4, 2)], "book string, coref long, member long")
    got = sorted((r.mi, r.coref, r.credited) for r in select.credit(mentions, plurals).collect())
    assert got == [(0, 2, True), (0, 4, False), (1, 1, False), (2, 1, True), (2, 2, True), (2, 4, False)]
