import zipfile

import pytest

from codexflow.operators.state import State, StateError, export, load, save, unpack


def test_links_merge_and_split():
    s = State()
    a = s.link(["e:x:1", "e:y:1"])
    b = s.link(["e:y:1", "e:z:1"])
    assert s.links == {b: ["e:x:1", "e:y:1", "e:z:1"]} and a not in s.links or a == b
    s.unlink("e:x:1")
    s.unlink("e:z:1")
    assert s.links == {} and s.unit_of("e:y:1") is None
    with pytest.raises(StateError):
        s.link(["e:x:1", "e:x:1"])


def test_collections_are_a_tree(spark):
    s = State()
    top = s.collection("top", books=("a",))
    low = s.collection("low", top, ("b", "a"))
    assert s.books_in(top) == ["a", "b"] and s.books_in(top, deep=False) == ["a"]
    with pytest.raises(StateError):
        s.move(top, low)
    assert sorted(map(tuple, s.frame(spark, "collections").collect())) == [(top, "a"), (top, "b"), (low, "a"), (low, "b")]
    s.remove_collection(top)
    assert s.collections == {}


def test_saving_exporting_and_unpacking(tmp_path):
    s = State(tags={"e:a:1": ["x"], "e:a:b:2": ["y"]}, meta={"a": {"title": "A"}, "b": {}})
    s.link(["e:a:1", "e:b:1"])
    save(s, tmp_path / "s.json")
    assert load(tmp_path / "s.json") == s and load(tmp_path / "none.json") == State()
    folder = tmp_path / "a-20250101-000000"
    folder.mkdir()
    (folder / "a.tokens").write_text("t")
    (folder / "a.other").write_text("t")
    export(s, {"a": str(folder)}, tmp_path / "x.zip")
    got = unpack(tmp_path / "x.zip", tmp_path / "new")
    assert got.tags == {"e:a:1": ["x"]} and got.links == {} and got.meta == {"a": {"title": "A"}}
    assert (tmp_path / "new/books/a-20250101-000000/a.tokens").read_text() == "t"
    with zipfile.ZipFile(tmp_path / "x.zip", "a") as z:
        z.writestr("books/../evil", "x")
    with pytest.raises(StateError):
        unpack(tmp_path / "x.zip", tmp_path / "other")
    (tmp_path / "s.json").write_text("{")
    with pytest.raises(StateError):
        load(tmp_path / "s.json")
