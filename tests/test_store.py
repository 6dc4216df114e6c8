import pytest

from codexflow.sources import annotated, store

from .test_books import rows, write


def test_books_are_parsed_once(spark, tmp_path):
    write(tmp_path / "lib" / "tale-20250101-000000")
    parsed = annotated.load(spark, str(tmp_path / "lib"))
    kept = store.materialise(parsed, str(tmp_path / "cache"))
    assert rows(kept.token, "i", "word") == rows(parsed.token, "i", "word")
    assert rows(kept.mention, "mi", "coref") == rows(parsed.mention, "mi", "coref")
    assert len(list((tmp_path / "cache").iterdir())) == 1
    store.materialise(annotated.load(spark, str(tmp_path / "lib")), str(tmp_path / "cache"))
    assert len(list((tmp_path / "cache").iterdir())) == 1
    (tmp_path / "lib/tale-20250101-000000/tale.quotes").write_text("quote_start\tquote_end\n0\t1\n")
    changed = store.materialise(annotated.load(spark, str(tmp_path / "lib")), str(tmp_path / "cache"))
    assert len(list((tmp_path / "cache").iterdir())) == 2 and rows(changed.quote, "start", "end") == [(0, 1)]


def test_models(spark, tmp_path):
    root = str(tmp_path / "models")
    assert store.list_models(spark, root) == []
    theta = spark.createDataFrame([("d", 0, 1.0)], "doc string, topic int, p double")
    phi = spark.createDataFrame([(0, "w", 1.0)], "topic int, word string, p double")
    store.save_model(spark, root, "m-1", theta, phi, {"k": 1})
    got = store.load_model(spark, root, "m-1")
    assert got[2] == {"k": 1} and got[0].collect() == theta.collect() and got[1].collect() == phi.collect()
    assert store.list_models(spark, root) == ["m-1"]
    store.delete_model(spark, root, "m-1")
    for bad in ("m-1", "../x"):
        with pytest.raises(store.ModelError):
            store.load_model(spark, root, bad)
