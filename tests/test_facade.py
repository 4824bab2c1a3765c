import pytest

import alignspark


def test_every_name_is_there(spark, tmp_path):
    for name in alignspark._HOMES:
        assert callable(getattr(alignspark, name)) and name in dir(alignspark)
    with pytest.raises(AttributeError):
        _ = alignspark.unknown


def test_load_through_the_package(spark, tmp_path):
    store = alignspark.TableStore(spark, str(tmp_path / "s"))
    found = alignspark.load(spark, store, [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}], "t", "upsert", keys=["k"])
    assert found["rows"] == 2 and alignspark.infer_key(store.read("t")).columns == ["k"]
