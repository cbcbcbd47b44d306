import pytest

from prefops.llm.frames import rows_of_keys


@pytest.mark.parametrize("most", [0, 100])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_rows_of_keys(spark, most, kind):
    make = (lambda k: None if k is None else str(k)) if kind == "string" else (lambda k: k)
    df = spark.createDataFrame([(make(k), f"t{k}") for k in (1, 2, 2, 0, None, -7)], f"doc_id {kind}, text string")
    keys = spark.createDataFrame([(make(k),) for k in (2, 2, 5, None, -7)], f"doc_id {kind}")
    assert sorted(r.text for r in rows_of_keys(df, "doc_id", keys, most=most).collect()) == ["t-7", "t2", "t2"]
    assert sorted(r.text for r in rows_of_keys(df, "doc_id", keys, inside=False, most=most).collect()) == sorted(["tNone", "t0", "t1"])
    none = keys.limit(0)
    assert rows_of_keys(df, "doc_id", none, most=most).count() == 0 and rows_of_keys(df, "doc_id", none, inside=False, most=most).count() == 6
