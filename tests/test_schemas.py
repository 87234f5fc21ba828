from pyspark.sql import functions as F

from geoloom.functions import schemas as sc

SCHEMA = {
    "n": sc.integer("a number"),
    "m": sc.nullable_integer("maybe a number"),
    "ok": sc.boolean("yes or no").optional(),
    "size": sc.quantity("m", "a length"),
    "kind": sc.enum(["b", "a"], "a kind"),
    "code": sc.mapped({"one": 1, "two": 2}, "a code"),
    "half": sc.custom(lambda s: s.try_cast("double") / 2, lambda v: (v * 2).cast("string"), "half of a number"),
}


def test_rows_are_parsed_with_all_their_errors(spark):
    names = "id int, n string, m string, ok string, size string, kind string, code string, half string"
    rows = [
        (1, "7", ".", None, "2.5 km", "a", "two", "3"),
        (2, " 8 ", "4", "YES", "3", "b", "one", "1e3"),
        (3, "x", "y", "perhaps", "3 kg", "c", "three", "z"),
        (4, None, None, "no", None, None, None, None),
    ]
    checked = sc.parsed(spark.createDataFrame(rows, names), SCHEMA)
    good, bad = sc.split_errors(checked, "id")
    assert sorted(map(tuple, good.collect())) == [(1, 7, None, None, 2500.0, "a", 2, 1.5), (2, 8, 4, True, 3.0, "b", 1, 500.0)]
    found = {(r.id, r.field): (r.text, r.error) for r in bad.collect()}
    assert {k for k in found if k[0] == 3} == {(3, f) for f in SCHEMA}
    assert found[3, "kind"] == ("c", "no enum, legal are ['a', 'b']") and found[3, "size"] == ("3 kg", "no quantity")
    assert {k for k in found if k[0] == 4} == {(4, f) for f in ("n", "size", "kind", "code", "half")}
    assert set(v for k, v in found.items() if k[0] == 4) == {(None, "missing")}


def test_the_way_back_and_what_is_known_of_a_column(spark):
    texts = spark.createDataFrame([("7", ".", "true", "2.5", "a", "two", "3.0")], list(SCHEMA))
    values = sc.parsed(texts, SCHEMA).drop("errors")
    assert tuple(sc.formatted(values, SCHEMA).first()) == ("7", ".", "true", "2.5", "a", "two", "3.0")
    about = dict(sc.described(values))
    assert list(about) == list(SCHEMA) and about["size"]["units"] == "m" and about["kind"]["description"] == "a kind.  Legal values are: ['a', 'b']"
    assert about["ok"]["required"] is False and sc.field_of(SCHEMA, "code").legal == ("one", "two")
    moved = sc.in_units(values, "size", "cm")
    assert moved.first()["size"] == 250.0 and dict(sc.described(moved))["size"]["units"] == "cm"


def test_columns_that_are_not_there(spark):
    df = spark.createDataFrame([(1, "5")], "id int, n string")
    checked = sc.parsed(df, {"n": SCHEMA["n"], "ok": SCHEMA["ok"], "kind": SCHEMA["kind"]}, errors="wrong")
    row = checked.first()
    assert row.n == 5 and row.ok is None and [(e.field, e.error) for e in row.wrong] == [("kind", "missing")]
    assert checked.where("false").select(F.explode("wrong")).count() == 0
