"""X1-X4."""

from pyspark.sql import functions as F

from contactrank.functions import text as X
from contactrank.sources.exports import js_number, to_text

NBSP, NEL, BOM = chr(0xA0), chr(0x85), chr(0xFEFF)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalize_key(spark):
    for given, expected in [(" E-mail Address ", "emailaddress"), ("first_name", "firstname"), ("Prénom", "prnom"), ("***", "")]:
        assert one(spark, X.normalize_key, given) == expected


def test_tokenize_query(spark):
    for given, expected in [(" ,CTO;; health care, cto ", ["cto", "health", "care", "cto"]), (",; ", []), (f"a{NBSP}b", ["a", "b"]), (f"a{NEL}b", [f"a{NEL}b"])]:
        assert one(spark, X.tokenize_query, given) == expected == X.tokens_of(given)


def test_js_trim(spark):
    assert one(spark, X.js_trim, f"{BOM}\tx{chr(0x3000)}") == "x"
    assert one(spark, X.js_trim, f"{NEL}x y\n\n") == f"{NEL}x y"


def test_to_text():
    cases = [(None, ""), ("a", "a"), (True, "true"), (1.0, "1"), ([1.0, None, "x"], "1  x"), ([[1.0, 2.0], 3.0], "1 2 3"), ({"b": [1.0, 2.0], "a": "é"}, '{"b":[1,2],"a":"é"}')]
    assert [to_text(v) for v, _ in cases] == [e for _, e in cases]


def test_js_number():
    cases = {1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-7: "1e-7", 0.000001: "0.000001", -0.0: "0", 2.5: "2.5", -1.5e-9: "-1.5e-9", 1e300: "1e+300", 9007199254740993.0: "9007199254740992"}
    assert {k: js_number(k) for k in cases} == cases


def test_column_to_text(spark):
    row = spark.range(1).select(X.array_to_text(F.array(F.lit("a"), F.lit(None), F.lit("b"))).alias("a"), X.object_to_text(F.create_map(F.lit("k"), F.lit(1))).alias("o")).first()
    assert (row.a, row.o) == ("a  b", '{"k":1}')
