import hashlib

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import clean, keys, rules, text, units


def one(spark, column, **values):
    names = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(names.values())], ", ".join(f"{k} {t}" for k, t in SCHEMA(names)))
    return df.select(column).first()[0]


def SCHEMA(values):
    kinds = {float: "double", int: "bigint", str: "string", type(None): "string"}
    return [(k, kinds[type(v)]) for k, v in values.items()]


@pytest.mark.parametrize(
    "value, unit, nm, note",
    [
        (2.0, "nM", 2.0, None),
        (2.0, "uM", 2000.0, None),
        (2.0, "µM", 2000.0, None),
        (2.0, "M", 2e9, None),
        (2.0, "mM", 2e6, None),
        (2.0, "pM", 0.002, None),
        (2.0, "fM", 2e-6, None),
        (2.0, " nM ", 2.0, None),
        (2.0, "  ", None, "missing_standard_units"),
        (2.0, None, None, "missing_standard_units"),
        (2.0, "%", None, "unconvertible_units:%"),
        (2.0, "NM", None, "unconvertible_units:NM"),
        (2.0, "μM", None, "unconvertible_units:μM"),
        (None, "nM", None, "missing_standard_value"),
        (None, None, None, "missing_standard_value"),
    ],
)
def test_units(spark, value, unit, nm, note):
    df = spark.createDataFrame([(value, unit)], "v double, u string")
    got = df.select(units.NANOMOLAR.base_value("v", "u"), units.NANOMOLAR.note("v", "u")).first()
    assert got[0] == pytest.approx(nm) if nm is not None else got[0] is None
    assert got[1] == note


def test_units_options(spark):
    df = spark.createDataFrame([(2.0, " nM "), (2.0, "μM")], "v double, u string")
    strict = units.UnitScale(trim=False)
    assert [r[0] for r in df.select(strict.base_value("v", "u")).collect()] == [None, None]
    greek = units.NANOMOLAR.with_aliases(units.GREEK_MU_FACTORS)
    assert [r[0] for r in df.select(greek.base_value("v", "u")).collect()] == [2.0, 2000.0]
    assert [r[0] for r in df.select(units.NANOMOLAR.base_unit("v", "u")).collect()] == ["nM", "μM"]


def test_numbers_from_text(spark):
    df = spark.createDataFrame(
        [("7",), (" 7 ",), ("7.0",), ("x",), ("",), (None,), ("-3",), ("NaN",), ("Infinity",), ("2.5",)], "t string"
    )
    assert [r[0] for r in df.select(clean.to_int("t")).collect()] == [
        7, None, None, None, None, None, -3, None, None, None,
    ]
    assert [r[0] for r in df.select(clean.to_double("t")).collect()] == [
        7.0, 7.0, 7.0, None, None, None, -3.0, None, None, 2.5,
    ]


def test_blank_nan_and_finite(spark):
    df = spark.createDataFrame([("  ", float("nan")), (" a ", float("inf")), (None, None), ("\t", 1.0)], "t string, d double")
    assert [r[0] for r in df.select(clean.blank_to_null("t")).collect()] == [None, "a", None, "\t"]
    assert [r[0] for r in df.select(clean.nan_to_null("d")).collect()] == [None, float("inf"), None, 1.0]
    assert [r[0] for r in df.select(clean.finite_or_null("d")).collect()] == [None, None, None, 1.0]


@pytest.mark.parametrize(
    "value", [16.0, 0.5, 12345678.9, 1e7, 98765432109.25, 0.00025, 3.0, 100000.0, 0.1, 7.51]
)
def test_number_text_is_plain(spark, value):
    df = spark.createDataFrame([(value,)], "d double")
    assert df.select(clean.number_text("d")).first()[0] == repr(value)


def test_number_text_null(spark):
    df = spark.createDataFrame([(None,)], "d double")
    assert df.select(clean.number_text("d")).first()[0] == "None"


def test_surrogate_key(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    expected = hashlib.md5(b"a-_dbt_utils_surrogate_key_null_-3").hexdigest()
    assert df.select(keys.surrogate_key("x", "y", "z")).first()[0] == expected


GOOD = {
    "standard_type": "IC50",
    "standard_value_nm": 5.0,
    "pchembl_value": 8.3,
    "confidence_score": 9,
    "data_validity_comment": None,
    "standard_relation": "=",
}
RULE_SCHEMA = (
    "standard_type string, standard_value_nm double, pchembl_value double, confidence_score int, "
    "data_validity_comment string, standard_relation string"
)


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, "included"),
        ({"standard_relation": None}, "included"),
        ({"standard_value_nm": 0.0}, "included"),
        ({"standard_value_nm": -1.0}, "included"),
        ({"confidence_score": 7}, "included"),
        ({"standard_type": "Inhibition"}, "non_curated_standard_type"),
        ({"standard_type": None}, "non_curated_standard_type"),
        ({"standard_value_nm": None}, "missing_or_unconvertible_nm_value"),
        ({"pchembl_value": None}, "missing_pchembl_value"),
        ({"confidence_score": 6}, "low_confidence_score"),
        ({"confidence_score": None}, "low_confidence_score"),
        ({"data_validity_comment": "x"}, "data_validity_comment_present"),
        ({"standard_relation": ">"}, "ambiguous_standard_relation"),
        ({"standard_value_nm": None, "pchembl_value": None}, "missing_or_unconvertible_nm_value"),
        ({"confidence_score": 1, "standard_relation": "~"}, "low_confidence_score"),
    ],
)
def test_rules_agree(spark, change, reason):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row.values())], RULE_SCHEMA)
    contract = rules.potency_rules()
    assert df.select(contract.reason()).first()[0] == reason
    assert df.filter(contract.predicate()).count() == (1 if reason == "included" else 0)


def test_unknown_type_can_pass(spark):
    df = spark.createDataFrame([tuple({**GOOD, "standard_type": None}.values())], RULE_SCHEMA)
    lenient = rules.potency_rules().reason(unknown_passes=[rules.TYPE_REASON])
    assert df.select(lenient).first()[0] == "included"


def test_rule_parameters(spark):
    df = spark.createDataFrame([tuple({**GOOD, "confidence_score": 5}.values())], RULE_SCHEMA)
    assert df.filter(rules.potency_rules(["IC50"], 5).predicate()).count() == 1
    assert df.filter(rules.potency_rules(["Ki"], 5).predicate()).count() == 0


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Don't stop at 1.5 mg, EGFR_2!", ["don't", "stop", "at", "1.5", "mg", "egfr_2"]),
        ("Ciónmé ÉTÉ straße œuvre", ["cionme", "ete", "strasse", "oeuvre"]),
        ("end. Next\nline", ["end", "next", "line"]),
        ("", []),
    ],
)
def test_tokens(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.tokens("t")).first()[0] == expected


def test_fold_table_is_one_to_one():
    assert len(text.FOLD_FROM) == len(text.FOLD_TO) == len(set(text.FOLD_FROM))
    assert dict(zip(text.FOLD_FROM, text.FOLD_TO))["é"] == "e"


def test_matches_any(spark):
    df = spark.createDataFrame([("Kinase inhibitor",), ("binding",), (None,)], "t string")
    got = [r[0] for r in df.select(text.matches_any(F.col("t"), "INHIBITOR cell")).collect()]
    assert got == [True, False, False]
