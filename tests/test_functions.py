"""Column helpers against values worked out by hand."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import formulas, numbers, text, web


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("x"))).collect()]


def test_rounding_goes_up_on_ties(spark):
    assert column(spark, [0.5, 1.5, 2.4, -0.5, -1.5, None], "double", numbers.half_up) == [1, 2, 2, 0, -1, None]
    assert column(spark, [1.005, 2.675, -1.005, 10.125], "double", numbers.money) == [1.0, 2.68, -1.0, 10.13]


def test_money_sums_are_exact(spark):
    rows = spark.createDataFrame([(0.1,)] * 1000, "x double")
    assert rows.agg(numbers.sum_money(F.col("x"))).first()[0] == 100.0


def test_indian_digits(spark):
    shown = column(spark, [6251940.0, 999.0, 1000.5, -123456.789, 0.0, 1e7], "double", numbers.indian_digits)
    assert shown == ["62,51,940", "999", "1,000.5", "-1,23,456.789", "0", "1,00,00,000"]
    rounded = column(spark, [1000.5, 1234.4], "double", lambda c: numbers.indian_digits(c, rounded=True))
    assert rounded == ["1,001", "1,234"]


def test_leading_number(spark):
    raw = ["12.5abc", "abc", "-3", ".5x", "1e3z", "  7 ", "1.", "", None]
    assert column(spark, raw, "string", numbers.leading_number) == [12.5, None, -3.0, 0.5, 1000.0, 7.0, 1.0, None, None]


def test_deviation(spark):
    rows = spark.createDataFrame([(101.0, 100.0), (5.0, 0.0), (90.0, 100.0)], "a double, b double")
    got = [r[0] for r in rows.select(numbers.deviation_pct(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 100.0, 10.0])


def test_categories(spark):
    kinds = ["Interior door", "Sliding DOOR", "windowsill", "Armchair", "Data point", "label", "exterior wall", "roof", None]
    assert column(spark, kinds, "string", text.object_category) == [
        "partition", "door", "window", "furniture", "electrical", "text", "wall", "other", "other",
    ]


def test_material_families(spark):
    kinds = ["Floor tile", "Glass wall", "Paint", "Carpet tile", "Carpet", "LIGHT", "Blinds", ""]
    assert column(spark, kinds, "string", text.material_family) == [
        "tile", "glass", "wall", "tile", "carpet", "light", "other", "other",
    ]


def test_names(spark):
    assert column(spark, [7, 42, 12345, None], "long", text.pad_id) == ["007", "042", "12345", "000"]
    assert column(spark, ["a.b.pdf", "plan", ".hidden"], "string", text.file_stem) == ["a.b", "plan", ""]
    assert column(spark, ["x.PDF", "x.png"], "string", lambda c: text.is_pdf(c, F.lit(None))) == [True, False]
    assert column(spark, [None, "", "image/png", "x" * 60], "string", text.content_type_or_default) == [
        "application/pdf", "application/pdf", "image/png", "x" * 50,
    ]
    assert column(spark, ["draft", "in_progress", "odd"], "string", text.status_label) == ["Draft", "In progress", "odd"]
    at = [datetime(2026, 7, 2, 9, 5)]
    assert column(spark, at, "timestamp", text.display_date) == ["02 Jul 2026"]
    assert column(spark, at, "timestamp", text.display_datetime) == ["02 Jul, 09:05"]


def test_room_areas(spark):
    labels = ["10'-0\" x 12'-0\"", "8'-6\" X 10'-0\"", "28'-0\"", "Room 1 - Office", None]
    assert column(spark, labels, "string", text.room_area_sqft) == [120.0, 85.0, None, None, None]


def test_paths(spark):
    given_paths = ["1/17-a plan (v1)+x.pdf", "a//b", "ü/~'!*"]
    assert column(spark, given_paths, "string", web.encode_path) == [
        "1/17-a%20plan%20(v1)%2Bx.pdf", "a//b", "%C3%BC/~'!*",
    ]
    urls = ["/d?project_id=7", "/d?project_id=-2", "/d?project_id=x", "/d", "/d?project_id=2.5"]
    full = [f"http://h{u}" for u in urls]
    assert column(spark, full, "string", lambda c: web.positive_parameter(c, "project_id")) == [7.0, 1.0, 1.0, 1.0, 2.5]
    assert column(spark, ["/projects/12", "/projects/12/x", "/projects/"], "string", lambda c: web.path_id(c, "/projects")) == [
        12, None, None,
    ]


VARIABLES = {"a": 7.5, "b": 0.0, "area": 346.0}


def value(spark, formula):
    row = spark.createDataFrame([tuple(VARIABLES.values())], "a double, b double, area double")
    return row.select(formulas.compile_formula(formula, {v: F.col(v) for v in VARIABLES})).first()[0]


@pytest.mark.parametrize(
    ("formula", "expected"),
    [
        (" 12.5 ", 12.5),
        ("1e2", 100.0),
        ("ceil(area / 100) * 2", 8.0),
        ("a / b", 0.0),
        ("sqrt(b - 1) + 5", 0.0),
        ("5 + ceil(sqrt(0 - 1))", 0.0),
        ("round(2.5) + round(3.5)", 6.0),
        ("round(area / 7, 1)", 49.4),
        ("abs(-a) + floor(a)", 14.5),
        ("nothing + 1", 0.0),
        ("a +", 0.0),
        ("", 0.0),
        ("__import__('os').getpid()", 0.0),
        ("a.real", 0.0),
        ("open('x')", 0.0),
        ("-a % 4", 0.5),
        ("a ** 2 // 10", 5.0),
    ],
)
def test_formulas(spark, formula, expected):
    assert value(spark, formula) == pytest.approx(expected)


_LEAVES = st.one_of(st.integers(0, 20).map(str), st.sampled_from(sorted(VARIABLES)))
_FORMULAS = st.recursive(
    _LEAVES,
    lambda inner: st.one_of(
        st.tuples(inner, st.sampled_from("+-*/"), inner).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
        st.tuples(st.sampled_from(["ceil", "floor", "sqrt", "abs", "round"]), inner).map(lambda t: f"{t[0]}({t[1]})"),
    ),
    max_leaves=6,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(_FORMULAS, min_size=20, max_size=20))
def test_formulas_agree_with_python(spark, texts):
    scope = {"ceil": math.ceil, "floor": math.floor, "sqrt": math.sqrt, "abs": abs, "round": round, **VARIABLES}

    def plain(formula):
        try:
            return float(eval(formula, {"__builtins__": {}}, scope))  # noqa: S307 - generated arithmetic only
        except Exception:
            return 0.0

    row = spark.createDataFrame([tuple(VARIABLES.values())], "a double, b double, area double")
    columns = {v: F.col(v) for v in VARIABLES}
    got = row.select(*[formulas.compile_formula(t, columns).alias(f"c{i}") for i, t in enumerate(texts)]).first()
    for formula, result in zip(texts, got):
        assert result == pytest.approx(plain(formula), rel=1e-9, abs=1e-9), formula


def test_chained_formulas(spark):
    rows = spark.createDataFrame([(10.0,)], "cabins double")
    chained = formulas.with_chained(
        rows,
        {"wool": "full * 1", "full": "perimeter * 8", "perimeter": "cabins * 4", "x": "y", "y": "x", "z": "y + 1"},
        ["cabins"],
    ).first()
    assert (chained["perimeter"], chained["full"], chained["wool"]) == (40.0, 320.0, 320.0)
    assert chained["formula_errors"] == ["x", "y", "z"] and chained["x"] == 0.0


def test_too_many_formulas_are_refused(spark):
    table = spark.range(20).selectExpr("concat('a + ', id) AS f")
    assert len(formulas.distinct_formulas(table, "f", limit=20)) == 20
    with pytest.raises(ValueError, match="more than 19"):
        formulas.distinct_formulas(table, "f", limit=19)
