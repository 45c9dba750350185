import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from datakiln.functions import casts, valuetypes
from datakiln.operators import headers, infer, transforms

TEXTS = ["1", " 2 ", "3.7", "-2.5", "1e3", "1.0d", "0x10", "1_000", "1,234", "", "  ", None, "nan", "-inf", "abc", ".5", "3.", "+7", "99999999999999999999"]


def applied(spark, f, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_int_takes_whole_text_only(spark):
    assert applied(spark, casts.to_int) == [1, 2, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, 7, None]


def test_float_takes_number_text_only(spark):
    got = applied(spark, casts.to_float)
    assert got[:12] == [1.0, 2.0, 3.7, -2.5, 1000.0, None, None, None, None, None, None, None]
    assert got[12] != got[12] and got[13] == float("-inf") and got[14:17] == [None, 0.5, 3.0]


def test_text_drops_only_the_empty_one(spark):
    assert applied(spark, casts.to_text, ["", " ", None, "a"]) == [None, " ", None, "a"]


def test_rounding_cutting_and_commas(spark):
    assert applied(spark, casts.parse_int, ["2.5", "3.7", "-2.5", "", "x"]) == [3, 4, -3, None, None]
    assert applied(spark, casts.int_cut, ["2.9", "-2.9", "x"]) == [2, -2, None]
    assert applied(spark, casts.clean_int, ["1,234", "1,2,3", "x"]) == [1234, 123, None]
    assert applied(spark, lambda c: casts.int_or(c, -1), ["5", "*"]) == [5, -1]
    with pytest.raises(Exception, match="not an integer"):
        applied(spark, lambda c: casts.clean_int(c, strict=True), ["x"])


def test_failed_value_is_the_raw_text(spark):
    assert applied(spark, lambda c: casts.failed_value(c, casts.to_int(c)), ["1", "*", " ", None, " b "]) == [None, "*", None, None, " b "]


def test_dates_in_many_forms(spark):
    day = dt.date(1970, 1, 2)
    forms = ["1970-01-02", "1970/01/02", "01/02/1970", "1/2/1970", "19700102", "01/02/70", "2 Jan 1970", "Jan 2, 1970", "January 2, 1970", " 1970-01-02 ", "1970-01-02 10:20:00"]
    assert applied(spark, casts.to_date, forms) == [day] * len(forms)
    assert applied(spark, casts.to_date, ["1970-13-02", "13/13/70", "", None, "tomorrow"]) == [None] * 5
    assert applied(spark, casts.to_date, ["01/02/69"]) == [dt.date(2069, 1, 2)]


def test_timestamps_and_times(spark):
    assert applied(spark, casts.to_timestamp, ["1970-01-01T01:01:01", "19700101T010101", "1970-01-01"]) == [dt.datetime(1970, 1, 1, 1, 1, 1), dt.datetime(1970, 1, 1, 1, 1, 1), dt.datetime(1970, 1, 1)]
    assert applied(spark, casts.to_time, ["10:20:00 AM", "1:05 pm", "12:34", "25:00", "x"]) == ["10:20:00", "13:05:00", "12:34:00", None, None]


def test_spreadsheet_days(spark):
    assert applied(spark, casts.excel_date, ["1", "59", "60", "61", "43831.5"]) == [dt.datetime(1900, 1, 1), dt.datetime(1900, 2, 28), dt.datetime(1900, 2, 28), dt.datetime(1900, 3, 1), dt.datetime(2020, 1, 1, 12)]
    assert applied(spark, lambda c: casts.excel_date(c, 1904), ["0", "1"]) == [dt.datetime(1904, 1, 1), dt.datetime(1904, 1, 2)]


@given(st.lists(st.tuples(st.lists(st.sampled_from(["trim", "scale", "row.other.year"]), max_size=3), st.booleans(), st.randoms()), min_size=1, max_size=4), st.booleans())
def test_normal_form_orders_the_parts_of_each_stage(stages, started):
    """Handlers and the initialiser may stand anywhere in their stage; the order of the pipes is kept."""
    written, wanted = [], []
    for place, (pipes, handled, chance) in enumerate(stages):
        first = ["^begin"] if started and place == 0 else []
        last = ["!rescue"] if handled else []
        mixed = list(pipes)
        for part in first + last:
            mixed.insert(chance.randint(0, len(mixed)), part)
        written.append(" | ".join(mixed))
        wanted.append("|".join(first + pipes + last))
    assert transforms.normal_form(";".join(written)) == ";".join(wanted)
    assert transforms.normal_form(";".join(wanted)) == ";".join(wanted)


@pytest.mark.parametrize("wrong", ["scale;^begin", "^begin|scale|^other", "scale;trim|!rescue|!again"])
def test_a_second_or_late_part_is_an_error(wrong):
    with pytest.raises(ValueError):
        transforms.parsed(wrong)


def spec(rows):
    return headers.TableSpec("t", {n: headers.ColumnSpec(i, n, k, transform=t) for i, (n, k, t) in enumerate(rows, 1)})


def test_stages_see_the_stage_before(spark):
    """Prices of a shop: stage 2 reads what stage 1 made of the other columns, stage 3 what stage 2 made."""
    df = spark.createDataFrame([("k1", "12", "0.5", "2020-03-04"), ("k2", "n/a", "2", None), ("k3", "7", "lots", "2021-12-31")], "ref string, price string, rate string, sold string")
    table = spec([
        ("line", "int", "^row_number"), ("ref", "str", "upper"), ("price", "int", "!ignore;double"), ("rate", "float", "capped;;clear_error"), ("rate_text", "str", ";row.rate.failed_value"),
        ("due", "float", ";;times"), ("sold", "date", ""), ("quarter", "int", ";row.sold.month|quarter"), ("returned", "date", ""),
    ])
    functions = {"double": lambda v: v * 2, "capped": lambda v: F.least(v, F.lit(1.0)), "times": lambda v, row: row["price"] * row["rate"], "quarter": lambda v: F.ceil(v / 3)}
    got = transforms.cast_columns(df, table, functions, order=["ref"]).orderBy("line").collect()
    first, last = dt.date(2020, 3, 4), dt.date(2021, 12, 31)
    assert [tuple(r)[:-1] for r in got] == [
        (1, "K1", 24, 0.5, None, 12.0, first, 1, None),
        (2, "K2", None, 1.0, None, None, None, None, None),
        (3, "K3", 14, None, "lots", None, last, 4, None),
    ]
    assert all(r["_errors"] == [] for r in got)


def test_value_types_and_expressions(spark):
    df = spark.createDataFrame([("a v", "0.25", "12.5%", "8", "06075010100", "1,000", "6"), ("b", "3", "x", None, "bad", "7", "99")], "name string, part string, pct string, moe string, place string, n string, state string")
    table = headers.TableSpec("t", {n: headers.ColumnSpec(i, n, k, v, transform=t) for i, (n, k, v, t) in enumerate([
        ("name", "str", "", "{upper(v)}|{replace(v, 'V', 'v w')}"), ("part", "float", "proportion", ";;clear_error"), ("part_code", "str", "", ";row.part.failed_value"), ("part_percent", "float", "", ";row.part.percent"),
        ("pct", "float", "pct", ""), ("pct_rate", "float", "", ";row.pct.rate"), ("moe", "float", "margin/95", ""), ("moe_se", "float", "", ";row.moe.se"), ("place", "str", "geoid/census", ""), ("county", "int", "", ";row.place.county"),
        ("n", "int", "", "^{replace(v, ',', '')}|{v + 1}"), ("total", "float", "", ";{row.n * row.part}"), ("state", "int", "fips/state", ""), ("state_name", "str", "", ";row.state.name"), ("tag", "str", "", "^tagged"),
    ], 1)})
    states = spark.createDataFrame([(6, "California", "CA")], "state int, name string, short string")

    def tagged(v, source, bundle, scratch):
        scratch["seen"] = scratch.get("seen", 0) + 1
        return F.lit(f"{source}-{bundle}-{scratch['seen']}")

    cast = transforms.cast_columns(df, table, {"tagged": tagged}, source="s", bundle="b", linked={"fips/state": states})
    one, two = (r.asDict() for r in cast.orderBy("name").collect())
    assert (one["name"], one["part"], one["part_percent"], one["pct"], one["pct_rate"]) == ("A v w", 0.25, 25.0, 12.5, 0.125)
    assert round(one["moe_se"] * 1.96, 9) == 8.0 and (one["county"], one["n"], one["total"], one["state_name"], one["tag"]) == (75, 1001, 250.25, "California", "s-b-1")
    assert (two["part"], two["part_code"], two["pct"], two["county"], two["state_name"], two["n"]) == (None, "3", None, None, None, 8)
    assert [tuple(e) for e in two["_errors"]] == [("pct", "x")]
    with pytest.raises(KeyError):
        transforms.cast_columns(df, spec([("name", "str", ""), ("x", "str", ";row.name.nosuch")])).count()


def test_errors_are_reported_unless_cleared(spark):
    df = spark.createDataFrame([("1",), ("*",), ("*",), ("b",), (None,), (" ",)], "n string")
    cast = transforms.cast_columns(df, spec([("n", "int", "")]))
    assert sorted(tuple(r) for r in transforms.error_report(cast).collect()) == [("n", "*", 2), ("n", "b", 1)]
    with pytest.raises(ValueError, match=r"n \(2\)"):
        transforms.checked(cast)
    assert transforms.checked(cast, 2).count() == 6
    with pytest.raises(KeyError):
        transforms.cast_columns(df, spec([("n", "int", "nosuch")]))
    with pytest.raises(TypeError):
        transforms.cast_columns(df, spec([("n", "int", "odd")]), {"odd": lambda v, what: v})


def test_typed_sources_are_not_read_as_text(spark):
    df = spark.createDataFrame([(3.7, 2, "x"), (-3.7, None, "y")], "a double, b int, c string")
    got = transforms.cast_columns(df, spec([("a", "int", ""), ("b", "float", ""), ("c", "str", "")])).collect()
    assert [tuple(r) for r in got] == [(3, 2.0, "x", []), (-3, None, "y", [])]


def test_a_failed_value_stays_failed_through_pipes(spark):
    df = spark.createDataFrame([("*",), ("3",), (None,)], "n string")
    got = transforms.cast_columns(df, spec([("n", "int", "zero;zero")]), {"zero": lambda v: F.coalesce(v, F.lit(0))}).collect()
    assert sorted(str(r.n) for r in got) == ["0", "3", "None"]


def test_inference_follows_the_rules(spark):
    rows = [(str(i), f"{i}.5" if i % 2 else str(i), "*" if i == 7 else str(i), "a" if i % 3 else "1", "01/02/70", "10:20", None, "2001-02-03 04:05:06") for i in range(40)]
    got = {c.name: (c.datatype, c.has_codes) for c in infer.inferred(spark.createDataFrame(rows, "i string, f string, coded string, mixed string, d string, t string, none string, s string"))}
    assert got == {"i": ("int", False), "f": ("float", False), "coded": ("int", True), "mixed": ("str", False), "d": ("date", False), "t": ("time", False), "none": ("unknown", False), "s": ("datetime", False)}


def test_value_types_resolve_by_longest_head(spark):
    assert valuetypes.resolved("margin/90").parameters == ("90",)
    assert valuetypes.resolved("ci/u/95").code == "ci/u/95" and valuetypes.resolved("geoid/census/tract").parameters == ()
    assert valuetypes.resolved("year/range?").role == "d"
    assert applied(spark, valuetypes.resolved("pct").cast, ["5%", "x"]) == [5.0, None]
    with pytest.raises(KeyError):
        valuetypes.resolved("nonsense/x")
