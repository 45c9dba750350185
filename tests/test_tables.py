import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.functions import nested, values
from datakiln.jobs import build, search
from datakiln.jobs.sqlscript import Warehouse, statements, substituted
from datakiln.operators import coverage, cubes, headers, row_index, rows, stats
from datakiln.sources import readers, runs
from datakiln.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_mangled_names():
    assert [headers.mangle(n, i) for i, n in enumerate(["Foo Bar", "  a--b__", "", None, "x%"])] == ["foo_bar", "a_b", "column2", "column3", "x"]
    assert headers.unique_names(["id", "a", "id", "a"]) == ["id", "a", "id_3", "a_4"]
    assert headers.ascii_name("naïve") == "nave"


def test_types_are_promoted():
    pairs = {("unknown", "int"): "int", ("int", "unknown"): "int", ("int", "float"): "float", ("float", "str"): "str", ("date", "time"): "str", ("date", "date"): "date"}
    assert {p: headers.promoted(*p) for p in pairs} == pairs


def test_merged_schema_adds_names_once_and_codes():
    c = headers.ColumnSpec
    table = headers.merged("t", [[c(1, "a", "int"), c(2, "b", "int", has_codes=True)], [c(1, "a", "float"), c(2, "z", "date"), c(3, "b", "unknown")]])
    assert {f.name: f.dataType.simpleString() for f in table.schema()} == {"id": "bigint", "a": "double", "b": "bigint", "b_code": "string", "z": "date"}
    assert table.columns["a"].datatype == "float" and table.columns["b"].datatype == "int"


def test_renames_and_layouts(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert headers.renamed_by_position(df, ["p", "q"]).columns == ["p", "q"]
    with pytest.raises(ValueError):
        headers.renamed_by_position(df, ["p"])
    layout = T.StructType([T.StructField("b", T.StringType()), T.StructField("new", T.LongType())])
    assert headers.laid_out(df, layout).first() == ("x", None) and headers.only_laid_out(df, layout).columns == ["b"]
    assert headers.without_blank_names(spark.createDataFrame([(1, 2, 3)], ["a", " ", ""])).columns == ["a"]
    mapped = {r.name: (r.s, r.t) for r in headers.column_map({"s": ["a", "b"], "t": ["b"]}, spark).collect()}
    assert mapped == {"a": (1, 0), "b": (1, 1)}


def test_declared_schema_round_trip(spark, tmp_path):
    (tmp_path / "schema.csv").write_text("table,column,datatype,valuetype,role,parent,description,transform\nt,id,int,,k,,,\nt,v,,measure,m,,a value,;dbl\nt,v_se,float,se,e,v,,\n")
    specs = headers.declared_schema(spark, str(tmp_path / "schema.csv"))
    schema = specs["t"].schema()
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "double", "double"] and specs["t"].columns["v"].transform == ";dbl"
    assert headers.by_role(schema, "m") == ["v"] and headers.children(schema, "v") == ["v_se"] and headers.children(schema, "v", "ci") == []
    out = headers.schema_rows(spark, list(specs.values()))
    assert out.columns == ["table", "position", "column", "datatype", "valuetype", "role", "parent", "description", "transform"] and out.count() == 3


def test_sample_positions():
    places = rows.sample_positions()
    assert places[:5] == [0, 7, 11, 16, 24] and {2018, 9999} <= set(places) and len(places) == 20


def test_slices():
    assert rows.slice_positions("0:3,10:13,9,-1", 15) == [0, 1, 2, 10, 11, 12, 9, 14]
    with pytest.raises(IndexError):
        rows.slice_positions("3", 3)


def test_edits_see_input_values(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows.edit(df, {"a": lambda c: c + F.col("b"), "b": lambda c: c + F.col("a")}).first() == (3, 3)
    with pytest.raises(KeyError):
        rows.edit(df, {"z": lambda c: c})
    assert rows.expand(df, ("s", "d"), F.array(F.col("a") + F.col("b"), F.col("a") - F.col("b"))).first() == (1, 2, 3, -1)
    assert rows.add_columns(df, ["n"]).first() == (1, 2, None) and rows.keep_columns(df, ["b", "a"]).columns == ["a", "b"]


def test_skip_keeps_nulls_and_counts(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "a int")
    kept, seen = rows.skip_counted(df, F.col("a") == 5)
    assert kept.count() == 2 and seen.get == {"skipped": 1, "passed": 2}
    assert df.filter(rows.not_equal(F.col("a"), F.lit(5))).count() == 2 and rows.select_rows(df, F.col("a") != 5).count() == 1
    everything, some = rows.split_matching(df, F.col("a") > 1)
    assert everything.count() == 3 and some.count() == 1


def test_steps_are_edited_by_name(spark):
    df = spark.range(3).toDF("a")
    steps = {"one": lambda d: d.withColumn("x", F.lit(1)), "two": lambda d: d.withColumn("y", F.lit(2))}
    made = rows.edited_steps(steps, {"+three": lambda d: d.limit(1), "!one": None, "-zero": lambda d: d.withColumn("z", F.lit(0))})
    assert list(made) == ["zero", "two", "three"] and rows.run_steps(df, made).columns == ["a", "z", "y"]
    with pytest.raises(KeyError):
        rows.edited_steps(steps, {"!none": None})
    changes = {"body": {"!two": None}, "body-src": {"+last": steps["one"]}, "body-tab": {"!one": None}}
    phases = {"body": steps, "final": {"one": steps["one"]}}
    assert [list(rows.configured(phases, changes, *names)["body"]) for names in (("t0", "tab", "src"), ("", "", "src"), ())] == [["two"], ["one", "two", "last"], ["one"]]
    assert list(rows.configured(phases, changes)["final"]) == ["one"]


def test_user_code_on_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("b", T.StringType())])
    got = rows.modify(df, lambda r: {"c": r["a"] * 10, "b": r["b"]} if r["b"] else None, schema)
    assert [tuple(r) for r in got.collect()] == [(10, "x")]
    counted, seen = rows.observed(df)
    assert counted.count() == 2 and seen.get == {"rows": 2}
    assert headers.schema_of_run(df, [lambda d: d.withColumn("z", F.lit(1.0))]).fieldNames() == ["a", "b", "z"]
    assert headers.mapped_columns(df, "s", [("s", "a", "n"), ("t", "b", "m")]).columns == ["n", "b"]


def test_row_numbers_have_no_gaps(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.lit(9).alias("id")).repartition(7)
    got = row_index.with_row_number(df, ["k"]).orderBy("k").collect()
    assert [r.id for r in got] == list(range(1, 5001))
    assert row_index.with_row_number(df.filter("k < 0"), ["k"]).count() == 0


def test_running_totals_cross_ranges(spark):
    """A hot key, null keys and null values, with columns that clash with the helper's own."""
    made = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 11}", i * 7919 % 1009, None if i % 13 == 0 else i % 10, i) for i in range(1009)]
    df = spark.createDataFrame(made, "k string, at int, v int, _range int").repartition(5)
    got = {(r.k, r["at"]): (r.running, r["_range"]) for r in row_index.running_total(df, ["k"], ["at"], "v").collect()}
    want, sums = {}, {}
    for k, at, v, i in sorted(made, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + (v or 0)
        want[k, at] = sums[k], i
    assert got == want
    whole = row_index.prefix_sums(df, [], ["at"], {"n": F.lit(1), "total": F.col("at").cast("long")}).collect()
    assert all(r.n == r["at"] + 1 and r.total == r["at"] * (r["at"] + 1) // 2 for r in whole) and len(whole) == 1009
    assert row_index.running_total(df.filter("at < 0"), ["k"], ["at"], "v").count() == 0


def test_a_large_partition_is_dealt_over_tasks_by_the_bytes_of_its_rows(spark, tmp_path):
    """Rows that shrink to nothing when they are shuffled are many in memory all the same."""
    df = spark.range(20_000).select("id", F.lit("the same text").alias("a.b"), F.when(F.col("id") % 100 == 0, F.array(F.lit(1))).alias("list"))
    parts = build.with_partition(df, "tab", segment=F.when(F.col("id") < 19_000, "-large").otherwise(F.lit("s")))
    path = tmp_path / "parts"
    build.write_partitions(parts, str(path), task_bytes=100_000)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in path.glob("*/*/*/*/p_segment=*")}
    assert len(files) == 2 and max(files.values()) > 10
    read = build.read_partitions(spark, str(path)).select(*[f"`{c}`" for c in parts.columns])
    assert read.exceptAll(parts).isEmpty() and parts.exceptAll(read).isEmpty()


def test_partitions_are_written_read_and_numbered(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("t"), F.when(F.col("id") % 2 == 0, "s-10").otherwise("s-2").alias("seg"))
    parts = build.with_partition(df, "tab", time=F.col("t"), segment=F.col("seg"))
    assert parts.select("partition").distinct().count() == 6 and parts.first().partition.startswith("tab-")
    path = str(tmp_path / "parts")
    build.write_partitions(parts, path, rows_a_file=20)
    assert build.read_partitions(spark, path).count() == 200 and build.read_partitions(spark, path, time="1", segment=build.ANY).count() == 67
    build.write_partitions(parts.filter("t = 1").limit(5), path)  # only the partitions at hand are overwritten
    assert build.read_partitions(spark, path, time="0").count() == 67 and build.read_partitions(spark, path, time="1").count() <= 67
    numbered = build.numbered_in_partitions(parts, ["t"], ["p_segment", "id"], "n")
    bounds = numbered.groupBy("t").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count_distinct("n").alias("c")).collect()
    assert all(r.a == 1 and r.b == r.c for r in bounds)
    first = numbered.filter("t = 0 and n = 1").first()
    assert first.p_segment == "s-10"  # byte order
    zeros = build.with_partition(df, "tab", segment=F.lpad(F.col("t").cast("string"), 3, "0"))
    build.write_partitions(zeros, str(tmp_path / "zeros"))
    assert build.read_partitions(spark, str(tmp_path / "zeros"), segment="001").count() == 67 and build.read_partitions(spark, str(tmp_path / "zeros"), segment="1").count() == 0
    joined = build.coalesce_segments(parts, ["id"], "n").orderBy("n").collect()
    assert [r.n for r in joined] == list(range(1, 201)) and {r.p_segment for r in joined} == {""}
    build.extract(parts.select("id", "t"), str(tmp_path / "csv"), 10, ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    assert build.failed_checks(parts, rows=200, sums={"id": 19900}, columns=parts.columns).count() == 0


def test_grouping_sets_equal_separate_groups(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", None), (None, "y", 7.0)], "p string, q string, v double")
    got = {(r["set"], r.p, r.q): (r.v, r["count"]) for r in cubes.all_sets(df, "v", [("p",), ("q",), ("p", "q")]).collect()}
    want = {}
    for s in (("p",), ("q",), ("p", "q")):
        for r in cubes.measure_by(df, "v", list(s)).collect():
            d = r.asDict()
            want[",".join(s), d.get("p"), d.get("q")] = (d["v"], d["count"])
    assert got == want


def test_dimension_rules():
    sets = cubes.dimension_sets({"year": 4, "county": 9, "sex": 2}, geo={"county"}, time={"year"})
    assert {s["key"]: s["chart"] for s in sets} == {"county": "map", "sex": "bar", "year": "line", "county/sex": "map", "county/year": "map", "year/sex": "line"}
    with pytest.raises(ValueError):
        cubes.check_axes(["a", "b"], {}, ["a"])
    assert cubes.chosen_filters({"a": ["z", "b"], "c": 1}) == {"a": "b", "c": 1}


def test_statistics_and_histograms_of_odd_columns(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (None, float("inf"), None), (3, 2.0, "b")], "i int, f double, s string")
    got = {r.column: r for r in stats.column_stats(df, exact=True).collect()}
    assert got["i"].mean == 2.0 and got["i"]["count"] == 2 and got["f"].mean == 2.0 and got["f"].max == 2.0 and got["s"].mean is None and got["s"].nuniques == 2
    held = {r.column: r.hist for r in stats.histograms(df, ["i", "f"], bins=4).collect()}
    assert held["i"] == [1, 0, 0, 1] and sum(held["f"]) == 1
    assert one(spark, stats.text_histogram(F.array(F.lit(0), F.lit(4), F.lit(8)))) == " ▄█"
    assert stats.uvalues(df, ["s", "i"], most=1).count() == 0


@pytest.mark.parametrize(
    ("text", "interval", "years"),
    [("2000-2001", "2000-01-01/2001-01-01", [2000, 2001]), (" 2000 ", "2000-01-01/2001-01-01", [2000]), ("1981-04-05/P1M", "1981-04-05/1981-05-05", [1981]), ("P1Y/2005", "2004-01-01/2005-01-01", [2004]), ("1978-02-01/1980-03-01", "1978-02-01/1980-03-01", [1978, 1979, 1980]), ("1978-01-01EP2Y", "1978-01-01/1980-01-01", [1978, 1979]), ("foobar", None, None), ("", None, None)],
)
def test_intervals(spark, text, interval, years):
    assert one(spark, values.interval_text(F.lit(text))) == interval
    assert one(spark, values.expand_to_years(F.lit(text))) == years


def test_years_geo_and_ages(spark):
    assert one(spark, values.range_text(F.lit("2000--2001"))) == "2000/2001" and one(spark, values.range_text(F.lit("2000"))) == "2000/2001" and one(spark, values.range_text(F.lit("x2000"))) is None
    assert one(spark, values.geo_parts(F.lit("06001402600"))["tract"]) == 402600 and one(spark, values.tract_dotted(F.lit(402600))) == "4026.00"
    assert one(spark, values.gvid(F.lit(6), F.lit(1))) == "0O0601" and one(spark, values.base62(F.lit(150), 2)) == "2q"
    assert one(spark, values.summary_grain(F.lit("2q060100010"))) == "2qZZZZZZZZZ" and one(spark, values.county_of_gvid(values.gvid(F.lit(6), F.lit(1), F.lit(5), F.lit(2)))) == "0O0601"
    assert one(spark, values.age_text(values.census_age(F.lit("Under 5 years")))) == "00-05" and one(spark, values.age_text(values.census_age(F.lit("15 and 16 years")))) == "15-17"
    assert one(spark, values.title(F.lit("it's a DAY"))) == "It'S A Day"
    assert round(one(spark, values.margin_to_se(F.lit(25.75), 99)), 9) == 10.0
    with pytest.raises(ValueError):
        values.margin_to_se(F.lit(1.0), 80)
    assert one(spark, values.source_keywords(F.lit("foo.bar.com"))) == ["bar.com", "com", "foo", "foo.bar", "foo.bar.com"]


def test_coverage_keeps_the_levels_asked_for(spark):
    assert coverage.level_code(50) == "0O" and coverage.level_code(150) == "2q"
    made = [("0O0601", "0a05", "county"), ("2q060100010", "", ""), ("2Mzz", "x1", None), (None, None, "state")]
    df = spark.createDataFrame([(1, *r) for r in made], "k int, gvid string, own string, grain string")
    assert coverage.space_coverage(df, ["k"], "gvid", declared=["own"]).first().places == ["0O0601", "0a05", "x1"]
    assert coverage.space_coverage(df, ["k"], "gvid", levels=(40,)).count() == 0
    assert coverage.grain_coverage(df, ["k"], "gvid", declared=["grain"]).first().grains[-2:] == ["county", "state"]


def test_exact_quarters_of_odd_columns(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(None if i % 3 == 0 else f"k{i % 2}", None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(x), int(i % 5)) for i, x in enumerate(rng.normal(size=500).round(1))]
    df = spark.createDataFrame(rows, "k string, x double, n long").repartition(6)
    for r in stats.column_stats(df, ["k"], exact=True).collect():
        held = [x if r.column == "x" else n for k, x, n in rows if k == r.k]
        numbers = [v for v in held if v is not None and v == v]
        assert np.allclose([r.p25, r.p50, r.p75], np.quantile(numbers, [0.25, 0.5, 0.75]), rtol=1e-12)
        assert r.nuniques == len({str(v) for v in held if v is not None})


def test_coverage_of_generated_rows(spark):
    df = readers.generated(spark, 4000, {"year": 2000 + F.col("id") % 4, "n": F.col("id") % 100, "bg": values.gvid(F.col("id") % 4 + 1, F.col("id") % 16 / 4 + 1, F.col("id") % 5 + 1, F.col("id") % 5 + 1), "one": F.lit(1), "f": readers.random_normal(100, 15, 1)})
    assert coverage.time_coverage(df, ["one"], ["year"]).first().years == [2000, 2001, 2002, 2003]
    assert len(coverage.space_coverage(df, ["one"], "bg").first().places) == 16 and coverage.grain_coverage(df, ["one"], "bg").first().grains == ["2qZZZZZZZZZ"]
    assert df.agg(F.sum("n")).first()[0] == 198000 and 98 < df.agg(F.avg("f")).first()[0] < 102


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a,b"\n2,c\n')
    (tmp_path / "b.tsv").write_text("x\ty\n3\tq\n")
    (tmp_path / "f.txt").write_text("001abc  9\n002de  10\n")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.csv", "x,y\n7,z\n8,\n")
        z.writestr("other.txt", "no")
    (tmp_path / "m.csv").write_text("Title,,\n,Rent,\nname,low,high\n# note\na,1,2\n\nb,3,4\nsum,4,6\n")
    s = readers.SourceSpec
    assert [tuple(r) for r in readers.read(spark, s("a", str(tmp_path / "a.csv"))).collect()] == [("1", "a,b"), ("2", "c")]
    assert readers.read(spark, s("b", str(tmp_path / "b.tsv"), "tsv")).first() == ("3", "q")
    fixed = s("f", str(tmp_path / "f.txt"), "fixed", widths=(("id", 1, 3), ("t", 4, 4), ("n", 8, 2)))
    assert [tuple(r) for r in readers.read(spark, fixed).collect()] == [("001", "abc", "9"), ("002", "de", "10")]
    with pytest.raises(ValueError):
        readers.fixed_width(spark, "x", [("id", 1, 0)])
    assert [tuple(r) for r in readers.read(spark, s("z", str(tmp_path / "z.zip"), "zip", member=r"\.csv$")).collect()] == [("7", "z"), ("8", None)]
    messy = readers.read(spark, s("m", str(tmp_path / "m.csv"), header_lines=(1, 2), start_line=3, end_line=6, comment="#"))
    assert messy.columns == ["name", "Rent low", "Rent high"] and sorted(tuple(r) for r in messy.collect()) == [("a", "1", "2"), ("b", "3", "4")]
    both = runs.together(spark, [s("a", str(tmp_path / "a.csv")), s("b", str(tmp_path / "b.tsv"), "tsv")])
    assert sorted(r["_source"] for r in both.collect()) == ["a", "a", "b"]
    listed = [s("a", stage=2, dest_table="t"), s("b", dest_table="u"), s("c", kind="ref")]
    assert [[x.name for x in group] for group in runs.by_stage(listed)] == [["b", "c"], ["a"]] and [x.name for x in runs.only(listed, tables={"t"})] == ["a"]
    done = spark.createDataFrame([("a",)], "name string")
    assert [r.name for r in runs.pending(spark, listed, done).collect()] == ["b"] and runs.pending(spark, listed, done, force=True).count() == 2
    covers = runs.source_table(spark, [s("a", time="2001", space="CA", dest_table="t")])
    marked = build.source_partition(both.filter("_source = 'a'"), covers, "t")
    assert marked.first().partition == "t-2001-CA-a"
    assert readers.from_rows(spark, [(1, "x", 2)]).columns == ["int", "str", "int_3"]


def test_sources_of_folders_and_encodings_keep_their_names(spark, tmp_path):
    s = readers.SourceSpec
    for name in ("north side", "south"):
        (tmp_path / name).mkdir()
        for part in ("a", "b"):
            (tmp_path / name / f"{part}.csv").write_text(f"town,n\nK\u00f6ln {name} {part},1\n", encoding="latin-1")
    (tmp_path / "utf.csv").write_text("town,n\nÅrhus,2\n", encoding="utf-8")
    (tmp_path / "tabs.tsv").write_text("town\textra\nBrno\tx\n")
    specs = [s("N", str(tmp_path / "north side"), encoding="ISO-8859-1"), s("S", str(tmp_path / "south"), encoding="ISO-8859-1"), s("U", str(tmp_path / "utf.csv")), s("T", str(tmp_path / "tabs.tsv"), "tsv")]
    got = sorted((r["_source"], r.town, r.n, r.extra) for r in runs.together(spark, specs).collect())
    assert got == sorted([*[(n[0].upper(), f"Köln {n} {p}", "1", None) for n in ("north side", "south") for p in "ab"], ("U", "Århus", "2", None), ("T", "Brno", None, "x")])
    assert sorted(runs.together(spark, specs[:2], limited=True).groupBy("_source").count().collect()) == [("N", 2), ("S", 2)]
    with pytest.raises(ValueError):
        runs.together(spark, [specs[0], s("again", str(tmp_path / "north side" / "a.csv"), encoding="ISO-8859-1")])
    (tmp_path / "messy.csv").write_text("Über uns\nort,zahl\nMünchen,3\n", encoding="latin-1")
    messy = readers.read(spark, s("m", str(tmp_path / "messy.csv"), encoding="ISO-8859-1", header_lines=(1,), start_line=2))
    assert [tuple(r) for r in messy.collect()] == [("München", "3")]


def test_rows_of_the_wrong_width_are_not_silent(spark, tmp_path):
    (tmp_path / "w.csv").write_text('a,b\n1,2\n3\n4,5,6\n7,"8\n9"\n')
    s = lambda **more: readers.SourceSpec("w", str(tmp_path / "w.csv"), options={"multiLine": "true"}, **more)
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read(spark, s()).select("a").collect()
    assert [r.a for r in readers.read(spark, s(bad_rows="drop")).orderBy("a").collect()] == ["1", "7"]
    assert readers.read(spark, s(bad_rows="drop")).filter("a = '7'").first().b == "8\n9"
    assert {r["_corrupt"] for r in readers.corrupt_rows(spark, s()).collect()} == {"3", "4,5,6"} and readers.read(spark, s(bad_rows="keep")).count() == 4


def test_lines_are_numbered_and_split_whatever_their_form(spark, tmp_path):
    wide = ",".join(f'"c{i}, ""q"""' for i in range(5000))
    (tmp_path / "wide.csv").write_text("a title\n" + ",".join(f"h{i}" for i in range(5000)) + f"\n{wide}\n")
    table = readers.read(spark, readers.SourceSpec("w", str(tmp_path / "wide.csv"), header_lines=(1,), start_line=2))
    assert len(table.columns) == 5000 and table.select("h0", "h4999").first() == ('c0, "q"', 'c4999, "q"')
    (tmp_path / "many.txt").write_text("".join(f"line {i}\n" for i in range(40_000)))
    cut = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        lines = readers.numbered_lines(spark, str(tmp_path / "many.txt"))
        assert lines.rdd.getNumPartitions() > 10 and lines.filter("value <> 'line ' || line_no").count() == 0 and lines.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    spark.range(3).createOrReplaceTempView("some_frame")
    assert readers.read(spark, readers.SourceSpec("f", "some_frame", "frame")).count() == 3
    assert readers.read(spark, readers.SourceSpec("g", "squares", "generator"), {"squares": lambda spark: readers.generated(spark, 4, {"sq": F.col("id") * F.col("id")})}).agg(F.sum("sq")).first()[0] == 14
    assert readers.read(spark, readers.SourceSpec("q", "select 1 as one", "sql")).first().one == 1


def test_files_are_ingested_once(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    (source / "a.csv").write_text("x\n1\n2\n")
    schema = T.StructType([T.StructField("x", T.StringType())])
    assert ingest.ingest_new(spark, str(source), schema, out, marks) == 2
    (source / "b.csv").write_text("x\n3\n")
    assert ingest.ingest_new(spark, str(source), schema, out, marks) == 1
    assert ingest.ingest_new(spark, str(source), schema, out, marks) == 0


def test_scripts(spark, tmp_path):
    spark.range(20).select("id", (F.col("id") % 3).alias("g")).write.parquet(str(tmp_path / "p1"))
    house = Warehouse(spark, {"ex.com-ints-1": str(tmp_path / "p1")})
    script = "DROP VIEW IF EXISTS v; /* note; */ CREATE VIEW v AS SELECT g, count(*) AS n FROM ex.com-ints-1 WHERE 'a;b' <> '--' GROUP BY g; SELECT * FROM v WHERE n > 6; SELECT 1"
    assert len(statements(script)) == 4 and [r.n for r in house.run(script).collect()] == [7, 7]
    views = {"ex.com-ints-1": "v1", "o.day": "v2"}
    assert substituted("SELECT * FROM ex.com-ints-1 AS a JOIN b ON a.x = b.y", views)[1] == ["ex.com-ints-1"]
    for same in ("SELECT * FROM catalog.db.real_table", "SELECT 'from ex.com-ints-1' AS x FROM `ex.com-ints-1`", "SELECT extract(year FROM o.date) FROM t"):
        assert substituted(same, views) == (same, [])
    spark.range(2).write.parquet(str(tmp_path / "p2"))
    alike = Warehouse(spark, {"a-b": str(tmp_path / "p1"), "a_b": str(tmp_path / "p2")})
    assert alike.query("SELECT x.id FROM a-b x JOIN a_b y ON x.id = y.id").count() == 2 and alike.query("SELECT * FROM a-b").count() == 20
    with pytest.raises(KeyError):
        house.install("none")


def test_materialised_partitions_are_bucketed(spark, tmp_path):
    for name in ("l", "r"):
        spark.range(50).select("id", (F.col("id") % 5).alias("g")).write.parquet(str(tmp_path / name))
    house = Warehouse(spark, {f"ex.com-{n}-1": str(tmp_path / n) for n in ("l", "r")})
    got = house.run("INDEX ex.com-l-1 (id); INDEX ex.com-r-1 (id); SELECT count(*) AS n FROM ex.com-l-1 AS a JOIN ex.com-r-1 AS b ON a.id = b.id")
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = house.query("SELECT a.id FROM ex.com-l-1 AS a JOIN ex.com-r-1 AS b ON a.id = b.id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
    assert got.first().n == 50 and "Exchange" not in plan  # the buckets meet without a shuffle
    made = house.run("CREATE MATERIALIZED VIEW few AS SELECT g, count(*) AS n FROM ex.com-l-1 GROUP BY g; SELECT sum(n) AS n FROM few")
    assert made.first().n == 50
    for name in ("ex_com_l_1", "ex_com_r_1", "few"):
        spark.sql(f"DROP TABLE {name}")


def test_nested_json_of_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "d": null, "e": {}}'), (2, None), (3, "{broken"), (4, "[true]")], "i int, j string")
    got = sorted(map(str, (tuple(r) for r in nested.flattened_rows(df, "j").collect())))
    assert got == sorted(map(str, [(1, "a.b.0", "1"), (1, "a.b.1.c", "x"), (1, "d", None), (4, "0", "true")]))


def test_search_phrases_and_index(spark):
    p = search.parsed_phrase("bus fares by tract with transfers to 2011 in oregon from 2004")
    assert (p.about, p.with_, p.in_, p.by, p.years) == (["bus", "fares"], ["transfers"], ["oregon"], ["tract"], (2004, 2011))
    q = search.parsed_phrase("from transit.example to 1999 ridership")
    assert q.source == "transit.example" and q.years == (1970, 1999) and q.about == ["ridership"] and search.parsed_phrase("source mine.example").source == "mine.example"
    r = search.parsed_phrase("'fares by tract' with \"in 2004\" '' in 'new  york'")
    assert (r.about, r.with_, r.in_, r.by, r.years) == (["fares by tract"], ["in 2004"], ["new  york"], [], None)
    assert search.terms_of(r.about + ["bus-fares", "bus"]) == ["bus", "by", "fares", "tract"]
    docs = spark.createDataFrame([("d1", "Rent by county", "california"), ("d2", "Rent rent rent", "")], "doc string, text string, keywords string")
    index = search.inverted_index(docs, {"doc": "text", "keywords": "keywords"})
    scores = {r.doc: r.score for r in search.ranked(index, ["rent"]).collect()}
    assert scores == {"d1": 0.25, "d2": 0.75} and [r.doc for r in search.matching(index, ["california"], ["keywords"]).collect()] == ["d1"]
    more = spark.createDataFrame([("d2", "changed", ""), ("d3", "new", "")], docs.schema)
    fields = {"doc": "text", "keywords": "keywords"}
    assert {r.term for r in search.extended_index(index, more, fields).filter("doc = 'd2'").collect()} == {"rent"}
    assert {r.term for r in search.extended_index(index, more, fields, force=True).filter("doc = 'd2'").collect()} == {"changed"}
    names = spark.createDataFrame([("California", "state", "06"), ("Calexico, California", "place", "p1"), ("Nevada", "state", "32")], "name string, type string, gvid string")
    found = search.similar_names(names, spark.createDataFrame([("california",)], "asked string"))
    assert found.first().name == "California" and [r.gvid for r in search.places_named(found, names).collect()] == ["06"]
    years = spark.createDataFrame([("p", 1978, 1981)], "doc string, first_year int, last_year int")
    assert search.in_years(years, (1979, 1980)).count() == 1 and search.in_years(years, (1979, 1980), inside=False).count() == 0


def test_counts_take_whole_values(spark):
    long = [("p" * 250 + end,) for end in "aab"]
    df = spark.createDataFrame(long, "url string")
    assert {(r.value, r["count"]) for r in stats.value_counts(df, ["url"]).collect()} == {(long[0][0], 2), (long[2][0], 1)}
    assert stats.uvalues(df, ["url"]).first().uvalues == {long[0][0]: 2, long[2][0]: 1}


def test_saved_tables_are_cleared_with_their_block(spark):
    from pathlib import Path

    from datakiln.jobs import scratch

    place = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).parent
    with scratch.cleared(spark):
        first = place(scratch.save(spark.range(3).toDF("x"), "outer"))
        with scratch.cleared(spark):
            second = place(scratch.save(spark.range(3).toDF("x"), "inner"))
            kept = scratch.save(spark.range(3).toDF("x"), "kept", outlives=True)
        gone = place(kept)
        assert first.exists() and not second.exists() and kept.count() == 3
    assert not first.exists() and not gone.exists()
    stays = scratch.save(spark.range(2).toDF("x"), "stays", outlives=True)
    assert stays.count() == 2
