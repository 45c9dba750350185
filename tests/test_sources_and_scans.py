"""Text sources by their own headers and records, tables right by default, scans and folds of any associative function."""

import csv
import io
import zipfile
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from datakiln.functions import values
from datakiln.jobs import build
from datakiln.operators import headers, row_index, transforms
from datakiln.operators import rows as rows_of_tables
from datakiln.sources import readers, records, runs


def test_files_of_one_source_have_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "some [files] 1"
    folder.mkdir()
    (folder / "a.csv").write_text("city,name\nrome,ann\n")
    (folder / "b.csv").write_text('name,city,"age, years"\nbob,"oslo, n",7\n')
    (folder / "c.csv").write_text("name\ncat\n")
    (folder / "d.csv").write_text("")
    s = readers.SourceSpec
    rows = readers.read(spark, s("x", str(folder).replace("[", "\\[").replace("]", "\\]")))
    assert sorted((r.city or "", r.name, r["age, years"] or "") for r in rows.collect()) == [("", "cat", ""), ("oslo, n", "bob", "7"), ("rome", "ann", "")]
    (folder / "e.csv").write_text("city,name\nwien,dan,9\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read(spark, s("x", str(folder / "e.csv").replace("[", "\\[").replace("]", "\\]"))).select("city").collect()
    messy = tmp_path / "messy"
    messy.mkdir()
    (messy / "a.csv").write_text("A title\nname,n\nann,1\nbob,2,3\n")
    (messy / "b.csv").write_text("A title\nn,x,name\n4,y,cat\n5\n")
    (messy / "c.csv").write_text("")
    spec = s("m", str(messy), header_lines=(1,), start_line=2, bad_rows="keep")
    kept = readers.read(spark, spec)
    assert kept.columns[-1] == "_corrupt" and sorted((r.name or "", r.n or "", r.x or "", r["_corrupt"] or "") for r in kept.collect()) == [("", "", "", "5"), ("", "", "", "bob,2,3"), ("ann", "1", "", ""), ("cat", "4", "y", "")]
    assert sorted(r.name for r in readers.read(spark, replace(spec, bad_rows="drop")).collect()) == ["ann", "cat"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read(spark, replace(spec, bad_rows="fail")).count()
    with pytest.raises(ValueError, match="bad_rows"):
        readers.read(spark, replace(spec, bad_rows="guess"))


def test_many_headers_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_LAYOUTS", 2)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"c{i}\n1\n")
    with pytest.raises(ValueError, match="distinct headers"):
        readers.read(spark, readers.SourceSpec("x", str(tmp_path)))


def test_zipped_records_obey_the_policy(spark, tmp_path):
    for name, text in (("a", 'x,y\n1,"two\nlines"\n3,4,5\n'), ("b", "y,x\nq,7\n\n"), ("c", "")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("in/one.csv", text)
    spec = readers.SourceSpec("z", str(tmp_path), "zip", bad_rows="keep")
    assert sorted((r.x or "", r.y or "", r["_corrupt"] or "") for r in readers.read(spark, spec).collect()) == [("", "", "3,4,5"), ("1", "two\nlines", ""), ("7", "q", "")]
    assert [r["_corrupt"] for r in readers.corrupt_rows(spark, spec).collect()] == ["3,4,5"]
    assert readers.read(spark, replace(spec, bad_rows="drop")).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read(spark, replace(spec, bad_rows="fail")).select("x").collect()


@given(st.lists(st.lists(st.text(alphabet='ab,"\n', max_size=6), min_size=2, max_size=2), max_size=8))
@settings(max_examples=40, deadline=None)
def test_lines_of_a_stream_join_into_the_records_they_were(rows):
    held = io.StringIO()
    csv.writer(held, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    lines = held.getvalue().split("\n")[:-1]
    assert list(csv.reader(r + "\n" for _, r in records.joined_lines(iter(lines)))) == rows


def test_lines_of_tables_join_as_those_of_a_stream(spark, monkeypatch):
    monkeypatch.setattr(records, "MOST_LINES", 5)
    files = {
        "even": ["a,b", 'c,"d"', "", "e,f"], "spread": ['1,"a', "", 'b""', 'c"', "2,x", '3,"', '"'], "open": ["1,a", '2,"never', "closed", "at all"],
        "long": ['1,"', *[str(i) for i in range(9)], '"', "2,after"], "none": [],
    }
    lines = spark.createDataFrame([(f, i, t) for f, held in files.items() for i, t in enumerate(held)], "file string, line_no long, value string").repartition(3)
    got = {}
    for r in records.records(lines, ["file"]).orderBy("file", "line_no").collect():
        got.setdefault(r.file, []).append((r.line_no, r.value))
    want = {f: list(records.joined_lines(iter(held))) for f, held in files.items() if held and f != "long"}
    assert {f: v for f, v in got.items() if f != "long"} == want and want["spread"] == [(0, '1,"a\n\nb""\nc"'), (4, "2,x"), (5, '3,"\n"')]
    assert [v.startswith(records.BROKEN) for _, v in want["open"]] == [False, True, True, True]
    assert len(got["long"]) == 12 and [v.startswith(records.BROKEN) for _, v in got["long"]] == [True] * 11 + [False]


HELPERS = ["_range", "_place", "_n", "_first", "_before", "_row_n", "_failed_x", "_linked_x", "_linked_key", "_value", "_late", "_state", "_scanned", "_k_k", "_time", "_space", "_grain", "_segment", "_nth", "_parts", "_errors_"]


def test_columns_may_bear_every_helper_name(spark):
    df = spark.createDataFrame([(i, i % 2, str(i), *[f"{h}{i}" for h in HELPERS]) for i in range(20)], ", ".join(["nr long", "k int", "x string", *[f"{h} string" for h in HELPERS]]))
    kept = lambda made: all(r[h] == f"{h}{r['nr']}" for r in made.collect() for h in HELPERS)
    for made in (
        row_index.with_row_number(df, ["nr"]), row_index.with_row_number(df), row_index.running_total(df, ["k"], ["nr"], "nr"), build.numbered_in_partitions(df, ["k"], ["nr"]),
        row_index.scan_with(df, ["k"], ["nr"], "nr", "most", max, "long"), build.source_partition(df.withColumn("_source", F.lit("s")), runs.source_table(spark, [readers.SourceSpec("s", time="2001")]), "t"),
    ):
        assert made.count() == 20 and kept(made)
    c = headers.ColumnSpec
    specs = [c(1, "id", "int", role="k"), c(2, "nr", "int"), c(3, "x", "int", "fips/state", transform=";{v + 1}"), *[c(4 + i, h, "str") for i, h in enumerate(HELPERS)]]
    cast = transforms.cast_columns(df, headers.TableSpec("t", {s.name: s for s in specs}), order=["nr"])
    assert kept(cast) and sorted((r.id, r.nr, r.x) for r in cast.collect()) == [(i + 1, i, i + 1) for i in range(20)]


def test_rows_are_numbered_as_they_come(spark):
    df = spark.range(1000).repartition(7)
    got = sorted(r.n for r in row_index.with_row_number(df, name="n").collect())
    assert got == list(range(1, 1001))
    table = headers.TableSpec("t", {s.name: s for s in [headers.ColumnSpec(1, "key", "int", role="k"), headers.ColumnSpec(2, "x", "str")]})
    assert sorted(r.key for r in transforms.cast_columns(df.select(F.col("id").cast("string").alias("x")), table).collect()) == list(range(1, 1001))


def test_names_never_clash():
    assert headers.unique_names(["a", "a", "a_2", "a", "b"]) == ["a", "a_2", "a_2_3", "a_4", "b"]
    for names in (["x"] * 9, ["a", "a_2", "a", "a_3", "a"], ["", "", "_2"]):
        assert len(set(headers.unique_names(names))) == len(names)


def test_codes_of_a_merged_table_are_kept(spark):
    c = headers.ColumnSpec
    made = headers.merged("t", [[c(1, "n", "int", has_codes=True), c(2, "n_code", "str"), c(3, "m", "int")], [c(1, "n", "int"), c(2, "m", "float", has_codes=True)], [c(1, "z", "int", has_codes=True)], [c(1, "z", "str")]])
    assert list(made.columns) == ["id", "n", "n_code_", "z", "n_code", "m", "m_code"] and made.columns["z"].datatype == "str"
    assert [s.position for s in made.columns.values()] == list(range(1, 8))
    rows = transforms.cast_columns(spark.createDataFrame([("1", "*", "x"), ("-", "2.5", "y")], "n string, m string, z string"), made, order=["n"])
    assert sorted((r.id, r.n, r.n_code_, r.m, r.m_code, r.z, r["_errors"]) for r in rows.collect()) == [(1, None, "-", 2.5, None, "y", []), (2, 1, None, None, "*", "x", [])]


def test_a_linked_key_that_repeats_names_one_row(spark):
    c = headers.ColumnSpec
    linked = {"fips/state": spark.createDataFrame([(6, "California"), (6, "Calif."), (7, "other")], "state int, name string")}
    specs = [c(1, "state", "int", "fips/state"), c(2, "name", "str", transform=";row.state.name")]
    rows = transforms.cast_columns(spark.createDataFrame([("6",), ("6",), ("8",)], "state string"), headers.TableSpec("t", {s.name: s for s in specs}), linked=linked)
    assert sorted((r.state, r.name or "") for r in rows.collect()) == [(6, "Calif."), (6, "Calif."), (8, "")]


def test_blank_parts_and_strokes_come_back_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["", "-", "--", "-a", "a-", None])], "n int, s string")
    build.write_partitions(build.with_partition(rows, "t", segment=F.col("s")), str(tmp_path / "p"))
    found = {r.n: r.p_segment for r in build.read_partitions(spark, str(tmp_path / "p")).collect()}
    assert found == {0: "", 1: "-", 2: "--", 3: "-a", 4: "a-", 5: ""}
    assert [sorted(r.n for r in build.read_partitions(spark, str(tmp_path / "p"), segment=s).collect()) for s in ("", "-", "-a", "a-")] == [[0, 5], [1], [3], [4]]


def test_a_null_tract_has_no_dotted_form(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (1234,), (400101,)], "t int").select(values.tract_dotted(F.col("t"))).collect()] == [None, "0012.34", "4001.01"]


@pytest.mark.parametrize("ranges", [1, 5])
def test_scans_agree_with_plain_ones(spark, monkeypatch, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", i, None if i % 4 == 0 else (i * 37) % 101, f"t{i}" if i % 6 == 0 else None) for i in range(200)]
        df = spark.createDataFrame(rows, "key string, at int, x int, t string").repartition(3)
        made = {"least": ("least", F.col("x")), "most": ("greatest", F.col("x")), "sum": ("sum", F.col("x")), "last": ("last", F.col("t")), "some": ("some", F.col("x") > 50)}
        got = sorted((r.at, r.least, r.most, r.sum, r.last, r.some) for r in row_index.prefix_scan(df, ["key"], ["at"], made).collect())
        joined = sorted((r.at, r.first_and_last) for r in row_index.scan_with(df, ["key"], ["at"], "t", "first_and_last", lambda a, b: a.split(" ")[0] + " " + b.split(" ")[-1], "string").collect())
        whole = sorted((r.at, r.most) for r in row_index.scan_with(df, [], ["at"], "x", "most", max, "int").collect())
        want, want_joined = [], []
        for key, at, _, _ in rows:
            xs = [x for k, a, x, _ in rows if k == key and a <= at and x is not None]
            ts = [t for k, a, _, t in rows if k == key and a <= at and t]
            want.append((at, min(xs, default=None), max(xs, default=None), sum(xs), ts[-1] if ts else None, any(x > 50 for x in xs) if xs else None))
            want_joined.append((at, None if not ts else ts[0] if len(ts) == 1 else f"{ts[0]} {ts[-1]}"))
        assert got == want and joined == want_joined
        assert whole == [(at, max((x for _, a, x, _ in rows if a <= at and x is not None), default=None)) for _, at, _, _ in rows]
        assert row_index.scan_with(df.limit(0), ["key"], ["at"], "x", "y", max, "int").collect() == row_index.prefix_scan(df.limit(0), ["key"], ["at"], made).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_folds_of_user_code_need_no_order(spark, monkeypatch):
    monkeypatch.setattr(rows_of_tables, "FAN_IN", 2)
    monkeypatch.setattr(rows_of_tables, "KEYS_HELD", 2)
    rows = [(None if i % 7 == 0 else f"k{i % 4}", None if i % 5 == 0 else i % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, x int").repartition(9)
    counted = lambda held, x: held | {x: held.get(x, 0) + 1} if x is not None else held
    merge = lambda a, b: {x: a.get(x, 0) + b.get(x, 0) for x in a.keys() | b.keys()}
    made = rows_of_tables.tree_fold(df, ["key"], "x", dict, counted, merge, "map<int,long>").collect()
    want = {}
    for key, x in rows:
        want[key] = counted(want.get(key, {}), x)
    assert {r.key: r.state for r in made} == want and len(made) == len(want)
    assert rows_of_tables.tree_fold(df, [], "x", int, lambda s, x: s + (x or 0), lambda a, b: a + b, "long").first().state == sum(x or 0 for _, x in rows)
    assert rows_of_tables.tree_fold(df.limit(0), ["key"], "x", dict, counted, merge, "map<int,long>").collect() == []


def test_frames_declare_tables_and_tables_head_sources(spark):
    df = spark.createDataFrame([(1, "a", 2.5, None, b"x", [1])], "n int, t string, f float, d date, b binary, l array<int>").withColumn("f", F.col("f").alias("f", metadata={"role": "m", "valuetype": "rate"}))
    made = headers.table_of_frame(df, "t")
    assert [(c.name, c.datatype, c.role) for c in made.columns.values()] == [("id", "int", "k"), ("n", "int", ""), ("t", "str", ""), ("f", "float", "m"), ("d", "date", ""), ("b", "blob", ""), ("l", "str", "")]
    raw = spark.createDataFrame([("1", "2", "3", "4", "5", "6")], "a string, t string, c string, e string, g string, h string")
    assert headers.headed_by(raw, made).columns == ["n", "t", "f", "d", "b", "l"] and headers.headed_by(raw.select("a").withColumn("id", F.lit(1)), headers.table_of_frame(df.select("n"), "t")).columns == ["id", "n"]
    with pytest.raises(ValueError, match="names for"):
        headers.headed_by(raw.select("a"), made)
    listed = lambda **more: [tuple(r) for r in headers.column_changes({"s": (raw.columns, made)}, spark, **more).orderBy("position").collect()]
    assert listed() == [("s", 1, "a", "n"), ("s", 3, "c", "f"), ("s", 4, "e", "d"), ("s", 5, "g", "b"), ("s", 6, "h", "l")] and len(listed(all_columns=True)) == 6
    with pytest.raises(ValueError, match="columns of 's'"):
        headers.column_changes({"s": (["a"], made)}, spark)


def test_runs_are_measured_by_their_own_action(spark, tmp_path):
    run = rows_of_tables.measured_run(spark.range(50), lambda df: df.write.parquet(str(tmp_path / "x")), "measured")
    assert run.rows == 50 and run.rate > 0 and rows_of_tables.Run().rate == 0
    kept, seen = rows_of_tables.skip_counted(spark.range(10), F.col("id") > 6, "one table", table="t", only="u")
    assert kept.count() == 10 and (seen.get["skipped"], seen.get["passed"]) == (0, 10)
