import datetime as dt
import zipfile

import pytest
from ruleframe.errors import RuleError
from ruleframe.operators import diff
from ruleframe.plans import steps
from ruleframe.plans.pipeline import Pipeline, parse_params, run_step
from ruleframe.sources import tables, xlsx
from ruleframe.streaming.upsert import latest, replace_partitions_stream


def test_sheet_round_trip(spark, tmp_path, rows):
    at = str(tmp_path / "a.xlsx")
    when = dt.datetime(2024, 5, 6, 12, 30)
    df = spark.createDataFrame([(1, "x & <y>", 1.5, True, when), (None, " 值", None, None, None), (3, None, 2.0, False, when)], "k long, t string, v double, b boolean, w timestamp_ntz")
    tables.write_table(df, at)
    told = []
    xlsx.write_xlsx(df, str(tmp_path / "p.xlsx"), progress=lambda n, of: told.append((n, of)), batch=2)
    assert told == [(2, 3), (3, 3)]
    back = tables.read_table(spark, at)
    assert back.columns == df.columns and rows(back) == rows(df)
    assert [f.dataType.simpleString() for f in back.schema] == ["bigint", "string", "double", "boolean", "timestamp_ntz"]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_stored_rows_of_other_partitions_survive(spark, tmp_path, rows, scheme):
    at = lambda n: f"{scheme}{tmp_path}/{n}.parquet"
    spark.createDataFrame([("a", k) for k in range(100)] + [("b", 7)], "g string, v int").write.parquet(at("stored"))
    spark.createDataFrame([("b", 8), ("b", 9)], "g string, v int").write.parquet(at("upload"))
    run_step(spark, "append_with_overwrite", {"database_file_path": at("stored"), "upload_file_path": at("upload"), "overwrite_conditions": {"g": "b"}})
    assert rows(spark.read.parquet(at("stored"))) == sorted([("a", k) for k in range(100)] + [("b", 8), ("b", 9)], key=repr)
    run_step(spark, "append_with_overwrite", {"database_file_path": at("new"), "upload_file_path": at("upload"), "overwrite_conditions": {"g": "b"}})
    assert rows(spark.read.parquet(at("new"))) == [("b", 8), ("b", 9)]


def test_sheets_at_file_addresses(spark, tmp_path, rows):
    tables.write_table(spark.range(3), f"file://{tmp_path}/a.xlsx")
    assert rows(tables.read_table(spark, f"file://{tmp_path}/a.xlsx")) == [(0,), (1,), (2,)]
    with pytest.raises(RuleError):
        tables.read_table(spark, "hdfs://host/a.xlsx")


def test_sheet_layout(spark, tmp_path):
    at = str(tmp_path / "b.xlsx")
    xlsx.write_rows(at, ["a", "b", ""], [[1, None, None], [], [2, "x"]], captions=None)
    assert xlsx.read_rows(at) == (["a", "b"], [[1, None], [None, None], [2, "x"]])
    for header, data in ((["a", "a"], [[1, 2]]), (["a", ""], [[1, 2]]), (["a"], [[1, 2]]), ([], [])):
        xlsx.write_rows(at, header, data)
        with pytest.raises(RuleError):
            xlsx.read_rows(at)
    with pytest.raises(RuleError):
        xlsx.write_rows(str(tmp_path / "b.xls"), ["a"], [])
    xlsx.write_rows(at, ["a"], [[1]], sheet="S & T", captions={"a": "caption"})
    assert xlsx.read_rows(at, "S & T") == (["a"], [["caption"], [1]])
    with pytest.raises(RuleError):
        xlsx.read_rows(at, "other")


def test_written_over_its_own_input(spark, tmp_path, rows):
    at = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(at)
    tables.write_table(spark.read.parquet(at).where("id > 2"), at)
    assert rows(spark.read.parquet(at)) == [(3,), (4,)]

    def fail():
        raise RuleError("no")

    with pytest.raises(RuleError):
        tables.write_table(spark.range(1), at, verify=fail)
    assert rows(spark.read.parquet(at)) == [(3,), (4,)] and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]
    for bad in ("x.csv", "x"):
        with pytest.raises(RuleError):
            tables.write_table(spark.range(1), bad)
        with pytest.raises(RuleError):
            tables.read_table(spark, bad)
    assert tables.query(spark, f"SELECT count(*) AS n, 'read_parquet(''x'')' AS t FROM read_parquet('{at}')").first().asDict() == {"n": 2, "t": "read_parquet('x')"}
    with pytest.raises(RuleError):
        tables.query(spark, "  ")


def test_schedule_runs_in_order(spark, tmp_path, rows):
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame([("a", "1"), ("a", "2"), ("b", " ")], "g string, v string").write.parquet(at("in.parquet"))
    schedule = [
        {"order": 2, "function": "service.filter_group_sum_to_excel", "params": {"input_file_path": at("f.parquet"), "output_file_path": at("s.parquet"), "group_sum_params": {"sum_by": ["v"], "group_by": ["g"]}}, "enabled": "y"},
        {"order": 1, "function": "filter_by_conditions", "params": f'{{"input_file_path": "{at("in.parquet")}",\n "conditions": {{"g": "a"}}, "output_file_path": "{at("f.parquet")}"}}', "enabled": "Y"},
        {"order": 3, "function": "nothing.there", "params": "broken", "enabled": None},
    ]
    seen = []
    assert len(Pipeline(schedule).run(spark, lambda e: seen.append((e.index, e.state)))) == 2
    assert seen == [(1, "started"), (1, "completed"), (2, "started"), (2, "completed")]
    assert rows(spark.read.parquet(at("s.parquet"))) == [("a", 3.0)]
    run_step(spark, "append_with_overwrite", {"database_file_path": at("db.parquet"), "upload_file_path": at("f.parquet"), "overwrite_conditions": {"g": "a"}})
    run_step(spark, "append_with_overwrite", {"database_file_path": at("db.parquet"), "upload_file_path": at("f.parquet"), "overwrite_conditions": {"g": "a"}})
    assert spark.read.parquet(at("db.parquet")).count() == 2
    spark.createDataFrame([("a", "9")], "g string, v string").write.parquet(at("other.parquet"))
    made = run_step(spark, "diff_by_row_to_excel", {"first_file_path": at("other.parquet"), "second_file_path": at("in.parquet"), "output_file_path": at("d.xlsx"), "join_keys": ["g"]})
    assert made.endswith("d(增1_删0_改1).xlsx") and xlsx.read_rows(made, "差异明细")[0] == ["差异类型", "g", "旧_v", "新_v"]


@pytest.mark.parametrize("change", [{"order": True}, {"order": "1"}, {"enabled": "Q"}, {"function": " "}, {"params": "[1]"}, {"params": "{"}])
def test_schedule_faults(change):
    with pytest.raises(RuleError):
        Pipeline([{"order": 1, "function": "concat", "params": {}, "enabled": "Y"} | change])


def test_schedule_preview():
    step = {"order": 1, "function": "concat", "params": None, "enabled": "Y"}
    with pytest.raises(RuleError):
        Pipeline([step, step])
    with pytest.raises(RuleError):
        Pipeline([step]).preview()
    with pytest.raises(RuleError):
        Pipeline([step | {"function": "os.system"}]).preview()
    assert parse_params(" ", 2) == {} and parse_params('{"a": "x\ny"}', 2) == {"a": "x\ny"}


def test_stream_replaces_partitions(spark, tmp_path, rows):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 1)], "p string, v int").write.parquet(source)
    go = lambda: replace_partitions_stream(spark.readStream.schema("p string, v int").parquet(source), target, ["p"], str(tmp_path / "c")).awaitTermination(60)
    go()
    spark.createDataFrame([("a", 2)], "p string, v int").write.mode("append").parquet(source)
    go()
    assert rows(spark.read.parquet(target).select("p", "v")) == [("a", 2), ("b", 1)]
    assert rows(latest(spark.createDataFrame([("a", 1), ("a", 3)], "k string, v int"), ["k"], ["v"])) == [("a", 3)]


def test_plans_stay_in_the_jvm(spark):
    from ruleframe.queries import steps as queries

    for name in ("filter_compare", "map_layered", "allocate_service", "diff_report"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
        if name == "filter_compare":
            pushed, read = plan.split("PushedFilters: ")[1], plan.split("ReadSchema: ")[1]
            assert pushed.startswith("[IsNotNull(l_quantity)") and "l_shipdate" not in read and "l_comment" not in read


def test_difference_workbook(spark, tmp_path):
    schema = "k string, v string, w string, _tmp_diff_src string"
    found = spark.createDataFrame([("a", "1", "x", "df_1"), ("a", "2", " NaN ", "df_2"), ("b", "1", "None", "df_1"), ("c", " none", "y", "df_2")], schema)
    made = xlsx.write_diff(diff.report(found, ["k"]), str(tmp_path / "sub" / "d.xlsm"))
    assert made == str(tmp_path / "sub" / "d(增1_删1_改1).xlsm") and [p.name for p in (tmp_path / "sub").iterdir()] == ["d(增1_删1_改1).xlsm"]
    header, data = xlsx.read_rows(made, "差异明细")
    assert header == ["差异类型", "k", "旧_v", "旧_w", "新_v", "新_w"]
    assert sorted(data) == sorted([["改", "a", "1", "x", "2", None], ["删", "b", "1", None, None, None], ["增", "c", None, None, None, "y"]])
    with zipfile.ZipFile(made) as z:
        sheet, styles, kinds = (z.read(n).decode() for n in ("xl/worksheets/sheet1.xml", "xl/styles.xml", "[Content_Types].xml"))
    assert "FFFFF59D" in styles and 'topLeftCell="B2"' in sheet and "autoFilter" in sheet and sheet.count('s="3"') == 4 and "application/vnd.ms-excel.sheet.macroEnabled.main+xml" in kinds
    empty = xlsx.write_diff(diff.report(found.limit(0), ["k"]), str(tmp_path / "e.txt"))
    assert empty.endswith("e(增0_删0_改0).xlsx") and "autoFilter" not in zipfile.ZipFile(empty).read("xl/worksheets/sheet1.xml").decode()


def test_own_steps_and_writing_events(spark, tmp_path):
    at = str(tmp_path / "n.xlsx")

    def count_up(store, n, path):
        return store.write(store.spark.range(n), path)

    def plain(a, b=2):
        return a + b

    steps.register(count_up, "own.count_up")
    try:
        seen = []
        rows = [{"order": 1, "function": "own.count_up", "params": {"n": 3, "path": at}, "enabled": "Y"}, {"order": 2, "function": plain, "params": {"a": 1}, "enabled": "Y"}]
        assert Pipeline(rows).run(spark, lambda e: seen.append((e.index, e.state, e.rows, e.of))) == [at, 3]
        assert seen == [(1, "started", None, None), (1, "writing", 3, 3), (1, "completed", None, None), (2, "started", None, None), (2, "completed", None, None)]
        assert run_step(spark, plain, {"a": 2}) == 4
        with pytest.raises(RuleError):
            steps.register(plain, "own.count_up")
    finally:
        del steps.STEPS["own.count_up"]
    for bad in ("other.module.concat", "os.system", "", "count_up"):
        with pytest.raises(RuleError):
            steps.resolve(bad)
    assert steps.resolve("service.concat") is steps.resolve("concat") is steps.resolve("some_package.service.concat")
    with pytest.raises(RuleError):
        run_step(spark, plain, {"z": 1})
