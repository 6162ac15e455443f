from __future__ import annotations

import json

import pytest
from helpers import audit, dicts
from pyspark.errors import AnalysisException, SparkRuntimeException

from seatscope.operators import clean
from seatscope.params import Exclusions, Params, Source, build_params
from seatscope.plans.review import in_report_order
from seatscope.sources import exclusions, readers, writers


def test_technicians_from_csv_keep_the_first_spelling(spark, tmp_path):
    path = tmp_path / "technicians.csv"
    path.write_text("Full Name\nAndy Self\nandy  self\nBeth Jones\n\nNA\n", encoding="utf-8")
    names = readers.read_technicians(spark, Params(technicians=Source(str(path))))
    rows = dicts(in_report_order("technician_list", names))
    assert [row["production_technician_name"] for row in rows] == ["Andy Self", "Beth Jones"]
    assert [row["production_technician_match_key"] for row in rows] == ["andy self", "beth jones"]


def test_first_spelling_follows_file_order_over_many_blocks(spark, tmp_path):
    lines = ["Full Name"]
    for n in range(2000):
        lines += [f"Person {n}", f"PERSON  {n}"]
    (tmp_path / "big.csv").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        source = Source(str(tmp_path / "big.csv"))
        names = readers.read_technicians(spark, Params(technicians=source))
        kept = {row["production_technician_name"] for row in names.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    assert kept == {f"Person {n}" for n in range(2000)}


def test_order_column_decides_over_file_order(spark, tmp_path):
    spark.createDataFrame([("ANN", 2), ("Ann", 1)], "`Full Name` string, pos int").write.parquet(
        str(tmp_path / "t")
    )
    source = Source(str(tmp_path / "t"), format="parquet", order_column="pos")
    names = readers.read_technicians(spark, Params(technicians=source))
    assert [row["production_technician_name"] for row in names.collect()] == ["Ann"]


def test_named_licences_from_json(spark, tmp_path):
    rows = [
        {"User": " Ann Lee ", "Allocated License": " Full "},
        {"User": "ann  lee", "Allocated License": "Shared"},
        {"User": " ", "Allocated License": "Full"},
        {"User": None, "Allocated License": "Full"},
        {"User": "Bob", "Allocated License": None},
    ]
    path = tmp_path / "named.json"
    path.write_text("\n".join(json.dumps(row) for row in rows), encoding="utf-8")
    named = readers.read_named_licences(spark, Params(named=Source(str(path))))
    assert sorted((r["named_user"], r["allocated_licence"]) for r in dicts(named)) == [
        ("Ann Lee", "Full"),
        ("Bob", None),
    ]


def test_login_audit_from_csv_has_trimmed_headers_and_text_cells(spark, tmp_path):
    path = tmp_path / "audit.csv"
    path.write_text(
        ' User Name ,Event Time,Note\n"Doe, ""J"" (x)",2026-01-01 00:00:00,\nnull,2026-01-01 00:00:00,7\n',
        encoding="utf-8",
    )
    table = readers.read_login_audit(spark, Params(login=Source(str(path))))
    assert table.columns == ["User Name", "Event Time", "Note"]
    assert [tuple(row) for row in table.collect()] == [
        ('Doe, "J" (x)', "2026-01-01 00:00:00", None),
        (None, "2026-01-01 00:00:00", "7"),
    ]


def test_catalog_table_input(spark):
    spark.createDataFrame([("u", "2026-01-01 00:00:00")], "`User Name` string, `Event Time` string").createOrReplaceTempView("audit_view")
    source = Source("audit_view", format="table")
    assert readers.read_login_audit(spark, Params(login=source)).count() == 1
    spark.createDataFrame([("B",), ("b",)], "`Full Name` string").coalesce(1).createOrReplaceTempView("tech_view")
    names = readers.read_technicians(spark, Params(technicians=Source("tech_view", format="table")))
    assert [row["production_technician_name"] for row in names.collect()] == ["B"]


def test_missing_and_unsupported_inputs(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_login_audit(spark, Params(login=Source(str(tmp_path / "none.csv"))))
    with pytest.raises(ValueError, match="Unsupported input format: txt"):
        readers.read_technicians(spark, Params(technicians=Source("list.txt")))
    with pytest.raises(ValueError, match="login audit source is required"):
        readers.read_login_audit(spark, Params())
    (tmp_path / "t.csv").write_text("Name\nx\n")
    with pytest.raises(ValueError, match="Missing Production Technician name column: Full Name"):
        readers.read_technicians(spark, Params(technicians=Source(str(tmp_path / "t.csv"))))
    with pytest.raises(ValueError, match="Missing required named licence columns: Allocated License, User"):
        readers.read_named_licences(spark, Params(named=Source(str(tmp_path / "t.csv"))))
    for reader in (readers.read_technicians, readers.read_named_licences, readers.read_denial_audit):
        assert reader(spark, Params()).isEmpty()


def write_json(path, payload):
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")
    return str(path)


def test_exclusions_file(spark, tmp_path):
    payload = {"excluded_user_exact_values": ["Exact User"], "excluded_user_contains_values": ["service"]}
    path = write_json(tmp_path / "exclusions.json", payload)
    loaded = exclusions.load_exclusions(spark, path)
    assert (loaded.exact, loaded.contains) == ((), ())
    assert sorted(map(tuple, loaded.table.collect())) == [("contains", "service"), ("exact", "Exact User")]
    assert exclusions.load_exclusions(spark, str(tmp_path / "none.json")).table.count() == 0
    for partial in ({}, {"excluded_user_exact_values": []}, {"other": 1}):
        path = write_json(tmp_path / "partial.json", partial)
        assert exclusions.load_exclusions(spark, path).table.count() == 0


@pytest.mark.parametrize(
    ("payload", "message"),
    [
        ({"excluded_user_exact_values": "not-a-list"}, "excluded_user_exact_values"),
        ({"excluded_user_exact_values": [1]}, "excluded_user_exact_values"),
        ({"excluded_user_contains_values": ["a", None]}, "excluded_user_contains_values"),
        ({"excluded_user_contains_values": [None]}, "excluded_user_contains_values"),
        ({"excluded_user_contains_values": ["a", 2]}, "excluded_user_contains_values"),
        ({"excluded_user_contains_values": [["a"]]}, "excluded_user_contains_values"),
        ({"excluded_user_exact_values": None}, "excluded_user_exact_values"),
        ({"excluded_user_exact_values": {}}, "excluded_user_exact_values"),
        ([], "JSON object"),
        ("[1", "JSON object"),
    ],
)
def test_malformed_exclusions_are_refused(spark, tmp_path, payload, message):
    path = write_json(tmp_path / "exclusions.json", payload)
    with pytest.raises(ValueError, match=message):
        exclusions.load_exclusions(spark, path)
    texts = spark.read.text(path, wholetext=True).selectExpr("'doc' AS origin", "value")
    with pytest.raises(SparkRuntimeException, match=message):
        exclusions.parse_exclusions(texts).collect()


@pytest.mark.parametrize("size", [0, 1, 300, 999, 1000, 1001, 5000])
def test_lists_of_any_length_take_the_same_route(spark, tmp_path, size):
    tokens = [f"svc-{n:04d}-" for n in range(size)]
    path = write_json(tmp_path / "exclusions.json", {"excluded_user_contains_values": tokens})
    raw = audit(spark, [(f"my SVC-{n:04d}-x", "2026-01-01 00:00:00") for n in (0, 299, 998, 999, 1000, 4999, 7000)])
    from_file = build_params(file_exclusions=exclusions.load_exclusions(spark, path))
    in_code = build_params(exclusions=Exclusions(contains=tuple(tokens)))
    left = sum(n >= size for n in (0, 299, 998, 999, 1000, 4999, 7000))
    for params in (from_file, in_code):
        assert clean.clean_login(raw, params).count() == left


def test_build_params(spark, tmp_path):
    path = write_json(
        tmp_path / "exclusions.json",
        {"excluded_user_exact_values": ["Custom"], "excluded_user_contains_values": ["fragment"]},
    )
    from_file = exclusions.load_exclusions(spark, path)
    assert build_params(file_exclusions=from_file).exclusions == from_file
    assert build_params().exclusions == Exclusions()
    assert build_params(user_column="", recent_days=None) == Params()
    assert build_params(lowercase_users=True, recent_days=30).recent_days == 30
    with pytest.raises(TypeError, match="Unknown parameters: colour"):
        build_params(colour="red")


def test_writers(spark, tmp_path):
    table = spark.createDataFrame([("a", None), (None, 1)], "s string, n int").coalesce(1)
    for _ in range(2):
        folders = writers.write_tables({"t": table}, str(tmp_path / "deep" / "out"), "csv")
    text = "".join(p.read_text() for p in (tmp_path / "deep" / "out" / "t").glob("*.csv"))
    assert folders == [str(tmp_path / "deep" / "out" / "t")]
    assert text == "s,n\na,\n,1\n"
    with pytest.raises(ValueError, match="Unsupported output format: xlsx"):
        writers.write_tables({}, "x", "xlsx")
