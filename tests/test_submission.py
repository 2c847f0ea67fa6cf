from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from framelake import validate, write_submission
from framelake.constants import EXPECTED_COLS, EXPECTED_ROWS
from framelake.operators.submission import label_table, line_profiles, stray_labels, validation_report


def small(spark, tmp_path, text, **kw):
    path = tmp_path / "m.txt"
    path.write_text(text)
    return validate(spark, str(path), **{"expected_rows": 2, "expected_cols": 3, **kw})


def constant(spark, tmp_path, value):
    path = str(tmp_path / "full")
    line = " ".join([str(value)] * EXPECTED_COLS)
    spark.range(0, EXPECTED_ROWS, 1, 4).selectExpr(f"'{line}' AS value").write.text(path)
    return path


def test_full_size(spark, tmp_path):
    rep = validate(spark, constant(spark, tmp_path, 1))
    assert rep.ok, rep.messages
    assert (rep.n_rows, rep.n_cols, rep.n_nans) == (EXPECTED_ROWS, EXPECTED_COLS, 0)
    assert rep.unique_labels == (1,)


def test_out_of_range(spark, tmp_path):
    rep = validate(spark, constant(spark, tmp_path, 99))
    assert not rep.ok
    assert rep.messages == ("labels outside allowed set: [99]",)
    assert rep.unique_labels == (99,)


def test_wrong_shape(spark, tmp_path):
    rep = small(spark, tmp_path, "1 1\n" * 10, expected_rows=EXPECTED_ROWS, expected_cols=EXPECTED_COLS)
    assert not rep.ok
    assert any("rows" in m for m in rep.messages)
    assert any("cols" in m for m in rep.messages)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("1 2 3\n1 nan 3\n", "1 NaN entries"),
        ("nan nan nan\n1 2 3\n", "3 NaN entries"),
        ("1 inf 3\n1 2 3\n", "non-integer entries present"),
        ("1 1.5 3\n1 2 3\n", "non-integer entries present"),
        ("1 1e300 3\n1 2 3\n", "non-integer entries present"),
        ("1 2 x\n1 2 3\n", "1 entries are not numbers"),
        ("x x x\n1 2 3\n", "3 entries are not numbers"),
        ("1 2 3\n1 2\n", "ragged rows: 2 to 3 columns"),
        ("1 2 3\n1 2 0x1\n", "1 entries are not numbers"),
        ("1 2 3\n1 2 1d\n", "1 entries are not numbers"),
        ("1 2 3\n1 0 9\n", "labels outside allowed set: [0, 9]"),
        ("1 2 3\n", "expected 2 rows, got 1"),
        ("", "expected 2 rows, got 0"),
        ("1\n1\n", "expected 3 cols, got 1"),
    ],
)
def test_one_message_per_fault(spark, tmp_path, text, message):
    rep = small(spark, tmp_path, text)
    assert not rep.ok
    assert message in rep.messages


@pytest.mark.parametrize(
    "text",
    [
        "1 2 3\n4 5 6\n",
        "# head\n1 2 3\n\n4 5 6\n",
        "1 2 3 # tail\n  4\t5   6  \n",
        "1.0 2e0 +3\n8 8 8\n",
        "1 2 3\r\n4 5 6\r\n",
        "7 7 7\n7  7 7\n",
    ],
)
def test_accepted_spellings(spark, tmp_path, text):
    rep = small(spark, tmp_path, text)
    assert rep.ok, rep.messages


def number(token):
    if re.fullmatch(r"(?i)[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)", token):
        return float(token)
    return None


def test_profiles_match_brute_force(spark):
    """Uniform lines take a shorter way; both ways must count alike."""
    words = ["1", "8", "99", "nan", "NaN", "inf", "1.5", "x", "-3", "+2", "1e0", ".5", "11", "1 "]
    lines = [f"{a} " * n + b for a in words for b in ("", a, words[0], "  8") for n in (1, 2, 5)]
    rows = line_profiles(spark.createDataFrame([(x,) for x in lines], "value string"))
    cells = [[number(t) for t in x.split()] for x in lines]
    total = rows.selectExpr(
        "sum(n_cols * n_lines) AS cols", "sum(n_nans * n_lines) AS nans", "sum(n_text * n_lines) AS text",
        "sum(n_lines) AS n", "sum(IF(fractional, n_lines, 0)) AS fractional",
    ).first()
    flat = [v for c in cells for v in c]
    assert total["n"] == len(lines)
    assert total["cols"] == len(flat)
    assert total["nans"] == sum(v is not None and math.isnan(v) for v in flat)
    assert total["text"] == sum(v is None for v in flat)
    odd = [any(v is not None and (not math.isfinite(v) or v != int(v)) for v in c) for c in cells]
    assert total["fractional"] == sum(odd)
    want = {}
    for c in cells:
        for v in {int(v) for v in c if v is not None and math.isfinite(v)}:
            want[v] = want.get(v, 0) + 1
    assert {r["label"]: r["n_lines"] for r in label_table(rows).collect()} == want


def test_all_stray_labels_are_reported(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).selectExpr("CONCAT(id + 100, ' 1 2') AS value").write.text(path)
    rep = validate(spark, path, expected_rows=1000, expected_cols=3)
    listed = ", ".join(str(i) for i in range(100, 1100))
    assert rep.messages == (f"labels outside allowed set: [{listed}]",)
    assert rep.unique_labels == (1, 2, *range(100, 1100))
    row = validation_report(line_profiles(spark.read.text(path)), 1000, 3).first()
    assert (row["n_stray"], row["messages"]) == (1000, ["1000 labels outside allowed set"])
    assert stray_labels(line_profiles(spark.read.text(path))).count() == 1000


def test_numbers_are_read_as_the_column_functions_do(spark):
    """Distinct tokens in bulk and odd ones alone, against one cast per token."""
    from framelake.functions.text import split_words, to_number, uncomment
    from framelake.sources.matrix import parse_matrix

    odd = ["+1", "1.", ".5", ".", "-", "+", "--1", "1e", "e5", "1e5", "1E+5", "1e999", "-1e999", "inf", "-INF", "Infinity", "+nan", "NaN", "-nan",
           "nano", "1d", "0x10", "1_0", "١", "1,5", "word", "1e5.5", "00012", "-0", "9" * 40, "4.9e-324"]
    lines = [" ".join(odd), "  3\t4 5 # 6", "#", "", " \x0b ", "7", "8\x0b9\x0c10", *[" ".join(str(k * 0.37) for k in range(j, j + 40)) for j in range(50)]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(lines)] + [(99, None)], "line int, value string").repartition(3)
    text = uncomment(F.col("value"))
    plain = rows.where(text != "").select("line", F.transform(split_words(text), to_number).alias("vals"))
    got, want = ({r["line"]: [str(v) for v in r["vals"]] for r in df.collect()} for df in (parse_matrix(rows), plain))
    assert got == want and len(got[0]) == len(odd) and set(got) == {0, 1, 5, 6, *range(7, 57)}
    assert parse_matrix(rows.limit(0)).count() == 0


def test_very_many_stray_labels_stay_in_a_table(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(2001).selectExpr("CONCAT(id * 7 + 100, ' 1 2') AS value").write.text(path)
    rep = validate(spark, path, expected_rows=2001, expected_cols=3)
    (message,) = rep.messages
    assert message.startswith("labels outside allowed set: [2001 labels, all of them in ") and len(message) < 300
    assert rep.unique_labels == (1, 2) and not rep.ok
    table = spark.read.parquet(message.partition("all of them in ")[2].rstrip("]"))
    assert table.count() == 2003 and table.agg({"label": "max"}).first()[0] == 2000 * 7 + 100


def test_writer_keeps_the_frame_order(spark, tmp_path):
    out = str(tmp_path / "sub")
    rows = spark.range(3000).selectExpr("(id * 7919) % 3000 AS frame_idx", "id AS k")
    preds = rows.selectExpr("frame_idx", "CAST(1 + frame_idx % 8 AS INT) AS y_pred")
    rep = write_submission(preds, out, n_cols=5000, expected_rows=3000, expected_cols=5000)
    assert rep.ok, rep.messages
    parts = sorted((tmp_path / "sub").glob("part-*"))
    assert len(parts) > 1
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert [int(x.split(" ", 1)[0]) for x in lines] == [1 + i % 8 for i in range(3000)]
    assert all(x.count(" ") == 4999 for x in lines)


def test_writer_refuses_a_repeated_frame(spark, tmp_path):
    preds = spark.createDataFrame([(0, 1), (1, 2), (1, 2)], "frame_idx long, y_pred int")
    with pytest.raises(ValueError, match="1 frames have several predictions, the first is 1"):
        write_submission(preds, str(tmp_path / "twice"), expected_rows=3)


def test_writer_refuses_bad_predictions(spark, tmp_path):
    out = str(tmp_path / "sub")
    base = spark.range(4)
    with pytest.raises(ValueError, match="one number per frame"):
        write_submission(base.selectExpr("id AS frame_idx", "array(1, 2) AS y_pred"), out)
    with pytest.raises(ValueError, match="non-integer"):
        write_submission(base.selectExpr("id AS frame_idx", "1.5D AS y_pred"), out)
    with pytest.raises(ValueError, match="empty"):
        write_submission(base.selectExpr("id AS frame_idx", "nullif(id, 2) AS y_pred"), out)


def test_unchecked_report_does_not_claim_ok(spark, tmp_path):
    preds = spark.range(3).selectExpr("id AS frame_idx", "2.0D AS y_pred")
    rep = write_submission(preds, str(tmp_path / "sub"), validate_after=False)
    assert (rep.ok, rep.checked, rep.n_rows) == (False, False, 3)
