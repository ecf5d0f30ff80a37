"""Presentation grids: merged headers, notes, filled row headers, columns by pattern, measures."""

import pytest

from tidemark.sources import files


def grid(spark, **sheets):
    cells = [(name, r, c, t) for name, rows in sheets.items() for r, row in enumerate(rows, 1) for c, t in enumerate(row, 1) if t is not None]
    return spark.createDataFrame(cells, "sheet string, row int, col int, text string")


RENTS = [
    ["Rents", None],
    ["", "", "Mar 2000", "", "", "Jun 2000"],
    ["", "", "Count", "Median", "Share", "Count", "Median"],
    ["Inner", "Carlton", "10", "100", "1", "11", "105"],
    ["", "Fitzroy", "-", "-", "2", "12", " 110 "],
    ["Source: a survey"],
    ["Outer", "Werribee", "20", "50", "", "", ""],
]


def test_measures_under_merged_headers(spark):
    data, held = files.wide_grid(grid(spark, flat=RENTS, house=RENTS), 2, 2, header_row=2, fill_down=(1,), measures={"Count": "lettings", "Median": "median"})
    got = [tuple(r) for r in data.orderBy("sheet", "row", "col").drop("col").collect()]
    assert got[:6] == [
        ("flat", 4, "Inner", "Carlton", "Mar 2000", "10", "100"), ("flat", 4, "Inner", "Carlton", "Jun 2000", "11", "105"), ("flat", 5, "Inner", "Fitzroy", "Mar 2000", "-", "-"),
        ("flat", 5, "Inner", "Fitzroy", "Jun 2000", "12", "110"), ("flat", 7, "Outer", "Werribee", "Mar 2000", "20", "50"), ("flat", 7, "Outer", "Werribee", "Jun 2000", "", ""),
    ]
    assert len(got) == 12 and got[6][0] == "house"
    assert sorted(map(tuple, held.collect())) == [("flat", "Share"), ("house", "Share")]
    with pytest.raises(ValueError, match=r"no columns headed \['Mean'\]"):
        files.wide_grid(grid(spark, flat=RENTS), 2, 2, header_row=2, measures={"Count": "n", "Mean": "m"})


def test_columns_by_pattern(spark):
    rows = [
        [None] * 25 + ["Change"],
        ["Locality", "2015", "", "2016", "", "Prelim", "", "24-25"],
        [None] * 5 + ["2026"],
        [],
        [],
        ["ABBOTSFORD", "925000", " ", "1187500", " ", "1555000", "^", "7"],
        ["YEA", "NA", " ", "305000", " ", "700000", "^", "22"],
    ]
    data, held = files.wide_grid(grid(spark, s=rows), 1, 1, header_row=2, column_match=r"^\d{4}$")
    assert [tuple(r) for r in data.orderBy("row", "col").select("name_1", "head_1", "cell").collect()] == [("ABBOTSFORD", "2015", "925000"), ("ABBOTSFORD", "2016", "1187500"), ("YEA", "2015", "NA"), ("YEA", "2016", "305000")]
    assert sorted(r.head for r in held.collect()) == ["24-25", "Prelim"]
    with pytest.raises(ValueError, match="no columns to read"):
        files.wide_grid(grid(spark, s=rows), 1, 1, header_row=2, column_match="nothing")


def test_three_levels_from_a_later_column(spark):
    rows = [["x", "", "All", "", "", ""], ["x", "", "Men", "", "Women", ""], ["x", "", "1990", "1991", "1990", "1991"], ["x", "A", "1", "", "3", "4"], ["x", "", "", "6", "", ""], ["x", "B", "", "", "", ""]]
    data, _ = files.wide_grid(grid(spark, s=rows), 3, 1, first_column=2)
    got = [tuple(r) for r in data.orderBy("row", "col").select("name_1", "head_1", "head_2", "head_3", "cell").collect()]
    assert got == [
        ("A", "All", "Men", "1990", "1"), ("A", "All", "Men", "1991", ""), ("A", "All", "Women", "1990", "3"), ("A", "All", "Women", "1991", "4"),
        ("", "All", "Men", "1990", ""), ("", "All", "Men", "1991", "6"), ("", "All", "Women", "1990", ""), ("", "All", "Women", "1991", ""),
    ]
