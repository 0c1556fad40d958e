"""Headers of very many sheets, damaged ones among them, are read from the first block of each."""

import pytest

from dipstick.sources import readers


def book_of(tmp_path, sheets):
    book = tmp_path / "book.xlsx"
    book.mkdir()
    for name, content in sheets.items():
        (book / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(book)


def test_five_thousand_sheets_one_damaged(spark, tmp_path):
    sheets = {f"{i:04d}.csv": f"Date,Total_Sold\n2024-01-{i % 28 + 1:02d},{i}\n" for i in range(5000)}
    sheets["0777.csv"] = b"PK\x03\x04\x00\x00\xff\xfe broken"
    book = book_of(tmp_path, sheets)
    assert len(readers.header_lines(spark, book)) == 4999
    assert [r.sheet for r in readers.damaged_sheets(spark, book).collect()] == ["0777.csv"]
    rows = readers.scan_sheets(spark, book)
    assert rows.count() == 4999 and rows.select("_sheet").distinct().count() == 4999


def test_only_the_first_block_is_read(spark, tmp_path, monkeypatch):
    """What comes after the header's block is not looked at: a NUL far below does not show."""
    body = "2024-01-01,1\n" * 20_000
    book = book_of(tmp_path, {"a.csv": "Date,Total_Sold\n" + body + "\0\0\n", "b.csv": "﻿\n \nDate,Total_Sold\n2024-01-02,2\n"})
    assert readers.header_lines(spark, book) == {"a.csv": "Date,Total_Sold", "b.csv": "Date,Total_Sold"}
    monkeypatch.setattr(readers, "HEAD_BLOCK", 3)  # a header of many blocks
    assert readers.header_lines(spark, book)["a.csv"] == "Date,Total_Sold"


def test_empty_and_latin_sheets(spark, tmp_path):
    book = book_of(tmp_path, {"a.csv": "", "b.csv": " \n\n", "c.csv": b"Date,T\xe9l\n1,2\n", "d.csv": "Date,x"})
    assert readers.header_lines(spark, book) == {"d.csv": "Date,x"}
    assert [r.sheet for r in readers.damaged_sheets(spark, book).collect()] == ["c.csv"]
    with pytest.raises(ValueError):
        readers.scan_sheets(spark, book_of(tmp_path / "other", {}) if (tmp_path / "other").mkdir() else book, ["a.csv"])


@pytest.mark.parametrize("line", ["Date,Total_Sold", "a,,b", "a,A,a", '"x, y",z', " Date ,b", "é,ü", "only"])
def test_names_are_those_of_a_scan(spark, tmp_path, line):
    path = tmp_path / "x.csv"
    path.write_text(line + "\n")
    assert list(readers.header_names(line)) == spark.read.option("header", True).csv(str(path)).columns


def test_escaped_names_are_read_by_the_scan(spark, tmp_path):
    book = book_of(tmp_path, {"a.csv": '"a ""b""",c\n1,2\n', "b.csv": 'Date,c\n3,4\n'})
    scanned = readers.scan_sheets(spark, book)
    assert "c" in scanned.columns and scanned.where("c in ('2', '4')").count() == 2
