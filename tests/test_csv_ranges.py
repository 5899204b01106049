import csv
import random

import pytest

from corpus_spark.sources import comments, csv_ranges
from corpus_spark.sources import tables as S


def write(path, rows, header=("id", "a", "b"), end="\n", mark=""):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(mark)
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def ranges(spark):
    """Sets the size of ranges; the usual size is put back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (f"{size}b", "1b"))]
    for n in names:
        spark.conf.unset(n)


def plain(spark, path):
    return values(spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(path))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [173, 211, 10**8])
def test_equal_to_the_plain_reader(spark, tmp_path, ranges, size, end):
    rng = random.Random(size)
    said = ["a", "b,c", 'q"q"', "line\nbreak", '"', "", "x\r\ny", '""', "tail\n", "\n\n\n", ',"', 'say "hi",\n\n"ok"', "é\n" * 20, "long " * 60 + "\n" + "long, " * 60]
    rows = [(k, rng.choice(said), rng.choice(said)) for k in range(40)]
    path = write(tmp_path / "x.csv", rows, end=end)
    want = plain(spark, path)
    assert len(want) == 40
    ranges(size)
    got, names = csv_ranges.read(spark, path)
    assert values(got.orderBy("row_index").select("row_index", *(f"fields.{c}" for c in names), "malformed")) == [(k, *r, False) for k, r in enumerate(want)]
    assert size > 10**6 or csv_ranges._lines(spark, path).rdd.getNumPartitions() >= 8


def test_every_border(spark, tmp_path, ranges):
    """Ranges are so small that a border stands before each line, also before those within quotes."""
    path = write(tmp_path / "y.csv", [(k, 'one\n"two"\n\nthree', "x") for k in range(4)])
    want = plain(spark, path)
    ranges(9)
    maps = csv_ranges._maps(csv_ranges._lines(spark, path)).collect()
    assert len(maps) >= 10 and any((r["from_out"], r["from_in"]) != (0, 1) for r in maps)
    got, names = csv_ranges.read(spark, path)
    ranges(10**8)
    assert sorted(values(got.select(*(f"fields.{c}" for c in names)))) == sorted(want)


def test_quotes_within_plain_fields(spark, tmp_path, ranges):
    text = 'id,a,b\n1,5" pipe,x\n2,"a\nb",y\n\n3,in 6" and 7",z\n4,one\n5,"c"d,w\n'
    (tmp_path / "z.csv").write_text(text)
    ranges(13)
    got = {r["row_index"]: (tuple(r["fields"])[:3], r["malformed"]) for r in csv_ranges.read(spark, str(tmp_path / "z.csv"))[0].collect()}
    ranges(10**8)
    assert [got[k][0][:2] for k in range(3)] == [("1", '5" pipe'), ("2", "a\nb"), ("3", 'in 6" and 7"')]
    assert [k for k in sorted(got) if got[k][1]] == [3]


def test_readers(spark, tmp_path, ranges):
    header = ("group", "datetime", "comment", "author")
    (tmp_path / "many").mkdir()
    for name in ("telegram_1", "telegram_2"):
        write(tmp_path / "many" / f"{name}.csv", [("g", str(k), f"{name}\nsays, {k}" * 9, "u") for k in range(9)], header, mark="﻿" if name[-1] == "2" else "")
    ranges(120)
    got = comments.read_plain(spark, str(tmp_path / "many"))
    lined = S.with_lineage(spark, str(tmp_path / "many" / "telegram_1.csv"))
    rows, lineage = values(got), values(lined.select("row_index", "datetime", "source_file"))
    ranges(10**8)
    assert sorted(rows) == sorted((str(k), "u", "g", f"{n}\nsays, {k}" * 9) for n in ("telegram_1", "telegram_2") for k in range(9))
    assert sorted(lineage) == [(k, str(k), "telegram_1.csv") for k in range(9)]
    with pytest.raises(ValueError):
        comments.read_plain(spark, write(tmp_path / "bad.csv", []))
