import random

import pytest

from helpers import SURVEY
from respondex.sources.survey import SOURCE_ORDER, read_survey, read_survey_split, write_survey

HEADER = "perm,r1,r2,r3,r4\n"


def quoted(value):
    if value is None:
        return ""
    if any(c in value for c in '",\r\n') or value != value.strip():
        return '"' + value.replace('"', '""') + '"'
    return value


def write(path, rows, end="\n"):
    lines = [",".join(quoted(v) for v in row) + end for row in rows]
    path.write_bytes((HEADER.replace("\n", end) + "".join(lines)).encode())


def awkward(n, seed=1):
    rng = random.Random(seed)
    parts = ["word", 'say "hi"', "a,b", "line\nbreak", "\n\n", '"', "é", " "]
    rows = []
    for i in range(n):
        answers = []
        for _ in range(4):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
            answers.append(text.strip() or None)
        rows.append((str(i), *answers))
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_quotes_commas_and_line_breaks(spark, tmp_path, reader):
    rows = awkward(300)
    write(tmp_path / "s.csv", rows)
    assert rows_of(reader(spark, str(tmp_path))) == rows


@pytest.mark.parametrize("size", ["60b", "300b", "5000b"])
def test_split_reader_joins_records_over_block_borders(spark, tmp_path, set_conf, size):
    set_conf("spark.sql.files.maxPartitionBytes", size)
    set_conf("spark.sql.files.openCostInBytes", "0")
    rows = awkward(120, seed=7)
    write(tmp_path / "a.csv", rows[:70])
    write(tmp_path / "b.csv", rows[70:])
    found = read_survey_split(spark, str(tmp_path))
    assert rows_of(found) == rows


def test_split_reader_drops_line_feeds_of_other_systems(spark, tmp_path):
    rows = [("1", "a", "b", None, "d"), ("2", None, "x y", "z", None)]
    write(tmp_path / "s.csv", rows, end="\r\n")
    assert rows_of(read_survey_split(spark, str(tmp_path))) == rows


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_only_empty_is_null_and_types_are_asked_for(spark, tmp_path, reader):
    (tmp_path / "s.csv").write_text('perm,r1,r2,r3,r4,first_gen\n007,NA,null,"",,1\n')
    row = reader(spark, str(tmp_path), types={"first_gen": "int"}).first()
    assert tuple(row) == ("007", "NA", "null", None, None, 1)


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_source_order(spark, tmp_path, set_conf, reader):
    set_conf("spark.sql.files.maxPartitionBytes", "200b")
    set_conf("spark.sql.files.openCostInBytes", "0")
    rows = awkward(60)
    write(tmp_path / "s.csv", rows)
    found = reader(spark, str(tmp_path), source_order=True).orderBy(SOURCE_ORDER)
    assert [r["perm"] for r in found.collect()] == [r[0] for r in rows]


def test_written_surveys_come_back(spark, tmp_path):
    rows = awkward(50)
    write_survey(spark.createDataFrame(rows, SURVEY), f"{tmp_path}/out")
    assert rows_of(read_survey(spark, f"{tmp_path}/out")) == rows
    assert rows_of(read_survey_split(spark, f"{tmp_path}/out")) == rows


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_odd_column_names(spark, tmp_path, reader):
    (tmp_path / "s.csv").write_text('perm,"first gen, coll","a`b"\n1,yes,no\n')
    found = reader(spark, str(tmp_path))
    assert found.columns == ["perm", "first gen, coll", "a`b"]
    assert tuple(found.first()) == ("1", "yes", "no")


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_columns_go_by_name_over_files(spark, tmp_path, reader):
    (tmp_path / "a.csv").write_text("perm,r1,r2\n1,x,y\n")
    (tmp_path / "b.csv").write_text("r2,perm,more,r1\nyy,2,m,xx\n")
    found = reader(spark, str(tmp_path))
    assert {r["perm"]: (r["r1"], r["r2"], r["more"]) for r in found.collect()} == {
        "1": ("x", "y", None),
        "2": ("xx", "yy", "m"),
    }
    assert reader(spark, str(tmp_path), columns=["r2", "perm"]).columns == ["r2", "perm"]


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
@pytest.mark.parametrize("line", ["1,a,b,c,d,e", "1,a,b"])
def test_records_of_another_length_fail(spark, tmp_path, reader, line):
    (tmp_path / "s.csv").write_text(f"{HEADER}0,a,b,c,d\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|CSV"):
        reader(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("text", ['6" tall', '6" tall and 2" wide', 'x "y" z'])
def test_stray_quotes_lose_nothing_in_silence(spark, tmp_path, text):
    rows = f"{HEADER}1,{text},a2,a3,a4\n2,b1,b2,b3,b4\n3,{text},c2,c3,c4\n"
    (tmp_path / "s.csv").write_text(rows)
    assert read_survey(spark, str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="quote|MALFORMED|malformed|CSV"):
        read_survey_split(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_headers_of_many_files_take_one_job(spark, tmp_path, reader):
    for i in range(12):
        write(tmp_path / f"{i}.csv", [(str(i), "a", None, None, "d")])
    tracker = spark.sparkContext.statusTracker()
    group = f"headers of {reader.__name__}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = reader(spark, str(tmp_path))
        assert len(tracker.getJobIdsForGroup(group)) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows_of(found) == [(str(i), "a", None, None, "d") for i in range(12)]


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_odd_headers(spark, tmp_path, reader):
    (tmp_path / "a.csv").write_text('perm,"a ""b""\nc, d",r1,R1,\n1,x,y,z,w\n')
    (tmp_path / "b.csv").write_text("\n\nperm,r1\n2,only\n")
    names = list(spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "a.csv")).columns)
    found = reader(spark, str(tmp_path / "a.csv"))
    assert found.columns == names
    assert [tuple(r) for r in found.collect()] == [("1", "x", "y", "z", "w")]
    if reader is read_survey:
        assert [tuple(r) for r in reader(spark, str(tmp_path / "b.csv")).collect()] == [("2", "only")]


@pytest.mark.parametrize("reader", [read_survey, read_survey_split])
def test_paths_with_blanks_and_percents(spark, tmp_path, reader):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    write(folder / "s 1.csv", [("1", "a", None, None, "d")])
    assert rows_of(reader(spark, str(folder))) == [("1", "a", None, None, "d")]
