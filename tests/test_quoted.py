"""CSV with breaks in quoted fields against the whole-file read."""

import random

import pytest
from pyspark.sql import functions as F

from tabprofile.sources import quoted
from tabprofile.sources.loading import load_dataset


def plain(spark, path, **options):
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=True, **options)


def text(seed, rows, end="\n"):
    rng = random.Random(seed)

    def field():
        raw = "".join(rng.choices(["a", "é", ",", '"', end, " ", "b,c", "\n"], k=rng.randint(0, 12)))
        if rng.random() < 0.1:
            return 'in "the" middle'
        return '"' + raw.replace('"', '""') + '"' if any(c in raw for c in ',"\r\n') or rng.random() < 0.3 else raw

    lines = [f'"n{end}ame",text,"x"']
    lines += [f"{i},{field()},{field()}" for i in range(rows)]
    return end.join(lines) + rng.choice(["", end])


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [64, 700, 1 << 20])
def test_equals_the_whole_file_read(spark, tmp_path, end, block):
    path = tmp_path / "q.csv"
    content = text(3, 120, end)
    content += f'{end}900,"{("long " + end) * 200}","over many ranges"{end}901,,{end}'
    path.write_bytes(content.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        tasks = spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions()
        got = load_dataset(spark, str(path))
        want = plain(spark, str(path))
        assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)
        assert tasks > 1 or block > 1000
        written = [r[0] for r in got.select(F.input_file_name()).distinct().collect()]
        assert len(written) > 1 or block > 1000  # several tasks read and wrote
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_folder_of_files_and_windows_text(spark, tmp_path):
    folder = tmp_path / "d.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f'k;v\n{i};"two\nlines"\n\n{i + 10};plain\n', newline="")
    assert rows_of(load_dataset(spark, str(folder))) == rows_of(plain(spark, str(folder), sep=";"))
    (tmp_path / "w.csv").write_bytes('k,v\n1,"café\n€"\n2,x\n'.encode("cp1252"))
    assert sorted(map(tuple, load_dataset(spark, str(tmp_path / "w.csv")).collect())) == [(1, "café\n€"), (2, "x")]


def test_files_that_need_the_whole_read(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'k,v\n1,"a\rb\nc"\n2,x\n')
    assert rows_of(load_dataset(spark, str(tmp_path / "r.csv"))) == rows_of(plain(spark, str(tmp_path / "r.csv")))
    (tmp_path / "s.csv").write_bytes(b'k,v\n1,"' + "".join(quoted.SPARE).encode() + b'\nc"\n2,x\n')
    assert rows_of(load_dataset(spark, str(tmp_path / "s.csv"))) == rows_of(plain(spark, str(tmp_path / "s.csv")))


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", False, True), (b'"a,b', True, False), (b'a"b,c', False, False), (b'"a""b",c', False, False), (b'x,"', True, False), (b'"",""', False, True), (b'","', False, True),
    (b'"a"b,"c', True, True), (b"", False, True), (b'"a" "', False, False)])
def test_states(line, outside, inside):
    assert (quoted.opens(line, b",", False), quoted.opens(line, b",", True)) == (outside, inside)
