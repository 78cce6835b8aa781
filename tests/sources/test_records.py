import csv
import io
import random

import pandas as pd
import pytest

from panelwright.sources import readers, records


@pytest.fixture
def tiny_chunks(spark):
    """Files are dealt out in chunks of a few bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path):
    lay = records.layout(spark, str(path), within=5)
    df = records.read_records(spark, str(path), lay)
    return sorted(tuple(r) for r in df.collect())


def expected(text):
    """As the usual reader of CSV files has it: a text of no characters for an empty cell."""
    frame = pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False, na_values=[])
    return sorted(tuple(r) for r in frame.itertuples(index=False))


def cell(r):
    return "".join(r.choice(["a", "bc", " ", ",", '"', "\n", "\r\n", "1.5", "é", "x" * 40]) for _ in range(r.randint(1, 5)))


@pytest.mark.parametrize("seed", range(3))
def test_random_cells_over_chunks(spark, tmp_path, tiny_chunks, seed):
    r = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
    writer.writerows([["k", "f", "b"], *([str(i), cell(r), cell(r)] for i in range(30))])
    path = tmp_path / "t.csv"
    path.write_bytes(out.getvalue().encode())
    want = expected(out.getvalue())
    for size in (13, 200, 1 << 20):
        tiny_chunks(size)
        assert read(spark, path) == want
    tiny_chunks(50)
    assert records._lines(spark, str(path)).rdd.getNumPartitions() > 10


FIXED = [
    'a,b\n1,"two\nlines"\n2,plain\n',
    'a,b\n1,"say ""yes"", now\n\n"\n2,""\n',
    'a,b\n5" pipe,x\n6",7"\n"8",9\n',  # quotes that open nothing
    'a,b\n"1"2,"3""4"5\n6,7\n',  # text behind a closing quote
    'a,b\n\n1,2\n\n\n3,4',  # blank lines, no line break at the end
    'a,b\r\n1,"x\r\ny"\r\n2,z\r\n',
    'a,b,\n1,2,\n',
    'a,a\n"\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n",1\n',  # one cell over many chunks
    "a,b\n1,2\r3,4\n",
]


@pytest.mark.parametrize("text", FIXED)
def test_fixed_files(spark, tmp_path, tiny_chunks, text):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    for size in (4, 1 << 20):
        tiny_chunks(size)
        assert read(spark, path) == expected(text)


def test_states_compose(spark, tmp_path, tiny_chunks):
    """Chunks that turn, keep and set the state, against a walk over the whole file."""
    text = 'a,b\n' + 'x,"1\n2\n3",y"\n"p\nq"\n' * 30
    path = tmp_path / "t.csv"
    path.write_text(text)
    tiny_chunks(11)
    inside, at, truth = False, 0, {}
    for line in text.split("\n")[:-1]:
        truth[at] = inside
        inside = records.ends_inside(line, inside)
        at += len(line) + 1
    for r in records.chunk_states(records._lines(spark, str(path)), 1).collect():
        first = min(a for a in truth if a >= r.start + (r.start > 0))
        if r.start:
            assert r.inside == truth[first], r


def test_several_files_and_names(spark, tmp_path, tiny_chunks):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'x,x,,"n\nm"\n{i},"a\n{i}",,\n{i},b,,"NA"\n')
    tiny_chunks(12)
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == ["x", "x.1", "Unnamed: 2", "n\nm"]
    assert sorted((r[0], r[1], r[3]) for r in df.collect()) == sorted([(str(i), f"a\n{i}", None) for i in range(3)] + [(str(i), "b", None) for i in range(3)])


def test_preamble_goes_by_place(spark, tmp_path, tiny_chunks):
    """A data line that equals a line of the preamble stays; a quote in the preamble opens nothing."""
    head = 'Country Name,Country Code,Indicator Name,Indicator Code,2010\n'
    (tmp_path / "t.csv").write_text('Data "Source,x,y,z,1\n\nUpdated\n\n' + head + 'Data "Source,x,y,z,1\n"No\nwhere",N,i,"c\n",2\n')
    for size in (100, 1 << 20):
        tiny_chunks(size)
        got = sorted(tuple(r) for r in readers.read_preamble_csv(spark, str(tmp_path / "t.csv")).collect())
        assert got == [('Data "Source', "x", "y", "z", "1"), ("No\nwhere", "N", "i", "c\n", "2")]


def test_errors(spark, tmp_path):
    bad = {"open.csv": 'a,b\n1,"2\n3,4\n', "long.csv": "a,b\n1,2,3\n", "none.csv": ""}
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    with pytest.raises(ValueError, match="inside a quoted cell"):
        readers.read_csv(spark, str(tmp_path / "open.csv"))
    with pytest.raises(Exception, match="3 cells"):
        readers.read_csv(spark, str(tmp_path / "long.csv")).collect()
    with pytest.raises(ValueError, match="no header"):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
