import pytest
from pyspark.errors import AnalysisException

from panelwright.plans import pipelines
from panelwright.sources import readers, sinks
from panelwright.sources.readers import SourceSpec

FIRST = "Country,Year,Status,Health index ,Polio\n" + "".join(f" Norland ,{y},Developing,{61 + i}.0,{v}\n" for i, (y, v) in enumerate([(2010, 101), (2011, "NA"), (2012, 50), (2013, 60), (2014, 70)])) + "B,bad,x,50,1\n"
SECOND = "Country Name,Year,Health Index Two,Region,IncomeGroup,GDP,Unemployment\n" + "".join(f"Norland,{y},{65 + i}.0,Europe,High,{g},..\n" for i, (y, g) in enumerate([(2010, 100), (2011, "NaN"), (2012, 300), (2015, 1)]))
WIDE = 'Country Name,Country Code,Indicator Name,Indicator Code,2010,2011,\n"Norland, Rep.",NOR,"Some, thing",X.1,1.5,,\nB,BBB,Other,Y.1,..,4,\n'


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_csv_and_missing_path(spark, tmp_path):
    df = readers.read_csv(spark, write(tmp_path, "first.csv", FIRST))
    assert df.filter("Polio IS NULL").count() == 1 and set(dict(df.dtypes).values()) == {"string"}
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        readers.load_source(spark, SourceSpec("x", "excel"))


@pytest.mark.parametrize("preamble", ["", '"Data Source","World Development Indicators"\n\n"Last Updated Date","2025"\n\n'])
def test_preamble(spark, tmp_path, preamble):
    df = readers.load_source(spark, SourceSpec(write(tmp_path, "wide.csv", preamble + WIDE), "preamble-csv"))
    assert df.columns == ["Country Name", "Country Code", "Indicator Name", "Indicator Code", "2010", "2011", "Unnamed: 6"]
    got = sorted(tuple(r)[:6] for r in df.collect())
    assert got == [("B", "BBB", "Other", "Y.1", "..", "4"), ("Norland, Rep.", "NOR", "Some, thing", "X.1", "1.5", None)]
    with pytest.raises(ValueError):
        readers.read_preamble_csv(spark, write(tmp_path, "other.csv", FIRST))


def test_from_files_to_the_panel(spark, tmp_path):
    specs = {
        "outcome": SourceSpec(write(tmp_path, "first.csv", FIRST), "csv", "Country", "Year", {"health_index": "health_a"}),
        "covariates": SourceSpec(write(tmp_path, "second.csv", SECOND), "csv", "Country Name", "Year", {"incomegroup": "income_group", "health_index_two": "health_b"}),
        "wide": SourceSpec(write(tmp_path, "wide.csv", WIDE), "preamble-csv"),
    }
    o = pipelines.PanelOptions(targets=("health_a", "health_b"), outcome={"min_targets": 1, "bounds": (0.0, 100.0)}, covariates={"cols": ["health_b", "region", "gdp", "unemployment"]}, impute={"interpolated": ["gdp"]})
    panel, summaries = pipelines.preprocess(spark, specs, o)
    got = panel.orderBy("year").collect()
    assert [(r.country, r.year, r.outcome, r.gdp) for r in got] == [("Norland", 2010, 63.0, 100.0), ("Norland", 2011, 64.0, 200.0), ("Norland", 2012, 65.0, 300.0)]
    assert {r.source: r.rows for r in summaries["sources"].collect()} == {"outcome": 6, "covariates": 4, "wide": 2}
    assert summaries["keys"].first().common_keys == 3 and summaries["outcome"].first().output_rows == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    sinks.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).columns == ["x", "y"]
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "t"), "xlsx")
    sinks.write_summary(spark, {"rows": 3, "first": {"input_rows": 2}}, str(tmp_path / "s.json"))
    assert spark.read.json(str(tmp_path / "s.json")).first()["first"].input_rows == 2
    log = str(tmp_path / "runs")
    sinks.append_run(df, log)
    sinks.append_run(df.withColumn("z", df.x * 2.0), log)
    assert sorted(r.z or 0 for r in sinks.read_runs(spark, log).collect()) == [0, 2.0]
    built = []
    for _ in range(2):
        out = sinks.load_or_build(spark, str(tmp_path / "panel"), lambda: built.append(1) or df)
        assert out.count() == 1
    assert built == [1]
