from relspark import cli
from relspark.lang.lexer import keywords


def test_parse_and_keywords(tmp_path, capsys):
    f = tmp_path / "p.txt"
    f.write_text("x = scan(${name}); store(x, y);")
    assert cli.main(["parse", str(f), "--key", "name", "--value", "region"]) == 0
    assert "public:adhoc:region" in capsys.readouterr().out
    assert cli.main(["keywords"]) == 0
    assert "emit" in keywords()["reserved"] and "stdev" in keywords()["functions"]


def test_run_explain_datalog(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(str(tmp_path / "t.parquet"))
    f = tmp_path / "p.txt"
    f.write_text("x = scan(t); y = [from x where k > 1 emit v]; store(y, out);")
    assert cli.main(["run", str(f), "--catalog", str(tmp_path)]) == 0
    assert "|  b|" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "public__adhoc__out")).count() == 1
    assert cli.main(["explain", str(f), "--catalog", str(tmp_path), "--name", "y"]) == 0
    assert "Physical Plan" in capsys.readouterr().out
    f.write_text("A(v) :- t(k, v), k < 2.")
    assert cli.main(["datalog", str(f), "--catalog", str(tmp_path)]) == 0
    assert "|  a|" in capsys.readouterr().out
