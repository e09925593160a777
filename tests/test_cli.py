from skyledger import cli
from tests.test_sources import expected, plain, sample


def test_commands(spark, tmp_path, capsys):
    codes, data = sample(1, 3, 6)
    (tmp_path / "a.24o").write_text(plain(3, codes, data))
    assert cli.main(["scan", str(tmp_path)]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[0] == "filename,epochs,maxobs,maxsats,sysobs,satobs,totobs,maxepochs"
    want = [x for x in expected(data, codes).values() if x[0]]
    assert lines[1].split(",")[1] == "6" and lines[1].split(",")[6] == str(len(want))
    for command in ("maxima", "counts", "analyze"):
        assert cli.main([command, "-v", str(tmp_path)]) == 0
    assert "l0,l1,l2,l3,l4,l5" in capsys.readouterr().out
