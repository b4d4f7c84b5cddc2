"""The command line, in the session of the tests."""

import json

from hinoki.__main__ import main
from hinoki.functions import tables as T


def test_check_reports(spark, tmp_path, capsys):
    path = tmp_path / "m.txt"
    path.write_text("本サービスはご利用されます。", encoding="utf-8")
    assert main(["check", str(path)]) == 0
    out = capsys.readouterr().out
    assert "norm_divergence" in out and "p.36" in out and "-> ご利用になります (sonkeigo)" in out and dict(T.DISCLAIMER)["en"] in out
    assert main(["check", str(path), "--language", "ja", "--audience", "社内"]) == 0
    out = capsys.readouterr().out
    assert "「ご＋名詞＋される」の形" in out and not any(p in out for lang, p in T.FORBIDDEN if lang == "ja")
    assert main(["check", str(path), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["reportable_count"] == 1


def test_explain_demo_and_unknown(spark, capsys):
    assert main(["explain", "uchi_sonkeigo", "--language", "ja"]) == 0
    out = capsys.readouterr().out
    assert "動作をする人を立てる" in out
    assert main(["explain", "nothing like it"]) == 2
    assert main(["forms", "走る"]) == 2
    assert main(["demo"]) == 0
    out = capsys.readouterr().out
    assert out.count("norm_divergence") >= 3 and "申しました" in out
