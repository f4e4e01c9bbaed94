"""The tools from files to models to scores."""

from lexspark import cli, tools
from lexspark.plans import fixtures as X

CORPUS = "\n".join(["the_DT cat_NN sleeps_NR ._PU", "a_DT dog_NN barks_NN at_DT 7_CD birds_NR ._PU", "7_CD birds_NN flew_NN ._PU"] * 3)


def test_tagger_from_corpus_to_accuracy(spark, tmp_path, capsys):
    (tmp_path / "corpus.txt").write_text(CORPUS)
    assert tools.main(["postagger-train", f"{tmp_path}/corpus.txt", f"{tmp_path}/m"], spark) == 0
    tools.main(["postagger-test", f"{tmp_path}/corpus.txt", f"{tmp_path}/m"], spark)
    words, total, _, correct, _, accuracy = capsys.readouterr().out.split()
    assert (words, total) == ("words", "45") and int(correct) >= 42 and abs(float(accuracy) - int(correct) / 45) < 1e-6


def test_parser_from_treebank_to_scores(spark, tmp_path, capsys):
    (tmp_path / "bank.txt").write_text(X.TREEBANK)
    tools.main(["depparser-train", f"{tmp_path}/bank.txt", f"{tmp_path}/m", "--iterations", "15"], spark)
    for method in ("beam", "greedy"):
        tools.main(["depparser-test", f"{tmp_path}/bank.txt", f"{tmp_path}/m", "--method", method], spark)
        _, total, _, uas, _, las = capsys.readouterr().out.split()
        assert int(total) == 21 and float(uas) >= float(las) > 0.8


def test_converted_models_are_those_of_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "one.txt").write_text("小猫 5\n海风 3\n帆 2\n")
    (tmp_path / "two.txt").write_text("小猫 海风 2\n海风 帆 1\n")
    tools.main(["gram", f"{tmp_path}/one.txt", f"{tmp_path}/two.txt", f"{tmp_path}/m"], spark)
    (tmp_path / "crf.txt").write_text(X.CRF_TEXT)
    (tmp_path / "templates.txt").write_text("u:%x[0,0]\nb\n")
    tools.main(["wapiti-conv", f"{tmp_path}/crf.txt", f"{tmp_path}/templates.txt", f"{tmp_path}/m", "--name", "segment"], spark)
    (tmp_path / "dict.txt").write_text("阿 1\n号 2\n")
    tools.main(["dict", f"{tmp_path}/dict.txt", f"{tmp_path}/m", "--name", "oov_properties"], spark)
    (tmp_path / "perc.txt").write_text(X.PERCEPTRON_TEXT)
    tools.main(["perc", f"{tmp_path}/perc.txt", f"{tmp_path}/m"], spark)
    assert spark.read.parquet(f"{tmp_path}/m/parser").count() == 3
    (tmp_path / "in.txt").write_text("小猫海风帆\n")
    for method in ("bigram_seg", "mixed_seg", "crf_seg"):
        assert cli.main(["-m", method, "-d", f"{tmp_path}/m", f"{tmp_path}/in.txt"], spark) == 0
    assert capsys.readouterr().out.split("\n")[0].split() == ["小猫", "海风", "帆"]
