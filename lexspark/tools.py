"""Tools: ``python -m lexspark.tools command ...`` trains, converts and tests models; they are folders of Parquet tables.

dict, gram, perc and wapiti-conv convert text files, postagger-train and depparser-train learn from corpora, and
postagger-test and depparser-test print scores.  Models of several commands may lie in one folder, which is what the
command line and :class:`lexspark.pipeline.Models` read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lexicon, parse, tag
from .operators.perceptron import Perceptron
from .options import Options
from .pipeline import Models
from .sources import formats


def _templates(spark: SparkSession, path: str) -> DataFrame:
    return formats.read_lines(spark, path).filter(F.trim("value") != "").select("line_no", F.col("value").alias("template"))


def _trees(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    rows = formats.tree_rows(formats.treebank(files), ("path", "sent"))
    return rows.select(F.format_string("%s#%012d", "path", "sent").alias("sent"), "words", "tags", "heads", "labels")


def dictionary(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lines of a word and a number."""
    formats.save_model({a.name: formats.dictionary(formats.read_lines(spark, a.input), order="line_no")}, a.output)


def gram(spark: SparkSession, a: argparse.Namespace) -> None:
    """Costs from counts of words and of pairs of words."""
    one = lexicon.unigram_model(formats.unigram_counts(formats.read_text(spark, a.unigram)))
    formats.save_model({"unigram": one, "bigram": lexicon.bigram_model(formats.bigram_counts(formats.read_text(spark, a.bigram)), one)}, a.output)


def perc(spark: SparkSession, a: argparse.Namespace) -> None:
    """A perceptron from its text."""
    formats.save_model({a.name: formats.perceptron_text(formats.read_lines(spark, a.input))}, a.output)


def wapiti_conv(spark: SparkSession, a: argparse.Namespace) -> None:
    """A CRF from its text and its templates."""
    formats.save_model({f"{a.name}_crf": formats.crf_text(formats.read_lines(spark, a.input)), f"{a.name}_templates": _templates(spark, a.templates)}, a.output)


def postagger_train(spark: SparkSession, a: argparse.Namespace) -> None:
    """A Markov model from lines of ``word_TAG``."""
    corpus = formats.tagged_corpus(formats.read_lines(spark, a.corpus), ("path", "line_no"))
    formats.save_model({"hmm_emission": tag.emissions(corpus.select("word", "tag")), "hmm_transition": tag.transitions(corpus, ("path", "line_no"))}, a.output)


def postagger_test(spark: SparkSession, a: argparse.Namespace) -> None:
    """Accuracy on lines of ``word_TAG``."""
    models = Models.load(spark, Options("crf", a.method, model_path=a.models), ("segment_crf", "segment_templates"))
    corpus = formats.tagged_corpus(formats.read_lines(spark, a.corpus), ("path", "line_no"))
    row = tag.evaluate(corpus, a.method, models.hmm, models.tag_crf, ("path", "line_no")).first()
    print(f"words {row.total} correct {row.correct} accuracy {row.accuracy}")


def depparser_train(spark: SparkSession, a: argparse.Namespace) -> None:
    """A parser from a treebank; ``--shards`` learns on several workers and takes the mean."""
    templates = _templates(spark, a.templates) if a.templates else spark.createDataFrame(list(enumerate(parse.TEMPLATES)), "line_no int, template string")
    lines = [r.template for r in templates.orderBy("line_no").collect()]
    rows = parse.train(_trees(spark, a.treebank), lines, a.beam, a.iterations, a.shards)
    formats.save_model({"parser": spark.createDataFrame(rows, "feature string, label string, weight double"), "parser_templates": templates}, a.output)


def depparser_test(spark: SparkSession, a: argparse.Namespace) -> None:
    """Attachment scores on a treebank, by its own tags."""
    t = formats.load_model(spark, a.models, "parser", "parser_templates")
    lines = [r.template for r in t["parser_templates"].orderBy("line_no").collect()]
    row = parse.evaluate(_trees(spark, a.treebank), a.method, Perceptron.load(t["parser"]), lines).first()
    print(f"words {row.total} uas {row.uas} las {row.las}")


#: Command, function, its arguments, and options with their defaults.
COMMANDS = (
    ("dict", dictionary, ("input", "output"), {"name": "dictionary"}), ("gram", gram, ("unigram", "bigram", "output"), {}), ("perc", perc, ("input", "output"), {"name": "parser"}),
    ("wapiti-conv", wapiti_conv, ("input", "templates", "output"), {"name": "tag"}), ("postagger-train", postagger_train, ("corpus", "output"), {}), ("postagger-test", postagger_test, ("corpus", "models"), {"method": "hmm"}),
    ("depparser-train", depparser_train, ("treebank", "output"), {"templates": "", "beam": parse.BEAM, "iterations": 10, "shards": 1}), ("depparser-test", depparser_test, ("treebank", "models"), {"method": "beam"}),
)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexspark.tools", description="Train, convert and test models.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run, arguments, options in COMMANDS:
        one = sub.add_parser(name, help=run.__doc__, description=run.__doc__)
        for argument in arguments:
            one.add_argument(argument)
        for option, value in options.items():
            one.add_argument(f"--{option}", default=value, type=type(value))
        one.set_defaults(run=run)
    a = p.parse_args(argv)
    a.run(spark or SparkSession.builder.getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
