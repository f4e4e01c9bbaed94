"""Command line: ``python -m lexspark.cli [-m method] [-d models] [-u user dictionary] [-t] [-i] input [output]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .options import METHODS, Options
from .pipeline import Pipeline
from .sources import formats


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexspark", description="Analyse text files line by line.")
    p.add_argument("input", nargs="?", help="file or folder; standard input if absent")
    p.add_argument("output", nargs="?", help="folder; standard output if absent")
    p.add_argument("-i", action="store_true", help="read standard input")
    p.add_argument("-m", choices=METHODS, default="mixed", help="method")
    p.add_argument("-d", required=True, help="folder of the models")
    p.add_argument("-u", help="user dictionary")
    p.add_argument("-t", action="store_true", help="show word types")
    a = p.parse_args(argv)
    if bool(a.input) == a.i:
        p.error("give either an input or -i")
    spark = spark or SparkSession.builder.getOrCreate()
    segmenter, tagger, parser = METHODS[a.m]
    lines = spark.createDataFrame([(n, x.rstrip("\r\n")) for n, x in enumerate(sys.stdin)], "line_no int, value string").withColumn("path", F.lit("-")) if a.i else formats.read_lines(spark, a.input)
    done = Pipeline(Options(segmenter, tagger, parser, model_path=a.d, user_dictionary=a.u)).lines(lines, ("path", "line_no"), "value", a.t)
    if a.output:
        formats.write_lines(done.repartitionByRange("path", "line_no").sortWithinPartitions("path", "line_no"), a.output, "line")
    else:
        for row in done.orderBy("path", "line_no").toLocalIterator():
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
