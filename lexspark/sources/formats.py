"""Text formats: readers of corpora, dictionaries and models, and sinks of results.  Models are kept as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``path, line_no, value`` of text files; ``encoding`` may be GBK.

    Line numbers need whole files: one file is one task, whatever its size.  For large corpora whose order doesn't
    matter use :func:`read_text`.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = T.from_gbk(F.col("content")) if encoding.upper() in ("GBK", "CP936") else F.decode("content", "UTF-8")
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return files.select("path", F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "value"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines of text files, split freely over tasks."""
    return spark.read.text(path)


def tagged_corpus(lines: DataFrame, keys: tuple = ("line_no",), value: str = "value") -> DataFrame:
    """``keys, idx, word, tag`` of lines ``word_TAG word_TAG``: cut at the last underscore; items without one are left out.

    ``idx`` counts from 0 what is kept, however long the line is.
    """
    items = F.filter(F.split(T.trim(F.col(value)), " +"), lambda x: x.contains("_"))
    rows = lines.select(*keys, F.posexplode(items).alias("idx", "item"))
    return rows.select(*keys, "idx", F.regexp_extract("item", r"(?s)^(.*)_([^_]*)$", 1).alias("word"), F.regexp_extract("item", r"(?s)^(.*)_([^_]*)$", 2).alias("tag"))


def treebank(files: DataFrame, keys: tuple = ("path",), content: str = "content") -> DataFrame:
    """``keys, sent, idx, word, tag, head, label`` of files of lines ``word tag head label``, sentences cut by blank lines.

    ``idx`` counts from 1.  A line of fewer fields or a head that is no number stops the query.
    """
    blocks = F.filter(F.split(F.regexp_replace(F.col(content), r"\r", ""), r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: T.trim(b) != "")
    sents = files.select(*keys, F.posexplode(blocks).alias("sent", "block"))
    rows = sents.select(*keys, "sent", F.posexplode(F.split(F.regexp_replace(T.trim(F.col("block")), r"[ \t]*\n[ \t]*", "\n"), r"\n")).alias("i", "line"))
    f = F.split("line", r"[ \t]+")
    head = F.when(F.size(f) >= 4, f[2].try_cast("int"))
    checked = F.when(head.isNull(), F.raise_error(F.concat(F.lit("bad treebank line: "), F.col("line"))).cast("int")).otherwise(head)
    return rows.select(*keys, "sent", (F.col("i") + 1).alias("idx"), f[0].alias("word"), f[1].alias("tag"), checked.alias("head"), f[3].alias("label"))


def tree_rows(rows: DataFrame, keys: tuple = ("sent",)) -> DataFrame:
    """``keys, words, tags, heads, labels``: a row for each sentence of :func:`treebank`."""
    s = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "word", "tag", "head", "label"))).alias("s"))
    return s.select(*keys, F.col("s.word").alias("words"), F.col("s.tag").alias("tags"), F.col("s.head").alias("heads"), F.col("s.label").alias("labels"))


def _fields(lines: DataFrame, value: str, n: int, what: str) -> tuple[DataFrame, list[Column]]:
    kept = lines.filter(T.trim(F.col(value)) != "").withColumn("__f", F.split(T.trim(F.col(value)), r"[ \t]+"))
    bad = F.raise_error(F.concat(F.lit(f"bad {what} line: "), F.col(value)))
    return kept, [F.when(F.size("__f") < n, bad.cast("string")).otherwise(F.get(F.col("__f"), F.lit(i))) for i in range(n)]


def _number(c: Column, kind: str, what: str) -> Column:
    got = c.try_cast(kind)
    return F.when(got.isNull(), F.raise_error(F.concat(F.lit(f"bad {what}: "), c)).cast(kind)).otherwise(got)


def unigram_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """``word, count`` of lines ``word count``."""
    rows, f = _fields(lines, value, 2, "count")
    return rows.select(f[0].alias("word"), _number(f[1], "double", "count").alias("count"))


def bigram_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """``left, right, count`` of lines ``left right count``."""
    rows, f = _fields(lines, value, 3, "count")
    return rows.select(f[0].alias("left"), f[1].alias("right"), _number(f[2], "bigint", "count").alias("count"))


def dictionary(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """``key, value`` of lines ``key number``; with ``order``, the last of a key's lines counts."""
    rows, f = _fields(lines, value, 2, "dictionary")
    out = rows.select(*([F.col(order).alias("__at")] if order else []), f[0].alias("key"), _number(f[1], "int", "value").alias("value"))
    return out.groupBy("key").agg(F.max_by("value", "__at").alias("value")) if order else out


def perceptron_text(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """``feature, label, weight`` of lines ``label feature weight``; of several the last counts."""
    rows, f = _fields(lines, value, 3, "perceptron")
    out = rows.select(F.col(order).alias("__at"), f[0].alias("label"), f[1].alias("feature"), _number(f[2], "double", "weight").alias("weight"))
    return out.groupBy("feature", "label").agg(F.max_by("weight", "__at").alias("weight"))


def crf_text(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """``feature, left, right, weight`` of lines of four columns; a feature begins with u or b, else the query stops.

    ``left`` is null for u features.  Of several lines the last counts.
    """
    rows, f = _fields(lines, value, 4, "model")
    kind = F.left(f[0], F.lit(1))
    checked = F.when(kind.isin("u", "b"), f[0]).otherwise(F.raise_error(F.concat(F.lit("feature begins with neither u nor b: "), f[0])).cast("string"))
    out = rows.select(F.col(order).alias("__at"), checked.alias("feature"), F.when(kind == "b", f[1]).alias("left"), f[2].alias("right"), _number(f[3], "double", "weight").alias("weight"))
    return out.groupBy("feature", "left", "right").agg(F.max_by("weight", "__at").alias("weight"))


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables of a model, each as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def spoken(words: Column) -> Column:
    """Words that sinks show: those that don't begin with CR, LF or a blank."""
    return F.filter(words, lambda w: ~w["word"].rlike("^[\r\n ]"))


def slash_line(words: Column, types: bool = False) -> Column:
    """``word[_TYPE][/TAG]`` and two blanks, for each word of an array of ``word, word_type[, tag]``."""
    def one(w: Column) -> Column:
        parts = [w["word"]] + ([F.lit("_"), T.type_code(w["word_type"])] if types else [])
        return F.concat(*parts, F.when(w["tag"].isNotNull(), F.concat(F.lit("/"), w["tag"])).otherwise(F.lit("")), F.lit("  "))

    return F.array_join(F.transform(spoken(words), one), "")


def conll_block(words: Column) -> Column:
    """Lines ``idx, word, tag, head, label``, parted by tabs, of an array of structs; white space words are left out.

    ``idx`` is the word's place in the sentence, so that heads refer to it.
    """
    return F.array_join(F.transform(spoken(words), lambda w: F.concat_ws("\t", w["idx"].cast("string"), w["word"], w["tag"], w["head"].cast("string"), w["label"])), "\n")


def write_lines(df: DataFrame, path: str, value: str, encoding: str = "UTF-8") -> None:
    """One text column as text files, in UTF-8 or GBK, which leaves out what it lacks."""
    if encoding.upper() in ("GBK", "CP936"):
        # the text sink knows only UTF-8; a CSV of one column, whose separator and quote never occur, is plain lines
        one = df.select(F.explode(F.split(T.from_gbk(T.to_gbk(F.col(value))), "\n")).alias(value))
        one.write.option("encoding", "GBK").mode("overwrite").csv(path, quote="\u0000", sep="\u0001", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        df.select(F.col(value)).write.mode("overwrite").text(path)
