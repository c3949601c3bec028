"""The text functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import sentences, source, tokens
from .words import tokens_of


class Tokenize:
    """One row for each token of a text."""

    def eval(self, text: str):
        for t in sorted(tokens_of(text or "")):
            yield (t,)


def register(spark: SparkSession) -> None:
    """``stem(word)``, ``important_sentences(text, name, package)``, ``parse_header(path, body)`` and the table function ``tokenize(text)``."""
    spark.udf.register("stem", tokens.stem)
    spark.udf.register("important_sentences", sentences.important_sentences)
    spark.udf.register("parse_header", source.parse_header)
    spark.udtf.register("tokenize", udtf(Tokenize, returnType="token: string"))
