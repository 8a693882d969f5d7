"""Rows with the awkward cases: nulls, empty and long texts, ties, repeats, and extra columns whose names clash."""

import os
import random

from downfield.llm.shared import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, hits string, text_ string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" if r.random() < 0.2 else f"W{r.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, texts, start=0):
    rows = [(None if t == "no id" else i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", -1, 7, "x", "y") for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


AWKWARD = [None, "", " ", "\n\n", "one", "a b c d", "\x00\x0b tab\tline\r\nend", "é" * 50, "no id", "same text twice here", "same text twice here", "x" * 5000, " ".join(words(20000, 5, 50)), "\U0001f600 emoji \U0001f600", "1 2 3 4 5 6 7 8 9 10 11 12"]


def written(spark):
    """Names of the tables that lie in the shared folder by now."""
    path = shared_dir(spark).removeprefix("file://")
    return os.listdir(path) if os.path.isdir(path) else []
