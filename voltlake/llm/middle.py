"""Fill-in-middle transformation: texts cut at line ends into prefix, middle and suffix, in two orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a line with its end, or what follows the last line end.
LINES = r"[^\n]*\n|[^\n]+"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Fixed value: any of the marks.
MARKS = "<P>|<S>|<M>"


def _cutter(pattern: str):
    """(text, h1, h2) -> number of units, and the code points before the cuts after h1 % (n + 1) and h2 % (n + 1) units, ascending."""

    @F.pandas_udf("n long, first long, second long")
    def cut(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
        rows = []
        for t, a, b in zip(text, h1, h2):
            ends = [0, *(end for _, (_, end) in split.pre_tokenize_str(t))] if t else [0]
            n = len(ends) - 1
            low, high = sorted((a % (n + 1), b % (n + 1)))
            rows.append((n, ends[low], ends[high]))
        return pd.DataFrame(rows, columns=["n", "first", "second"])

    return cut


def draws(key: Column, seed: int) -> list[Column]:
    """The first four groups of 8 hexadecimal digits of sha256('seed:key'), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, pattern: str = LINES) -> DataFrame:
    """Adds to docs (doc_id, text): n (units), form, prefix_chars and middle_chars (code points; null if plain) and output.

    The tokenizers library's Split finds the units and their code-point offsets; two draws from a hash of
    doc_id rank two of the offsets, which cut the text. rate: the percentage of texts that are transformed;
    suffix_first: the percentage of those whose suffix comes first (form spm; psm otherwise). Empty texts
    and texts that hold a mark are plain. The pattern must match every character of a text.

    Null text is an empty text. A null doc_id is drawn for as an empty one; rows that share a doc_id have the
    same draws. Own columns of these five names are replaced, others are kept. An empty table gives no rows.
    """
    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.coalesce(F.col("doc")["text"].cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc")["doc_id"].cast("string"), F.lit("")).alias("key"))
    h = draws(F.col("key"), seed)
    rows = rows.withColumn("cut", _cutter(pattern)("text", h[0], h[1]))
    plain = (F.col("text") == "") | F.col("text").rlike(MARKS) | (h[2] % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"))
    first, second = F.col("cut")["first"], F.col("cut")["second"]
    prefix, middle = F.substring(F.col("text"), F.lit(1), first), F.substring(F.col("text"), first + 1, second - first)
    suffix = F.substring(F.col("text"), second + 1, F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.select(
        *[F.col("doc")[c].alias(c) for c in docs.columns if c not in own],
        F.col("cut")["n"].alias("n"),
        "form",
        F.when(cut, first).alias("prefix_chars"),
        F.when(cut, second - first).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from its output and form alone."""
    parts = F.split(output, MARKS, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
