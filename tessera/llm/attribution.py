"""Token counts of fields and sections, by character offsets (operator 6).

A document is encoded once, as a whole, and the character spans of its tokens are
joined to the spans of its sections, which tile the text in order. A token that
crosses a border is allocated by a rule:

* start: to the section that holds its first character,
* most: to the section that holds most of its characters, the first of several,
* share: to each section by its share of the token's characters.

Under every rule the counts of a document add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.sstable import tokenizer_path
from tessera.llm.tokens import encoder

RULES = ("start", "most", "share")


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section: section k spans borders[k] to borders[k + 1]; crossing counts the tokens that begin in it and end beyond it. Token spans ascend."""
    n = len(borders) - 1
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, np.maximum(ends - 1, starts), side="right") - 1
    first, last = np.clip(first, 0, n - 1), np.clip(last, 0, n - 1)
    crosses = first != last
    crossing = np.bincount(first[crosses], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    tokens = np.bincount(first[~crosses], minlength=n).astype(float)
    for k in np.flatnonzero(crosses):
        held = np.minimum(borders[first[k] + 1 : last[k] + 2], ends[k]) - np.maximum(borders[first[k] : last[k] + 1], starts[k])
        if rule == "most":
            tokens[first[k] + int(held.argmax())] += 1
        else:
            tokens[first[k] : last[k] + 1] += held / held.sum()
    return tokens, crossing


def counts_sql(text: Column, lengths: Column, tokenizer: str, rule: str = "start") -> Column:
    """struct(tokens array<double>, crossing array<int>) of the sections of a text, whose lengths in characters add up to the text's."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    @pandas_udf("struct<tokens: array<double>, crossing: array<int>>")
    def count(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for texts, sizes in parts:
            found = [allocate(*coder.spans(t), np.concatenate([[0], np.cumsum(s, dtype=np.int64)]), rule) for t, s in zip(texts, sizes, strict=True)]
            yield pd.DataFrame({"tokens": [a for a, _ in found], "crossing": [b.astype(np.int32) for _, b in found]})

    return count(text, lengths)


def section_tokens(docs: DataFrame, *, fields: list[str] | None = None, between: str = "\n", tokenizer: str | None = None, rule: str = "start") -> DataFrame:
    """Per row of docs and section: doc_id, section (from 0; with fields the field's name), n_chars, n_tokens, n_crossing.

    Without fields the sections of text are its parts up to and with each `between`, a text without
    any being one. With fields the document is their texts with `between` after each but the last,
    which counts to the field before it. Null texts and fields are empty; an empty text has one
    section with no tokens, and an empty field none of its own. Repeated rows are counted each.
    """
    if fields:
        parts = F.array(*(F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(between if k < len(fields) - 1 else "")) for k, f in enumerate(fields)))
    else:
        pieces = F.split(F.coalesce("text", F.lit("")), f"(?<={_quoted(between)})")
        # a text that ends on a separator has no section after it
        parts = F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    cut = docs.select("doc_id", parts.alias("parts")).select("doc_id", F.array_join("parts", "").alias("whole"), F.transform("parts", F.length).alias("chars"))
    counted = cut.withColumn("found", counts_sql(F.col("whole"), F.col("chars"), tokenizer or tokenizer_path(), rule))
    # every text has a section; for posexplode the optimizer would add a filter on the array and so count twice
    rows = counted.select("doc_id", F.posexplode_outer(F.arrays_zip(F.col("chars"), F.col("found.tokens").alias("tokens"), F.col("found.crossing").alias("crossing"))).alias("section", "x"))
    section = F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1) if fields else F.col("section")
    return rows.select("doc_id", section.alias("section"), F.col("x.chars").cast("long").alias("n_chars"), F.col("x.tokens").alias("n_tokens"), F.col("x.crossing").cast("long").alias("n_crossing"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def op6_attribution(docs: DataFrame) -> DataFrame:
    """Tokens of every line of every text: doc_id, section, n_chars, n_tokens, n_crossing, a token counting to the line of its first character."""
    return section_tokens(docs)
