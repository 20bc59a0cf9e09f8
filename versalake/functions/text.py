"""Analysers: how a text becomes search tokens. The same analyser serves an index and its queries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters and digits, and CJK signs one by one.
MIXED = r"[一-鿿㐀-䶿]|[\p{L}\p{N}&&[^一-鿿㐀-䶿]]+"
#: Words of ASCII letters.
ASCII = r"[a-z]+"
#: Words of letters, single CJK signs and four marks, as simple analysers take them.
PLAIN = r"[a-zA-Z]+|[一-龥]|[，。？！]"
BLANK = ("", " ", "  ", "\n", "\t")


@dataclass(frozen=True)
class Analyser:
    """pattern: a Java regular expression of tokens; stop: words that neither index nor query keep."""

    pattern: str = MIXED
    case_sensitive: bool = False
    stop: tuple[str, ...] = ()

    def tokens(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        text = text if self.case_sensitive else F.lower(text)
        found = F.regexp_extract_all(text, F.lit(self.pattern), 0)
        return F.array_except(found, F.array(*(F.lit(w) for w in (*BLANK, *self.stop))))

    def query(self, spark, text: str) -> list[str]:
        """The distinct tokens of a query, by the same rules as the column's."""
        row = spark.range(1).select(self.tokens(F.lit(text)).alias("t")).first()
        return list(dict.fromkeys(row.t))


def stop_words(*paths: str, extra: Iterable[str] = ()) -> tuple[str, ...]:
    """Stop words of files, one a line."""
    words = list(extra)
    for path in paths:
        with open(path, encoding="utf-8") as file:
            words += [line.strip() for line in file if line.strip()]
    return tuple(dict.fromkeys(words))
