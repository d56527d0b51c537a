"""The technical analyzer: tokens by white space, each kept whole and split into its words and numbers, in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a token: a capitalised or lower-case run, a run of letters without case, a run of digits.
PARTS = r"\p{Lu}+\p{Ll}*|\p{Ll}+|[\p{Lo}\p{Lm}\p{Lt}]+|\p{Nd}+"


def tokens(text: Column) -> Column:
    """ARRAY<STRING> with repeats between tokens; within one, a part equal to the whole comes once. Null gives an empty array."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    split = F.transform(words, lambda t: F.array_distinct(F.transform(F.array_union(F.array(t), F.regexp_extract_all(t, F.lit(PARTS), F.lit(0))), F.lower)))
    return F.flatten(split)


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, by the same rules, on the driver."""
    import regex

    out: list[str] = []
    for t in query.split():
        out += [t.lower(), *(p.lower() for p in regex.findall(PARTS, t))]
    return list(dict.fromkeys(out))
