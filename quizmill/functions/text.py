"""Column helpers for text: spacing, tiers, tri-state labels, tags, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill import constants as C

# a-z, tested first, and no way back: the same words in less time
WORD = r"[a-z\p{L}\p{N}_]++"
MEMORY_WORD = r"[a-z\p{L}\p{N}_]{3,}+"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def phrase_pattern(phrases: list[str]) -> str:
    return r"(?iU)\b(" + "|".join(phrases) + r")\b"


def array_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def codes(*pairs: tuple[Column, Column | str]) -> Column:
    """Ordered array of the codes whose condition holds; an unknown condition does not."""
    return F.array_compact(
        F.array(*[
            F.when(F.coalesce(cond, F.lit(False)), F.lit(code) if isinstance(code, str) else code)
            for cond, code in pairs
        ])
    )


def blank(col: Column) -> Column:
    """Null, empty or white space only. Most texts show it by their first character."""
    return F.coalesce(~(F.substring(col, 1, 1).rlike(r"(?U)\S") | col.rlike(r"(?U)\S")), F.lit(True))


def _edged(col: Column, pattern: str) -> Column:
    """True if the first or the last character is one of ``pattern``."""
    return F.substring(col, 1, 1).rlike(pattern) | F.substring(col, -1, 1).rlike(pattern)


def strip(col: Column) -> Column:
    # a run is tried from its beginning only, so that long runs inside a text cost no more than their length
    return F.when(_edged(col, r"(?U)\s"), F.regexp_replace(col, r"(?U)^\s+|(?<!\s)\s++$", "")).otherwise(col)


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def canonical_query(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))


def document_tier(tier: Column, source_tier: Column) -> Column:
    name = F.lower(first_text(tier, source_tier))
    out = F.when(name == "", F.lit(C.LEGACY_TIER))
    for label, aliases in C.TIER_ALIASES.items():
        out = out.when(name.isin(aliases), F.lit(label))
    return out.otherwise(F.concat(F.lit("Unapproved tier ("), name, F.lit(")")))


def tristate(col: Column) -> Column:
    text = F.lower(strip(col.cast("string")))
    # A number counts as true when it is not zero.
    return F.when(text.isin(C.PASS_VALUES), True).when(text.isin(C.FAIL_VALUES), False)


def tristate_number(col: Column) -> Column:
    return F.when(col.isNotNull(), col != 0)


def word_count(col: Column) -> Column:
    return F.when(col.isNotNull(), F.size(F.regexp_extract_all(col, F.lit(WORD), F.lit(0))))


def memory_words(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(MEMORY_WORD), F.lit(0)))


def contains_han(*cols: Column) -> Column:
    return reduce(
        lambda a, b: a | b, [F.coalesce(c.rlike(HAN), F.lit(False)) for c in cols]
    )


def contains_any(col: Column, markers: list[str]) -> Column:
    """True if any marker is part of any text of an array column."""
    return F.exists(
        col, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in markers])
    )


def answer_tag(col: Column) -> Column:
    pattern = "(?is)" + C.ANSWER_TAG
    return F.when(
        col.rlike(pattern), strip(F.regexp_extract(col, pattern, 1))
    ).otherwise(F.lit(C.ANSWER_PARSE_ERROR))


def _unfenced(col: Column) -> Column:
    """A reply without white space and code fences around it; untouched where its ends show none."""
    bare = strip(col)
    for fence in (r"^```json", r"^```", r"```$"):
        bare = F.regexp_replace(bare, fence, "")
    return F.when(_edged(col, r"(?U)[\s`]"), bare).otherwise(col)


def _from_brace(col: Column) -> Column:
    """A reply from its first brace on; null without one."""
    at = F.locate("{", col)
    return F.when(at > 0, F.substr(col, at))


def with_json_object(df: DataFrame, reply: str, name: str) -> DataFrame:
    """Add the first JSON object of a reply as a variant, null if there is none.

    Each step is a column of its own, so that a reply is parsed once.
    """
    at = f"_{name}"
    df = df.withColumn(at, _unfenced(F.col(reply)))
    df = df.withColumn(at, _from_brace(F.col(at)))
    df = df.withColumn(at, F.try_parse_json(at))
    return df.withColumn(
        name, F.when(F.schema_of_variant(at).startswith("OBJECT"), F.col(at))
    ).drop(at)


def flatten_json(col: Column) -> Column:
    """All text values of a JSON text at any depth, in order, joined by single blanks."""
    tokens = F.regexp_extract_all(col, F.lit(r'"(?:[^"\\]|\\.)*+"\s*:?'), F.lit(0))
    values = F.filter(tokens, lambda t: ~t.endswith(":"))

    def plain(token: Column) -> Column:
        return F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))

    return F.array_join(F.filter(F.transform(values, plain), lambda x: x != ""), " ")
