"""String columns shared by the operators. All JVM-side expressions.

Patterns start with ``(?U)`` so that ``\\s``/``\\w``/``\\b`` are Unicode aware and with ``d`` where
``.``/``$`` must treat only ``\\n`` as a line end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times (also inside other lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLANK_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, BLANK_EDGES, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def normalize_name(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def name_similarity(left: Column, right: Column) -> Column:
    """1 for equal names, length ratio for containment, else shared tokens / larger token set."""
    return normalized_similarity(normalize_name(left), normalize_name(right))


def normalized_similarity(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b)).cast("double")
    longer = F.greatest(F.length(a), F.length(b)).cast("double")
    ta = F.array_distinct(F.split(a, " "))
    tb = F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(ta, tb)).cast("double")
    return (
        F.when(a == b, F.lit(1.0))
        .when(F.contains(a, b) | F.contains(b, a), shorter / longer)
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(shared / F.greatest(F.size(ta), F.size(tb)).cast("double"))
    )


def token_count(c: Column) -> Column:
    """White-space separated words, at least 1."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    return F.greatest(F.lit(1), F.size(words))


def query_tokens(c: Column, min_length: int = 3) -> Column:
    parts = F.split(F.lower(c), r"(?U)\W+")
    return F.filter(parts, lambda x: F.length(x) >= min_length)


def extension(c: Column) -> Column:
    """Lower-cased text after the last dot, '' when there is no dot."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit(".")), F.substring_index(low, ".", -1)).otherwise("")


def first_positions(keys: Column) -> Column:
    """Zero-based places of the first occurrence of each key, ascending. Sorting keeps it n log n."""

    def firsts(ordered: Column) -> Column:
        return F.filter(
            ordered, lambda x, i: (i == 0) | ~x["key"].eqNullSafe(F.get(ordered, i - 1)["key"])
        )

    pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
    return F.array_sort(F.transform(bind(pairs, firsts), lambda x: x["at"]))


def running_totals(numbers: Column) -> Column:
    """Inclusive prefix sums of an int array.

    Arrays are immutable, so one fold would copy its result at every step. Blocks of about the square
    root of the length are folded on their own and shifted by the totals before them.
    """

    def fold(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))

        def step(acc: Column, x: Column) -> Column:
            total = (acc["total"] + x).cast("int")
            return F.struct(total.alias("total"), F.array_append(acc["sums"], total).alias("sums"))

        return F.aggregate(values, start, step, lambda acc: acc["sums"])

    def of(all_numbers: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_numbers))).cast("int"))
        count = F.ceil(F.size(all_numbers) / width).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
                             lambda b: fold(F.slice(all_numbers, b * width + 1, width)))
        return bind(blocks, joined)

    def joined(sums: Column) -> Column:
        ends = fold(F.transform(sums, lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))))
        return bind(ends, lambda e: F.flatten(F.transform(
            sums, lambda s, b: bind(F.when(b == 0, F.lit(0)).otherwise(F.get(e, b - 1)),
                                    lambda base: F.transform(s, lambda x: x + base)))))

    return bind(numbers, of)


def dedupe_names(names: Column) -> Column:
    """Case/space-insensitive ordered distinct; the first spelling wins, blanks are dropped."""

    def first_spellings(kept: Column) -> Column:
        return F.transform(
            first_positions(F.transform(kept, normalize_name)), lambda i: F.get(kept, i)
        )

    kept = F.filter(F.transform(names, strip), lambda x: x != "")
    return F.coalesce(bind(kept, first_spellings), F.array().cast("array<string>"))


def find_spans(text: Column, pattern: str) -> Column:
    """All matches as array<struct<match, start, end>> with half-open code-point offsets.

    Gaps between matches come from ``split``, so offsets are running sums of gap and match lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)

    def spans(found: Column) -> Column:
        lengths = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, match: F.length(gap) + F.length(match)
        )
        return F.zip_with(found, running_totals(lengths), lambda match, end: F.struct(
            match.alias("match"), (end - F.length(match)).cast("int").alias("start"), end.alias("end")))

    none = F.array().cast("array<struct<match:string,start:int,end:int>>")
    return bind(matches, lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))
