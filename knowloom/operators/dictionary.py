"""Mentions of dictionary names of any number: token runs of texts meet the names by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.layout import once
from knowloom.functions.skew import hot_join, is_small, small_side
from knowloom.functions.text import bind, find_spans

WORD = r"(?U)\w+"
NAME_BOUND = 500_000


def _names(dictionary: DataFrame) -> DataFrame:
    """Distinct names with their words: name (lower-cased, cut to its first and last word character), first, n, key."""
    low = F.regexp_replace(F.lower("name"), r"(?U)^\W+|\W+$", "")
    rows = dictionary.select(low.alias("name")).filter("name <> ''").distinct()
    words = F.regexp_extract_all("name", F.lit(WORD), F.lit(0))
    rows = once(rows, words=words)
    return rows.select("name", F.get("words", F.lit(0)).alias("first"), F.size("words").alias("n"), F.xxhash64("words").alias("key"))


def dictionary_mentions(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """version_id, name, spelled, start, end: every place where a name of ``dictionary(name)`` stands in ``documents(version_id, text)``.

    Case is ignored; a name must stand between non-word characters and match to the letter, separators included.
    Only places whose word begins some name form runs, of the lengths that names with this word have; a run's hash
    joins the names and its spelling, put together from its words and the gaps between them, confirms it. Neither the
    names nor the texts are ever gathered, and texts do not meet the places again. A dictionary of a checked size is broadcast.
    """
    names = _names(dictionary)
    few = is_small(names, NAME_BOUND)
    starts = names.groupBy("first").agg(F.sort_array(F.collect_set("n")).alias("lengths"))  # as many as words in the longest name
    texts = documents.select("version_id", "text").filter("text is not null")
    tokens = once(texts, spans=find_spans(F.col("text"), WORD), gaps=F.split("text", WORD))
    words = F.transform("spans", lambda s: F.lower(s["match"]))
    # The gap before each word, then the word.
    pieces = F.flatten(F.zip_with(F.slice("gaps", F.lit(1), F.size("spans")), "spans", lambda gap, s: F.array(gap, s["match"])))
    placed = once(tokens.select("version_id", "spans", "gaps"), words=words, pieces=pieces).drop("gaps")
    longest = names.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def runs(i: Column) -> Column:
        """For every number of words up to the longest name: hash, end and spelling of the run that begins at ``i``."""
        one = [F.struct(
            F.lit(n).alias("n"), F.xxhash64(F.slice("words", i + 1, n)).alias("key"), F.get("spans", i + (n - 1))["end"].cast("int").alias("end"),
            F.array_join(F.slice("pieces", 2 * i + 2, 2 * n - 1), "").alias("spelled")) for n in range(1, longest + 1)]
        return F.array(*one) if one else F.array().cast("array<struct<n:int,key:bigint,end:int,spelled:string>>")

    at = F.transform("spans", lambda s, i: F.struct(F.get("words", i).alias("first"), s["start"].cast("int").alias("start"), runs(i).alias("runs")))
    places = placed.select("version_id", F.explode(at).alias("p")).select("version_id", "p.*")
    begun = places.join(small_side(starts, few), "first")
    wanted = F.filter("runs", lambda r: F.array_contains("lengths", r["n"]) & r["end"].isNotNull())
    keyed = begun.select("version_id", "start", F.explode(wanted).alias("r")).select("version_id", "start", "r.*")
    by_key = names.select("key", "n", "name")
    met = keyed.join(F.broadcast(by_key), ["key", "n"]) if few else hot_join(keyed, by_key, ["key", "n"])
    return met.filter(F.lower("spelled") == F.col("name")).select("version_id", "name", "spelled", "start", "end")


def _apart(spans: Column) -> Column:
    """From left to right, of mentions that overlap the first, and of those that begin together the longest."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("_"), s.alias("s"))))
    none = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<start:int,end:int,name:string,spelled:string>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["last"]
        return F.when(free, F.struct(x["s"]["end"].alias("last"), F.array_append(acc["kept"], x["s"]).alias("kept"))).otherwise(acc)

    return bind(F.aggregate(ordered, none, step), lambda acc: acc["kept"])


def dictionary_entities(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """First mention of each dictionary name per document, in text order: version_id, name (as spelled), term, start, end, i.

    Of overlapping names the leftmost, then the longest counts; the same as one regular expression of all names,
    longest first, but for dictionaries of any size. The mentions of one document are gathered in its row.
    """
    span = F.struct("start", "end", "name", "spelled")
    rows = dictionary_mentions(documents, dictionary).groupBy("version_id").agg(F.collect_list(span).alias("m"))
    firsts = once(rows, kept=_apart(F.col("m"))).select("version_id", F.explode("kept").alias("s")).groupBy("version_id", F.col("s.name").alias("term")).agg(F.min("s").alias("s"))
    lists = firsts.groupBy("version_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("version_id", F.posexplode("s").alias("i", "s")).select(
        "version_id", F.col("s.spelled").alias("name"), F.col("s.name").alias("term"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "i")
