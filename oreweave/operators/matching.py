"""Substring join of texts against a dictionary of any size.

``norm in text`` is not an equi-join, and comparing every text with every name would be a
cross join. Every name is given one anchor among the short pieces it is made of. A text can only
contain the name if it contains the anchor, so an equi-join on the anchor yields all candidates
and one ``contains`` check makes them exact. Which anchor is chosen affects the work, never the
result.

Where no group of names (those of one run, say) has more than a few, each text simply tries the
names of its group. Of a larger dictionary of bounded size, names of one word can only lie within
one word of a text: the names in the frequent words are looked up, once for all texts, and texts
are joined with them by their words; other words, and texts for names of several words, are cut
into pieces and joined with broadcast anchors, an anchor being the piece that the fewest names
share. All of it happens in the row that holds the text, without a shuffle. Which words
count as frequent is taken from a sample: it decides by which of the two ways a word goes. Beyond
that bound pieces are shuffled without their texts, and the anchor is the piece that the fewest
texts of a sample contain.

Pieces have five characters; names of three or four are their own pieces.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave.session import stored

BROADCAST_BYTES = 16 << 20  # of names whose anchors are broadcast
GROUP_NAMES = 32  # names that a text tries one by one
SEPARATORS = " \t\n\r!\"#$%&()*,.:;<=>?@[\\]^`{|}~"  # between the words of a text
FREQUENT_WORDS, FREQUENT_CHARS = 300_000, 40  # looked up beforehand, of at most so many characters
SAMPLE_TEXTS, SAMPLE_CHARS = 100_000, 2_000  # in whose heads words are counted
SHORTEST, LONGEST = 3, 5
ANCHOR_CHOICES = 12


def grams(text: Column, length: int) -> Column:
    """Distinct overlapping pieces of a fixed length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * length}))"), F.lit(1)))


def _candidates(
    low: DataFrame,
    names: DataFrame,
    on: Sequence[str],
    text_id: Sequence[str],
    name_id: Sequence[str],
    length: int,
    statistics_fraction: float,
) -> DataFrame:
    """(text_id, name_id, _name) pairs whose text contains the anchor of the name."""

    def pieces(df: DataFrame) -> DataFrame:
        return df.select(*dict.fromkeys([*on, *text_id]), F.explode(grams(F.col("_low"), length)).alias("_gram"))

    # any subset of a name's pieces will do for its anchor, so long names do not inflate the table
    choices = names.select(
        *on, *name_id, "_name", F.explode(F.slice(grams(F.col("_name"), length), 1, ANCHOR_CHOICES)).alias("_gram")
    )
    sample = low if statistics_fraction >= 1.0 else low.sample(statistics_fraction, seed=7)
    wanted = choices.select(*on, "_gram").distinct()
    frequency = pieces(sample).join(wanted, [*on, "_gram"], "left_semi").groupBy(*on, "_gram").agg(
        F.count("*").alias("_df")
    )
    rarest = Window.partitionBy(*on, *name_id).orderBy("_df", "_gram")
    anchors = (
        choices.join(frequency, [*on, "_gram"], "left")
        .withColumn("_df", F.coalesce("_df", F.lit(0)))
        .withColumn("_pick", F.row_number().over(rarest))
        .where(F.col("_pick") == 1)
        .select(*on, *name_id, "_name", "_gram")
    )
    return pieces(low).join(anchors, [*on, "_gram"]).select(*text_id, *name_id, "_name")


def _pieces(text: Column, lengths: Sequence[int]) -> Column:
    """Distinct pieces of several lengths."""
    return F.concat(*[grams(text, n) for n in lengths])


def _one_by_one(low: DataFrame, names: DataFrame, on: Sequence[str], name_id: Sequence[str]) -> DataFrame:
    """Texts with the names of their group that they contain; groups are small and broadcast."""
    key = list(on) or ["_all"]
    listed = names.withColumn("_all", F.lit(0)).groupBy(*key).agg(F.collect_list(F.struct(*name_id, "_name")).alias("_names"))
    met = low.withColumn("_all", F.lit(0)).join(F.broadcast(listed), key)  # all names together were measured
    hits = met.withColumn("_hit", F.explode(F.filter("_names", lambda n: F.contains(F.col("_low"), n["_name"]))))
    return hits.select(*low.columns, *[F.col("_hit")[c].alias(c) for c in name_id if c not in low.columns], F.col("_hit")["_name"].alias("_name"))


def _anchors(names: DataFrame, on: Sequence[str], name_id: Sequence[str], lengths: Sequence[int]) -> DataFrame:
    """Names with the piece (``_gram``) that the fewest names share."""
    own = F.least(F.length("_name"), F.lit(max(lengths)))
    choices = names.select(*on, *name_id, "_name", F.explode(_own_pieces(own, lengths)).alias("_gram"))
    shared = choices.withColumn("_df", F.count("*").over(Window.partitionBy(*on, "_gram")))
    rarest = Window.partitionBy(*on, *name_id, "_name").orderBy("_df", "_gram")
    return shared.withColumn("_pick", F.row_number().over(rarest)).where("_pick = 1").drop("_pick", "_df")


def _in_the_row(
    low: DataFrame, names: DataFrame, on: Sequence[str], name_id: Sequence[str], lengths: Sequence[int], text: str = "_low"
) -> DataFrame:
    """Texts with the names they contain, found in one pass over the texts.

    Lambdas are kept out of the scan: Spark runs the generators and joins as one loop then, and
    the text is not copied for each of its pieces."""
    anchors = _anchors(names, on, name_id, lengths)
    cut = low.withColumn("_gram", F.explode(_pieces(F.col(text), lengths)))
    return cut.join(F.broadcast(anchors), [*on, "_gram"]).where(F.contains(F.col(text), F.col("_name")))  # as large as the names, which were measured


def _by_words(low: DataFrame) -> DataFrame:
    """A row per distinct word (``_word``) of a text; ``_line`` has these words between blanks."""
    words = F.array_distinct(F.split("_low", f"[{re.escape(SEPARATORS)}]+"))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return low.withColumn("_line", line).withColumn("_word", F.explode(F.split("_line", " "))).where(F.length("_word") >= SHORTEST)


def _frequent_words(low: DataFrame) -> DataFrame:
    """Words of a sample of the texts, the most frequent ones; which ones affects the work, never the result."""
    share = SAMPLE_TEXTS / max(low.count(), 1)
    sample = low if share >= 1 else low.sample(share, seed=7)
    heads = sample.select(F.substring("_low", 1, SAMPLE_CHARS).alias("_low"))
    words = _by_words(heads).where(F.length("_word") <= FREQUENT_CHARS)
    counted = words.groupBy("_word").agg(F.count("*").alias("n")).where("n > 1")
    return stored(counted.orderBy(F.desc("n"), "_word").limit(FREQUENT_WORDS).select("_word"))


def _word_by_word(low: DataFrame, names: DataFrame, on: Sequence[str], name_id: Sequence[str], shortest: int) -> DataFrame:
    """Texts with the names of one word that they contain.

    A name that lies in several words of a text is reported by the first of them in ``_line``,
    so no pair comes twice. Words are short to search, so their anchors are as short as the
    shortest name: one cut of a word instead of several."""
    frequent = _frequent_words(low)
    plain = names.select("_name").distinct()
    inside = _in_the_row(frequent, plain, [], [], [shortest], "_word")
    # a frequent word is its own key, after a blank; another one has its pieces for keys
    blank = F.lit(" ")
    whole = F.concat(blank, "_word")
    keys = stored(inside.select(whole.alias("_key"), "_name").unionByName(_anchors(plain, [], [], [shortest]).select(F.col("_gram").alias("_key"), "_name")))
    cut = _by_words(low).join(F.broadcast(frequent.withColumn("_frequent", F.lit(True))), "_word", "left")  # bounded
    cut = cut.withColumn("_key", F.explode(F.when(F.col("_frequent"), F.array(whole)).otherwise(grams(F.col("_word"), shortest))))
    # _found keeps the tests behind the second join, where names of other groups are gone
    met = cut.join(F.broadcast(keys), "_key").join(F.broadcast(names.withColumn("_found", F.col("_name"))), [*on, "_name"])  # bounded words; measured names
    before = F.call_function("substring_index", F.col("_line"), F.concat(blank, "_word", blank), F.lit(1))
    hits = met.where(F.contains("_word", "_found") & ~F.contains(before, F.col("_found")))
    return hits.select(*low.columns, *[c for c in name_id if c not in low.columns], "_name")


def _own_pieces(own: Column, lengths: Sequence[int]) -> Column:
    out = None
    for n in lengths:
        found = grams(F.col("_name"), n)
        out = F.when(own == n, found) if out is None else out.when(own == n, found)
    return out


def contains_join(
    texts: DataFrame,
    names: DataFrame,
    text_id: Sequence[str],
    text: str,
    name_id: Sequence[str],
    name: str,
    on: Sequence[str] = (),
    statistics_fraction: float = 0.2,
    broadcast_bytes: int = BROADCAST_BYTES,
    group_names: int = GROUP_NAMES,
    carry: Sequence[str] = (),
    derive: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Pairs ``(text_id, name_id)`` where the lower-case text contains the name.

    Names shorter than three characters never match. ``on`` lists columns both sides must
    agree on; columns that describe a name may be listed in ``name_id`` and need no later join.
    ``carry`` adds columns of the texts, ``derive`` expressions over them, the text (``_text``),
    the place of the name in it (``_at``, from 1) and ``name_id``, made where the text is at hand.

    The names are measured first (hand in a stored table): groups of up to ``group_names`` are
    tried one by one; up to ``broadcast_bytes`` of names are broadcast, those of one word found by
    the words of the texts and others by anchors; a larger dictionary is joined by a shuffle.
    """
    own = list(dict.fromkeys([*on, *text_id, *carry]))
    low = texts.select(*own, F.col(text).alias("_text"), F.lower(F.col(text)).alias("_low"))
    usable = names.where(F.length(name) >= SHORTEST).select(*on, *name_id, F.col(name).alias("_name"))
    row = F.length(F.to_json(F.struct("*"))).cast("long")
    several = F.translate("_name", SEPARATORS, "") != F.col("_name")
    length = F.least(F.length("_name"), F.lit(LONGEST))
    size = usable.agg(
        F.coalesce(F.sum(row), F.lit(0)).alias("bytes"), F.min(F.length("_name")).alias("shortest"),
        F.array_sort(F.collect_set(F.when(several, length))).alias("several"),
        F.array_sort(F.collect_set(F.when(~several, length))).alias("single"),
    ).first()

    def crowded(some: DataFrame) -> bool:
        groups = some.groupBy(*[F.col(c) for c in on]).agg(F.count("*").alias("n"))
        return groups.where(F.col("n") > group_names).limit(1).count() > 0

    if size["bytes"] > broadcast_bytes:
        low = low.repartition(*text_id)
        shortest = min(LONGEST, size["shortest"] or SHORTEST)
        candidates = _candidates(low, usable, on, text_id, name_id, shortest, statistics_fraction)
        found = candidates.join(low.drop(*[c for c in on if c not in text_id]), list(text_id)).where(F.contains("_low", "_name"))
    elif not crowded(usable):
        found = _one_by_one(low, usable, on, name_id)
    else:
        columns = [*low.columns, *[c for c in name_id if c not in low.columns], "_name"]
        parts = []
        if size["single"]:
            parts.append(_word_by_word(low, usable.where(~several), on, name_id, size["single"][0]))
        if size["several"] and crowded(usable.where(several)):
            parts.append(_in_the_row(low, usable.where(several), on, name_id, size["several"]))
        elif size["several"]:
            parts.append(_one_by_one(low, usable.where(several), on, name_id))
        found = reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])
    found = found.withColumn("_at", F.instr("_low", F.col("_name")))
    more = [column.alias(label) for label, column in (derive or {}).items()]
    return found.select(*text_id, *name_id, *carry, *more)
