"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to a few symbols, so that the one-edit neighbourhood of a word has few strings. Every word generates the
full neighbourhood of its reduced form: itself, every replaced symbol, every deletion; an insertion is a deletion seen from
the longer word, and a replacement is generated on the side of the smaller symbol, so a pair of words meets once. The
neighbourhoods are joined with the reduced vocabulary, and what meets is verified on the original strings.

An edit leaves one half of a word as it is. Each generated string is therefore joined together with the original letters of
the half that its edit does not touch (the shorter word's front or back half). That keeps candidates close to the pairs
sought however many words share a reduced form, and no group of words is ever gathered or compared all with all; a
frequent half is one key of two stored tables, which adaptive execution splits on either side. Words of more than ``LONG``
letters meet by an exact half (33 letters or more) and their length alone: their neighbourhood would take as many
characters as the square of their length. All links are found in either way.

A word's form is its most frequent near word, if that occurs ``RATIO`` times as often; roots follow forms by pointer
doubling, whose rounds are the logarithm of a depth that is itself at most the logarithm of the largest count.

All built from DataFrame functions. Defined cases: null or empty text has no words; a null ``doc_id`` is written as nothing
before the colon; equal rows of a document count each; an empty table, or one without repeated words, gives no rows; of
equal counts the smaller word in code-point order is the form; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintshelf.llm.common import LOWER, UPPER, stored

#: Shortest word, fewest occurrences, how much more often a form occurs, one in how many runs loses a letter.
SHORTEST, FEWEST, RATIO, DAMAGE = 7, 2, 10, 31
RUN = rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"
#: Symbols of the reduced alphabet.
SYMBOLS = "0123"
#: Longest word whose neighbourhood is generated.
LONG = 64


def count_words(documents: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of documents (doc_id, text); one run in ``damage`` (by hash) loses one letter first, 0: none."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("w"))
    if damage:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("w")).cast("binary"))
        at = (F.col("h") % F.char_length("w")).cast("int")
        cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
        low = low.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("w")).alias("w"))
    counted = low.filter(F.char_length("w") >= SHORTEST).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= FEWEST)


def _alphabet() -> tuple[str, str]:
    """Every letter of a run and its symbol: code points spread by a multiplicative hash."""
    letters = LOWER + "".join(chr(i) for i in range(0xC0, 0x100))
    return letters, "".join(SYMBOLS[(ord(c) * 2_654_435_761 >> 16) % len(SYMBOLS)] for c in letters)


def reduced(word: Column) -> Column:
    return F.translate(word, *_alphabet())


def _key(front: Column, variant: Column, half: Column) -> Column:
    """Hash of a reduced string with a half's letters; the lowest bit says which half."""
    return F.shiftleft(F.xxhash64(variant, half), 1) + front.cast("long")


def _halves(length: Column, front: Column, back: Column) -> Column:
    """Keys of a word of that length and with these halves: its reduced form, or its length where it is long."""
    what = F.when(length > LONG, length.cast("string")).otherwise(F.col("r"))
    return F.array(_key(F.lit(True), what, front), _key(F.lit(False), what, back))


def _shelves() -> Column:
    """Where a word (w, r, l) stands for others to find: under its front half, and under its back half."""
    h = F.expr("cast(l div 2 as int)")
    return _halves(F.col("l"), F.substr("w", F.lit(1), h), F.substr("w", h + 1))


def _edited() -> Column:
    """Keys of the strings that an edit at place p makes of a word, with the half of the found word that it leaves alone.

    Within a run of one symbol every deletion gives the same string: the first one of each half stands for all. At place 0
    stand the word itself and, where a word without one of its letters is still long, both halves of that.
    """
    p, h, g = F.col("p"), F.expr("cast(l div 2 as int)"), F.expr("cast((l - 1) div 2 as int)")
    before, here, behind = F.substr("r", F.lit(1), p - 1), F.substr("r", p, F.lit(1)), F.substr("r", p + 1)
    half = F.when(p > h, F.substr("w", F.lit(1), h)).otherwise(F.substr("w", h + 1))
    replaced = [F.when((F.col("l") <= LONG) & (here < s), _key(p > h, F.concat(before, F.lit(s), behind), half)) for s in SYMBOLS[1:]]
    front, back = F.substr("w", F.lit(1), g), F.substr("w", g + 2)
    first = (p == 1) | (p == g + 1) | (here != F.substr("r", p - 1, F.lit(1)))
    edits = F.array(*replaced, F.when(first, _key(p > g, F.concat(before, behind), F.when(p > g, front).otherwise(back))))
    shorter = F.when(F.col("l") > LONG + 1, _halves(F.col("l") - 1, front, back)).otherwise(F.array().cast("array<bigint>"))
    return F.when(p == 0, F.concat(_shelves(), shorter)).otherwise(edits)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words within one edit, both ways, of a vocabulary (word, n)."""
    words = vocabulary.select(F.col("word").alias("w"), "n", F.char_length("word").alias("l"), reduced(F.col("word")).alias("r"))
    places = words.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("l") <= LONG + 1, F.col("l")).otherwise(0))).alias("p"))
    have = words.select(F.col("w").alias("b"), F.col("n").alias("nb"), F.explode(_shelves()).alias("key"))
    seek = places.select(F.col("w").alias("a"), F.col("n").alias("na"), F.explode(_edited()).alias("key")).filter("key IS NOT NULL")
    met = seek.join(have, "key").filter("a <> b")
    la, lb = F.char_length("a"), F.char_length("b")
    h = F.floor(lb / 2).cast("int")
    front = F.substr("a", F.lit(1), h) == F.substr("b", F.lit(1), h)
    # a pair whose edit may be told in either half counts in front only; where both words find each other, the smaller one does
    once = ((F.col("key") % 2 != 0) == front) & (la >= lb) & ((la > lb) | ((la <= LONG) & (reduced(F.col("a")) != reduced(F.col("b")))) | (F.col("a") < F.col("b")))
    pairs = met.filter(once & (F.levenshtein("a", "b", 1) == 1))
    both = F.array(F.struct("a", "na", "b", "nb"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms; forms must not run in circles."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = stored(longer)
        at = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            return at


def group_variants(documents: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of documents (doc_id, text)."""
    return group_words(stored(count_words(documents, damage)))


def group_words(words: DataFrame) -> DataFrame:
    """The same of a vocabulary (word, n) with distinct words."""
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")))
    near = near_words(words).groupBy(F.col("a").alias("word"), F.col("na").alias("n")).agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= RATIO * F.col("n")
    judged = stored(near.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    end = roots(judged.filter("form IS NOT NULL"))
    out = words.join(judged, "word", "left").join(end, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
