"""Inverted text index: postings, IDF, fuzzy token matching, candidate injection."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tintshelf.functions import text as T
from tintshelf.operators.numbering import checkpointed
from tintshelf.session import spread, spread_scan

MAX_LENGTH_GAP = 3
#: Words with at most this many unmatched characters meet on a common subsequence, others on a common piece.
FEW_EDITS = 4


def build_postings(docs: DataFrame, min_len: int = 4) -> DataFrame:
    """docs(image_name, text) to (token, image_name), each pair once."""
    return spread_scan(docs, "image_name").select(F.explode(T.text_tokens(F.col("text"), min_len)).alias("token"), "image_name").distinct()


def token_idf(postings: DataFrame, total_images: int | DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + max(1, n)/df). ``total_images`` is a number or a one-row frame (n)."""
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    if isinstance(total_images, DataFrame):
        # Exactly one row by contract: a global aggregate.
        df = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(total_images.select(F.col("n"), F.lit(1).alias("_one"))), "_one"
        ).drop("_one")
    else:
        df = df.withColumn("n", F.lit(total_images))
    ratio = F.greatest(F.lit(1), F.col("n")) / F.col("df")
    return df.select("token", "df", F.log(ratio + 1.0).alias("idf"))


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _edits(len_a, len_b, min_ratio: float):
    """Most characters, over both tokens, that may stay unmatched at this ratio; it has the parity of the lengths' sum."""
    most = F.floor((len_a + len_b) * (1.0 - min_ratio) + 1e-9).cast("int")
    return most - (most + len_a + len_b) % 2


def _lengths(words: DataFrame, mine: str, other: str, min_ratio: float) -> DataFrame:
    """Each word once per length of a partner; ``lost`` characters of the vocabulary word n and ``won`` of the query
    word qn stay unmatched at most: lost + won = edits, lost - won = n - qn."""
    own = F.col(mine)
    w = words.withColumn(other, F.explode(F.sequence(own - MAX_LENGTH_GAP, own + MAX_LENGTH_GAP))).filter(F.col(other) > 0)
    w = w.withColumn("edits", _edits(F.col("n"), F.col("qn"), min_ratio)).filter("edits >= abs(n - qn)")
    return w.withColumn("lost", F.expr("(edits + n - qn) div 2").cast("int")).withColumn("won", F.expr("(edits + qn - n) div 2").cast("int"))


def _shortened(word, times):
    """The distinct strings left when ``times`` characters of the word are deleted."""

    def cut(w):
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    return F.aggregate(F.array_repeat(F.lit(0), times), F.array(word), lambda words, _: F.array_distinct(F.flatten(F.transform(words, cut))))


def _common_subsequences(words: DataFrame, vocab: DataFrame, min_ratio: float) -> DataFrame:
    """Pairs (query_token, token) of few edits that share a subsequence of the length the ratio asks for.

    The ratio counts matched blocks in order, so a pair that reaches it has such a subsequence: delete ``lost`` characters
    of one word and ``won`` of the other and both read the same. Nothing else meets, however common a piece of a word is.
    """
    v = _lengths(vocab.select("token", F.length("token").alias("n")), "n", "qn", min_ratio).filter(F.col("edits") <= FEW_EDITS)
    v = v.select("token", "n", "lost").distinct().select("token", "n", "lost", F.explode(_shortened(F.col("token"), F.col("lost"))).alias("key"))
    q = _lengths(words.select("query_token", F.length("query_token").alias("qn")), "qn", "n", min_ratio).filter(F.col("edits") <= FEW_EDITS)
    q = q.select("query_token", "n", "lost", F.explode(_shortened(F.col("query_token"), F.col("won"))).alias("key"))
    return q.join(v, ["n", "lost", "key"]).select("query_token", "token").distinct()


def _vocab_pieces(vocab: DataFrame, min_ratio: float) -> DataFrame:
    """Each word cut into (edits + 1) even pieces, once per query length it can be compared with."""
    v = _lengths(vocab.select("token", F.length("token").alias("n")), "n", "qn", min_ratio).filter(F.col("edits") > FEW_EDITS)
    v = v.withColumn("parts", F.least(F.col("edits") + 1, F.col("n")))
    v = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start = F.expr("i * n div parts").cast("int")
    stop = F.expr("(i + 1) * n div parts").cast("int")
    return v.select("token", "n", "qn", "i", F.substring("token", start + 1, stop - start).alias("piece"))


def _query_pieces(words: DataFrame, min_ratio: float) -> DataFrame:
    """Every substring of a query word that could be piece i of a word of length n."""
    n, qn = F.col("n"), F.col("qn")
    w = _lengths(words.select("query_token", F.length("query_token").alias("qn")), "qn", "n", min_ratio).filter(F.col("edits") > FEW_EDITS)
    w = w.withColumn("parts", F.least(F.col("edits") + 1, n))
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    w = w.withColumn("start", F.expr("i * n div parts").cast("int"))
    w = w.withColumn("len", F.expr("(i + 1) * n div parts").cast("int") - F.col("start"))
    low = F.greatest(F.lit(0), F.col("start") - F.col("lost"))
    high = F.least(qn - F.col("len"), F.col("start") + F.col("won"))
    w = w.filter(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    piece = F.expr("substring(query_token, at + 1, len)")
    return w.select("query_token", "n", "qn", "i", piece.alias("piece")).distinct()


def fuzzy_candidates(words: DataFrame, vocab: DataFrame, min_ratio: float = 0.78) -> DataFrame:
    """(query_token, token): pairs of words(query_token) and vocab(token) that may reach the ratio; none that does is missed.

    Words of few edits meet on common subsequences, longer ones on pieces. Rows per word depend on its length alone.
    """
    a, b = F.col("query_token"), F.col("token")
    long = _query_pieces(words, min_ratio).join(_vocab_pieces(vocab, min_ratio), ["n", "qn", "i", "piece"]).select("query_token", "token")
    near = _common_subsequences(words, vocab, min_ratio).unionByName(long.distinct())  # a pair of lengths goes one way only
    return near.filter(F.levenshtein(a, b) <= _edits(F.length(a), F.length(b), min_ratio))


def match_tokens(
    query_tokens: DataFrame, vocab: DataFrame, min_ratio: float = 0.78, max_matches: int = 4
) -> DataFrame:
    """query_tokens(query_token) against vocab(token, idf): (query_token, token, ratio, idf).

    An exact hit stands alone. Otherwise the best ``max_matches`` by (ratio, idf, token) with ratio >= min_ratio
    and lengths at most 3 apart. A ratio r = 2M/(a+b) leaves at most (1-r)(a+b) characters unmatched, shared out
    between the words by their lengths. Up to four, both words give the strings left after that many deletions and
    meet on equal ones; beyond, of that many + 1 pieces of one word at least one stands unbroken in the other, near
    its place, and words meet on pieces. None is missed. The edit distance is no larger than the number of unmatched
    characters, so it thins the candidates out in the JVM; only the rest reach the Python ratio.
    """
    # Either side is read for the exact and for the fuzzy matches; the texts behind it only once.
    q = checkpointed(spread(query_tokens.select("query_token"), "query_token").distinct())
    vocab = checkpointed(vocab.select("token", "idf"))
    exact = q.join(vocab, q.query_token == vocab.token).select("query_token", "token", F.lit(1.0).alias("ratio"), "idf")
    rest = q.join(vocab, q.query_token == vocab.token, "left_anti")
    a, b = F.col("query_token"), F.col("token")
    la, lb = F.length(a), F.length(b)
    pairs = fuzzy_candidates(rest, vocab.select("token"), min_ratio)
    inside = (la >= 6) & (lb >= 6) & (F.contains(b, a) | F.contains(a, b))
    contained = pairs.filter(inside).withColumn("ratio", F.least(la, lb) / F.greatest(la, lb))
    others = pairs.filter(~inside).withColumn("ratio", _sequence_ratio(a, b))
    fuzzy = contained.unionByName(others).filter(F.col("ratio") >= min_ratio).join(vocab, "token")
    w = Window.partitionBy("query_token").orderBy(F.desc("ratio"), F.desc("idf"), "token")
    fuzzy = fuzzy.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_matches)
    return exact.unionByName(fuzzy.select("query_token", "token", "ratio", "idf"))


def inject_text_candidates(
    ranked: DataFrame,
    query_tokens: DataFrame,
    matches: DataFrame,
    postings: DataFrame,
    base: float = 0.88,
    scale: float = 0.18,
    max_per_token: int = 64,
    max_injected: int = 24,
) -> DataFrame:
    """Lift or add images whose text matches the query's tokens.

    ranked(query_id, image_name, score), query_tokens(query_id, query_token), matches from ``match_tokens``.
    Each matched token speaks for its first ``max_per_token`` images by name. Ranked images always stay;
    others enter only among the ``max_injected`` best boosted of their query.
    """
    first = Window.partitionBy("token").orderBy("image_name")
    head = postings.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= max(1, max_per_token)).drop("_rn")
    weight = F.col("idf") * F.col("ratio")
    hits = (
        query_tokens.select("query_id", "query_token").distinct()
        .join(matches, "query_token").filter(weight > 0)
        .join(head, "token")
        .groupBy("query_id", "image_name")
        .agg(F.sum(weight).alias("raw"), F.count("*").alias("hits"))
    )
    per_query = Window.partitionBy("query_id")
    bonus = F.least(F.lit(0.08), (F.col("hits") - 1) * 0.02)
    seed = F.least(F.lit(1.2), F.col("raw") / (F.max("raw").over(per_query) + 1e-6) * scale + base + bonus)
    seeds = hits.select("query_id", "image_name", seed.alias("seed"))
    merged = ranked.join(seeds, ["query_id", "image_name"], "full").withColumn(
        "merged", F.greatest("score", "seed")
    )
    if max_injected <= 0:
        return merged.select("query_id", "image_name", F.col("merged").alias("score"))
    order = Window.partitionBy("query_id").orderBy(
        F.col("seed").isNull(), F.desc(F.round("merged", 9)), "image_name"
    )
    merged = merged.withColumn("_rn", F.row_number().over(order))
    return merged.filter(F.col("score").isNotNull() | (F.col("_rn") <= max_injected)).select(
        "query_id", "image_name", F.col("merged").alias("score")
    )
