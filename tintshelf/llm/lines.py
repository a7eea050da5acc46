"""Line dedup by winnowing: later repeats of a run of lines go, the first place of the run stays.

Rule: a run of ``run`` lines in a row, or one line of at least ``long_words`` words, that stands word for word at an
earlier place (order: doc_id, text hash, line) is removed there; repeats that overlap count as repeats. Lines are compared
without outer blanks; blank lines are no part of a run and go with the line before them. A run of fewer than ``run`` lines
also counts that reaches ``long_words`` words as a whole, but not without its first or its last line (``passages``).

Way: every window of ``run`` line hashes gives its smallest hash (the rightmost of equals) as a fingerprint, and a long
line is one by itself, so both places of a repeated run hold the same fingerprints at the same offsets; a passage is a
window of its own lines. Only fingerprints
that occur at two places are followed: around each the runs that hold it are spelled out to both sides, the first place of
every run is a minimum over partial sums, and all other places are cut. Work and shuffles are linear: places meet the
first place of their run, never one another.

Defined cases: null text stays null; text without lines stays; rows of one doc_id with different texts are different
documents, rows that repeat doc_id and text are one document, returned as often as given; null doc_id sorts first; an
empty table gives no rows; further columns come back unchanged, whatever their names (those named _ld_* are ours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintshelf.llm.common import stored, text_hash

RUN, LONG_WORDS = 3, 50


def removed_lines(documents: DataFrame, run: int = RUN, long_words: int = LONG_WORDS, passages: bool = True) -> DataFrame:
    """(doc_id, th, lines): numbers of the lines that repeat an earlier run, for the documents that have any."""
    docs = documents.select("doc_id", text_hash(F.col("text")).alias("th"), F.split("text", "\n").alias("all")).filter(F.size("all") > 0)
    named = F.transform("all", lambda x, i: F.struct(F.btrim(x, F.lit(" \t\r")).alias("s"), i.alias("i")))
    full = docs.select("doc_id", "th", F.size("all").alias("n"), F.filter(named, lambda x: x["s"] != "").alias("at"))

    lengths = range(2, run) if passages else ()

    def line(x, k):
        words = F.size(F.split(x["s"], "[ \t]+"))
        return F.struct(
            x["i"].alias("i"),
            F.coalesce(F.get("at", k + 1)["i"], F.col("n")).alias("upto"),
            F.xxhash64(x["s"]).alias("h"),
            F.xxhash64(F.lit("again"), x["s"]).alias("g"),
            (words >= long_words).alias("wide"),
            *([words.alias("w")] if lengths else []),
        )

    lines = full.select("doc_id", "th", F.transform("at", line).alias("l"))
    # smallest hash of each window, the rightmost of equals
    smallest = lambda s, size=run: F.array_min(F.transform(F.slice("l", s + 1, F.lit(size)), lambda x, o: F.struct(x["h"].alias("h"), (-(s + o)).alias("k"))))
    starts = F.when(F.size("l") >= run, F.sequence(F.lit(0), F.size("l") - run)).otherwise(F.array().cast("array<int>"))
    minima = F.transform(starts, lambda s: -smallest(s)["k"])
    wide = F.filter(F.transform("l", lambda x, k: F.when(x["wide"], k)), lambda k: k.isNotNull())

    def passage(of, s, size):
        count = lambda a, z: F.aggregate(F.slice(of, a + 1, F.lit(z)), F.lit(0), lambda n, x: n + x["w"])
        return (count(s, size) >= long_words) & (count(s, size - 1) < long_words) & (count(s + 1, size - 1) < long_words)

    def passage_minima(size):
        at = F.when(F.size("l") >= size, F.sequence(F.lit(0), F.size("l") - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(at, lambda s: passage("l", s, size)), lambda s: -smallest(s, size)["k"])

    marks = F.concat(minima, wide, *[passage_minima(m) for m in lengths])
    marked = lines.select("doc_id", "th", "l", F.size("l").alias("n"), F.array_distinct(marks).alias("ks"))

    def around(k):
        lo = F.greatest(k - (run - 1), F.lit(0))
        return F.struct(F.get("l", k)["h"].alias("h"), (k - lo).alias("o"), F.slice("l", lo + 1, F.least(k + run, F.col("n")) - lo).alias("near"))

    prints = stored(marked.select("doc_id", "th", F.explode(F.transform("ks", around)).alias("p")).select("doc_id", "th", "p.h", "p.o", "p.near"))
    # the same line at two places: runs are followed only from there
    shared = stored(prints.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    meeting = prints.join(shared, "h")

    def gram(s, size):
        part = F.slice("near", s + 1, F.lit(size))
        return F.struct(
            F.aggregate(part, F.lit(size).cast("long"), lambda a, x: F.xxhash64(a, x["h"])).alias("a"),
            F.aggregate(part, F.lit(size).cast("long"), lambda a, x: F.xxhash64(a, x["g"])).alias("b"),
            F.get("near", s)["i"].alias("from"),
            F.get("near", s + size - 1)["upto"].alias("upto"),
        )

    def around_print(size, of=lambda at: at):
        first_start, last_start = F.greatest(F.col("o") - (size - 1), F.lit(0)), F.least(F.col("o"), F.size("near") - size)
        return F.when(last_start >= first_start, F.transform(of(F.sequence(first_start, last_start)), lambda s: gram(s, size)))

    runs = [around_print(run), *[around_print(m, lambda at, m=m: F.filter(at, lambda s: passage("near", s, m))) for m in lengths]]
    own = F.get("near", F.col("o"))
    single = F.when(own["wide"], F.array(F.struct(own["h"].alias("a"), own["g"].alias("b"), own["i"].alias("from"), own["upto"].alias("upto"))))
    none = F.array().cast("array<struct<a:bigint,b:bigint,from:int,upto:int>>")
    spelled = meeting.select("doc_id", "th", F.explode(F.concat(*[F.coalesce(x, none) for x in (*runs, single)])).alias("r"))
    spelled = spelled.select("doc_id", "th", "r.a", "r.b", "r.from", "r.upto")
    place = F.struct("doc_id", "th", "from")
    firsts = spelled.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    later = spelled.join(stored(firsts.drop("last")), ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    cut = later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("from", "upto")).alias("cut"))
    spans = F.transform("cut", lambda c: F.sequence(c["from"], c["upto"] - 1))
    return cut.select("doc_id", "th", F.array_sort(F.array_distinct(F.flatten(spans))).alias("lines"))


def dedup_lines(documents: DataFrame, run: int = RUN, long_words: int = LONG_WORDS, passages: bool = True) -> DataFrame:
    """All columns of ``documents`` with the shortened ``text``, then ``n_lines`` and ``n_removed`` of the text as given."""
    # renamed, so that nothing else that the caller has can clash
    gone = stored(removed_lines(documents, run, long_words, passages)).toDF("_ld_doc", "_ld_th", "_ld_gone")
    docs = documents.drop("n_lines", "n_removed").withColumn("_ld_here", text_hash(F.col("text")))
    both = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_ld_doc"]) & (docs["_ld_here"] == gone["_ld_th"]), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_gone"))
    kept = F.when(F.size("_ld_gone") == F.size("_ld_lines"), F.lit("")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_ld_lines", i)), "\n"))
    both = both.withColumn("_ld_lines", lines)
    shorter = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_ld_lines")).cast("long")
    out = {"text": shorter, "n_lines": n_lines, "n_removed": F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long")}
    rest = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("_ld_") and c != "text"]
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed") and not c.startswith("_ld_")]
    return both.select(*rest, *[e.alias(c) for c, e in out.items()]).select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_removed")
