"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed letter 3-grams, learned from labelled texts. A document is a mixture of
languages: expectation-maximisation estimates their proportions from the 3-gram likelihoods; languages are added to the
set, largest proportion first, while the log-likelihood gains more than a penalty that grows with the log of the number
of 3-grams (Bayesian information, for 3-grams that overlap). The prediction is the language with the largest proportion.

The model is fitted on at most about ``SAMPLE`` texts of each language, drawn by a hash; every document is judged on its
whole text. Every label is learned, however many there are: counts are summed in Spark, and what goes to the tasks is the
counts of the buckets that each language has (a language without a bucket has the smoothed rest there).

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no languages, as is every text if nothing
could be learned; ties take the first language in alphabetical order; rows come back as often as given, whatever their
doc_id; an empty table gives no rows; columns of the caller that are named like ours are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BUCKETS, SMOOTH = 1 << 16, 0.5
#: Bound of what is learned: texts of each language (on average, by hash).
SAMPLE = 1000
#: Languages that a task counts side by side before it hands their counts on.
HELD = 64
ROUNDS, STOP, PENALTY = 40, 1e-4, 3.0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_buckets(text: str | None) -> np.ndarray:
    """Bucket of every 3-gram of the lower-cased letters; runs of anything else count as one blank."""
    if not text:
        return np.empty(0, dtype=np.int64)
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(_letters()[code], code, np.uint32(32)).astype(np.uint64)
    blank = code == 32
    code = code[~(blank & np.r_[False, blank[:-1]])]
    if len(code) < 3:
        return np.empty(0, dtype=np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    mix = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mix >> np.uint64(48)).astype(np.int64)[b != 32]


class Model:
    """Languages and their counts by bucket: entries ``start[b]`` to ``start[b + 1]`` are those of bucket b."""

    def __init__(self, languages: list[str], language: np.ndarray, bucket: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.total = np.bincount(language, weights=counts, minlength=len(languages)) + SMOOTH * BUCKETS
        order = np.argsort(bucket, kind="stable")
        self.language, self.counts = language[order].astype(np.int32), counts[order].astype(np.float64)
        self.start = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def likelihood(self, bucket: np.ndarray) -> np.ndarray:
        """Probability of each of the (distinct) buckets in every language: buckets x languages."""
        counts = np.full((len(bucket), len(self.languages)), SMOOTH)
        size = self.start[bucket + 1] - self.start[bucket]
        row = np.repeat(np.arange(len(bucket)), size)
        at = np.arange(size.sum()) + np.repeat(self.start[bucket] - (np.cumsum(size) - size), size)
        counts[row, self.language[at]] += self.counts[at]
        return counts / self.total

    @staticmethod
    def _mix(p: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
        share = np.full(p.shape[1], 1 / p.shape[1])
        n = times.sum()
        for _ in range(ROUNDS):
            joint = p @ share
            new = share * ((times / joint) @ p) / n
            done = np.abs(new - share).max() < STOP
            share = new
            if done:
                break
        return share, float(times @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[list[tuple[int, float]], float]:
        """([(language, proportion)] of the chosen set, largest first, mean gain in nats over even buckets)."""
        found = gram_buckets(text)
        if not len(found) or not self.languages:
            return [], 0.0
        bucket, times = np.unique(found, return_counts=True)
        p, times = self.likelihood(bucket), times.astype(np.float64)
        alone = times @ np.log(p)
        best = int(alone.argmax())
        chosen, share, like = [best], np.ones(1), float(alone[best])
        if len(self.languages) > 1:
            everyone, _ = self._mix(p, times)
            for k in np.argsort(-everyone, kind="stable"):
                if k == best:
                    continue
                if everyone[k] <= STOP:
                    break
                wider = [*chosen, int(k)]
                s, l = self._mix(p[:, wider], times)
                if l - like <= PENALTY * 0.5 * np.log(times.sum() + 1):
                    break
                chosen, share, like = wider, s, l
        order = sorted(zip(chosen, share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return order, like / times.sum() + np.log(BUCKETS)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of (doc_id, text, lang): rows with null lang or text teach nothing."""
    given = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    known = given.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("share"))
    drawn = given.join(F.broadcast(known), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pd.DataFrame]:
            for lang, counts in seen.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})
            seen.clear()

        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                if lang not in seen:
                    if len(seen) >= HELD:
                        yield from handed()
                    seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                seen[lang] += np.bincount(gram_buckets(text), minlength=BUCKETS)
        yield from handed()

    summed = drawn.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toPandas()  # one row for each bucket that a language has
    languages = sorted(got["lang"].unique())
    language = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    return Model(languages, language, got["bucket"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.int64))


_SHARE = T.StructType().add("lang", "string").add("share", "double")
_ADDED = T.StructType().add("lang_pred", "string").add("score", "double").add("mixture", T.ArrayType(_SHARE)).add("fit", "double")


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` with ``lang_pred``, ``score`` (its proportion), ``mixture`` and ``fit``, from ``text`` alone."""
    docs = documents.drop(*_ADDED.names)
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.languages
        for batch in batches:
            found = [sent.value.infer(t) for t in batch.column(at).to_pylist()]
            mixture = pa.array([[{"lang": names[k], "share": s} for k, s in f] for f, _ in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            new = [
                pa.array([names[f[0][0]] if f else UNKNOWN for f, _ in found], pa.string()),
                pa.array([min(1.0, f[0][1]) if f else 0.0 for f, _ in found], pa.float64()),
                mixture,
                pa.array([x for _, x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *_ADDED.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_ADDED.fields]))
