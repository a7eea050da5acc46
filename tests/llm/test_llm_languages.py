"""Any number of languages is learned, with the same likelihoods as from dense counts."""

import numpy as np

from tintshelf.llm import langid


def test_every_language_is_learned(spark):
    r = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    names = [f"l{k:03d}" for k in range(130)]
    words = {n: ["".join(r.choice(letters, 5)) for _ in range(12)] for n in names}
    text = lambda n: " ".join(r.choice(words[n], 60))
    rows = [(i, text(n), n) for i, n in enumerate([*names, *names[:100]])]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == names
    asked = spark.createDataFrame([(n, text(n)) for n in names], "lang string, text string")
    assert all(x["lang_pred"] == x["lang"] and x["fit"] > 0 for x in langid.identify(asked, model).collect())


def test_likelihood_of_seen_and_unseen_buckets():
    dense = np.zeros((3, langid.BUCKETS))
    dense[0, [0, 5, 9]], dense[1, [5, langid.BUCKETS - 1]] = [3, 1, 2], [7, 4]
    language, bucket = np.nonzero(dense)
    model = langid.Model(["a", "b", "c"], language, bucket, dense[language, bucket])
    asked = np.array([0, 1, 5, 9, langid.BUCKETS - 1])
    want = ((dense + langid.SMOOTH) / (dense.sum(axis=1, keepdims=True) + langid.SMOOTH * langid.BUCKETS)).T[asked]
    assert np.array_equal(model.likelihood(asked), want)
