"""Text index over all documents; the benchmark passages and the order comments of parts are the queries."""

from pyspark.sql import functions as F

from checks.base import Data, query
from tintshelf.functions import text as T
from tintshelf.operators import textindex as H
from tintshelf.operators.numbering import checkpointed


def _postings(d: Data):
    return H.build_postings(d.docs())


def _idf(d: Data, postings=None):
    n = d.table("documents").agg(F.count("*").alias("n"))
    return H.token_idf(postings if postings is not None else _postings(d), n)


@query("build_postings", "SELECT token, image_name FROM postings")
def _(d):
    return _postings(d)


@query("token_idf", "SELECT token, df, round(idf, 6) AS idf FROM token_idf")
def _(d):
    return _idf(d).withColumn("idf", F.round("idf", 6))


def _query_tokens(d: Data):
    """Tokens of the benchmark passages, half of them with their second letter lost."""
    t = d.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.text_tokens(F.col("text"))).alias("t"))
    damaged = F.concat(F.substring("t", 1, 1), F.expr("substring(t, 3)"))
    token = F.when((F.length("t") % 2 == 0) & (F.length("t") > 5), damaged).otherwise(F.col("t"))
    return t.select("query_id", token.alias("query_token")).distinct()


def _matches(d: Data, postings=None):
    return H.match_tokens(_query_tokens(d).select("query_token"), _idf(d, postings).select("token", "idf"))


_TOKENS = r"""raw_tokens AS (SELECT DISTINCT item_id AS query_id, unnest(list_transform(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]{4,}'),
      lambda t: regexp_replace(t, '^[0-9]+|[0-9]+$', '', 'g'))) AS t FROM benchmark),
    query_tokens AS (SELECT DISTINCT query_id, CASE WHEN length(t) % 2 = 0 AND length(t) > 5 THEN t[1:1] || t[3:] ELSE t END AS query_token
      FROM raw_tokens WHERE length(t) >= 4 AND regexp_matches(t, '[A-Z]'))"""


#: All pairs of near lengths and few edits; the ratio by blocks: the longest common block (first in the query word, then in
#: the other), then what lies left and right of it.
_FUZZY = f"""WITH RECURSIVE {_TOKENS}, asked AS (SELECT DISTINCT query_token FROM query_tokens),
    near AS MATERIALIZED (SELECT query_token AS q, token AS t, length(query_token) AS lq, length(token) AS lt FROM asked JOIN token_idf
      ON abs(length(token) - length(query_token)) <= 3 AND levenshtein(query_token, token) <= (length(token) + length(query_token)) * 0.22::DOUBLE + 1e-9::DOUBLE
      WHERE query_token NOT IN (SELECT token FROM token_idf)),
    places AS MATERIALIZED (SELECT unnest(generate_series(1, (SELECT greatest(max(lq), max(lt)) FROM near))) AS n),
    spans AS (SELECT q, t, '' AS side, q AS x, t AS y, 0 AS got FROM near
      UNION ALL
      SELECT q, t, side || c.side, c.x, c.y, c.got FROM (SELECT q, t, side, unnest([
          {{'side': 'l', 'x': left(x, (-best[2] - 1)::BIGINT), 'y': left(y, (-best[3] - 1)::BIGINT), 'got': best[1]}},
          {{'side': 'r', 'x': substr(x, (best[1] - best[2])::BIGINT), 'y': substr(y, (best[1] - best[3])::BIGINT), 'got': 0}}]) AS c
        FROM (SELECT q, t, side, x, y, max([l.n, -i.n, -j.n]) AS best FROM spans JOIN places i ON i.n <= length(x) JOIN places j ON j.n <= length(y)
          JOIN places l ON l.n <= length(x) - i.n + 1 AND l.n <= length(y) - j.n + 1 AND substr(x, i.n, l.n) = substr(y, j.n, l.n) GROUP BY ALL))),
    blocks AS (SELECT q, t, sum(got) AS m FROM spans GROUP BY q, t),
    scored AS (SELECT q AS query_token, t AS token, CASE WHEN least(lq, lt) >= 6 AND (contains(q, t) OR contains(t, q)) THEN least(lq, lt)::DOUBLE / greatest(lq, lt)
      ELSE 2.0::DOUBLE * m / (lq + lt) END AS ratio FROM near JOIN blocks USING (q, t)),
    matches AS (SELECT query_token, token, 1.0::DOUBLE AS ratio, idf FROM asked JOIN token_idf ON token = query_token
      UNION ALL (SELECT query_token, token, ratio, idf FROM scored JOIN token_idf USING (token) WHERE ratio >= 0.78
        QUALIFY row_number() OVER (PARTITION BY query_token ORDER BY ratio DESC, idf DESC, token) <= 4))"""


@query("match_tokens", f"{_FUZZY} SELECT query_token, token, round(ratio, 6) AS ratio, round(idf, 6) AS idf FROM matches")
def _(d):
    return _matches(d).withColumn("ratio", F.round("ratio", 6)).withColumn("idf", F.round("idf", 6))


@query("match_tokens_exact", f"WITH {_TOKENS} SELECT DISTINCT query_token, token, 1.0::DOUBLE AS ratio FROM query_tokens JOIN token_idf ON token = query_token")
def _(d):
    return _matches(d).filter("query_token = token").select("query_token", "token", "ratio")


def _ranked(d: Data, postings):
    """A first list: the documents that hold the most tokens of a passage."""
    hits = _query_tokens(d).join(postings, F.col("query_token") == F.col("token")).groupBy("query_id", "image_name").agg(F.count("*").alias("n"))
    return hits.select("query_id", "image_name", (F.col("n") / 40.0).alias("score"))


_RANKED = """hits AS (SELECT query_id, image_name, count(*) AS n FROM query_tokens JOIN postings ON token = query_token GROUP BY ALL),
    ranked AS (SELECT query_id, image_name, n / 40.0::DOUBLE AS score FROM hits),
    top64 AS (SELECT token, image_name FROM postings QUALIFY row_number() OVER (PARTITION BY token ORDER BY image_name) <= 64)"""
_PLACED = """seeds AS (SELECT query_id, image_name, least(1.2::DOUBLE, 0.88::DOUBLE + 0.18::DOUBLE * raw / (max(raw) OVER (PARTITION BY query_id) + 1e-6::DOUBLE) + least(0.08::DOUBLE, 0.02::DOUBLE * (hits - 1))) AS seed FROM raw),
    merged AS (SELECT query_id, image_name, score, seed, greatest(coalesce(score, seed), coalesce(seed, score)) AS best FROM ranked FULL JOIN seeds USING (query_id, image_name)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed IS NULL, round(best, 9) DESC, image_name) AS nth FROM merged)
    SELECT query_id, image_name, round(best, 6) AS score FROM placed WHERE score IS NOT NULL OR nth <= 24"""
_EXACT = f"""WITH {_TOKENS}, {_RANKED},
    raw AS (SELECT query_id, image_name, sum(idf) AS raw, count(*) AS hits FROM query_tokens JOIN token_idf ON token = query_token JOIN top64 USING (token) GROUP BY ALL),
    {_PLACED}"""
_INJECTED = f"""{_FUZZY}, {_RANKED},
    raw AS (SELECT query_id, image_name, sum(idf * ratio) AS raw, count(*) AS hits FROM query_tokens JOIN matches USING (query_token) JOIN top64 USING (token) GROUP BY ALL),
    {_PLACED}"""


@query("inject_text_candidates_exact", _EXACT)
def _(d):
    postings = checkpointed(_postings(d))  # read three times
    exact = _matches(d, postings).filter("query_token = token")
    return H.inject_text_candidates(_ranked(d, postings), _query_tokens(d), exact, postings).withColumn("score", F.round("score", 6))


@query("inject_text_candidates", _INJECTED)
def _(d):
    postings = checkpointed(_postings(d))  # read three times
    tokens, ranked = _query_tokens(d), _ranked(d, postings)
    out = H.inject_text_candidates(ranked, tokens, _matches(d, postings), postings)
    return out.withColumn("score", F.round("score", 6))
