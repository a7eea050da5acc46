"""Vector search, fusion, re-ranking, training and the settings-defined ranking steps; every vector is query and catalog."""

from pyspark.sql import functions as F

from checks.base import Data, query
from tintshelf.functions import vector as X
from tintshelf.operators import ivf as I
from tintshelf.operators import learn as N
from tintshelf.operators import ranking as R
from tintshelf.operators import vectors as V
from tintshelf.operators.numbering import checkpointed
from tintshelf.plans.search import SearchSettings, search_styles
from tintshelf.session import new_folder as work_folder

WEIGHTS = (0.55, 0.16, 0.04, 0.25)
# A fixed model for the checks that need SQL; training has its own query.
MODEL = N.PairModel(
    (1.5, 0.75, -0.25, 0.5, 0.125, 0.25, -0.5, 0.375, 0.625, -0.125), -0.5,
    (0.1, 0.05, 0.02, 0.01, 0.03, 0.0, 0.01, -0.02, 0.04, 0.03), (0.5, 0.4, 0.3, 0.35, 0.25, 0.5, 0.45, 0.4, 0.2, 0.15),
)


def _listed(v):
    return F.array_join(F.transform(v, lambda x: F.round(x, 6).cast("decimal(12,6)").cast("string")), "|")


def _sql_list(v):
    return f"array_to_string(list_transform({v}, lambda x: round(x, 6)::DECIMAL(12,6)::VARCHAR), '|')"


def _unit(v):
    return f"list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-8::DOUBLE))"


@query("l2_normalize", f"WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x * (vec_id % 5)) AS v FROM vectors) SELECT vec_id, {_sql_list(_unit('v'))} AS v FROM s")
def _(d: Data):
    v = X.l2_normalize(X.scale(F.col("embedding"), (F.col("vec_id") % 5).cast("double")))
    return d.vectors().select("vec_id", _listed(v).alias("v"))


_HYBRID = "list_concat(" + ", ".join(
    f"list_transform({_unit(m)}, lambda x: x * {w}::DOUBLE)" for m, w in zip(N.MODALITIES, WEIGHTS)) + ")"


@query("hybrid_embedding", f"WITH h AS (SELECT vec_id, {_HYBRID} AS v FROM modal) SELECT vec_id, {_sql_list(_unit('v'))} AS v FROM h")
def _(d):
    return d.modal().select("vec_id", _listed(X.hybrid_embedding(*[F.col(m) for m in N.MODALITIES], WEIGHTS)).alias("v"))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _recall(d: Data, k: int = 90):
    return V.topk_vectors(d.queries(), d.images(), k)


@query("topk_vectors", "SELECT query_id, image_name, round(score, 6) AS score FROM recalled")
def _(d):
    return _rounded(_recall(d), "score")


@query("topk_vectors_by_cells", "SELECT query_id, image_name, round(score, 6) AS score FROM recalled WHERE true QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) <= 20")
def _(d):
    # The way taken when the query side is too large to hand to every task.
    return _rounded(V.topk_vectors(d.queries(), d.images(), 20, max_broadcast_rows=0), "score")


_VIEWS = """per_view AS (SELECT q.query_id, q.view, c.image_name, list_dot_product(q.embedding, c.embedding) AS score FROM view_queries q, vectors c)"""


@query("topk_vectors_views", f"""WITH {_VIEWS}, fused AS (SELECT query_id, image_name, round(0.8::DOUBLE * max(score) + 0.2::DOUBLE * avg(score), 12) AS score FROM per_view GROUP BY ALL)
    SELECT query_id, image_name, round(score, 6) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) <= 20""")
def _(d):
    return _rounded(V.topk_vectors(d.view_queries(), d.images(), 20, consensus=0.2), "score")


def _view_scores(d: Data):
    """The score in every view of each image that some view ranks among its best 20."""
    v = d.view_queries()
    keyed = v.select(F.concat_ws("/", "query_id", "view").alias("query_id"), "embedding")
    top = V.topk_vectors(keyed, d.images(), 20)
    seen = top.select(F.substring_index("query_id", "/", 1).cast("bigint").alias("query_id"), "image_name").distinct()
    pairs = seen.join(d.images().select("image_name", F.col("embedding").alias("e")), "image_name").join(v, "query_id")
    dot = F.aggregate(F.zip_with("embedding", "e", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select("query_id", "image_name", dot.alias("score"))


@query("fuse_views", """WITH per_view AS (SELECT q.query_id, q.view, c.image_name, round(list_dot_product(q.embedding, c.embedding), 12) AS score FROM view_queries q, vectors c),
    top AS (SELECT DISTINCT query_id, image_name FROM (SELECT * FROM per_view QUALIFY row_number() OVER (PARTITION BY query_id, view ORDER BY score DESC, image_name) <= 20))
    SELECT query_id, image_name, round(0.55::DOUBLE * max(score) + 0.45::DOUBLE * avg(score), 6) AS score FROM per_view JOIN top USING (query_id, image_name) GROUP BY ALL""")
def _(d):
    return _rounded(V.fuse_views(_view_scores(d), 0.45), "score")


# The same top-20 lists after zeroing the first view, as a second opinion.
_SECOND = """second AS (SELECT query_id, image_name, score FROM (SELECT q.query_id, c.image_name, round(list_dot_product(q.embedding, c.embedding), 12) AS score
    FROM view_queries q, vectors c WHERE view = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) <= 20)"""


def _second(d: Data, k=20):
    return V.topk_vectors(d.view_queries().filter("view = 1").drop("view"), d.images(), k)


@query("merge_ranked", f"""WITH {_SECOND}, both_lists AS (SELECT query_id, image_name, score FROM recalled UNION ALL SELECT query_id, image_name, 0.94::DOUBLE * score FROM second)
    SELECT query_id, image_name, round(max(score), 6) AS score FROM both_lists GROUP BY ALL""")
def _(d):
    return _rounded(V.merge_ranked(_recall(d), _second(d), 0.94), "score")


def _codes(d: Data):
    return V.rank_style_codes(_recall(d))


@query("rank_style_codes", "SELECT query_id, style_code, best_image, round(raw_score, 6) AS raw_score FROM code_scores")
def _(d):
    return _rounded(_codes(d), "raw_score")


def _hints(d: Data):
    return d.vectors().select(F.col("vec_id").alias("query_id"), F.col("style_code").alias("hint_code"))


@query("apply_hint_boost", """SELECT query_id, s.style_code, round(raw_score + CASE WHEN s.style_code = v.style_code THEN 0.08::DOUBLE ELSE 0 END, 6) AS raw_score
    FROM code_scores s JOIN vectors v ON v.vec_id = query_id""")
def _(d):
    return _rounded(V.apply_hint_boost(_codes(d), _hints(d), 0.08), "raw_score").select("query_id", "style_code", "raw_score")


PRIOR = """prior AS (SELECT query_id, style_code AS code, max(0.08::DOUBLE * least(1, (score - 0.2::DOUBLE) / 0.8::DOUBLE)) AS boost FROM sims WHERE score >= 0.2::DOUBLE GROUP BY ALL)"""


def _prior(d: Data, **options):
    return V.label_memory_prior(d.queries(), d.vectors().select("style_code", "embedding"), threshold=0.2, **options)


@query("label_memory_prior", f"WITH {PRIOR} SELECT query_id, code, round(boost, 6) AS boost FROM prior")
def _(d):
    return _rounded(_prior(d), "boost")


@query("label_memory_prior_by_cells", f"WITH {PRIOR} SELECT query_id, code, round(boost, 6) AS boost FROM prior")
def _(d):
    return _rounded(_prior(d, max_broadcast_rows=0), "boost")


@query("apply_code_prior", f"""WITH {PRIOR} SELECT s.query_id, style_code, round(raw_score + coalesce(boost, 0), 6) AS raw_score
    FROM code_scores s LEFT JOIN prior p ON p.query_id = s.query_id AND code = style_code""")
def _(d):
    return _rounded(V.apply_code_prior(_codes(d), _prior(d)), "raw_score").select("query_id", "style_code", "raw_score")


_SHOWN = """round(least(0.9999::DOUBLE, 1 / (1 + exp(-greatest(-20, least(20, 8 * (raw_score - 0.72::DOUBLE)))))), 4) AS score, round(raw_score, 6) AS rank_score"""


@query("display_score", f"SELECT query_id, style_code, {_SHOWN} FROM code_scores")
def _(d):
    return V.display_score(_codes(d)).select("query_id", "style_code", "score", "rank_score")


SEARCHED = f"""shown AS (SELECT query_id, style_code, best_image, {_SHOWN} FROM code_scores),
    searched AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, style_code) AS rank FROM shown WHERE rank_score >= 0.1::DOUBLE)"""


@query("final_topk", f"WITH {SEARCHED} SELECT query_id, style_code, rank_score, rank::INT AS rank FROM searched WHERE rank <= 10")
def _(d):
    return V.final_topk(V.display_score(_codes(d)), 10, 0.1).select("query_id", "style_code", "rank_score", "rank")


def _search(d: Data):
    return search_styles(d.queries(), d.images(), SearchSettings(min_score=0.1))


@query("search_styles", f"WITH {SEARCHED} SELECT query_id, style_code, best_image, score, rank_score, rank::INT AS rank FROM searched WHERE rank <= 10")
def _(d):
    return _search(d)


@query("search_styles_boosted", f"""WITH {PRIOR}, boosted AS (SELECT s.query_id, s.style_code, best_image, raw_score + CASE WHEN s.style_code = v.style_code THEN 0.08::DOUBLE ELSE 0 END + coalesce(boost, 0) AS raw_score
      FROM code_scores s JOIN vectors v ON v.vec_id = s.query_id LEFT JOIN prior p ON p.query_id = s.query_id AND code = s.style_code)
    SELECT query_id, style_code, best_image, {_SHOWN}, (row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 6) DESC, style_code))::INT AS rank FROM boosted
    QUALIFY rank <= 10""")
def _(d):
    return search_styles(d.queries(), d.images(), SearchSettings(hint_boost=0.08, min_score=-9.0), hints=_hints(d), prior=_prior(d))


@query("cap_unique_codes", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) AS rank FROM recalled),
    f AS (SELECT *, rank <= 40 AND row_number() OVER (PARTITION BY query_id, style_code ORDER BY rank) = 1 AS lead FROM r),
    n AS (SELECT *, sum(lead::INT) OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM f)
    SELECT query_id, image_name, rank::INT AS rank FROM n WHERE rank > 40 OR (lead AND nth <= 12)""")
def _(d):
    return V.cap_unique_codes(_recall(d), 40, 12).select("query_id", "image_name", "rank")


@query("first_per_code", """WITH r AS (SELECT query_id, upper(style_code) AS code, min(row_rank) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) AS row_rank FROM recalled) GROUP BY ALL)
    SELECT query_id, code, (row_number() OVER (PARTITION BY query_id ORDER BY pos))::INT AS rank FROM r QUALIFY rank <= 9""")
def _(d):
    rows = V.cap_unique_codes(_recall(d), 0, 0).withColumn("style_code", F.lower("style_code"))
    return V.first_per_code(rows).select("query_id", F.upper("style_code").alias("code"), "rank")


@query("dedup_views", """SELECT query_id, min(view) AS view, width, height, mean_level FROM (SELECT vec_id AS query_id, view, 100 + (view // 2)::INT AS width, 80 AS height,
    floor(100 + 200 * embedding[view + 1]::DOUBLE)::INT AS mean_level FROM embeddings, generate_series(0, 7) g(view)) GROUP BY ALL""".replace("min(view)", "min(view)::INT"))
def _(d):
    v = d.vectors().withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(7))))
    views = v.select(
        F.col("vec_id").alias("query_id"), "view", F.expr("cast(100 + view div 2 as int)").alias("width"), F.lit(80).alias("height"),
        (F.get("embedding", F.col("view")) * 200 + 100).alias("mean"),
    )
    return V.dedup_views(views)


# ---- pairs, training, re-ranking ------------------------------------------------------------------------------------


def pair_sql(source: str, keys: str) -> str:
    """CTEs ending in ``featured(keys, base, f1..f9)`` from ``source(keys, base, q_clip.., c_clip..)``."""
    dots = ", ".join(f"list_dot_product(q_{m}, c_{m}) AS s_{m}" for m in N.MODALITIES)
    return f"""dotted AS (SELECT {keys}, base, {dots} FROM {source}),
      featured AS (SELECT {keys}, base, s_clip AS f1, s_shape AS f2, s_color AS f3, s_stripe AS f4, s_clip - s_shape AS f5, s_shape - s_color AS f6,
        s_stripe - s_color AS f7, s_clip * s_stripe AS f8, s_shape * s_stripe AS f9 FROM dotted)"""


def model_sql(m: N.PairModel) -> str:
    names = ["base", *[f"f{i}" for i in range(1, 10)]]
    z = " + ".join(f"({n} - ({mu})::DOUBLE) / {s}::DOUBLE * ({w})::DOUBLE" for n, w, mu, s in zip(names, m.weights, m.mean, m.std))
    return f"(1 / (1 + exp(-greatest(-20, least(20, ({m.intercept})::DOUBLE + {z})))))"


_SIDES = ", ".join(f"q.{m} AS q_{m}, c.{m} AS c_{m}" for m in N.MODALITIES)


def _head_pairs(d: Data):
    m = d.modal()
    q = m.select(F.col("vec_id").alias("query_id"), *[F.col(n).alias(f"q_{n}") for n in N.MODALITIES])
    c = m.select("image_name", *[F.col(n).alias(f"c_{n}") for n in N.MODALITIES])
    return _recall(d, 20).withColumnRenamed("score", "base").join(q, "query_id").join(c, "image_name")


_HEAD = f"""head AS (SELECT query_id, image_name, score AS base FROM recalled QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) <= 20),
    joined AS (SELECT query_id, h.image_name, base, {_SIDES} FROM head h JOIN modal q ON q.vec_id = query_id JOIN modal c ON c.image_name = h.image_name)"""


@query("pair_features", f"WITH {_HEAD}, {pair_sql('joined', 'query_id, image_name')} SELECT query_id, image_name, {_sql_list('[base, f1, f2, f3, f4, f5, f6, f7, f8, f9]')} AS features FROM featured")
def _(d):
    return N.pair_features(_head_pairs(d)).select("query_id", "image_name", _listed(F.col("features")).alias("features"))


@query("mine_positives", "SELECT a.image_name, b.image_name AS partner FROM vectors a JOIN vectors b ON a.style_code = b.style_code AND (a.image_name <> b.image_name OR (SELECT count(*) FROM vectors x WHERE x.style_code = a.style_code) = 1)")
def _(d):
    return N.mine_positives(d.modal())


_HARD = """clip_sims AS (SELECT q.image_name, c.image_name AS partner, round(list_dot_product(q.clip, c.clip), 12) AS s FROM modal q JOIN modal c ON q.style_code <> c.style_code),
    hard AS (SELECT image_name, partner FROM clip_sims QUALIFY row_number() OVER (PARTITION BY image_name ORDER BY s DESC, partner) <= 16)"""


@query("mine_hard_negatives", f"WITH {_HARD} SELECT image_name, partner FROM hard")
def _(d):
    return N.mine_hard_negatives(d.modal())


@query("mine_hard_negatives_by_cells", f"WITH {_HARD} SELECT image_name, partner FROM hard")
def _(d):
    return N.mine_hard_negatives(d.modal(), max_broadcast_rows=0)


@query("labelled_pairs", """WITH asked AS (SELECT 'q' || vec_id AS image_name, clip, CASE WHEN vec_id % 11 = 0 THEN '' WHEN vec_id % 11 = 1 THEN 'ZZ-1' ELSE style_code END AS style_code FROM modal),
    known AS (SELECT * FROM asked WHERE style_code IN (SELECT style_code FROM modal)),
    others AS (SELECT q.image_name, c.image_name AS partner, round(list_dot_product(q.clip, c.clip), 12) AS s FROM known q JOIN modal c ON q.style_code <> c.style_code)
    SELECT image_name, partner, false AS positive FROM others QUALIFY row_number() OVER (PARTITION BY image_name ORDER BY s DESC, partner) <= 24
    UNION ALL SELECT q.image_name, c.image_name, true FROM known q JOIN modal c USING (style_code)""")
def _(d):
    """Every vector is a labelled query; some labels are blank, some name no code."""
    m, n = d.modal(), F.col("vec_id") % 11
    code = F.when(n == 0, " ").when(n == 1, "ZZ-1").otherwise(F.concat(F.lit(" "), "style_code"))
    labels = m.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("image_name"), code.alias("style_code"), "clip")
    positives, negatives = N.labelled_pairs(labels, m)
    return positives.withColumn("positive", F.lit(True)).unionByName(negatives.withColumn("positive", F.lit(False)))


def _training(d: Data):
    m = d.modal()
    views = m.withColumn("view", F.lit(0))
    return N.training_pairs(views, m, N.mine_positives(m, per_image=64), N.mine_hard_negatives(m), stored=True)


@query("train_reranker")
def _(d):
    pairs = _training(d)
    return N.training_metrics(pairs, N.train_reranker(pairs))


@query("training_metrics", f"""WITH {_HARD}, marked AS (SELECT image_name, partner, 0.0 AS label FROM hard UNION ALL
      SELECT a.image_name, b.image_name, 1.0 FROM vectors a JOIN vectors b ON a.style_code = b.style_code AND (a.image_name <> b.image_name OR (SELECT count(*) FROM vectors x WHERE x.style_code = a.style_code) = 1)),
    joined AS (SELECT label, list_dot_product(q.clip, c.clip) AS base, {_SIDES} FROM marked m JOIN modal q ON q.image_name = m.image_name JOIN modal c ON c.image_name = partner),
    {pair_sql('joined', 'label')}
    SELECT count(*) AS samples, round(avg(label)::DOUBLE, 4) AS pos_rate, round(avg((({model_sql(MODEL)} >= 0.5) = (label = 1))::INT), 4) AS train_acc FROM featured""")
def _(d):
    m = d.modal()
    return N.code_metrics(m.withColumn("view", F.lit(0)), m, N.mine_hard_negatives(m), MODEL)


@query("rerank", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) AS rank FROM recalled),
    f AS (SELECT *, rank <= 40 AND row_number() OVER (PARTITION BY query_id, style_code ORDER BY rank) = 1 AS lead FROM r),
    cut AS (SELECT * FROM (SELECT *, sum(lead::INT) OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM f) WHERE rank > 40 OR (lead AND nth <= 12)),
    joined AS (SELECT query_id, h.image_name, rank, score AS base, {_SIDES} FROM cut h JOIN modal q ON q.vec_id = query_id JOIN modal c ON c.image_name = h.image_name),
    {pair_sql('joined', 'query_id, image_name, rank')}
    SELECT query_id, image_name, round(CASE WHEN rank <= 40 THEN 0.6::DOUBLE * base + 0.4::DOUBLE * {model_sql(MODEL)} ELSE base END, 6) AS score FROM featured""")
def _(d):
    m = d.modal()
    q = m.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("view"), *N.MODALITIES)
    c = m.select("image_name", F.lit(0).alias("view"), *N.MODALITIES)
    return _rounded(N.rerank(_recall(d), q, c, MODEL, top_n=40, weight=0.4, max_unique_codes=12), "score")


@query("ranking_eval", f"""WITH {SEARCHED}, firsts AS (SELECT v.vec_id, min(rank) AS pos FROM vectors v LEFT JOIN (SELECT * FROM searched WHERE rank <= 9) s ON s.query_id = v.vec_id AND s.style_code = v.style_code GROUP BY ALL)
    SELECT count(*) AS queries, round(avg((pos IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / pos, 0)), 6) AS mrr FROM firsts""")
def _(d):
    truth = d.vectors().select(F.col("vec_id").alias("query_id"), "style_code")
    return _rounded(N.ranking_eval(_search(d), truth, 9), "hit_rate", "mrr")


# ---- steps defined by settings ----------------------------------------------------------------------------------------

_RESULT = f"{SEARCHED}, result AS (SELECT query_id, style_code, rank_score, rank FROM searched WHERE rank <= 10)"
_MARGINS = """margins AS (SELECT v.vec_id AS query_id, max(CASE WHEN rank = 1 THEN rank_score END) AS top1,
    round(max(CASE WHEN rank = 1 THEN rank_score END) - coalesce(max(CASE WHEN rank = 2 THEN rank_score END), 0), 6) AS margin
    FROM vectors v LEFT JOIN result r ON r.query_id = v.vec_id GROUP BY ALL)"""


@query("confidence_band", f"""WITH {_RESULT}, {_MARGINS} SELECT query_id, top1, margin, CASE WHEN margin >= 0.10::DOUBLE THEN 'high' WHEN margin >= 0.03::DOUBLE THEN 'medium' ELSE 'low' END AS band,
    coalesce(margin < 0.06::DOUBLE OR top1 < 0.78::DOUBLE, true) AS is_ambiguous FROM margins""")
def _(d):
    return R.confidence_band(d.queries(), _search(d))


@query("adaptive_second_pass", f"""WITH {_RESULT}, {_MARGINS}, weak AS (SELECT query_id FROM margins WHERE top1 < 0.72::DOUBLE OR margin < 0.35::DOUBLE),
    again AS (SELECT query_id, style_code, round(raw_score, 6) AS rank_score FROM code_scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 6) DESC, style_code) <= 20)
    SELECT query_id, style_code, rank_score FROM result WHERE query_id NOT IN (SELECT query_id FROM weak)
    UNION ALL SELECT query_id, style_code, rank_score FROM again WHERE query_id IN (SELECT query_id FROM weak)""")
def _(d):
    again = SearchSettings(top_k=20, recall_cap=90, min_score=-9.0)
    first = _search(d)
    return R.adaptive_second_pass(
        d.queries(), first, lambda q: search_styles(q, d.images(), again), margin_below=0.35
    ).select("query_id", "style_code", "rank_score")


def _shape_sims(d: Data, rows):
    """Shape similarity of every row (query_id, image_name)."""
    m = d.modal()
    q = m.select(F.col("vec_id").alias("query_id"), F.col("shape").alias("q"))
    pairs = rows.select("query_id", "image_name").join(q, "query_id").join(m.select("image_name", F.col("shape").alias("c")), "image_name")
    dot = F.aggregate(F.zip_with("q", "c", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select("query_id", "image_name", dot.alias("sim"))


@query("consistency_boost", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) AS rank FROM recalled)
    SELECT query_id, r.image_name, round(score + CASE WHEN rank <= 40 THEN 0.08::DOUBLE * list_dot_product(q.shape, c.shape) ELSE 0 END, 6) AS score
    FROM r JOIN modal q ON q.vec_id = query_id JOIN modal c ON c.image_name = r.image_name""")
def _(d):
    rows = _recall(d)
    return _rounded(R.consistency_boost(rows, _shape_sims(d, rows), 0.08, 40), "score")


_HASHES = """hashes AS (SELECT vec_id, image_name, bit_or(CASE WHEN v > mean THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END) AS hash FROM (SELECT vec_id, image_name, i, embedding[i + 1] AS v,
    avg(embedding[i + 1]) OVER (PARTITION BY vec_id) AS mean FROM vectors, generate_series(0, 63) g(i)) GROUP BY ALL)"""


@query("hash_boost", f"""WITH {_HASHES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) AS rank FROM recalled)
    SELECT query_id, r.image_name, round(score + CASE WHEN rank <= 40 THEN 0.06::DOUBLE * (1 - bit_count(xor(a.hash, b.hash)) / 64.0::DOUBLE) ELSE 0 END, 6) AS score
    FROM r JOIN hashes a ON a.vec_id = query_id JOIN hashes b ON b.image_name = r.image_name""")
def _(d):
    cells = d.vectors().select("vec_id", "image_name", F.posexplode("embedding").alias("cell", "value"))
    hashes = R.average_hash(cells.select(F.col("image_name").alias("image_id"), "cell", "value")).withColumnRenamed("image_id", "image_name")
    of_query = hashes.join(d.vectors().select(F.col("vec_id").alias("query_id"), "image_name"), "image_name").select("query_id", "hash")
    return _rounded(R.hash_boost(_recall(d), of_query, hashes, 0.06, 40), "score")


# The best 50 images of each query by shape alone are a list of its own here, as a region search returns one.
_SHAPE = """shape_sims AS (SELECT query_id, image_name, sim FROM (SELECT q.vec_id AS query_id, c.image_name, round(list_dot_product(q.shape, c.shape), 12) AS sim FROM modal q, modal c)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, image_name) <= 50)"""
_REGION = f"""{_SHAPE}, region AS (SELECT query_id, image_name, sim AS score, regexp_replace(image_name, '_[^_]*$', '') AS style_code FROM shape_sims),
    strong AS (SELECT query_id, style_code, max(score) AS score FROM region WHERE score >= 0.1::DOUBLE GROUP BY query_id, style_code QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, style_code) <= 8)"""


def _region(d: Data):
    m = d.modal()
    q = m.select(F.col("vec_id").alias("query_id"), F.col("shape").alias("embedding"))
    return V.topk_vectors(q, m.select("image_name", F.col("shape").alias("embedding")), 50)


@query("region_code_prior", f"WITH {_REGION} SELECT query_id, style_code AS code, round(0.08::DOUBLE * 0.45, 6) AS boost FROM strong")
def _(d):
    return _rounded(R.region_code_prior(_region(d), min_score=0.1, match_mode="exact"), "boost")


@query("region_rescue", f"""WITH {_RESULT}, {_REGION} SELECT query_id, style_code, rank_score FROM result UNION ALL
    SELECT query_id, style_code, round(score, 6) FROM strong ANTI JOIN result USING (query_id, style_code)""")
def _(d):
    return _rounded(R.region_rescue(_search(d), _region(d), min_score=0.1), "rank_score")


_SEEDS = f"""{_REGION}, seeds AS (SELECT query_id, image_name, 0.92::DOUBLE + 0.24::DOUBLE * score AS seed FROM region WHERE score >= 0.1::DOUBLE),
    fresh AS (SELECT query_id, image_name, seed FROM seeds ANTI JOIN recalled USING (query_id, image_name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seed DESC, image_name) <= 16),
    seeded_rows AS (SELECT query_id, image_name, greatest(score, coalesce(seed, score)) AS score, false AS seeded FROM recalled LEFT JOIN seeds USING (query_id, image_name)
      UNION ALL SELECT query_id, image_name, seed, true FROM fresh)"""


def _seeded(d: Data):
    return R.seed_candidates(_recall(d), _region(d), 0.92, 0.24, 0.1, 16)


@query("seed_candidates", f"WITH {_SEEDS} SELECT query_id, image_name, round(score, 6) AS score, seeded FROM seeded_rows")
def _(d):
    return _rounded(_seeded(d), "score")


@query("suppress_seeds", f"""WITH {_SEEDS}, sure AS (SELECT query_id FROM region WHERE score >= 0.25::DOUBLE GROUP BY query_id HAVING count(*) >= 3)
    SELECT query_id, image_name, round(score, 6) AS score, seeded FROM seeded_rows WHERE NOT seeded OR query_id NOT IN (SELECT query_id FROM sure)""")
def _(d):
    return _rounded(R.suppress_seeds(_seeded(d), _region(d), 0.25, 3), "score")


def _boxes(d: Data):
    """A screen rectangle per order line."""
    p = d.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 6).alias("left"), (F.col("l_partkey") % 300).cast("double").alias("top"),
        (F.col("l_suppkey") % 97 + 5).cast("double").alias("width"), (F.col("l_orderkey") % 89 + 5).cast("double").alias("height"),
    )
    rect = {n: F.col(n) for n in ("left", "top", "width", "height")}
    box = {"width": F.lit(375.0), "height": F.lit(400.0)}
    image = {"width": F.lit(800.0), "height": F.lit(600.0) + F.col("l_linenumber") * 100}
    return p.withColumn("r", R.crop_ratio(rect, box, image))


_FOUR = ("x", "y", "w", "h")
_BOXES = """src AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 6 AS l, (l_partkey % 300)::DOUBLE AS t, (l_suppkey % 97 + 5)::DOUBLE AS bw, (l_orderkey % 89 + 5)::DOUBLE AS bh,
      least(375.0::DOUBLE / 800, 400.0::DOUBLE / (600 + l_linenumber * 100)) AS fit, (600 + l_linenumber * 100) AS ih FROM lineitem),
    drawn AS (SELECT *, 800 * fit AS dw, ih * fit AS dh FROM src), pads AS (SELECT *, (375 - dw) / 2 AS ox, (400 - dh) / 2 AS oy FROM drawn),
    edges AS (SELECT *, greatest(l, ox) AS x0, greatest(t, oy) AS y0, least(l + bw, ox + dw) AS x1, least(t + bh, oy + dh) AS y1 FROM pads),
    boxes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(1, (x0 - ox) / dw)) AS x, greatest(0, least(1, (y0 - oy) / dh)) AS y, greatest(0, least(1, (x1 - x0) / dw)) AS w,
      greatest(0, least(1, (y1 - y0) / dh)) AS h FROM edges WHERE bw >= 20 AND bh >= 20 AND x1 - x0 >= 20 AND y1 - y0 >= 20)"""
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ROUND4 = ", ".join(f"round({c}, 9) AS {c}" for c in _FOUR)


def _flat(df, column, extra=()):
    return df.filter(F.col(column).isNotNull()).select(
        *_KEYS.split(", "), *[F.round(F.col(f"{column}.{c}"), 9).alias(c) for c in _FOUR], *[F.col(f"{column}.{c}").alias(c) for c in extra]
    )


@query("crop_ratio", f"""WITH {_BOXES}, judged AS (SELECT *, bw >= 20 AND bh >= 20 AND x1 - x0 >= 20 AND y1 - y0 >= 20 AS ok FROM edges)
    SELECT {_KEYS}, CASE WHEN ok THEN round(greatest(0, least(1, (x0 - ox) / dw)), 9) END AS x, CASE WHEN ok THEN round(greatest(0, least(1, (y0 - oy) / dh)), 9) END AS y,
      CASE WHEN ok THEN round(greatest(0, least(1, (x1 - x0) / dw)), 9) END AS w, CASE WHEN ok THEN round(greatest(0, least(1, (y1 - y0) / dh)), 9) END AS h FROM judged""")
def _(d):
    """Too small boxes are null."""
    return _boxes(d).select(*_KEYS.split(", "), *[F.round(F.col(f"r.{c}"), 9).alias(c) for c in _FOUR])


_GROWN = """grown AS (SELECT *, greatest(0.01::DOUBLE, least(1, w * 2)) AS gw, greatest(0.01::DOUBLE, least(1, h * 2.4::DOUBLE)) AS gh FROM boxes)"""


@query("expand_crop", f"""WITH {_BOXES}, {_GROWN} SELECT {_KEYS}, round(greatest(0, least(1 - gw, x + w / 2 - gw / 2)), 9) AS x, round(greatest(0, least(1 - gh, y + h / 2 - gh / 2)), 9) AS y,
    round(gw, 9) AS w, round(gh, 9) AS h FROM grown""")
def _(d):
    return _flat(_boxes(d).withColumn("e", R.expand_crop(F.col("r"))), "e")


@query("crop_mode", f"""WITH {_BOXES}, s0 AS (SELECT *, greatest(w, 0.38::DOUBLE) AS w0, greatest(h, 0.38::DOUBLE) AS h0, w >= h * 1.8::DOUBLE AS strip FROM boxes),
    s1 AS (SELECT *, sqrt(greatest(1, 0.14::DOUBLE / (w0 * h0))) AS k FROM s0),
    s2 AS (SELECT *, greatest(0.01::DOUBLE, least(1, w0 * k)) AS gw, CASE WHEN strip THEN greatest(h, least(greatest(0.01::DOUBLE, least(1, h0 * k)), 0.42::DOUBLE)) ELSE greatest(0.01::DOUBLE, least(1, h0 * k)) END AS gh FROM s1)
    SELECT {_KEYS}, round(greatest(0, least(1 - gw, x + w / 2 - gw / 2)), 9) AS x, round(greatest(0, least(1 - gh, y + h / 2 - gh / 2)), 9) AS y, round(gw, 9) AS w, round(gh, 9) AS h,
      w * h <= 0.1::DOUBLE AND gw * gh >= w * h * 1.6::DOUBLE AS strict_small, strip FROM s2""")
def _(d):
    return _flat(_boxes(d).withColumn("e", R.crop_mode(F.col("r"))), "e", ("strict_small", "strip"))


@query("weights_for_query", """SELECT event_id, event_type AS mode, CASE WHEN event_id % 3 = 0 THEN '0.82|0.06|0.02|0.1' ELSE '0.3|0.3|0.1|0.3' END AS weights FROM events""".replace(
    "event_type AS mode", "CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'strip' END AS mode"))
def _(d):
    mode = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.lit("strip"))
    q = d.table("events").select("event_id", mode.alias("mode"))
    return R.weights_for_query(q).select("event_id", "mode", F.array_join(F.col("weights").cast("array<string>"), "|").alias("weights"))


@query("pca_reduce", """SELECT vec_id, round(sqrt(list_dot_product(embedding, embedding)), 6) AS length,
    round(list_dot_product(embedding, lead(embedding) OVER (ORDER BY vec_id)), 6) AS to_next FROM vectors""")
def _(d):
    """All components: a rotation, which keeps lengths and the products of neighbours."""
    v = d.vectors().select(F.col("vec_id").cast("string").alias("key"), "embedding")
    p = R.pca_reduce(v, 64).select(F.col("key").cast("bigint").alias("vec_id"), "embedding")
    after = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return p.join(after, "vec_id", "left").select("vec_id", F.round(X.norm(F.col("embedding")), 6).alias("length"), F.round(X.dot(F.col("embedding"), F.col("next")), 6).alias("to_next"))


@query("quantize_int8", """WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x))) / 127 AS step FROM vectors)
    SELECT vec_id, round(step, 9) AS step, array_to_string(list_transform(embedding, lambda x: round_even(x / step, 0)::INT), '|') AS codes FROM s""")
def _(d):
    q = X.quantize_int8(F.col("embedding"))
    return d.vectors().select("vec_id", q.alias("q")).select(
        "vec_id", F.round("q.step", 9).alias("step"), F.array_join(F.col("q.codes").cast("array<string>"), "|").alias("codes"))


_NEAR_AXES = """shifted AS (SELECT vec_id, image_name, list_transform(generate_series(1, 64), lambda i: embedding[i] * 0.1::DOUBLE + CASE WHEN i % 10 = style_code[4]::INT THEN 0.5 ELSE 0 END) AS e FROM vectors)"""


@query("topk_clustered", f"""WITH {_NEAR_AXES}, s AS (SELECT q.vec_id AS query_id, c.image_name, round(list_dot_product(q.e, c.e), 12) AS score FROM shifted q, shifted c)
    SELECT query_id, image_name, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) <= 20""")
def _(d):
    """Vectors that lie near ten directions, where most products end early (counted in tests/test_pruning.py)."""
    at = F.substring("style_code", 4, 1).cast("int")
    shifted = F.transform("embedding", lambda v, i: v * 0.1 + F.when((i + 1) % 10 == at, F.lit(0.5)).otherwise(F.lit(0.0)))
    v = d.vectors().select("vec_id", "image_name", shifted.alias("embedding"))
    return _rounded(V.topk_vectors(v.select(F.col("vec_id").alias("query_id"), "embedding"), v.select("image_name", "embedding"), 20), "score")


def _probed(d: Data):
    """(index, found): the 20 best of every vector at a quarter of the cells, by an index written and read again."""
    folder = work_folder(d.spark)
    I.write_ivf(I.build_ivf(d.images().withColumnRenamed("image_name", "key")), folder)
    index = I.read_ivf(d.spark, folder)
    return index, checkpointed(I.search_ivf(d.queries(), index, 20, index.cells // 4).withColumnRenamed("key", "image_name"))


def _exact(d: Data):
    return V.topk_vectors(d.queries(), d.images(), 20)


@query("ivf_topk")
def _(d):
    """With the share of the exact rows that each query found."""
    found = _probed(d)[1]
    return _rounded(found.join(I.recall(found, _exact(d)), "query_id"), "score")


@query("ivf_recall", """SELECT count(*) AS queries, true AS recall_reached, true AS quarter_of_cells, 0 AS wrong_scores, count(*) * 20 AS found FROM vectors""")
def _(d):
    """A recall of 0.9 or more at a quarter of the cells, and every score the exact product."""
    index, found = _probed(d)
    per_query = I.recall(found, _exact(d)).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_reached"), F.lit((index.cells // 4) * 4 <= index.cells).alias("quarter_of_cells"), F.lit(1).alias("one"))
    sides = found.join(d.queries().withColumnRenamed("embedding", "q"), "query_id").join(d.images(), "image_name")
    wrong = F.count_if(F.abs(X.dot(F.col("q"), F.col("embedding")) - F.col("score")) > 1e-9).cast("int")
    return per_query.join(F.broadcast(sides.agg(wrong.alias("wrong_scores"), F.count("*").alias("found"), F.lit(1).alias("one"))), "one").drop("one")


@query("ivf_topk_full_probe", "SELECT query_id, image_name, round(score, 6) AS score FROM recalled QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) <= 20")
def _(d):
    """All cells, and all rows scored again: the exact rows."""
    return _rounded(R.ivf_topk(d.queries(), d.images(), 20, clusters=8, nprobe=8, rescore=10**6), "score")


@query("search_styles_by_index", """SELECT count(DISTINCT vec_id) AS queries, true AS agree FROM vectors""")
def _(d):
    """Photo search on a stored index: the first code of nine in ten queries or more is that of the exact search."""
    index = I.build_ivf(d.images().withColumnRenamed("image_name", "key"))
    by_index = search_styles(d.queries(), d.images(), index=index, nprobe=max(1, index.cells // 4)).filter("rank = 1")
    exact = search_styles(d.queries(), d.images()).filter("rank = 1").select("query_id", F.col("style_code").alias("code"))
    both = exact.join(by_index, "query_id", "left")
    return both.agg(F.count("*").alias("queries"), (F.avg(F.coalesce((F.col("code") == F.col("style_code")).cast("double"), F.lit(0.0))) >= 0.9).alias("agree"))
