"""The engine's operators applied to the driver's tables, each with its SQL where SQL can express it.

Stand-ins: ``embeddings`` are clips with a category, ``documents`` are text clips, ``labels`` a label file
(quality 1 good, 0 bad), ``events`` a log of clicks (purchase good, error bad; a clip is a user).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions import scalars as S
from corvid.functions.vectors import cosine, mean_vector
from corvid.operators import collections, datasets, evaluate, extract, labels, metrics, mlp, progress, search, thresholds, training, views
from corvid.operators.embed import WRAPPERS, HashingEmbedder, embedded
from corvid.schema import DETECTORS, EXTENSIONS, MIME
from corvid.sinks import files as sinks
from corvid.storage import durable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- stand-ins


def clips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip_id"), "embedding", F.col("label").alias("category"))


def text_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as clips: the origin is the source, the origin name the language and size."""
    d = table(spark, sf, "documents")
    origin = F.struct(F.lit("folder").alias("importer"), F.create_map(F.lit("path"), F.col("source")).alias("params"))
    return d.select(
        F.col("doc_id").alias("clip_id"), F.lit("paragraph").alias("type"), F.md5("text").alias("md5"), origin.alias("origin"),
        F.concat_ws("_", "lang", F.col("n_chars").cast("string")).alias("origin_name"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("lang").alias("category"), F.col("text").alias("clip_string"),
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """The label file: English entries name a hash, the others an origin; toxic ones have a label that isn't valid."""
    d = text_clips(spark, sf)
    rows = table(spark, sf, "labels").join(d, F.col("doc_id") == F.col("clip_id"))
    en = F.col("category") == "en"
    return rows.select(
        F.col("doc_id").alias("entry_id"), F.when(F.col("toxic") == 1, "maybe").when(F.col("quality") == 1, "good").otherwise("bad").alias("label"),
        F.when(en, F.col("md5")).alias("md5"), F.when(~en, F.col("origin")).alias("origin"), F.when(~en, F.col("origin_name")).alias("origin_name"),
    )


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "good").otherwise("bad").alias("vote"))


_E = "CAST(embedding AS DOUBLE[])"
_Q0 = f"(SELECT {_E} AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_SIM = f"SELECT vec_id AS clip_id, label AS category, list_cosine_similarity({_E}, q) AS sim FROM embeddings, {_Q0}"
_CLIPS = """SELECT doc_id AS clip_id, md5(text) AS md5, source AS origin, lang || '_' || n_chars AS origin_name, lang AS category FROM documents"""
_ENTRIES = f"""SELECT l.doc_id AS entry_id, CASE WHEN toxic = 1 THEN 'maybe' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label,
  CASE WHEN category = 'en' THEN md5 END AS md5, CASE WHEN category <> 'en' THEN origin END AS origin,
  CASE WHEN category <> 'en' THEN origin_name END AS origin_name FROM labels l JOIN ({_CLIPS}) c ON l.doc_id = c.clip_id"""
_MATCH = f"""SELECT entry_id, clip_id, min(kind) AS kind FROM (
  SELECT entry_id, clip_id, 0 AS kind FROM ({_ENTRIES}) e JOIN ({_CLIPS}) c ON e.origin = c.origin AND e.origin_name = c.origin_name
  UNION ALL SELECT entry_id, clip_id, 1 FROM ({_ENTRIES}) e JOIN ({_CLIPS}) c ON e.md5 = c.md5) GROUP BY 1, 2"""
_CLICKS = """SELECT user_id AS clip_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'good' ELSE 'bad' END AS vote
  FROM events WHERE event_type IN ('purchase', 'error')"""
_TOGGLED = f"""SELECT clip_id, seq, CASE WHEN row_number() OVER (PARTITION BY clip_id, vote, run ORDER BY seq) % 2 = 1 THEN vote ELSE 'unlabel' END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY seq) - row_number() OVER (PARTITION BY clip_id, vote ORDER BY seq) AS run FROM ({_CLICKS}))"""
_CURRENT = f"SELECT clip_id, arg_max(label, seq) AS label, max(seq) AS seq FROM ({_TOGGLED}) GROUP BY 1 HAVING arg_max(label, seq) <> 'unlabel'"


def _first_vector(spark: SparkSession, sf: str) -> DataFrame:
    return clips(spark, sf).orderBy("clip_id").limit(1)


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    q = _first_vector(spark, sf).select(F.col("embedding").alias("q"))
    return clips(spark, sf).crossJoin(F.broadcast(q)).select("clip_id", "category", cosine(F.col("embedding"), F.col("q")).alias("sim"))


# --- search


@query(f"SELECT clip_id, round(sim, 4) AS similarity FROM ({_SIM}) ORDER BY similarity DESC, clip_id LIMIT 10")
def similarity_topk(spark, sf):
    return search.example_sort(clips(spark, sf), _first_vector(spark, sf), limit=10)


@query(f"SELECT clip_id, round(sim, 4) AS similarity FROM ({_SIM})")
def example_sort(spark, sf):
    return search.example_sort(clips(spark, sf), _first_vector(spark, sf))


@query(f"""SELECT category, rk, clip_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY similarity DESC, clip_id) AS rk
  FROM (SELECT category, clip_id, round(sim, 4) AS similarity FROM ({_SIM}))) WHERE rk <= 3""")
def similarity_per_category(spark, sf):
    s = _similar(spark, sf).select("category", "clip_id", F.round("sim", 4).alias("similarity"))
    rk = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("similarity"), "clip_id"))
    return s.withColumn("rk", rk.cast("long")).where("rk <= 3").select("category", "rk", "clip_id", "similarity")


# --- detectors: weights by rule, so that both sides have the same literals


def _model(k: int, dim: int = 64, hidden: int = 8) -> mlp.Mlp:
    j, i = np.arange(hidden)[:, None], np.arange(dim)[None]
    return mlp.Mlp(((j * 7 + i * 3 + k * 5) % 11 - 5) / 4.0, (np.arange(hidden) % 3 - 1) / 10.0, ((np.arange(hidden) * 5 + k) % 7 - 3) / 2.0, 0.1 * k)


_THRESHOLDS = (0.5, 0.6, 0.99999)


def detectors(spark: SparkSession, n: int = 3) -> DataFrame:
    rows = [(f"detector_{k}", "audio", *_model(k).as_row().values(), _THRESHOLDS[k], None) for k in range(n)]
    return spark.createDataFrame(rows, DETECTORS)


def _score_sql(k: int) -> str:
    m = _model(k)
    lit = lambda v: "[" + ",".join(repr(float(x)) for x in v) + "]::DOUBLE[]"
    parts = [f"{float(m.w2[j])!r}::DOUBLE * greatest(list_dot_product({_E}, {lit(m.w0[j])}) + ({float(m.b0[j])!r}), 0)" for j in range(len(m.w2))]
    return f"1 / (1 + exp(-({' + '.join(parts)} + {m.b2!r})))"


_SCORES = " UNION ALL ".join(f"SELECT vec_id AS clip_id, 'detector_{k}' AS detector, {_score_sql(k)} AS raw, {_THRESHOLDS[k]!r}::DOUBLE AS threshold FROM embeddings" for k in range(3))


@query(f"SELECT vec_id AS clip_id, round({_score_sql(0)}, 4) AS score FROM embeddings")
def detector_sort(spark, sf):
    s = search.detector_scores(clips(spark, sf), detectors(spark, 1))
    return s.select("clip_id", F.round("raw", 4).alias("score")).orderBy(F.desc("score"), "clip_id")


@query(f"SELECT clip_id, round(raw, 4) AS score FROM ({_SCORES}) WHERE detector = 'detector_0' AND raw >= threshold")
def detector_hits(spark, sf):
    return search.hits(search.detector_scores(clips(spark, sf), detectors(spark, 1))).select("clip_id", "score")


@query(f"""SELECT detector, rank, clip_id, score FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY score DESC, clip_id) AS rank
  FROM (SELECT detector, clip_id, round(raw, 4) AS score FROM ({_SCORES}) WHERE raw >= threshold))""")
def multi_detector_hits(spark, sf):
    return search.hits(search.detector_scores(clips(spark, sf), detectors(spark))).select("detector", F.col("rank").cast("long").alias("rank"), "clip_id", "score")


@query(f"SELECT detector, count(*) FILTER (WHERE raw >= threshold) AS total_hits FROM ({_SCORES}) GROUP BY 1")
def detector_hit_counts(spark, sf):
    d = detectors(spark)
    return search.hit_counts(search.detector_scores(clips(spark, sf), d), d)


@query(f"""SELECT detector, 'clip_' || clip_id AS filename, CAST(label AS VARCHAR) AS category, round(raw, 4) AS score, 'set(' || label || ')' AS origin
  FROM ({_SCORES}) s JOIN embeddings e ON e.vec_id = s.clip_id WHERE raw >= threshold""")
def hits_export_rows(spark, sf):
    origin = F.struct(F.lit("set").alias("importer"), F.create_map(F.lit("label"), F.col("category").cast("string")).alias("params"))
    none = F.lit(None).cast("string")
    own = clips(spark, sf).select("clip_id", none.alias("filename"), F.col("category").cast("string").alias("category"), origin.alias("origin"), none.alias("origin_name"), none.alias("md5"))
    hit = search.hit_rows(search.hits(search.detector_scores(clips(spark, sf), detectors(spark))), own)
    return sinks.hits_csv_rows(hit).select("detector", "filename", "category", "score", "origin")


@query(f"SELECT detector, count(*) FILTER (WHERE raw >= threshold) AS total_hits, coalesce(max(round(raw, 4)) FILTER (WHERE raw >= threshold), -1) AS best FROM ({_SCORES}) GROUP BY 1")
def results_document(spark, sf):
    d = detectors(spark)
    doc = search.results_document(search.hits(search.detector_scores(clips(spark, sf), d)), d)
    return doc.select("detector", F.col("total_hits").cast("long").alias("total_hits"), F.coalesce(F.get("hits", F.lit(0))["score"], F.lit(-1.0)).alias("best"))


# --- labels


@query(_MATCH.replace("min(kind) AS kind", "CAST(min(kind) AS BIGINT) AS kind"))
def label_resolution(spark, sf):
    return labels.resolve(entries(spark, sf), text_clips(spark, sf)).withColumn("kind", F.col("kind").cast("long"))


@query(f"SELECT entry_id, arg_min(clip_id, kind * 1000000000000 + clip_id) AS clip_id FROM ({_MATCH}) GROUP BY 1")
def label_first_match(spark, sf):
    return labels.first_match(labels.resolve(entries(spark, sf), text_clips(spark, sf)))


@query("SELECT item_id AS entry_id, md5(b.text) AS md5 FROM benchmark b WHERE md5(b.text) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL)")
def label_missing(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), F.md5("text").alias("md5"), F.lit("good").alias("label"), F.lit(None).cast("struct<importer:string,params:map<string,string>>").alias("origin"), F.lit(None).cast("string").alias("origin_name"))
    return labels.missing(b, labels.resolve(b, text_clips(spark, sf))).select("entry_id", "md5")


@query(f"""SELECT count(*) FILTER (WHERE label <> 'maybe' AND hit) AS applied, count(*) FILTER (WHERE label <> 'maybe' AND NOT hit) AS missing,
  count(*) FILTER (WHERE label = 'maybe') AS skipped FROM (SELECT label, entry_id IN (SELECT entry_id FROM ({_MATCH})) AS hit FROM ({_ENTRIES}))""")
def label_apply_counts(spark, sf):
    e = entries(spark, sf)
    return labels.apply_counts(e, labels.resolve(e, text_clips(spark, sf)))


@query(f"SELECT clip_id, arg_max(label, e.entry_id) AS label FROM ({_ENTRIES}) e JOIN ({_MATCH}) m ON e.entry_id = m.entry_id WHERE label <> 'maybe' GROUP BY 1")
def labels_applied(spark, sf):
    e = entries(spark, sf)
    return labels.apply_labels(e, labels.resolve(e, text_clips(spark, sf)))


@query(f"""SELECT label, count(*) AS n, count(md5) AS hashes FROM ({_ENTRIES}) WHERE label <> 'maybe' GROUP BY 1""")
def labelset_counts(spark, sf):
    return entries(spark, sf).where(labels.valid(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("md5").alias("hashes"))


# --- the vote log


@query(_TOGGLED)
def vote_history_toggle(spark, sf):
    return labels.toggled(clicks(spark, sf))


@query(_CURRENT)
def votes_current(spark, sf):
    return labels.current(labels.toggled(clicks(spark, sf)))


@query(f"""SELECT a.clip_id, click FROM (SELECT clip_id, seq, row_number() OVER (ORDER BY seq) AS click FROM ({_TOGGLED}) WHERE label <> 'unlabel') a
  JOIN ({_CURRENT}) c ON a.clip_id = c.clip_id AND a.seq = c.seq""")
def click_ordinals(spark, sf):
    return labels.click_ordinals(labels.toggled(clicks(spark, sf)))


@query(f"SELECT label, row_number() OVER (PARTITION BY label ORDER BY seq) AS ord, clip_id FROM ({_CURRENT})")
def vote_sets(spark, sf):
    return labels.vote_sets(labels.toggled(clicks(spark, sf)))


@query()
def votes_with_imports(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error", "signup"))
    log = e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "bad").otherwise("good").alias("vote"), (F.col("event_type") == "signup").alias("is_import"))
    return labels.folded(log)


@query("SELECT event_type AS text, max(event_id) AS seq FROM events GROUP BY 1")
def mru_suggestions(spark, sf):
    return labels.recent_texts(table(spark, sf, "events").select(F.col("event_type").alias("text"), F.col("event_id").alias("seq")))


@query(f"""SELECT c.clip_id, c.label, CASE WHEN s.score IS NULL THEN -1 WHEN c.label = 'good' THEN s.score ELSE 1 - s.score END AS confidence
  FROM ({_CURRENT}) c LEFT JOIN (SELECT vec_id, round((1 + list_cosine_similarity({_E}, q)) / 2, 4) AS score FROM embeddings, {_Q0}) s ON c.clip_id = s.vec_id""")
def confidence_sort(spark, sf):
    s = _similar(spark, sf).select("clip_id", F.round((1 + F.col("sim")) / 2, 4).alias("score"))
    rows = labels.current(labels.toggled(clicks(spark, sf))).join(s, "clip_id", "left")
    return labels.sort_labels(rows, "confidence_desc").select("clip_id", "label", "confidence")


# --- datasets


@query("""SELECT doc_id AS clip_id, 'paragraph' AS type, coalesce(source, 'unknown') AS category, strlen(text) AS file_size, md5(text) AS md5, 'clip_' || doc_id AS filename FROM documents""")
def clip_listing(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("clip_id"), F.lit("paragraph").alias("type"), F.coalesce("source", F.lit("unknown")).alias("category"), F.octet_length("text").cast("long").alias("file_size"),
        F.md5("text").alias("md5"), F.concat(F.lit("clip_"), F.col("doc_id").cast("string")).alias("filename"),
    )


_PARTS = "SELECT 0 AS src, doc_id AS pos, md5(text) AS md5 FROM documents UNION ALL SELECT 1, item_id, md5(text) FROM benchmark"


@query(f"""SELECT row_number() OVER (ORDER BY src, pos) AS clip_id, md5 FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY src, pos) AS k FROM ({_PARTS})) WHERE k = 1""")
def dedup_union(spark, sf):
    a = text_clips(spark, sf).select("clip_id", "type", "md5")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("clip_id"), F.lit("paragraph").alias("type"), F.md5("text").alias("md5"))
    return datasets.combine([a, b], ["documents", "benchmark"]).select("clip_id", "md5")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS clip_id FROM documents")
def id_renumber(spark, sf):
    return datasets.renumber(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "clip_id")


@query("""SELECT vec_id AS clip_id, label AS category, CASE WHEN rn <= CASE WHEN n < 2 THEN 0 ELSE least(greatest(round_even(n * 0.25, 0), 1), n - 1) END THEN 'test' ELSE 'simulation' END AS side
  FROM (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || label || ':' || vec_id)) AS rn FROM embeddings)""")
def stratified_split(spark, sf):
    return datasets.stratified_split(clips(spark, sf).select("clip_id", "category"), 0.25, 42)


@query("""SELECT clip_id, category, place FROM (SELECT doc_id AS clip_id, lang AS category, row_number() OVER (PARTITION BY lang ORDER BY 'doc_' || doc_id || '.txt', doc_id) - 1 AS place FROM documents)
  WHERE place >= 5 AND place < 25""")
def category_slice(spark, sf):
    return datasets.category_slice(text_clips(spark, sf), 5, 25).select("clip_id", "category", F.col("place").cast("long").alias("place"))


@query("SELECT max(doc_id) + 1 AS next_id FROM documents")
def next_clip_id(spark, sf):
    return datasets.next_clip_id(text_clips(spark, sf))


@query("SELECT DISTINCT lang AS category FROM documents")
def categories(spark, sf):
    return text_clips(spark, sf).select("category").distinct()


# --- functions


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS words, length(text) AS characters, strlen(text) AS bytes, md5(text) AS md5 FROM documents""")
def text_stats(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", S.word_count(t).alias("words"), F.char_length(t).cast("long").alias("characters"), F.octet_length(t).cast("long").alias("bytes"), F.md5(t).alias("md5"))


@query("SELECT doc_id, nullif(trim(substring(text, 1, 1000)), '') AS clean FROM documents")
def truncate_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.clean_prefix(F.col("text")).alias("clean"))


_PATHS = "SELECT vec_id, 'media/clip_' || vec_id || '.' || list_extract([" + ", ".join(f"'{e}'" for e in sorted(MIME)) + f", 'XYZ'], CAST(vec_id % {len(MIME) + 1} + 1 AS BIGINT)) AS path FROM embeddings"
_EXT = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"


@query(f"SELECT vec_id, path, CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in sorted(MIME.items())) + f" ELSE 'application/octet-stream' END AS mime, CASE {_EXT} "
       + " ".join(f"WHEN '{e}' THEN '{k}'" for k, v in EXTENSIONS.items() for e in v) + f" END AS media_type FROM ({_PATHS})")
def mime_lookup(spark, sf):
    exts = F.array(*[F.lit(e) for e in [*sorted(MIME), "XYZ"]])
    path = F.concat(F.lit("media/clip_"), F.col("vec_id").cast("string"), F.lit("."), F.get(exts, F.pmod("vec_id", F.lit(len(MIME) + 1)).cast("int")))
    rows = table(spark, sf, "embeddings").select("vec_id", path.alias("path"))
    return rows.select("vec_id", "path", S.mime_type(F.col("path")).alias("mime"), S.media_type(F.col("path")).alias("media_type"))


@query("""SELECT page_id, substr(md5(url), 1, 8) || '_' || list_extract(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/'), -1) AS filename FROM pages""")
def url_filenames(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.url_filename(F.col("url")).alias("filename"))


@query("SELECT doc_id AS clip_id, 'folder(' || source || ')' AS origin FROM documents")
def origin_display(spark, sf):
    return text_clips(spark, sf).select("clip_id", S.origin_display(F.col("origin")).alias("origin"))


_WRAPS = ", ".join(f"'{w}'" for w in WRAPPERS["paragraph"])


@query(f"SELECT item_id, replace(w, '{{text}}', substr(text, 1, 20)) AS prompt FROM benchmark, (SELECT unnest([{_WRAPS}]) AS w)")
def wrapped_queries(spark, sf):
    w = F.array(*[F.lit(x) for x in WRAPPERS["paragraph"]])
    return table(spark, sf, "benchmark").select("item_id", F.explode(w).alias("w"), F.substring("text", 1, 20).alias("t")).select("item_id", S.wrapped(F.col("w"), F.col("t")).alias("prompt"))


@query(f"SELECT item_id, replace(w, '{{text}}', text) AS prompt FROM benchmark, (SELECT unnest([{_WRAPS}]) AS w)")
def wrapped_texts(spark, sf):
    w = F.array(*[F.lit(x) for x in WRAPPERS["paragraph"]])
    return table(spark, sf, "benchmark").select("item_id", "text", F.explode(w).alias("w")).select("item_id", S.wrapped(F.col("w"), F.col("text")).alias("prompt"))


@query(f"SELECT label AS category, i AS pos, round(avg(list_extract({_E}, CAST(i + 1 AS BIGINT))), 6) AS mean FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2")
def wrapper_mean_vector(spark, sf):
    m = clips(spark, sf).groupBy("category").agg(mean_vector(64, F.col("embedding").cast("array<double>")).alias("v"))
    return m.select("category", F.posexplode("v").alias("pos", "mean")).select("category", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("""SELECT page_id, array_to_string(CASE WHEN n = 1 THEN [0] ELSE list_transform(range(least(n, 8)), lambda i: CAST(floor(i * (n - 1) / (least(n, 8) - 1)) AS BIGINT)) END, ',') AS frames
  FROM (SELECT page_id, page_id % 30 + 1 AS n FROM pages)""")
def frame_sampling(spark, sf):
    n = F.pmod("page_id", F.lit(30)) + 1
    return table(spark, sf, "pages").select("page_id", F.array_join(S.sample_frames(n).cast("array<string>"), ",").alias("frames"))


# --- metrics


_QUERIES = f"SELECT label AS query, arg_min({_E}, vec_id) AS v FROM embeddings GROUP BY 1"
_RANKED = f"""SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY sim DESC, clip_id) AS rk FROM (
  SELECT q.query, e.vec_id AS clip_id, CAST(e.label = q.query AS INT) AS rel, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS sim FROM embeddings e, ({_QUERIES}) q)"""
_HITS = f"SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rk) AS hits FROM ({_RANKED})"
_AP = f"SELECT query, sum(CASE WHEN rel = 1 THEN hits / rk ELSE 0 END) / sum(rel) AS ap FROM ({_HITS}) GROUP BY 1"


def _eval(spark, sf):
    q = clips(spark, sf).groupBy("category").agg(F.min_by("embedding", "clip_id").alias("vector")).withColumn("query", F.col("category"))
    return metrics.text_sort_eval(clips(spark, sf), q)


@query(f"SELECT query, round(ap, 6) AS average_precision FROM ({_AP})")
def avg_precision(spark, sf):
    return _eval(spark, sf).select("query", F.round("average_precision", 6).alias("average_precision"))


@query(f"""SELECT query, round(sum(rel) FILTER (WHERE rk <= 5) / 5.0, 6) AS p_at_5, round(sum(rel) FILTER (WHERE rk <= 10) / 10.0, 6) AS p_at_10, round(sum(rel) FILTER (WHERE rk <= 20) / 20.0, 6) AS p_at_20,
  round(sum(rel) FILTER (WHERE rk <= 5) / sum(rel), 6) AS r_at_5, round(sum(rel) FILTER (WHERE rk <= 10) / sum(rel), 6) AS r_at_10, round(sum(rel) FILTER (WHERE rk <= 20) / sum(rel), 6) AS r_at_20
  FROM ({_RANKED}) GROUP BY 1""")
def precision_recall_at_k(spark, sf):
    return _eval(spark, sf).select("query", *[F.round(f"{m}_at_{k}", 6).alias(f"{m}_at_{k}") for m in "pr" for k in (5, 10, 20)])


@query(f"SELECT round(avg(ap), 6) AS mean_ap FROM ({_AP})")
def mean_ap(spark, sf):
    return metrics.mean_average_precision(_eval(spark, sf)).select(F.round("mean_ap", 6).alias("mean_ap"))


_JUDGED = "SELECT lang, n_chars >= 1500 AS pred, quality = 1 AS truth FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_COUNTS = f"SELECT lang, count(*) FILTER (WHERE pred AND truth) AS tp, count(*) FILTER (WHERE pred AND NOT truth) AS fp, count(*) FILTER (WHERE NOT pred AND truth) AS fn, count(*) FILTER (WHERE NOT pred AND NOT truth) AS tn FROM ({_JUDGED}) GROUP BY 1"


def _judged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select("lang", (F.col("n_chars") >= 1500).alias("pred"), (F.col("quality") == 1).alias("truth"))


def _ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END"


@query(f"SELECT lang, tp, fp, fn, tn, round({_ratio_sql('tp + tn', '(tp + fp + fn + tn)')}, 6) AS accuracy, round({_ratio_sql('tp', '(tp + fp)')}, 6) AS precision, round({_ratio_sql('tp', '(tp + fn)')}, 6) AS recall, round({_ratio_sql('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1 FROM ({_COUNTS})")
def binary_metrics(spark, sf):
    m = metrics.binary_metrics(_judged(spark, sf), ("lang",))
    return m.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"SELECT lang, round(fpr + 4 * fnr, 4) AS cost, round(fpr, 4) AS fpr, round(fnr, 4) AS fnr FROM (SELECT lang, {_ratio_sql('fp', '(fp + tn)')} AS fpr, {_ratio_sql('fn', '(fn + tp)')} AS fnr FROM ({_COUNTS}))")
def error_cost(spark, sf):
    return metrics.error_cost(_judged(spark, sf), 2, ("lang",))


@query("SELECT l_returnflag AS category, l_linenumber AS t, round(avg(l_discount), 6) AS mean, round(coalesce(stddev_samp(l_discount), 0), 6) AS std, count(*) AS n FROM lineitem GROUP BY 1, 2")
def iteration_mean_std(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("t"), "l_discount")
    m = metrics.mean_and_spread(f, "l_discount", ("category", "t"))
    return m.select("category", "t", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


# --- thresholds


_SCORED = f"SELECT clip_id, category, sim AS score, category = 0 AS good FROM ({_SIM})"
_CUM = f"""SELECT *, sum(CAST(good AS INT)) OVER w AS tp, sum(CAST(NOT good AS INT)) OVER w AS fp, sum(CAST(good AS INT)) OVER () AS p, sum(CAST(NOT good AS INT)) OVER () AS n
  FROM ({_SCORED}) WINDOW w AS (ORDER BY score DESC, clip_id ROWS UNBOUNDED PRECEDING)"""
_BEST = f"SELECT score FROM ({_CUM}) ORDER BY fp / n + (p - tp) / p, score DESC, clip_id LIMIT 1"


def _scored(spark, sf):
    return _similar(spark, sf).select(F.col("clip_id").alias("item_id"), F.col("sim").alias("score"), (F.col("category") == 0).alias("is_good"))


@query(f"SELECT round(score, 6) AS threshold FROM ({_BEST})")
def optimal_threshold(spark, sf):
    return thresholds.optimal_threshold(_scored(spark, sf)).select(F.round("threshold", 6).alias("threshold"))


@query(f"SELECT category, count(*) FILTER (WHERE sim >= 0.05) AS pos FROM ({_SIM}) GROUP BY 1")
def threshold_position(spark, sf):
    return thresholds.position(_similar(spark, sf), F.lit(0.05), "sim", ("category",))


def _voted(spark, sf):
    return labels.current(labels.toggled(clicks(spark, sf)))


@query(f"SELECT clip_id, round(sim, 6) AS score FROM ({_SIM}) WHERE clip_id NOT IN (SELECT clip_id FROM ({_CURRENT})) ORDER BY sim DESC, clip_id LIMIT 1")
def next_clip_top(spark, sf):
    r = _similar(spark, sf).select("clip_id", F.col("sim").alias("score"))
    return search.next_clip_top(r, _voted(spark, sf)).select("clip_id", F.round("score", 6).alias("score"))


@query(f"""SELECT clip_id, round(sim, 6) AS score, idx FROM (SELECT clip_id, sim, row_number() OVER (ORDER BY sim DESC, clip_id) - 1 AS idx FROM ({_SIM})),
  (SELECT count(*) FILTER (WHERE sim >= 0.05) AS t FROM ({_SIM})) WHERE clip_id NOT IN (SELECT clip_id FROM ({_CURRENT})) ORDER BY abs(idx - t), abs(sim - 0.05), idx LIMIT 1""")
def next_clip_hard(spark, sf):
    r = _similar(spark, sf).select("clip_id", F.col("sim").alias("score"))
    return search.next_clip_hard(r, _voted(spark, sf), 0.05).select("clip_id", F.round("score", 6).alias("score"), "idx")


# --- progress: steps are blocks of a thousand events


_PREDS = "SELECT event_id // 1000 AS step, user_id AS clip_id, sum(value) > 100 AS pred FROM events GROUP BY 1, 2"
_COST = "SELECT event_id // 1000 AS step, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS cost, count(*) FILTER (WHERE event_type = 'signup') AS flips FROM events GROUP BY 1"


def _step():
    return F.floor(F.col("event_id") / 1000)


def _costs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(_step().alias("step")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 4).alias("cost"), F.count_if(F.col("event_type") == "signup").alias("flips"))


@query(f"""SELECT step, count(*) FILTER (WHERE s0 = step - 1 AND pred <> p0) AS flips, count(*) FILTER (WHERE s0 = step - 1) AS common
  FROM (SELECT step, pred, lag(pred) OVER w AS p0, lag(step) OVER w AS s0 FROM ({_PREDS}) WINDOW w AS (PARTITION BY clip_id ORDER BY step)) GROUP BY 1""")
def prediction_flips(spark, sf):
    p = table(spark, sf, "events").groupBy(_step().alias("step"), F.col("user_id").alias("clip_id")).agg((F.sum("value") > 100).alias("pred"))
    return progress.flips(p)


_SLOPE = f"SELECT CASE WHEN count(*) < 2 THEN 0.0 ELSE round(regr_slope(cost, CAST(step AS DOUBLE)) / avg(cost), 4) END AS slope, count(*) AS valid FROM ({_COST}), (SELECT count(*) AS n FROM ({_COST})) WHERE step >= n - 10"


@query(f"SELECT slope FROM ({_SLOPE})")
def status_slope(spark, sf):
    c = _costs(spark, sf)
    return progress.status(c, 30, 30, c.count()).select("slope")


@query(f"SELECT CASE WHEN g + b < 20 OR g < 5 OR b < 5 THEN 'red' WHEN valid < 3 OR slope < -0.015 THEN 'yellow' ELSE 'green' END AS status FROM ({_SLOPE}), (SELECT count(*) FILTER (WHERE label = 'good') AS g, count(*) FILTER (WHERE label = 'bad') AS b FROM ({_CURRENT}))")
def labeling_status(spark, sf):
    c, v = _costs(spark, sf), _voted(spark, sf).agg(F.count_if(F.col("label") == "good"), F.count_if(F.col("label") == "bad")).first()
    return progress.status(c, v[0], v[1], c.count()).select("status")


@query(f"""SELECT CASE WHEN n < 5 THEN 'keep' WHEN span / mean < 0.1 AND flips < 5 THEN 'stop' WHEN span / mean < 0.15 THEN 'consider' WHEN flips < 3 THEN 'stable' ELSE 'keep' END AS advice
  FROM (SELECT max(n) AS n, max(cost) - min(cost) AS span, avg(cost) AS mean, avg(flips) AS flips FROM (SELECT *, row_number() OVER (ORDER BY step DESC) AS rn, count(*) OVER () AS n FROM ({_COST})) WHERE rn <= greatest(3, floor(n * 0.3)))""")
def recommendation(spark, sf):
    return progress.recommendation(_costs(spark, sf))


# --- learning: no SQL; tests hold them against brute force and known outcomes


def _votes(spark, sf, n: int = 60):
    """The first votes of a simulated labeller who likes category 0: a vote set of human size is the input here."""
    c = clips(spark, sf).select("clip_id", F.when(F.col("category") == 0, "good").otherwise("bad").alias("label"))
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.sha2(F.col("clip_id").cast("string"), 256)))
    return c.withColumn("rn", rn).where(F.col("rn") <= n // 2).drop("rn")


@query()
def gmm_threshold(spark, sf):
    s = _similar(spark, sf).select(F.col("sim").alias("score"))
    return spark.createDataFrame([(round(thresholds.mixture_threshold(s), 4),)], "threshold double")


@query()
def learned_sort(spark, sf):
    ranked, _, _ = search.learned_sort(clips(spark, sf), _votes(spark, sf), safe=True)
    return ranked.select("clip_id", "score")


@query()
def cross_calibration(spark, sf):
    x, y = search.training_rows(clips(spark, sf), _votes(spark, sf))
    return spark.createDataFrame([(round(thresholds.cross_calibrated_np(x, y), 4),)], "threshold double")


@query()
def eval_learned(spark, sf):
    return evaluate.eval_learned_sort(clips(spark, sf), epochs=60)


@query(f"""SELECT entry_id, clip_id, label FROM (SELECT entry_id, clip_id, row_number() OVER (PARTITION BY entry_id ORDER BY kind, clip_id) AS rn FROM ({_MATCH}))
  JOIN (SELECT entry_id, label FROM ({_ENTRIES})) USING (entry_id) WHERE rn = 1 AND label IN ('good', 'bad')""")
def detector_training_rows(spark, sf):
    return training.matched(entries(spark, sf), text_clips(spark, sf).withColumn("embedding", F.array(F.lit(1.0))))


def _embedded_texts(spark, sf):
    """Embedded once and written: searches and training read the vectors several times, never the texts."""
    docs = embedded(text_clips(spark, sf), HashingEmbedder, "clip_string").where("embedding is not null")
    return durable(docs.select("clip_id", "md5", "origin", "origin_name", "embedding"), "embedded")


@query()
def detector_from_labels(spark, sf):
    """A detector trained on 200 entries, a label file of human size, and its hits over all documents."""
    docs, asked = _embedded_texts(spark, sf), entries(spark, sf).orderBy("entry_id").limit(200)
    found = training.from_labels(asked, docs, epochs=60)
    one = found.row(spark, "quality", "paragraph")
    return search.hit_counts(search.detector_scores(docs, one), one).withColumns({"loaded": F.lit(found.loaded), "skipped": F.lit(found.skipped)})


@query()
def text_search(spark, sf):
    ranking, threshold = training.text_search(_embedded_texts(spark, sf), HashingEmbedder(), "the quality of data", enrich=True)
    return ranking.withColumn("above", F.col("similarity") >= threshold)


@query()
def eval_report(spark, sf):
    """mAP and mean F1, with the first vector of each category as its query."""
    c = clips(spark, sf).where("category is not null")
    q = c.groupBy("category").agg(F.min_by("embedding", "clip_id").alias("vector")).withColumn("query", F.col("category").cast("string"))
    found = evaluate.run_eval({"embeddings": (c, q)}, epochs=60)
    return spark.createDataFrame([(n, r["text_sort"]["mAP"], r["learned_sort"]["mean_f1"]) for n, r in found.items()], "dataset string, mean_ap double, mean_f1 double")


@query()
def progress_report(spark, sf):
    h = _votes(spark, sf, 24).withColumn("seq", F.row_number().over(Window.orderBy(F.sha2(F.col("clip_id").cast("string"), 256))))
    return progress.report(clips(spark, sf), h, epochs=40)


@query()
def voting_iterations(spark, sf):
    return evaluate.simulate_voting(clips(spark, sf), [0, 1])


@query()
def model_replay(spark, sf):
    v = _votes(spark, sf, 24)
    seq = F.row_number().over(Window.orderBy(F.sha2(F.col("clip_id").cast("string"), 256)))
    h = v.withColumn("seq", seq)
    models = progress.replay(clips(spark, sf), h, epochs=40)
    return progress.cost_over_time(clips(spark, sf), models, v)


@query("""SELECT extractor, clip_id, confidence, label FROM (SELECT 'big_' || lang AS extractor, doc_id AS clip_id, round(n_chars / 10000.0, 4) AS confidence, lang AS label, n_chars / 10000.0 AS c FROM documents) WHERE c >= 0.2""")
def extract_explode(spark, sf):
    d = table(spark, sf, "documents")
    found = d.select(F.col("doc_id").alias("clip_id"), F.array(F.struct((F.col("n_chars") / 10000.0).alias("confidence"), F.array(F.lit(0.0), F.lit(1.0)).alias("bbox"), F.col("lang").alias("label"))).alias("found"))
    kinds = spark.createDataFrame([(f"big_{x}", "paragraph", x, 0.2) for x in ("de", "en", "es", "fr")], "name string, media_type string, target_class string, threshold double")
    return extract.extract(found, kinds, "paragraph").select("extractor", "clip_id", "confidence", "label")


# --- what a session shows

_RANKED = """SELECT clip_id, score, ROW_NUMBER() OVER (ORDER BY score DESC, clip_id) AS rank, COUNT(*) OVER () AS n
FROM (SELECT doc_id AS clip_id, round(n_chars / 7.0, 4) AS score FROM documents WHERE doc_id % 3 > 0 OR n_chars < 1000)"""


def _ranking(spark, sf):
    """A ranking with ties, some of whose clips are not loaded."""
    d = table(spark, sf, "documents")
    loaded = d.where("doc_id % 3 > 0 OR n_chars < 1000").select(F.col("doc_id").alias("clip_id"), "lang")
    return d.select(F.col("doc_id").alias("clip_id"), F.round(F.col("n_chars") / 7.0, 4).alias("score")), loaded


@query(f"""SELECT r.clip_id, r.rank, d.lang, (r.rank - 1) / CAST(r.n AS DOUBLE) AS position, CAST(NTILE(100) OVER (ORDER BY r.rank) AS INTEGER) AS stripe
FROM ({_RANKED}) r JOIN documents d ON d.doc_id = r.clip_id""")
def ranked_stripes(spark, sf):
    found = views.stripes(views.ranked_clips(*_ranking(spark, sf)))
    return found.select("clip_id", "rank", "lang", "position", "stripe")


@query(f"""SELECT stripe, COUNT(*) AS n, COUNT(*) FILTER (WHERE quality = 1) AS good, COUNT(*) FILTER (WHERE quality = 0) AS bad
FROM (SELECT clip_id, CAST(NTILE(100) OVER (ORDER BY rank) AS INTEGER) AS stripe FROM ({_RANKED})) s LEFT JOIN labels l ON l.doc_id = s.clip_id GROUP BY stripe""")
def stripe_marks(spark, sf):
    votes = table(spark, sf, "labels").select(F.col("doc_id").alias("clip_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return views.stripe_marks(views.stripes(views.ranked_clips(*_ranking(spark, sf))), votes)


@query("""SELECT (SELECT COUNT(*) FROM embeddings) > 0 AS loaded, (SELECT COUNT(*) FROM embeddings) AS num_clips,
(SELECT COUNT(*) FROM events WHERE event_type IN ('purchase', 'error')) > 0 AS has_votes, 'audio' AS media_type""")
def session_status(spark, sf):
    votes = table(spark, sf, "events").select(F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "error", "bad").alias("label"))
    return collections.session_status(clips(spark, sf).withColumn("type", F.lit("audio")), votes)


@query("""SELECT clip_id, current, total, elapsed, LEAST(100.0, round(100.0 * current / total, 1)) AS percent, s AS seconds_left,
CASE WHEN s < 5 THEN 'Less than 5 seconds remaining' WHEN s < 30 THEN 'Less than 30 seconds remaining' WHEN s < 60 THEN 'Less than a minute remaining' WHEN s < 90 THEN 'About a minute remaining'
     WHEN s < 3600 THEN 'About ' || CAST(CAST(floor(s / 60 + 0.5) AS INTEGER) AS VARCHAR) || ' minutes remaining'
     WHEN floor(s / 3600) = 1 THEN CASE WHEN floor((s % 3600) / 60 + 0.5) > 0 THEN 'About 1 hour ' || CAST(CAST(floor((s % 3600) / 60 + 0.5) AS INTEGER) AS VARCHAR) || ' minutes remaining' ELSE 'About 1 hour remaining' END
     ELSE 'About ' || CAST(CAST(floor(s / 3600) AS INTEGER) AS VARCHAR) || ' hours remaining' END AS eta
FROM (SELECT *, CASE WHEN current > 0 AND elapsed > 0 THEN GREATEST(0.0, (total - current) * elapsed / current) END AS s
      FROM (SELECT l_orderkey * 10 + l_linenumber AS clip_id, CAST(l_linenumber - 1 AS BIGINT) AS current, CAST(l_partkey % 50 + 1 AS BIGINT) AS total, CAST(l_quantity * l_quantity AS DOUBLE) AS elapsed FROM lineitem))""")
def progress_eta(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clip_id"), (F.col("l_linenumber") - 1).cast("long").alias("current"), (F.col("l_partkey") % 50 + 1).cast("long").alias("total"),
        (F.col("l_quantity") * F.col("l_quantity")).cast("double").alias("elapsed"),
    )
    return views.with_eta(rows).drop("rate")


@query("""SELECT doc_id AS clip_id, CASE WHEN doc_id % 2 = 0 THEN 'own(' || source || ')' ELSE 'folder(/all)' END AS origin, CASE WHEN doc_id % 5 > 0 THEN 'doc_' || CAST(doc_id AS VARCHAR) ELSE lang END AS origin_name FROM documents""")
def origin_fill(spark, sf):
    d = table(spark, sf, "documents")
    own = F.struct(F.lit("own").alias("importer"), F.create_map(F.lit("path"), F.col("source")).alias("params"))
    rows = d.select(F.col("doc_id").alias("clip_id"), F.when(F.col("doc_id") % 2 == 0, own).alias("origin"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("origin_name"), F.col("lang").alias("filename"))
    return collections.with_origins(rows, "folder", {"path": "/all"}).select("clip_id", S.origin_display(F.col("origin")).alias("origin"), "origin_name")


def _eval_rows(spark, sf):
    """Precision and recall of suppliers' parts, standing in for evaluated queries."""
    l = table(spark, sf, "lineitem")
    share = lambda c: F.avg(c.cast("double"))
    return l.groupBy(F.col("l_returnflag").alias("dataset"), (F.col("l_suppkey") % 7).alias("query")).agg(
        share(F.col("l_discount") > 0.05).alias("average_precision"), *[share(F.col("l_quantity") <= k).alias(f"p_at_{k}") for k in metrics.K_VALUES], *[share(F.col("l_quantity") > k).alias(f"r_at_{k}") for k in metrics.K_VALUES]
    )


_EVAL = """SELECT l_returnflag AS dataset, l_suppkey % 7 AS query, AVG(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS average_precision,
AVG(CASE WHEN l_quantity <= 5 THEN 1.0 ELSE 0.0 END) AS p5, AVG(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END) AS p10, AVG(CASE WHEN l_quantity <= 20 THEN 1.0 ELSE 0.0 END) AS p20 FROM lineitem GROUP BY 1, 2"""


@query(f"SELECT dataset, mean_ap, ROW_NUMBER() OVER (ORDER BY mean_ap DESC, dataset) AS ord FROM (SELECT dataset, AVG(average_precision) AS mean_ap FROM ({_EVAL}) GROUP BY dataset)")
def chart_map_by_dataset(spark, sf):
    return views.map_by_dataset(_eval_rows(spark, sf))


@query(f"SELECT dataset, query, average_precision, ROW_NUMBER() OVER (PARTITION BY dataset ORDER BY average_precision DESC, query) AS ord FROM ({_EVAL})")
def chart_ap_by_query(spark, sf):
    return views.ap_by_query(_eval_rows(spark, sf))


@query(f"""SELECT 'precision' AS chart, dataset, k, AVG(CASE k WHEN 5 THEN p5 WHEN 10 THEN p10 ELSE p20 END) AS mean FROM ({_EVAL}), (SELECT UNNEST([5, 10, 20]) AS k) GROUP BY dataset, k
UNION ALL SELECT 'recall', dataset, k, AVG(1 - CASE k WHEN 5 THEN p5 WHEN 10 THEN p10 ELSE p20 END) FROM ({_EVAL}), (SELECT UNNEST([5, 10, 20]) AS k) GROUP BY dataset, k""")
def chart_at_k(spark, sf):
    rows = durable(_eval_rows(spark, sf), "eval")
    return views.at_k(rows, "p").withColumn("chart", F.lit("precision")).unionByName(views.at_k(rows, "r").withColumn("chart", F.lit("recall")))


_LEARNED = """SELECT l_returnflag AS dataset, l_suppkey % 9 AS category, AVG(CASE WHEN l_quantity <= 20 THEN 1.0 ELSE 0.0 END) AS accuracy, AVG(CASE WHEN l_quantity <= 30 THEN 1.0 ELSE 0.0 END) AS precision,
AVG(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END) AS recall, AVG(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END) AS f1 FROM lineitem GROUP BY 1, 2"""


def _learned_rows(spark, sf):
    share = lambda c: F.avg(c.cast("double"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), (F.col("l_suppkey") % 9).alias("category")).agg(
        share(F.col("l_quantity") <= 20).alias("accuracy"), share(F.col("l_quantity") <= 30).alias("precision"), share(F.col("l_quantity") > 20).alias("recall"), share(F.col("l_tax") > 0.04).alias("f1")
    )


@query(f"SELECT dataset, category, f1, ROW_NUMBER() OVER (PARTITION BY dataset ORDER BY f1 DESC, category) AS ord FROM ({_LEARNED})")
def chart_f1_by_category(spark, sf):
    return views.f1_by_category(_learned_rows(spark, sf))


@query(f"""SELECT dataset, metric, AVG(CASE metric WHEN 'accuracy' THEN accuracy WHEN 'precision' THEN precision WHEN 'recall' THEN recall ELSE f1 END) AS mean
FROM ({_LEARNED}), (SELECT UNNEST(['accuracy', 'precision', 'recall', 'f1']) AS metric) GROUP BY dataset, metric""")
def chart_metrics_breakdown(spark, sf):
    return views.metrics_breakdown(_learned_rows(spark, sf))


@query("""SELECT dataset, category, t, AVG(fpr) AS fpr_mean, coalesce(stddev_samp(fpr), 0) AS fpr_std, AVG(fnr) AS fnr_mean, coalesce(stddev_samp(fnr), 0) AS fnr_std
FROM (SELECT l_returnflag AS dataset, l_linestatus AS category, l_linenumber AS t, l_discount AS fpr, l_tax AS fnr FROM lineitem) GROUP BY 1, 2, 3""")
def chart_rates_over_steps(spark, sf):
    return views.rates_over_steps(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("t"), F.col("l_discount").alias("fpr"), F.col("l_tax").alias("fnr")))
