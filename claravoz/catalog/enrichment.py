"""Queries for vectors, sentiment, the limiter, streams and the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from claravoz.catalog.cleaning import _mapped
from claravoz.catalog.files import _sentiments
from claravoz.catalog.metrics import _CLEANED_SQL, _DIRTY_SURVEY_SQL, _FIELDS, _IMPROVED_SQL, _dirty_survey, _report_sql
from claravoz.catalog.registry import query, table
from claravoz.catalog.survey import strip_sql
from claravoz.functions import text
from claravoz.operators import embedding, limits, neighbors, sentiment, telemetry
from claravoz.operators.vector_index import VectorIndex, learn
from claravoz.plans import jobs
from claravoz.scratch import scratch_path
from claravoz.sources import sinks
from claravoz.streaming import files as stream_files
from claravoz.streaming import windows
from claravoz.streaming.limits import token_bucket_stream
from claravoz.streaming.telemetry import windowed_rollup

# --- vectors ----------------------------------------------------------------------------

_UNIT_SQL = """u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
_KNN_SQL = f"""WITH {_UNIT_SQL}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
    round(greatest(2 - 2 * list_cosine_similarity(a.v, b.v), 0), 6) AS distance FROM u a, u b WHERE a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM p)
    SELECT query_id, id, distance, CAST(position AS INTEGER) AS position FROM r WHERE position <= 10"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _queries(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query("exact_knn", _KNN_SQL)
def exact_knn(spark, d):
    return neighbors.exact_knn(_queries(spark, d), _vectors(spark, d), 10, exclude_self=True)


@query("exact_knn_blocked", _KNN_SQL)
def exact_knn_blocked(spark, d):
    """The form for query sets too large to broadcast."""
    return neighbors.exact_knn(_queries(spark, d), _vectors(spark, d), 10, exclude_self=True,
                               broadcast_bytes=0, block_rows=200)


@query("approximate_knn")
def approximate_knn(spark, d):
    return neighbors.approximate_knn(_queries(spark, d), _vectors(spark, d), 10, exclude_self=True)


@query("approximate_recall", "SELECT count(*) * 10 AS expected, true AS good FROM embeddings")
def approximate_recall(spark, d):
    asked, stored = _queries(spark, d), _vectors(spark, d)
    truth = neighbors.exact_knn(asked, stored, 10, exclude_self=True)
    found = neighbors.approximate_knn(asked, stored, 10, exclude_self=True)
    return neighbors.recall(found, truth).select("expected", (F.col("recall") >= 0.8).alias("good"))


@query("vector_table_roundtrip", _KNN_SQL.replace("), p AS", """), n AS (SELECT vec_id, list_transform(v, lambda x:
       CAST(CAST(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS FLOAT) AS DOUBLE)) AS v FROM u), p AS""")
       .replace("u a, u b", "u a, n b"))
def vector_table_roundtrip(spark, d):
    """Add in two parts, save, load, search."""
    rows = table(spark, d, "embeddings")
    first = neighbors.VectorTable.create(rows.where("label < 5"), "vec_id", "embedding",
                                         neighbors.HyperplaneHash(64))
    path = scratch_path(spark, "vector-table")
    first.add(rows.where("label >= 5"), "vec_id", "embedding").save(path)
    return neighbors.VectorTable.load(spark, path).search(_queries(spark, d), 10, exclude_self=True)


_PART = "list_slice({}, 8 * p + 1, 8 * p + 8)"


@query("vector_index_search", f"""WITH {_UNIT_SQL}, n AS (SELECT vec_id AS id, list_transform(v, lambda x: x / sqrt(
         list_sum(list_transform(v, lambda y: y * y)))) AS v,
         row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS i FROM u),
       c AS (SELECT i AS cell, v AS c FROM n WHERE i < 16),
       a AS (SELECT n.*, cell, c, row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c) ** 2, 9), cell) AS nth FROM n, c),
       r AS (SELECT id, i, v, cell, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r FROM a WHERE nth = 1),
       b AS (SELECT p, i AS entry, {_PART.format('r')} AS e FROM r, range(8) AS t(p) WHERE i < 32),
       k AS (SELECT id, p, e, row_number() OVER (PARTITION BY id, p ORDER BY round(list_distance({_PART.format('r')}, e) ** 2, 9), entry)
         AS nth FROM r JOIN b ON true),
       q AS (SELECT id AS query_id, v AS q, cell, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS l FROM a
         WHERE id % 50 = 0 AND nth <= 6),
       d AS (SELECT query_id, r.id, any_value(q) AS q, any_value(r.v) AS v, round(sum(round(list_distance({_PART.format('l')}, e) ** 2, 9)), 6) AS d
         FROM q JOIN r USING (cell) JOIN k ON k.id = r.id AND k.nth = 1 WHERE query_id <> r.id GROUP BY 1, 2),
       m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS nth FROM d),
       x AS (SELECT query_id, id, round(greatest(2 - 2 * list_dot_product(q, CAST(CAST(v AS FLOAT[]) AS DOUBLE[])), 0), 6) AS distance
         FROM m WHERE nth <= 60),
       o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM x)
       SELECT query_id, id, distance, CAST(position AS INTEGER) AS position FROM o WHERE position <= 10""")
def vector_index_search(spark, d):
    """The index with the vectors it starts from as centroids and codebooks, which SQL can follow.

    Vectors are added in two parts; the index is stored and loaded before the search.
    """
    rows, path = _vectors(spark, d), scratch_path(spark, "vector-index")
    quantiser = learn(rows, cells=16, parts=8, entries=32, rounds=0)
    index = VectorIndex.create(spark, path, quantiser)
    index.add(rows.where("id % 3 = 0"))
    index.add(rows.where("id % 3 <> 0"))
    return VectorIndex.load(spark, path).search(
        _queries(spark, d).where("query_id % 50 = 0"), 10, probes=6, candidates=60, exclude_self=True)


@query("vector_index_recall", "SELECT count(*) * 10 AS expected, true AS good FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, d):
    """A learned index against exact search, for the queries whose id is divisible by 50."""
    asked, stored = _queries(spark, d).where("query_id % 50 = 0"), _vectors(spark, d)
    index = VectorIndex.build(stored, scratch_path(spark, "vector-index"))
    index.calibrate()
    truth = neighbors.exact_knn(asked, stored, 10, exclude_self=True)
    found = index.search(asked, 10, exclude_self=True)
    return neighbors.recall(found, truth).select("expected", (F.col("recall") >= 0.9).alias("good"))


_SLOTS_SQL = """tok AS (SELECT {id} AS id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
    lambda w: w <> '')) AS w FROM {table}),
    cnt AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS slot, count(*) AS c FROM tok GROUP BY 1, 2),
    nrm AS (SELECT id, sqrt(sum(c * c)::DOUBLE) AS n FROM cnt GROUP BY id),
    vec AS (SELECT id, slot, CAST(CAST(c / n AS FLOAT) AS DOUBLE) AS v FROM cnt JOIN nrm USING (id))"""


@query("text_embedding", "WITH " + _SLOTS_SQL.format(id="doc_id", table="documents") + """
       SELECT d.doc_id, 384 AS size, count(v) AS filled, round(coalesce(max(v), 0), 5) AS largest,
       round(coalesce(sum(v), 0), 3) AS total FROM documents d LEFT JOIN vec ON d.doc_id = vec.id GROUP BY d.doc_id""")
def text_embedding(spark, d):
    vectors = embedding.hashed_vectors(table(spark, d, "documents", spread=True).select("doc_id", "text"), "text")
    filled = F.filter("embedding", lambda x: x != 0)
    return vectors.select(
        "doc_id", F.size("embedding").alias("size"), F.size(filled).cast("long").alias("filled"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("largest"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x), 3).alias("total"))


_PREFIX = {"q": ("item_id", "benchmark"), "t": ("doc_id", "documents")}


def _prefixed(p):
    sql = _SLOTS_SQL.format(id=_PREFIX[p][0], table=_PREFIX[p][1])
    for name in ("tok", "cnt", "nrm", "vec"):
        sql = sql.replace(f"{name} AS (", f"{p}{name} AS (").replace(f"FROM {name}", f"FROM {p}{name}") \
            .replace(f"JOIN {name} ", f"JOIN {p}{name} ")
    return sql + f", {p}u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS u FROM {p}vec)"


@query("semantic_search", f"""WITH {_prefixed('q')}, {_prefixed('t')},
       dots AS (SELECT qu.id AS query_id, tu.id AS record_id, sum(qu.u * tu.u) AS s FROM qu JOIN tu USING (slot) GROUP BY 1, 2),
       p AS (SELECT i.item_id AS query_id, d.doc_id AS record_id, round(greatest(2 - 2 * coalesce(s, 0), 0), 6) AS distance
         FROM benchmark i CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = i.item_id AND dots.record_id = d.doc_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS position FROM p)
       SELECT query_id, record_id, distance, CAST(position AS INTEGER) AS position, d.text FROM r
       JOIN documents d ON d.doc_id = record_id WHERE position <= 10""")
def semantic_search(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("record_id"), "text", F.lit("docs").alias("task_id"))
    return jobs.semantic_search(asked, docs, task_id="docs")


# --- sentiment --------------------------------------------------------------------------


def _trained(spark, d):
    docs = table(spark, d, "documents", spread=True).select("doc_id", "text")
    labelled = table(spark, d, "labels").join(docs, "doc_id").select("text", F.col("quality").alias("label"))
    return docs, sentiment.train(labelled)


def _consistent(scored):
    p, n = F.col("positive_score"), F.col("negative_score")
    return (
        (F.abs(p + n - 1) < 1e-9) & ((F.col("sentiment") == "POSITIVE") == (p > n))
        & (F.col("confidence") == F.greatest(p, n))
    )


@query("sentiment_model", "SELECT doc_id, true AS consistent FROM documents")
def sentiment_model(spark, d):
    docs, model = _trained(spark, d)
    scored = sentiment.score_with_model(docs, model)
    return scored.select("doc_id", _consistent(scored).alias("consistent"))


@query("sentiment_stage", "SELECT doc_id, true AS consistent FROM documents")
def sentiment_stage(spark, d):
    """The same model as a saved stage of an ML pipeline."""
    docs, model = _trained(spark, d)
    path = scratch_path(spark, "model")
    model.save(path)
    stage = sentiment.SentimentTransformer(inputCol="text", modelPath=path)
    scored = stage.transform(docs)
    return scored.select("doc_id", _consistent(scored).alias("consistent"))


def _length_scorer():
    """Stands for a model: two logits from the length of the text."""
    return lambda texts: [[0.0, len(t) / 1000 - 1] for t in texts]


@query("sentiment_plugged_scorer", """WITH s AS (SELECT doc_id, 1 / (1 + exp(-(length(text) / 1000.0::DOUBLE - 1))) AS p
       FROM documents) SELECT doc_id, CASE WHEN p > 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
       round(greatest(p, 1 - p), 6) AS confidence FROM s""")
def sentiment_plugged_scorer(spark, d):
    scored = sentiment.score_texts(table(spark, d, "documents", spread=True).select("doc_id", "text"), _length_scorer)
    return scored.select("doc_id", "sentiment", F.round("confidence", 6).alias("confidence"))


def _five_scorer():
    return lambda texts: [[float((len(t) + 7 * i) % 11) + i / 10 for i in range(5)] for t in texts]


@query("sentiment_five_classes", """WITH l AS (SELECT doc_id, list_transform([0, 1, 2, 3, 4],
       lambda i: ((length(text) + 7 * i) % 11)::DOUBLE + i / 10.0::DOUBLE) AS l FROM documents)
       SELECT doc_id, ['Very Negative', 'Negative', 'Neutral', 'Positive', 'Very Positive'][list_position(l, list_max(l))]
       AS sentiment FROM l""")
def sentiment_five_classes(spark, d):
    from claravoz.functions.scoring import FIVE_CLASSES

    docs = table(spark, d, "documents", spread=True).select("doc_id", "text")
    return sentiment.score_texts(docs, _five_scorer, labels=FIVE_CLASSES).select("doc_id", "sentiment")


@query("enrich_job", "SELECT count(*) AS n FROM documents")
def enrich_job(spark, d):
    docs, model = _trained(spark, d)
    renamed = docs.withColumnRenamed("doc_id", "record_id")
    return jobs.enrich(renamed, model, scratch_path(spark, "enriched")).agg(F.sum("n").alias("n"))


# --- limiter ----------------------------------------------------------------------------


def _bucket_sql(key, rule):
    token, full, refill = rule.token, rule.full, rule.refill
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS k, epoch_us(ts) AS us,
      row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
      b AS (SELECT event_id, k, us, rn, {full - token}::BIGINT AS units, true AS allowed, 0::BIGINT AS missing FROM e WHERE rn = 1
      UNION ALL SELECT event_id, k, us, rn, CASE WHEN r >= {token} THEN r - {token} ELSE r END, r >= {token},
        greatest({token} - r, 0) FROM (SELECT e.event_id, e.k, e.us, e.rn,
          least({full}, b.units + (e.us - b.us) * {refill}) AS r FROM b JOIN e ON e.k = b.k AND e.rn = b.rn + 1))
      SELECT event_id, k AS {key}, allowed, round(missing::DOUBLE / {refill * 1_000_000}::DOUBLE, 6) AS retry_after,
      round(units::DOUBLE / {token}::DOUBLE, 6) AS tokens_left FROM b"""


PER_USER = limits.BucketRule(max_tokens=3, refill_rate=1 / 43200)
PER_TYPE = limits.BucketRule(max_tokens=20, refill_rate=1 / 1800)


def _limited(decided, key):
    return decided.select("event_id", key, "allowed", F.round("retry_after", 6).alias("retry_after"),
                          F.round("tokens_left", 6).alias("tokens_left"))


@query("rate_limit_by_user", _bucket_sql("user_id", PER_USER))
def rate_limit_by_user(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return _limited(limits.token_bucket(events, "user_id", "ts", "event_id", PER_USER), "user_id")


@query("rate_limit_hot_keys", _bucket_sql("event_type", PER_TYPE))
def rate_limit_hot_keys(spark, d):
    """Few keys, each with a large part of all events."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return _limited(limits.token_bucket(events, "event_type", "ts", "event_id", PER_TYPE), "event_type")


@query("rate_limit_idle_keys", """SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events
       GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR""")
def rate_limit_idle_keys(spark, d):
    now = F.lit("2024-01-31").cast("timestamp")
    return limits.idle_keys(table(spark, d, "events"), "user_id", "ts", now, 6 * 3600).select(
        "user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


# --- streams ----------------------------------------------------------------------------


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(spark, df, label):
    """Run a stream over what is there and read what it wrote."""
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    df.writeStream.format("parquet").option("checkpointLocation", state).option("path", out) \
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("stream_rate_limit", _bucket_sql("user_id", PER_USER))
def stream_rate_limit(spark, d):
    stream = _event_stream(spark, d).select("event_id", "user_id", "ts")
    return _limited(_drained(spark, token_bucket_stream(stream, "user_id", "ts", "event_id", PER_USER), "limits"),
                    "user_id")


_WINDOW_SQL = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate(telemetry.PROCESSING_BUCKETS))
_ROLLED_SQL = f"""count(*) AS operations, count(*) AS records, round(sum(value), 4) AS seconds, {_WINDOW_SQL},
    count(value) AS le_inf"""


def _windows(rolled, *more):
    return rolled.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "operations", "records",
        F.round("seconds", 4).alias("seconds"), *(f"le_{i}" for i in range(len(telemetry.PROCESSING_BUCKETS))), "le_inf", *more)


@query("stream_windowed_telemetry", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, {_ROLLED_SQL}
       FROM events GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, * EXCLUDE (s) FROM w
       WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windowed_telemetry(spark, d):
    return _windows(_drained(spark, windowed_rollup(_event_stream(spark, d), "ts", ["event_type"], "value"), "windows"))


@query("stream_early_windows", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, {_ROLLED_SQL}
       FROM events GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, * EXCLUDE (s),
       s + INTERVAL 70 MINUTE < (SELECT time_bucket(INTERVAL 1 HOUR, max(ts)) FROM events) AS final FROM w""")
def stream_early_windows(spark, d):
    """Newest revisions of all windows, the open ones included."""
    def run():
        return _drained(spark, windows.early_windows(_event_stream(spark, d), "ts", ["event_type"], "value"), "early-windows")

    newest = windows.latest(windows.with_state_store(spark, run), ["event_type"])
    return _windows(newest, "final")


@query("sliding_telemetry", f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * CAST(i AS INTEGER)) AS s,
       event_type, value FROM events, range(4) AS r(i)) SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, event_type,
       {_ROLLED_SQL} FROM w GROUP BY s, event_type""")
def sliding_telemetry(spark, d):
    return _windows(windowed_rollup(table(spark, d, "events"), "ts", ["event_type"], "value",
                                    width="24 hours", slide="6 hours"))


@query("stream_file_ingest", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, {strip_sql("' ' || source")} AS source,
       'good' AS row_status FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, 'malformed' FROM labels""")
def stream_file_ingest(spark, d):
    folder = scratch_path(spark, "drop")
    good = F.concat_ws(",", "doc_id", "lang", F.concat(F.lit('" '), "source", F.lit('"')))
    lines = table(spark, d, "documents", spread=True).select(good.alias("value")).unionByName(
        table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("value")))
    lines.write.text(folder)
    out, audits = scratch_path(spark, "dropped"), scratch_path(spark, "drop-audit")
    stream_files.ingest_stream(
        spark, folder, ["doc_id", "lang", "source"], out, scratch_path(spark, "drop-state"),
        clean=lambda b: b.withColumn("source", text.strip(F.col("source"))),
        audit_path=audits, options={"header": "false", "multiLine": "false"},
    ).awaitTermination()
    return stream_files.committed(spark, out, audits).select("doc_id", "lang", "source", "row_status")


# --- jobs -------------------------------------------------------------------------------


@query("ingest_job", """SELECT CAST(event_id AS VARCHAR) AS event, CASE WHEN event_id % 9 = 0 THEN ' '
       ELSE CAST(user_id AS VARCHAR) END AS user_id, CASE WHEN event_id % 8 = 0 THEN 'bad'
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "timestamp", CASE WHEN event_id % 10 = 0 THEN 'x'
       WHEN event_id % 10 = 1 THEN NULL ELSE CAST(event_id % 13 AS VARCHAR) END AS nps FROM events""")
def ingest_job(spark, d):
    raw = _mapped(spark, d).toDF("Event", "User  Id", "Created At", "Satisfaction")
    source = scratch_path(spark, "events-csv")
    raw.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(source)
    result = jobs.ingest(spark, source, scratch_path(spark, "ingested"), scratch_path(spark, "history"))
    return result.good(spark)


@query("convert_job", f"{_DIRTY_SURVEY_SQL}, {_CLEANED_SQL}, r AS ("
       + _report_sql("before", "s", (*_FIELDS, "NOTA"), _FIELDS, 7) + " UNION ALL "
       + _report_sql("after", "c", (*_FIELDS, "NOTA"), _FIELDS[:-1], 7) + f") {_IMPROVED_SQL}")
def convert_job(spark, d):
    return jobs.convert(spark, _dirty_survey(spark, d), scratch_path(spark, "converted")).quality


@query("results_export_job", """SELECT CAST(d.doc_id AS VARCHAR) AS record_id, d.lang, CASE WHEN l.quality = 1 THEN
       'POSITIVE' WHEN l.quality = 0 THEN 'NEGATIVE' END AS sentiment FROM documents d LEFT JOIN labels l USING (doc_id)""")
def results_export_job(spark, d):
    docs = table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("record_id"), "lang")
    path = sinks.export(docs, scratch_path(spark, "export"), "csv", sentiments=_sentiments(spark, d))
    return spark.read.option("header", True).csv(path).select("record_id", "lang", "sentiment")
