import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claravoz.operators import embedding, feedback, headers, limits, neighbors, quality, schema, sentiment
from claravoz.operators.ordering import number_rows, with_previous

# --- limiter ----------------------------------------------------------------------------


def sequential(rule, events):
    """One bucket per key, event by event, in whole units."""
    state, out = {}, {}
    for key, us, tie, need in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        units = rule.full if key not in state else rule.refilled(state[key][0], us - state[key][1])
        missing = need * rule.token - units
        if missing <= 0:
            units -= need * rule.token
        state[key] = (units, us)
        out[tie] = (missing <= 0, max(missing, 0) / (rule.refill * 1_000_000))
    return out


def decide(spark, rule, events):
    df = spark.createDataFrame([(str(k), us, i, n) for k, us, i, n in events], "k string, us long, i long, n int") \
        .withColumn("ts", F.timestamp_micros("us"))
    rows = limits.token_bucket(df.select("k", "ts", "i", "n"), "k", "ts", "i", rule, F.col("n")).collect()
    return {r["i"]: (r["allowed"], r["retry_after"]) for r in rows}


@pytest.mark.parametrize("size, rate, times, expected", [
    (10, 10, [("a", 0)] * 10, [True] * 10),
    (5, 1, [("a", 0)] * 6, [True] * 5 + [False]),
    (5, 10, [("a", 0)] * 5 + [("a", 150_000)], [True] * 6),
    (5, 1, [("user-1", 0)] * 6 + [("user-2", 0)], [True] * 5 + [False, True]),
    (3, 1, [("a", 0)] * 4, [True, True, True, False]),
])
def test_token_bucket_cases(spark, size, rate, times, expected):
    got = decide(spark, limits.BucketRule(size, rate), [(k, us, i, 1) for i, (k, us) in enumerate(times)])
    assert [got[i][0] for i in range(len(times))] == expected
    assert all((retry > 0) != allowed for allowed, retry in got.values())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.sampled_from([0.25, 1.0, 1 / 3, 5.0]), st.integers(0, 10**6),
       st.lists(st.tuples(st.integers(0, 3_000_000), st.integers(1, 3)), min_size=1, max_size=40),
       st.sampled_from([None, 2.0]))
def test_transfer_equals_simulation(size, rate, start, steps, idle):
    """The piecewise transfer gives, for any arrival, what event by event simulation gives."""
    rule = limits.BucketRule(size, rate, idle)
    transfer = limits.Transfer(rule)
    units = start * rule.full // 10**6
    expect = units
    for i, (gap, need) in enumerate(steps):
        if i:
            transfer.wait(gap)
            expect = rule.refilled(expect, gap)
        transfer.take(need * rule.token)
        if expect >= need * rule.token:
            expect -= need * rule.token
    assert transfer(units) == expect


def test_transfer_stays_small():
    """Pieces depend on the bucket's size, not on the number of events, so summaries stay small."""
    rng = random.Random(1)
    for size, rate, load in ((1, 1.0, 10), (3, 1 / 7, 3), (20, 3.0, 1.1), (100, 10.0, 1.5), (5, 1.0, 3)):
        transfer, most = limits.Transfer(limits.BucketRule(size, rate)), 0
        for _ in range(5000):
            transfer.wait(int(rng.expovariate(rate * load) * 1_000_000))
            transfer.take(transfer.rule.token)
            most = max(most, len(transfer.pieces))
        assert most <= 4 * (size + 4)


def test_token_bucket_hot_key_spans_partitions(spark):
    """One key holds most events and never refills fully; the result does not depend on the cuts."""
    rng = random.Random(7)
    rule = limits.BucketRule(4, 2.5)
    us, events = 0, []
    for i in range(3000):
        us += rng.choice([0, 100_000, 250_000, 390_001, 420_000])
        events.append(("hot" if i % 4 else f"k{i % 50}", us, i, 1 + i % 2))
    got = decide(spark, rule, events)
    want = sequential(rule, [(str(k), t, i, n) for k, t, i, n in events])
    assert got == want
    assert {a for a, _ in got.values()} == {True, False}


def test_idle_keys(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00'), ('b', TIMESTAMP '2024-01-01 02:00:00') t(k, ts)")
    now = F.lit("2024-01-01 02:30:00").cast("timestamp")
    assert [r["k"] for r in limits.idle_keys(df, "k", "ts", now, 3600).collect()] == ["a"]


# --- ordering ---------------------------------------------------------------------------


def test_number_rows_with_hot_group(spark):
    rows = [("hot", i) for i in range(500)] + [(f"g{i % 7}", i) for i in range(60)] + [(None, i) for i in range(5)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {(r["g"], r["v"]): r["n"] for r in number_rows(df, ["v"], ["g"], "n").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        for n, v in enumerate(sorted(v for h, v in rows if h == g)):
            want[(g, v)] = n
    assert got == want
    whole = [r["n"] for r in number_rows(df, ["v", "g"], (), "n").orderBy("v", "g").collect()]
    assert whole == list(range(len(rows)))


def test_with_previous(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("b", 2, 5), ("a", 2, 20)], "g string, o int, v int")
    got = {(r["g"], r["o"]): r["p"] for r in with_previous(df, ["g"], ["o"], {"p": "v"}).collect()}
    assert got == {("a", 1): None, ("a", 2): 10, ("a", 3): 20, ("b", 2): None}


# --- quality ----------------------------------------------------------------------------

CSV_ROWS = [
    ("Silver", 8, "false", "Me gusta mucho", "2023-11-02"),
    ("Gold", 4, "true", "<iframe src=x>mal</iframe>", "2023/11/03"),
    ("Silver", 6, "no", "Regular, sin más", "02-11-2023"),
    ("Gold", 1, "0", "=EXEC(A1)", "2023-11-04 08:00:00"),
]
SURVEY_DDL = "plan string, score int, outage_flag string, comentario string, fecha string"


def test_detect_and_clean_small_file(spark):
    df = spark.createDataFrame(CSV_ROWS, SURVEY_DDL)
    types = {r["column"]: r["type"] for r in schema.detect_schema(df).collect()}
    assert types == {"plan": "string", "score": "integer", "outage_flag": "boolean",
                     "comentario": "string", "fecha": "date"}
    sampled = {r["column"]: r["type"] for r in schema.detect_schema(df, sample_rows=3).collect()}
    assert sampled == types
    rows = schema.clean(df, types).orderBy("fecha").collect()
    assert [r["outage_flag"] for r in rows] == [False, False, True, False]
    assert [r["fecha"] for r in rows] == ["2023-11-02", "2023-11-02", "2023-11-03", "2023-11-04"]
    assert rows[3]["comentario"] == "'=EXEC(A1)"
    fixed = schema.clean_survey(df).orderBy("fecha").collect()
    assert [tuple(r) for r in fixed] == [tuple(r) for r in rows]


def test_report_counts(spark):
    df = spark.createDataFrame([(" a", 1.0, None), ("a", -0.0, None), ("a", 0.0, None), ("", 2.0, "x ")],
                               "s string, d double, t string")
    got = {(r["column"], r["metric"]): r["value"] for r in quality.quality_report(df).collect()}
    assert got[(None, "total_records")] == 4 and got[(None, "total_cells")] == 12
    assert got[(None, "total_nulls")] == 3 and got[(None, "null_percentage")] == 25.0
    assert got[(None, "whitespace_contamination")] == 2 and got[(None, "whitespace_percentage")] == 50.0
    assert got[(None, "duplicate_rows")] == 1 and got[("t", "null_percentage")] == 75.0
    empty = {r["metric"]: r["value"] for r in quality.quality_report(df.limit(0)).where("column IS NULL").collect()}
    assert set(empty.values()) == {0.0}


def test_profile_handles_wide_tables(spark):
    wide = spark.range(20).select(*(
        F.when(F.col("id") % (i + 2) != 0, F.concat(F.lit(" "), F.col("id"))).alias(f"c{i}") for i in range(70)),
        *(F.when(F.col("id") % 2 == 0, F.col("id")).alias(f"n{i}") for i in range(70)))
    got = {(r["column"], r["metric"]): r["value"] for r in quality.quality_report(wide).collect()}
    for i in (0, 19, 20, 21, 69):
        nulls = sum(1 for x in range(20) if x % (i + 2) == 0)
        assert got[(f"c{i}", "null_count")] == nulls and got[(f"c{i}", "whitespace_count")] == 20 - nulls
        assert got[(f"n{i}", "null_count")] == 10


def test_content_hash_is_order_free_and_sees_changes(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "x").alias("s"))
    base = quality.content_hash(df).first()
    assert quality.content_hash(df.repartition(7).orderBy(F.desc("id"))).first() == base
    assert quality.content_hash(df.unionAll(df)).first()["content_hash"] != base["content_hash"]
    moved = spark.createDataFrame([("a", None)], "x string, y string")
    other = spark.createDataFrame([(None, "a")], "x string, y string")
    assert quality.content_hash(moved).first() != quality.content_hash(other).first()


def test_audit_and_validation(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("", None)], "x string, y string")
    audit = quality.validate_audit(quality.audit_record(df, "v1", "in", "out", 1, 1)).first()
    assert audit["rows"] == 3 and audit["columns"] == 2 and audit["nulls"] == {"x": 0, "y": 3}
    assert audit["empty_strings"] == {"x": 1, "y": 0} and audit["distincts"] == {"x": 2, "y": 0}
    assert audit["status"] == "passed" and audit["alerts"] == ["INFO: 1 columns not mapped to canonical schema"]
    more = spark.createDataFrame([(None, None), ("b", None)], "x string, y string")
    warned = quality.validate_audit(quality.audit_record(more, "v2", "in", "out")).first()
    assert warned["status"] == "warning" and warned["alerts"] == ["WARNING: High null percentage: 75.00%"]
    empty = quality.validate_audit(quality.audit_record(df.limit(0), "v3", "in", "out")).first()
    assert empty["status"] == "failed" and empty["alerts"] == ["CRITICAL: Zero rows in output"]


def test_drift(spark):
    now = spark.createDataFrame([("b", "int"), ("c", "string")], "field string, type string")
    then = spark.createDataFrame([("a", "string"), ("b", "string")], "field string, type string")
    got = {r["field"]: r["change"] for r in schema.schema_drift(now, then).collect()}
    assert got == {"a": "removed", "b": "retyped", "c": "added"}


# --- headers ----------------------------------------------------------------------------

# The header of the survey table.
SURVEY_COLUMNS = [
    "id_cliente", "fecha", "region", "canal", "servicio", "plan", "dispositivo", "comentario", "NOTA", "NPS_GRUPO",
    "sentimiento", "sentimiento_score", "pain_points", "churn_risk", "ticket_id", "agent_id",
    "velocidad_bajada_mbps", "velocidad_subida_mbps", "latencia_ms", "jitter_ms", "outage_flag", "fcr",
    "sla_cumplido", "facturacion_flag", "dias_desde_instalacion",
]


@pytest.mark.parametrize("match", ["tokens", "contains"])
def test_survey_headers_map_without_duplicates(spark, match):
    df = spark.createDataFrame([tuple("x" * 25)], ", ".join(f"`{c}` string" for c in SURVEY_COLUMNS))
    mapped, report = headers.map_columns(df, match=match)
    assert len({c.lower() for c in mapped.columns}) == 25
    assert report.mapping["id_cliente"] == "user_id" and report.mapping["nps_grupo"] == "nps"
    assert {"ticket_id", "agent_id"} <= set(report.collisions)
    assert report.mapped_count + report.unmapped_count + len(report.collisions) == 25
    by_contains = {"velocidad_bajada_mbps", "velocidad_subida_mbps", "sla_cumplido"} & set(report.collisions)
    assert bool(by_contains) == (match == "contains")


def test_header_rules(spark):
    df = spark.createDataFrame([(1, 2)], "` First  Name ` int, `E-Mail` int")
    assert headers.normalize_headers(df).columns == ["first_name", "e-mail"]
    names = spark.createDataFrame([("tmestamp",), ("nps",), ("zzz",)], "h string")
    got = [r["t"] for r in names.select(headers.fuzzy_match(F.col("h")).alias("t")).collect()]
    assert got == ["timestamp", "nps", None]
    score = spark.range(1).select(headers.partial_similarity(F.lit("abc"), F.lit("xxabdxx"))).first()[0]
    assert score == pytest.approx(200 / 3)
    assert headers.normalize_values(spark.createDataFrame([(" A  b ",)], "x string")).first()[0] == "_a_b_"


def test_vector_suggestions_stay_pending(spark):
    asked = spark.createDataFrame([("e-mail adress",), ("time stamp",), ("qqqq",)], "header string")
    got = {r["header"]: (r["target"], r["status"]) for r in headers.suggest_by_vector(asked, threshold=0.6).collect()}
    assert got == {"e-mail adress": ("email", "pending"), "time stamp": ("timestamp", "pending")}
    known = spark.createDataFrame([("email", "mail", "1")], "target string, alias string, version string")
    approved = spark.createDataFrame([("email", "mail"), ("email", "e-mail adress")], "target string, alias string")
    rows = {(r["alias"], r["version"]) for r in headers.approve_pending(known, approved, "2").collect()}
    assert rows == {("mail", "1"), ("e-mail adress", "2")}


# --- vectors and sentiment --------------------------------------------------------------


def brute_force(queries, vectors, k):
    unit = {i: np.asarray(v) / (np.linalg.norm(v) or 1) for i, v in vectors}
    out = {}
    for q, v in queries:
        u = np.asarray(v) / (np.linalg.norm(v) or 1)
        scored = sorted((round(max(2 - 2 * float(u @ w), 0.0), 6), i) for i, w in unit.items())
        out[q] = [(i, d) for d, i in scored[:k]]
    return out


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_exact_knn_equals_brute_force(spark, limit):
    rng = np.random.RandomState(5)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(40)] + [(400, [0.0] * 8)]
    queries = [(f"q{i}", rng.standard_normal(8).tolist()) for i in range(5)] + [("dup", vectors[0][1]), ("zero", [0.0] * 8)]
    q = spark.createDataFrame(queries, "query_id string, query_vec array<double>")
    v = spark.createDataFrame(vectors, "id long, vec array<double>").repartition(4)
    got = {}
    found = neighbors.exact_knn(q, v, 7, broadcast_bytes=limit, block_rows=64)
    for r in found.orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert got == brute_force(queries, vectors, 7)


def test_copies_of_a_search_end_with_its_blocks(spark):
    """Each row was copied once per ``block_rows`` rows of the other side, so copies grew with the square of the table."""
    v = spark.range(4000).select("id", F.array(F.lit(1.0)).alias("vec"), F.lit(0).alias("bucket"))
    q = v.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "bucket")
    left, right, keys = neighbors.blocked_sides(q, v, ["bucket"], "query_id", "id", 10)
    for side in (left, right):
        assert side.count() == 4000 * 16
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] < neighbors.BLOCK_ROWS


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_exact_knn_over_many_tiles(spark, monkeypatch, limit):
    """A file of one split is spread, and tiles, ties, copies and vectors of no length lose no neighbour."""
    for name, value in (("_TILE_QUERIES", 7), ("_TILE_VECTORS", 90), ("_PAIRS", 11), ("_TASK_PAIRS", 1000), ("_MANY_QUERIES", 10)):
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.RandomState(8)
    vectors = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[1][1]) for i in range(120)] + [(500, [float("inf")] * 6)]
    v = spark.createDataFrame(vectors, "id long, vec array<double>").coalesce(1)
    q = v.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = neighbors.exact_knn(q, v, 5, broadcast_bytes=limit, block_rows=64, exclude_self=True)
    if limit:
        assert "RoundRobinPartitioning" in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    whole = vectors[:-1]
    assert got == {i: [x for x in brute_force([(i, u)], whole, 6)[i] if x[0] != i][:5] for i, u in whole if i % 3 == 0}


def test_exact_knn_beside_an_infinite_vector(spark):
    """One such vector among fewer than k others hid them all."""
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("inf"), 1.0]), ("c", [0.0, 1.0])], "id string, vec array<double>").coalesce(1)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vec array<double>")
    assert [(r["id"], r["distance"]) for r in neighbors.exact_knn(q, v, 5).orderBy("position").collect()] == [("a", 0.0), ("c", 2.0)]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_approximate_knn_with_one_hot_bucket(spark, monkeypatch, broadcast_rows):
    """A third of the vectors are copies, so they share every bucket; cells stay bounded."""
    monkeypatch.setattr(neighbors, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.RandomState(6)
    centres = rng.standard_normal((5, 16))
    vectors = [(i, (centres[i % 5] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(200)]
    v = spark.createDataFrame(vectors, "id long, vec array<double>")
    q = v.where("id < 20").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    truth = neighbors.exact_knn(q, v, 5)
    found = neighbors.approximate_knn(q, v, 5, block_rows=50)
    assert neighbors.recall(found, truth).first()["recall"] >= 0.9


def test_exact_search_of_many_queries_copies_no_row(spark):
    """Both sides were copied once per block of the other side."""
    v = spark.range(3000).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 2)).alias("vec"))
    q = v.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    found, want = (neighbors.exact_knn(q, v, 3, exclude_self=True, broadcast_bytes=limit, block_rows=500) for limit in (0, 1 << 26))
    assert "CoGroups" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_hashing_of_many_copies_is_searched_by_a_scan(spark, monkeypatch):
    """Every row was copied for each table and probe; the scan copies none and finds what buckets find."""
    rng = np.random.RandomState(11)
    vectors = [(i, rng.standard_normal(12).tolist()) for i in range(700)]
    vectors += [(700 + i, vectors[i % 3][1]) for i in range(150)] + [(900, [0.0] * 12)]
    v = spark.createDataFrame(vectors, "id long, vec array<double>").repartition(3)
    q = v.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    hashing = neighbors.HyperplaneHash(12, tables=6, bits=7, probes=3)
    search = lambda: neighbors.approximate_knn(q, v, 10, hashing=hashing, exclude_self=True, block_rows=100)
    found = search()
    assert "CoGroups" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(neighbors, "_COPY_VECTORS", 1)
    blocks = search()
    assert "CoGroups" in blocks._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, blocks.collect()))


def test_hashed_vectors_equal_python(spark):
    import hashlib
    import re
    texts = ["Hola hola, señor 42!", "", None, "a-b a_b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in embedding.hashed_vectors(df, "t").collect():
        counts = np.zeros(384)
        for w in re.findall(r"[^\W_]+", (texts[row["i"]] or "").lower()):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384] += 1
        want = counts / (np.linalg.norm(counts) or 1)
        assert np.allclose(row["embedding"], want, atol=1e-6)


def test_model_vectors_and_scores(spark):
    df = spark.createDataFrame([("Llegó a tiempo",), ("No lo recomiendo nada",), ("tie",), (None,)], "text string")
    vec = embedding.model_vectors(df, "text", lambda: lambda ts: [[float(len(t)), 1.0] for t in ts], batch_size=2)
    assert [r["embedding"] for r in vec.collect()] == [[14.0, 1.0], [21.0, 1.0], [3.0, 1.0], [0.0, 1.0]]

    def load():
        scores = {"Llegó a tiempo": (.1, .9), "No lo recomiendo nada": (.65, .35), "tie": (.5, .5)}
        return lambda ts: np.log([scores[t] for t in ts])

    got = [(r["sentiment"], None if r["confidence"] is None else round(r["confidence"], 6))
           for r in sentiment.score_texts(df, load).collect()]
    assert got == [("POSITIVE", .9), ("NEGATIVE", .65), ("NEGATIVE", .5), (None, None)]


def test_a_scorer_runs_beside_no_copy_of_its_batch(spark):
    def load():
        import gc

        def score(texts):
            held = any(type(o).__name__ == "Series" for o in gc.get_objects())
            return [[0.0, 9.0] if held else [9.0, 0.0]] * len(texts)

        return score

    df = spark.range(200).select(F.when(F.col("id") % 7 > 0, F.repeat(F.lit("é "), 500)).alias("text"))
    got = {r["sentiment"]: r["count"] for r in sentiment.score_texts(df, load).groupBy("sentiment").count().collect()}
    assert got == {"NEGATIVE": 171, None: 29}


def test_trained_model_learns(spark):
    rows = [(f"good great nice {i}", 1) for i in range(30)] + [(f"bad awful poor {i}", 0) for i in range(30)]
    df = spark.createDataFrame(rows, "text string, label int")
    scored = sentiment.score_with_model(df.select("text", "label"), sentiment.train(df)).collect()
    assert all((r["sentiment"] == "POSITIVE") == (r["label"] == 1) for r in scored)


# --- survey analytics -------------------------------------------------------------------


def test_product_ranking(spark):
    rows = ([("A", "Detractor", "Alto", "App")] * 6 + [("A", "Pasivo", "Bajo", " App ")] * 2 + [("A", "Promotor", "Medio", "")] * 2
            + [("B", "Promotor", "Bajo", None)] * 4 + [("B", "Detractor", "Medio", "WiFi")])
    df = spark.createDataFrame(rows, "plan string, NPS_GRUPO string, churn_risk string, pain_points string")
    first, second = feedback.rank_products(df).collect()
    assert (first["plan"], first["rank"], first["detractors"]) == ("A", 1, 6)
    assert first["severity_score"] == pytest.approx(60 * .5 + 60 * .3 + 20 * .2) and first["severity_level"] == "critical"
    assert [tuple(t) for t in first["top_pain_points"]] == [("App", 8)]
    assert second["severity_score"] == pytest.approx(20 * .5 + 20 * .2)
    sheet = feedback.ranking_sheet(feedback.rank_products(df)).first()
    assert (sheet["detractors"], sheet["score"], sheet["top_problems"]) == ("60.0%", "52.0", "App (8)")


def test_alerts_on_crossing(spark):
    rows = []
    for week, bad in enumerate([1, 9, 9, 2]):
        rows += [(f"2024-01-{1 + 7 * week:02d}", "P", "Detractor" if i < bad else "Pasivo", "Alto") for i in range(10)]
    df = spark.createDataFrame(rows, "d string, plan string, NPS_GRUPO string, churn_risk string").withColumn("d", F.to_date("d"))
    got = [(str(r["period"]), r["alert"]) for r in feedback.threshold_alerts(df, "d", 60.0).orderBy("period").collect()]
    assert got == [("2024-01-08", "raised"), ("2024-01-22", "cleared")]




def test_detection_shuffles_no_rows(spark):
    df = spark.createDataFrame([(f"2024-01-{i % 28 + 1:02d}", "si", f"t{i}") for i in range(50)], "d string, b string, t string")
    plan = schema.detect_schema(df)._jdf.queryExecution().executedPlan().toString()
    assert "_digest" not in plan and "sha2" not in plan
    assert {r["column"]: r["type"] for r in schema.detect_schema(df).collect()} == {"d": "date", "b": "boolean", "t": "string"}


def test_hash_settings_reach_their_recall_on_vectors_without_clusters(spark):
    """Neighbours of random vectors are hardly nearer than other rows, so fixed tables and probes miss most of them."""
    rng = np.random.RandomState(7)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(3000)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.where("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    truth = neighbors.exact_knn(q, v, 10, exclude_self=True)
    found = neighbors.approximate_knn(q, v, 10, exclude_self=True)
    assert neighbors.recall(found, truth).first()["recall"] >= 0.9
    # without a vector there is nothing to measure
    assert neighbors.hashing_for(v.limit(0), "vec").bits == 2


def test_training_reads_a_text_once(spark):
    """Each fit cut the texts again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = [(("good " if i % 2 else "bad ") + f"word{i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label int").select(counted("text").alias("text"), "label")
    model = sentiment.train(df, features=64, iterations=5)
    assert seen.value == 40
    said = sentiment.score_with_model(spark.createDataFrame([("good",), ("bad",)], "text string"), model).collect()
    assert [r["sentiment"] for r in said] == ["POSITIVE", "NEGATIVE"]
