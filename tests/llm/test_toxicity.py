import random
import zlib

from pyspark.sql import functions as F

from claravoz.llm import toxicity
from tests.llm.conftest import make, prose

BAD = ["gronk", "fleck", "vorb", "snarl"]


def corpus(spark, n=400):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(1000 + i, rnd.randint(5, 80)).split(), int(i % 6 == 0)
        for _ in range(toxic * rnd.randint(2, 5)):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return make(spark, rows).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert {d for d, r in rows.items() if r["held_out"]} == set(held)
    assert sum(rows[d]["predicted"] == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())


def test_scores_agree_above_and_below_the_bound(spark):
    """Bad words in ordinary texts too, so that the share of the classes decides close cases."""
    docs, labels = corpus(spark, 900)
    mixed = docs.withColumn("text", F.when(F.col("doc_id") % 6 == 1, F.concat("text", F.lit(" gronk vorb"))).otherwise(F.col("text")))
    whole, bounded = (toxicity.score(mixed, labels, most=most).collect() for most in (10_000, 110))
    scores = {r["doc_id"]: r["score"] for r in whole}
    gap = [r["score"] - scores[r["doc_id"]] for r in bounded]
    assert toxicity.training_texts(mixed, labels, 110)[1][0] > 4
    assert abs(sum(gap)) / len(gap) < 0.02 and sum(abs(g) for g in gap) / len(gap) < 0.04


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_backoff_counts_cover_the_whole_corpus(spark):
    docs, labels = corpus(spark)
    texts = [set(toxicity.words_of(r["text"])) for r in docs.collect()]
    want = {w: sum(w in t for t in texts) for t in texts for w in t}
    assert {r["word"]: r["n"] for r in toxicity.corpus_words(docs).collect()} == want
    total = sum(want.values())
    assert toxicity.shared_chance(docs, {"the", "gronk"}) == {w: want[w] / total for w in ("the", "gronk")}
    assert 0 < toxicity.shared_chance(docs, {"absent"})["absent"] < 1 / total


def test_counts_are_of_distinct_texts(spark):
    texts = spark.createDataFrame([("a b a b", 1), ("a b c", 0), ("c", 0)], "text string, toxic int")
    words = {r["word"]: (r["ordinary"], r["toxic"]) for r in toxicity.word_counts_of(texts).collect()}
    assert words == {"a": (1, 1), "b": (1, 1), "c": (2, 0)}
    pairs = {(r["before"], r["word"]): (r["ordinary"], r["toxic"]) for r in toxicity.pair_counts_of(texts, {"b", "c"}).collect()}
    assert pairs == {("a", "b"): (1, 1), ("b", "c"): (1, 0), ("a", None): (1, 1), ("b", None): (1, 1)}


def test_odd_rows(spark, odd, odd_rows, none):
    docs, labels = corpus(spark)
    both = docs.unionByName(odd.select(docs.columns)) .withColumn("toxic", F.lit(1))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 0, 5), (12, 1, 0), (12, 1, 0)], labels.schema))
    rows = toxicity.score(both, more).collect()
    assert len(rows) == 400 + len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, labels).count() == 0
    unlabelled = toxicity.score(odd, labels.limit(0)).collect()
    assert len(unlabelled) == len(odd_rows) and not any(r["predicted"] for r in unlabelled)
