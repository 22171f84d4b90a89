import math
import re
from collections import Counter

from pyspark.sql import functions as F

from claravoz.llm import licenses
from tests.llm.conftest import prose

FILES = [
    (1, "a/LICENSE", "MIT License\nReleased under the MIT License."), (2, "a/x.py", prose(1, 20)), (3, "a/b/c/y.py", prose(2, 20)),
    (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "a/b/c/d/z.py", None),
    (6, "a/b/own.py", "# Licensed under the Apache License, Version 2.0.\n" + prose(3, 30)), (7, "top.py", prose(4, 10)), (8, None, ""),
    (9, "a2/LICENSES/x", prose(5, 10)), (10, "q/license.txt", "no notice here"), (None, "a/w.py", prose(6, 10)), (2, "a/x.py", prose(1, 20)),
]


def files(spark):
    return spark.createDataFrame(FILES, "doc_id long, file string, text string").withColumn("licence", F.lit("clash"))


def test_inheritance(spark):
    rows = {(r["doc_id"], r["path"]): (r["licence"], r["origin"], r["from_directory"]) for r in licenses.scan(files(spark), F.col("file")).collect()}
    assert rows[1, "a/LICENSE"] == ("MIT", "own", None)
    assert rows[2, "a/x.py"] == rows[None, "a/w.py"] == ("MIT", "inherited", "a")
    assert rows[3, "a/b/c/y.py"] == ("GPL-3.0", "inherited", "a/b") and rows[5, "a/b/c/d/z.py"] == ("GPL-3.0", "inherited", "a/b")
    assert rows[6, "a/b/own.py"][:2] == ("Apache-2.0", "own")
    assert all(rows[k] == (None, "none", None) for k in [(7, "top.py"), (8, ""), (9, "a2/LICENSES/x"), (10, "q/license.txt")])
    assert licenses.scan(files(spark), F.col("file")).count() == len(FILES)


def test_cosines_match_brute_force(spark):
    lines = ["Released under the MIT License.", "released under MIT license terms by Carol", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0",
             "our general licence policy", "version 2.0 of the public software", "the license license license"] + ["Licensed under CC BY 4.0"] * 3
    tokens = lambda s: [t for t in re.findall(licenses._TOKEN, s.lower()) if t not in licenses.COMMON]
    vocabulary = {t for texts in licenses.NOTICES.values() for n in texts for t in tokens(n)}
    df, total = Counter(t for x in lines for t in set(tokens(x))), len(lines)
    idf = lambda t: math.log((1 + total) / (1 + df[t])) + 1 if t in vocabulary else math.log(1 + total) + 1
    vector = lambda s: {t: n * idf(t) for t, n in Counter(tokens(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for line in set(lines):
        v = vector(line)
        best = min((-round(sum(x * u.get(t, 0) for t, x in v.items()) / (norm(v) * norm(u)), 9), name)
                   for name, texts in licenses.NOTICES.items() for n in texts for u in [vector(n)])
        if -best[0] >= 0.3:
            want[line] = (best[1], -best[0])
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r["line"]: (r["licence"], r["cosine"]) for r in licenses.matched_lines(table, licenses.NOTICES, 0.3).collect()}
    assert got == want and got["Licensed under CC BY-NC 4.0."][0] == "CC-BY-NC-4.0"


def test_odd_rows(odd, odd_rows, none):
    assert licenses.scan(odd, F.col("source")).count() == len(odd_rows)
    assert licenses.scan(none, F.col("source")).count() == 0


def test_lines_of_words_that_are_rare_in_the_corpus_only(spark):
    """Where the corpus is full of a notice's own words, the others decide."""
    lines = ["licensed gnu affero license x"] * 200 + ["general public 3"]
    docs = spark.createDataFrame([(i, "f", x) for i, x in enumerate(lines)], "doc_id long, file string, text string")
    want = {r["line"]: r["licence"] for r in licenses.matched_lines(docs.select(F.col("text").alias("line")), licenses.NOTICES, 0.7).collect()}
    got = licenses.scan(docs, F.col("file")).where("doc_id = 200").first()
    assert want["general public 3"] is not None and (got["licence"], got["n_lines"]) == (want["general public 3"], 1)
    glued = spark.createDataFrame([(1, "f", "2Released 3mit 4license.")], "doc_id long, file string, text string")
    assert licenses.scan(glued, F.col("file"), least=0.3).first()["licence"] == "MIT"
