"""Batches of the file ingest are whole or absent, however a run ends."""

import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from claravoz.operators import quality
from claravoz.streaming import files


class Ingest:
    def __init__(self, spark, root):
        self.spark, self.root, self.cleaned = spark, root, 0
        (root / "drop").mkdir()

    def drop(self, name, content):
        (self.root / "drop" / name).write_text(content)

    def run(self, state="state"):
        def clean(batch):
            self.cleaned += 1
            return batch.withColumn("x", F.upper("x"))

        files.ingest_stream(self.spark, f"{self.root}/drop", ["x", "y"], f"{self.root}/out", f"{self.root}/{state}", clean).awaitTermination()

    def rows(self):
        found = files.committed(self.spark, f"{self.root}/out")
        return sorted((r["batch_id"], r["row_status"], r["x"]) for r in found.collect()) if "x" in found.columns else []

    def counts(self):
        return sorted((r["batch_id"], r["good"], r["malformed"]) for r in files.manifests(self.spark, f"{self.root}/out").collect())


@pytest.fixture
def ingest(spark, tmp_path):
    return Ingest(spark, tmp_path)


def test_death_between_data_and_audit_shows_neither(ingest, monkeypatch):
    assert ingest.rows() == [] and ingest.counts() == []
    ingest.drop("a.csv", "x,y\na,1\nb,2\nc,3,4\n")
    whole = quality.validate_audit

    def dies(audits):
        raise RuntimeError("lost")

    monkeypatch.setattr(quality, "validate_audit", dies)
    with pytest.raises(StreamingQueryException):
        ingest.run()
    assert list((ingest.root / "out" / "batch_id=0").glob("*/*.parquet")) and ingest.rows() == [] and ingest.counts() == []
    monkeypatch.setattr(quality, "validate_audit", whole)
    ingest.run()
    want = [(0, "good", "A"), (0, "good", "B"), (0, "malformed", "C")]
    assert ingest.rows() == want and ingest.counts() == [(0, 2, 1)]
    ingest.drop("b.csv", "x,y\nd,1\n")
    monkeypatch.setattr(quality, "validate_audit", dies)
    with pytest.raises(StreamingQueryException):
        ingest.run()
    assert ingest.rows() == want  # what was whole before stays so
    monkeypatch.setattr(quality, "validate_audit", whole)
    ingest.run()
    assert ingest.rows() == [*want, (1, "good", "D")] and ingest.counts() == [(0, 2, 1), (1, 1, 0)]


def test_death_before_the_checkpoint_runs_nothing_twice(ingest):
    ingest.drop("a.csv", "x,y\na,1\n")
    ingest.run()
    for name in ("0", ".0.crc"):
        (ingest.root / "state" / "commits" / name).unlink()
    cleaned, data = ingest.cleaned, {p.name for p in (ingest.root / "out").rglob("*.parquet")}
    ingest.run()
    assert ingest.cleaned == cleaned and {p.name for p in (ingest.root / "out").rglob("*.parquet")} == data
    assert ingest.rows() == [(0, "good", "A")]


def test_another_checkpoint_is_refused(ingest):
    ingest.drop("a.csv", "x,y\na,1\n")
    ingest.run()
    with pytest.raises(StreamingQueryException, match="another query"):
        ingest.run("other")
    shutil.rmtree(ingest.root / "state")
    with pytest.raises(StreamingQueryException, match="another query"):
        ingest.run()  # a new checkpoint in the old place counts its batches anew
    assert ingest.rows() == [(0, "good", "A")]
