"""Row numbers hold when the cuts of the input change while an operator runs, as when executors come or go."""

import numpy as np
import pytest

import corpus_pipeline as P
from rfcover.llm import common, similar

WORDS = "relay mast valley ridge harbour signal north tower road serves above below stands near coast village".split()


@pytest.fixture()
def recut(spark, monkeypatch):
    """After each staged table the scans of the session are cut anew."""
    cuts, before = [3, 11, 2, 7, 5], {}
    for name in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"):
        before[name] = spark.conf.get(name, None)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")

    def staged(df, name):
        out = common.stage(df, name)
        cuts.append(cuts.pop(0))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cuts[0]))
        return out

    monkeypatch.setattr(similar, "stage", staged)
    monkeypatch.setattr(P, "stage", staged)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _documents(spark, where):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{w}{k}" for w, k in zip(rng.choice(WORDS, 40), rng.integers(0, 60, 40))) for _ in range(150)]
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[:50]]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(24).write.parquet(where)
    return spark.read.parquet(where)


def test_components_with_new_cuts(spark, tmp_path, recut):
    docs = _documents(spark, f"file://{tmp_path}/documents.parquet").selectExpr("doc_id feature_id", "text description")
    got = {r.feature_id: r.component_id for r in similar.similar_descriptions(docs).collect()}
    assert got == {**{i: i for i in range(150)}, **{150 + i: i for i in range(50)}}


def test_pipeline_rows_with_new_cuts(spark, tmp_path, recut):
    docs = _documents(spark, f"file://{tmp_path}/documents.parquet")
    kept = P._kept(docs, lambda rows: P.stage(rows, "judged").where("description LIKE '%changed'"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(150, 200))
