"""Training passes of the language model."""

from inciflow.llm import lm_scoring
from tests.conftest import SF


def test_two_passes_over_the_training_documents(spark, monkeypatch):
    rates, train = [], lm_scoring.train_round
    monkeypatch.setattr(lm_scoring, "train_round", lambda docs, voc, p, rate: rates.append(rate) or train(docs, voc, p, rate))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert lm_scoring.score_documents(docs).count() == docs.count()
    assert rates == [0.3, 0.15]
