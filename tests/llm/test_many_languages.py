"""op5 learns every language, however many there are."""

import numpy as np

from loomspark.llm import language


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language.ByteNetwork, "fit", lambda self, cut, labels: setattr(self, "seen", np.bincount(labels)))
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 70:02d}") for i in range(1400)], "doc_id long, text string, lang string")
    assert len(language.train(docs).languages) == 70
    monkeypatch.setattr(language, "TRAIN_DOCS", 140)
    found = language.train(docs)
    assert len(found.languages) == 70 and found.seen.max() <= 2
