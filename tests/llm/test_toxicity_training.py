"""Training reads whole texts."""

import numpy as np

from provloom.llm import toxicity


def test_a_late_passage_is_learned(spark):
    """Long texts that are toxic only after their first 100,000 bytes."""
    rng = np.random.default_rng(4)
    plain = [f"plain{i}" for i in range(300)]

    def text(i):
        return " ".join(rng.choice(plain, 14_000)) + (" vile zzgrub snark" * 3 if i % 2 else "")

    docs = spark.createDataFrame([(i, text(i)) for i in range(60)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).where("held_out").collect()
    assert len(got) > 5 and all(r.predicted == r.doc_id % 2 for r in got)
    assert toxicity.fit(docs, labels).mean[2 * len(toxicity.STEPS)] > np.log(1700)  # windows of whole texts
