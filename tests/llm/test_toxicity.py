import random

import pytest

from scrubline.llm import toxicity as T
from scrubline.llm.common import table

SF = "/root/testdata/sf0.1"


def test_swaps_and_features():
    assert T.swapped({"women", "stone", "gay"}) == {"men", "stone", "lesbian"}
    assert T.features_of({"abc", "abcde", "abcdef"}) == {"abc", "abcde", "abcdef", "^abcd"}


def test_penalty_lowers_weight_of_identity_terms(spark):
    """Toxic texts mention one group more often; a neutral mention must not be flagged."""
    rng = random.Random(1)
    filler = [f"word{c}" for c in "abcdefghijklmnopqrstuvw"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        w = rng.choices(filler, k=12)
        if toxic and rng.random() < .9:
            w += [rng.choice(["idiot", "scum"])]
        if rng.random() < (.8 if toxic else .02):
            w += [rng.choice(["muslim", "gay", "women"])]
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = T.train(docs, lab, penalty=0.0), T.train(docs, lab, penalty=20.0)
    neutral = "the worda wordb {} wordc"
    gap = lambda m: abs(m.score(neutral.format("muslim")) - m.score(neutral.format("christian")))
    assert gap(plain) > 0.3 and gap(fair) < gap(plain) / 3
    assert fair.score("worda idiot wordb") >= 0.7
    assert fair.score(neutral.format("muslim")) < 0.7 <= plain.score(neutral.format("muslim")) or gap(fair) < 0.1


@pytest.fixture(scope="module")
def result(spark):
    return T.op6_toxicity(spark, SF).toPandas()


def test_held_out_accuracy(spark, result):
    labels = table(spark, SF, "labels").toPandas()
    assert len(result) == table(spark, SF, "documents").count()
    assert result.score.between(0, 1).all() and (result.predicted == (result.score >= 0.7)).all()
    held = result[result.held_out].merge(labels[labels.toxic.notna()], on="doc_id")
    tp = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert tp >= 0.8 * (held.toxic == 1).sum() and tp >= 0.95 * (held.predicted == 1).sum()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "Idiot", "c"), (2, "x" * 100_000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        got = T.score(docs, T.train(docs, lab)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert T.score(docs.limit(0), T.Model({}, 0.0)).count() == 0
