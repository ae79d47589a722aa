"""Language-model scoring with a model of many segments: nothing is broadcast, and no pass over the texts is added."""

import random

from pyspark import SparkContext
from pyspark.sql import functions as F

from geochron.llm import lm_score
from geochron.llm.shared import written


def test_model_is_not_sent_to_every_task(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{draw.randrange(3000)}" for _ in range(30_000)]
    rows = [(i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(300)] + [(300, None), (301, ""), (None, "w1 w2"), (None, "w1 w2")]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), F.pmod("doc_id", F.lit(7)) == 0
    model = written(lm_score.learned(docs.where(~held), 40), "lm-segments")

    def refused(*_):
        raise AssertionError("a broadcast grows with the model")

    monkeypatch.setattr(SparkContext, "broadcast", refused)
    df = lm_score.score_corpus(docs, held, segments=40, broadcast_bytes=1000)
    got = sorted(map(repr, df.collect()))
    assert len(got) == len(rows) and got == sorted(map(repr, lm_score.scored(docs, model, 40).collect()))
    # Another number of segments changes the filter's false items only.
    exact = lambda df: sorted(map(repr, df.drop("score").collect()))
    assert exact(df) == exact(lm_score.score_corpus(docs, held, segments=3))
