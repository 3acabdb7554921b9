"""Rules about what is asked after a comparison, and about spans without a place."""

import pandas as pd

from factsieve.functions import reuse
from factsieve.operators import followups
from factsieve.packs import korean as K
from factsieve.streaming import jobs


def test_only_stated_conditions_are_asked_about(spark):
    docs = spark.createDataFrame([("r", 1, "posting"), ("r", 2, "contract")], "record_id string, seq long, doc_type string")
    item, facet = K.NEW_CONDITION_ITEMS[0], K.RELATE_ITEMS[0][2][0][0]
    rows = [("r", item, "x", "newly_stated", n) for n in (0, 1)] + [("r", K.RELATE_ITEMS[0][0], facet, "not_mentioned_later", n) for n in (0, 1)]
    relations = spark.createDataFrame(rows, "record_id string, item_id string, facet_id string, relation string, stated_docs long")
    assert sorted(r["kind"] for r in followups.relation_candidates(relations, docs).collect()) == ["newly_stated", "not_mentioned_later"]


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


def test_span_stream_takes_unlocated_spans_and_edits_without_region():
    keeper = jobs.SpanKeeper()
    keeper.spans = _Value()
    frame = pd.DataFrame({"rev": [-1, 0], "span_id": [1, None], "kind": ["word", None], "state": ["pending", None], "start": [None, None], "end": [None, None],
                          "new_end": [None, None], "text": ["abc", None]})
    out = next(keeper.handleInputRows(("d",), iter([frame]), None))
    assert out["span_id"].tolist() == [1] and out["start"].isna().all()


def test_steps_drop_only_their_own_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 2)], "_mine int, x int")
    out = reuse.Steps().withColumn("_half", F.col("x") / 2).withColumn("y", F.col("_half")).apply(df)
    assert out.columns == ["_mine", "x", "y"]
