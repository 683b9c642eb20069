"""What Python workers keep between tasks goes when a task of another operator runs in them."""

import gc

import pyarrow as pa
import pytest

import corpus_pipeline
from fleetlens.llm.sentencepiece_fst import Transducer


def encoders(spark):
    """How many compiled models the workers of some tasks hold."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x) is Transducer for x in gc.get_objects())] * b.num_rows})

    return spark.range(0, 64, 1, 64).mapInArrow(run, "n long").groupBy().sum("n").first()[0]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:3], ids=lambda s: s[1].__name__)
def test_no_stage_works_beside_the_encoder(spark, data, stage):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(64).repartition(64).localCheckpoint()
    corpus_pipeline.tokens(spark, docs, data).write.format("noop").mode("overwrite").save()
    assert encoders(spark) > 0
    stage[1](spark, docs, data).write.format("noop").mode("overwrite").save()
    assert encoders(spark) == 0
