"""All stages of the pipeline over rows with nulls, repeats and clashing columns, and over no rows."""

import corpus_pipeline
import pytest
from packloom.llm.common import stage


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_odd_documents(spark, folder, odd_documents, empty):
    docs = odd_documents.where("false") if empty else odd_documents
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, folder), name)
        assert docs.columns == odd_documents.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.count() == 0 if empty else packed.count() >= docs.count()
