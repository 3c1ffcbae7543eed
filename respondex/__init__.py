"""Search over free-text survey answers, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from respondex.models import MODELS, Model, model, word_count_model
from respondex.operators.batch import search_batch
from respondex.operators.cells import build_cells, search_cells, search_cells_batch
from respondex.operators.context import build_context, render_prompts, with_messages
from respondex.operators.embed import (
    EmbeddingStore,
    embed_distinct,
    embed_queries,
    embed_texts,
    pending_texts,
)
from respondex.operators.keys import (
    assign_ids,
    duplicate_keys,
    number_within,
    orphan_keys,
    vector_faults,
)
from respondex.operators.quantised import search_quantised, store_quantised
from respondex.operators.reshape import keep_first, new_texts, split_null_keys, to_long
from respondex.operators.search import display_lines, join_answers, search
from respondex.plans.pipelines import (
    add_texts,
    build,
    prepare_prompt,
    prepare_prompts,
    search_lines,
    search_question,
)
from respondex.schemas import create_tables
from respondex.sources.colocated import buckets_for, read_colocated, store_colocated
from respondex.sources.embeddings import (
    export_embeddings,
    materialize_if_absent,
    model_embeddings,
    read_embeddings,
)
from respondex.sources.survey import read_survey, read_survey_split, write_survey

# Functions of this package travel to the executors as code and not as an import, so that
# it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
