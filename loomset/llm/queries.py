"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .cotraining import op8_quality_classifier
from .idfiles import op3_token_ids
from .jaccard import op5_ngram_jaccard
from .langid import op10_language_id
from .lattice import op7_lattice_scores
from .lines import op4_line_dedup
from .mixing import OP1_SQL, op1_mixing
from .neighbours import op2_nearest_neighbours
from .packing import op6_packing
from .rules import op9_quality_rules


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_nearest_neighbours, op3_token_ids, op4_line_dedup, op5_ngram_jaccard, op6_packing, op7_lattice_scores, op8_quality_classifier, op9_quality_rules, op10_language_id, pipeline)}
ORACLES = {"op1_mixing": OP1_SQL}
