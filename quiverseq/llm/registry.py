"""The queries of this subpackage, by name, and their DuckDB SQL."""

from __future__ import annotations

from .bpe import op10_bpe
from .hmm import op9_hmm
from .jaccard import OP2_SQL, op2_jaccard
from .linededup import OP4_SQL, op4_line_dedup
from .media import op7_media, page_sequences
from .mixing import OP8_SQL, op8_mixing
from .quality import op3_quality
from .sharding import op5_sharding
from .spotsigs import op6_fingerprints, spotsigs_classes
from .urlfilter import op1_url_filter


def _pipeline(spark, sf_dir: str):
    """The whole corpus pipeline at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_jaccard": op2_jaccard,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_fingerprints": op6_fingerprints,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_hmm": op9_hmm,
    "op10_bpe": op10_bpe,
    "spotsigs_classes": spotsigs_classes,
    "page_sequences": page_sequences,
    "pipeline": _pipeline,
}

ORACLE = {
    "op2_jaccard": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op8_mixing": OP8_SQL,
}
