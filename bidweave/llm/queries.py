"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidweave.llm.bpe import op7_bpe
from bidweave.llm.fingerprints import op3_fingerprints
from bidweave.llm.importance import OP13_SQL, op13_suffix_resampling
from bidweave.llm.katz import op10_katz
from bidweave.llm.language import op8_language_id
from bidweave.llm.minhash import op5_minhash
from bidweave.llm.negatives import OP11_SQL, op11_voronoi_negatives
from bidweave.llm.packing import op2_packing
from bidweave.llm.pii import op1_pii_pseudonyms
from bidweave.llm.pivots import op4_pivot_dedup
from bidweave.llm.quality import op6_quality
from bidweave.llm.sharding import op12_virtual_slots
from bidweave.llm.url_filters import OP9_SQL, op9_url_filters
from bidweave.session import ship

_QUERIES = [op1_pii_pseudonyms, op2_packing, op3_fingerprints, op4_pivot_dedup, op5_minhash, op6_quality, op7_bpe, op8_language_id, op9_url_filters, op10_katz, op11_voronoi_negatives, op12_virtual_slots, op13_suffix_resampling]
ORACLES = {"op9_url_filters": OP9_SQL, "op11_voronoi_negatives": OP11_SQL, "op13_suffix_resampling": OP13_SQL}


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in _QUERIES}
