"""Schemas of the engine's tables."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, I, D, B = StringType(), IntegerType(), DoubleType(), BooleanType()

SENTENCE = _struct(id=S, doc_id=S, text=S, n_words=I, band=S, fact_idx=ArrayType(I), n_facts=I)
OP = _struct(kind=S, src=S, dst=S, source=S)
WORD_PLAN = StructType([StructField("idx", I), StructField("gold", S), StructField("out", S), StructField("ops", ArrayType(OP)), StructField("intensity", D), StructField("dropped", B)])
DAMAGE = _struct(
    id=S, doc_id=S, gold_text=S, gold_tokens=ArrayType(S), band=S, severity=S, k=I, frac=D, anchor_idx=I, span_start=I, span_end=I,
    damaged_idx=ArrayType(I), ops_per_word=ArrayType(WORD_PLAN), corrupted_text=S, mask_positions=ArrayType(I), fact_idx_in_span=ArrayType(I), seed=I, split=S,
)
SLOT = _struct(idx=I, out=S, dropped=B, lead=S, core=S, trail=S, anchor=B, fact=B)
PREDICTION = _struct(
    id=S, severity=S, split=S, method=S, method_version=S, model_name=S, slots_in=S, raw_output=S, pred_words=ArrayType(S),
    spliced_text=S, format_ok=B, error=S, seconds=D, timestamp=TimestampType(),
)
PREDICTION_KEY = ["id", "severity", "method", "method_version"]

#: Levels of damage in their order; as strings they don't sort.
LEVELS = ["0", "1w", "10", "25", "50", "75"]
CONFIG = {
    "seed": 42,
    "bands": [(20, 29), (30, 44), (45, 60)],
    "min_words": 20, "max_words": 60, "min_fact_tokens": 2, "min_fact_tokens_fallback": 1, "fallback_pool_threshold": 170, "max_per_doc": 3,
    "n_test": 150, "n_dev": 20,
    "intensity_low": 0.20, "intensity_high": 0.30, "max_deletions": 2, "drop_prob": 0.10, "p_deletion": 0.25,
}
