"""Schemas of the inputs."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _of(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


S, L, D = StringType(), LongType(), DoubleType()

BENCHMARK = _of(dataset=S, doc=S, claim=S, label=L, contamination_identifier=S)
ANSWER = _of(type=S, noul=D, score=D, choice=S, probabilities=MapType(S, D), confidence=D)
PREDICTION = _of(
    id=S, input_hash=S, pack_hash=S, model=S, answers=MapType(S, ANSWER), scores=MapType(S, D), usage=_of(input_tokens=L, output_tokens=L),
    seconds=D, attempts=IntegerType(), document_truncated=BooleanType(), request_seconds=D,
)
PROBABILITY_CACHE = _of(id=S, answers=MapType(S, D), prompt_tokens=L)
LOGIT_CACHE = _of(id=S, logits=MapType(S, ArrayType(D)), prompt_tokens=L)
CHUNK_CACHE = _of(id=S, score=D, n_chunks=L)
CLAIM = _of(claim_id=S, claim=S, candidate_documents=ArrayType(S))
ANNOTATION = _of(index=L, cluster=S, assessment=S, reason=S)
