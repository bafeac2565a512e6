"""Explicit schemas of the records that the library reads and writes."""

from pyspark.sql import types as T


_MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "messages": T.ArrayType(_MESSAGE)}


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, _TYPES[v]) for k, v in fields.items()])


TRACE = _struct(id="string", gen="int", category="string", status="string", correct="boolean", extracted="string", answer="string", has_box="boolean", out_tokens="int", reasoning_chars="int", stop="string", text="string", answer_text="string", error="string")
PROBLEM = _struct(id="string", category="string", status="string", prompt="string", answer="string")
COT = _struct(id="string", prompt="string", answer="string", type="string", generated_cot="string")
CURATED = _struct(id="string", prompt="string", answer="string", type="string", generated_cot="string", source="string")
CHAT = _struct(messages="messages", type="string")
SCORE = _struct(id="string", type="string", correct="boolean", extracted="string", answer="string", tokens="int")
STATE = _struct(slug="string", run="string", ep="int", status="string", attempts="int", submitted_at="string", err="string")
