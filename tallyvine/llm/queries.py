"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from . import merkle, warc
from .avi import op9_avi
from .fingerprint import op2_fingerprints
from .jaccard import op6_jaccard
from .language import op3_language
from .packing import op1_packing
from .periodic import op11_periodic
from .pieces import op5_sentencepiece
from .secrets import op4_secrets
from .simhash import op12_simhash
from .token_counts import op10_token_counts
from .toxicity import op7_toxicity

QUERIES = {"op1_packing": op1_packing, "op2_fingerprints": op2_fingerprints, "op3_language": op3_language, "op4_secrets": op4_secrets, "op5_sentencepiece": op5_sentencepiece, "op6_jaccard": op6_jaccard, "op7_toxicity": op7_toxicity, "op8_warc": warc.op8_warc, "op9_avi": op9_avi, "op10_token_counts": op10_token_counts, "op11_periodic": op11_periodic, "op12_simhash": op12_simhash, "op13_merkle": merkle.op13_merkle}

SQL: dict[str, str] = {"op8_warc": warc.SQL, "op13_merkle": merkle.SQL}
