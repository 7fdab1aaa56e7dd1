"""The subpackage's queries, by name."""

from __future__ import annotations

import corpus_pipeline

from .decontamination import op6_decontamination
from .html_text import op8_html_text
from .line_dedup import op2_line_dedup
from .mixing import op10_mixing
from .ngram_join import op4_ngram_join
from .pii import op1_pii
from .quality import op7_quality
from .secrets import op9_secrets
from .suffix_dedup import op5_suffix_dedup
from .url_filters import op3_url_filters

QUERIES = {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_url_filters, op4_ngram_join, op5_suffix_dedup, op6_decontamination, op7_quality, op8_html_text, op9_secrets, op10_mixing)} | {"pipeline": corpus_pipeline.run}
#: None of the ten methods is expressible in SQL as a whole; tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {}
