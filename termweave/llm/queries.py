"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from termweave.llm.bpe import op3_bpe
from termweave.llm.langid import op10_language_id
from termweave.llm.media import op4_media
from termweave.llm.minhash import OP2_SQL, op2_minhash
from termweave.llm.mixing import op7_mixing
from termweave.llm.repeats import OP9_SQL, op9_repeats
from termweave.llm.syncmer import op8_syncmers
from termweave.llm.toxicity import op5_toxicity
from termweave.llm.url_filter import OP1_SQL, op1_url_filters
from termweave.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_minhash": op2_minhash,
    "op3_bpe": op3_bpe,
    "op4_media": op4_media,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_syncmers": op8_syncmers,
    "op9_repeats": op9_repeats,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op2_minhash": OP2_SQL, "op6_warc": OP6_SQL, "op9_repeats": OP9_SQL}
