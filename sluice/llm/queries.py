"""The queries of this subpackage: one for each operator, with production parameters."""

from __future__ import annotations

from functools import wraps

from sluice.llm.arrow_stream import op9_arrow_stream
from sluice.llm.bpe_codec import op7_bpe_codec
from sluice.llm.common import small_batches
from sluice.llm.flac import op4_flac
from sluice.llm.language_mixture import op3_language
from sluice.llm.packing import op1_packing
from sluice.llm.quartile_digest import op5_quartile_digest
from sluice.llm.sharding import op10_sharding
from sluice.llm.simhash import op8_simhash
from sluice.llm.suffix_dedup import op6_suffix_dedup
from sluice.llm.token_counts import op2_token_counts


def registered(query):
    """A query is an application: it sets the session's batch size, operators don't."""

    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: registered(f)
    for f in (op1_packing, op2_token_counts, op3_language, op4_flac, op5_quartile_digest, op6_suffix_dedup, op7_bpe_codec, op8_simhash, op9_arrow_stream, op10_sharding)
}

#: None of these can be said in SQL (tokenizers, checksums, iterative links); tests/llm holds brute-force versions.
ORACLES: dict[str, str] = {}
