"""The registered queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from incidentlens.llm import (
    decontaminate, fingerprints, html_extract, licenses, line_dedup, minhash, pieces, prefix_trie, secrets, token_output, toxicity,
    url_filter, whitening,
)

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_minhash": minhash.op4_minhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_piece_sampling": pieces.op8_piece_sampling,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_output": token_output.op12_token_output,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}

#: The others train, sample, parse or build on positions that SQL does not give; the tests hold them against brute force.
SQL = {
    "op4_minhash": minhash.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
