"""The corpus operators' queries and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from docmill.llm.bpe import op3_bpe
from docmill.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from docmill.llm.fingerprints import LINKS_SQL, fingerprint_links, op10_fingerprints
from docmill.llm.html_extract import op8_html
from docmill.llm.licenses import OP6_SQL, op6_licenses
from docmill.llm.mixing import OP1_SQL, op1_mixing
from docmill.llm.near_dedup import OP5_SQL, op5_near_dedup
from docmill.llm.periodic_runs import op13_periodic_runs
from docmill.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from docmill.llm.quality import op2_quality
from docmill.llm.token_count import op9_token_counts
from docmill.llm.toxicity import op7_toxicity
from docmill.llm.url_filters import op11_url_filters

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_licenses": op6_licenses,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_url_filters": op11_url_filters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
    # the other half of operator 10: bands of its fingerprints, joined and verified
    "fingerprint_links": fingerprint_links,
}

#: The others are not SQL: models, a tokenizer, tree alignment, signatures; tests hold them against brute force.
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op5_near_dedup": OP5_SQL, "op6_licenses": OP6_SQL, "op12_prefix_trie": OP12_SQL, "fingerprint_links": LINKS_SQL}
