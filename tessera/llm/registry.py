"""The queries of this subpackage, by name; SQL where it can express one."""

from __future__ import annotations

from tessera.llm.ann import op1_ann
from tessera.llm.bpe import op5_bpe
from tessera.llm.licenses import op7_licenses
from tessera.llm.mixing import op3_mixing
from tessera.llm.negatives import op13_negatives
from tessera.llm.oracles import LICENSES, NEGATIVES, QUALITY, SECRETS, SHARDING, SIMHASH, SUBSTRINGS, TRIE
from tessera.llm.pii import op8_pii
from tessera.llm.prefix_trie import op12_prefix_trie
from tessera.llm.quality import op4_quality
from tessera.llm.secret_scan import op11_secrets
from tessera.llm.sharding import op9_sharding
from tessera.llm.simhash import op6_simhash
from tessera.llm.substrings import op2_substrings
from tessera.llm.toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_ann, op2_substrings, op3_mixing, op4_quality, op5_bpe, op6_simhash, op7_licenses, op8_pii, op9_sharding, op10_toxicity, op11_secrets, op12_prefix_trie, op13_negatives)
}
SQL: dict[str, str] = {"op2_substrings": SUBSTRINGS, "op4_quality": QUALITY, "op6_simhash": SIMHASH, "op7_licenses": LICENSES, "op9_sharding": SHARDING, "op11_secrets": SECRETS, "op12_prefix_trie": TRIE, "op13_negatives": NEGATIVES}
