"""The queries of the subpackage; importing this module registers them all."""

from contestry.llm import lbl, licenses, packing, periodic, pieces, prefix_trie, quality, risk_rules, sharding, simhash, sketch, superminhash, url_filter  # noqa: F401
from contestry.llm.common import ORACLES, QUERIES  # noqa: F401
