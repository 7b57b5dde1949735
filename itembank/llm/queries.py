"""All queries of this package; importing this module registers them."""
from itembank.llm import ann, extract, manifest, mixing, ngram_join, pieces, repeats, setsketch, token_counts, token_files, topk, toxicity, trie  # noqa: F401
from itembank.llm.common import ORACLE, QUERIES  # noqa: F401
