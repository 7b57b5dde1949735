"""Queries of the package and those that SQL can express."""
from itembank.llm import queries


def test_oracles():
    assert set(queries.ORACLE) == {"op9_top_k", "op11_manifest", "op12_prefix_trie"}
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
