"""Named queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from larkspur.plans import corpus, dialogue, evaluation, retrieval, units

QUERIES: dict = {**retrieval.QUERIES, **corpus.QUERIES, **evaluation.QUERIES, **dialogue.QUERIES, **units.QUERIES}

#: Columns whose type the SQL engine widens, and the type they have here.
TYPES = {
    **dict.fromkeys(["bm25_topk", "bm25_scoped_topk", "dense_l2_topk", "rrf_fusion", "page_rank", "diverse_pages", "local_rerank", "local_rerank_all", "debug_items"], {"rank": "int"}),
    "companies_mentioned": {"place": "int"},
    "page_expand": {"rank": "int", "n_chars": "int"},
    "line_flags": {"n_table": "bigint", "n_heading": "bigint"},
    "fixed_chunks": {"n_chars": "int"},
    "refusal_matrix": dict.fromkeys(["tp", "fp", "fn", "tn", "measured", "unclassified"], "bigint"),
    "token_cost": {"measured_queries": "bigint"},
    "paired_lift": {"paired": "bigint"},
    "win_tie_loss": dict.fromkeys(["wins", "ties", "losses"], "bigint"),
    "split_integrity": dict.fromkeys(["other_splits", "answerable_a", "answerable_b"], "bigint"),
    "requested_metrics": {"place": "int"},
    "trace_ids": {"place": "int"},
}


def _typed(sql: str, types: dict[str, str]) -> str:
    return f"select * replace ({', '.join(f'{c}::{t} as {c}' for c, t in types.items())}) from ({sql})" if types else sql


SQL: dict = {name: _typed(sql, TYPES.get(name, {})) for name, sql in {**retrieval.SQL, **corpus.SQL, **evaluation.SQL, **dialogue.SQL, **units.SQL}.items()}
