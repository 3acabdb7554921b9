"""Registered queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from factsieve.llm.cost_packing import op12_cost_packing
from factsieve.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from factsieve.llm.langid import op7_language_id
from factsieve.llm.mixing import OP4_SQL, op4_mixing
from factsieve.llm.ngram_join import op2_ngram_jaccard_join
from factsieve.llm.packing import op5_best_fit_packing
from factsieve.llm.periodic_runs import op11_periodic_runs
from factsieve.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from factsieve.llm.secrets import op9_secret_scans
from factsieve.llm.sitetree import op8_html_extraction
from factsieve.llm.suffix_dedup import op3_suffix_array_dedup
from factsieve.llm.topk import OP6_SQL, op6_exact_top_k
from factsieve.llm.warc import OP1_SQL, op1_warc_transactions

QUERIES = {
    f.__name__: f
    for f in (op1_warc_transactions, op2_ngram_jaccard_join, op3_suffix_array_dedup, op4_mixing, op5_best_fit_packing, op6_exact_top_k,
              op7_language_id, op8_html_extraction, op9_secret_scans, op10_exact_dedup, op11_periodic_runs, op12_cost_packing, op13_prefix_trie)
}

#: The others cannot be said in SQL, or not cheaply on whole tables; tests/llm holds them against brute force or held-out labels.
ORACLE = {"op1_warc_transactions": OP1_SQL, "op4_mixing": OP4_SQL, "op6_exact_top_k": OP6_SQL, "op10_exact_dedup": OP10_SQL,
          "op13_prefix_trie": OP13_SQL}
