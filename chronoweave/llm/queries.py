"""The registered queries of this folder and the SQL that must give the same rows."""

from __future__ import annotations

from chronoweave.llm.bpe import op5_bpe
from chronoweave.llm.decontamination import OP11_SQL, op11_benchmark_decontamination
from chronoweave.llm.embeddings import OP9_SQL, op9_embedding_near_dedup
from chronoweave.llm.extraction import OP7_SQL, op7_html_extraction
from chronoweave.llm.jaccard import op8_ngram_jaccard_join
from chronoweave.llm.licenses import op1_license_scan
from chronoweave.llm.lm import op4_lm_scoring
from chronoweave.llm.packing import op2_best_fit_packing
from chronoweave.llm.quality import OP10_SQL, op10_quality_rules
from chronoweave.llm.search import OP13_SQL, op13_ranked_lexical_search
from chronoweave.llm.toxicity import op3_toxicity
from chronoweave.llm.warc import OP6_SQL, op6_warc
from chronoweave.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_html_extraction": op7_html_extraction,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}
ORACLES = {
    "op6_warc": OP6_SQL,
    "op7_html_extraction": OP7_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_benchmark_decontamination": OP11_SQL,
    "op13_ranked_lexical_search": OP13_SQL,
}
