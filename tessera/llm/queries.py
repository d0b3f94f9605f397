"""The operators' queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.epsilon_join import OP1_SQL, op1_epsilon_join
from tessera.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tessera.llm.language_id import op5_language_id
from tessera.llm.mixing import OP7_SQL, op7_mixing
from tessera.llm.ngram_join import op2_ngram_jaccard_join
from tessera.llm.pitman_yor import op8_pitman_yor
from tessera.llm.secret_scan import OP11_SQL, op11_secret_scan
from tessera.llm.sentencepieces import op4_sentencepiece
from tessera.llm.suffix_dedup import op9_suffix_dedup
from tessera.llm.toxicity import op10_toxicity
from tessera.llm.url_filter import OP3_SQL, op3_url_filter
from tessera.llm.whitening import op12_whitening

QUERIES = {
    "op1_epsilon_join": op1_epsilon_join,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_url_filter": op3_url_filter,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_secret_scan": op11_secret_scan,
    "op12_whitening": op12_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_epsilon_join": OP1_SQL,
    "op3_url_filter": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op11_secret_scan": OP11_SQL,
}
