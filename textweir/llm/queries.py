"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from textweir.llm.alignment import op13_cross_tokenizer_alignment
from textweir.llm.chat import OP5_SQL, op5_chat_formatting
from textweir.llm.decontamination import OP4_SQL, op4_winnowing_decontamination
from textweir.llm.embeddings import OP6_SQL, op6_e8_embedding_dedup
from textweir.llm.linededup import op9_content_defined_line_dedup
from textweir.llm.minhash import OP2_SQL, op2_minhash_near_dedup
from textweir.llm.mixing import op11_entropy_balancing
from textweir.llm.packing import op1_binary_packing
from textweir.llm.prefixtrie import OP12_SQL, op12_conversation_prefix_trie
from textweir.llm.secrets import op7_guess_cost_secrets
from textweir.llm.substrings import OP10_SQL, op10_super_kmer_substrings
from textweir.llm.toxicity import op3_crf_toxicity
from textweir.llm.warc import OP8_SQL, op8_warc_transactions

QUERIES = {f.__name__: f for f in (
    op1_binary_packing, op2_minhash_near_dedup, op3_crf_toxicity, op4_winnowing_decontamination, op5_chat_formatting,
    op6_e8_embedding_dedup, op7_guess_cost_secrets, op8_warc_transactions, op9_content_defined_line_dedup, op10_super_kmer_substrings,
    op11_entropy_balancing, op12_conversation_prefix_trie, op13_cross_tokenizer_alignment)}

SQL = {
    "op2_minhash_near_dedup": OP2_SQL, "op4_winnowing_decontamination": OP4_SQL, "op5_chat_formatting": OP5_SQL,
    "op6_e8_embedding_dedup": OP6_SQL, "op8_warc_transactions": OP8_SQL, "op10_super_kmer_substrings": OP10_SQL,
    "op12_conversation_prefix_trie": OP12_SQL}
