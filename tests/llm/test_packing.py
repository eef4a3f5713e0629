import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textweir.llm import packing

TEXTS = ["", None, "Two  words,\tand\nA LINE", "don't <|endoftext|> stop", "\u00c9t\u00e9 \u65e5\u672c \U0001f642", "x" * 300 + " y " * 2100]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers_own(spark, name):
    """Whether or not a tokenizer splits at white space."""
    own = Tokenizer.from_file(public_tokenizers.path(name))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int")
    rows = sorted(packing.pack(docs, name).collect(), key=lambda r: (r.doc_id, r.start))
    for i, t in enumerate(TEXTS):
        ids = b"".join(bytes(r.tokens) for r in rows if r.doc_id == i)
        want = [*own.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == want
        assert [r.length for r in rows if r.doc_id == i] == packing.piece_lengths(len(want))
    assert packing.drops_spaces(own) == name.startswith("word")
