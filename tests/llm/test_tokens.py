import random

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from dossier.llm.tokens import PieceTokenizer  # noqa: E402


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_the_library(name):
    t = PieceTokenizer(P.path(name))
    rng = random.Random(3)
    chars = ["a", "B", "é", "É", "ß", " ", "  ", "\n", "\t", "1", "23", ".", ",", "'s", "'", "don't", " ", "　", "日本", "é", "́", "Σ", "ΑΣ", "😀", "×", "÷", "<|endoftext|>", "\x1c", "\r\n", "²", "“", "İ", "the", " of", "ing", "\\", "###", " ", "\x0b", "ª", "·"]
    texts = ["", " ", "\n\n", "a", " a", "a ", "a  b", "a \n b", "a  b", "   Y", "The and 1234, (x) don't.\n\nÉtude à 5%%%"]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for part in (texts[:1500], texts[1500:], texts[::3]):
        ids, at = t.encode(pa.array(part))
        for i, x in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == t.whole.encode(x, add_special_tokens=False).ids, repr(x)
