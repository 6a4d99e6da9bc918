"""Words taken apart from the punctuation after them, against the tokenizers library."""

import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from siltbed.llm.tokens import WordTokenizer, default_path


def test_words_share_their_letters():
    tok, own = Tokenizer.from_file(default_path()), WordTokenizer(default_path(), keep=4)
    texts = [
        "one beta, beta. beta! beta beta,.;:!?*#%$&| beta\nbeta,\nbeta\n.\n,a", "one", "", None, "beta,", "x \nb", "don't. 3.5. a-b, ,a, ,.\n, 'tis, it's!",
        "über, Éè. ߀, x²! naïve; क़, e\u0301. \ud7a3, 漢字. Ⅷ, ª.", "a  b, c,  d. " + "long" * 30 + ", " + "long" * 30 + "! end", "z <|endoftext|> beta, y",
    ]
    for _ in range(3):  # with words that are new, kept, and dropped
        got = [b.tolist() for b in own.id_arrays(texts)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    kept = WordTokenizer(default_path())
    kept.id_arrays(["one beta, beta. beta! beta beta?! beta; beta"])
    assert set(kept._young) == {"beta"}


def test_letters_are_the_pre_tokenizers():
    """What Arrow takes for a letter is one to the pre-tokenizer, so punctuation after it is a piece of its own."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    letters = [c for c, x in zip(every, pc.utf8_is_alpha(pa.array(every)).to_pylist(), strict=True) if x]
    cut = Tokenizer.from_file(default_path()).pre_tokenizer.pre_tokenize_str("".join(f" a{c}b," for c in letters))
    assert len(cut) == 2 * len(letters) > 100_000 and {p for p, _ in cut[1::2]} == {","}
