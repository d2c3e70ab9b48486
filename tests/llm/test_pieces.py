"""The pieces that a worker remembers take bounded room, and forgetting them changes no id."""

import public_tokenizers

from postsieve.llm import prefix_bpe as P


def test_pieces_remembered():
    c = P.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    letters = "etaoinsrhl"
    text = lambda a, b: " ".join("".join(letters[int(d)] for d in str(i)) for i in range(a, b))
    first = c.encode(text(0, 1000))
    for a in range(0, 420_000, 20_000):
        c.encode(text(a, a + 20_000))
    assert len(c.young) + len(c.old) <= 400_000
    assert c.encode(text(0, 1000)) == first and c.decode(first) == text(0, 1000).encode()
