"""Words are encoded many to a text, with the ids that each has alone."""

import random

from closebook.llm import bitpack


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_share_texts_and_keep_their_ids():
    rng = random.Random(3)
    encode = bitpack.Encoder(bitpack.default_vocabulary(), 2)
    whole, encode.tokenizer = encode.tokenizer, Counting(encode.tokenizer)
    words = ["".join(rng.choice("abcdefgXYZ019.,'-é́ \u0085中\U0001f600\u0000\u0002") for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]
    texts += ["", " ", " ", "a\x01b \x01 c", "\x01\x01", "x<|endoftext|>y plain", "odd <| words \x01"]
    ids, ends = encode([t.encode() for t in texts])
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text
        begin = end
    apart = bitpack.Encoder(bitpack.default_vocabulary(), 2)
    apart.tokenizer = Counting(apart.tokenizer)
    apart([" ".join(words).encode()])
    assert apart.tokenizer.texts < len(apart.index.ids) / 10
