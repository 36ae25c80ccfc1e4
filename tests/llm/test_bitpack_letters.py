"""Words of small letters go to the model straight, words are cut by whole arrays, and a call's words are looked up once each."""

import random
import re

from closebook.llm import bitpack

PIECES = [*"abzAZ019.,'-!{}~@[`/:;?", *"éÉß÷ÿ×ŁſKİ中ªµ", "\u0301", "\U0001f600", "\0", "\x01", "\x1c", "\x85", "\u00a0", *" \t\n\x0b\r" * 3, "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL"]
MARKS = re.compile(r"([a-zß-öø-ÿ])([!-/:-@\[-`{-~]+)(?=[ \t-\r]|\Z)")


def made(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(rng.choice([1, 9, 60])))) for _ in range(n)]


def plainly(text: str) -> list[bytes]:
    if "<|" in text:
        return text.encode().split()
    return MARKS.sub(r"\1 \2", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).encode().split()


def test_words_are_cut_as_text_by_text():
    for seed in range(60):
        texts = made(seed, seed % 30)
        if seed % 2:
            texts = [t.replace("<|", "") for t in texts]
        words, before = bitpack.words_of([t.encode() for t in texts])
        assert words.to_pylist() == [w for t in texts for w in plainly(t)]
        assert before.tolist() == [sum(len(plainly(t)) for t in texts[: i + 1]) for i in range(len(texts))]


def test_ids_are_the_librarys():
    encode = bitpack.Encoder(bitpack.default_vocabulary(), 2)
    texts = made(1, 3000)
    ids, ends = encode([t.encode() for t in texts])
    for text, begin, end in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
        assert ids[begin:end].tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_words_of_letters_pass_normalizing_and_are_looked_up_once():
    encode = bitpack.Encoder(bitpack.default_vocabulary(), 2)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghïßÿ") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(100)]
    whole, index, asked = encode.tokenizer, encode.index, []

    class Once:
        columns = property(lambda self: index.columns)

        def __call__(self, words):
            asked.extend(words)
            return index(words)

    encode.tokenizer, encode.index = None, Once()
    ids, ends = encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in (*whole.encode(t, add_special_tokens=False).ids, 2)]
    assert len(asked) == len(set(asked)) == len({w for t in texts for w in t.split()}) + 1
