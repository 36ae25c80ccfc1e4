"""Alignment against a plain walk over both token lists, and stretches against whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from closebook.llm import alignment
from closebook.llm.queries import QUERIES

ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n  b\n\n c\t\td ", "\n", "a▁b", "▁", "<|endoftext|> x</s><s>", "it's WE'LL 'tis don't", "é é ﬁ ß", "日本語 テキスト　です。", "a b c   d", "\x00\x01\x1c \x1c!", "!\x1c b\x85 c\x85\x85 d",
    "12345 67,890.5", "x" * 5000, "ab " * 3000, "\U0001f600 \U0001f468‍\U0001f469", "{ }\r\n  return;\r\n", "a. b", "same text", "same text", "<0x41> <unk>", "   \n   \n  x   y   ",
]


def plain(rows):
    """Every document by itself: tokens of the whole text, byte ranges compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def ranges(parts):
        at, out = 0, []
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    done = []
    for doc, text in rows:
        if not text:
            done.append((doc, [], [], [], []))
            continue
        raw = (" " + text).encode()
        xs = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ys = [(i, alignment.piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]
        if b"".join(x for _, x in xs) != raw or b"".join(y for _, y in ys) != raw:
            done.append((doc, [], [], [], []))
            continue
        xs, ys = ranges(xs), ranges(ys)
        cuts = sorted({e for _, _, e in xs} & {e for _, _, e in ys})
        links, j = [], 0
        for i, s, e in xs:
            while ys[j][2] <= s:
                j += 1
            k = j
            while k < len(ys) and ys[k][1] < e:
                links.append((i, ys[k][0]))
                k += 1
        done.append((doc, xs, ys, cuts, links))
    holds, top = Counter(p for *_, links in done for p in set(links)), defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    out = []
    for doc, xs, ys, cuts, links in done:
        groups = ";".join(
            ",".join(str(i) for i, s, e in xs if c0 <= s and e <= c1) + "|" + ",".join(str(i) for i, s, e in ys if c0 <= s and e <= c1) for c0, c1 in zip([0, *cuts], cuts, strict=False)
        ) if len(cuts) < 400 else _grouped(xs, ys, set(cuts))
        sha = hashlib.sha256(groups.encode()).hexdigest() if xs else ""
        out.append((doc, len(xs), len(ys), len(cuts), len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links), sha))
    return out


def _grouped(xs, ys, cuts):
    """The same for long texts: both lists are dealt out by walking them."""
    def dealt(tokens):
        out, now = [], []
        for i, _, e in tokens:
            now.append(str(i))
            if e in cuts:
                out.append(",".join(now))
                now = []
        return out

    return ";".join(f"{x}|{y}" for x, y in zip(dealt(xs), dealt(ys), strict=True))


def key(row):
    return tuple(map(repr, row))


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 20])
def test_alignment_equals_the_plain_walk(spark, block_bytes, monkeypatch):
    rng = random.Random(block_bytes)
    letters = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "!", "?!", "'s", "'", "12", "日", " ", "▁", "\r", "\x1c", "ing", "tion", "."]
    texts = ODD + ["".join(rng.choice(letters if rng.random() < 0.3 else letters[:15]) for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "the end", None, None), (3, "the end", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, block int").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(docs, block_bytes=block_bytes).collect()), key=key)
    assert got == sorted(plain([r[:2] for r in rows]), key=key)
    assert alignment.align(docs.limit(0)).count() == 0


def test_groups_and_counts_as_they_are(spark):
    docs = spark.createDataFrame([(1, "unbelievable things"), (2, None), (3, "things")], "doc_id long, text string")
    told = {r.doc_id: r for r in alignment.groups(docs).collect()}
    want = {r[0]: r for r in plain([(1, "unbelievable things"), (2, None), (3, "things")])}
    assert told[2].groups == "" and all(hashlib.sha256(told[i].groups.encode()).hexdigest() == want[i][-1] for i in (1, 3))
    made = alignment.blocks(docs)
    counts = {(r.a, r.b): (r.documents, r.best) for r in alignment.pair_counts(made).collect()}
    assert max(n for n, _ in counts.values()) == 2 and sum(best for _, best in counts.values()) >= len({a for a, _ in counts})


def test_long_text_is_hashed_in_chunks(spark, monkeypatch):
    texts = ["word " * 2000, "", "one more " * 700, "x"]
    path = alignment.default_vocabularies()
    both = alignment.Both(*path)
    whole = alignment.block_of(both, [0, 1, 2, 3], texts)["groups"]
    for chunk in (1, 7, 1000):
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        assert alignment.block_of(both, [0, 1, 2, 3], texts)["groups"] == whole
    assert whole == [r[-1] for r in plain(list(enumerate(texts)))]


def test_whole_texts_where_stretches_are_not_sure():
    both, whole = (alignment.Both(*alignment.default_vocabularies()) for _ in range(2))
    assert both.by_stretch
    whole.by_stretch = False
    for text in filter(None, ODD):
        (x, n), (y, m) = both([text]), whole([text])
        assert n.tolist() == m.tolist() and all(x[k].tolist() == y[k].tolist() for k in x), text


def test_query_equals_the_plain_walk(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_align_tokenizers"](spark, sf).collect()), key=key) == sorted(plain(rows), key=key)
