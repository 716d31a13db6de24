"""Cross-tokenizer alignment against a walk over both whole token sequences."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spikelens.llm.token_align import align

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def letters():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def expected(texts):
    a, b, table = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH), letters()
    a.encode_special_tokens = True
    found, holds = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                  b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        if any(b"".join(x for _, x in side) != want for side in (left, right)):
            found.append(None)
            continue
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        cuts = [[bisect_left(ends, e) for _, _, e in side] for side in spans]
        groups = [[[], []] for _ in ends]
        for k, side in enumerate(spans):
            for (i, _, _), g in zip(side, cuts[k], strict=True):
                groups[g][k].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in groups]
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        holds.update(set(links))
        found.append((len(left), len(right), groups, links))
    best = defaultdict(int)
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        f[0], f[1], len(f[2]), len(f[3]), sum(holds[p] == best[p[0]] for p in f[3]), sum(holds[p] for p in f[3]),
        hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


ODD = [
    None, "", "a", " lead", "tail ", "two  spaces", "a\n\nb\n c", "one\ntwo.\nThree, four", "▁x y", "a ▁ b",
    "<s> </s> <|endoftext|> <0x41> x", "ｆｕｌｌ ﬁ é x", "日本 語 テスト　x y", "don't we'll 'S 's", "\x00 a\x01 b", "é á b ñandú",
    "\t \r\n x", "🙂 🙂🙂 a 🙂", "x  y  z", "²³ ½ x", "1 22 333 , . ! ?? a-b_c", "same text", "same text",
    "a" * 5000, "word " * 4000 + "end", "ab.\n\nCd", "x\u0085 y", "é clair",
]


@pytest.mark.parametrize("part", [1 << 20, 8000])
def test_alignment_equals_a_walk(spark, part):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [*enumerate(ODD, 10_000), *((r.doc_id, r.text) for r in rows)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in align(frame, A_PATH, B_PATH, part=part).collect()}
    want = dict(zip((d for d, _ in docs), expected([t for _, t in docs]), strict=True))
    assert got == want


def test_null_and_repeated_keys_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a c"), (None, None)], "key long, body string")
    docs = docs.selectExpr("key", "body", "1 n_a", "2 uid", "3 pairs", "4 text", "5 doc", "6 times")
    got = sorted(tuple(r) for r in align(docs, A_PATH, B_PATH, doc="key", text="body").select("n_a", "count_sum").collect())
    assert got == [(0, 0), (2, 4), (2, 5), (2, 5)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align(docs, A_PATH, B_PATH).collect() == []
