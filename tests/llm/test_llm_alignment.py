"""Aligned tokens against a walk over bytes with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

from compare import TEST_DATA
from helpers import documents, odd_texts
from tillbook.llm import alignment
from tillbook.llm.alignment import BYTE_VOCABULARY, PIECE_VOCABULARY, Side, align_tokenizers, segments_of, vocabularies


@pytest.fixture(scope="module")
def files():
    return tuple(open(path, "rb").read() for path in (BYTE_VOCABULARY, PIECE_VOCABULARY))


@pytest.fixture(scope="module")
def plain():
    """Token bytes and encoders by the libraries, without anything of the operator."""
    a = tokenizers.Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def bytes_a(i):
        return bytes(byte[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, lambda t: b.encode(t), bytes_a, bytes_b


def expected(rows, plain):
    encode_a, encode_b, bytes_a, bytes_b = plain
    held, counts = [], Counter()
    for _, text in rows:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        spelled = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, a)) != spelled or b"".join(map(bytes_b, b)) != spelled:
            held.append(None)
            continue
        ends = [np.cumsum([len(of(i)) for i in ids]).tolist() for of, ids in ((bytes_a, a), (bytes_b, b))]
        places = [{end: k for k, end in enumerate(own, 1)} for own in ends]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = places[0][end], places[1][end]
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = [(x, y) for left, right in groups for x in left for y in right]
        counts.update(set(links))
        held.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), h in zip(rows, held, strict=True):
        if h is None:
            out.append(str((doc_id, 0, 0, 0, 0, 0, 0, "")))
            continue
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in h[2])
        best = sum(counts[link] == most[link[0]] for link in h[3])
        out.append(str((doc_id, h[0], h[1], len(h[2]), len(h[3]), best, sum(counts[x] for x in h[3]), hashlib.sha256(shown.encode()).hexdigest())))
    return sorted(out)


def found(spark, rows, files, **more):
    frame = align_tokenizers(documents(spark, rows, **more), *files)
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(str(tuple(r)) for r in frame.collect())


ODD = [
    "plain words", "  two blanks first", "blanks last   ", "\ttab\n\nlines \r\n", "don't we'll I'm", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "▁marked▁", "naïve café über ß", "日本語 の テキスト", "emoji \U0001f600\U0001f3fd mixed", "zero\x00byte \x07bell", "é combining", " nbsp em",
    "x" * 300, "ab" * 2000, " " * 50, "1234567890 3.14", "ﬁ ligature ﻿ bom", "ẞ ՘ ࢏", "a  b   c    d", "word", "word", "\n", " ",
]


def test_odd_texts_equal_a_walk_over_bytes(spark, files, plain):
    rows = [*((k, t) for k, t in enumerate(ODD, 100)), *odd_texts(), (5, "One line of words only."), (None, "word"), (900, None), (901, "")]
    result = found(spark, rows, files, extra="links times row n_a link best a")
    assert result == expected(rows, plain)
    assert any(row.endswith("'')") for row in result) and str((900, 0, 0, 0, 0, 0, 0, "")) in result
    assert found(spark, [], files) == []


def test_generated_documents(spark, files, plain):
    frame = spark.read.parquet(f"{TEST_DATA}/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    got = sorted(str(tuple(r)) for r in align_tokenizers(frame, *vocabularies(spark)).collect())
    assert got == expected(rows, plain)


def test_small_memories_and_equal_hashes_change_nothing(files, plain, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Beta's", "gammaδ", "12", "—", "zz" * 40]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    sides = Side.byte_level(files[0]), Side.pieces(files[1])

    def plainly(found):
        return [(*x[:4], sorted(zip(x[4].tolist(), x[5].tolist(), strict=True))) for x in found]

    whole = plainly(alignment.Windows(*sides).align(texts))
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 3)
    monkeypatch.setattr(alignment, "KEPT_TOKENS", 1)
    windows = alignment.Windows(*sides)
    assert plainly([windows.align([text])[0] for text in texts]) == whole
    monkeypatch.setattr(alignment, "_MIX", np.uint64(0))
    assert plainly(alignment.Windows(*sides).align(texts)) == whole


def test_encoding_by_ranks_equals_the_library(files, plain):
    side, rng = Side.byte_level(files[0]), random.Random(3)
    letters = "abcdeiou tnsr  EA's't9.,-\n\tßéñüø" + chr(0x200B) + "»"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert side.encode([text], [segments_of(text)])[0].tolist() == plain[0](text)


def test_segments_are_encoded_as_in_the_text(files, plain):
    a, b, rng = Side.byte_level(files[0]), Side.pieces(files[1]), random.Random(4)
    signs = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "a", "Be", "ther", "'s", "12", ".", "é", "日", "\U0001f600", "▁", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        segments = segments_of(text)
        assert "".join(" " + s for s in segments) == " " + text
        assert a.encode([text], [segments])[0].tolist() == plain[0](text), repr(text)
        assert b.encode([text], [segments])[0].tolist() == plain[1](text), repr(text)


def test_a_file_with_merges_in_another_order_is_left_to_the_library(files):
    import json

    file = json.loads(files[0])
    file["model"]["merges"].reverse()
    symbol = alignment._byte_of_symbol()
    table = {bytes(map(symbol.__getitem__, token)): i for token, i in file["model"]["vocab"].items() if all(c in symbol for c in token)}
    assert alignment._by_ranks(file, table) is None
    file["model"]["merges"].reverse()
    assert alignment._by_ranks(file, table) is not None
    assert alignment._by_ranks(file | {"normalizer": {"type": "NFC"}}, table) is None


def test_windows_are_cut_at_anchors_only(files):
    windows = alignment.Windows(Side.byte_level(files[0]), Side.pieces(files[1]))
    windows.align(["one two two one two"])
    assert len(windows.texts) == 2  # " one" and " two", each aligned once
