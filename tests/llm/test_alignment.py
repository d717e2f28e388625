from __future__ import annotations

import hashlib
import json
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from fieldloom.llm import alignment as A

SPECIAL = ["a <|endoftext|> b <s> </s> <unk>", "<0x41> x", "▁ lower one", "a▁b", " ", "\n", "  two  spaces \r\n tab\t", "é中文😀 ﬁ\u0085\xa0x", "nul\x00here", "'s we'll can't 12345 3.14", "x" * 3000]


def brute(texts: list[str | None]) -> list[tuple]:
    """Token by token, in plain Python."""
    import sentencepiece
    from tokenizers import Tokenizer

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a_path = public_tokenizers.path(A.BYTE_LEVEL)
    vocabulary = {k: bytes(letters[c] for c in t) for t, k in json.load(open(a_path))["model"]["vocab"].items()}
    a_model = Tokenizer.from_file(a_path)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.PIECES))

    def ranges(ids, spell):
        out, at = [], 0
        for k in ids:
            out.append((k, at, at + len(spell(k))))
            at += len(spell(k))
        return out

    def piece(k):
        p = b_model.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(k) else p.replace("▁", " ").encode()

    documents = []
    for t in texts:
        if not t:
            documents.append(([], []))
            continue
        a = ranges(a_model.encode(" " + t, add_special_tokens=False).ids, vocabulary.__getitem__)
        b = ranges(b_model.encode(t), piece)
        same = b"".join(vocabulary[k] for k, _, _ in a) == b"".join(piece(k) for k, _, _ in b) == (" " + t).encode()
        documents.append((a, b) if same else ([], []))
    links = []
    for a, b in documents:
        own, j = [], 0
        for x, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            own += [(x, y) for y, s2, e2 in b[j : j + e - s + 1] if s2 < e and s < e2]
        links.append(own)
    counts = Counter(p for own in links for p in own)
    most: dict[int, int] = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (a, b), own in zip(documents, links, strict=True):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(x) for x, s, _ in a if low <= s < e) + "|" + ",".join(str(x) for x, s, _ in b if low <= s < e))
            low = e
        text = ";".join(groups)
        out.append((len(a), len(b), len(ends), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def found(df, spark, **more):
    got, pairs = A.align(df, **more)
    return [tuple(r) for r in got.orderBy("doc_id").collect()], pairs


@pytest.mark.parametrize("frequent", [A.FREQUENT, 50, 1])
def test_as_brute_force(spark, rows, frequent):
    """Whatever share of the pairs is joined and not broadcast."""
    texts = [*(t if t is None or len(t) < 5000 else t[:5000] for _, t, *_ in rows), *SPECIAL]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, _ = found(df, spark, frequent=frequent)
    assert got == [(k, *x) for k, x in enumerate(brute(texts))]


def test_quick_encoder_as_the_file_says(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(A.BYTE_LEVEL))
    model.encode_special_tokens = True
    texts = [t for _, t, *_ in rows if t] + SPECIAL
    assert A.byte_level(public_tokenizers.path(A.BYTE_LEVEL)).encode(texts) == [model.encode(f" {t}", add_special_tokens=False).ids for t in texts]


def test_groups_by_hand():
    a = A.Tokens.of(list, [b"ab", b"c", b"de"])
    b = A.Tokens.of(list, [b"a", b"bc", b"d", b"e"])
    lists = A.lists([[0, 1, 2], [], [2]]), A.lists([[0, 1, 2, 3], [], [2, 3]])
    got = A.aligned(*lists, a, b)
    assert sorted(zip(got.link_docs, got.link_a, got.link_b, strict=True)) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 2, 3), (2, 2, 2), (2, 2, 3)]
    n, hashed = A.digests(got, 3, a, b)
    assert n.tolist() == [2, 0, 1] and hashed == [hashlib.sha256(b"0,1|0,1;2|2,3").hexdigest(), "", hashlib.sha256(b"2|2,3").hexdigest()]


def test_odd_tables(spark, empty):
    """Empty tables, rows that share an id or have none, columns whose names the work uses."""
    assert found(empty, spark)[0] == []
    rows = [(7, "one text", 1, "x", 2), (7, "one text", 1, "x", 2), (None, "one text", 1, "x", 2), (8, None, 1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, ids_a string, N long")
    got, pairs = found(df, spark)
    assert len({x[1:] for x in got if x[0] != 8}) == 1 and [x[0] for x in got] == [None, 7, 7, 8]
    assert {r["n"] for r in pairs.collect()} == {3} and all(r["best"] for r in pairs.collect())
    assert A.spelled(A.lists([[0]]), A.Tokens.of(list, [b"q"])).to_pylist() == [b"q"]
    assert pa.types.is_list(A.lists([]).type)
