import zlib
from collections import defaultdict

import cases
import numpy as np
from conftest import SF

from contestry.llm import packing, pieces


def test_pack_places_every_token_once():
    rng = np.random.default_rng(3)
    for lengths in (np.array([], int), np.array([2048]), np.array([1]), rng.integers(1, 2049, 700), np.full(50, 1500), np.full(9, 2047)):
        parts, sequences = defaultdict(list), defaultdict(list)
        for piece, at, n, s, offset in packing.pack(lengths.astype(np.int64)):
            parts[piece].append((at, n))
            sequences[s].append((offset, n))
        assert len(parts) == len(lengths)
        for i, spans in parts.items():
            assert sorted(spans)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), [*sorted(spans)[1:], (lengths[i], 0)]))
        for spans in sequences.values():
            spans.sort()
            total = sum(n for _, n in spans)
            assert all(a + n == b for (a, n), (b, _) in zip(spans, [*spans[1:], (total, 0)])) and spans[0][0] == 0
            assert total == 2048 or total & (total - 1) == 0


def check_packed(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = defaultdict(int)
    for doc, text in docs:
        want[(doc, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
        by_doc[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sum(r.length for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        mine = [r for r in by_doc[doc, len(ids) // 4] if r.ids == ids[4 * r.start:4 * (r.start + r.length)]]
        assert sum(r.length for r in mine) >= n * len(ids) // 4


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packed([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(docs).collect())


def test_pack_odd_and_empty(spark, monkeypatch):
    docs = cases.odd(spark)
    rows = packing.pack_documents(docs).collect()
    check_packed([(r.doc_id, r.text) for r in docs.collect()], rows)
    assert packing.pack_documents(cases.empty(spark)).count() == 0


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.TOKENIZER), packing.WordEncoder(packing.TOKENIZER, most=3)
    texts = ["don't STOP!! now... #tag's", "a\x1cb \u2003wide\u00a0space", "ΣΑΣ. Σ İstanbul!", "<|endoftext|> x<|startoftext|>.", "e\u0301e\u0301. n\u0303, ½. ²!", "ab.cd. ,,, '' 's. it's."]
    for _ in range(3):
        got = encode([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_equals_tokenizer_at_every_code_point():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.TOKENIZER), packing.WordEncoder(packing.TOKENIZER)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 50_000):
        texts = [t for c in points[at:at + 50_000] for t in (f"a{c}.", f"{c}B!? x{c}y")]
        want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for t, x, ids in zip(texts, encode([t.encode() for t in texts]), want):
            assert np.frombuffer(x, "<u4").tolist() == ids, repr(t)
    texts = ["<|ENDOFTEXT|>a.", "<|endoftext|>a.", "THE\u0130. A\u0958!", "x<|startoftext|>. <b>c."] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def reference(texts):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.MODEL)
    ids = model.encode(texts)
    return ids, [model.decode(x) for x in ids]


def test_pieces_equal_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = pieces.encode(docs)
    ids, _ = reference([texts[d] for d in texts])
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == dict(zip(texts, ids))
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == texts


def test_pieces_odd(spark):
    texts = ["", "  a  b\nThe héllo\t世界 <s> <0x0A>", "aaaa aaaaaaa" * 9, "▁▁▁ x   ", "   ", "\x00\x01 😀😀 e\u0301", "x" * 3000, "lorem     ipsum" + " " * 40 + "y"]
    own = pieces.Codec(pieces.MODEL, most=2)
    ids, decoded = reference(texts)
    for _ in range(2):
        got = [np.frombuffer(own.encode([t])[0], "<u4").tolist() for t in texts]
        assert got == ids and [own.decode(x) for x in got] == decoded
    rows = pieces.encode(cases.odd(spark)).collect()
    assert len(rows) == len(cases.ROWS) and all(not r.ids for r in rows if r.doc_id in (3, 4))
    assert pieces.decode(pieces.encode(cases.empty(spark))).count() == 0


def test_pieces_encode_a_part_once_whatever_stands_beside_it(monkeypatch):
    own, seen, words = pieces.Codec(pieces.MODEL), [], pieces.Pieces.words
    monkeypatch.setattr(pieces.Pieces, "words", lambda self, new: seen.extend(new) or words(self, new))
    texts = [f"one{a}\ttwo{b} one" for a in ".,;!" for b in ".,;!"] + ["", "one two"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == reference(texts)[0]
    assert len(seen) == len(set(seen)) <= 9  # one and two behind a space, two behind a tab, the tab and four marks


def test_pieces_equal_library_at_code_points():
    from sentencepiece import SentencePieceProcessor

    model, own = SentencePieceProcessor(model_file=pieces.MODEL), pieces.Codec(pieces.MODEL)
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 61)] if not 0xD800 <= c <= 0xDFFF]
    texts = [t for c in points for t in (f"a{c}.", f"{c}{c} x{c}y")]
    for t, x, ids in zip(texts, own.encode(texts), model.encode(texts)):
        assert np.frombuffer(x, "<u4").tolist() == ids, repr(t)


def test_pieces_decode_joins_surfaces(spark):
    own = pieces.Codec(pieces.MODEL)
    byte = own.pieces.byte_id.tolist()
    lists = [[], [byte[0xE2]], [byte[0xE2], byte[0x96], byte[0x81], byte[0x41]], [0, 1, 2], [byte[0xC3], byte[0xA9], *range(300, 340)], list(range(3000, 3050))]
    want = [b"".join(own.pieces.surface[i] for i in ids).decode(errors="replace").replace(pieces.SPACE, " ") for ids in lists]
    want = [t[1:] if t[:1] == " " else t for t in want]
    assert [own.decode(ids) for ids in lists] == want
    rows = spark.createDataFrame([(i, ids) for i, ids in enumerate([*lists, None])], "k long, ids array<int>").repartition(1)
    assert {r.k: r.text for r in pieces.decode(rows).collect()} == dict(enumerate([*want, ""]))
