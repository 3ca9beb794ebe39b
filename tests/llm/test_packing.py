import zlib
from collections import defaultdict

import numpy as np

from raresift.llm import packing as P


def test_ids_equal_the_tokenizer(rows):
    from tokenizers import Tokenizer

    spec = P.tokenizer_spec()
    whole, own = Tokenizer.from_str(spec), P.WordTokenizer(spec)
    extra = ["don't we'll", "a.b c_d 1,234", "İstanbul ŉ ǅ", "end<|endoftext|>x <|startoftext|>", "a b c\x1cd\x85e", "é ΑΣ ß", "''s 's_'t", "a\tb\nc\rd"]
    for t in [t for _, t in rows] + extra:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_packing(spark, docs, rows):
    spec = P.tokenizer_spec()
    tok = P.WordTokenizer(spec)
    pieces = P.pack(P.token_pieces(docs, spec, 64), 64, group_rows=50).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        ids = tok.encode(t) + np.array([1], "<u4").tobytes()
        want = [(k, 64 * k, len(x) // 4, zlib.crc32(x)) for k, x in enumerate(ids[a : a + 256] for a in range(0, len(ids), 256))]
        assert sorted(by_doc[i]) == want
    total = 0
    for own in by_seq.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 64
        total += at
    assert len(by_seq) <= 1.1 * total / 64 + 2


def test_rule_is_least_sum_of_squares():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 21, 400))[::-1]
    seq, off = P.sum_of_squares(sizes, 20)
    number, gap = np.zeros(21, np.int64), {}
    for s, q, o in zip(sizes.tolist(), seq.tolist(), off.tolist()):
        def after(g):
            n = number.copy()
            if g < 20:
                n[g] -= 1
            if g - s:
                n[g - s] += 1
            return int((n * n).sum())

        open_gaps = [g for g in range(s, 20) if number[g]]
        chosen = gap.get(q, 20)
        assert o == 20 - chosen
        assert after(chosen) == min(after(g) for g in open_gaps + [20])
        if chosen < 20:
            number[chosen] -= 1
        gap[q] = chosen - s
        if chosen - s:
            number[chosen - s] += 1


def test_repeated_rows_and_empty(spark, empty):
    rows = [(1, "a b c")] * 30 + [(None, None)] * 10
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 40 and len({(r["sequence_id"], r["offset"]) for r in got}) == 40
    assert P.pack_documents(empty).count() == 0


def test_ids_can_be_kept(spark, docs, rows):
    got = P.pack_documents(docs, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
