import numpy as np
import pytest

from raresift.llm import sentencepiece as S


@pytest.fixture(scope="module")
def vocab():
    return S.Vocabulary(S.default_path())


def unigram_library(tmp_path):
    """The same vocabulary as a unigram model of the public library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(S.default_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=path)


def brute(codec, vocab, text):
    """Best score by plain dynamic programming over all pieces."""
    score = {p: s for p, s, k in zip(vocab.pieces, vocab.scores, vocab.kinds) if k == S.NORMAL}
    t = S.SPACE + text.replace(" ", S.SPACE)
    best = [0.0] + [-1e18] * len(t)
    for end in range(1, len(t) + 1):
        best[end] = best[end - 1] + codec.unknown
        for start in range(max(0, end - 24), end):
            if t[start:end] in score:
                best[end] = max(best[end], best[start] + score[t[start:end]])
    return best[-1]


def total(codec, vocab, ids):
    out, i = 0.0, 0
    while i < len(ids):
        if vocab.kinds[ids[i]] == S.BYTE:
            first = int(vocab.pieces[ids[i]][3:-1], 16)
            i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            out += codec.unknown
        else:
            out += vocab.scores[ids[i]]
            i += 1
    return out


TEXTS = ["hello world", "a  b\n c é 𐍈", "Keit das die.", "   ", "the  of\n\nthere", "naïve ß", "aaaaaaa" * 9, "x" * 300]


def test_best_segmentation(vocab):
    c = S.Codec(vocab)
    for t in TEXTS:
        ids = np.frombuffer(c.encode(t), "<u4").tolist()
        assert total(c, vocab, ids) == pytest.approx(brute(c, vocab, t))
        assert c.decode(ids) == t


def test_never_worse_than_public_library(vocab, tmp_path):
    lib, c = unigram_library(tmp_path), S.Codec(vocab)
    for t in ["hello world", "a b c", "Keit das die.", "the of there", "naïve"]:
        ids = np.frombuffer(c.encode(t), "<u4").tolist()
        assert total(c, vocab, ids) >= total(c, vocab, lib.encode(t))


def test_round_trip_over_a_table(spark, docs, rows, vocab):
    got = {r["doc_id"]: r for r in S.round_trip(docs, vocab).collect()}
    assert len(got) == len(rows) and all(r["restored"] for r in got.values())
    assert got[[i for i, t in rows if t is None][0]]["n_tokens"] == 0
    back = {r["doc_id"]: r["text"] for r in S.decode(S.encode(docs, vocab), vocab).collect()}
    assert all(back[i] == (t or "").replace(S.SPACE, " ") for i, t in rows)


def test_empty_table(empty, vocab):
    assert S.round_trip(empty, vocab).count() == 0
