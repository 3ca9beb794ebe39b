"""SentencePiece encoding and decoding over whole texts.

An Aho-Corasick automaton over the pieces drives a single-pass Viterbi: at
every end position the matches that the output links give (longest first)
relax the best score of that position; characters without a piece fall back to
their UTF-8 byte pieces at a penalty below every score.  Ties keep the longest
last piece.  No piece of the vocabulary spans a word start or a line feed, so
the best segmentation of a text is the concatenation of those of its words
(checked when the vocabulary is loaded; otherwise whole texts are segmented),
and the words of a batch are segmented once: the memory of a worker is bounded
by ``MEMO`` words and one Arrow batch.

The vocabulary (a bounded file, its path a parameter) is read on the driver
and travels inside the function.  Map-only: no shuffle, lost tasks just rerun.

Defined results: null and empty texts have no tokens; repeated rows give equal
rows; ``U+2581`` in a text decodes to a space, as in every such model.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from raresift.llm.catalog import register
from raresift.llm.common import read

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 300_000
MEMO_CHARS = 48
#: piece types of the model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.kinds = [
            UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else UNUSED if sp.is_unused(i) else NORMAL
            for i in range(n)
        ]
        self.key = (path, n, zlib.crc32("\n".join(self.pieces).encode()))


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        self.byte_ids = [0] * 256
        used, usable = [], []
        self.texts = []
        for i, (piece, kind) in enumerate(zip(vocab.pieces, vocab.kinds)):
            if kind == BYTE:
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.texts.append(bytes([value]))
            else:
                self.texts.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
            if kind == NORMAL:
                used.append(vocab.scores[i])
                usable.append(piece)
                self.trie.add_word(piece, (len(piece), vocab.scores[i], i))
        self.trie.make_automaton()
        self.unknown = min(used) - UNKNOWN_PENALTY
        by_word = all("\n" not in p and (SPACE not in p.lstrip(SPACE)) for p in usable)
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if by_word else "(?s).+")
        self.memo: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Single-pass Viterbi over the matches of the automaton."""
        n = len(text)
        best = [0.0] + [-np.inf] * n
        back = [(0, -1)] * (n + 1)
        done = 0  # every position up to here has its unknown-character edge
        unknown = self.unknown
        for end, (size, score, i) in self.trie.iter(text):
            while done < end:
                done += 1
                if best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                    back[done] = (done - 1, -1)
            stop = end + 1
            s = best[stop - size] + score
            if s > best[stop]:
                best[stop] = s
                back[stop] = (stop - size, i)
        while done < n:
            done += 1
            if best[done - 1] + unknown > best[done]:
                best[done] = best[done - 1] + unknown
                back[done] = (done - 1, -1)
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i < 0:
                ids.extend(self.byte_ids[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass")))
            else:
                ids.append(i)
            at = start
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        memo = self.memo
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        out = []
        for w in words:
            got = memo.get(w)
            if got is None:
                got = np.array(self.segment(w), "<u4").tobytes()
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> str:
        texts = self.texts
        joined = b"".join([texts[i] for i in ids])
        return joined.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}


def codec(vocab: Vocabulary) -> Codec:
    """The worker's codec of a vocabulary (built once per worker)."""
    if vocab.key not in _CODECS:
        _CODECS.clear()
        _CODECS[vocab.key] = Codec(vocab)
    return _CODECS[vocab.key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids`` array<int> of every whole text."""

    def run(batches):
        c = codec(vocab)
        for b in batches:
            parts = [c.encode(x) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in parts])
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[id_col, "ids"]
            )

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and ``text`` of every id sequence (null: null)."""

    def run(batches):
        c = codec(vocab)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    src = tokens.select(id_col, ids_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, ids, n_tokens,
    ids_crc32, decoded_sha256 and whether the text came back."""

    def run(batches):
        c = codec(vocab)
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = [c.encode(x) for x in texts]
            ends = np.cumsum([0] + [len(p) // 4 for p in parts])
            back = [c.decode(np.frombuffer(p, "<u4").tolist()) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    pa.array([x == (t or "").replace(SPACE, " ") for x, t in zip(back, texts)], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"))),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "restored", "ids"],
            )

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, restored boolean, ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


@register("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and what they decode to."""
    return round_trip(read(spark, sf_dir, "documents"), Vocabulary(default_path()))
