"""Best-fit packing by sums of squares.

Documents become token ids plus an end id; only those longer than a sequence
are cut.  Pieces are placed by the sum-of-squares rule: among all open
sequences, described by their residual gap, and a new one, take the place after
which the sum over gaps of (number of open sequences with that gap)^2 is
smallest (ties: the smaller gap).  Longer pieces come first.

At scale the pieces are dealt into groups of about ``group_rows`` rows, each
packed by its own task with two arrays of one number per gap.  Sequences that a
group leaves open are few; their pieces are packed again together with those of
the other groups, in fewer groups, until one group is left.  Only piece lengths
move, never texts or ids.

Defined results: a null text is empty and has just the end id; repeated rows
are separate documents; an empty table gives an empty result; a text of any
length is cut into pieces of full length and a last, shorter one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.llm.catalog import register
from raresift.llm.common import materialize, read

MAX_TOKENS = 4096
END_ID = 1
GROUP_ROWS = 32_768
MEMO = 300_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ"
#: a run of letters, then a run of ASCII punctuation without the apostrophe
_SIMPLE = re.compile(f"([{_LETTERS}]*)([!-&(-/:-@\\[-`{{-~]*)")


class WordTokenizer:
    """Ids of a text, word by word.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words one after another; words are encoded once and
    kept (at most ``MEMO`` of them).  A word of plain letters and punctuation
    is handed to the BPE model without the general text preparation.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # bytes as the characters that byte-level vocabularies write for them
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.letters = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other)}}

    def _general(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        got = self.parts.get(run)
        if got is None:
            text = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
            got = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(run) <= 32:
                if len(self.parts) >= MEMO:
                    self.parts.clear()
                self.parts[run] = got
        return got

    def word(self, word: str) -> bytes:
        m = _SIMPLE.fullmatch(word)
        if m is None:
            return self._general(word)
        letters, marks = m.groups()
        return (self._run(letters.lower()) if letters else b"") + (self._run(marks) if marks else b"")

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        memo = self.memo
        words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join(map(memo.__getitem__, words))  # most texts have known words only
        except KeyError:
            pass
        out = []
        for w in words:
            got = memo.get(w)
            if got is None:
                got = self.word(w) if w else b""
                if len(w) <= 48:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = got
            out.append(got)
        return b"".join(out)


_TOKENIZERS: dict[int, WordTokenizer] = {}


def word_tokenizer(spec: str) -> WordTokenizer:
    key = zlib.crc32(spec.encode())
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(spec)
    return _TOKENIZERS[key]


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's text (a bounded vocabulary)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def token_pieces(docs: DataFrame, spec: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        tok = word_tokenizer(held.value)
        end = np.array([END_ID], "<u4").tobytes()
        size = 4 * max_tokens
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = tok.encode(text) + end
                for p, at in enumerate(range(0, len(ids), size)):
                    rows.append((doc, p, at // 4, ids[at : at + size]))
            cols = list(zip(*rows)) or [(), (), (), ()]
            arrays = [
                pa.array(cols[0], b.column(0).type),
                pa.array(cols[1], pa.int32()),
                pa.array(cols[2], pa.int64()),
                pa.array([len(x) // 4 for x in cols[3]], pa.int64()),
                pa.array([zlib.crc32(x) for x in cols[3]], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0] + [len(x) // 4 for x in cols[3]])
                values = pa.array(np.frombuffer(b"".join(cols[3]), "<i4"))
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    src = docs.select("doc_id", "text")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return src.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of every length, in the given order, and
    thereby the gap each sequence keeps; see the module text for the rule."""
    number = np.zeros(max_tokens + 1, np.int64)  # of open sequences, by gap
    open_at: list[list[int]] = [[] for _ in range(max_tokens + 1)]
    seq = np.empty(len(lengths), np.int64)
    off = np.empty(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = number[s:max_tokens]  # gaps s .. max-1 that can take the piece
        change = 2 * (number[: max_tokens - s] - gaps + 1)
        if len(gaps):
            change[0] = 1 - 2 * gaps[0]  # a closed sequence counts no more
            change[gaps == 0] = np.iinfo(np.int64).max
            j = int(change.argmin())
            cost = change[j]
        else:
            j, cost = 0, np.iinfo(np.int64).max
        fresh = 2 * number[max_tokens - s] + 1 if s < max_tokens else 0
        if cost <= fresh and len(gaps):
            gap = s + j
            at = open_at[gap].pop()
            number[gap] -= 1
        else:
            gap, at = max_tokens, used
            used += 1
        seq[i], off[i] = at, max_tokens - gap
        left = gap - s
        if left:
            open_at[left].append(at)
            number[left] += 1
    return seq, off


def _place_group(max_tokens: int, base: int):
    """Packs one group (an Arrow table with ``length``, ``_row``, ``_group``)."""

    def place(key, table):
        table = table.drop_columns(["_group"]).sort_by([("length", "descending"), ("_row", "ascending")])
        lengths = table.column("length").to_numpy().astype(np.int64)
        seq, off = sum_of_squares(lengths, max_tokens)
        gap = max_tokens - np.bincount(seq, weights=lengths).astype(np.int64)[seq]
        table = table.append_column("sequence_id", pa.array(seq + (base + (key[0].as_py() << 30))))
        return table.append_column("offset", pa.array(off)).append_column("_gap", pa.array(gap))

    return place


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, group_rows: int = GROUP_ROWS, max_gap: int = 16) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of at most
    ``max_tokens``.  A sequence with a gap over ``max_gap`` is packed again."""
    cols = pieces.columns
    rest = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    n, level, parts = rest.count(), 0, []
    added = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "_gap")]
    schema = T.StructType(rest.schema.fields + added)
    while True:
        groups = max(1, -(-n // group_rows))
        group = F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups))
        done = rest.withColumn("_group", group).groupBy("_group").applyInArrow(_place_group(max_tokens, level << 58), schema)
        if groups == 1 or level == 6:
            parts.append(done)
            break
        done = materialize(done)
        parts.append(done.where(F.col("_gap") <= max_gap))
        rest = done.where(F.col("_gap") > max_gap).drop("sequence_id", "offset", "_gap")
        n, level = rest.count(), level + 1
        if n == 0:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*cols, "sequence_id", "offset")


def pack_documents(docs: DataFrame, spec: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack whole documents; one row per piece."""
    return pack(token_pieces(docs, spec or tokenizer_spec(), max_tokens, with_ids), max_tokens)


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"))
