"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best fit: a task holds a fixed number of open bins.  A
bitset with one bit for each amount of free space says which amounts are on
offer; its lowest bit at or above a piece's length names the fullest bin that
takes the piece.  If none does and all bins are in use, the fullest one closes
first.  A piece is placed the moment it is read, so a task's memory is its open
bins, whatever the number of rows.  Pieces come in order of falling length, which
Spark's sort provides: the long ones open the bins that the short ones fill.

With ``added_tokens`` ids are those of the library's ``encode`` for the file as
it is: the strings of its added tokens (``<|endoftext|>``) get their own ids.
Without, they are ordinary text, as with the library's ``encode_special_tokens``.

Null text counts as empty.  A document's ids are its tokens and the end id, so
an empty one is the single end id.  Only documents longer than a sequence are
cut: their first piece takes the remainder, all others are full.  Repeated rows
and rows with a null id are packed like any other; an empty table gives an
empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.tables import release
from wordloom.operators.ranking import materialize

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 32_768          # open bins of a packing task
PIECES_PER_TASK = 32_768    # pieces shorter than a sequence that a task packs, about
CACHED_WORDS = 400_000      # a tokenising task forgets its cache beyond this many pre-tokens

# Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def _latin_split():
    """The same pattern for texts below U+0250, in the faster standard module."""
    import re
    import unicodedata

    def of(kind):
        return "".join(map(re.escape, (chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)))

    letter, number = of("L"), of("N")
    space = r"\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      rf"|[{space}]+(?![^{space}])|[{space}]+")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 0x100 + k for k, b in enumerate(rest)}


class TokenCache(dict):
    """Pre-token -> its ids as little-endian bytes; a miss is tokenised on its own, as the vocabulary's pattern allows."""

    def __init__(self, tokenizer_path: str | None, added_tokens: bool = False):
        import re

        import regex
        from tokenizers import Tokenizer
        if tokenizer_path is None:
            import public_tokenizers
            tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
        # the model alone: texts are split here, at added tokens and then by the pattern
        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()} if added_tokens else {}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that strip or stand alone are not split here")
        self.added = {s: i.to_bytes(4, "little") for s, (i, _) in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.beyond, self.latin, self.any = re.compile("[^\x00-ɏ]"), _latin_split(), regex.compile(SPLIT)

    def __missing__(self, word: str):
        spelt = word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelt)])
        return ids

    def ids(self, text: str, end_id: int) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        split = self.any if self.beyond.search(text) else self.latin
        if self.at_added and self.at_added.search(text):
            found = [self.added[s] if k % 2 else b"".join(map(self.__getitem__, split.findall(s)))
                     for k, s in enumerate(self.at_added.split(text))]
        else:
            found = map(self.__getitem__, split.findall(text))
        return np.frombuffer(b"".join(found) + end_id.to_bytes(4, "little"), "<u4")


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; all but the first have ``seq_len``."""
    head = (n - 1) % seq_len + 1
    return [(0, head)] + [(s, seq_len) for s in range(head, n, seq_len)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQUENCE, end_id: int = END_ID,
                    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                    added_tokens: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]); reads nothing but the two columns."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        import pyarrow as pa
        cache = TokenCache(tokenizer_path, added_tokens)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = cache.ids(text.as_py() or "", end_id)
                for k, (s, n) in enumerate(cut(len(ids), seq_len)):
                    row.append(i), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(ids[s:s + n].tobytes()))
                    if with_ids:
                        kept.append(ids[s:s + n].astype(np.int32))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)
        cache.clear()
        release()

    return src.mapInArrow(run, T.StructType(fields))


class OpenBins:
    """The open bins of one task: ``place(length)`` gives (sequence, offset)."""

    def __init__(self, seq_len: int, open_bins: int, first: int = 0):
        self.seq_len, self.open_bins, self.next = seq_len, open_bins, first
        self.mask, self.count = 0, 0                  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            del self.by_free[free]
            self.mask ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, sequence, self.next = self.seq_len, self.next, self.next + 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(sequence)
            self.mask |= 1 << left
            self.count += 1
        return sequence, self.seq_len - free


def assign_sequences(pieces: DataFrame, seq_len: int = SEQUENCE, open_bins: int = OPEN_BINS,
                     pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces.

    Pieces are dealt by a hash of all that tells them apart, so one long
    document or one source spreads over all tasks.  More rows give more tasks,
    not larger ones.
    """
    short = pieces.filter(F.col("length") < seq_len).count()
    tasks = max(1, -(-short // pieces_per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("__at", order).repartition(tasks, "__at").sortWithinPartitions(
        F.col("length").desc(), "__at", "doc_id", "piece")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    given, names = pieces.columns, schema.names

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        bins = OpenBins(seq_len, open_bins, first=TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            kept = [batch.column(c) for c in given]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
                names=names)

    return dealt.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQUENCE, end_id: int = END_ID,
         open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Pack whole documents: one row per piece with its place, and its ids if ``with_ids``."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, seq_len, end_id, id_col, text_col, with_ids, added_tokens), "pieces")
    return assign_sequences(pieces, seq_len, open_bins)
