"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k holds the pieces of more than capacity/(k+1) and at most capacity/k tokens, and each of its bins is
filled with exactly k of them. Since documents may be cut, a document first gives off pieces of exactly
capacity/1, capacity/2, capacity/4, ... tokens (those classes' bins fill without a gap) and only a rest of
less than capacity/SMALLEST goes to the class of its own length, where a bin's gap is small. Every Spark
task packs its own partition and numbers its own sequences; the few pieces in bins that are still open at its
end are cut to fill sequences one after another. So a task leaves at most one badly filled sequence, whatever
the number of documents, and nothing is shuffled.

Defined results: a null or empty text is the end-of-document id alone; repeated rows are packed as often as
they come; an empty table gives no sequence. Other columns do not take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from helixspark.llm.common import bounded_batches, remembered, slices

CAPACITY, END_ID = 2048, 1
#: Pieces are cut exactly down to capacity/SMALLEST.
SMALLEST = 16
CACHE_WORDS = 500_000
#: Marks after a run of letters that the tokenizer splits off, whatever the letters (an apostrophe is not one).
MARKS = ".,;:!?#$%&*"
#: A text that a tokenizer must give the same ids for in parts as whole.
PROBE = "Ab cd.\nef GH'ij 12-x, Straße  ok!"
#: Letters of Latin-1.
LATIN = "".join(c for c in map(chr, range(256)) if c.isalpha())
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds(dict):
    """Ids of text between blanks, as little-endian bytes. This tokenizer never joins ids across white space, so
    a text's ids are those of its blank-separated parts in order. Words met before are remembered.

    A text of Latin-1 is lowered at once, as the tokenizer would do. A run of Latin-1 letters, which has no other form and is one piece, goes
    to the tokenizer's model without the steps before it, apart from any marks behind it; other words take all steps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.bytes_of = [np.array(k, "<u4").tobytes() for k in range(self.tokenizer.get_vocab_size())]
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): level.pre_tokenize_str(c)[0][0] for c in LATIN}
        probes = [PROBE, LATIN, " ".join(LATIN)]
        if any(set(t) <= set(LATIN + MARKS + " ") for t in self.added) or self.texts(probes) != [self.alone(t) for t in probes]:
            raise ValueError(f"{path}: only tokenizers that never join ids across white space, and lower their letters, can be used")

    def alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        head = word.rstrip(MARKS)
        low = head.lower()
        if not head.isalpha() or not low.isalpha():
            ids = self.alone(word)
        elif head != word:
            ids = self[head] + self[word[len(head) :]]
        elif not latin(head):
            ids = self.alone(head)
        elif low != head:
            ids = self[low]
        else:
            ids = b"".join([self.bytes_of[p.id] for p in self.pieces(head if head.isascii() else head.translate(self.spelled))])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def lowered(self, text: str) -> str:
        """The text lowered if that gives the same ids: not if it has other letters, or what lowering makes an added token."""
        if not latin(text):
            return text
        low = text.lower()
        return text if any(t in low for t in self.added) else low

    def texts(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, self.lowered(t).replace("\n", " ").split(" "))) if t else b"" for t in texts]


def word_ids(path: str) -> WordIds:
    """The process's ids for a tokenizer: a Python worker keeps them from one task to the next."""
    return remembered(f"ids of {path}", lambda: WordIds(path))


def cuts(tokens: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces in order: full bins, exact halves, quarters, ..., and the rest."""
    out, k, left = [], 1, tokens
    while left and k <= smallest:
        exact = capacity // k
        out += [(exact, k)] * (left // exact)
        left %= exact
        k *= 2
    if left:
        out.append((left, capacity // left))
    return out


class Packer:
    """Packs one partition. sequence_id: the partition's number and a count within it."""

    def __init__(self, partition: int, capacity: int = CAPACITY):
        self.next_id, self.capacity = partition << 36, capacity
        self.open: dict[int, list[list]] = {}

    def add(self, doc_id, ids: bytes) -> Iterator[list]:
        tokens, start = len(ids) // 4, 0
        for length, k in cuts(tokens, self.capacity):
            waiting = self.open.setdefault(k, [])
            waiting.append([doc_id, start, ids[4 * start : 4 * (start + length)], tokens])
            start += length
            if len(waiting) == k:
                yield from self.close(self.open.pop(k))

    def close(self, pieces: list[list]) -> Iterator[list]:
        at, seq = 0, self.next_id
        self.next_id += 1
        for doc_id, start, ids, tokens in pieces:
            yield [doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, seq, at]
            at += len(ids) // 4

    def finish(self) -> Iterator[list]:
        """What open bins hold, at most k pieces of each class k, cut to fill sequences."""
        filling, room = [], self.capacity
        for k in sorted(self.open):
            for doc_id, start, ids, tokens in self.open[k]:
                while ids:
                    head, ids = ids[: 4 * room], ids[4 * room :]
                    filling.append([doc_id, start, head, tokens])
                    start, room = start + len(head) // 4, room - len(head) // 4
                    if not room:
                        yield from self.close(filling)
                        filling, room = [], self.capacity
        self.open = {}
        if filling:
            yield from self.close(filling)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece. with_ids adds the piece's ids (array<int>), which training reads; without it
    only their checksum is given."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(path), Packer(TaskContext.get().partitionId(), capacity)
        end = np.array([END_ID], "<u4").tobytes()
        fields = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]

        def batch(rows: list[list]) -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
            return pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

        if with_ids:
            plain = packer.close

            def close(pieces):  # keeps each piece's ids beside its row
                for row, piece in zip(plain(pieces), pieces):
                    yield [*row, np.frombuffer(piece[2], "<u4").astype("i4")]

            packer.close = close

            def batch(rows):  # noqa: F811
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)] + [pa.array([r[7] for r in rows], pa.list_(pa.int32()))]
                return pa.RecordBatch.from_arrays(cols, schema=pa.schema([*fields, pa.field("ids", pa.list_(pa.int32()))]))

        for b in batches:
            for lo, hi in slices(b.column(1)):
                rows = [r for d, ids in zip(b.column(0)[lo:hi].to_pylist(), words.texts(b.column(1)[lo:hi].to_pylist())) for r in packer.add(d, ids + end)]
                if rows:
                    yield batch(rows)
        if rows := list(packer.finish()):
            yield batch(rows)

    return docs.select("doc_id", "text").mapInArrow(packed, schema)
