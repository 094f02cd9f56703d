"""SentencePiece encoding and decoding with a fixed public BPE model, whose path is a parameter.

The encoder never runs the merge loop over a text. A piece sequence is what merging yields exactly if each pair of neighbours is
compatible: merging the two strings' concatenation alone gives back these two. So every prefix of a text has one last
piece: of the pieces that end there (an automaton over the vocabulary lists them), the one that is compatible with the last piece of the prefix
before it. The table of last pieces is filled from left to right, a number a character, and the ids are recovered from
its end backwards: linear in the text's length, also for a text without blanks.

Between two characters that stand side by side in no piece of the vocabulary (something and a blank after it, a letter and a full stop, around
a line's end) no piece goes on, so the table starts anew there, and a stretch between such places is encoded once and remembered by the worker.

Defined results: a null text is empty; an empty text is the end id alone; a missing id list decodes to null. Repeated rows are encoded as often
as they come; an empty table gives no rows; columns other than doc_id and text take no part. Models of other kinds, or with rules of their own for
normalising, are refused rather than encoded differently.
"""

from __future__ import annotations

import codecs
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixspark.llm.common import bounded_batches, remembered, slices

BLANK = "▁"
#: Stretches and pairs that a worker remembers, and characters at most of a stretch that it does.
CACHE_STRETCHES, CACHE_PAIRS, CACHED_LENGTH = 400_000, 1_000_000, 64
#: Characters of a text that are split into stretches at once.
PART = 1 << 20
#: Bytes of the texts that are cut up together.
SLICE = 3 << 20
NONE, NEVER = -1, float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merging:
    """How merging one piece's own characters goes: each merge's rank (lower goes first) and the string at either end after it."""

    __slots__ = ("first", "last", "ranks", "lefts", "rights", "whole")

    def __init__(self, piece: str, rank: dict[str, float]):
        parts = list(piece)
        self.first, self.last = parts[0], parts[-1]
        self.ranks: list[float] = []
        self.lefts: list[str] = []
        self.rights: list[str] = []
        while len(parts) > 1:
            best, at = min((rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.ranks.append(best)
            self.lefts.append(parts[0])
            self.rights.append(parts[-1])
        self.whole = len(parts) == 1
        self.ranks.append(NEVER)


class Pieces:
    """A model's vocabulary, its automaton, and what has been learned of pairs and stretches so far."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        rules, made = model.normalizer_spec, model.trainer_spec
        if (
            made.model_type != sentencepiece_model_pb2.TrainerSpec.BPE
            or not made.byte_fallback
            or made.treat_whitespace_as_suffix
            or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not (rules.add_dummy_prefix and rules.escape_whitespaces)
            or model.denormalizer_spec.precompiled_charsmap
            or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces)
        ):
            raise ValueError("only BPE models with byte fallback, a blank put in front and no other normalising are supported")
        self.strings = [p.piece for p in model.pieces]
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.controls = {k for k, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.end = self.ids.get("</s>", next(k for k, s in enumerate(self.strings) if s == "</s>"))
        self.end_bytes = array("i", [self.end]).tobytes()
        raw = {k: b for b, k in self.bytes.items()}
        self.surface = [
            bytes([raw[k]]) if k in raw else b"" if k in self.controls else (made.unk_surface if p.type == kind.UNKNOWN else p.piece.replace(BLANK, " ")).encode()
            for k, p in enumerate(model.pieces)
        ]
        self.fronted = {k for p, k in self.ids.items() if p.startswith(BLANK)}
        self.sizes = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.silent, self.leads = np.zeros(len(self.surface), bool), np.zeros(len(self.surface), bool)
        self.silent[list(self.controls)] = self.leads[list(self.fronted)] = True
        self.automaton = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.automaton.add_word(p, (k, len(p)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids))
        # Characters by number, and which two of them stand side by side in some piece.
        letters = sorted({c for p in self.ids if len(p) > 1 for c in p})
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1,) * 2, bool)
        for x, y in {pair for p in self.ids for pair in zip(p, p[1:])}:
            self.together[number[x], number[y]] = True
        self.merging: dict[int, Merging] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def string(self, token: int) -> str:
        """A piece's string; characters outside the vocabulary are tokens below NONE."""
        return self.strings[token] if token >= 0 else chr(NONE - 1 - token)

    def merges(self, token: int) -> Merging:
        found = self.merging.get(token)
        if found is None:
            found = self.merging[token] = Merging(self.string(token), self.rank)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the strings of a and b together gives a and b: no merge across their border is ever the next one. Of two
        merges with one rank the left one goes first."""
        x, y, rank = self.merges(a), self.merges(b), self.rank
        if not y.whole or not x.whole:
            return False
        i = j = 0
        right, left = x.last, y.first
        while True:
            p, q = x.ranks[i], y.ranks[j]
            across = rank.get(right + left, NEVER)
            if across < p and across <= q and across != NEVER:
                return False
            if p == q == NEVER:
                return True
            if p <= q:
                right, i = x.rights[i], i + 1
            else:
                left, j = y.lefts[j], j + 1

    def fill(self, text: str, last: list[int], shared: int) -> None:
        """Make last the table of text: the last piece of its prefix of each length. Its first shared entries are right already, as another
        text that begins so has left them; the automaton lists the pieces that end at each later place."""
        del last[shared + 1 :]
        last.extend([NONE] * (len(text) - shared))
        pairs, done = self.pairs, shared
        for at, (token, size) in self.automaton.iter(text, max(0, shared - self.longest)):
            if at < shared:
                continue
            end = at + 1
            if last[end] != NONE:
                continue
            while done < at:  # characters at which no piece ends stand alone
                done += 1
                if last[done] == NONE:
                    last[done] = NONE - 1 - ord(text[done - 1])
            start = end - size
            if start == 0:
                fits = self.merges(token).whole
            else:
                pair = last[start] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(last[start], token)
            if fits:
                last[end] = token
        while done < len(text):
            done += 1
            if last[done] == NONE:
                last[done] = NONE - 1 - ord(text[done - 1])

    def recovered(self, text: str, last: list[int]) -> bytes:
        """The ids that the table of a text says, found from its end backwards."""
        out, at, strings = [], len(text), self.strings
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= len(strings[token])
            else:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
                at -= 1
        out.reverse()
        return array("i", out).tobytes()

    def encode_stretch(self, text: str) -> bytes:
        last = [NONE]
        self.fill(text, last, 0)
        return self.recovered(text, last)

    def stretches(self, text: str) -> Iterator[list[str]]:
        """A text's stretches in order, those of about PART characters at once."""
        at, width = 0, PART
        while at < len(text):
            part = text[at : at + width]
            k = self.numbers[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
            cuts = (np.flatnonzero(~self.together[k[:-1], k[1:]]) + 1).tolist()
            if at + len(part) == len(text):
                cuts.append(len(part))
            if not cuts:  # one stretch that is longer
                width *= 2
                continue
            yield [part[i:j] for i, j in zip([0, *cuts], cuts)]
            at, width = at + cuts[-1], PART

    def learn(self, stretches: set[str]) -> None:
        """Encode those that aren't known. In their order each shares a prefix with the one before, and that part of its table."""
        known, ids = self.known, self.ids
        fresh = stretches.difference(known)
        if len(known) + len(fresh) > CACHE_STRETCHES:
            known.clear()
            fresh = stretches
        last, before = [NONE], ""
        for s in sorted(fresh):
            whole = ids.get(s)
            if whole is not None and self.merges(whole).whole:
                known[s] = array("i", [whole]).tobytes()
                continue
            shared = 0
            for x, y in zip(s, before):
                if x != y:
                    break
                shared += 1
            self.fill(s, last, shared)
            known[s] = self.recovered(s, last)
            before = s

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, the end id last, as 4-byte numbers."""
        out = []
        for stretches in self.stretches(marked(text)):
            distinct = set(stretches)
            self.learn(distinct)
            out.append(b"".join(map(self.known.__getitem__, stretches)))
            self.forget(distinct)
        out.append(self.end_bytes)
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The same of texts that fit into memory cut up: what is new in any is learned at once."""
        cut = [[s for part in self.stretches(marked(t)) for s in part] for t in texts]
        distinct = set().union(*cut)
        self.learn(distinct)
        out = [b"".join(map(self.known.__getitem__, stretches)) + self.end_bytes for stretches in cut]
        self.forget(distinct)
        return out

    def forget(self, stretches: set[str]) -> None:
        for s in stretches:
            if len(s) > CACHED_LENGTH:
                del self.known[s]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the blank put in front goes, controls are silent, bytes that form no character become U+FFFD each."""
        first, text, at = next((k for k in ids if k not in self.controls), None), [], 0
        for stop in [k for k, x in enumerate(ids) if x in self.controls] + [len(ids)]:  # bytes on either side of a control form no character together
            text.append(b"".join(map(self.surface.__getitem__, ids[at:stop])).decode("utf-8", "helixspark.bytewise"))
            at = stop + 1
        found = "".join(text)
        return found[1:] if first in self.fronted else found


    def decode_all(self, lists: pa.Array) -> pa.Array:
        """The texts of lists of ids. The bytes of all ids are gathered at once; lists that a control stands inside of, and those whose bytes
        don't form characters, are decoded by themselves."""
        ids, counts = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        alone = lambda rows: {k: self.decode(lists[k].as_py()) for k in rows}
        if lists.null_count or total > PART * 8:
            return pa.array([None if row is None else self.decode(row) for row in lists.to_pylist()], pa.string())
        last = np.cumsum(counts)
        first = last - counts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat[np.arange(total) + np.repeat(self.starts[ids] - ends[:-1], sizes)]
        odd = np.flatnonzero(self.silent[ids])
        of = np.searchsorted(last, odd, "right")
        slow = set(of[odd != last[of] - 1].tolist())
        begins = ends[first]
        inside = begins < total
        slow |= set(np.flatnonzero(inside)[data[begins[inside]] & 0xC0 == 0x80].tolist())  # a character may not begin in the list before
        slow |= {k - 1 for k in slow if k}
        try:
            data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            slow = set(range(len(lists)))
        found = alone(slow)
        held = np.flatnonzero(counts > 0)
        dropped = held[self.leads[ids[first[held]]]]
        keep = np.ones(total, bool)
        keep[begins[dropped]] = False
        offsets = np.concatenate([begins, [total]])
        offsets = (offsets - np.concatenate([[0], np.cumsum(~keep)])[offsets]).astype(np.int32)
        out = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(data[keep]))
        if not found:
            return out
        texts = out.to_pylist() if len(found) < len(lists) else [""] * len(lists)  # invalid bytes are not looked at
        return pa.array([found.get(k, t) for k, t in enumerate(texts)], pa.string())


def marked(text: str | None) -> str:
    """A text as the model reads it: blanks by their sign, and one in front."""
    return BLANK + text.replace(" ", BLANK) if text else ""


codecs.register_error("helixspark.bytewise", lambda e: ("�", e.start + 1))


def pieces(path: str) -> Pieces:
    """The process's model: a Python worker keeps it from one task to the next."""
    return remembered(f"pieces of {path}", lambda: Pieces(path))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the ids (array<int>) of each whole text, as the library encodes it with an end id."""
    bounded_batches(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for b in batches:
            for lo, hi in slices(b.column(1), SLICE):
                texts = b.column(1)[lo:hi].to_pylist()
                ids = known.encode_all(texts) if len(texts) > 1 else [known.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "i4")))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], lists], names=["doc_id", "ids"])

    text = docs.select("doc_id", "text")
    return text.mapInArrow(run, f"doc_id {text.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the library decodes the ids to; ids outside the vocabulary are an error."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], known.decode_all(b.column(1)[lo:hi])], names=["doc_id", "ids", "text"])

    ids = encoded.select("doc_id", "ids")
    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
