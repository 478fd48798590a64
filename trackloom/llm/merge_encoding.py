"""SentencePiece merge-type encoding by backtracking, and decoding.

A merge encoder joins, again and again, the adjacent pieces whose union has the best score, the leftmost of equal ones.
Here the result is found from the left instead. An Aho-Corasick automaton gives the longest piece at each position. A piece
may follow another if merging their joined text again yields just these two (such checks are remembered); if it may not,
the next shorter piece at the place is tried, and where none is left, the position is marked as failed in a bitfield and the
piece before it is taken back. A sequence whose neighbours all fit is the encoder's own, because no merge can then cross
an edge between them, so the first one found is the result, and a failed position need not be tried again.

Pieces that merging never yields are left out. Characters outside the vocabulary stand for themselves and become one id for
each UTF-8 byte. If no piece holds a blank behind another character, a text falls apart into words with their blanks in
front, and these into runs of characters that pieces link; the runs are encoded one by one, and short ones are remembered up
to a bound, so a text is read in parts of ``PART`` characters and nothing but its ids grows with it.

Defined results: a null text counts as empty and has no ids; rows are told apart by nothing, so repeated rows and ids come
out as often as they went in; other columns stay as they are, and a column with the name of a new one is replaced. Ids out of
range, null or of a control piece add nothing to a decoded text, the unknown id adds the library's sign for it; bytes that are
no valid UTF-8 become U+FFFD one by one.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

BLANK = "▁"  # stands for a space inside pieces
UNKNOWN_SIGN = " ⁇ "
PART = 1_000_000  # characters of a text that are looked at together
SHORT, KEPT_WORDS, KEPT_PAIRS = 48, 400_000, 1_000_000  # what a task remembers


@dataclass
class Pieces:
    """The tables of a model: what a task needs to encode and decode, without the model's file or library."""

    names: list[str]  # by id
    scores: list[float]
    byte_of: dict[int, int]  # ids that stand for a byte
    silent: frozenset[int]  # control ids
    unknown: int
    yielded: frozenset[int] | None = None  # ids that merging yields; None: not looked for yet
    _words: dict[str, bytes] = field(default_factory=dict, repr=False)  # ids as an array's bytes
    _fits: dict[tuple[int, int], bool] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        keep = ("names", "scores", "byte_of", "silent", "unknown", "yielded")
        return {k: self.__dict__[k] for k in keep} | {"_words": {}, "_fits": {}}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.names) if i not in self.byte_of and i not in self.silent and i != self.unknown}

    @cached_property
    def byte_ids(self) -> dict[int, int]:
        return {b: i for i, b in self.byte_of.items()}

    @cached_property
    def words_apart(self) -> bool:
        return not any(BLANK in name.lstrip(BLANK) for name in self.ids)

    @cached_property
    def _word(self) -> re.Pattern:
        """What is encoded by itself: a run of characters that are linked by standing side by side in pieces, with the blanks in
        front of it. No merge crosses its edges, and ``word`` and ``word,`` share what is remembered of the word."""
        if not self.words_apart:
            return re.compile("(?s).+")
        groups: dict[str, set[str]] = {}
        for name in self.ids:
            inner = set(name.lstrip(BLANK)) if len(name.lstrip(BLANK)) > 1 else set()
            if inner and not all(groups.get(c) is groups.get(min(inner), inner) for c in inner):
                inner = inner.union(*(groups[c] for c in inner if c in groups))
                groups |= dict.fromkeys(inner, inner)
        linked = sorted({id(g): g for g in groups.values()}.values(), key=len, reverse=True)
        runs = [f"{BLANK}*[{''.join(map(re.escape, sorted(g)))}]+" for g in linked]
        return re.compile("|".join([*runs, f"{BLANK}*[^{BLANK}]", f"{BLANK}+"]))

    @cached_property
    def _known(self) -> re.Pattern:
        """A run of characters that occur in pieces, or one that does not."""
        return re.compile("[" + "".join(map(re.escape, sorted({c for name in self.ids for c in name}))) + "]+|(?s:.)")

    @cached_property
    def _automaton(self):
        """Over reversed pieces: run over a reversed text, it reports at each place the pieces that start there."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if self.yielded is None or i in self.yielded:
                found.add_word(name[::-1], i)
        found.make_automaton()
        return found

    @cached_property
    def _sizes(self) -> list[int]:
        return [len(name) for name in self.names]

    @cached_property
    def _shorter(self) -> list[int]:
        """For each piece the longest other one that it starts with, or -1."""
        out = [-1] * len(self.names)
        for name, i in self.ids.items():
            for end in range(len(name) - 1, 0, -1):
                other = self.ids.get(name[:end])
                if other is not None and (self.yielded is None or other in self.yielded):
                    out[i] = other
                    break
        return out

    def merge(self, text: str, until: int = 1) -> list[str]:
        """Best pair first, the leftmost of equal ones, until no pair or ``until`` parts are left. For single pieces and pairs."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @cached_property
    def _last_merge(self) -> dict[int, tuple[int, int]]:
        """The two pieces that each piece of several characters is merged from at last."""
        out = {}
        for name, i in self.ids.items():
            if len(name) > 1 and (self.yielded is None or i in self.yielded):
                parts = self.merge(name, until=2)
                if len(parts) == 2:
                    out[i] = (self.ids[parts[0]], self.ids[parts[1]])
        return out

    @cached_property
    def _in_order(self) -> frozenset[int]:
        """Pieces whose merges come in the order of their scores: each scores less than those that it is merged from."""
        out = set()
        for name, i in sorted(self.ids.items(), key=lambda named: len(named[0])):
            parts = self._last_merge.get(i)
            if len(name) == 1 or parts and all(p in out and (len(self.names[p]) == 1 or self.scores[i] < self.scores[p]) for p in parts):
                out.add(i)
        return frozenset(out)

    def _merges_back(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces yields these two again.

        Their merges are taken back, the latest first. A pair across the edge that stands before a merge and scores better
        would have been joined instead of it.
        """
        names, scores, ids = self.names, self.scores, self.ids
        if left not in self._in_order or right not in self._in_order:
            return self.merge(names[left] + names[right]) == [names[left], names[right]]
        bound, of_right = None, False
        while True:
            across = ids.get(names[left] + names[right])
            if across is not None and (bound is None or scores[across] > bound or scores[across] == bound and of_right):
                return False
            of_left, below = self._last_merge.get(left), self._last_merge.get(right)
            if of_left and (not below or scores[left] < scores[right]):
                bound, of_right, left = scores[left], False, of_left[1]
            elif below:
                bound, of_right, right = scores[right], True, below[0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._merges_back(left, right)
        return known

    def _backtrack(self, text: str) -> list[int]:
        """text: characters that occur in pieces."""
        size, sizes, shorter, known = len(text), self._sizes, self._shorter, self._fits.get
        # The automaton reports the longest piece of a place first; put in the other way round, that one stays.
        longest = dict(list(self._automaton.iter(text[::-1]))[::-1]).get
        failed = bytearray((size >> 3) + 1)
        found, at, before, piece = [], 0, -1, longest(size - 1, -1)
        while at < size:
            if piece < 0:  # nothing fits here: take back the piece before, and try a shorter one in its place
                if not found:
                    raise ValueError(f"no sequence of pieces for {text[:80]!r}")
                failed[at >> 3] |= 1 << (at & 7)
                at -= sizes[before]
                piece = shorter[found.pop()]
                before = found[-1] if found else -1
                continue
            end = at + sizes[piece]
            fits = False
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = before < 0 or known((before, piece))
                if fits is None:
                    fits = self.fits(before, piece)
            if fits:
                found.append(piece)
                at, before, piece = end, piece, longest(size - 1 - end, -1)
            else:
                piece = shorter[piece]
        return found

    def _encode_word(self, word: str) -> array:
        found = array("i")
        for run in self._known.findall(word):
            if len(run) == 1:
                one = self.ids.get(run)
                if one is not None:
                    found.append(one)
                elif self.byte_ids:
                    found.extend(map(self.byte_ids.__getitem__, run.encode()))
                else:
                    found.append(self.unknown)
            else:
                found.extend(self._backtrack(run))
        return found

    def _ids_of(self, word: str) -> bytes:
        """The ids of a word as bytes, remembered if it is short."""
        words = self._words
        ids = words.get(word)
        if ids is None:
            ids = self._encode_word(word).tobytes()
            if len(word) <= SHORT:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                words[word] = ids
        return ids

    def encode_parts(self, text: str | None) -> Iterator[array]:
        """The ids of a text, part by part."""
        first = True
        for part in text_parts(text or "", PART if self.words_apart else None):
            part = part.replace(" ", BLANK)
            words = self._word.findall(BLANK + part if first else part)
            found = list(map(self._words.get, words))
            if None in found:
                found = [self._ids_of(word) if ids is None else ids for word, ids in zip(words, found)]
            out = array("i")
            out.frombytes(b"".join(found))
            first = False
            yield out

    def encode(self, text: str | None) -> array:
        out = array("i")
        for part in self.encode_parts(text):
            out.extend(part)
        return out

    @cached_property
    def _surfaces(self) -> list[bytes]:
        """What an id adds to a text: its piece with spaces for blanks, or its byte."""
        out = [n.replace(BLANK, " ").encode() for n in self.names]
        for i, b in self.byte_of.items():
            out[i] = bytes([b])
        out[self.unknown] = UNKNOWN_SIGN.encode()
        return out

    def decode(self, ids: Iterable[int], start: bool = True) -> str:
        """The text of ids; ``start`` tells that they begin a text, whose first blank is the encoder's."""
        size, silent = len(self.names), self.silent
        runs: list[list[int]] = [[]]  # control ids part runs of bytes
        if isinstance(ids, array) and not silent.intersection(ids):
            runs = [ids]
        else:
            for i in ids:
                if i is not None and 0 <= i < size:
                    runs.append([]) if i in silent else runs[-1].append(i)
        out = [b"".join(map(self._surfaces.__getitem__, run)) for run in runs]
        # An incomplete run of bytes cannot be completed by a piece, so bytes and pieces can be read together.
        text = "".join(part.decode(errors="byte_by_byte") for part in out)
        first = next((run[0] for run in runs if len(run)), self.unknown) if start else self.unknown
        return text[1:] if first != self.unknown and self.names[first].startswith(BLANK) else text


# Each byte that starts no valid character becomes U+FFFD.
codecs.register_error("byte_by_byte", lambda wrong: ("\ufffd", wrong.start + 1))

_WORD_EDGE = re.compile(f"[^ {BLANK}](?=[ {BLANK}])")


def text_parts(text: str, size: int | None) -> Iterator[str]:
    """Parts of about ``size`` characters; each but the first begins with a blank that follows another character."""
    at = 0
    while at < len(text):
        edge = _WORD_EDGE.search(text, at + size) if size and len(text) - at > size else None
        end = edge.end() if edge else len(text)
        yield text[at:end]
        at = end


def load(path: str) -> Pieces:
    """The pieces of a sentencepiece model file of the merge type, with a space put before the text and no other change to it.

    Raises if the model does something else: the result would not be the library's.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = Pieces(
        [model.id_to_piece(i) for i in every], [model.get_score(i) for i in every],
        {i: int(model.id_to_piece(i)[1:-1], 16) for i in every if model.is_byte(i)},
        frozenset(i for i in every if model.is_control(i)), model.unk_id())
    probe = " A  ﬁ é ① Å\t\n "
    if model.normalize(probe) != (BLANK + probe).replace(" ", BLANK):
        raise ValueError(f"{path} changes texts in a way that is not built here")
    if any(model.is_unused(i) for i in every) or any(c not in pieces.ids for name in pieces.ids for c in name):
        raise ValueError(f"{path} has unused pieces, or characters in pieces that are no piece")
    pieces.yielded = frozenset(i for name, i in pieces.ids.items() if len(name) == 1 or pieces.merge(name) == [name])
    listed = list(pieces.ids)
    for at in range(0, len(listed), 500):
        text = " ".join(listed[at : at + 500])
        if model.encode(text) != list(pieces.encode(text)):
            raise ValueError(f"{path} is not of the merge type, or has rules that are not built here")
    return pieces


def _with(docs: DataFrame, source: str, new: list[StructField], compute: Callable[[object], tuple]) -> DataFrame:
    """``docs`` with columns that ``compute`` makes of the value of ``source``, row by row."""
    names = {f.name.lower() for f in new}
    kept = [f for f in docs.schema if f.name.lower() not in names]
    kinds = [to_arrow_type(f.dataType) for f in new]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(source)
            found = list(zip(*(compute(values[i].as_py()) for i in range(batch.num_rows)))) or [()] * len(new)
            arrays = [batch.column(f.name) for f in kept] + [pa.array(v, kind) for v, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept + new])

    return docs.mapInArrow(each, StructType(kept + new))


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` with ``ids``, the encoding of ``text``."""
    return _with(docs, "text", [StructField("ids", ArrayType(IntegerType()))], lambda text: (pieces.encode(text),))


def decode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` with ``decoded``, the text of ``ids`` (null: no ids)."""
    return _with(docs, "ids", [StructField("decoded", StringType())], lambda ids: (pieces.decode(ids or ()),))


def digests(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of every row.

    Each text is encoded and its ids decoded part by part, so neither its ids nor its decoded text stand in memory whole.
    """
    numbers = [str(i) for i in range(len(pieces.names))]

    def of_text(text: str | None) -> tuple[int, str, str]:
        count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for part in pieces.encode_parts(text):
            if count and part:
                of_ids.update(b",")
            of_ids.update(",".join(map(numbers.__getitem__, part)).encode())
            of_text.update(pieces.decode(part, start=not count).encode())
            count += len(part)
        return count, of_ids.hexdigest(), of_text.hexdigest()

    new = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _with(docs.select("doc_id", "text"), "text", new, of_text).drop("text")
