"""Byte-level BPE as a lazily determinised finite-state transducer.

Merges by rank are compiled, as text needs them, into a transducer that reads a
word's bytes left to right. Two facts make that possible. Of a merged sequence,
every adjacent pair of tokens merges to itself; and each prefix of a word has
exactly one last token that fits so. Hence what has been read is described by
the last token of each prefix, of which only *open* ones matter: those after
which the bytes read since may still grow into one vocabulary token. Tokens
that the merges of all open prefixes share can no longer change and are
emitted at once, so lookahead is bounded by token length, not word length.

A state is the last emitted token with the bytes read since. States and
transitions are made on first use and kept in a bounded table that is emptied
when full, as is the memory of whole words; neither affects results.

Decoding is a stream too: :class:`Utf8Stream` holds the bytes of an unfinished
character between calls, tracked by a state machine.

Defined cases: a null text counts as empty and gives no ids; repeated rows get
equal rows; an empty table gives an empty table; other columns are not read.
A word that is itself a token is that token, as in the public library.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern for which parts between blanks stand alone.
BLANK_JOINING = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TABLE_LIMIT = 300_000
_WORD_LIMIT = 120_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(x): int(rank) for x, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Feeds bytes, yields ranks. One instance serves many words."""

    def __init__(self, ranks: dict[bytes, int], table_limit: int = _TABLE_LIMIT):
        self.ranks = ranks
        self.token_of = {rank: token for token, rank in ranks.items()}
        self.limit = table_limit
        #: Proper prefixes of tokens: what may still grow.
        self.growing = {t[:k] for t in ranks for k in range(1, len(t))}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._split: dict[bytes, tuple[bytes, bytes]] = {}
        self._whole: dict[bytes, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: The bytes since the last emitted token, the last token of each prefix
        #: of those (first that emitted token), and the open prefixes.
        self.states: list[tuple[bytes, list[bytes], list[int]]] = [(b"", [b""], [0])]
        self.numbers: dict[tuple[bytes | None, bytes], int] = {(b"", b""): 0}
        #: By 256 times the state plus the byte: 256 times the next state, and the ids emitted.
        self.moves: dict[int, tuple[int, bytes]] = {}
        #: By 256 times the state: the ids of what is pending when the word ends.
        self.ends: dict[int, bytes] = {}

    def _renewed(self, state: int) -> int:
        """Empties the table and gives the state at hand its new number, so a word of any length keeps the limit."""
        pending, lasts, opened = held = self.states[state >> 8]
        self._reset()
        name = (lasts[0] if opened[0] == 0 else None, pending)
        if name not in self.numbers:
            self.numbers[name] = len(self.states)
            self.states.append(held)
        return self.numbers[name] << 8

    def _pack(self, pending: bytes, cuts: list[int]) -> bytes:
        ranks = self.ranks
        return b"".join([ranks[pending[a:b]].to_bytes(4, "little") for a, b in zip(cuts, cuts[1:])])

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Merge by rank, lowest first and leftmost of equals, down to ``until`` parts: the definition."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """What the last merge into ``token``, of two bytes or more, joined."""
        got = self._split.get(token)
        if got is None:
            parts = self.merge(token, 2)
            got = self._split[token] = (parts[0], parts[1])
        return got

    def _sound(self, token: bytes) -> bool:
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = self.merge(token) == [token]
        return got

    def _fit(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) >= self.limit:
                self._fits.clear()
            got = self._fits[key] = self._meet(left, right)
        return got

    def _meet(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens, side by side, merge to themselves.

        Undoes merges beside the seam, latest first. At each step the two parts
        that met there at that time must not have had a merge of their own that
        came earlier. Of equal ranks the left merge came first.
        """
        ranks, bound = self.ranks, 1 << 60  # twice the rank, one more for a merge on the right
        while True:
            joint = ranks.get(left + right)
            if joint is not None and 2 * joint < bound:
                return False
            one, two = len(left) > 1, len(right) > 1
            if not (one or two):
                return True
            if one and not (two and ranks[left] <= ranks[right]):
                bound, left = 2 * ranks[left], self._halves(left)[1]
            else:
                bound, right = 2 * ranks[right] + 1, self._halves(right)[0]

    def _compile(self, key: int) -> tuple[int, bytes]:
        pending, lasts, opened = self.states[key >> 8]
        pending += bytes((key & 255,))
        for i in opened:  # only what could grow can have become a token
            token = pending[i:]
            if token in self.ranks and self._sound(token) and (not lasts[i] or self._fit(lasts[i], token)):
                break
        else:
            raise ValueError(f"no token for {pending!r}")
        lasts = [*lasts, token]
        growing = self.growing
        opened = [i for i in opened if pending[i:] in growing]
        opened.append(len(pending))
        live = opened[:]
        while len(live) > 1:  # up to where all open prefixes' tokens agree
            top = live.pop()
            up = top - len(lasts[top])
            if up > live[-1]:
                live.append(up)
            elif up not in live:
                insort(live, up)
        at = live[0]
        emitted = self._pack(pending, self._chain(lasts, at)) if at else b""
        # The token ahead matters only while a token may still start right after it.
        name = (lasts[at] if opened[0] == at else None, pending[at:])
        number = self.numbers.get(name)
        if number is None:
            number = self.numbers[name] = len(self.states)
            self.states.append((name[1], lasts[at:], [i - at for i in opened]))
        move = self.moves[key] = number << 8, emitted
        return move

    @staticmethod
    def _chain(lasts: list[bytes], end: int) -> list[int]:
        """Boundaries from the start of the pending bytes to ``end``."""
        out = [end]
        while end > 0:
            end -= len(lasts[end])
            out.append(end)
        return out[::-1]

    def _finish(self, state: int) -> bytes:
        pending, lasts, _ = self.states[state >> 8]
        packed = self.ends[state] = self._pack(pending, self._chain(lasts, len(pending)))
        return packed

    def tokens(self, data: Iterable[int]) -> Iterator[bytes]:
        """Tokens of one word, each as soon as no continuation can change it."""
        state = 0
        for byte in data:
            if len(self.states) > self.limit:
                state = self._renewed(state)
            key = state + byte
            state, emitted = self.moves.get(key) or self._compile(key)
            yield from self._named(emitted)
        yield from self._named(self.ends.get(state) or self._finish(state))

    def _named(self, packed: bytes) -> list[bytes]:
        return [self.token_of[rank] for rank in np.frombuffer(packed, "<u4").tolist()]

    def ids(self, data: bytes) -> bytes:
        """Packed ids of one word: those of ``tokens``, in one loop."""
        state, out, known = 0, [], self.moves.get
        add = out.append
        for byte in data:
            move = known(state + byte)
            if move is None:
                if len(self.states) > self.limit:
                    state = self._renewed(state)
                    known = self.moves.get
                move = self._compile(state + byte)
            state, emitted = move
            if emitted:
                add(emitted)
        add(self.ends.get(state) or self._finish(state))
        return b"".join(out)


#: Marks that the public pattern matches apart from the letters before them.
_MARKS = ".,;:!?"


class _NotApart(Exception):
    """A part begins or ends in white space, which may belong to a longer match."""


class _Memory(dict):
    """Remembers at most twice ``limit`` entries; what was not used of late goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        packed = self.older.get(key)
        if packed is None:
            packed = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = packed
        return packed


class _Parts(_Memory):
    """Ids of parts of a text: a word, with the blank or line break before it."""

    def __init__(self, codec: Codec, limit: int):
        super().__init__(limit)
        self.codec = codec

    def make(self, part: str) -> bytes:
        blank = part[:1] if part[:1] in (" ", "\n") else ""
        word = part[len(blank) :]
        core = word.rstrip(_MARKS)
        if core.isalpha():  # letters, then marks: matched as one and one
            if blank == "\n":
                return self.codec["\n"] + self[word]
            if core is not word and core != word:
                return self[blank + core] + self.codec[word[len(core) :]]
            return self.codec.make(part)
        if word != word.strip() or (not word and part):
            raise _NotApart
        return self.codec.encode_whole(part)


class Codec(_Memory):
    """Encodes and decodes whole texts; as a mapping, remembers words' ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, word_limit: int = _WORD_LIMIT):
        super().__init__(word_limit)
        self.machine = Transducer(ranks)
        self.ranks = ranks
        self.bytes_of = self.machine.token_of
        self.split = regex.compile(pattern)
        self.parts = _Parts(self, 2 * word_limit)
        #: The public pattern lets one blank join the word after it and nothing else.
        self.blank_joins = pattern == BLANK_JOINING

    def make(self, word: str) -> bytes:
        data = word.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return self.machine.ids(data) if whole is None else whole.to_bytes(4, "little")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A text with single blanks or line breaks between words is cut before
        each of them; no match of the pattern crosses such a place, so each
        part is matched by itself and can be remembered. Other texts are
        matched whole.
        """
        if not self.blank_joins or "\0" in text:
            return self.encode_whole(text)
        try:
            return b"".join(map(self.parts.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")))
        except _NotApart:
            return self.encode_whole(text)

    def encode_whole(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes, block: int = 1 << 16) -> Iterator[str]:
        """The text of packed ids, a block at a time."""
        stream = Utf8Stream()
        numbers = np.frombuffer(ids, "<u4")
        for k in range(0, len(numbers), block):
            yield stream.feed(b"".join(map(self.bytes_of.__getitem__, numbers[k : k + block].tolist())))
        yield stream.close()


def _utf8_states() -> list[list[int]]:
    """Next state by state and byte; -1 where the byte can't follow.

    State 0 is between characters, 1 to 3 lack so many bytes of any kind, 4 to 7
    are after a first byte that narrows the second (E0, ED, F0, F4).
    """
    #: Of each state after 0, the bytes that may follow and the state then.
    follow = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    first = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
    table = [[-1] * 256 for _ in range(8)]
    for state, ranges in [(0, first), *((k, [v]) for k, v in follow.items())]:
        for low, high, then in ranges:
            table[state][low : high + 1] = [then] * (high - low + 1)
    return table


_UTF8 = _utf8_states()


class Utf8Stream:
    """Incremental UTF-8 as a state machine of eight states.

    Between calls it holds a state and the bytes of the open character, three at
    most. Whole characters inside a part are decoded at once; the machine runs
    over an open character's bytes only, at either end of a part. Bytes that
    can't be UTF-8 become U+FFFD, as for one whole decode.
    """

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        out, at = "", 0
        while self.state and at < len(data):
            then = _UTF8[self.state][data[at]]
            if then < 0:  # the open character ends here; this byte starts anew
                out, self.held, self.state = out + "\ufffd", b"", 0
                break
            self.held, self.state, at = self.held + data[at : at + 1], then, at + 1
            if not then:
                out, self.held = out + self.held.decode(), b""
        if self.state:
            return out
        cut = len(data)
        for k in range(len(data) - 1, max(at, len(data) - 3) - 1, -1):
            if data[k] >= 0xC0:  # the last first byte near the end
                state = 0
                for byte in data[k:]:
                    state = _UTF8[state][byte]
                    if state <= 0:
                        break
                if state > 0:
                    cut, self.state, self.held = k, state, data[k:]
                break
        return out + data[at:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out = "\ufffd" if self.state else ""
        self.state, self.held = 0, b""
        return out


def codec(path: str, pattern: str) -> Codec:
    """This process's codec of a vocabulary file; built once."""
    key = (path, pattern)
    if key not in _CODECS:
        gc.set_threshold(200_000, 50, 1000)  # the tables hold no cycles
        _CODECS[key] = Codec(load_ranks(path), pattern)
    return _CODECS[key]


_CODECS: dict[tuple[str, str], Codec] = {}


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, the array of token ids."""
    return _mapped(docs, path, pattern, id_col, text_col, "ids array<long>", lambda held, text: (np.frombuffer(held.encode(text), "<u4").tolist(),))


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and return counts and digests of both."""
    return _mapped(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _digest(held: Codec, text: str) -> tuple[int, str, str]:
    ids = held.encode(text)
    back = hashlib.sha256()
    for part in held.decode(ids):
        back.update(part.encode())
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, made: str, per_text) -> DataFrame:
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    spec = docs.sparkSession.createDataFrame([], made).schema
    schema = rows.select(id_col).schema
    for x in spec:
        schema = schema.add(x)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        held, arrow = codec(path, pattern), to_arrow_schema(schema)
        for batch in batches:
            got = [per_text(held, text.as_py()) for text in batch.column(1)]
            columns = list(zip(*got)) if got else [()] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), *(pa.array(list(c), f.type) for c, f in zip(columns, list(arrow)[1:]))], names=arrow.names)

    return rows.mapInArrow(run, schema)
