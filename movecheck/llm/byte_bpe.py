"""Byte-level BPE: Aho-Corasick matches, backtracking, exact merges."""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from movecheck.llm.common import resident

#: Entries of each generation of a worker's memo; two generations are kept.
MEMO = 250_000
#: Fixed value: Unicode white space, as the pattern's \s means it.
WHITE = "\t-\r " + "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
#: Fixed value: letters and digits of Latin and Cyrillic, by any version of Unicode.
WORD = "0-9A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
#: Fixed value: ASCII signs that are no letters or digits, but for the apostrophe.
SIGNS = r"!-&(-/:-@\[-`{-~"
#: An optional space with a word before a sign, or with what stands up to the next white space,
#: or a stretch of white space. The pattern's matches never reach over the ends of such chunks:
#: none holds a letter or digit and a sign after it.
_CHUNK = re.compile(f" ?[{WORD}]++(?=[{SIGNS}])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


def _explicit(pattern: str) -> str:
    """The pattern with white space spelled out, the same for every regex library."""
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern, re.S):
        if part == "\\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif part == "\\S":
            out.append(f"[^{WHITE}]")
        else:
            inside = (inside or part == "[") and part != "]"
            out.append(part)
    return "".join(out)


class Memo(dict):
    """A bounded memo: when the young generation is full it becomes the old one.

    What is asked for by ``memo[key]`` and in neither is made by ``build`` and kept.
    """

    def __init__(self, limit: int = MEMO, build: Callable | None = None) -> None:
        super().__init__()
        self.limit, self.build, self.old = limit, build, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.build(key)
        self.keep(key, value)
        return value

    def recall(self, key):
        value = self.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes as merging by lowest rank would, without merging.

    A sequence of tokens is what the merges give exactly if every two neighbours are
    compatible: merging the bytes of both leaves the boundary between them. So the text is
    covered from the left with the longest tokens that the automaton finds; a token that its
    neighbour rejects gives way to the next shorter one, and where none fits the last token
    is taken back. A position that failed once is never tried again, which keeps the work
    linear in the text. Compatibility is decided from the tokens' last merges, and memoised.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(_explicit(pattern))
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.shorter = {rank: self._prefix(token) for token, rank in ranks.items()}
        self.single = {token.decode("latin-1"): rank for token, rank in ranks.items() if len(token) == 1}
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        automaton.make_automaton()
        # Without a token to find there is no automaton.
        self.matches = automaton.iter if len(automaton) else lambda piece: ()
        self.fits: Memo = Memo(memo, self._compatible)
        self.pieces: Memo = Memo(memo, self._piece)
        self.chunks: Memo = Memo(memo, self._chunk)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            self._learn(token, rank)

    def _prefix(self, token: bytes) -> int | None:
        """The longest other token that ``token`` begins with."""
        for size in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:size])
            if rank is not None:
                return rank
        return None

    def _learn(self, token: bytes, rank: int) -> None:
        """The last merge that makes ``token``: the tokens its bytes give when it isn't there yet."""
        self.parts[rank] = None
        if len(token) < 2:
            return
        halves = self._cover(token.decode("latin-1"), below=rank)
        if halves is not None and len(halves) == 2:
            self.parts[rank] = (halves[0], halves[1])
            self.joined[halves[0], halves[1]] = rank
            self.fits.keep((halves[0], halves[1]), False)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the bytes of both tokens, merged by rank, are these two tokens again.

        The later of the two tokens is undone step by step. A merge of the tokens facing each
        other at the boundary that comes before the step that made either of them would have
        taken place, and the boundary would be gone.
        """
        bound, (a, b), good = len(self.ranks) + 1, pair, None
        while good is None:
            across = self.joined.get((a, b))
            if across is not None and across < bound:
                good = False
            elif self.parts[a] is None and self.parts[b] is None:
                good = True
            elif self.parts[b] is None or (self.parts[a] is not None and a > b):
                bound, a = a, self.parts[a][1]
            else:
                bound, b = b + 1, self.parts[b][0]
        return good

    def _cover(self, piece: str, below: int = sys.maxsize) -> list[int] | None:
        size, lengths, shorter, fits = len(piece), self.lengths, self.shorter, self.fits
        # The longest token from each position: of matches with one start, the last to end.
        longest = list(map(self.single.get, piece))
        for end, (rank, before) in self.matches(piece):
            longest[end - before] = rank
        dead = bytearray(size + 1)
        tokens: list[int] = []
        at, last, rank = 0, None, longest[0] if size else None
        while at < size:
            while rank is not None:
                end = at + lengths[rank]
                if rank < below and not dead[end] and (last is None or fits[last, rank]):
                    break
                rank = shorter[rank]
            if rank is not None:
                tokens.append(rank)
                at, last = end, rank
                rank = longest[at] if at < size else None
            elif tokens:
                dead[at] = 1
                rank = tokens.pop()
                at -= lengths[rank]
                last = tokens[-1] if tokens else None
                rank = shorter[rank]
            else:
                return None
        return tokens

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        found = self._cover(raw.decode("latin-1"))
        if found is None:
            raise ValueError(f"no tokens cover {piece!r}: the ranks lack a byte")
        return tuple(found)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pattern.findall(chunk)
        if len(pieces) == 1:  # the memo of chunks will know it
            return self._piece(pieces[0])
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, _CHUNK.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encoder(path: str, pattern: str, memo: int = MEMO) -> Encoder:
    """This process's encoder for a rank file; built once, kept until another operator's tasks come."""
    return resident(("byte_bpe", path, pattern, memo), lambda: Encoder(load_ranks(path), pattern, memo))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", memo: int = MEMO) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the whole text encoded without special tokens.

    ``memo`` bounds what a worker remembers, about 1 kB an entry.

    A null text is encoded as the empty one; other columns pass through, but for one called like
    a result column, which is replaced. An empty table gives an empty one. A very long text is
    encoded whole in its task. Rows may repeat: a text equal to the one before it is not encoded
    again, so copies that lie together cost one. No row moves, so a hot key doesn't matter.
    """
    return _mapped(docs, path, pattern, text, keep_ids=True, memo=memo)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead of the ids.

    Nulls, empty tables, repeated rows and clashing names as for ``encoded``.
    """
    return _mapped(docs, path, pattern, text, keep_ids=False)


def _mapped(docs: DataFrame, path: str, pattern: str, text: str, keep_ids: bool, memo: int = MEMO) -> DataFrame:
    added = (["ids"] if keep_ids else []) + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    types = {"ids": ArrayType(IntegerType()), "n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    for name in added:
        schema = schema.add(name, types[name])

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern, memo)
        decimal = {rank: str(rank) for rank in bpe.bytes}
        last, ids, ids_digest, decoded_digest = None, [], "", ""
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found: dict[str, list] = {name: [] for name in types}
                for value in batch.column(batch.schema.get_field_index(text)):
                    now = value.as_py() or ""
                    if now != last:
                        last, ids = now, bpe.encode(now)
                        listed = " ".join(map(decimal.__getitem__, ids))
                        ids_digest = hashlib.sha256(listed.encode()).hexdigest()
                        decoded_digest = hashlib.sha256(bpe.decode(ids)).hexdigest()
                    if keep_ids:
                        found["ids"].append(ids)
                    found["n_tokens"].append(len(ids))
                    found["ids_sha256"].append(ids_digest)
                    found["decoded_sha256"].append(decoded_digest)
                arrow = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                columns += [pa.array(found[name], arrow.get(name, pa.string())) for name in added]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(encode_batches, schema)
