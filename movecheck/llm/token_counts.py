"""Token counts: pieces counted once per distinct pre-token and joined to the texts' frequencies."""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from movecheck.llm.byte_bpe import WHITE, Memo
from movecheck.llm.common import runs

#: A block of documents whose pre-tokens share one posting list ends at either of these.
BLOCK_CHARS = 32_000_000
BLOCK_ROWS = 60_000
#: A pre-token in more than this share of a block's texts meets its lists of other blocks in many
#: tasks instead of one.
HOT_SHARE = 0.05
#: Row within its block, and how often the pre-token stands there.
_POSTING = np.dtype([("row", "<u2"), ("n", "u1")])
#: A row of a block and its partial sum.
_SUM = np.dtype([("row", "<u2"), ("n", "<i8")])
_CONTROL = re.compile("[\x1c-\x1f]")
_STRETCH = re.compile(f"[^{WHITE}]+")


class Splitter:
    """Pre-tokens of a text, as the tokenizer file has them, and what needs no lookup.

    ``whole`` holds the vocabulary's entries that are one piece as a pre-token: the file
    bounds them, and they are counted where they stand. Added tokens found in a text count
    one each, as the library does by default.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        suffix = stored["model"].get("end_of_word_suffix") or ""
        words = {t[: len(t) - len(suffix)] for t in stored["model"]["vocab"] if t.endswith(suffix) and t != suffix}
        added = sorted((t["content"] for t in stored["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.whole = {w for w in words if self.pieces(w) == 1}
        self.memo = Memo()

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))

    def _of_stretch(self, stretch: str) -> tuple[int, tuple[str, ...]]:
        known = self.memo.recall(stretch)
        if known is None:
            normal = self.tokenizer.normalizer.normalize_str(stretch)
            found = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            rest = tuple(p for p in found if p not in self.whole)
            known = (len(found) - len(rest), rest)
            self.memo.keep(stretch, known)
        return known

    def post(self, text: str, row: int, block: Block) -> int:
        """Pieces counted already; each remaining pre-token's frequency goes to the block's postings."""
        direct, parts = 0, [text]
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            direct = len(parts) - 1
        recall, code_of = self.memo.get, block.codes.__getitem__
        codes, counts = [], []
        for part in parts:
            # str.split takes four control characters for white space that aren't.
            stretches = _STRETCH.findall(part) if _CONTROL.search(part) else part.split()
            for stretch, n in Counter(stretches).items():
                known = recall(stretch)
                if known is None:
                    known = self._of_stretch(stretch)
                direct += known[0] * n
                for pre_token in known[1]:
                    codes.append(code_of(pre_token))
                    counts.append(n)
        if codes:
            block.add(row, codes, counts)
        return direct


class _Codes(dict):
    """Numbers of pre-tokens, from 0 as they come."""

    def __missing__(self, pre_token: str) -> int:
        code = self[pre_token] = len(self)
        return code


class Block:
    """Postings of a block of documents: pre-token, row, frequency."""

    def __init__(self) -> None:
        self.codes = _Codes()
        self._codes, self._rows, self._counts = array("I"), array("H"), array("Q")

    def add(self, row: int, codes: list[int], counts: list[int]) -> None:
        self._codes.extend(codes)
        self._counts.extend(counts)
        self._rows.extend([row] * len(codes))

    def dealt(self, name: int, rows: int, buckets: int) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """For each bucket: its pre-tokens, the lengths of their lists, and the lists end to end.

        A pre-token's hash names its bucket; that of one in many of the block's ``rows`` is moved
        on by the block's name, so that its lists are spread over all buckets.
        """
        keys = list(self.codes)
        codes, n = np.frombuffer(self._codes, np.uint32), np.frombuffer(self._counts, np.uint64).astype(np.int64)
        at = np.frombuffer(self._rows, np.uint16)
        if len(n) and n.max() > 255:  # a posting holds up to 255; more are spread over several
            times = (n + 254) // 255
            codes, at = np.repeat(codes, times), np.repeat(at, times)
            spread = np.full(int(times.sum()), 255, dtype=np.int64)
            spread[np.cumsum(times) - 1] = n - 255 * (times - 1)
            n = spread
        lengths = np.bincount(codes, minlength=len(keys))
        bucket = np.fromiter((xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys), np.int64, len(keys))
        bucket = (bucket + np.where(lengths > HOT_SHARE * rows, name, 0)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        by_key = np.argsort(place[codes], kind="stable")
        packed = np.empty(len(by_key), dtype=_POSTING)
        packed["row"], packed["n"] = at[by_key], n[by_key]
        sorted_lengths = lengths[order]
        ends = np.cumsum(sorted_lengths)
        sorted_bucket = bucket[order]
        starts = np.flatnonzero(np.append(True, sorted_bucket[1:] != sorted_bucket[:-1])) if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            first = ends[start] - sorted_lengths[start]
            some = [keys[i] for i in order[start:end]]
            yield int(sorted_bucket[start]), some, sorted_lengths[start:end].astype("<u4"), packed[first : ends[end - 1]]


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """This process's splitter for a tokenizer file; built once."""
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


class _Pieces(dict):
    """Pieces of a pre-token, counted when it is first asked for."""

    def __init__(self, split: Splitter) -> None:
        super().__init__()
        self.split = split

    def __missing__(self, pre_token: str) -> int:
        n = self[pre_token] = self.split.pieces(pre_token)
        return n


def token_counts(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one per row of ``docs``; ``path`` is a tokenizer file.

    1. Each task folds a block of documents to posting lists, one for each distinct pre-token
       that isn't a whole vocabulary entry: in which rows of the block it stands, how often.
    2. One shuffle deals the lists by a hash of the pre-token; what a block has for a bucket is
       one row. Each task counts the pieces of a pre-token once and meets them with the lists of all
       blocks. A pre-token in many of a block's texts is dealt by its block as well: its lists fill
       no task, and its pieces are counted once per task.
    3. Count times frequency is added up per row of the block, and the sums per row are added.

    Token ids are never made. Null and empty texts have no tokens; repeated rows and repeated
    or null ids are counted row by row; other columns are ignored; an empty table gives no rows.
    ``docs`` must be read again in the same order if a task is repeated, as files are.
    """
    kind = docs.schema[id].dataType
    id_arrow = to_arrow_type(kind)
    base_arrow = pa.list_(pa.struct([("id", id_arrow), ("n_bytes", pa.int64()), ("n", pa.int64())]))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        task, number = TaskContext.get().partitionId(), 0
        block = Block()
        ids, sizes, direct, chars = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, sizes, direct, chars, number
            name = (task << 20) + number
            for bucket, keys, lengths, packed in block.dealt(name, len(ids), buckets):
                values = [[bucket], [name], [keys], [lengths.tobytes()], [packed.tobytes()], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, dealt)], schema=dealt)
            base = [{"id": i, "n_bytes": b, "n": n} for i, b, n in zip(ids, sizes, direct)]
            values = [[name % buckets], [name], [None], [None], [None], [base]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, dealt)], schema=dealt)
            block, ids, sizes, direct, chars, number = Block(), [], [], [], 0, number + 1

        for batch in batches:
            for id_, value in zip(batch.column(0), batch.column(1)):
                value = value.as_py() or ""
                direct.append(split.post(value, len(ids), block))
                ids.append(id_.as_py())
                sizes.append(len(value.encode("utf-8", "surrogatepass")))
                chars += len(value)
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_ROWS:
                    yield from flush()
        if ids:
            yield from flush()

    base_type = f"array<struct<id:{kind.simpleString()},n_bytes:bigint,n:bigint>>"
    dealt = pa.schema(
        [
            ("bucket", pa.int32()),
            ("block", pa.int64()),
            ("keys", pa.list_(pa.string())),
            ("lengths", pa.binary()),
            ("postings", pa.binary()),
            ("base", base_arrow),
        ]
    )
    posted = rows.mapInArrow(post, f"bucket int, block bigint, keys array<string>, lengths binary, postings binary, base {base_type}")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        counted = _Pieces(split)
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            sums: list[bytes | None] = []
            for keys, lengths, packed in zip(*(batch.column(c) for c in ("keys", "lengths", "postings"))):
                if not keys.is_valid:
                    sums.append(None)
                    continue
                pieces = np.fromiter(map(counted.__getitem__, keys.as_py()), np.int64, len(keys))
                lists = np.frombuffer(packed.as_buffer(), dtype=_POSTING)
                each = np.repeat(pieces, np.frombuffer(lengths.as_buffer(), "<u4")) * lists["n"]
                total = np.bincount(lists["row"], weights=each)
                row = np.flatnonzero(total)
                out = np.empty(len(row), dtype=_SUM)
                out["row"], out["n"] = row, total[row]
                sums.append(out.tobytes())
            columns = [pa.array(blocks, pa.int64()), pa.array(sums, pa.binary()), batch.column("base").cast(base_arrow)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "sums", "base"])

    # An explicit number: adaptive execution would merge buckets by their bytes, and the work is in them.
    met = posted.repartition(buckets, "bucket")
    partial = met.mapInArrow(add, f"block bigint, sums binary, base {base_type}")
    first = F.col("base").isNull()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["block"]):
            for start, end in zip(starts, starts[1:]):
                # The block's base sorts first; its partial sums follow.
                base = table.column("base")[int(start)].as_py()
                total = np.array([b["n"] for b in base], dtype=np.int64)
                for packed in table.column("sums").slice(int(start) + 1, int(end - start) - 1).to_pylist():
                    part = np.frombuffer(packed, dtype=_SUM)
                    total[part["row"]] += part["n"]  # a row stands once in each
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b["id"] for b in base], id_arrow),
                        pa.array([b["n_bytes"] for b in base], pa.int64()),
                        pa.array(total, pa.int64()),
                    ],
                    ["id", "n_bytes", "n_tokens"],
                )

    together = partial.withColumn("later", first).repartition("block").sortWithinPartitions("block", "later")
    out = together.mapInArrow(finish, f"id {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id)
