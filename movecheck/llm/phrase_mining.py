"""Phrase collocations: dynamic itemset counting over cyclic scans of shards.

Texts are coded once into blocks, which are dealt to a fixed number of shards. Step t scans
shard t modulo the number of shards and counts phrases of all lengths at a time: a word is
counted in the first cycle; a longer phrase becomes active after the step in which the later
of its two subphrases (without its last, without its first word) reached the threshold, and
is counted until each shard has been seen once since. A frequent phrase has frequent
subphrases, so it becomes active at some step, and its count is then exact.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movecheck.llm.common import discard, staged
from movecheck.session import scratch_folder

MIN_COUNT = 10
MAX_WORDS = 3
SHARDS = 3
#: Words after which a block ends (at the end of a text); its words and phrases are summed at once.
BLOCK_WORDS = 2_000_000
#: Log2 of the slots that remember when a word or phrase of the slot first reached the threshold.
#: A table of them is 16 MB at any size of input. Two phrases in one slot are counted where one
#: would have been enough; no result depends on it.
SLOT_BITS = 24
#: Of a phrase, percent that must stand inside a longer one for the phrase to be dropped.
CONTAINED = 50
NEVER = 255
UNKNOWN_LANG = "und"

_SEPARATOR = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r",
    bytes(range(97, 123)) + _SEPARATOR * 10,
)


#: Words of a language that wait as Python objects before they become Arrow's.
_WAITING = 20_000


def coded(docs: DataFrame, text: str, lang: str, shards: int, seed: int, block_words: int) -> DataFrame:
    """Blocks (shard, words, langs, hashes, counts, codes): the texts as numbers of their words.

    ``hashes`` name the words with their languages in 64 bits across blocks. No phrase spans
    two pieces, so texts of all languages share a block.
    """

    def code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        waiting: dict[str, list[bytes]] = {}
        packed: dict[str, list[pa.Array]] = {}
        size = 0

        def pack(said: str) -> None:
            packed.setdefault(said, []).append(pa.array(waiting[said], pa.large_binary()))
            waiting[said] = []

        def flush() -> pa.RecordBatch:
            nonlocal waiting, packed, size, block
            words: list[bytes] = []
            langs: list[str] = []
            parts: list[np.ndarray] = []
            for said in waiting:
                pack(said)
                encoded = pa.concat_arrays(packed.pop(said)).dictionary_encode()
                at = encoded.indices.to_numpy()
                # The separator came first: it is 0 in each language, and -1 in the block.
                parts.append(np.where(at == 0, -1, at + (len(words) - 1)).astype(np.int32))
                words += encoded.dictionary.to_pylist()[1:]
                langs += [said] * (len(words) - len(langs))
            codes = np.concatenate(parts)
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            hashes = [xxhash.xxh64_intdigest(l.encode() + _SEPARATOR + w, seed) for l, w in zip(langs, words)]
            row = {
                "shard": (task + block) % shards,
                "words": [w.decode("utf-8", "replace") for w in words],
                "langs": langs,
                "hashes": np.array(hashes, dtype=np.uint64).view(np.int64),
                "counts": counts,
                "codes": codes.astype("<i4").tobytes(),
            }
            waiting, packed, size, block = {}, {}, 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for said, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                value = value.as_py()
                if not value:
                    continue
                said = UNKNOWN_LANG if said is None else said
                if said not in waiting:
                    waiting[said] = [_SEPARATOR]
                found = value.translate(_TABLE).replace(_SEPARATOR, b" \xff ").split()
                found.append(_SEPARATOR)
                waiting[said] += found
                size += len(found)
                if len(waiting[said]) >= _WAITING:
                    pack(said)
                if size >= block_words:
                    yield flush()
        if size:
            yield flush()

    arrow = pa.schema(
        [
            ("shard", pa.int32()),
            ("words", pa.list_(pa.string())),
            ("langs", pa.list_(pa.string())),
            ("hashes", pa.list_(pa.int64())),
            ("counts", pa.list_(pa.int64())),
            ("codes", pa.binary()),
        ]
    )
    rows = docs.select(F.col(lang).cast("string"), F.col(text).cast("string"))
    kinds = "shard int, words array<string>, langs array<string>, hashes array<bigint>, counts array<bigint>, codes binary"
    return rows.mapInArrow(code_batches, kinds)


def _slots(hashes: list[np.ndarray]) -> np.ndarray:
    """Slot of each phrase, from the hashes of its words; ``_slot`` says the same in Spark."""
    mixed = reduce(lambda a, b: a ^ b, [h.view(np.uint64) >> np.uint64(13 * j) for j, h in enumerate(hashes)])
    return (mixed & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _slot(names: list[str]) -> Column:
    mixed = reduce(lambda a, b: a.bitwiseXOR(b), [F.shiftrightunsigned(F.col(h), 13 * j) for j, h in enumerate(names)])
    return mixed.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def starts(codes: np.ndarray, hashes: np.ndarray, firsts: list[np.ndarray], k: int) -> np.ndarray:
    """For each position the step at which the phrase of ``k`` words there becomes active."""
    n = max(0, len(codes) - k + 1)
    inside = reduce(np.logical_and, [codes[j : j + n] >= 0 for j in range(k)])
    out = np.full(n, NEVER, dtype=np.uint8)
    at = np.flatnonzero(inside)
    if k == 2:
        known = firsts[0][_slots([hashes])]
        left, right = known[codes[at]], known[codes[at + 1]]
    else:
        of = [hashes[codes[at + j]] for j in range(k)]
        left, right = firsts[k - 2][_slots(of[:-1])], firsts[k - 2][_slots(of[1:])]
    later = np.maximum(left, right)
    out[at] = np.where(later == NEVER, NEVER, later + 1)
    return out


def counted(codes: np.ndarray, at: np.ndarray, k: int, distinct: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of the distinct phrases of ``k`` words at these positions, and their frequencies."""
    bits = max(1, int(distinct - 1).bit_length())
    if bits * k <= 63:
        key = codes[at].astype(np.int64)
        for j in range(1, k):
            key = key << bits | codes[at + j]
        found, n = np.unique(key, return_counts=True)
        return [(found >> bits * (k - 1 - j)) & ((1 << bits) - 1) for j in range(k)], n
    ids, first, n = codes[at].astype(np.int64), at[:0], at[:0]
    for j in range(1, k):
        _, first, ids, n = np.unique(ids << 32 | codes[at + j], return_index=True, return_inverse=True, return_counts=True)
    return [codes[at[first] + j] for j in range(k)], n


def scanned(blocks: DataFrame, step: int, shards: int, max_words: int, shared: Broadcast) -> DataFrame:
    """Rows (k, start, h0, …, n): the phrases active at this step, counted in each block.

    ``shared`` holds the slots, deflated: (``max_words`` - 1) x 16 MB at most.
    """
    names = [f"h{j}" for j in range(max_words)]

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = batch.column(0)[i].values.to_numpy()
                codes = np.frombuffer(batch.column(1)[i].as_buffer(), dtype="<i4")
                for k in range(2, max_words + 1):
                    begun = starts(codes, hashes, firsts, k)
                    at = np.flatnonzero((begun <= step) & (step < begun.astype(np.int64) + shards))
                    if not len(at):
                        continue
                    words, n = counted(codes, at, k, len(hashes))
                    of = [hashes[w] for w in words]
                    lefts, rights = (firsts[k - 2][_slots(x)] for x in (of[:-1], of[1:]))
                    of += [np.zeros(len(n), np.int64)] * (max_words - k)
                    start = np.maximum(lefts, rights).astype(np.int32) + 1
                    columns = [np.full(len(n), k, np.int32), start, *of, n.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "start", *names, "n"])

    kinds = ["k int", "start int", *[f"{h} bigint" for h in names], "n bigint"]
    return blocks.filter(F.col("shard") == step % shards).select("hashes", "codes").mapInArrow(count_batches, ", ".join(kinds))


def summed(phrases: DataFrame, names: list[str]) -> DataFrame:
    """Rows (k, start, h0, …, n): the counts of each phrase added up.

    The rows move before they are grouped: blocks were summed already, and grouping them once more
    beforehand took off 0.1 % of them on 0.10 GB and 3 to 5 % on 0.51 GB.
    """
    return phrases.repartition(*names).groupBy("k", "start", *names).agg(F.sum("n").alias("n"))


def _reach(first: np.ndarray, reached: DataFrame, names: list[str], step: int) -> None:
    """Note the step in the slots of ``reached`` that are still empty (an action).

    What comes to the driver is one bit for each slot, at most 2 MB however many phrases there are.
    """
    slot = reached.select((_slot(names) + 1).alias("slot"))
    bits = slot.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for b, found in bits.collect():
        at = (b - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8), bitorder="little"))
        first[at[first[at] == NEVER]] = step


def _frequent(docs: DataFrame, text: str, lang: str, min_count: int, max_words: int, shards: int, seed: int, block_words: int):
    """Staged tables of words (lang, word, h, n) and of longer phrases (k, h0, …, n), and rows
    (lang, n) of all words; None instead where two words share a hash."""
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    coded(docs, text, lang, shards, seed, block_words).write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    schema = "words array<string>, langs array<string>, hashes array<bigint>, counts array<bigint>, codes binary, shard int"
    blocks = spark.read.schema(schema).parquet(folder)
    names = [f"h{j}" for j in range(max_words)]
    firsts = [np.full(1 << SLOT_BITS, NEVER, dtype=np.uint8) for _ in range(max_words - 1)]
    words = phrases = written = None
    done: list[DataFrame] = []
    often = F.col("n") >= min_count
    # A phrase of k words is active from step (k - 1) * shards at the latest.
    for step in range(shards * max_words):
        if step < shards:
            zipped = F.explode(F.arrays_zip("langs", "words", "hashes", "counts")).alias("w")
            new = blocks.filter(F.col("shard") == step).select(zipped).select(
                F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.hashes").alias("h"), F.col("w.counts").alias("n")
            )
            old, words = words, new if words is None else words.unionByName(new)
            words = staged(words.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")))
            discard(old)
            if step == shards - 1 and words.groupBy("h").count().filter("count > 1").take(1):
                discard(words, written, blocks)
                return None
        if step:
            shared = spark.sparkContext.broadcast([zlib.compress(x, 1) for x in firsts])
            new = scanned(blocks, step, shards, max_words, shared)
            phrases = new if phrases is None else phrases.unionByName(new)
            # What has been through its cycle is exact; if it is rare, so is all that holds it.
            going = F.col("start") > step - shards + 1
            table = staged(summed(phrases, names).filter(going | often))
            discard(written)
            written, phrases = table, table.filter(going)
            shared.destroy()
            if step >= shards:
                done.append(staged(table.filter(~going).select("k", *names, "n")))
        if step < shards:
            _reach(firsts[0], words.filter(often), ["h"], step)
        # Phrases of k words are counted before step k * shards.
        for k in range(max(2, step // shards + 1), max_words if written is not None else 2):
            _reach(firsts[k - 1], written.filter((F.col("k") == k) & often), names[:k], step)
    kept = staged(words.filter(often)), staged(reduce(DataFrame.unionByName, done)), staged(words.groupBy("lang").agg(F.sum("n").alias("total")))
    discard(words, written, blocks, *done)
    return kept


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    top: int = 2000,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    shards: int = SHARDS,
    contained: int = CONTAINED,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends and these into
    words at blanks and tabs. ``a`` counts a phrase of two to ``max_words`` words inside pieces,
    overlaps included; only phrases with ``a`` >= ``min_count`` count. Cut after its first words,
    a phrase has ``l`` for the first part, ``r`` for the rest and the score
    floor(1000000 a a / (l r)); the cut with the lowest score counts, of equals the first.
    Phrases are dropped of which ``contained`` percent or more stand inside one longer frequent
    phrase. ``n`` is the number of words of the language. Ranks go by score, then ``a``, both
    falling, then the phrase in byte order.

    A word is named by 64 bits; should two words of the input share them, which is checked,
    everything is counted again under another seed. Null and empty texts hold nothing; a null
    language is ``und``; repeated rows count each time; other columns are ignored; an empty
    table gives no rows. A text of any length is one block at least: about 60 bytes a word in
    one task. The phrases' counts are summed per block before they move, so a word or phrase
    of a third of all texts is one row per block. Acts when called: (``max_words`` x ``shards``)
    steps, each a scan of one shard.
    """
    found, seed = None, 42
    while found is None:
        found = _frequent(docs, text, lang, min_count, max_words, shards, seed, block_words)
        seed = uuid.uuid4().int & 0xFFFFFFFF
    words, phrases, sizes = found
    names = [f"h{j}" for j in range(max_words)]
    zero = F.lit(0).cast("bigint")

    def part(begin: int, end: int) -> list[Column]:
        return [F.lit(end - begin).alias("pk"), *[(F.col(names[j]) if j < end else zero).alias(f"p{j - begin}") for j in range(begin, begin + max_words - 1)]]

    keys = ["pk", *[f"p{j}" for j in range(max_words - 1)]]
    singles = words.select("lang", F.lit(1).alias("pk"), F.col("h").alias("p0"), *[zero.alias(k) for k in keys[2:]], "n")
    longer = phrases.filter(F.col("k") < max_words).select(
        F.lit(None).cast("string").alias("lang"), F.col("k").alias("pk"), *[F.col(names[j]).alias(f"p{j}") for j in range(max_words - 1)], "n"
    )
    known = singles.unionByName(longer)
    sides, subs = [], []
    for k in range(2, max_words + 1):
        cuts = [(c, s, p) for c in range(1, k) for s, p in enumerate((part(0, c), part(c, k)))]
        these = [F.struct(F.lit(c).alias("cut"), F.lit(s).alias("side"), *p) for c, s, p in cuts]
        sides.append(F.when(F.col("k") == k, F.array(*these)))
        inner = [F.struct(*part(b, b + m)) for m in range(2, k) for b in range(k - m + 1)]
        if inner:
            subs.append(F.when(F.col("k") == k, F.array(*inner)))
    looked = phrases.select("k", *names, "n", F.explode(F.coalesce(*sides)).alias("c")).select("k", *names, F.col("n").alias("a"), "c.*")
    met = looked.join(known, keys)
    values = [
        F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("n"))).alias(f"{name}{c}")
        for c in range(1, max_words)
        for s, name in enumerate("lr")
    ]
    of_lang = F.max(F.when((F.col("cut") == 1) & (F.col("side") == 0), F.col("lang"))).alias("lang")
    joined = met.groupBy("k", *names, "a").agg(of_lang, *values)

    def cut(c: int) -> Column:
        exact = {x: f"cast({x} as decimal(18,0))" for x in ("a", f"l{c}", f"r{c}")}
        score = F.expr(f"(1000000 * ({exact['a']} * {exact['a']})) div ({exact[f'l{c}']} * {exact[f'r{c}']})")
        return F.when(F.col(f"l{c}").isNotNull(), F.struct(score.alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))

    best = F.array_min(F.array_compact(F.array(*[cut(c) for c in range(1, max_words)])))
    scored = joined.withColumn("best", best).select("lang", "k", *names, "a", "best.score", "best.l", "best.r")
    if subs:
        inside = phrases.select("n", F.explode(F.coalesce(*subs)).alias("c")).select("n", "c.*").groupBy(*keys).agg(F.max("n").alias("longer"))
        inside = inside.select(F.col("pk").alias("k"), *[F.col(f"p{j}").alias(names[j]) for j in range(max_words - 1)], zero.alias(names[-1]), "longer")
        scored = scored.join(inside, ["k", *names], "left").filter(
            F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))
        )
    falling = [F.desc("score"), F.desc("a")]
    near = Window.partitionBy("lang").orderBy(*falling)
    # Ties of the last rank stay until the phrases are spelled out.
    high = staged(scored.withColumn("near", F.rank().over(near)).filter(F.col("near") <= top))
    at = F.posexplode(F.slice(F.array(*names), F.lit(1), F.col("k"))).alias("pos", "h")
    spelled = (
        high.select("lang", "k", *names, at)
        .join(words.select("h", "word"), "h")
        .groupBy("k", *names)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("said"))
        .select("k", *names, F.array_join("said.word", " ").alias("phrase"))
    )
    whole = high.join(spelled, ["k", *names]).join(sizes, "lang")
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*falling, "phrase")))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint")
    )
