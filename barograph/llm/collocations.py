"""Phrase collocations: multikey three-way quicksort of suffix pointers, whose equal partitions are the counts.

1. Tasks number the words of a slice of texts and sort pointers to all its places, by up to ``DEPTH`` words from each on.
   Equal suffixes become one weighted entry: what is repeated within a slice is never shuffled twice.
2. Entries are routed by their two leading words, in packed rows of arrays. A place where much more than a share of the
   text would meet is cut up further by the third word, so that no part holds more than about ``PART`` places.
3. Each part is sorted the same way. The weights of an equal partition add up to the count of the phrase that its
   entries have in common; a partition that falls below the least count is abandoned unsorted.

Only frequent phrases come out. Counts of a candidate's pieces are found among them, as a piece is no rarer than the
whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm.textbatch import mixed, slices
from barograph.session import shared_dir

#: Words of the longest phrase.
DEPTH = 3
LEAST_COUNT, FIRST, COVERED_PERCENT, SCALE = 10, 2000, 50, 1_000_000
NO_LANG = "und"

#: Places of one part of a sort, about; and how many cells the leading words are dealt over.
PART, CELLS = 2_000_000, 4096
#: Bytes of text whose places are sorted together before they are routed.
SLICE = 8 << 20
#: Copies of a counted piece of one and of two words, over which the phrases that begin or end with it are dealt.
SALTS = {1: 16, 2: 4}
#: Groups of phrases that are ranked first, so that a language's last ranking has ``GROUPS`` times the wanted rows at most.
GROUPS = 16

#: Characters that part pieces, as bytes that no text has; words are parted by blanks and tabs.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
#: Stands for "the piece has ended" among word numbers.
_END = -1


def multikey_partitions(
    keys: np.ndarray, weights: np.ndarray, abandon: Callable[[np.ndarray, int], np.ndarray], least_depth: int = 1
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Three-way quicksort of entries by several keys; its equal partitions as (depth, an entry of each, their weights).

    keys: a row of word numbers for each depth, -1 from where an entry has ended. Entries are dealt out by their leading
    word first. Then all partitions are cut at once, each by a key of its own: entries below it, equal to it and above
    it. Equal ones have one more word in common and go on with the next. ``abandon`` tells from weights and the number
    of common words which partitions aren't worth going on with.
    """
    depths, n = keys.shape
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    if not n:
        return out
    order = np.argsort(keys[0], kind="stable").astype(np.int32)
    cuts = np.flatnonzero(np.diff(keys[0][order], prepend=-2))
    sizes, depth = np.diff(cuts, append=n).astype(np.int32), np.ones(len(cuts), np.int8)
    total = np.add.reduceat(weights[order], cuts)
    if least_depth <= 1:
        out.append((1, order[cuts], total))
    go = ~abandon(total, 1)
    order, sizes, depth = order[np.repeat(go, sizes)], sizes[go], depth[go]
    while len(order):
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        k = np.empty(len(order), np.int32)
        for d in range(1, depths):
            here = np.repeat(depth == d, sizes)
            k[here] = keys[d, order[here]]
        middle = np.stack([k[starts], k[starts + sizes // 2], k[starts + sizes - 1]])
        middle.sort(axis=0)
        pivot = middle[1][own]
        side = (k >= pivot).view(np.int8) + (k > pivot).view(np.int8)
        # each entry goes behind the parts before its own and the entries before it in its part
        below, equal = np.cumsum(side == 0, dtype=np.int32), np.cumsum(side == 1, dtype=np.int32)
        ends = starts + sizes - 1
        n_below, n_equal = (np.diff(c[ends], prepend=np.int32(0)) for c in (below, equal))
        b_before, e_before = below[ends] - n_below, equal[ends] - n_equal
        at = np.arange(len(order), dtype=np.int32)
        base = (starts - b_before)[own], (starts + n_below - e_before)[own], (n_below + n_equal + b_before + e_before)[own]
        place = np.where(side == 0, base[0] + below - 1, np.where(side == 1, base[1] + equal - 1, base[2] + at - below - equal))
        moved = np.empty_like(order)
        moved[place] = order
        counts = np.stack([n_below, n_equal, sizes - n_below - n_equal], axis=1).ravel()
        some = np.flatnonzero(counts)
        counts, equals = counts[some], some % 3 == 1
        part_starts = np.cumsum(counts, dtype=np.int32) - counts
        total = np.add.reduceat(weights[moved], part_starts)
        new_depth = depth[some // 3] + equals
        # equal to the end mark: nothing in common beyond the words before it
        ended = equals & (middle[1][some // 3] == _END)
        for d in range(max(2, least_depth), depths + 1):
            found = np.flatnonzero(equals & ~ended & (new_depth == d))
            out.append((d, moved[part_starts[found]], total[found]))
        go = ~ended & (new_depth < depths)
        for d in range(1, depths):
            found = np.flatnonzero(go & (new_depth == d))
            go[found[abandon(total[found], d)]] = False
        order, sizes, depth = moved[np.repeat(go, counts)], counts[go], new_depth[go].astype(np.int8)
    return out


def _numbered(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Word numbers of a text in order, -1 at the end of each piece, and the words by number."""
    tokens = data.lower().translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    x = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    mark = pc.index(coded.dictionary, pa.scalar(_BREAK, pa.binary())).as_py()
    if mark >= 0:
        x[x == mark] = _END
    return x, coded.dictionary


def _suffixes(x: np.ndarray) -> np.ndarray:
    """For every place of a word: the numbers of the words from it on, as keys by depth."""
    at = np.flatnonzero(x != _END)
    keys = np.full((DEPTH, len(at)), _END, np.int64)
    keys[0] = x[at]
    padded = np.concatenate([x, np.full(DEPTH, _END)])
    for d in range(1, DEPTH):
        keys[d] = np.where(keys[d - 1] == _END, _END, padded[at + d])
    return keys


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from its first and last ones; used for routing alone."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    h = np.diff(ends).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(8):
        for place in (ends[:-1] + i, ends[1:] - 1 - i):
            inside = (place >= ends[:-1]) & (place < ends[1:])
            byte = np.where(inside, raw[np.minimum(np.maximum(place, 0), len(raw) - 1)] if len(raw) else 0, 0).astype(np.uint64)
            h = mixed(h * np.uint64(31) + byte)
    return h


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def _by_lang(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, bytes]]:
    """Texts of one language together, about ``limit`` bytes of all languages at a time, with a break between texts."""
    wait: dict[str, list[bytes]] = {}
    held = 0
    for piece, data, starts in slices(batches):
        raw, at = data.tobytes(), starts.tolist()
        for lang, a, b in zip(piece.column("lang").to_pylist(), at, at[1:], strict=False):
            wait.setdefault(lang, []).append(raw[a:b])
        held += len(raw)
        if held >= limit:
            yield from ((lang, _BREAK.join(texts)) for lang, texts in wait.items())
            wait, held = {}, 0
    yield from ((lang, _BREAK.join(texts)) for lang, texts in wait.items())


def _cell_places(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many places each cell of two leading words has; -1 counts the words of a language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, words = np.zeros(CELLS, np.int64), {}
        for lang, data in _by_lang(batches, limit):
            x, dictionary = _numbered(data)
            words[lang] = words.get(lang, 0) + int((x != _END).sum())
            h = _word_hashes(dictionary)
            pair = np.flatnonzero((x[:-1] != _END) & (x[1:] != _END))
            cells += np.bincount((_paired(h[x[pair]], h[x[pair + 1]]) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(some) + list(words), pa.string()), pa.array([*some.tolist(), *[-1] * len(words)], pa.int32()), pa.array([*cells[some].tolist(), *words.values()], pa.int64())],
            names=["lang", "cell", "places"],
        )

    return counted


_ENTRIES = "part int, lang string, words array<binary>, keys array<int>, weights array<int>"


def _joined(found: list[tuple[int, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and weights of the partitions with so many words in common."""
    at = [(a, w) for d, a, w in found if d == depth]
    return (np.concatenate([a for a, _ in at]), np.concatenate([w for _, w in at])) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def _routed(limit: int, parts: np.ndarray, part_starts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weighted entries of each slice, packed by the part that they are routed to."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _by_lang(batches, limit):
            x, dictionary = _numbered(data)
            if not (x != _END).any():
                continue
            h = _word_hashes(dictionary)
            keys = _suffixes(x)
            words, counts = np.unique(keys[0], return_counts=True)
            # single words are counted as they are; of the rest, those places that have a second word
            keys = keys[:, keys[1] != _END]
            entries, weights = [np.stack([words, np.full(len(words), _END), np.full(len(words), _END)])], [counts]
            found = multikey_partitions(keys, np.ones(keys.shape[1], np.int64), lambda w, d: np.zeros(len(w), bool), 2)
            pairs, pair_counts = _joined(found, 2)
            triples, triple_counts = _joined(found, 3)
            entries.append(keys[:, triples])
            weights.append(triple_counts)
            # what is left of a pair's count has no third word
            code = keys[0] * len(dictionary) + keys[1]
            order = np.argsort(code[pairs])
            pairs, rest = pairs[order], pair_counts[order]
            np.subtract.at(rest, np.searchsorted(code[pairs], code[triples]), triple_counts)
            left = rest > 0
            ended = keys[:, pairs[left]]
            ended[2] = _END
            entries.append(ended)
            weights.append(rest[left])
            all_keys, all_weights = np.concatenate(entries, axis=1), np.concatenate(weights)
            second = np.where(all_keys[1] == _END, np.uint64(0), h[all_keys[1]])
            third = np.where(all_keys[2] == _END, np.uint64(0), h[all_keys[2]])
            pair = _paired(h[all_keys[0]], second)
            cell = (pair % np.uint64(CELLS)).astype(np.int64)
            part = part_starts[cell] + (_paired(pair, third) % parts[cell].astype(np.uint64)).astype(np.int64)
            yield from _packed(lang, part, all_keys, all_weights, dictionary)

    return routed


def _packed(lang: str, part: np.ndarray, keys: np.ndarray, weights: np.ndarray, dictionary: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each part: its words, its entries' keys one depth after another, and their weights."""
    order = np.lexsort((keys[2], keys[1], keys[0], part))
    part, keys, weights = part[order], keys[:, order], weights[order]
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        used, local = np.unique(keys[:, a:b], return_inverse=True)
        local = local.reshape(DEPTH, -1)
        if used[0] == _END:
            used, local = used[1:], local - 1
        columns = [[int(part[a])], [lang], [dictionary.take(pa.array(used))], [local.ravel().astype(np.int32)], [weights[a:b].astype(np.int32)]]
        types = [pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "lang", "words", "keys", "weights"])


def _counted(least: int, whole: set[int]) -> Callable[[pa.Table], pa.Table]:
    """The frequent phrases of a part; of parts that share their leading words with others, all pairs' counts so far."""

    def counted(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        out = []
        langs = group.column("lang").combine_chunks()
        for lang in pc.unique(langs).to_pylist():
            own = group.filter(pc.equal(langs, lang)).combine_chunks()
            lists = own.column("words").combine_chunks()
            coded = lists.flatten().dictionary_encode()
            numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            many = np.asarray(own.column("weights").combine_chunks().value_lengths())
            flat = np.asarray(own.column("keys").combine_chunks().flatten()).astype(np.int64)
            weights = np.asarray(own.column("weights").combine_chunks().flatten()).astype(np.int64)
            keys = np.full((DEPTH, len(weights)), _END, np.int64)
            at = 0
            for i, n in enumerate(many.tolist()):
                rows = flat[at * DEPTH : (at + n) * DEPTH].reshape(DEPTH, n)
                keys[:, at : at + n] = np.where(rows == _END, _END, numbers[np.minimum(rows + first[i], len(numbers) - 1)])
                at += n
            # a pair's count is only part of it where others have the rest: then nothing below a pair is abandoned
            enough = (lambda w, d: w < least) if part in whole else (lambda w, d: (w < least) & (d >= 2))
            for d, at_, total in multikey_partitions(keys, weights, enough):
                # single words have entries of their own: what their longer entries here add up to isn't all
                if d == 1:
                    continue
                keep = total >= least if d == DEPTH or part in whole else total > 0
                out.append((lang, keys[:, at_[keep]], total[keep], d, coded.dictionary))
            single = keys[1] == _END
            if single.any():
                count = np.bincount(keys[0, single], weights[single]).astype(np.int64)
                frequent = np.flatnonzero(count >= least)
                out.append((lang, np.stack([frequent, *[np.full(len(frequent), _END)] * (DEPTH - 1)]), count[frequent], 1, coded.dictionary))
        schema = pa.schema([("lang", pa.string()), *((f"w{d}", pa.string()) for d in range(1, DEPTH + 1)), ("f", pa.int64())])
        tables = []
        for lang, keys, total, depth, dictionary in out:
            words = [dictionary.take(pa.array(np.where(keys[d] == _END, 0, keys[d]))).cast(pa.string()) if d < depth else pa.nulls(len(total), pa.string()) for d in range(DEPTH)]
            tables.append(pa.table([pa.array([lang] * len(total), pa.string()), *words, pa.array(total)], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return counted


def phrase_counts(spark: SparkSession, docs: DataFrame, least: int = LEAST_COUNT, part: int = PART, slice_bytes: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, w1, w2, w3, f), w2 and w3 null where a phrase is shorter, and (lang, n), all its words.

    docs: lang and text. The driver gets the number of places in each of ``CELLS`` cells, and nothing else.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    places = texts.mapInArrow(_cell_places(slice_bytes), "lang string, cell int, places long")
    at = shared_dir(spark, "phrase-cells")
    places.groupBy("lang", "cell").agg(F.sum("places").alias("places")).write.parquet(at)
    places = spark.read.parquet(at)
    in_cell = np.zeros(CELLS, np.int64)
    for row in places.where("cell >= 0").collect():
        in_cell[row["cell"]] = row["places"]
    # small cells share a part, large ones are cut by the third word
    parts = np.maximum(1, -(-in_cell // part))
    together = np.cumsum(in_cell) // part
    part_starts = np.where(parts > 1, 0, together)
    large = np.flatnonzero(parts > 1)
    offset = int(together[-1]) + 1
    for cell in large.tolist():
        part_starts[cell] = offset
        offset += int(parts[cell])
    whole = set(np.unique(part_starts[parts == 1]).tolist())
    entries = texts.mapInArrow(_routed(slice_bytes, parts, part_starts), _ENTRIES)
    schema = "lang string, " + ", ".join(f"w{d} string" for d in range(1, DEPTH + 1)) + ", f long"
    counted = entries.groupBy("part").applyInArrow(_counted(least, whole), schema)
    if len(large):
        counted = counted.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    at = shared_dir(spark, "phrases")
    counted.write.parquet(at)
    return spark.read.parquet(at), places.where("cell = -1").select("lang", F.col("places").alias("n"))


def _with_count(phrases: DataFrame, counts: DataFrame, words: list[str], name: str) -> DataFrame:
    """``phrases`` with the count of the piece ``words``. Those of one piece are dealt over copies of its count."""
    salts = SALTS[len(words)]
    piece = [f"__{i}" for i in range(len(words))]
    size = F.size(F.array_compact(F.array("w1", "w2", "w3")))
    pieces = counts.where(size == len(words)).select(F.col("lang").alias("__lang"), *[F.col(f"w{i + 1}").alias(c) for i, c in enumerate(piece)], F.col("f").alias(name))
    pieces = pieces.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(salts)).cast("int")
    same = (F.col("lang") == F.col("__lang")) & (F.col("__salt") == salt)
    for w, c in zip(words, piece, strict=True):
        same &= F.col(w) == F.col(c)
    return phrases.join(pieces, same).drop("__lang", "__salt", *piece)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly: in decimals, as the products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST_COUNT, first: int = FIRST, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases of two and three words.

    docs: lang and text; other columns don't matter. Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and
    line ends, pieces into words at blanks and tabs. A phrase counts with ``least`` occurrences within pieces; its
    score is that of its worst cut in two, occurrences squared over those of both sides; a pair is dropped where a phrase
    of three words that holds it has ``covered_percent`` of its occurrences. A null language is ``und``, a null text
    empty; repeated rows count as often as they stand there; ties go by occurrences, then by the phrase's bytes. No
    frequent phrase, or an empty table, gives no rows. Words compare as texts, not by hashes; counts below 10^15.
    """
    counts, words = phrase_counts(spark, docs.select("lang", "text"), least)
    pairs = counts.where("w2 is not null and w3 is null").withColumnRenamed("f", "a")
    triples = counts.where("w3 is not null").withColumnRenamed("f", "a")

    over = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    over = over.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(over, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a"))).drop("longer")
    pairs = _with_count(_with_count(pairs, counts, ["w1"], "l"), counts, ["w2"], "r")
    pairs = pairs.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))

    for left, right, i in ((["w1"], ["w2", "w3"], 1), (["w1", "w2"], ["w3"], 2)):
        triples = _with_count(_with_count(triples, counts, left, f"l{i}"), counts, right, f"r{i}")
        triples = triples.withColumn(f"s{i}", _score(F.col("a"), F.col(f"l{i}"), F.col(f"r{i}")))
    later = F.col("s2") < F.col("s1")
    cut = {"l": F.when(later, F.col("l2")).otherwise(F.col("l1")), "r": F.when(later, F.col("r2")).otherwise(F.col("r1")), "score": F.least("s1", "s2")}
    triples = triples.select("lang", "w1", "w2", "w3", "a", *[c.alias(n) for n, c in cut.items()])

    both = pairs.select(*triples.columns).unionByName(triples).withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    both = both.withColumn("__at", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(F.col("__at") <= first)
    best = Window.partitionBy("lang").orderBy(*order)
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
