"""Language-model scores from a probabilistic suffix tree, beside those of a unigram model.

Symbols are the bytes of a text's lower-cased words, parted by single blanks and closed by one end. A context of up to
DEPTH symbols is kept if it is frequent enough and its next symbols diverge from those of the context one shorter; each
state's distribution is smoothed with its parent's. Beginnings of kept contexts are kept too, so that the longest
suffix state follows from the last state and the symbol alone, and a text is scored by walking from state to state.

The kept contexts are a table in the shared folder that grows with the input. Only the common ones, of bounded number,
make up the tree that goes to every task; what the rare ones add to a place is looked up by a join, like the rare words
of the unigram model. The bound decides who looks a context up and has no influence on scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import labelled
from barograph.llm.textbatch import RangeHash, mixed, slices, word_spans
from barograph.session import shared_dir

#: The longest context, in symbols; a context and its next symbol fit 64 bits.
DEPTH = 5
#: Contexts seen less often are not tried: what a single place can save over the parent is less than the gain asked for.
LEAST_COUNT = 2
#: Kept contexts that make up at least this share of all places, at most 1 / COMMON_CONTEXT of each length, go to every
#: task as a tree; the others are joined.
COMMON_CONTEXT = 3e-6
#: Bits of the filter by which tasks see where a rare context may hold; a place that it marks in vain is only joined in vain.
FILTER_BITS = 1 << 26
#: The log-likelihood (nats) that a context must gain over its parent, as a multiple of the log of all places.
GAIN = 1.0
#: How many times a state counts its parent's distribution, and the root each byte.
PARENT_WEIGHT, ROOT_WEIGHT = 10.0, 0.5
#: Words that make up at least this share of all tokens, at most 1 / COMMON, go to every task; the others are joined.
COMMON = 2e-7
BASE_SMOOTHING = 0.1

END = 10
WORD_KIND, PLACE_KIND = 0, 1
#: Counts that a task holds before it hands them on.
HELD = 2_000_000
#: Symbols that are walked in one go; more of a text are walked beside them.
STRETCH = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Tokens:
    """Words of a slice: the document of each and its hash, and the symbols of all documents, each led by DEPTH ends."""

    doc: np.ndarray
    word: np.ndarray
    symbols: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray


def tokens(data: np.ndarray, starts: np.ndarray) -> Tokens:
    data = _LOWER[data]
    begin, end = word_spans(data, starts)
    docs = len(starts) - 1
    doc = np.searchsorted(starts, begin, "right") - 1
    sizes = end - begin
    words = np.bincount(doc, minlength=docs)
    # the symbols of a document: its words and a blank or the end behind each; the end alone if it has none
    lengths = np.bincount(doc, sizes + 1, docs).astype(np.int64) + (words == 0)
    begins = np.cumsum(lengths + DEPTH) - lengths
    symbols = np.full(int((lengths + DEPTH).sum()), 32, np.uint8)
    inside = np.repeat(np.cumsum(sizes) - sizes, sizes)
    within = np.arange(int(sizes.sum())) - inside
    first_word = np.cumsum(words) - words
    before = np.cumsum(sizes + 1) - (sizes + 1)
    place = begins[doc] + before - before[first_word[doc]] if len(doc) else begin
    symbols[np.repeat(place, sizes) + within] = data[np.repeat(begin, sizes) + within]
    symbols[begins + lengths - 1] = END
    symbols[(begins[:, None] - 1 - np.arange(DEPTH)).ravel()] = END
    return Tokens(doc, RangeHash(data)(begin, end).view(np.int64), symbols, begins, lengths)


def places(t: Tokens) -> np.ndarray:
    """A code for each symbol to be predicted: the symbol in the lowest byte, those before it above, the latest lowest."""
    codes = np.zeros(max(0, len(t.symbols) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        codes |= t.symbols[DEPTH - k : len(t.symbols) - k].astype(np.int64) << (8 * k)
    led = np.ones(len(codes), bool)
    # symbols that only lead a document are not predicted; the first document's are cut off already
    led[(t.begins[1:, None] - DEPTH - 1 - np.arange(DEPTH)).ravel()] = False
    return codes[led]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {WORD_KIND: [], PLACE_KIND: []}

    def handed(kind: int) -> pa.RecordBatch:
        codes, n = _summed(held[kind])
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), kind), pa.int32()), pa.array(codes), pa.array(n)], names=["kind", "code", "n"])

    for _, data, starts in slices(batches):
        t = tokens(data, starts)
        # the end is a token like the words, under a code of its own
        ends = (np.zeros(1, np.int64), np.array([len(starts) - 1]))
        held[WORD_KIND] += [np.unique(t.word, return_counts=True), ends]
        held[PLACE_KIND].append(np.unique(places(t), return_counts=True))
        for kind in held:
            if sum(len(c) for c, _ in held[kind]) > HELD:
                held[kind] = [_summed(held[kind])]
                if len(held[kind][0][0]) > HELD // 2:
                    yield handed(kind)
    for kind in held:
        if held[kind]:
            yield handed(kind)


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of texts that nothing is learnt from, counted as 0."""
    held = []

    def handed() -> pa.RecordBatch:
        codes = np.unique(np.concatenate(held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), PLACE_KIND), pa.int32()), pa.array(codes), pa.array(np.zeros(len(codes), np.int64))], names=["kind", "code", "n"])

    for _, data, starts in slices(batches):
        held.append(np.unique(places(tokens(data, starts))))
        if sum(len(c) for c in held) > HELD:
            yield handed()
    if held:
        yield handed()


def contexts(counted: DataFrame, all_places: int, least_count: int = LEAST_COUNT, gain: float = GAIN) -> DataFrame:
    """(length, context, symbol, n, all) of the contexts that are kept, and of the root (length 0).

    counted: code, n of all places; all: how often the context is seen. A context is tried if it is seen often enough,
    and kept if coding its next symbols by their own rates instead of the parent's saves enough.
    """
    order = F.explode(F.array(*[F.struct(F.lit(k).alias("length"), F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("context")) for k in range(DEPTH + 1)])).alias("o")
    rows = counted.select(order, F.col("code").bitwiseAND(F.lit(255)).alias("symbol"), "n").groupBy("o.length", "o.context", "symbol").agg(F.sum("n").alias("n"))
    totals = rows.groupBy("length", "context").agg(F.sum("n").alias("all")).where(F.col("all") >= least_count)
    rows = rows.join(totals, ["length", "context"])
    up = rows.select((F.col("length") + 1).alias("length"), F.col("context").alias("above"), "symbol", F.col("n").alias("n_above"), F.col("all").alias("all_above"))
    mask = F.element_at(F.array(*[F.lit((1 << (8 * max(0, k - 1))) - 1) for k in range(DEPTH + 1)]), F.col("length") + 1)
    saved = F.sum(F.col("n") * (F.log(F.col("n") / F.col("all")) - F.log(F.col("n_above") / F.col("all_above"))))
    tried = rows.where("length > 0").withColumn("above", F.col("context").bitwiseAND(mask)).join(up, ["length", "above", "symbol"])
    kept = tried.groupBy("length", "context").agg(saved.alias("saved")).where(F.col("saved") >= gain * float(np.log(max(2, all_places)))).select("length", "context")
    return rows.where("length = 0").select("length", "context", "symbol", "n", "all").unionByName(rows.join(kept, ["length", "context"]).select("length", "context", "symbol", "n", "all"))


def _filter_bit(length: int, context: np.ndarray, bits: int) -> np.ndarray:
    return (mixed((context | (length << (8 * DEPTH))).astype(np.uint64)) >> np.uint64(7)).astype(np.int64) & (bits - 1)


def context_filter(rare: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array that marks each (length, context) of ``rare``. Tasks fold their marks into words of 64 bits, so that
    the driver gets at most bits / 64 rows, whatever the number of contexts."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, context = (batch.column(c).to_numpy() for c in ("length", "context"))
            at = np.unique(np.concatenate([_filter_bit(k, context[length == k].astype(np.int64), bits) for k in range(1, DEPTH + 1)]))
            word, first = np.unique(at >> 6, return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], names=["word", "held"])

    folded = rare.select("length", "context").mapInArrow(marks, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[folded["word"].to_numpy()] = folded["held"].to_numpy()
    return out


def marked(held: np.ndarray, length: int, codes: np.ndarray) -> np.ndarray:
    """Whether the filter has the context of this length before the symbol of each code."""
    at = _filter_bit(length, (codes >> 8) & ((1 << (8 * length)) - 1), len(held) << 6)
    return (held[at >> 6] >> (at & 63)) & 1 != 0


def _looked_for(model, held):
    def looked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each code and each rare context that may hold before its symbol: what the tree gives, and the context."""
        for batch in batches:
            codes = batch.column("code").to_numpy().astype(np.int64)
            for k in range(1, DEPTH + 1):
                mine = codes[marked(held.value, k, codes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine), pa.array(np.full(len(mine), k), pa.int32()), pa.array((mine >> 8) & ((1 << (8 * k)) - 1)), pa.array(mine & 255), pa.array(model.value.at(mine))],
                    names=["code", "length", "context", "symbol", "log10"],
                )

    return looked_for


def rare_places(codes: DataFrame, rare: DataFrame, model, held) -> DataFrame:
    """(code, moved): by how much the rare contexts change the log10 probability that the tree gives to a place.

    codes: each different code once. rare: (length, context, symbol, n, all) of the kept contexts that the tree lacks.
    A context is never seen more often than its suffixes, so that all rare ones of a place are longer than the common.
    """
    own = rare.groupBy("length", "context", "all").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("counts"))
    places = codes.select("code").mapInArrow(_looked_for(model, held), "code long, length int, context long, symbol long, log10 double")
    found = places.join(own, ["length", "context"]).withColumn("n", F.coalesce(F.try_element_at("counts", F.col("symbol")), F.lit(0)))
    chain = found.groupBy("code").agg(F.first("log10").alias("log10"), F.array_sort(F.collect_list(F.struct("length", "n", "all"))).alias("states"))
    rate = F.aggregate("states", F.pow(F.lit(10.0), F.col("log10")), lambda p, s: (s["n"] + PARENT_WEIGHT * p) / (s["all"] + PARENT_WEIGHT))
    return chain.select("code", (F.log10(rate) - F.col("log10")).alias("moved"))


@dataclass
class Tree:
    """column: of each byte; log10 and follow: log probability and next state, at state * columns + column."""

    column: np.ndarray
    columns: int
    log10: np.ndarray
    follow: np.ndarray

    def at(self, codes: np.ndarray) -> np.ndarray:
        """The log10 probability of each code's symbol after the DEPTH symbols before it."""
        state = np.zeros(len(codes), np.int64)
        for k in range(DEPTH, 0, -1):
            state = self.follow[state * self.columns + self.column[(codes >> (8 * k)) & 255]].astype(np.int64)
        return self.log10[state * self.columns + self.column[codes & 255]].astype(float)

    def walk(self, t: Tokens) -> np.ndarray:
        """The log10 probability of each document's symbols."""
        docs = len(t.lengths)
        pieces = -(-t.lengths // STRETCH)
        doc = np.repeat(np.arange(docs), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, size = t.begins[doc] + nth * STRETCH, np.minimum(STRETCH, t.lengths[doc] - nth * STRETCH)
        order = np.argsort(-size, kind="stable")
        doc, begin, size = doc[order], begin[order] - DEPTH, size[order]
        symbol, state, total = self.column[t.symbols], np.zeros(len(doc), np.int64), np.zeros(len(doc))
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        for j in range(DEPTH + longest):
            # the DEPTH symbols before a stretch lead to its first state
            n = len(doc) if j < DEPTH else live[j - DEPTH]
            at = state[:n] * self.columns + symbol[begin[:n] + j]
            if j >= DEPTH:
                total[:n] += self.log10[at]
            state[:n] = self.follow[at]
        return np.bincount(doc, total, docs)


def tree(rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Tree:
    """The tree of (length, context, symbol, n) rows; without rows all bytes are alike."""
    length, context, symbol, n = rows
    seen = np.unique(symbol)
    column = np.full(256, len(seen), np.int64)
    column[seen] = np.arange(len(seen))
    columns = len(seen) + 1
    # contexts once each, by a number of length and context; only these become Python objects
    own, row_of = np.unique((length << (8 * DEPTH)) | context, return_inverse=True)
    own = [(k >> (8 * DEPTH), k & ((1 << (8 * DEPTH)) - 1)) for k in own.tolist()]
    states = {(0, 0)}
    for k, c in own:
        # all suffixes, and all beginnings of these; the latest symbol is the lowest byte
        for a in range(k + 1):
            for b in range(a, k + 1):
                states.add((b - a, (c >> (8 * a)) & ((1 << (8 * (b - a))) - 1)))
    states = sorted(states)
    number = {s: i for i, s in enumerate(states)}
    # rows of one state stand together; dense arrays are of single precision and filled piece by piece, for the driver's sake
    at = np.array([number[s] for s in own], np.int64)[row_of]
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(len(states) + 1)).tolist()
    cols, counts = column[symbol][order], n[order].astype(float)
    others = max(0, 256 - len(seen))
    rate = np.empty((len(states), columns), np.float32)
    for i, (k, c) in enumerate(states):
        mine, own = counts[edge[i] : edge[i + 1]], cols[edge[i] : edge[i + 1]]
        if k == 0:
            row = np.full(columns, ROOT_WEIGHT)
            row[own] += mine
            rate[0] = row / (row[:-1].sum() + ROOT_WEIGHT * others)
        else:
            row = PARENT_WEIGHT * rate[number[(k - 1, c & ((1 << (8 * (k - 1))) - 1))]].astype(float)
            row[own] += mine
            rate[i] = row / (mine.sum() + PARENT_WEIGHT)
    np.log10(rate, out=rate)
    lengths, codes = np.array([k for k, _ in states]), np.array([c for _, c in states], np.int64)
    follow = np.zeros((len(states), columns), np.int32)
    for i in range(0, len(states), 4096):
        longer = (codes[i : i + 4096, None] << 8) | seen[None, :].astype(np.int64)
        for k in range(1, DEPTH + 1):
            of = np.flatnonzero(lengths == k)
            if len(of):
                end = longer & ((1 << (8 * k)) - 1)
                found = np.minimum(np.searchsorted(codes[of], end), len(of) - 1)
                hit = (codes[of][found] == end) & (lengths[i : i + 4096, None] + 1 >= k)
                follow[i : i + 4096, :-1][hit] = of[found[hit]]
    return Tree(column, columns, rate.ravel(), follow.ravel())


def _scores(model, common, held, floor: float):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, (codes, logs) = model.value, common.value
        if not len(codes):
            codes, logs = np.array([np.iinfo(np.int64).min]), np.full(1, floor)
        names = ["tag", "doc_id", "kind", "code", "uses", "n_tokens", "n_known", "base", "score"]

        def looked_up(tag: np.ndarray, kind: int, code: np.ndarray, uses: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(code))
            columns = [pa.array(tag), none.cast(pa.int64()), pa.array(np.full(len(code), kind), pa.int32()), pa.array(code), pa.array(uses, pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, *(none.cast(x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

        for batch, data, starts in slices(batches):
            t, docs = tokens(data, starts), batch.num_rows
            words, which = np.unique(t.word, return_inverse=True)
            at = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
            known = codes[at] == words
            hit = known[which]
            base = np.bincount(t.doc[hit], logs[at][which[hit]], docs)
            n_known, n_words = np.bincount(t.doc[hit], minlength=docs), np.bincount(t.doc, minlength=docs)
            end = min(np.searchsorted(codes, 0), len(codes) - 1)
            has_end = codes[end] == 0
            base, n_known = base + (logs[end] if has_end else floor), n_known + int(has_end)
            tag = batch.column("tag").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("tag"), batch.column("doc_id"), pa.nulls(docs, pa.int32()), pa.nulls(docs, pa.int64()), pa.array(np.zeros(docs, np.int32)), pa.array(n_words + 1), pa.array(n_known), pa.array(base), pa.array(walker.walk(t))], names=names
            )
            # words that are not common are looked up by a join, once for each document
            rare, uses = np.unique(t.doc[~hit].astype(np.int64) * max(1, len(words)) + which[~hit], return_counts=True)
            yield looked_up(tag[rare // max(1, len(words))], WORD_KIND, words[rare % max(1, len(words))], uses)
            # so are places where a rare context may hold
            seen, which = np.unique(places(t), return_inverse=True)
            may = np.zeros(len(seen), bool)
            for k in range(1, DEPTH + 1):
                may |= marked(held.value, k, seen)
            doc = np.repeat(np.arange(docs), t.lengths)
            of = may[which]
            rare, uses = np.unique(doc[of] * max(1, len(seen)) + which[of], return_counts=True)
            yield looked_up(tag[rare // max(1, len(seen))], PLACE_KIND, seen[rare % max(1, len(seen))], uses)

    return scores


def score(spark: SparkSession, docs: DataFrame, learn=None, common_context: float = COMMON_CONTEXT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row of ``docs``.

    learn: the condition on doc_id for documents that counts are taken from; crc32(doc_id) mod 10 is not 0 by default,
    and never true for a null doc_id, which is not held out either. Null texts are empty: the end is their only token.
    Repeated rows are counted and scored each. If nothing is learnt, the base score is 0 for each token and all bytes
    are alike to the tree.

    Counts are added up by tasks before the shuffle. The driver gets the common contexts and words, both of
    bounded number (COMMON_CONTEXT, COMMON), and a filter of fixed size; rare contexts and words are joined. Words are
    told apart by 64-bit hashes.
    """
    learn = labelled.remainder(10) != 0 if learn is None else learn
    at = shared_dir(spark, "lm-counts")
    counts = docs.where(learn).select("text").mapInArrow(_counts, "kind int, code long, n long")
    others = docs.where(~F.coalesce(learn, F.lit(False))).select("text").mapInArrow(_unseen, "kind int, code long, n long")
    counts.unionByName(others).groupBy("kind", "code").agg(F.sum("n").alias("n")).write.parquet(at)
    counted = spark.read.schema("kind int, code long, n long").parquet(at)
    words = counted.where(F.col("kind") == WORD_KIND).select("code", "n")
    size = {r["kind"]: (r["all"] or 0, r["different"]) for r in counted.groupBy("kind").agg(F.sum("n").alias("all"), F.count("*").alias("different")).collect()}
    (n_all, n_different), (n_places, _) = size.get(WORD_KIND, (0, 0)), size.get(PLACE_KIND, (0, 0))
    below = n_all + BASE_SMOOTHING * (n_different + 1)
    codes, contexts_at, rare_at = counted.where(F.col("kind") == PLACE_KIND).select("code", "n"), shared_dir(spark, "lm-contexts"), shared_dir(spark, "lm-rare-places")
    contexts(codes.where("n > 0"), n_places).write.parquet(contexts_at)
    kept = spark.read.schema("length int, context long, symbol long, n long, all long").parquet(contexts_at)
    to_all = (F.col("length") == 0) | (F.col("all") >= common_context * n_places)
    rare_contexts, kept = kept.where(~to_all), kept.where(to_all).select("length", "context", "symbol", "n").toArrow()
    model = tree(tuple(kept[c].to_numpy().astype(np.int64) for c in ("length", "context", "symbol", "n")))
    common = words.where(F.col("n") >= COMMON * n_all).toArrow()
    order = np.argsort(common["code"].to_numpy())
    table = (common["code"].to_numpy().astype(np.int64)[order], np.log10((common["n"].to_numpy().astype(float)[order] + BASE_SMOOTHING) / below))
    del kept, common, order
    floor = float(np.log10(BASE_SMOOTHING / below))
    send = spark.sparkContext.broadcast
    model, held = send(model), send(context_filter(rare_contexts))
    rare_places(codes, rare_contexts, model, held).write.parquet(rare_at)
    tagged = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tag"))
    parts = tagged.mapInArrow(_scores(model, send(table), held, floor), "tag long, doc_id long, kind int, code long, uses int, n_tokens long, n_known long, base double, score double")
    # a document's own row goes by its tag, so that the join deals these out too
    parts = parts.withColumn("key", F.coalesce("code", F.xxhash64("tag")))
    rare = words.where(F.col("n") < COMMON * n_all).select(F.lit(WORD_KIND).alias("known_kind"), F.col("code").alias("known_code"), F.col("n").alias("c"), F.lit(None).cast("double").alias("moved"))
    moved = spark.read.schema("code long, moved double").parquet(rare_at)
    rare = rare.unionByName(moved.select(F.lit(PLACE_KIND).alias("known_kind"), F.col("code").alias("known_code"), F.lit(None).cast("long").alias("c"), "moved"))
    looked = parts.join(rare, (F.col("key") == F.col("known_code")) & (F.col("kind") == F.col("known_kind")), "left")
    each = F.log10((F.coalesce("c", F.lit(0)) + F.lit(BASE_SMOOTHING)) / F.lit(float(below)))
    whole = looked.groupBy("tag").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("uses").cast("long")), F.lit(0).cast("long"))).alias("n_known"),
        F.sum(F.coalesce("base", F.when(F.col("kind") == WORD_KIND, F.col("uses") * each), F.lit(0.0))).alias("base_score"),
        F.sum(F.coalesce("score", F.col("uses") * F.col("moved"), F.lit(0.0))).alias("score"),
    )
    held_out = F.coalesce(labelled.remainder(10) == 0, F.lit(False))
    return whole.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
