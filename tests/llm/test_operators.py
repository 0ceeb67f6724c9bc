"""Each operator beside a plain version of itself, and at the edges: nulls, empty and long texts, ties, repeats, no rows."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from barograph.llm import bpe, labelled, mixing, near_copies, quality_crf, rules, simhash, suffix_tree, topk, toxicity, urls, warc
from barograph.llm.components import smallest_reachable

SCHEMA = "doc_id long, text string, source string, __order2 string"
WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "") for b in ("ra", "ti", "so", "ne", "pu", "ga", "lin")]


def prose(rng, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def edge_documents():
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [None, "", " \t\n ", "one", "one two three", base, base, base.replace("ba", "be", 1), base.upper(), "x" * 50_000, prose(rng, 30_000), "é ñ " * 60, "\x00\x1c\x1f a\x0bb", "a b c a b c a b c\na b c\n\na b c"]
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    rows = [(i, t, [None, "b", "a", "a"][i % 4], "kept") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id", "a", "kept"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


def test_mixing_fills_targets_and_keeps_rows(spark, docs):
    rows = mixing.mix_sizes(spark, docs).collect()
    assert len(rows) == len(edge_documents())
    size = {s: sum(len(words_of(t)) for _, t, x, _ in edge_documents() if x == s) for s in (None, "a", "b")}
    by_target = {}
    for r in rows:
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
    assert sorted(s for s, _ in by_target) == sorted(size.values())
    assert all(sum(taken) == math.floor(target) for (_, target), taken in by_target.items())
    assert math.isclose(sum(t for _, t in by_target), 1.5 * sum(size.values()))
    again = mixing.mix_sizes(spark, docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"], r["position"] or -1)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixing_of_nothing_and_of_whole_documents(spark, docs, nothing):
    assert mixing.mix_sizes(spark, nothing).count() == 0
    mixed = mixing.mix_documents(spark, docs)
    assert mixed.columns == docs.columns
    read = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert max(read.values()) <= 4 and all(words_of(t) for _, t in read)


@pytest.mark.parametrize("knots", [*mixing.CURRICULUM, ((0.0, 0.0), (0.25, 3.0), (0.5, 3.0), (1.0, 0.5))])
def test_schedule_inverse(spark, knots):
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", mixing.moment(F.col("x"), knots).alias("t")).collect()
    for r in got:
        grid = np.linspace(0, r["t"], 20001)
        w = np.interp(grid, *zip(*knots, strict=True))
        assert abs(np.sum((w[1:] + w[:-1]) / 2 * np.diff(grid)) - r["x"] * mixing.area(knots)) < 1e-6


def plain_verdict(url, rule_rows, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rule_rows if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits and host else None
    return host, path, best and best[2], best[3] if best else otherwise


def test_url_filters(spark):
    rule_rows = [*urls.RULES, ("example.com", "/en/a", "allow"), ("example.com", "/en/ab", "block"), ("a.b.c", "", "block"), ("c", "/x/", "block")]
    given = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/", "https://www.example.com/en/1?x#y", "http://a.example.com/en/abc", "http://m.example.com/en/aa/", "x://notexample.com/en/", "http://com", "http://com/", "http://a.b.c?q", "http://z.a.b.c", "http://q.net/es/1\n2", "http://" + "a." * 3000 + "c/x/y", "ftp://x.com://y/z"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given * 2)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, urls.rule_table(spark, rule_rows)).collect()}
    assert got == {i: plain_verdict(u, rule_rows) for i, u in enumerate(given * 2)}
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, urls.rule_table(spark).limit(0), "block").collect()} == {"block"}


def plain_fingerprint(text):
    w = words_of(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_duplicates(spark, docs, nothing):
    rows = simhash.near_duplicates(spark, docs).collect()
    given = edge_documents()
    prints = [plain_fingerprint(t) for _, t, _, _ in given]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((d[0], f"{p:016x}") for d, p in zip(given, prints, strict=True))
    of = list(range(len(given)))
    for _ in given:
        of = [min(of[j] for j in range(len(given)) if bin(prints[i] ^ prints[j]).count("1") <= 4) for i in range(len(given))]
    smallest = {c: min((d[0] for d, x in zip(given, of, strict=True) if x == c and d[0] is not None), default=None) for c in of}
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == Counter((d[0], smallest[c]) for d, c in zip(given, of, strict=True))
    kept = simhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(set(of))
    assert simhash.near_duplicates(spark, nothing).count() == 0


def test_near_copies_are_candidates_by_simhash_too(spark):
    """With min-hashes that never meet, what is left is fingerprints at 4 bits or fewer, each link verified."""
    rng = random.Random(5)
    base = [[rng.choice(WORDS) for _ in range(800)] for _ in range(4)]
    texts = [" ".join(w[:k] + ["new"] + w[k + 1 :]) for w in base for k in (3, 300, 790)] + ["", "one two"]
    data = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    h, edges = near_copies.shingles(np.frombuffer(b"".join(data), np.uint8), starts)
    prints = near_copies.fingerprints(h, edges, 100).tolist()
    for a, b, p in zip(edges, edges[1:], prints, strict=False):
        assert p == sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in h[a:b]) > b - a)
    close = {(i, j) for i in range(14) for j in range(i) if edges[i + 1] > edges[i] and edges[j + 1] > edges[j] and (prints[i] ^ prints[j]).bit_count() <= 4}
    assert len(close) >= 4
    rows = [(i, list(range(20 * i, 20 * i + 20)) if edges[i + 1] > edges[i] else [], p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "key long, bands array<long>, print long, first long")
    of, want = list(range(14)), list(range(14))
    found = {(r["a"], r["b"]) for r in near_copies.close_prints(nodes).collect()}
    for _ in texts:
        of = [min([of[i], *(of[a + b - i] for a, b in found if i in (a, b))]) for i in range(14)]
        want = [min([want[i], *(want[a + b - i] for a, b in close if i in (a, b))]) for i in range(14)]
    assert of == want
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, __key long")
    documents = docs.select("doc_id", F.struct("doc_id", "text").alias("__row"), "__key")
    got = {tuple(sorted(r)) for r in near_copies.links(spark, documents, nodes).collect()}
    assert got == {tuple(sorted(x)) for x in found if x[0] // 3 == x[1] // 3}


@pytest.mark.parametrize("part", [4, 1024])
def test_the_pipeline_keeps_one_of_each_group_of_near_copies(spark, nothing, part):
    """Beside all pairs' exact similarity; most planted copies differ in more bits than the contract of op3 allows."""
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for n in (60, 150, 400):
        for _ in range(4):
            words = [rng.choice(WORDS) for _ in range(n)]
            texts.append(" ".join(words))
            for changes in (1, 1, 2, 3, 5, 12):
                copy = list(words)
                for at in rng.sample(range(n), changes):
                    copy[at] = f"new{rng.random()}"
                texts.append(" ".join(copy))
    order = rng.sample(range(len(texts)), len(texts))
    given = [(d, texts[i]) for d, i in enumerate(order)] + [(0, texts[order[0]]), (None, "no id")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for _, t in given]
    near = [[j for j, b in enumerate(sets) if (5 * len(a & b) >= 4 * len(a | b))] for a in sets]
    of = list(range(len(given)))
    for _ in given:
        of = [min(of[j] for j in js) for js in near]
    want = Counter(min((d for (d, _), x in zip(given, of, strict=True) if x == c and d is not None), default=None) for c in set(of))
    prints = [plain_fingerprint(t) for _, t in given]
    assert any(bin(prints[i] ^ prints[j]).count("1") > 4 for i, js in enumerate(near) for j in js)
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    assert Counter(r["doc_id"] for r in near_copies.one_of_each(spark, docs, part).collect()) == want
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    assert near_copies.one_of_each(spark, nothing).count() == 0


@pytest.mark.parametrize("part", [16, 4096])
def test_links_connect_all_that_is_close(spark, part):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), part=part)
    found = {(r["a"], r["b"]) for r in links.collect()}
    mask = (1 << 64) - 1
    assert all(bin((a ^ b) & mask).count("1") <= 4 for a, b in found)

    def components(pairs):
        root = {p: p for p in signed}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        return {p: top(p) for p in signed}

    assert components(found) == components((a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & mask).count("1") <= 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (7, 3), (3, 7)]
    got = {r["node"]: r["root"] for r in smallest_reachable(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{x: 100 for x in range(101, 140)}}


def test_tokens_are_those_of_the_library(spark, docs, nothing):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    given = edge_documents()
    encoded = bpe.encode(docs, ["doc_id", "text"])
    assert all(r["tokens"] == coder.encode_ordinary(r["text"] or "") for r in encoded.collect())
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in bpe.decode(encoded, ["text"]).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter((d, len(ids := coder.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t, _, _ in given)
    clashing = docs.withColumn("n_tokens", F.lit("own")).withColumn("ids_sha256", F.lit(1)).withColumn("decoded", F.lit("own")).withColumn("__row", F.lit(7))
    result = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = bpe.round_trip(clashing, ["doc_id", "n_tokens", "ids_sha256", "decoded", "__row"])
    assert got.columns == ["doc_id", "decoded", "__row", "tokens", *result[1:]] and got.select("decoded", "__row").distinct().collect() == [("own", 7)]
    assert Counter(tuple(r) for r in got.select(*result).collect()) == want
    assert all(r["tokens"] == coder.encode_ordinary(r["text"] or "") for r in bpe.round_trip(docs, ["text"]).collect())
    assert Counter(tuple(r) for r in bpe.round_trip(docs, ["doc_id"]).select(*result).collect()) == want
    assert bpe.round_trip(nothing, ["doc_id"]).count() == 0


def test_odd_characters_are_parted_as_in_the_library():
    rng = random.Random(2)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    odd = [chr(c) for c in [*range(0x180), 0x2028, 0x3000, 0x1680, 0x200B, 0xFEFF, 0x4E2D, 0x1F600, 0x300, 0x660, 0x2163]]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 60))) for _ in range(2000)] + ["ab" * 3000, "中文" * 500, " " * 300 + "x"]
    ids, ends = bpe.Codec(bpe.read_ranks()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [coder.encode_ordinary(t) for t in texts]


def test_quality_rules(spark, docs, nothing):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.quality_rules(docs).collect())
    want = Counter()
    for d, t, _, _ in edge_documents():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[d, len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    assert rules.quality_rules(nothing).count() == 0


def test_failing_lines_go_and_documents_that_lose_too_much(spark):
    rng = random.Random(3)
    body = "\n".join(prose(rng, 40) for _ in range(3))
    menu, shout, junk = "Home | News | About | Shop | Help | Jobs | Blog", "BUY!! NOW!! ALL!! OF!! IT!!", "a### b%%% c&&& d$$$ " * 20
    rows = [(0, body), (1, f"{menu}\n{body}\nAll rights reserved."), (2, f"{body}\n{(junk + chr(10)) * 9}"), (3, f"{shout}\n\n{body}")]
    got = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(4)] == [True, True, False, True]
    assert got[0]["cleaned_text"] == body and got[1]["cleaned_text"] == body and got[3]["cleaned_text"] == f"\n{body}"


def test_scores_of_the_suffix_tree(spark, docs, nothing):
    given = edge_documents()
    learn = [d is not None and zlib.crc32(str(d).encode()) % 10 != 0 for d, *_ in given]
    counts = Counter(w for (_, t, *_), x in zip(given, learn, strict=True) if x for w in [*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    got = suffix_tree.score(spark, docs).collect()
    assert len(got) == len(given) and {r["train_tokens"] for r in got} == {n}
    key = lambda d, k, known, base: (d is None, d, k, known, round(base, 6))
    want = Counter(key(d, len(w := [*words_of(t), None]), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, t, *_ in given)
    assert Counter(key(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got) == want
    assert all(r["score"] < 0 for r in got) and suffix_tree.score(spark, nothing).count() == 0
    assert {r["base_score"] for r in suffix_tree.score(spark, docs, F.lit(False)).where("n_tokens = 1").collect()} == {0.0}


def plain_tree_scores(given, learn):
    """The suffix tree of all contexts seen twice or more that pass the divergence test, place by place."""
    symbols = lambda t: [10] * 5 + list(b" ".join(words_of(t)) + b"\n")
    code = lambda s, i, k: bytes(s[i - k : i])
    counts = {}
    for (_, t, *_), x in zip(given, learn, strict=True):
        s = symbols(t)
        for i in range(5, len(s)) if x else ():
            for k in range(6):
                counts.setdefault(code(s, i, k), Counter())[s[i]] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}
    saved = lambda c: sum(n * math.log(n / total[c] / (counts[c[1:]][x] / total[c[1:]])) for x, n in counts[c].items())
    kept = {c for c in counts if c and total[c] >= 2 and saved(c) >= math.log(total[b""])}

    def rate(c, x):
        if not c:
            return (counts[b""][x] + 0.5) / (total[b""] + 0.5 * 256)
        return (counts[c][x] + 10 * rate(c[1:], x)) / (total[c] + 10) if c in kept else rate(c[1:], x)

    return [sum(math.log10(rate(code(s, i, 5), s[i])) for i in range(5, len(s))) for s in (symbols(t) for _, t, *_ in given)], {c: total[c] for c in kept}


@pytest.mark.parametrize("share", [suffix_tree.COMMON_CONTEXT, 2e-3, 2.0])
def test_rare_contexts_count_wherever_they_are_looked_up(spark, share):
    rng = random.Random(8)
    given = [(i, prose(rng, 200) + (f" zyxwv{'qj'[i % 2]}kpt" * (1 + i % 3) if i % 4 == 0 else "")) for i in range(60)]
    learn = [zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in given]
    want, kept = plain_tree_scores(given, learn)
    # some contexts are too rare for the tree of the tasks, or all are
    assert share < 1e-3 or min(kept.values()) < share * sum(len(t) for _, t in given)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(spark, spark.createDataFrame(given, "doc_id long, text string"), common_context=share).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(math.isclose(got[d], x, rel_tol=1e-5) for (d, _), x in zip(given, want, strict=True))


def test_a_context_is_kept_by_its_support_whatever_else_there_is(spark):
    code = lambda before, x: int.from_bytes(before * 5 + x, "big")
    for others in (10_000, 10_000_000):
        counted = spark.createDataFrame([(code(b"b", b"a"), others), (code(b"q", b"z"), 20)], "code long, n long")
        assert (1, ord("q")) in {(r["length"], r["context"]) for r in suffix_tree.contexts(counted, others + 20).collect()}


def test_walk_takes_the_longest_suffix_state():
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(WORDS, 3000)).encode()
    data, starts = np.frombuffer(text, np.uint8), np.array([0, 5000, 5000, len(text)])
    t = suffix_tree.tokens(data, starts)
    codes, n = np.unique(suffix_tree.places(t), return_counts=True)
    assert n.sum() == t.lengths.sum()
    rows = Counter()
    for c, x in zip(codes.tolist(), n.tolist(), strict=True):
        for k in (0, 1, 2, 4):
            rows[k, (c >> 8) & ((1 << 8 * k) - 1), c & 255] += x
    rows = {r: x for r, x in rows.items() if r[0] < 4 or r[1] % 3 == 0}
    model = suffix_tree.tree(tuple(np.array(x) for x in zip(*[(*r, x) for r, x in rows.items()], strict=True)))
    assert np.allclose((10.0 ** model.log10.reshape(-1, model.columns)[:, :-1]).sum(axis=1) + 10.0 ** model.log10.reshape(-1, model.columns)[:, -1] * (257 - model.columns), 1, atol=1e-4)
    walked = model.walk(t)
    kept = {}
    for (k, c, x), m in rows.items():
        kept.setdefault((k, c), {})[x] = m

    def rate(k, c, x):
        if k == 0:
            return (kept[0, 0].get(x, 0) + 0.5) / (sum(kept[0, 0].values()) + 0.5 * 256)
        own = kept.get((k, c), {})
        return (own.get(x, 0) + 10 * rate(k - 1, c & ((1 << 8 * (k - 1)) - 1), x)) / (sum(own.values()) + 10)

    for d in range(3):
        total, seq = 0.0, t.symbols[t.begins[d] - 5 : t.begins[d] + t.lengths[d]].tolist()
        for i in range(5, len(seq)):
            context = lambda k, i=i: sum(seq[i - 1 - j] << (8 * j) for j in range(k))
            total += math.log10(rate(4, context(4), seq[i]))
        assert math.isclose(walked[d], total, rel_tol=1e-4)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=20)]) for i in range(160)]
    vectors[7] = (7, vectors[3][1])
    rows = [*vectors, (160, None), (161, [1.0, None]), (162, [float("nan")] * 20), (163, [float("inf")] * 20), (None, vectors[0][1]), (164, []), (150, [1.0, 2.0]), vectors[9]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(table).collect())
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    want = []
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(table.limit(0)).count() == 0


def test_branch_and_bound_keeps_ties():
    ids = np.arange(500)[::-1].copy()
    block = topk.Block(ids, np.ones((500, 24)))
    at, scores = topk.search(np.ones(24), block, 4)
    assert ids[at].tolist() == [0, 1, 2, 3] and set(scores) == {24}
    # a floor that is just reached keeps what reaches it
    at, scores = topk.search(np.ones(24), block, 4, 24.0)
    assert ids[at].tolist() == [0, 1, 2, 3]


def test_best_over_fifty_blocks():
    rng = np.random.default_rng(8)
    rows = np.floor(rng.normal(size=(2500, 21)) * 256)
    rows[2000:] = rows[:500]
    ids = rng.permutation(2500)
    blocks = [topk.Block(ids[i : i + 50], rows[i : i + 50]) for i in range(0, 2500, 50)]
    for q in range(40):
        want = sorted(((int(s), int(i)) for s, i in zip(rows @ rows[q], ids, strict=True) if i != ids[q]), key=lambda x: (-x[0], x[1]))[:5]
        assert topk.best_of(int(ids[q]), rows[q], blocks, 5) == want


def test_scores_beyond_doubles_are_exact():
    big = float(2**40)
    rows = np.array([[big, 1.0], [big, 3.0], [-big, 5.0], [2.0, 7.0]])
    blocks = [topk.Block(np.arange(4), rows)]
    assert topk.best_of(9, np.array([2.0**20 + 1, 1.0]), blocks, 3) == [(2**60 + 2**40 + 3, 1), (2**60 + 2**40 + 1, 0), (2**21 + 9, 3)]


def test_queries_of_an_id_with_several_vectors(spark):
    """The query's own id is no candidate under any of its vectors."""
    rows = [(50, [1.0, 0.0]), (50, [0.5, 0.0]), (50, [0.25, 0.0]), (1, [0.1, 0.0]), (2, [0.2, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2)
    assert {r["vec_id"] for r in got.collect()} <= {1, 2} and got.count() == 2


def test_candidates_meet_queries_without_a_join(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(120)], "vec_id long, embedding array<double>")
    text = topk.top_k(table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "hashpartitioning(dims" not in text and "MapInArrow" in text


def test_archives(spark):
    long, short = "<p>é</p>" * 30, "short"
    rows = [(3, "http://a/ b\r\n", long, 1), (1, None, long, 1), (2, "u", short, 1), (4, "u", short, 1), (5, "u", None, 1), (6, "u", "", 1), (7, "u", "x" * 300_000, 1), (None, "u", long, 1), (1, None, long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(2)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc.round_trip(spark, pages).collect())
    want = Counter()
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        again = html == long and i != 1
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None, None if again else raw] += 1
    assert got == want and warc.round_trip(spark, pages.limit(0)).count() == 0


def test_damaged_archives_are_errors():
    payload = b"abc" * 50
    whole = warc.record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)
    assert [r.http[1] for r in warc.records(io.BytesIO(whole * 3))] == [payload] * 3
    for bad in (whole[:-5], warc.record(1, "u", payload, "0" * 64, None), warc.member({"A": "b"}, b"x")[:-20]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad)))


def labelled_documents(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        text = "\n".join(prose(rng, 25) for _ in range(4))
        toxic, bad = i % 4 == 1, i % 5 == 2
        if toxic:
            text = text.replace(" ", " vexguk ", 3)
        if bad:
            text = "\n".join("zap### " * 12 for _ in range(4))
        rows.append((i, text))
        marks.append((i, int(not bad), int(toxic and not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("op", "mark"), [(toxicity.toxicity, "toxic"), (quality_crf.quality, "quality")])
def test_classifiers(spark, docs, nothing, op, mark):
    texts, labels = labelled_documents(spark)
    truth = {r["doc_id"]: r[mark] for r in labels.where("doc_id is not null").where(f"{mark} is not null").collect()}
    got = op(spark, texts, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) and held
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    odd = op(spark, docs, labels).collect()
    assert len(odd) == len(edge_documents()) and len({r["score"] for r in odd if r["doc_id"] in (0, 1)}) == 1
    assert op(spark, nothing, labels).count() == 0 and op(spark, docs, labels.limit(0)).count() == len(edge_documents())
    by = 4 if mark == "toxic" else 5
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % by == (2 if by == 4 else 0)) for r in odd)


def plain_grams(text) -> set[int]:
    """The hashed n-grams of a text, one by one."""
    small = [c.lower() if len(c.lower()) == 1 and ord(c.lower()) < 1 << 16 else c for c in text or ""]
    chars = [32, *(32 if c.isspace() else ord(c) for c in small), 32]
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(chars) - n + 1):
            h = n
            for c in chars[i : i + n]:
                h = ((h * 0x01000193 & 0xFFFFFFFF) ^ c) * 0x85EBCA6B & 0xFFFFFFFF
            out.add(((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - toxicity.BITS)
    return out


@pytest.mark.parametrize("features", [40, 100_000])
def test_toxicity_beside_a_plain_version(spark, features):
    """Ratios, the features kept, the optimum of the regression and the scores, from sets of n-grams."""
    texts, labels = labelled_documents(spark)
    sampled = labelled.sample(spark, texts, labels, "toxic", F.lit(True), 60)
    model = toxicity.fit(sampled, features)
    rows = [(plain_grams(r["text"]), r["label"]) for r in sampled.collect()]
    toxic = sum(y for _, y in rows)
    counts = {y: Counter(g for x, z in rows if z == y for g in x) for y in (0, 1)}
    ratio = {g: math.log((counts[1][g] + 1) / (toxic + 2) / ((counts[0][g] + 1) / (len(rows) - toxic + 2))) for g in {*counts[0], *counts[1]} if counts[0][g] + counts[1][g] >= toxicity.LEAST_DOCUMENTS}
    worth = lambda g: (-round(abs(ratio[g]) / math.sqrt(1 / (counts[1][g] + 1) + 1 / (counts[0][g] + 1)), 9), g)
    kept = sorted(sorted(ratio, key=worth)[:features])
    assert model.feature.tolist() == kept and len(kept) == min(features, len(ratio))
    weight = dict(zip(kept, model.weight, strict=True))
    odds = np.array([model.bias + sum(weight.get(g, 0.0) for g in x) for x, _ in rows])
    y = np.array([y for _, y in rows])
    # at the optimum no weight can be moved to lessen the loss, up to the rounds that are made
    weigh = np.where(y == 1, 0.5 / toxic, 0.5 / (len(y) - toxic))
    slope = weigh * (1 / (1 + np.exp(-odds)) - y)
    start = weigh * (0.5 - y)
    of = lambda s: np.array([ratio[g] * sum(v for v, (x, _) in zip(s, rows, strict=True) if g in x) for g in kept])
    left = of(slope) + toxicity.PENALTY * np.array([model.weight[i] / ratio[g] if ratio[g] else 0.0 for i, g in enumerate(kept)])
    assert np.abs(left).max() < 0.05 * np.abs(of(start)).max() and abs(slope.sum()) < 0.02
    more = [*[t for _, t in [(0, None), (1, ""), (2, "VEXGUK \U0001F600 x")]], *[r["text"] for r in texts.limit(20).collect()]]
    given = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(given, model, ["doc_id"]).collect()}
    for i, t in enumerate(more):
        if "\U0001F600" not in (t or ""):
            assert math.isclose(got[i], 1 / (1 + math.exp(-model.bias - sum(weight.get(g, 0.0) for g in plain_grams(t)))), rel_tol=1e-9)


def test_chain_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(8)
    e, ties = rng.normal(size=6), np.array([0.5, -0.3, 0.2, 1.1])
    doc = np.array([0, 0, 0, 0, 1, 1])
    forward, backward = quality_crf.Chain(doc).run(e, ties)
    for d in (0, 1):
        at = np.flatnonzero(doc == d)
        weight = np.zeros((len(at), 2))
        for code in range(2 ** len(at)):
            y = [code >> i & 1 for i in range(len(at))]
            w = math.exp(sum(e[a] for a, v in zip(at, y, strict=True) if v) + sum(ties[2 * a + b] for a, b in zip(y, y[1:], strict=False)))
            for i, v in enumerate(y):
                weight[i, v] += w
        assert np.allclose((forward + backward)[at], np.log(weight[:, 1] / weight[:, 0]))


def test_sample_is_bounded_and_admits_only_what_may_be_learnt(spark):
    texts, labels = labelled_documents(spark)
    got = labelled.sample(spark, texts, labels, "toxic", labelled.remainder(4) != 2, 10)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: 10, 1: 10}
