"""The whole pipeline beside a plain version of it, on documents with planted junk, toxic words and copies."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from barograph.llm import bpe

SYLLABLES = ["ba", "de", "ki", "lo", "mu", "ra", "ti", "so", "ne", "pu", "ga", "lin", "or", "est"]
WEIGHTS = [3, 1, 2]


def line(rng, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)) + "."


def planted():
    """(doc_id, source, lang, text) and labels; which documents are toxic."""
    rng = random.Random(17)
    rows, labels, toxic = [], [], set()
    for i in range(160):
        lines = [line(rng, rng.randint(20, 45)) for _ in range(rng.randint(3, 6))]
        if i % 4 == 1:
            toxic.add(i)
            lines = [" ".join("vexguk" if rng.random() < 0.2 else w for w in x.split()) for x in lines]
        if i % 9 == 2:
            lines.insert(1, "Home | News | About | Shop | Help | Jobs | Blog")
        if i % 9 == 5:
            lines.append("All rights reserved.")
        if i % 13 == 6:
            lines += ["a### b%%% c&&& d$$$ " * 20] * 9
        if i % 17 == 3:
            lines = lines[:1]
        rows.append([i, [None, "web", "web", "books", "code"][i % 5], "en", "\n".join(lines)])
        labels.append((i, 1, int(i in toxic)))
    for i, base in enumerate(rng.sample(range(160), 40)):
        words = rows[base][3].split(" ")
        for at in rng.sample(range(len(words)), i % 3):
            words[at] = f"new{at}"
        rows.append([160 + i, rng.choice(["web", "books"]), "en", " ".join(words)])
        if base in toxic:
            toxic.add(160 + i)
    for text in (None, "", " \n "):
        rows.append([len(rows), "web", None, text])
    return rows, labels, toxic


def fails(x: str) -> bool:
    words, n = re.findall(r"[^\x20\x09-\x0D]+", x), len(x)
    bars = len(re.findall(r" [|>](?= )", x))
    return (
        sum(w.endswith("!!") for w in words) > 0.3 * len(words)
        or sum(c in "#*$%&|<>" for c in x) > 0.04 * n
        or (bars >= 3 and 100 * bars >= 20 * len(words))
        or (n <= 200 and "rights reserved" in x.lower())
        or (not re.search(r"[.,;:!?]", x) and len(words) > 20)
    )


def cleaned(text):
    """The text without failing lines; None for a document that goes."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    lost = sum(len(x) for x in lines if x.strip() and fails(x))
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w) or lost > 0.5 * sum(map(len, lines)):
        return None
    return "\n".join(x for x in lines if not (x.strip() and fails(x)))


def one_of_each(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r[3].lower().split() for r in rows)]
    of = list(range(len(rows)))
    near = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    for _ in rows:
        of = [min(of[j] for j in js) for js in near]
    lead = {c: min(r[0] for r, x in zip(rows, of, strict=True) if x == c) for c in of}
    return [r for r, c in zip(rows, of, strict=True) if r[0] == lead[c]]


def passes(rows):
    """doc_id of each reading of the mix."""
    size = {r[0]: len(r[3].split()) for r in rows}
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size[r[0]] for r in rows if r[1] == s) for s in sources}
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(held.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * held[s] <= level * weight[s]}
        for s in full or open_:
            target[s] = 2 * held[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    out = []
    for s in sources:
        goal, at = math.floor(target[s]), 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n, whole = size[r[0]], goal // held[s]
            taken = n * whole + max(0, min(n, goal - whole * held[s] - at))
            at += n
            out += [r[0]] * ((taken > 0 and 2 * min(taken, n) >= n) + (2 * taken >= 3 * n))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels, toxic = planted()
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = [(*r, len(r[3] or "")) for r in rows]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, toxic


def test_run_equals_the_plain_version(spark, corpus):
    at, rows, toxic = corpus
    good = [[d, s, g, c] for d, s, g, t in rows if (c := cleaned(t)) is not None]
    clean = [r for r in good if r[0] not in toxic]
    single = one_of_each(clean)
    assert len(rows) > len(good) > len(clean) > len(single)
    text = {r[0]: r[3] for r in single}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter()
    for d in passes(single):
        ids = coder.encode_ordinary(text[d])
        want[d, len(text[d]), tuple(ids), len(ids), sha(",".join(map(str, ids)).encode()), sha(text[d].encode())] += 1
    got = corpus_pipeline.run(spark, at)
    assert got.columns == ["doc_id", "source", "lang", "n_chars", "tokens", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = Counter((r["doc_id"], r["n_chars"], tuple(r["tokens"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect())
    assert {k[0]: n for k, n in found.items()} == {k[0]: n for k, n in want.items()}
    assert found == want


def test_an_empty_corpus_stays_empty(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
