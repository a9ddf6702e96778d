"""Scores of the learned queries, digests and pipeline stages, each against a plain loop over the same model."""

import base64
import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tissuegrid.llm import fingerprints, language, mixing, quality, toxicity
from tissuegrid.llm.queries import QUERIES, fold, vocabulary

PATH = "/root/testdata/sf0.001"
DOC = {"id_col": "doc_id", "text_col": "text"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{PATH}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}


# ---- quality ----


def plain_features(text):
    n = len(text)
    if not n:
        return [0.0] * 20
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    has = lambda test: sum(1 for b in text if test(b))
    upper, lower, wide = has(lambda b: 65 <= b <= 90), has(lambda b: 97 <= b <= 122), has(lambda b: b >= 128)
    symbol = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    share = [c / n for c in Counter(text).values()]
    out = [math.log1p(n), math.log1p(len(words)), has(lambda b: b not in b"\t\n\x0b\x0c\r ") / nw, upper / max(1, upper + lower), has(lambda b: 48 <= b <= 57) / n]
    out += [has(symbol) / n, has(lambda b: symbol(b) and b not in b".,;:'\"-()?!") / n, wide / n, text.count(b"|") / nw, text.count(b"!") / nw]
    out += [len(set(words)) / nw, sum(a == b for a, b in zip(words, words[1:], strict=False)) / nw]
    out += [len(re.findall(rb"[^\w\s.,;:'\")?!\x80-\xff](?=\s|$)", text)) / nw, sum(w.isupper() for w in words) / nw]
    out += [math.log1p(n / nl), len(set(lines)) / nl, -sum(p * math.log2(p) for p in share), text.count(b".") / nw]
    return [*out, math.log1p(max((len(w) for w in words), default=0)), (upper + lower + wide) / n]


def test_quality_scores_are_sums_of_looked_up_bins(spark, docs, texts):
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    model = quality.fit_quality(docs, labels, usable=fold(4) != 2, **DOC)
    got = {r["doc_id"]: r for r in QUERIES["op5_quality"](spark, PATH).collect()}
    for i, text in texts.items():
        bins = [sum(e <= x for e in edges) for x, edges in zip(plain_features(text), model.edges, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bins[a] * 8 // 32][bins[b] * 8 // 32]
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


# ---- toxicity ----


def test_toxicity_scores_measure_every_window(spark, docs, texts):
    import zstandard as z

    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, usable=fold(5) != 0, **DOC)
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, PATH).collect()}
    form = z.ZstdCompressionParameters.from_level(
        19, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, window_log=15
    )
    size = lambda d, w: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), compression_params=form).compress(w))
    known = {}

    def odds(word):
        if word not in known:
            two, four = (((" " + word) * k + " ").encode() for k in (2, 4))
            known[word] = model.odds.get((len(two), size(model.ordinary, two), size(model.toxic, two), size(model.ordinary, four), size(model.toxic, four)), 0.0)
        return known[word]

    for i, text in sorted(texts.items())[:60]:
        score = model.base
        if model.weights:
            worst = heapq.nlargest(3, (odds(w) for w in set(re.findall(r"[^\W\d_]+", text.decode().lower()))))
            worst += [0.0] * (3 - len(worst))
            score = 1 / (1 + math.exp(-model.weights[0] - sum(a * b for a, b in zip(model.weights[1:], worst, strict=True))))
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
    assert {i for i in got} == set(texts)


# ---- language ----


def plain_bundle(text, letters):
    kinds = []
    for c in text.decode().lower():
        kinds.append((1 + ord(c) - 97 if "a" <= c <= "z" else 27 + ord(c) % 101) if c.isalpha() else 0)
    slots = [0]
    for k in [*kinds, 0]:
        if k or slots[-1]:
            slots.append(k)
    if len(slots) < 3:
        return None
    total = np.zeros(1024)
    for (a, b, c), n in Counter(zip(slots, slots[1:], slots[2:], strict=False)).items():
        total += n * (np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]).astype(float)
    return total / np.linalg.norm(total) if total.any() else None


def test_languages_are_nearest_bundles(spark, docs, texts):
    letters = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (128, 1024))
    bundles = {i: plain_bundle(t, letters) for i, t in texts.items()}
    profiles = {}
    for r in docs.select("doc_id", "lang", "text").collect():
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 and bundles[r["doc_id"]] is not None:
            profiles[r["lang"]] = profiles.get(r["lang"], 0) + np.rint(bundles[r["doc_id"]] * 1e6)
    profiles = {k: v / np.linalg.norm(v) for k, v in sorted(profiles.items())}
    for r in QUERIES["op10_language"](spark, PATH).collect():
        v = bundles[r["doc_id"]]
        if v is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosine = {k: float(p @ v) for k, p in profiles.items()}
        best = max(cosine, key=lambda k: cosine[k])
        assert cosine[r["lang_pred"]] == pytest.approx(cosine[best], abs=1e-6)
        share = 1 / sum(math.exp(30 * (c - cosine[best])) for c in cosine.values())
        assert r["score"] == pytest.approx(share, abs=1e-3)


def test_language_slots_are_those_of_the_operator():
    for c in "azéßжñ中 1_":
        slot = (1 + ord(c) - 97 if "a" <= c <= "z" else 27 + ord(c) % 101) if c.isalpha() else 0
        assert language._letters()[ord(c)] == slot


# ---- digest ----


@pytest.mark.parametrize("text", ["", "abc", "abcde", "the quick brown fox " * 9, "é" * 700, "".join(chr(33 + i % 90) for i in range(5000))])
def test_digest_counts_triplets_and_codes_quartiles(text):
    body = text.encode()
    odd = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
    counts = [0] * 256
    for at in range(len(body) - 4):
        for salt, places in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))):
            h = sum(body[at + p] * odd[p] for p in places) + 0x3C6EF372 * (salt + 1) & 0xFFFFFFFF
            h ^= h >> 15
            counts[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(counts)
    code = [sum(c > ranked[q] for q in (63, 127, 191)) for c in counts]
    packed = bytes(64 * a + 16 * b + 4 * c + d for a, b, c, d in zip(*[iter(code)] * 4, strict=True))
    length = min(255, round(8 * math.log2(1 + len(body))))
    assert fingerprints.digest(body) == bytes([length, sum(body) % 256]).hex() + packed.hex()


# ---- pipeline ----


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_stages_equal_plain_ones(spark, docs, tmp_path):
    import tiktoken
    from public_tokenizers import PATTERN

    def stage(k, df):
        corpus_pipeline.STAGES[k][1](spark, df, PATH).write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{PATH}/labels.parquet"), **DOC)
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model, **DOC).collect()}
    clean = stage(0, docs)
    kept = sorted(r for r in rows if not verdict[r[0]])
    assert sorted(tuple(r) for r in clean.select(*corpus_pipeline.COLUMNS).collect()) == kept

    sites, first = {}, {}
    key = lambda line: line.strip(" \t\r\x0b\x0c")
    for i, text, _, source, _ in kept:
        for line in (text or "").split("\n"):
            if key(line):
                sites.setdefault(key(line), set()).add(source)
                first[key(line)] = min(i, first.get(key(line), i))
    spread = {k for k, s in sites.items() if len(s - {None}) >= corpus_pipeline.MIN_SITES}
    cut = {}
    for i, text, *_ in kept:
        cut[i] = None if text is None else "\n".join(x for x in text.split("\n") if key(x) not in spread or first[key(x)] == i)
    stripped = stage(1, clean)
    got = {r["doc_id"]: r for r in stripped.collect()}
    assert {i: r["text"] for i, r in got.items()} == cut
    assert all(r["n_chars"] == len(cut[i]) for i, r in got.items() if cut[i] is not None)

    ids, sets = sorted(cut), {i: shingle_set(t) for i, t in cut.items()}
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    single = stage(2, stripped)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({top(i) for i in ids})

    sized = single.withColumn("_words", mixing.word_count("text"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_cohorts(sized, id_col="doc_id", cohort_col="source", size_col="_words").collect()}
    mixed = stage(3, single)
    taken = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert Counter(taken) == Counter({(i, cut[i]): n for i, n in copies.items() if n})

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = stage(4, mixed).collect()
    wanted = Counter((i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in taken)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in encoded) == wanted and all(r["round_trip"] for r in encoded)
