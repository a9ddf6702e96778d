"""Operators on event texts against brute force, with the awkward rows every one must stand."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tissuegrid.llm import fingerprints, language, lines, quality, simhash, suffixes, tokens, toxicity
from tissuegrid.llm.queries import vocabulary

SCHEMA = "event_id long, event string, site string, lang string, _id long, _body string, _text string, score double, _row int"


def events(spark, rows):
    full = [(*r, *[None] * (4 - len(r)), 1, "x", "y", 0.5, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    """Null id, null text, empty and blank texts, a very long one, ties and repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return events(
        spark,
        [
            (None, "no id", "a", "en"),
            (1, None, "a", "en"),
            (2, "", None, None),
            (3, " \n\t ", "a", "en"),
            (4, long, "b", "en"),
            (5, "same text of a few words here", "c", "de"),
            (5, "same text of a few words here", "c", "de"),
            (6, "same text of a few words here", "d", "de"),
            (7, "x", "e", "fr"),
        ],
    )


def words(rng, n, vocab=60):
    return " ".join(f"t{rng.randrange(vocab)}" for _ in range(n))


# ---- SimHash ----


def plain_simhash(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, near):
    least = {i: i for i, _ in items}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, (i, x) in enumerate(items):
        for j, y in items[n + 1 :]:
            if near(x, y):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: root(i) for i, _ in items}


def test_simhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(0, 80))) for i in range(150)]
    for i in range(150, 300):  # near and exact copies
        base = rows[rng.randrange(150)][1].split(" ")
        if base and i % 3:
            base[rng.randrange(len(base))] = f"N{i}"
        rows.append((i, " ".join(base)))
    rows += [(300, None), (301, ""), (302, "É é ZÀ x y")]
    found = {r["event_id"]: r for r in simhash.near_groups(events(spark, rows)).collect()}
    codes = [(i, plain_simhash(t)) for i, t in rows]
    expected = components(codes, lambda x, y: (x ^ y).bit_count() <= 4)
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == dict(codes)
    assert {i: r["component_id"] for i, r in found.items()} == expected


def test_simhash_tiles_of_many_blocks_lose_no_link(spark):
    # fingerprints that all share four segments: one key with more rows than a tile holds
    rng = np.random.default_rng(5)
    low = rng.choice(1 << 21, 6000, replace=False).astype(np.int64)
    fps = spark.createDataFrame([(int(x),) for x in low], "_fp long")
    links = simhash.near_links(fps).collect()
    parent = {int(x): int(x) for x in low}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in links:
        assert (r["a"] ^ r["b"]).bit_count() <= 4
        parent[root(r["a"])] = root(r["b"])
    for at in range(0, 6000, 200):
        for i, j in zip(*np.nonzero(np.bitwise_count(low[at : at + 200, None] ^ low[None, :]) <= 4)):
            assert root(int(low[at + i])) == root(int(low[j]))


def test_simhash_awkward_rows(spark):
    got = simhash.near_groups(awkward(spark)).collect()
    assert len(got) == 9
    zero = {r["event_id"]: r["component_id"] for r in got if r["event_id"] in (1, 2, 3)}
    assert zero == {1: 1, 2: 1, 3: 1}
    assert {r["component_id"] for r in got if r["event_id"] in (5, 6)} == {5}
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r["event_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 7]


# ---- lines ----


def plain_lines(rows, min_sites, min_words):
    key = lambda x: x.strip(" \t\r\x0b\x0c")
    counts = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= min_words
    sites, first = {}, {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            if counts(line):
                sites.setdefault(key(line), set()).add(site)
                first[key(line)] = min(i, first.get(key(line), i))
    out = {}
    for i, text, _ in rows:
        own = [] if text is None else text.split("\n")
        kept = [x for x in own if not (counts(x) and len(sites[key(x)] - {None}) >= min_sites and first[key(x)] != i)]
        out[i] = (len(own), len(own) - len(kept), None if text is None else "\n".join(kept))
    return out


@pytest.mark.parametrize("min_sites", [2, 10])
def test_lines_equal_brute_force(spark, min_sites):
    rng = random.Random(4)
    common = [f"shared line number {k}" for k in range(40)]
    rows = []
    for i in range(400):
        body = [rng.choice(common) if rng.random() < 0.3 else words(rng, rng.randrange(0, 7), 9) for _ in range(rng.randrange(0, 8))]
        rows.append((i, "\n".join(x + rng.choice(["", " ", "\t", "\r"]) for x in body), rng.choice([None, *"abcdefghijklmnop"])))
    rows.append((400, None, "a"))
    got = lines.remove_boilerplate(events(spark, rows), min_sites=min_sites)
    found = {r["event_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in got.collect()}
    assert found == plain_lines(rows, min_sites, 1)
    three = lines.remove_boilerplate(events(spark, rows), min_sites=min_sites, min_words=3).collect()
    assert {r["event_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in three} == plain_lines(rows, min_sites, 3)
    assert any(v[1] for v in found.values())


def test_lines_stay_out_of_python(spark):
    plan = lines.remove_boilerplate(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_awkward_rows(spark):
    got = {(r["event_id"], r["kept"]): r["n_removed"] for r in lines.remove_boilerplate(awkward(spark), min_sites=2).collect()}
    assert got[(6, "")] == 1 and got[(5, "same text of a few words here")] == 0 and got[(1, None)] == 0
    stripped = lines.strip_boilerplate(awkward(spark), min_sites=2)
    assert stripped.columns == awkward(spark).columns and stripped.count() == 9


# ---- fingerprints ----


def test_next_and_edited_text(spark):
    rng = random.Random(9)
    rows = [(i * 3 % 101, words(rng, rng.randrange(0, 50)) + "é" * (i % 4)) for i in range(101)]
    got = {r["event_id"]: r for r in fingerprints.compare_with_next(events(spark, rows)).collect()}
    texts = dict(rows)
    ids = sorted(texts)
    for at, i in enumerate(ids):
        text, other = texts[i], texts[ids[(at + 1) % len(ids)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        assert bytes(got[i]["edited"]).decode() == edited
        assert got[i]["n_chars"] == len(text)
        assert got[i]["fingerprint"] == fingerprints.digest(text.encode())
        assert got[i]["near_next"] == fingerprints.likeness(fingerprints.digest(text.encode()), fingerprints.digest(other.encode()))
        assert 0 <= got[i]["near_edited"] <= 1


def test_digests_tell_edits_from_strangers(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300))
    near, far = [], []
    for _ in range(40):
        a, b = text(), text()
        d = fingerprints.digest(a.encode())
        near.append(fingerprints.likeness(d, fingerprints.digest((a[: len(a) * 3 // 4] + b[: len(b) // 4]).encode())))
        far.append(fingerprints.likeness(d, fingerprints.digest(b.encode())))
    assert min(near) > max(far)
    assert fingerprints.likeness(d, d) == 1.0 and fingerprints.difference(d, "00" * 66) <= fingerprints.WORST


def test_fingerprints_awkward_rows(spark):
    got = fingerprints.compare_with_next(awkward(spark)).collect()
    assert len(got) == 9 and all(0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.compare_with_next(awkward(spark).where("event_id = 7")).first()["near_next"] == 1.0
    plain = {r["event_id"]: r["fingerprint"] for r in fingerprints.fingerprint_events(awkward(spark)).collect()}
    assert plain[1] == plain[2] and plain[5] == plain[6]


# ---- repeats ----


def plain_repeats(rows, span):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + span] for t in texts for k in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if seen[t[k : k + span]] > 1:
                gone[k : k + span] = b"\x01" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(t), sum(gone), runs, kept))
    return out


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", group_rows)
    rng = random.Random(6)
    passages = [words(rng, 150, 5000) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 150), 5000)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 200)
            parts += [p[a : a + rng.randrange(350, 600)], words(rng, rng.randrange(0, 40), 5000)]
        rows.append((i, " ".join(parts)))
    rows += [(60, "ab" * 600), (61, "é" * 300), (62, "For " * 300), (63, rows[3][1]), (64, None), (65, "")]
    rows += [(66, "y" + "ab" * 199 + "z"), (67, "q" * 400), (68, "r" * 401)]
    got = {r["event_id"]: r for r in suffixes.remove_repeats(events(spark, rows)).collect()}
    for (i, _), (n, removed, spans, kept) in zip(rows, plain_repeats(rows, 400), strict=True):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, spans, kept), i


def test_repeats_of_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    rng = random.Random(8)
    a, b = words(rng, 3000, 10**6), words(rng, 2500, 10**6)
    rows, spans = suffixes.text_runs((a + b + a[5000:9000]).encode(), 400), None
    covered = set()
    for x, y in rows[1]:
        covered.update(range(x, y))
    # runs at the ends of the repeat differ; all inside is found
    assert set(range(5400, 8200)) <= covered and spans is None


def test_repeats_awkward_rows(spark):
    got = suffixes.remove_repeats(awkward(spark)).collect()
    assert len(got) == 9
    twice = awkward(spark).where("event_id = 4").unionByName(awkward(spark).where("event_id = 4"))
    assert [r["n_removed"] == r["n_bytes"] > 0 for r in suffixes.remove_repeats(twice).collect()] == [True, True]


# ---- tokens ----


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(vocabulary()), special_tokens={}
    )


def test_tokens_equal_the_reference_encoder(spark, tiktoken_encoding):
    rng = random.Random(11)
    pool = ["'s", "'ll", "'RE", "'", " ", "  ", "\n", "\t", "　", "\xa0", "a", "Zq", "é", "1", "½", "!", "#", "\U0001f600", "́", "\x00", chr(0x10FFFE)]
    rows = [(i, "".join(rng.choices(pool, k=rng.randrange(0, 20)))) for i in range(3000)]
    rows += [(3000, "a" * 3000), (3001, " " * 999 + "x"), (3002, "日本語" * 500), (3003, None)]
    encoded = tokens.encode_events(events(spark, rows), vocabulary(), offsets=True)
    got = {r["event_id"]: r for r in encoded.collect()}
    for i, text in rows:
        ids = tiktoken_encoding.encode_ordinary(text or "")
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert got[i]["n_tokens"] == len(ids)
        ends = np.cumsum([len(tiktoken_encoding.decode_single_token_bytes(x)) for x in ids]).tolist()
        assert np.frombuffer(got[i]["ends"], "<u4").tolist() == ends
    back = {r["event_id"]: bytes(r["decoded"]) for r in tokens.decode_events(encoded, vocabulary()).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    once = {r["event_id"]: r for r in tokens.round_trip_events(events(spark, rows), vocabulary()).collect()}
    assert all(once[i]["ids"] == got[i]["ids"] and bytes(once[i]["decoded"]) == back[i] for i in back)
    assert tokens.round_trip_events(events(spark, rows), vocabulary(), compare=True).where("not round_trip").count() == 0


def test_tokens_awkward_rows(spark):
    got = tokens.encode_events(awkward(spark), vocabulary()).collect()
    assert len(got) == 9 and {r["n_tokens"] for r in got if r["event_id"] in (1, 2)} == {0}


# ---- learned operators ----


def labelled(spark, n=600):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        bad, rough = rng.random() < 0.3, rng.random() < 0.3
        body = [f"{rng.choice('abcdefgh')}{rng.choice('lmnop')}{rng.choice('aeiou')}{rng.choice('rst')}" for _ in range(60)]
        if bad:
            for _ in range(3):
                body[rng.randrange(60)] = rng.choice(["grumblefuss", "snarlbucket"])
        if rough:
            body = [w.upper() + "!!" for w in body]
        rows.append((i, " ".join(body)))
        marks.append((i, int(not rough), int(bad)))
    return events(spark, rows), spark.createDataFrame(marks, "event_id long, quality int, toxic int")


def accuracy(scored, labels, col, held):
    both = scored.join(labels, "event_id").where(held)
    return both.agg(F.avg((F.col("predicted") == F.col(col)).cast("double"))).first()[0]


def test_toxicity_on_held_out_rows(spark):
    texts, labels = labelled(spark)
    model = toxicity.fit_toxicity(texts, labels, usable=F.col("event_id") % 5 != 0)
    scored = toxicity.score_toxicity(texts, model)
    assert accuracy(scored, labels, "toxic", F.col("event_id") % 5 == 0) > 0.97
    got = {r["event_id"]: r for r in toxicity.score_toxicity(awkward(spark), model).collect()}
    assert len(toxicity.score_toxicity(awkward(spark), model).collect()) == 9
    assert got[1]["predicted"] == got[2]["predicted"] == 0 and 0 <= got[4]["score"] <= 1
    kept = toxicity.keep_clean(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.count() == 9


def test_toxicity_with_nothing_to_learn(spark):
    texts, labels = labelled(spark, 20)
    for some in (labels.where("toxic = 0"), labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit_toxicity(texts, some)
        assert {r["predicted"] for r in toxicity.score_toxicity(texts, model).collect()} <= {0, 1}


def test_quality_on_held_out_rows(spark):
    texts, labels = labelled(spark)
    model = quality.fit_quality(texts, labels, usable=F.col("event_id") % 4 != 2)
    assert accuracy(quality.score_quality(texts, model), labels, "quality", F.col("event_id") % 4 == 2) > 0.97
    assert len(quality.score_quality(awkward(spark), model).collect()) == 9
    none = quality.fit_quality(texts, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(texts, none).collect()} == {0.5}


def test_quality_finds_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x[:2000], y[:2000], n_pairs=1)
    assert model.pairs == ((0, 1),)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_language_on_held_out_rows(spark):
    rng = random.Random(12)
    parts = {"xx": ["ba", "lo", "mi"], "yy": ["sch", "ung", "ter"], "zz": ["ção", "õe", "nha"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), None, lang))
    df = events(spark, rows)
    model = language.fit_languages(df, usable=F.col("event_id") % 5 != 0)
    got = {r["event_id"]: r for r in language.predict_language(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, _, lang in rows if i % 5 == 0)
    odd = {r["event_id"]: r for r in language.predict_language(awkward(spark), model).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[3]["lang_pred"] == "und" and odd[2]["score"] == 0.0
    assert odd[7]["lang_pred"] in parts
    empty = language.fit_languages(df.limit(0))
    assert {r["lang_pred"] for r in language.predict_language(df, empty).collect()} == {"und"}


# ---- all of them on no rows ----


def test_empty_tables(spark):
    none = awkward(spark).limit(0)
    model = toxicity.fit_toxicity(none, spark.createDataFrame([], "event_id long, toxic int"))
    found = [
        simhash.near_groups(none),
        simhash.keep_one(none),
        lines.remove_boilerplate(none),
        fingerprints.compare_with_next(none),
        suffixes.remove_repeats(none),
        tokens.encode_events(none, vocabulary()),
        toxicity.score_toxicity(none, model),
        quality.score_quality(none, quality.fit_quality(none, spark.createDataFrame([], "event_id long, quality int"))),
        language.predict_language(none, language.fit_languages(none)),
    ]
    assert [df.count() for df in found] == [0] * len(found)


def test_digest_columns_follow_the_bytes():
    assert hashlib.sha256(np.array([1, 256], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\x01\0\0\0\0\x01\0\0").hexdigest()
