"""What single stages of the pipeline keep, against brute force."""

import random

import corpus_pipeline
from tissuegrid.llm import shingles

PATH = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents of ``(doc_id, text, source)``."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(x, y):
    return not x and not y or 5 * len(x & y) >= 4 * len(x | y)


def near_rows():
    rng = random.Random(11)
    word = lambda: f"t{rng.randrange(400)}"
    texts = [[word() for _ in range(rng.randrange(1, 160))] for _ in range(120)]
    for i in range(200):  # copies with zero to four changed, lost or added words
        copy = list(rng.choice(texts[:120]))
        for _ in range(i % 5):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice(([word()], [], [copy[at], word()])) or copy[at : at + 1]
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(400, None), (401, ""), (402, " \n"), (403, "One"), (404, "one")]


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    least = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for n, (i, x) in enumerate(sets):
            for j, y in sets[n + 1 :]:
                if least[i] != least[j] and plain_near(x, y):
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return least


def test_near_dedup_keeps_one_of_texts_that_share_four_fifths(spark):
    rows = near_rows()
    expected = plain_components(rows)
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    groups = shingles.near_groups(docs, id_col="doc_id", text_col="text").collect()
    assert {r["doc_id"]: r["component_id"] for r in groups} == expected
    kept = corpus_pipeline.drop_near_copies(spark, docs, PATH)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_near_texts_meet_in_tiles_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("tissuegrid.llm.tiles.BLOCK_ROWS", 8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base, f"own{i}"]), "a") for i in range(60)]
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), PATH)
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_near_dedup_stands_null_ids(spark):
    docs = documents(spark, [(None, "no id", "a"), (1, None, "a"), (2, "", "a"), (3, "no id", "b"), (3, "no id", "b")])
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.drop_near_copies(spark, docs, PATH).collect()) == [0, 1, 3]


def test_line_dedup_finds_a_passage_under_a_hot_source(spark):
    # 20 documents, seven of one source and the others of seven sources: eight sources in all
    passage = "a passage that stands in twenty of the documents"
    source = lambda i: "hot" if i < 7 else f"s{i % 7}"
    rows = [(i, f"line of document {i}\n{passage}", source(i)) for i in range(20)]
    rows += [(i, f"line of document {i}\non four sources only", f"s{i % 4}") for i in range(20, 40)]
    assert len({s for _, _, s in rows[:20]}) == 8
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, documents(spark, rows), PATH).collect()}
    assert kept[0] == rows[0][1]
    assert all(kept[i] == f"line of document {i}" for i in range(1, 20))
    assert all(kept[i] == rows[i][1] for i in range(20, 40))


def test_line_dedup_removes_short_and_unspaced_lines(spark):
    rows = [(i, f"own line {i}\n\n本页内容仅供参考请勿转载\nAnd ornd.", f"s{i}") for i in range(6)]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, documents(spark, rows), PATH).collect()}
    assert kept == {0: rows[0][1], **{i: f"own line {i}\n" for i in range(1, 6)}}


def test_near_dedup_keeps_unlike_texts_that_repeat_an_id(spark):
    copied, clean = "one text that two documents have", "another text that only repeats the id"
    docs = documents(spark, [(1, copied, "a"), (1, clean, "b"), (2, copied, "c")])
    kept = corpus_pipeline.drop_near_copies(spark, docs, PATH).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, copied), (1, clean)])


def test_near_dedup_keeps_one_of_texts_with_near_fingerprints(spark):
    """Op1's links count, also where the sets of five words share less than four fifths."""
    from tissuegrid.llm import simhash

    rng = random.Random(21)
    word = lambda: f"t{rng.randrange(900)}"
    rows, n = [], 0
    while n < 40:
        # a passage that repeats outweighs what is written around it, which the sets do not see
        passage = " ".join(word() for _ in range(11))
        rows += [(2 * n + k, " ".join([passage] * 25 + [word() for _ in range(6)])) for k in (0, 1)]
        n += 1
    rows += [(i + 200, " ".join(word() for _ in range(30))) for i in range(40)]
    signs = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    near = lambda i, j: (signs[i] ^ signs[j]).bit_count() <= 4 or plain_near(plain_set(texts[i]), plain_set(texts[j]))
    texts = dict(rows)
    by_bits = [(i, j) for i in texts for j in texts if i < j and near(i, j) and not plain_near(plain_set(texts[i]), plain_set(texts[j]))]
    assert len(by_bits) >= 10 and all(j == i + 1 for i, j in by_bits)
    wanted = set(texts) - {j for i in texts for j in texts if i < j and near(i, j)}
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, [(i, t, "a") for i, t in rows]), PATH)
    assert {r["doc_id"] for r in kept.collect()} == wanted


def test_a_fingerprint_shared_by_unlike_sets_links_them(spark):
    from tissuegrid.llm import simhash

    # the words of the longer text repeat so often that its fingerprint is that of the shorter one
    short = " ".join(["a b c"] * 41)
    rows = [(7, short), (3, short + " z"), (5, "quite another text of several words"), (9, None), (8, " ")]
    assert simhash.fingerprint(rows[0][1].encode()) == simhash.fingerprint(rows[1][1].encode())
    assert not plain_near(plain_set(rows[0][1]), plain_set(rows[1][1]))
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, PATH).collect()} == {3, 5, 8}
