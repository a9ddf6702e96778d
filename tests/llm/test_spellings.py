"""Spelling groups of slide metadata against brute force."""

import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tissuegrid.llm import spellings
from tissuegrid.sources.metadata import load_slide_metadata

SCHEMA = "slide_id string, Mitosis string, word int, n string, _red int, root string"
ALPHABET = "abcdeéüö"


def plain_counts(rows, drop_every=0, min_letters=6, min_count=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= min_letters and n >= min_count}


def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, times=5):
    near = {w: [v for v in counts if plain_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def slides(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], SCHEMA)


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def made_up(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    rows = []
    for i in range(700):
        words = []
        for _ in range(12):
            w = rng.choice(base[: 1 + int(60 * rng.random() ** 3)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice(ALPHABET) + w[at:], w[:at] + rng.choice(ALPHABET) + w[at + 1 :]))
            words.append(rng.choice((w, w, w.upper())))
        rows.append((str(i), rng.choice(" ,\n.").join(words)))
    return rows


@pytest.mark.parametrize("load,drop_every", [(12.0, 0), (0.0, 7), (1e9, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, load, drop_every):
    monkeypatch.setattr(spellings, "LOAD", load)  # the most, some and the fewest symbols
    rows = made_up()
    counts = plain_counts(rows, drop_every)
    assert len(counts) > 80
    got = spellings.group_spellings(slides(spark, rows), drop_every=drop_every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == plain_groups(counts)


def test_chains_are_followed_to_the_last(spark):
    # each form is five times commoner and one letter away
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(f"{k}-{i}", w) for k, w in enumerate(chain) for i in range(5 * 5**k)]
    got = {r["word"]: r for r in spellings.group_spellings(slides(spark, rows)).collect()}
    assert {r["root"] for r in got.values()} == {"aabbbb"}
    assert [got[w]["form"] for w in chain] == [*chain[1:], None]


def test_terms_of_slide_metadata(spark, tmp_path):
    texts = ["Necrosis present, mitotic count high"] * 30 + ["necrosys present, mitotc count high"] * 6 + ["Nécrosis"] * 5
    path = tmp_path / "slides.json"
    path.write_text("\n".join(json.dumps({f"s{i}": {"patient": f"p{i}", "Mitosis": t}}) for i, t in enumerate(texts)))
    got = {r["word"]: r["root"] for r in spellings.group_spellings(load_slide_metadata(spark, str(path))).collect()}
    assert got == {"necrosis": "necrosis", "present": "present", "mitotic": "mitotic", "necrosys": "necrosis", "mitotc": "mitotic", "nécrosis": "necrosis"}


def test_awkward_slides(spark):
    long = "x" * 3000
    rows = [(None, "tumour tumour"), ("1", None), ("2", ""), ("3", " \n"), *[("4", "tumour")] * 3, *[(str(i), long) for i in range(5)], *[(str(i), long[1:]) for i in range(25)]]
    assert rows_of(spellings.group_spellings(slides(spark, rows))) == plain_groups(plain_counts(rows))
    assert spellings.group_spellings(slides(spark, [])).collect() == []
    assert spellings.group_spellings(slides(spark, rows), min_count=1000).collect() == []


@pytest.mark.parametrize("size", spellings.SYMBOLS)
def test_neighbourhoods_hold_every_edit(size):
    rng = random.Random(size)
    points = lambda w: np.array([[ord(c) for c in w]], np.uint32)
    for _ in range(150):
        w = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(2, 12)))
        keys = set(spellings.neighbour_keys(points(w), size)[0].tolist())
        at, c = rng.randrange(len(w)), rng.choice(ALPHABET)
        for v in (w, w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w + c):
            assert int(spellings.reduced_keys(points(v), size)[0]) in keys
