"""Importance resampling of slides against a plain version."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tissuegrid.functions import ranking
from tissuegrid.llm import resampling
from tissuegrid.sources.metadata import load_slide_metadata

SCHEMA = "slide_id long, Mitosis string, _id int, _n string, rank string, score double"


def plain_words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def plain_features(text, max_n, buckets):
    words = plain_words(text)
    runs = [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(rows, target, max_n, buckets, min_words, percent, seed):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(plain_features(text, max_n, buckets))
    for text in target:
        t.update(plain_features(text, max_n, buckets))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, text in rows:
        found = plain_features(text, max_n, buckets)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if len(plain_words(text)) >= min_words:
            able.append((-score, i is not None, i or 0, len(out)))
        out.append([i, len(found), weight, score, None])
    for rank, entry in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[entry[-1]][4] = rank
    return sorted(map(str, out))


def slides(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 0.5) for i, t in rows], SCHEMA)


def got_rows(df):
    return sorted(str([r["slide_id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in df.collect())


def reports(n=400, seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Grade", "grade", "high", "low", "é2", "tumour", "cells", "x9", "naïve"]) + rng.choice(["", "", "s", "7"])
    lines = [" ".join(word() for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 8)))) for i in range(n)]
    return rows, [" ".join(["tumour cells high Grade"] * 3), "x9\nx9 low", None, ""]


@pytest.mark.parametrize("max_n,target_rows", [(1, 500_000), (2, 500_000), (3, 50)])
def test_equals_a_plain_version(spark, monkeypatch, max_n, target_rows):
    monkeypatch.setattr(ranking, "TARGET_ROWS", target_rows)  # ranks of one bucket and of many
    rows, target = reports()
    how = {"max_n": max_n, "buckets": 97, "min_words": 8, "percent": 25, "seed": 11}
    got = resampling.resample_slides(slides(spark, rows), slides(spark, list(enumerate(target))), **how)
    assert got.columns == ["slide_id", "n_features", "weight", "score", "rank"]
    assert got_rows(got) == plain_resample(rows, target, **how)


def test_runs_over_line_feeds_count_once(spark):
    text = spark.createDataFrame([("a b\n\nc\nd e f",)], "t string")
    how = {"max_n": 3, "buckets": 1_000_003}
    counts = resampling.bucket_counts(resampling.line_features(text, "t", **how), text, "t", **how).collect()
    assert Counter({r["_b"]: r["_count"] for r in counts}) == Counter(plain_features("a b c d e f", 3, 1_000_003))


def test_distinct_lines_are_worked_out_once(spark):
    rows = [(i, "the same line\nand another") for i in range(300)]
    lines = resampling.line_features(slides(spark, rows), "Mitosis", max_n=1, buckets=10).collect()
    assert sorted(r["_n"] for r in lines) == [300, 300]


def test_awkward_slides(spark):
    long = "\n".join(f"w{i % 977} and more" for i in range(20_000))
    rows = [(None, "no id at all"), (None, "no id at all"), (1, None), (2, ""), (3, " \n\n"), (4, long), (5, "same words"), (5, "same words"), (5, "other words"), (6, "same words")]
    how = {"max_n": 2, "buckets": 50, "min_words": 2, "percent": 100, "seed": 1}
    wanted = plain_resample(rows, ["same words"], **how)
    got = got_rows(resampling.resample_slides(slides(spark, rows), slides(spark, [(0, "same words")]), **how))
    strip = lambda found: sorted(x.rsplit(",", 1)[0] for x in found)
    assert strip(got) == strip(wanted)  # equal scores of one id: which text is first is ours
    assert sorted(x.rsplit(", ", 1)[1] for x in got) == sorted(x.rsplit(", ", 1)[1] for x in wanted)
    none = slides(spark, [])
    assert resampling.resample_slides(none, slides(spark, [(0, "a")]), **how).collect() == []
    assert len(resampling.resample_slides(slides(spark, rows), none, **how).collect()) == len(rows)


def test_slide_metadata_toward_a_cohort(spark, tmp_path):
    doc = {f"s{i}": {"patient": f"p{i}", "Mitosis": ("high count of cells (score = 3)" if i % 4 == 0 else "low count, few cells (score = 1)")} for i in range(200)}
    path = tmp_path / "slides.json"
    path.write_text(json.dumps(doc))
    meta = load_slide_metadata(spark, str(path))
    cohort = spark.createDataFrame([("high count score 3",)] * 50, "report string")
    got = resampling.resample_slides(meta, cohort, target_text_col="report", min_words=3).where("rank IS NOT NULL").collect()
    assert len(got) == 20 and sum(int(r["slide_id"][1:]) % 4 == 0 for r in got) >= 18
