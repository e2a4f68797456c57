"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random
import re

import corpus_pipeline
import numpy as np
from helpers import DATA

from spanfold.llm import similar
from spanfold.llm.common import table


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """(doc_id, text) of the least row of each group, null ids last."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), group in zip(rows, label):
        me = (doc_id is None, doc_id or 0)
        least[group] = min(least.get(group, me), me)
    return sorted(least.values())


def kept(spark, rows):
    found = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    return sorted((r.doc_id is None, r.doc_id or 0) for r in found.collect())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_planted_near_copies(spark):
    rng = random.Random(31)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 900]))]
        rows += [" ".join(base)] + [edited(rng, base, len(base) * e // 1000) for e in (5, 10, 18, 25, 40)]
    for n in (25, 60, 200, 417, 900):  # longer ones, up to a similarity of 0.8 and just below
        base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        rows += [" ".join(base)] + [" ".join(base + [f"y{rng.randrange(10**6)}" for _ in range((n - 4) * e // 100 + more)]) for e, more in ((8, 0), (17, 0), (25, 0), (25, 1), (27, 2))]
    boiler = [f"b{i}" for i in range(100)]  # shared by all, similar only to some
    rows += [" ".join(boiler + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([10, 30, 200]))]) for _ in range(40)]
    rows += ["", None, "one two", "One  two", "one two three"]
    rows = [(None if i % 9 == 0 else i, t) for i, t in enumerate(rows)]
    assert kept(spark, rows) == plain_kept(rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    assert kept(spark, rows) == plain_kept(rows)


def test_fingerprints_go_through_the_vantage_point_shards(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    rows = [(0, " ".join(base)), (1, edited(rng, base, 2)), (2, edited(rng, base, 3)), (3, " ".join(f"z{rng.randrange(10**6)}" for _ in range(4000)))]
    prints = [similar.fingerprint(similar.shingles(t.encode())) & (1 << 64) - 1 for _, t in rows]
    assert max((a ^ b).bit_count() for a in prints[:3] for b in prints[:3]) <= similar.RADIUS
    asked, linked = [], similar.link_fingerprints
    monkeypatch.setattr(similar, "link_fingerprints", lambda fps, radius: asked.append(sorted(r.fp & (1 << 64) - 1 for r in fps.collect())) or linked(fps, radius))
    # Without any shingle to meet under, only the fingerprints' links are left.
    monkeypatch.setattr(similar, "_prefixes", lambda shared: lambda batches: iter(()))
    assert kept(spark, rows) == [(False, 0), (False, 3)]
    assert asked == [sorted(set(prints))]
    assert similar.fingerprint(np.empty(0, np.uint64)) == 0


def test_far_copies_of_one_text_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, 6)) for i in range(300)]  # some 0.5 similar to each other, under the same common shingles
    made, apart = [], similar._apart
    monkeypatch.setattr(similar, "_apart", lambda left: made.append(apart(left).count()) or apart(left))
    assert kept(spark, rows) == plain_kept(rows)
    assert made[0] < 300
