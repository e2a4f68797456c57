"""Registered queries that SQL can't express, against plain Python over whole tables."""

import zlib

import __spark_entry__ as entry
import numpy as np
from helpers import DATA, duck
from test_groups import plain_components, plain_fingerprint
from test_scans import folded, stands

from spanfold.llm import licenses, packing


def documents():
    return duck().execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_every_operator_is_registered_once():
    numbers = [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_licences(spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found = {r.doc_id: r for r in entry.queries()["op2_licenses"](spark, DATA).collect()}
    assert len(found) == len(documents())
    for doc_id, text in documents():
        words = folded(text)
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        r, joined = found[doc_id], " ".join(words)
        labels = {label for _, label in places} | {n.label for n in licenses.NOTICES if stands(n, joined)}
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({label for _, label in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1


def test_packing(spark):
    encode, pieces = packing.Encoder(), {}
    for r in entry.queries()["op6_packing"](spark, DATA).collect():
        ids = np.frombuffer(r.input_ids, np.uint16)
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(doc, []).append((piece, ids[a:b].tolist()))
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in pieces.items()} == {d: [*encode(t or "").tolist(), packing.END] for d, t in documents()}


def test_quality(spark):
    found = {r.doc_id: r for r in entry.queries()["op7_quality"](spark, DATA).collect()}
    labels = dict(duck().execute("SELECT doc_id, quality FROM labels").fetchall())
    assert set(found) == {d for d, _ in documents()}
    for doc_id, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r.predicted == labels[d] for d, r in found.items() if r.held_out and d in labels]
    assert sum(held) >= 0.9 * len(held) > 0


def test_simhash(spark):
    rows = documents()
    fps = [plain_fingerprint(t) for _, t in rows]
    least = {}
    for (doc_id, _), group in zip(rows, groups := plain_components(fps)):
        least[group] = min(least.get(group, doc_id), doc_id)
    wanted = sorted((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, groups))
    assert sorted(map(tuple, entry.queries()["op9_simhash"](spark, DATA).collect())) == wanted
