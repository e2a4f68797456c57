"""The pipeline against brute force, stage by stage."""

import corpus_pipeline
import numpy as np
from helpers import DATA
from pyspark.sql import functions as F
from test_groups import check_whole_documents
from test_scans import plain_contamination
from test_similar import plain_kept

from spanfold.llm import mixing, packing, quality
from spanfold.llm.common import table


def test_stages_act_on_what_is_left(spark, tmp_path):
    docs = table(spark, DATA, "documents").cache()
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = kept[next(reversed(kept))]
        out = stage(spark, before, DATA)
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert kept[name].columns == docs.columns
    ids = {name: [r.doc_id for r in frame.select("doc_id").collect()] for name, frame in kept.items() if name != "packing"}

    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    known = [d for d in ids[""] if d in labels]
    assert sum((d in set(ids["quality"])) == (labels[d] == 1) for d in known) > 0.95 * len(known)

    rows = [tuple(r) for r in kept["quality"].select("doc_id", "text").collect()]
    assert sorted((d is None, d or 0) for d in ids["near_duplicates"]) == plain_kept(rows)

    rows = [tuple(r) for r in kept["near_duplicates"].select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, DATA, "benchmark").collect()]
    assert sorted(ids["decontamination"]) == sorted(r[0] for r in plain_contamination(rows, items) if not r[5])

    check_whole_documents(kept["decontamination"], kept["mixing"], mixing.mix_single_source(kept["decontamination"]))

    encode = packing.Encoder()
    packed = kept["packing"].collect()
    assert sum(r.n_tokens for r in packed) == sum(len(encode(r.text)) + 1 for r in kept["mixing"].collect())
    assert all(len(np.frombuffer(r.input_ids, np.uint16)) == packing.ROW for r in packed)
    again = corpus_pipeline.run(spark, DATA)
    assert again.agg(F.sum("n_tokens")).first()[0] == sum(r.n_tokens for r in packed)


def test_stages_of_awkward_rows(spark, docs, rows, empty, clashing):
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, empty, DATA).count() == 0, name
    labels = table(spark, DATA, "labels").where(~quality.held_out()).select("doc_id", F.col("quality").alias("label"))
    ranking = quality.fit(docs, labels)
    accepted = [r for r in rows if ranking.scores(np.array([quality.features((r[1] or "").encode())]))[0] >= quality.THRESHOLD]
    assert sorted(map(tuple, stages["quality"](spark, docs, DATA).collect()), key=repr) == sorted(accepted, key=repr)
    kept = stages["near_duplicates"](spark, docs, DATA)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == plain_kept([r[:2] for r in rows])
    assert sorted(map(repr, stages["near_duplicates"](spark, clashing, DATA).select(*docs.columns).collect())) == sorted(map(repr, kept.collect()))
    items = [tuple(r) for r in table(spark, DATA, "benchmark").collect()]
    clean = sorted((r[0] for r in plain_contamination([r[:2] for r in rows], items) if not r[5]), key=repr)
    assert sorted((r.doc_id for r in stages["decontamination"](spark, docs, DATA).collect()), key=repr) == clean
    unique = docs.dropDuplicates(["doc_id"])
    check_whole_documents(unique, stages["mixing"](spark, unique, DATA), mixing.mix_single_source(unique))
    encode = packing.Encoder()
    assert sum(r.n_tokens for r in stages["packing"](spark, docs, DATA).collect()) == sum(len(encode(r[1] or "")) + 1 for r in rows)
