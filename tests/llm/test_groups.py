"""SimHash, line deduplication, mixing, quality, chat and packing against plain Python."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanfold.llm import chat, line_dedup, mixing, packing, quality, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id reachable, by id."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints_and_components(docs, rows, empty, clashing):
    found = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    fps = {t: plain_fingerprint(t) for _, t, *_ in rows}
    label = plain_components([fps[t] for _, t, *_ in rows])
    least = {}
    for (doc_id, *_), group in zip(rows, label):
        least[group] = min((x for x in (least.get(group), doc_id) if x is not None), default=None)
    wanted = sorted(((d, f"{fps[t]:016x}", least[g]) for (d, t, *_), g in zip(rows, label)), key=repr)
    assert found == wanted
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(map(tuple, simhash.near_duplicates(clashing).collect()), key=repr) == wanted
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({w[2] for w in wanted}, key=repr)


def test_links_in_shards_equal_all_pairs(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base[:150]:
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 3)):
                b ^= 1 << rng.randrange(64)
            fps.add(b)
    fps |= {1 << i for i in range(64)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    label = plain_components(fps)
    for shard_size in (30, 100_000):
        nodes = simhash.components(simhash.link_fingerprints(frame, shard_size=shard_size)).collect()
        root = {n.node % 2**64: n.root for n in nodes}
        groups = {}
        for f, g in zip(fps, label):
            groups.setdefault(g, []).append(f)
        for members in groups.values():
            assert len({root.get(m) for m in members}) == 1 and (root.get(members[0]) is None) == (len(members) == 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark, docs, empty, clashing):
    rng = random.Random(8)
    base = ["".join(rng.choice("abc dé") for _ in range(rng.randint(3, 70))) for _ in range(25)]
    lines = list(base)
    for line in base * 2:
        at = rng.randrange(len(line))
        lines.append(line[:at] + rng.choice(["", "x", "é", line[at] + "y"]) + line[at + rng.randint(0, 1) :])
    lines += ["page 1 of the long report", "page 2 of the long report", "page 3 of the long report", "0123456789abcdef", "0123456789abcde", "x" * 32, "x" * 31, "x" * 33]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i::6]) for i in range(6)]
    frame = spark.createDataFrame([*enumerate(texts), (6, None), (7, ""), (8, " \n\n"), (0, texts[0]), (None, lines[0] + "\nonly here without id")], "doc_id long, text string")
    earlier, kept = [], {}
    for doc_id, text in [*enumerate(texts), (None, lines[0] + "\nonly here without id")]:
        for number, line in enumerate(text.split("\n")):
            if not line.strip():
                continue
            near = any(line == e or abs(len(e) - len(line)) <= 1 and levenshtein(e, line) <= 1 for e in earlier)
            if not near:
                kept.setdefault(doc_id, []).append(number)
            earlier.append(line)
    found = line_dedup.dedup_lines(frame).collect()
    assert len(found) == 11
    for r in found:
        assert r.kept_lines == kept.get(r.doc_id, []), r
    long = {r.doc_id: r.kept_lines for r in line_dedup.dedup_lines(spark.createDataFrame([(1, "ab\nac\nab\nlonger line\nlonger lines")], "doc_id long, text string"), least_chars=3).collect()}
    assert long == {1: [0, 1, 3]}
    left = line_dedup.drop_lines(frame, line_dedup.dedup_lines(frame)).collect()
    assert {r.doc_id: r.text for r in left}[1] == "\n".join(x for i, x in enumerate(texts[1].split("\n")) if i in kept.get(1, []) or not x.strip())
    assert line_dedup.dedup_lines(empty).count() == 0
    assert sorted(map(tuple, line_dedup.dedup_lines(clashing).collect()), key=repr) == sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=repr)


def test_lines_of_any_ids(spark):
    """Negative ids, the largest id, null ids and shared ids with different texts, beside clashing columns."""
    most = 2**63 - 1
    rows = [(-5, "one line here\ntwo lines there\nthird and last"), (-4, "two lines there\na fourth kind of line"), (most, "x marks\nno id at all"), (None, "no id at all\nnull only, first"), (None, "null only, second text\nx marks")]
    rows += [(7, "shared id, one text\nx marks"), (7, "another text altogether\nx marks")]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, kept_lines int, _id int, text_key int")
    found = {(r.doc_id, r.n_lines, tuple(r.kept_lines)) for r in line_dedup.dedup_lines(frame).collect()}
    left = {(r.doc_id, r.text) for r in line_dedup.drop_lines(frame, line_dedup.dedup_lines(frame)).collect()}
    assert line_dedup.drop_lines(frame, line_dedup.dedup_lines(frame)).columns == frame.columns
    assert (-5, 3, (0, 1, 2)) in found and (-4, 2, (1,)) in found and (most, 2, (1,)) in found
    assert {x[2] for x in found if x[0] is None} == {(1,), (0,)} and len([x for x in found if x[0] == 7]) == 2
    assert (-4, "a fourth kind of line") in left and (None, "null only, first") in left and (None, "null only, second text") in left
    assert sorted(t.count("x marks") for d, t in left if d == 7) == [0, 1] and (most, "no id at all") in left
    with pytest.raises(TypeError, match="integer"):
        line_dedup.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_mix_of_single_sources(docs, rows, empty, clashing):
    found = mixing.mix_single_source(docs).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {}
    for r, s in ((r, {i: x[3] for i, x in enumerate(rows[:52])}.get(r.doc_id, "s1")) for r in found):
        assert r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, (0,))[0] + r.taken, r.target
    assert all(abs(got - target) <= 2 for got, target in taken.values())
    assert abs(sum(t for _, t in taken.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = sorted(map(tuple, mixing.mix_single_source(docs.repartition(7)).collect()), key=repr)
    assert again == sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix_single_source(clashing).collect()), key=repr)
    assert mixing.mix_single_source(empty).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.taken, r.target) for r in mixing.mix_single_source(blank).collect()} == {(0, 0.0)}


def check_whole_documents(before, after, mixed):
    """Texts stay whole; each stands as often as the mix took it, the one at a stretch's end rounded."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows, times = {(r.doc_id, r.text) for r in before.collect()}, {}
    for r in after.collect():
        assert (r.doc_id, r.text) in rows
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    sizes = {d: size(t) for d, t in rows}
    for r in mixed.collect():
        assert not r.size or abs(times.get(r.doc_id, 0) - r.taken / sizes[r.doc_id]) <= 0.5


def test_repeated_documents_have_the_words_taken(docs, empty, clashing):
    unique = docs.where("doc_id <> 2")
    out = mixing.repeat_documents(unique)
    assert out.columns == docs.columns
    check_whole_documents(unique, out, mixing.mix_single_source(unique))
    names = clashing.withColumns({"_place": F.lit(5), "_pattern": F.lit("p"), "copy": F.lit(6), "within": F.lit(9)})
    again = mixing.repeat_documents(names.where("doc_id <> 2"))
    assert again.columns == names.columns and again.where("_place <> 5 or _pattern <> 'p' or copy <> 6 or within <> 9").count() == 0
    assert sorted(map(repr, again.select(*docs.columns).collect())) == sorted(map(repr, out.collect()))
    assert mixing.repeat_documents(empty).count() == 0


def test_rows_without_ids_are_mixed_one_by_one(spark):
    rows = [(None, f"word{i} " * (5 + i % 3), "a") for i in range(300)] + [(i, "x y z", "b") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_single_source(frame).collect()
    words = {s: sum(r.taken for r in mixed if (r.doc_id is None) == (s == "a")) for s in "ab"}
    targets = {s: next(r.target for r in mixed if (r.doc_id is None) == (s == "a")) for s in "ab"}
    assert all(abs(words[s] - targets[s]) <= 2 for s in "ab")
    out = mixing.repeat_documents(frame)
    assert abs(out.where("source = 'a'").agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] - targets["a"]) <= 7


def test_overlapping_sources_meet_quotas_cheaply(spark):
    units = spark.createDataFrame([(i, str(i), (["a"], ["a", "b"], ["b", "c"])[i % 3], 10 + i % 7) for i in range(300)], "doc_id long, name string, members array<string>, size long")
    plan = mixing.plan_mix(units, lambda s: dict.fromkeys(s, 1), Fraction(1, 2), 2)
    got = mixing.take(units, plan).collect()
    by = {}
    for r in got:
        assert r.taken == sum(x.words for x in r.by_source) <= 2 * r.size and {x.source for x in r.by_source} <= set(r.members)
        for x in r.by_source:
            by[x.source] = by.get(x.source, 0) + x.words
    assert all(abs(by[s] - float(t)) <= 2 for s, t in plan.targets.items())
    assert max(r.taken / r.size for r in got) <= 1  # no repetition while unused documents could serve


def test_min_cost_flow_equals_enumeration():
    rng = random.Random(9)
    for _ in range(30):
        arcs = [(0, 1, rng.randint(0, 3), rng.randint(0, 3)), (0, 2, rng.randint(0, 3), rng.randint(0, 3)), (1, 2, 2, 1), (1, 3, rng.randint(0, 3), rng.randint(0, 3)), (2, 3, rng.randint(0, 3), rng.randint(0, 3))]
        flow, total = mixing.min_cost_flow(4, arcs, 0, 3)
        best = None
        for f in np.ndindex(*(a[2] + 1 for a in arcs)):
            if f[0] == f[2] + f[3] and f[1] + f[2] == f[4]:
                key = (-(f[3] + f[4]), sum(x * a[3] for x, a in zip(f, arcs)))
                best = key if best is None else min(best, key)
        assert (-total, sum(x * a[3] for x, a in zip(flow, arcs))) == best


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 300 and right > 0.97


def test_quality_of_awkward_rows(spark, docs, empty, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_quality(docs, labels)
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1 or (score >= 0.7) <> (predicted = 1)").count() == 0
    assert sorted(map(tuple, quality.score_quality(clashing, labels).collect()), key=repr) == sorted(map(tuple, found.collect()), key=repr)
    assert quality.score_quality(empty, labels).count() == 0
    none = quality.score_quality(docs, labels.limit(0))
    assert none.where("predicted = 0").count() == 0
    ranking = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    kept = quality.keep_accepted(clashing, ranking)
    assert kept.columns == clashing.columns
    assert kept.count() == quality.score(docs, ranking, ["doc_id"]).where("predicted = 1").count()


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(21)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(60))
    x, y, *others = [text() for _ in range(8)]
    rows = [(None, t) for t in others] + [(None, others[0]), (3, x), (7, y), (7, x), (None, y + " ")]
    kept = sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert kept == sorted([(None, t) for t in others] + [(3, x), (7, y)], key=repr)


def test_the_kept_rows_keep_clashing_columns(spark, clashing, docs, empty):
    more = clashing.withColumns({c: F.lit(4) for c in ("_place", "_key", "group", "copies", "kept_id", "kept_key", "_c0", "_row")})
    kept = simhash.keep_one(more)
    assert kept.columns == more.columns and kept.where("_place <> 4 or `group` <> 4 or _c0 <> 4 or copies <> 4 or _row <> 4").count() == 0
    assert sorted(map(repr, kept.select(*docs.columns).collect())) == sorted(map(repr, simhash.keep_one(docs).collect()))
    assert simhash.keep_one(empty).count() == 0
    extreme = [(-(2**63), "a b c d"), (2**63 - 1, "a b c d"), (None, "e f g h i j"), (-1, "e f g h i j")]
    found = simhash.keep_one(spark.createDataFrame(extreme, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {-(2**63), -1} and len(found) == 2


SAID = "</s>[INST] ok [/INST]"


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "b\\ <s>"), (1, 0, "user", "a\n"), (-1, 0, "user", SAID), (-1, 1, "assistant", SAID), (2, 0, "system", None), (2, None, None, "x"),
        (2, 5, "assistant", ""), (2, 5, "assistant", "é"), (None, 0, "user", "q"),
    ] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} [/INST]") for i in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert len(found) == 5
    groups = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in groups.items():
        r, loss = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and not r.rewrites
        assert r.formatted_chars == len(chat.template(turns))
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_escapes_and_rewriting_templates():
    rng = random.Random(10)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "[INST]", "[/INST]", "<s>", "</s>", "<", "[", "/", "INST]", "s>", "a", "é", "\n", "[\\INST]"]) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
        assert chat.read_turn(chat.template([("user", text)]))[:2] == ("user", text)
    shows_last = chat.Incremental(lambda turns: f"{len(turns)} turns: {turns[-1][1]}")
    shows_last.add("user", "a")
    assert not shows_last.rewrites
    shows_last.add("user", "b")
    assert shows_last.rewrites


def test_templates_that_depend_on_earlier_turns(spark):
    def alternating(turns):
        """A template that shows the system prompt in every turn and insists on alternating roles."""
        prompt = next((text for role, text in turns if role == "system"), "NONE")
        said = [t for t in turns if t[0] != "system"]
        if any(role != ("user", "assistant")[i % 2] for i, (role, _) in enumerate(said)):
            raise ValueError("roles must alternate")
        return "".join(f"<{prompt}|{role}>{text}\n" for role, text in said)

    rows = [(1, 0, "system", "be kind")] + [(1, i, ("assistant", "user")[i % 2], f"t{i}") for i in range(1, 201)]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "conv_id long, turn long, role string, text string, piece int, start int")
    pieces = chat.format_conversations(frame, alternating).orderBy("turn_index").collect()
    assert "".join(r.piece for r in pieces) == alternating([(role, text) for _, _, role, text in rows]) and not any(r.rewrites for r in pieces)
    assert pieces[-1].end == pieces[-1].chars == len(alternating([(role, text) for _, _, role, text in rows]))


def test_spans_of_rewriting_templates_are_null(spark):
    frame = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(3)], "conv_id long, turn long, role string, text string")
    counts = lambda turns: f"{len(turns)} turns: {turns[-1][1]}"
    found = chat.format_conversations(frame, counts).orderBy("turn_index").collect()
    assert [r.rewrites for r in found] == [False, True, True] and [r.start for r in found] == [0, None, None] and [r.end for r in found] == [11, None, None]
    assert chat.read_back(chat.format_conversations(frame, counts)).first().formatted_chars == len("3 turns: t2")


def test_chat_of_long_texts_and_empty_tables(spark):
    text = "word [INST] \\ " * 200_000
    frame = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_conversations(frame)).first()
    assert row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_long_conversations_are_rendered_whole(spark):
    rows = [(conv, i, "user", f"t{i}") for conv in (1, 2) for i in range(150)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").where("conv_id = 1 or turn < 100")
    numbered = lambda turns: "".join(f"{i} {text}\n" for i, (_, text) in enumerate(turns, 1))
    pieces = {(r.conv_id, r.turn_index): r for r in chat.format_conversations(frame, numbered).collect()}
    for conv, n in ((1, 150), (2, 100)):
        assert "".join(pieces[conv, i].piece for i in range(n)) == numbered([("user", f"t{i}") for i in range(n)])
    marks_first = lambda turns: ("long " if len(turns) > 120 else "") + numbered(turns)
    found = chat.format_conversations(frame, marks_first).groupBy("conv_id").agg(F.max("rewrites")).collect()
    assert dict(map(tuple, found)) == {1: True, 2: False}


def test_packing_keeps_every_token(docs, rows, empty):
    encode = packing.Encoder()
    packed = packing.pack_tokens(docs, row=256, block=3000).collect()
    pieces = {}
    for r in packed:
        ids = np.frombuffer(r.input_ids, np.uint16)
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 256 and (ids[r.n_tokens :] == packing.END).all()
        for doc, number, piece, a, b, start in zip(r.doc_ids, r.doc_rows, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], r.position_starts):
            assert start == piece * 256
            pieces.setdefault((doc, number), []).append((piece, tuple(ids[a:b].tolist())))
    wanted = sorted(([d, [*encode(t or "").tolist(), packing.END]] for d, t, *_ in rows), key=repr)
    found = sorted(([d, [x for _, part in sorted(p) for x in part]] for (d, _), p in pieces.items()), key=repr)
    assert found == wanted  # rows that share an id, or a row that stands twice, are put together each
    assert packing.pack_tokens(empty).count() == 0


def test_packing_of_shared_ids_and_long_texts(spark, tmp_path, docs, clashing):
    rows = [(7, "one two three"), (7, "four five"), (None, "six"), (None, "seven"), (-1, "eight " * 30_000)]
    packed = packing.pack_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), row=64)
    packing.write_packed(packed, str(tmp_path / "packed"))
    import pyarrow.parquet as pq

    written = pq.read_table(str(tmp_path / "packed"))
    ids, lengths, positions = packing.read_matrix(written, row=64)
    assert ids.shape == positions.shape == (written.num_rows, 64)
    pieces, encode = {}, packing.Encoder()
    for r, line, cuts, places in zip(written.to_pylist(), ids, lengths, positions):
        for doc, number, piece, a, b in zip(r["doc_ids"], r["doc_rows"], r["pieces"], cuts, cuts[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault((doc, number), []).append((piece, line[a:b].tolist()))
    found = sorted([str(d), sum((x for _, x in sorted(p)), [])] for (d, _), p in pieces.items())
    assert found == sorted([str(d), [*encode(t).tolist(), packing.END]] for d, t in rows)
    plain = lambda frame: sorted(r.n_tokens for r in packing.pack_tokens(frame).collect())
    assert plain(clashing) == plain(docs)


def test_chunked_encoding_equals_whole_texts():
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    whole = tiktoken.Encoding("whole", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode, rng = packing.Encoder(), random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "a", "été", "12", "!", "'s", "don't", " ", "\x1c", " ", "日本", "\r\n", "x"]) for _ in range(rng.randint(0, 12)))
        assert encode(text).tolist() == whole.encode_ordinary(text), repr(text)


def test_best_fit_uses_the_fullest_row_that_fits():
    rng = random.Random(12)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))]
        rows, free = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(f, -r) for r, f in enumerate(free) if f >= sizes[i]]
            r = -min(fits)[1] if fits else len(rows)
            if not fits:
                rows.append([])
                free.append(20)
            rows[r].append(i)
            free[r] -= sizes[i]
        found = packing.best_fit(sizes, 20)
        assert sorted(sum(sizes[i] for i in r) for r in found) == sorted(20 - f for f in free)
        assert sorted(i for r in found for i in r) == list(range(len(sizes)))


def test_position_resets():
    assert packing.position_ids([0, 2, 5]).tolist() == [0, 1, 0, 1, 2] and packing.position_ids([0, 2, 3], [0, 256]).tolist() == [0, 1, 256]


def test_bradley_terry_equals_plain_gradient_descent():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0.4, 1, (60, 4)), rng.normal(0, 1, (50, 4))])
    d = quality.differences(x, np.array([1] * 60 + [0] * 50), 800, 3)
    assert d.shape == (800, 4)
    w = [0.0] * 4
    for _ in range(4000):
        slope = [0.001 * v for v in w]
        for row, p in zip(d.tolist(), (1 / (1 + np.exp(-d @ np.array(w)))).tolist()):
            for i in range(4):
                slope[i] += (p - 1) * row[i] / len(d)
        w = [v - 0.5 * g for v, g in zip(w, slope)]
        if max(map(abs, slope)) < 1e-6:
            break
    assert np.allclose(quality.bradley_terry(d), w, atol=1e-4)


def test_the_fit_sees_each_label_once(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, label int")
    rows = [(1, "good words stand here"), (2, "bad"), (2, "worse")]
    some, many = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, rows * 50))
    assert quality.fit(some, labels) == quality.fit(many, labels)


@pytest.mark.parametrize("shape", [(5, 9), (0, 9)])
def test_bradley_terry_prefers_the_right_side(shape):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 0.3, (shape[0] * 10, quality.N_FEATURES)), rng.normal(0, 0.3, (shape[1] * 10, quality.N_FEATURES))])
    label = np.array([1] * (shape[0] * 10) + [0] * (shape[1] * 10))
    scores = quality.fit_pairs(x, label).scores(x)
    assert ((scores >= quality.THRESHOLD) == (label == 1)).all()
