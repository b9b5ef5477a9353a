"""Vector links, mixing, near-duplicates, packing and the pipeline against brute force."""

from __future__ import annotations

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import difference
from leadsieve.llm import components, minhash_dedup, mixing, packing, quality_model, vector_dedup
from leadsieve.llm.common import WORD, table, tokenizer
from tests.llm.conftest import ODD


class Union:
    def __init__(self):
        self.up = {}

    def top(self, i):
        while self.up.setdefault(i, i) != i:
            i = self.up[i]
        return i

    def link(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_mixing"])
def test_rows_agree_with_sql(spark, sf_dir, name):
    assert difference(entry.queries()[name](spark, sf_dir), sf_dir, entry.oracle_sql()[name])[1] == ""


def test_components(spark):
    rng, union = random.Random(4), Union()
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 40)]
    for a, b in edges:
        if a != b:
            union.link(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: union.top(i) for e in edges for i in e if e[0] != e[1]}


# ---------------------------------------------------------------- vectors


def test_vector_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    vectors = [*base, *(base[:60] + rng.normal(size=(60, 16)) * 0.1), *base[:20], *(base[0] + rng.normal(size=(80, 16)) * 0.08), *(2 * base[30:35])]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i < 300 else (i - 300) % 3 if i < 380 else 0) for i, v in enumerate(vectors)]
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] + [1.0] * 15, 1), (9003, [None] + [1.0] * 15, 1), (9004, rows[0][1], None), (9005, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "label")
    got = {r.vec_id: r for r in vector_dedup.vector_links(df, per_pivot=30, slice_size=40).collect()}
    union, links = Union(), collections.Counter()
    good = [r for r in rows if r[0] < 9000]
    x = vector_dedup.unit([r[1] for r in good])
    near = x @ x.T >= vector_dedup.THRESHOLD
    for i in range(len(good)):
        for j in range(i):
            if near[i, j] and good[i][2] == good[j][2]:
                union.link(good[i][0], good[j][0])
                links[good[i][0]] += 1
                links[good[j][0]] += 1
    found = sum(got[i].n_links for i in links) / sum(links.values())
    assert found > 0.97 and all(got[i].n_links <= links[i] for i in got)
    same = np.mean([got[r[0]].component_id == union.top(r[0]) for r in good])
    assert same > 0.98
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(9000, 9006))


def test_low_or_unmeasured_recall_is_made_up(spark, monkeypatch):
    rng = np.random.default_rng(2)
    lone = rng.normal(size=(600, 32))
    far = rng.normal(size=(3, 32))
    # the first 600 ids divisible by 20 have no links; label 1 has many more, label 2 a single one, and the search finds none
    rows = [(20 * i, [float(x) for x in v], 1) for i, v in enumerate(lone)]
    rows += [(100_001 + 20 * i + j, [float(x) for x in far[i % 3] + 0.01 * rng.normal(size=32)], 1) for i in range(60) for j in range(2)]
    rows += [(200_000 + 20 * i, [float(x) for x in v], 2) for i, v in enumerate(rng.normal(size=(4000, 32)))]
    rows += [(900_001 + j, [1.0] * 31 + [1.0 + j / 100], 2) for j in range(2)]
    monkeypatch.setattr(vector_dedup, "ATTEMPTS", 1)
    monkeypatch.setattr(vector_dedup, "searched", lambda tasks, adjacency, threshold: spark.createDataFrame([], "node long, links long, root long"))
    got = {r.vec_id: r for r in vector_dedup.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[100_001 + 20 * i + j].n_links for i in range(60) for j in range(2)] == [39] * 120
    assert len({got[100_001 + 20 * i].component_id for i in range(60)}) == 3
    assert [(got[900_001 + j].n_links, got[900_001 + j].component_id) for j in range(2)] == [(1, 900_001)] * 2


def test_tight_groups_that_touch_are_one_component(spark):
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    turned = 0.955 * axes[0] + np.sqrt(1 - 0.955**2) * axes[1]
    # 70 and 70 vectors in two tight groups at a cosine of about 0.95 to each other, and 200 far from both
    centres = [axes[0]] * 70 + [turned] * 70 + [axes[2]] * 200
    rows = [(i, [float(x) for x in c + 0.01 * rng.normal(size=64)], 1) for i, c in enumerate(centres)]
    x = vector_dedup.unit([r[1] for r in rows])
    near = x @ x.T >= vector_dedup.THRESHOLD
    assert near[:70, 70:140].any()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.vector_links(df, wanted=0.0).collect()}
    assert [got[i].n_links for i in range(340)] == (near.sum(axis=1) - 1).tolist()
    assert {got[i].component_id for i in range(140)} == {0}


def test_no_vectors(spark):
    assert vector_dedup.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)]
    got = vector_dedup.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, True), (3, 1, True), (3, 1, True)]


# ---------------------------------------------------------------- mixing


def test_targets_and_mix(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix_documents(docs).collect()
    assert sorted(rows) == sorted(mixing.mix_documents(docs).collect())
    taken, target, longest = collections.Counter(), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source], longest[r.source] = r.target, max(longest.get(r.source, 0), r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    total = sum(r.size for r in rows)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix_documents(odd).count() == len(ODD) and mixing.mix_documents(empty).count() == 0


def test_inclusion_follows_the_length(spark):
    """Over many seeds a document is taken as often as its length says, and each draw meets the target."""
    sizes = [9 + 13 * (i % 11) ** 2 for i in range(400)]
    sized = spark.createDataFrame([(i, "ab"[i % 4 == 0], n) for i, n in enumerate(sizes)], "doc_id long, source string, size long")
    rates = mixing.expected_copies(sized, mixing.source_targets(sized)).collect()
    want = {(r.source, r["class"]): r.copies for r in rates}
    for s in "ab":
        rows = [r for r in rates if r.source == s]
        assert abs(sum(r.copies * r._words for r in rows) - rows[0].target) < 1e-6 * rows[0].target
        copies = [r.copies for r in sorted(rows, key=lambda r: r["class"])]
        assert copies == sorted(copies, reverse=True) and max(copies) <= 2
    assert len({c % 1 for c in want.values()} - {0.0}) > 4
    got, n = collections.Counter(), collections.Counter()
    for seed in range(25):
        for r in mixing.mix(sized, seed=f"s{seed}").collect():
            got[r.source, len(bin(r.size)) - 2] += r.copies
            n[r.source, len(bin(r.size)) - 2] += 1
            assert r.copies - want[r.source, len(bin(r.size)) - 2] < 1
    assert all(abs(got[k] / n[k] - c) < 0.1 for k, c in want.items())


# ---------------------------------------------------------------- near-duplicates


def brute_classes(rows, weights):
    union, sets = Union(), {}
    for i, text in rows:
        sets[i] = weights.of(text or "")
        union.top(i)
    for i in sets:
        for j in sets:
            if j < i and minhash_dedup.similarity(sets[i], sets[j]) >= minhash_dedup.THRESHOLD:
                union.link(i, j)
    return {i: union.top(i) for i in sets}


def test_near_duplicates(make):
    rng = random.Random(7)

    def prose(n):
        return [f"w{rng.randint(0, 3000)}" for _ in range(n)]

    texts, passage = [], prose(60)
    for _ in range(30):  # families of edited copies, which drift apart
        words = prose(rng.choice([40, 120, 300]))
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "edit"
    texts += [" ".join(prose(30) + passage) for _ in range(25)]  # a shared passage is no copy
    base = prose(150)
    for _ in range(60):  # a large family
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"e{rng.randint(0, 99)}"
        texts.append(" ".join(words))
    texts += ["", None, " \n", "one two", "one two", "one two three"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = make(rows)
    want = brute_classes(rows, minhash_dedup.Weights(*minhash_dedup.frequencies(df)))
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(df).collect()}
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= len(texts) // 100


def test_block_similarities():
    rng = random.Random(9)
    weights = minhash_dedup.Weights(np.zeros(minhash_dedup.DF_BUCKETS), 10)
    sets = [weights.of(" ".join(rng.choice(["a", "b", "c", "d e"]) for _ in range(rng.randint(1, 80)))) for _ in range(20)]
    got = minhash_dedup.all_similarities([minhash_dedup.leveled(*s) for s in sets[:9]], [minhash_dedup.leveled(*s) for s in sets[9:]], columns=16)
    want = np.array([[minhash_dedup.similarity(a, b) for b in sets[9:]] for a in sets[:9]])
    assert np.allclose(got, want)


def test_word_hashes(monkeypatch):
    """One hash for one word, whatever the block size and the place; blanks as in the pattern of words."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab\u00e9 \t\n\x0b\x1c\u65e5\ud800") for _ in range(n)) for n in range(150)]
    texts += ["", " \r\f", "x" * 500, " ".join(map(str, range(5000)))]
    whole = [minhash_dedup.word_hashes(t).tolist() for t in texts]
    found = {}
    for text, hashes in zip(texts, whole, strict=True):
        words = WORD.findall(text)
        assert len(words) == len(hashes)
        assert all(found.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(found.values())) == len(found)
    for size in (1, 7, 64):
        monkeypatch.setattr(minhash_dedup, "_BLOCK", size)
        minhash_dedup._byte_tables.cache_clear()
        assert [minhash_dedup.word_hashes(t).tolist() for t in texts] == whole
    minhash_dedup._byte_tables.cache_clear()


def test_draws_agree_as_often_as_texts_do():
    rng, weights = random.Random(2), minhash_dedup.Weights(np.zeros(minhash_dedup.DF_BUCKETS), 10)
    same = want = 0.0
    for _ in range(60):
        words = [f"v{rng.randint(0, 10**6)}" for _ in range(200)]
        other = words[: rng.randint(100, 200)] + ["x"] * rng.randint(0, 20)
        a, b = weights.of(" ".join(words)), weights.of(" ".join(other))
        same += float((minhash_dedup.draw(*a[:2]) == minhash_dedup.draw(*b[:2])).mean())
        want += minhash_dedup.similarity(a, b)
    assert abs(same - want) / 60 < 0.03


def test_dedup_on_odd_and_empty(odd, empty):
    got = minhash_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id in (4, 5)} == {4}
    assert [r.kept for r in got if r.doc_id == 5] == [False]
    kept = minhash_dedup.without_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.without_duplicates(empty).count() == 0


# ---------------------------------------------------------------- packing


def check_plan(counts, capacity):
    plan = packing.plan_sequences(dict(counts), capacity)
    fill, seen = collections.defaultdict(list), collections.Counter()
    for length, lo, hi, per, sequence, offset in plan.rows:
        for r in range(lo, hi):
            fill[sequence + (r - lo) // per].append((offset + (r - lo) % per * length, length))
            seen[length] += 1
    assert seen == collections.Counter(counts) and set(fill) == set(range(plan.sequences))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return plan.sequences


def test_plans():
    rng = random.Random(3)
    for _ in range(40):
        check_plan({rng.randint(1, 64): rng.randint(1, 50) for _ in range(15)}, 64)
    counts = collections.Counter(min(4096, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(20_000))
    assert check_plan(counts, 4096) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 4096)


def check_packed(rows, texts, capacity=4096):
    """Round trip: ids of every text, cut as stated, gapless sequences."""
    tok, want = tokenizer("word_bpe_49k.json"), collections.Counter()
    for doc, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(doc, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packed_documents(spark, odd, empty):
    check_packed(packing.pack_documents(odd).collect(), [x[:2] for x in ODD])
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    rows = packing.pack_documents(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert check_packed(rows, docs) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack_documents(empty).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    scores = {r.doc_id: r.score for r in quality_model.quality_scores(docs, table(spark, sf, "labels")).collect()}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, sf)
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= quality_model.THRESHOLD}
    unique = stage["near_duplicates"](spark, good, sf)
    want = {r.doc_id for r in minhash_dedup.near_duplicates(good).where("kept").collect()}
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == want
    clean = stage["secrets"](spark, unique, sf)
    assert clean.columns == columns and clean.count() == unique.count()
    mixed = stage["mixture"](spark, clean, sf)
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in mixing.mix_documents(clean).collect() if r.copies})
    rows = stage["packing"](spark, mixed, sf).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in mixed.collect()])


def test_stages_on_odd_and_empty(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
        assert stage(spark, odd, "/root/testdata/sf0.001").count() >= 0, name


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in entry.queries()} and "pipeline" in entry.queries()
    assert duckdb and WORD
