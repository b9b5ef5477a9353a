"""Vector codes, the prefix trie and binary packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from leadsieve.llm import binary_packing, minhash_dedup, prefix_trie, vector_codes
from leadsieve.llm.common import table, tokenizer
from tests.llm.conftest import LONG, ODD

# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error double"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds over all distances, in integers."""
    whole = [(i, [math.floor(4096 * float(np.float32(a))) for a in v], label) for i, v, label in rows]
    seeds = {}
    for i, v, _ in sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        seeds.setdefault(i, v)
    seeds = list(seeds.values())[:entries]
    x, cut = np.array([v for _, v, _ in whole]), vector_codes.spans(len(whole[0][1]), parts)
    books = [np.array(seeds)[:, s] for s in cut]

    def assigned(p):
        d = ((x[:, None, cut[p]] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = assigned(p)
            for k in range(len(seeds)):
                mine = x[at == k][:, cut[p]]
                if len(mine):
                    books[p][k] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    final = [assigned(p) for p in range(parts)]
    by_label, out = {}, []
    for n, (i, _, label) in enumerate(whole):
        error = int(sum(d[n] for _, d in final))
        by_label[label] = by_label.get(label, 0) + error
        out.append([i, "".join(f"{at[n]:02x}" for at, _ in final), error, label])
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def test_vector_codes_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf_dir, "embeddings").collect()]
    got = entry.queries()["op11_vector_codes"](spark, sf_dir)
    assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows)


@pytest.mark.parametrize(("count", "dimensions"), [(5, 16), (90, 19), (40, 3)])
def test_vector_codes_of_odd_rows(spark, count, dimensions):
    rng = np.random.default_rng(count)
    good = [(i - 3, [float(np.float32(a)) for a in rng.integers(-4, 5, dimensions) / 4], None if i % 5 == 0 else i % 2) for i in range(count)]
    good += [good[1], good[1], (None, good[2][1], 1), (1, [0.125] * dimensions, 0)]
    bad = [(-50, None, 1), (-49, [float("nan")] + [1.0] * (dimensions - 1), 1), (-48, [None] + [1.0] * (dimensions - 1), 1)]
    bad += [(-47, [float("inf")] + [1.0] * (dimensions - 1), 0)]
    short = [(900, [1.0, 2.0], 1), (901, [], None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in good + bad + short], VECTORS).repartition(5)
    got = vector_codes.code_report(df).collect()
    fits = [tuple(r) for r in got if r.vec_id not in (900, 901)]
    assert sorted(fits, key=str) == plain_codes(good)
    rest = {r.vec_id: r for r in got if r.vec_id in (900, 901)}
    assert set(rest) == {900, 901} and all(r.code is None and r.error is None for r in rest.values())


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.code_report(none).count() == 0
    assert vector_codes.code_report(spark.createDataFrame([(1, None, 1, None, None)], VECTORS)).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 8, 1, None, None), (2, [-3e38] * 8, 1, None, None)], VECTORS)
    assert {r.error for r in vector_codes.code_report(huge).collect()} == {0}


def test_pivots_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    entries = rng.integers(-4000, 4000, (16, 8))
    parts = np.concatenate([entries[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 8)), (entries[:1] + entries[1:2]) // 2, entries])
    pivots = vector_codes.fixed_pivots(entries)
    at, best, tried = vector_codes.nearest(parts, vector_codes.distances(parts, pivots).astype(np.float32), entries, pivots)
    d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert tried < 0.25 * d.size  # most entries were never evaluated
    twins = np.repeat(entries[:1], 5, axis=0)
    at, _, _ = vector_codes.nearest(parts, vector_codes.distances(parts, twins[:1]), twins, twins[:1])
    assert (at == 0).all()


# ---------------------------------------------------------------- prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth string, k1 int"


def plain_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes, kids = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members, ends = nodes.setdefault(tuple(turns[:d]), ([], []))
            members.append(c)
            if d == len(turns):
                ends.append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    total, out = {}, []
    for k in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[k][0]) - 1) * (len(k[-1][1].encode()) if k else 0)
        below = [total[x] for x in kids.get(k, [])]
        total[k] = (sum(n for n, _ in below) or 1, saved + sum(s for _, s in below))
        digest = hashlib.sha256(",".join(map(str, sorted(nodes[k][1]))).encode()).hexdigest()
        parent = min(nodes[k[:-1]][0]) if k else None
        out.append((min(nodes[k][0]), len(k), parent, len(nodes[k][0]), len(kids.get(k, [])), *total[k], digest))
    return sorted(out, key=str)


def test_prefix_trie_of_the_table(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op12_prefix_trie"](spark, sf_dir)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns[:8] == names and len({t for _, t in got.drop("ends_sha256").dtypes}) == 1
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def odd_turns():
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "y", None, "é"])) for c in range(200) for t in range(rng.randint(0, 12))]
    rows += [(7, t, "u", f"z{t % 3}") for t in range(100, 600)]  # one conversation with a third of all turns
    rows += [(8, None, None, None), (None, 1, "u", "q"), (11, 1, "u", "long " * 50_000)]
    return rows + [(9, 5000, "u", "same")] * 200 + [(1000 + c, t, "u", f"t{t}") for c in range(60) for t in range(10)]


@pytest.mark.parametrize("how", [{}, {"shard_turns": 20, "band": 3, "in_memory": 5, "block": 3}, {"shard_turns": 0, "band": 2}])
def test_prefix_trie_of_odd_rows(spark, how):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(6)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df, **how).collect()), key=str) == plain_trie(rows)


def test_long_conversations_are_summed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 7)
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df, shard_turns=100).collect()), key=str) == plain_trie(rows)


def test_prefix_trie_without_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", None, None)], TURNS)).count() == 0


def test_node_texts(spark):
    df = spark.createDataFrame([(5, 0, "u", "a"), (5, 1, "a", "b"), (10, 0, "u", None)], "conv_id long, turn long, role string, text string")
    named = prefix_trie.node_texts(prefix_trie.prefix_trie(df), df).collect()
    assert {(r.conv_id, r.depth, r.role, r.text) for r in named} == {(5, 0, None, None), (5, 1, "u", "a"), (5, 2, "a", "b"), (10, 1, "u", "")}


@pytest.mark.parametrize("in_memory", [1, 3, 1000])
def test_spilling_queue(in_memory):
    rng, queue, plain = random.Random(5), prefix_trie.SpillingQueue(in_memory), []
    for _ in range(2000):
        if rng.random() < 0.55 or not plain:
            message = tuple(rng.randint(-5, 5) for _ in range(5))
            queue.push(message)
            plain.append(message)
        else:
            plain.sort()
            assert queue.first() == plain[0] and queue.pop() == plain.pop(0)
    assert [queue.pop() for _ in range(len(plain))] == sorted(plain) and queue.first() is None
    assert (queue.spilled > 0) == (in_memory < 1000)


# ---------------------------------------------------------------- binary packing


def test_binary_pieces():
    for n in [*range(1, 70), 4095, 4096, 4097]:
        pieces = binary_packing.binary_pieces(n, 16)
        assert [s for s, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))] and sum(x for _, x in pieces) == n
        assert len(pieces) == n // 16 + bin(n % 16).count("1") and all(x & (x - 1) == 0 and x <= 16 for _, x in pieces)


def expected_pieces(rows, capacity=2048):
    tok, out = tokenizer("byte_bpe_50k.json"), []
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for start, length in binary_packing.binary_pieces(len(ids), capacity):
            out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), 0))
    return sorted(out, key=str)


def pieces_of(df):
    rows = df.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)  # a sequence each
    return sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows), key=str)


def test_binary_packing_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = entry.queries()["op13_binary_packing"](spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces_of(got) == expected_pieces(rows)


def test_binary_packing_of_odd_rows(spark, odd, empty):
    assert pieces_of(binary_packing.binary_sequences(odd)) == expected_pieces([(r[0], r[1]) for r in ODD])
    assert binary_packing.binary_sequences(empty).count() == 0
    small = binary_packing.binary_sequences(odd, capacity=64, with_ids=True).collect()
    assert all(len(r.ids) == r.length <= 64 for r in small)
    with pytest.raises(ValueError):
        binary_packing.binary_sequences(odd, capacity=100)


def test_ids_are_the_librarys():
    encoder, rng = binary_packing.ByteEncoder("byte_bpe_50k.json"), random.Random(1)
    parts = [" ", " ", "  ", "\n", " \n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "\u200b", "\u3000", "\x1c", "\u180e", "a", "the", "'s", "'ll", "I'm"]
    parts += ["12", "½", "!?", "日本", "<|endoftext|>", "é", "é", "🙂", "ſ", "_", "Ⅷ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += [LONG, "日本語" * 30_000, "a" * 100_000, "x  日本 " * 20_000]
    for text in texts:
        assert np.array(encoder.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() == encoder.ids(text)


def test_buckets_and_batches(spark, sf_dir):
    sequences = binary_packing.binary_sequences(table(spark, sf_dir, "documents"), capacity=256).cache()
    sums = {r.length: r for r in binary_packing.buckets(sequences).collect()}
    assert sum(r.tokens for r in sums.values()) == sum(r.length for r in sequences.collect()) and abs(sum(r.share for r in sums.values()) - 1) < 1e-9
    rows = binary_packing.batches(sequences, 1024).collect()
    assert len(rows) == sequences.count()
    held = {}
    for r in rows:
        held.setdefault((r.length, r.batch), []).append(r.place)
    for (length, batch), places in held.items():
        last = batch == max(b for n, b in held if n == length)
        assert sorted(places) == list(range(len(places))) and (last or len(places) == 1024 // length)
    again = {(r.sequence_id, r.batch) for r in binary_packing.batches(sequences, 1024).collect()}
    assert again == {(r.sequence_id, r.batch) for r in rows}
    sequences.unpersist()


# ---------------------------------------------------------------- near-duplicates in large bands


def test_near_duplicates_around_a_common_passage(spark, monkeypatch):
    """Families that share a passage fill the same bands; every level of the blocks is used."""
    for name, size in (("SKETCH_SLICE", 20), ("SLICE", 6), ("SMALL", 4)):
        monkeypatch.setattr(minhash_dedup, name, size)
    rng, rows = random.Random(5), []
    for f in range(40):
        words = [f"c{i}" for i in range(60)] + [f"f{f}w{i}" for i in range(rng.choice([3, 6, 10, 30]))]
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(w if rng.random() > 0.004 else f"x{rng.random()}" for w in words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = minhash_dedup.Weights(*minhash_dedup.frequencies(df))
    sets, up = [weights.of(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if minhash_dedup.similarity(sets[i], sets[j]) >= minhash_dedup.THRESHOLD:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {i: top(i) for i in got} and len(got) == len(rows) > len(set(got.values())) > 1
