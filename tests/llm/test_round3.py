"""Conversation trie, filter audit and shards against plain versions of their rules, and their handling of odd input."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from choicelab.llm import filter_audit, prefix_trie, sharding, substring_dedup
from choicelab.llm.text import slices


# --- conversation prefix trie -----------------------------------------------

def plain_trie(rows):
    """Every node by listing all prefixes of all rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(rs)] for c, rs in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    words = lambda text: len(text.encode().split())
    own_cost = {p: (len(m) - 1) * (words(p[-1][1]) if p else 0) for p, m in nodes.items()}
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own_cost[p]
    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(rebuilt[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


TRIE_SCHEMA = "conv_id long, turn long, role string, text string, segment int, depth int, id string"


def trie_rows(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TRIE_SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(df, **kw)
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got.collect()), key=str)


@pytest.mark.parametrize("block,segment", [(4, 256), (2, 2), (1, 3)])
def test_trie_matches_plain(spark, block, segment):
    """Shared beginnings of all lengths, whole copies, conversations of many blocks and segments."""
    rng = np.random.default_rng(block)
    starts = [[("user", f"hello {k} " * (k + 1)), ("assistant", f"hi {k}")] * 4 for k in range(3)]
    rows = []
    for c in range(90):
        path = list(starts[c % 3][:int(rng.integers(0, 9))]) + [("user", f"turn {int(rng.integers(0, 3))}") for _ in range(int(rng.integers(0, 4)))]
        path = path or [("user", "one")]
        if c % 10 == 4:
            path = starts[0] * 2
        rows += [(c * 2 + (c > 40) * 1000, i, r, t) for i, (r, t) in enumerate(path)]
    rows += [(5000 + c, i, "user", f"long {i}") for c in (0, 1, 7) for i in range(23 + c)]
    assert trie_rows(spark, rows, block=block, segment=segment) == plain_trie(rows)


def test_trie_of_odd_input(spark):
    """Null turn, role, text and conv_id, ties and repeated rows, negative ids, absent and short bases, white space of all kinds."""
    rows = [(20, None, None, None), (20, 1, "user", "a  b\tc"), (20, 1, "user", "a"), (21, 5, "user", "x"), (21, 5, "user", "x"), (22, 0, "us", "er"), (22, 0, "use", "r"),
            (None, 0, "user", "nobody"), (61, 0, "user", "no base"), (62, 0, "user", ""), (63, 3, "", ""), (-7, 0, "user", "minus"), (0, 0, "user", "zero"),
            (45, 0, "a", "only one"), (40, 0, "a", "    x"), (23, 1, "user", "w " * 30_000)]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, []) == []


def test_trie_of_turnless_conversations(spark):
    """Conversations whose own turns are all replaced by a base that does not exist are members of the root alone."""
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 400)}
    rows = [(c, 0, "user", "t") for c, h in heads.items() if h and c % 20][:9]
    got = trie_rows(spark, rows)
    assert got == plain_trie(rows) and len(got) == 1 and got[0][:6] == (rows[0][0], 0, None, 9, 0, 1)


def test_list_digests_over_batches(spark, monkeypatch):
    """Stretches of one node that end anywhere give the digest of the whole list."""
    monkeypatch.setattr(prefix_trie, "_BLOB", 8)
    import pyarrow as pa
    rows = [(b"a", c) for c in range(40)] + [(b"b", 7)]
    batches = [pa.record_batch([pa.array([r[0] for r in rows[i:i + 9]], pa.binary()), pa.array([r[1] for r in rows[i:i + 9]], pa.int64())], ["id", "conv_id"]) for i in range(0, 41, 9)]
    lists = list(prefix_trie._id_lists(iter(batches)))
    got = {k: v for b in prefix_trie._list_digests(iter(lists)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert got == {b"a": hashlib.sha256(",".join(map(str, range(40))).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}


# --- filter interaction audit -----------------------------------------------

def plain_audit(docs, labels):
    """Every order walked document by document."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = []
    for doc, text, source in docs:
        t = text or ""
        words = [w for w in t.encode().split()]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, _ in docs)}
        rows.append((source or "", {f for f, x in fails.items() if x}, doc in good, doc in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, value in out.items():
            if key[0] == part:
                value[6] = removed_by[value[6]]
    return {k: tuple(v) for k, v in out.items()}


AUDIT_SCHEMA = "doc_id long, text string, source string, part string, mask int, n int, good int, _first long"


def test_audit_matches_plain(spark):
    rng = np.random.default_rng(8)
    docs = []
    for k in range(160):
        n = int(rng.choice([3, 49, 50, 51, 120]))
        words = [f"w{x}" for x in rng.integers(0, int(rng.choice([20, 400])), n)]
        text = " ".join(words) + ("$" if rng.random() < 0.2 else "") + ("ABC" * 12 if rng.random() < 0.2 else "")
        docs.append((k, text, rng.choice(["a", "b", "", None])))
    docs += [(200 + k, docs[k % 5][1], "a") for k in range(40)]            # a large group of copies
    docs += [(None, docs[0][1], "a"), (None, None, None), (300, None, "b"), (301, "", "b"), (302, " \t\n", "b"), (303, "x", "c"), (303, "x", "c"), (304, "x", "c"), (305, "É" * 40 + "AB", "ü")]
    docs += [(306, "word " * 300_000 + "end", "long"), (307, " ".join(["nbsp"] * 60), "long")]
    labels = [(k, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for k in range(0, 240, 2)] + [(1, None, None), (2, 0, 0), (2, 1, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, "p", 1, 2, 3, 4) for d in docs], AUDIT_SCHEMA).repartition(5)
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(df, label_df).collect()}
    known = [row for row in labels if row[0] is not None]
    assert got == plain_audit(docs, known)
    assert filter_audit.audit(df.limit(0), label_df).count() == 0
    assert filter_audit.audit(df, label_df.limit(0)).filter("good_lost > 0 or toxic_lost > 0").count() == 0


def test_gray_walk_visits_every_subset():
    cells = np.random.default_rng(3).integers(0, 50, (4, 32, 3))
    states = filter_audit.gray_states(cells)
    for subset in range(32):
        want = cells[:, [m for m in range(32) if m & subset == 0]].sum(axis=1)
        assert (states[:, subset] == want).all()


def test_word_counts_of_long_texts(monkeypatch):
    raw = b"a b\x0bc\x0ca  \x1cd\r\n" * 50
    want = filter_audit.word_counts(raw)
    monkeypatch.setattr(filter_audit, "_PIECE", 10)
    assert filter_audit.word_counts(raw) == want == (len(raw.split()), len(set(raw.split())))


# --- shards -----------------------------------------------------------------

def jump(key, shards):
    """The published loop over 64-bit words."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards_match_the_published_loop(spark):
    rng = np.random.default_rng(1)
    keys = [0, 1, 2**32 - 1, 2**32, 2**64 - 1, 2**63, *map(int, rng.integers(0, 2**63, 3000))]
    df = spark.createDataFrame([(str(k), k >> 32, k & 0xFFFFFFFF) for k in keys], "k string, hi long, lo long")
    for shards in (1, 2, 7, 40):
        rows = df.select("k", sharding.jump_shards(df.hi, df.lo, shards).alias("s")).collect()
        for r in rows:
            assert (r.s.shard, r.s.grown) == (jump(int(r.k), shards), jump(int(r.k), shards + 1))
        moved = [r for r in rows if r.s.grown != r.s.shard]
        assert all(r.s.grown == shards for r in moved)
        assert abs(len(moved) / len(rows) - 1 / (shards + 1)) < 0.05


def test_assign(spark):
    """Slots are gapless, ids keep their shard, one row per row; nulls, empty and long texts, a repeated row that holds most of the table."""
    rows = [(k, f"text {k}") for k in range(300)] + [(7, "other")] * 3 + [(None, "n"), (None, "m"), (None, None), (301, None), (302, ""), (303, "é" * 100_000)] + [(9, "hot")] * 2000
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, shard int, slot int, _n int").repartition(4)
    got = sharding.assign(df).collect()
    want = sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    by_shard, of_id = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        of_id.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert all(len(s) == 1 for s in of_id.values())
    assert sorted(map(str, sharding.assign(df.repartition(2)).collect())) == sorted(map(str, got))
    assert sharding.assign(df.limit(0)).count() == 0


def test_assign_deals_repeated_rows_in_portions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    got = sharding.assign(spark.createDataFrame([(1, "a")] * 30 + [(2, "b")], "doc_id long, text string"), shards=1).collect()
    assert sorted(r.slot for r in got) == list(range(31)) and {r.shard for r in got} == {0}


def test_with_shard(spark):
    df = spark.createDataFrame([(k, "x") for k in range(50)], "doc_id long, text string")
    named = {r.doc_id: r.shard for r in sharding.with_shard(df, 13).collect()}
    assert named == {r.doc_id: r.shard for r in sharding.assign(df, 13).collect()}


# --- repeated passages ------------------------------------------------------

def test_contexts_of_any_length(spark):
    words = [f"{k % 7}{'x' * (k % 3)}" for k in range(3000)]
    one, two = " ".join(words), " ".join([*words[:2500], "other", *words[2501:]])
    rows = [(doc, 0, 0, side, 9, doc == 1, bytearray(f(text).encode()))
            for doc, text in ((1, one), (2, two)) for side, f in (("R", lambda t: f". {t} "), ("L", lambda t: f" {t[::-1]} ."))]
    contexts = spark.createDataFrame(rows, "doc_id long, text_key long, place int, side string, digest long, asks boolean, bytes binary")
    got = {r.side: sorted(s.n for s in r.steps) for r in substring_dedup._shared_steps(contexts).collect()}
    assert got == {"L": list(range(1, 2502)), "R": list(range(1, 2501))}  # to the left, the dot begins a word


def test_fringes_of_any_size():
    sizes = np.array([0, 49, 448, 10_000, 3_000_000])
    packed = substring_dedup._fringe(sizes, lambda reach: reach // 6)
    reach = (packed & ((1 << substring_dedup.REACH_BITS) - 1)) * substring_dedup.UNIT
    assert reach[0] == substring_dedup.AROUND and (reach[1:] >= sizes[1:] + 64).all() and (reach[1:] < sizes[1:] + 64 + substring_dedup.UNIT).all()
    assert (packed >> substring_dedup.REACH_BITS).tolist() == [85, 21, 85, 127, 127] and packed.max() < 2**31


def test_passages_against_all_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    owners, where = {}, {}
    for doc, text in texts.items():
        where[doc] = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
        for k in range(len(where[doc]) - 50):
            owners.setdefault(" ".join(text[a:b] for a, b in where[doc][k:k + 51]), set()).add(doc)
    want = {}
    for doc, text in texts.items():
        for k in range(len(where[doc]) - 50):
            if len(owners[" ".join(text[a:b] for a, b in where[doc][k:k + 51])]) > 1:
                want.setdefault(doc, set()).update(where[doc][k:k + 51])
    got = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        got.setdefault(r.doc_id, []).append((r.passage_start, r.passage_end))
    assert want
    missed = {doc: [w for w in words if not any(a <= w[0] and w[1] <= b for a, b in got.get(doc, []))] for doc, words in want.items()}
    assert not any(missed.values())
    assert len(set(got) - set(want)) <= 1  # a passage chained over several documents counts too


def test_steps_of_many_contexts_at_once():
    """Contexts cut together give the steps that each gives alone, whatever bytes are beside them."""
    around = [b"", b" ", b"a", b" ab cd ", "x é\tyz  w".encode(), b"ab", b"  a", b"a b", b"\xa9 q\nr "]
    contexts = [(side, x) for x in around for side in "LR"]
    (part,) = slices(pa.array([x for _, x in contexts], pa.binary()))
    of, number, start, stop = substring_dedup.word_ranges(part, np.array([side == "L" for side, _ in contexts]))
    got = {(k, n): part.data[a:b].tobytes() for k, n, a, b in zip(of.tolist(), number.tolist(), start.tolist(), stop.tolist())}
    want = {(k, n): x[len(x) - step:] if side == "L" else x[1:1 + step]
            for k, (side, x) in enumerate(contexts) if x for n, step in enumerate(substring_dedup.word_steps(side, x), 1)}
    assert got == want and len(got) == len(of)
