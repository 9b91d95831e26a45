import hashlib
import math
import random
import zlib

from rungs.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows, siblings=5, most=9):
    """Rows of the trie, from dictionaries of whole prefixes."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = turns.get(c - int(math.fmod(c, siblings)), [])[:h] + v[h:]
    members, children = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in below)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made(spark, rows, **k):
    return sorted(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), **k).collect()))


def odd_rows():
    r, rows = random.Random(3), []
    for c in range(-7, 25):
        if r.random() > 0.15:
            rows += [(c, r.choice([t, t, t, None, 5]), r.choice(["u", "a", None]), r.choice(["", "x", "é", None])) for t in range(r.choice([0, 1, 3, 9, 20, 70]))]
    return rows + rows[:20] + [(None, 1, "u", "x")]


def test_deep_tries_of_every_band_height(spark):
    rows = odd_rows()
    for band in (2, 4, 16):
        assert made(spark, rows, band=band) == brute(rows)


def test_long_conversations_are_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "_RUN", 3)
    rows = odd_rows()
    assert made(spark, rows, band=4) == brute(rows)


def test_small_tables(spark):
    for rows in ([], [(None, 1, "u", "x")], [(5, 0, "u", "hi")], [(6, 0, "u", "hi")] * 3 + [(10**12, None, None, None)], [(5 * c, 0, "u", "same") for c in range(200)]):
        assert made(spark, rows) == brute(rows)


def test_other_columns_and_very_long_texts(spark):
    rows = [(c, t, "u", "ab" * 500_000 if t == 2 else "x") for c in (20, 21, 22) for t in range(12)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", key string, pos int")
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect())) == brute(rows)


def test_conversation_in_several_tasks(spark):
    rows = [(7, t, "u", "same") for t in range(300)] + [(7, 5, "u", "same")] * 300 + [(8, 1, "u", "z")]
    numbered = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.conv_id, r.pos) for r in numbered.collect()) == [(7, i) for i in range(1, 601)] + [(8, 1)]
    assert made(spark, rows) == brute(rows)
