"""Operators that take texts apart, against brute force on small documents with nulls, copies and clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from rungs.llm import bwt, mixing, rolling, substring, tiling, winnow_lines

DOCS = "doc_id long, text string, source string, lang string, n_chars long, h long, th long, did long, runs string, tag string, copies long"


def frame(spark, docs):
    """(doc_id, text) with other columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else f"s{k % 3}", "en", None, 1, 2, 3, "x", "y", 4) for k, (i, t) in enumerate(docs)], DOCS)


def some_docs(seed, letters="abcd", sep=" ", n=40, most=60):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        w = [r.choice(letters) for _ in range(r.randrange(0, most))]
        if i % 6 == 4:
            w = w[:9] + ((docs[r.randrange(len(docs))][1] or "").split(sep) if sep else list(docs[r.randrange(len(docs))][1]))[:25]
        docs.append((i, sep.join(w)))
    return [*docs, (None, docs[3][1]), (None, None), (90, None), (91, ""), (92, "é" * 30), docs[7], (5, docs[8][1] + sep + "z"), (95, sep.join(["q"] * 300))]


def test_substring_words(spark):
    docs = some_docs(1)
    for length, short in ((5, 3), (6, 1), (3, 3)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in substring.drop_repeats(frame(spark, docs), length, short).collect())
        key = lambda i: -(2**63) if i is None else i
        first = {}
        for i, t in docs:
            w = (t or "").split()
            for p in range(len(w) - length + 1):
                first[tuple(w[p : p + length])] = min(first.get(tuple(w[p : p + length]), 2**63), key(i))
        want = []
        for i, t in docs:
            w = (t or "").split()
            gone = [False] * len(w)
            for p in range(len(w) - length + 1):
                if first[tuple(w[p : p + length])] < key(i):
                    gone[p : p + length] = [True] * length
            want.append((i is None, i or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
        assert got == sorted(want)


@pytest.mark.parametrize("short", [2, 3, 7])
def test_substring_with_other_first_lengths(spark, short):
    docs = some_docs(11)
    rows = sorted(map(str, substring.drop_repeats(frame(spark, docs), 9, 4).collect()))
    assert sorted(map(str, substring.drop_repeats(frame(spark, docs), 9, short).collect())) == rows
    # texts without an id are each their own
    nulls = [(None, t) for _, t in docs]
    assert all(x.n_removed == 0 for x in substring.drop_repeats(frame(spark, nulls), 9, short).collect())


def test_substring_of_a_stretch_that_one_document_has_twice(spark):
    r = random.Random(11)
    for _ in range(3):
        z, p, x, y = ([f"w{r.randrange(10**6)}" for _ in range(30)] for _ in range(4))
        # the second row of id 5 holds the stretch once more, and is no earlier document of the first
        docs = [(1, z + p), (5, x + p + x + p), (5, y + p)]
        got = sorted((r.doc_id, r.n_removed, r.text) for r in substring.drop_repeats(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect())
        assert got == sorted([(1, 0, " ".join(z + p)), (5, 60, " ".join(x + x)), (5, 30, " ".join(y))])


def brute_bytes(texts, length):
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((k, p))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if len(seen[t[p : p + length]]) > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("most", [20_000, 1])  # 1: every anchor with several surroundings goes window by window
def test_byte_strings(spark, most):
    docs = some_docs(2, letters="abc", sep="", most=90)
    for length in (12, 7) if most > 1 else (12,):
        rows = bwt.drop_repeats(frame(spark, docs), length, most).collect()
        got = sorted((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows)
        assert got == sorted(brute_bytes([(t or "").encode() for _, t in docs], length))


def test_parts_of_long_texts(spark):
    r = random.Random(9)
    long = "".join(r.choice("ab") for _ in range(500))
    docs = [(1, long), (2, long[100:300] + "x" + long[310:420])]
    rows = bwt.anchors(bwt.keyed(spark.createDataFrame(docs, "doc_id long, text string")), 20, span=64).collect()
    # the windows of all parts, once each
    assert sorted(p for x in rows if x.did == 1 for p in range(x.first, x.after)) == list(range(500 - 20 + 1))


def test_merge_of_orders_is_sorted_and_gives_common_prefixes():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab") for _ in range(24)) for _ in range(60)]
    blocks = np.sort(np.array([r.randrange(3) for _ in strings]))
    order, common = bwt.interleave(blocks, bwt._words(strings, 0, 24), 0)
    keys = [(blocks[i], strings[i]) for i in order]
    assert keys == sorted(keys)
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        want = next((k for k in range(24) if a[k] != b[k]), bwt._NEVER)
        assert common[i] == (-1 if blocks[order[i - 1]] != blocks[order[i]] else want)


def test_lines(spark):
    r = random.Random(6)
    base = [f"line {k}" for k in range(12)] + ["", "  "]
    docs = [(i, "\n".join(r.choice(base) for _ in range(r.randrange(0, 12)))) for i in range(30)]
    docs += [(None, None), (40, None), (41, ""), (None, docs[3][1]), (43, "line 3"), (44, " line 3"), (42, "  " + docs[4][1].replace("\n", " \n\t"))]
    for run in (1, 2, 3):  # 1: single lines, and copies of texts of one line
        rows = winnow_lines.drop_repeats(frame(spark, docs), run).collect()
        key = {id(d): (-(2**63) if d[0] is None else d[0], k) for k, d in enumerate(docs)}
        first = {}
        for d in docs:
            b = [x.strip() for x in (d[1] or "").split("\n") if x.strip()]
            for p in range(len(b) - run + 1):
                w = tuple(b[p : p + run])
                at = (key[id(d)][0], p)
                first[w] = min(first.get(w, at), at)
        want = []
        for d in docs:
            every = (d[1] or "").split("\n")
            ink = [j for j, x in enumerate(every) if x.strip()]
            out = set()
            for p in range(len(ink) - run + 1):
                if first[tuple(every[j].strip() for j in ink[p : p + run])] < (key[id(d)][0], p):
                    out |= set(ink[p : p + run])
            want.append((len(ink), len(out), "\n".join(x for j, x in enumerate(every) if j not in out)))
        # two rows without id, one of them empty: no ties between texts of one id here
        assert sorted((x.n_lines, x.n_removed, x.text) for x in rows) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for f in (substring.drop_repeats, bwt.drop_repeats, winnow_lines.drop_repeats, mixing.mix, mixing.mixed_documents):
        assert f(none).count() == 0


def test_tiles():
    a = list(range(20))
    assert tiling.tiles(a, a, 5) == [(0, 0, 20)]
    moved = a[10:] + [-1] + a[:10]
    assert sorted(tiling.tiles(a, moved, 5)) == [(0, 11, 10), (10, 0, 10)]
    assert tiling.tiles(a, a[:4] + [99] + a[4:8], 5) == []
    # a part that comes twice covers its place once
    assert sum(t[2] for t in tiling.tiles(a, a[:6] + [-1] + a[:6], 5)) == 6


def test_decontamination(spark):
    words = [f"word{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:20])), (2, None), (3, "too few words"), (4, " ".join(words[20:]))], "item_id long, text string")
    docs = [
        (1, "x " * 50 + " ".join(words[:20]).upper() + ", y"),  # whole, in capitals
        (2, " ".join(words[10:20]) + " and then " + " ".join(words[:10])),  # reordered
        (3, " ".join(words[:15])),  # three quarters
        (4, " ".join(words[:17])),
        (5, " ".join(w for x in zip(words[:20], words[20:], strict=True) for w in x)),  # every word, in no order
        (6, None), (7, ""), (None, "\n".join(words[20:])), (8, " ".join(words)),
    ]
    got = sorted((r.doc_id or 0, r.item_id, round(r.coverage, 2), len(r.tiles)) for r in tiling.contaminated(frame(spark, docs), bench).collect())
    assert got == [(0, 4, 1.0, 1), (1, 1, 1.0, 1), (2, 1, 1.0, 2), (4, 1, 0.85, 1), (8, 1, 1.0, 1), (8, 4, 1.0, 1)]
    clean = tiling.decontaminate(frame(spark, docs), bench)
    assert clean.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6, 7]
    named = spark.createDataFrame([("d", " ".join(words[:20]), {"k": 1}), ("e", "clean", None)], "doc_id string, text string, th map<string,int>")
    assert [x.doc_id for x in tiling.decontaminate(named, bench).collect()] == ["e"]
    assert tiling.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    assert tiling.decontaminate(frame(spark, docs), bench.limit(0)).count() == len(docs)


def brute_tiling(own, words, least):
    """Words of own under greedy tiles: the longest common run of unmarked words first, leftmost in own, then in words."""
    free, there, got = [True] * len(own), [True] * len(words), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(own)):
            for j in range(len(words)):
                k = 0
                while i + k < len(own) and j + k < len(words) and free[i + k] and there[j + k] and own[i + k] == words[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return got
        free[i : i + k] = [False] * k
        there[j : j + k] = [False] * k
        got += k


@pytest.mark.parametrize("bits", [6, 26])
def test_contaminated_is_what_brute_force_finds(spark, monkeypatch, bits):
    monkeypatch.setattr(tiling, "FILTER_BITS", bits)  # with 6, nearly everything passes the filter
    r = random.Random(21)
    items = [(k, " ".join(r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(r.randrange(1, 30)))) for k in range(12)] + [(3, "a b c d e f"), (None, "a b c d e f"), (50, None), (51, ""), (52, "...")]
    docs = []
    for i in range(60):
        w = [r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(r.randrange(0, 30))]
        for _ in range(r.randrange(3)):  # parts of an item, in any order
            own = r.choice(items)[1] or ""
            own = own.split()
            cut = r.randrange(len(own) + 1)
            w += own[cut:] + [f"x{i}"] * r.randrange(2) + own[:cut]
        docs.append((i, " ".join(w) or None))
    docs += [(None, items[4][1]), (7, items[5][1]), (7, items[5][1]), (90, "A, b; c! D e (f)"), (91, items[0][1] + " more")]
    bench = spark.createDataFrame([(k, t, 9) for k, t in items], "item_id int, text string, row int")
    want = []
    for d, t in docs:
        words = tiling.plain(t).split()
        for k, item in items:
            own = tiling.plain(item).split()
            least = min(5, len(own))
            if own and (words == own if len(own) < 5 else brute_tiling(own, words, least) >= 0.8 * len(own)):
                want.append((d, k))
    got = tiling.contaminated(frame(spark, docs), bench)
    assert sorted(map(str, ((x.doc_id, x.item_id) for x in got.collect()))) == sorted(map(str, want))
    assert dict(got.dtypes)["item_id"] == "int" and len(want) > 10
    clean = tiling.decontaminate(frame(spark, docs), bench)
    out = {d for d, _ in want}
    assert sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(d) for d, t in docs if d not in out)


def test_items_are_looked_up_by_their_rarest_seeds(spark):
    r = random.Random(8)
    for _ in range(200):  # without these seeds, too few words are under the others; with one turn less, enough are
        n, least = r.randrange(1, 40), 5
        words = np.array([r.randrange(6) for _ in range(n)], np.uint64)
        found = tiling.seeds(words, least)
        docs = np.array([int(h) % 7 for h in found.tolist()])
        chosen = set(tiling.telling(found, docs, n, 0.8).tolist())

        def under(gone, found=found, n=n):
            least = n - len(found) + 1
            return len({i + k for i, h in enumerate(found.tolist()) if h not in gone for k in range(least)})

        assert under(chosen) / n < 0.8
        last = max(chosen, key=lambda h: (docs[found.tolist().index(h)], h))
        assert under(chosen - {last}) / n >= 0.8
        assert all(docs[found.tolist().index(h)] <= docs[found.tolist().index(last)] for h in chosen)
    # a phrase that all items and documents have looks nothing up, and no copy is lost
    stock = " ".join(f"stock{k}" for k in range(9))
    items = [(k, f"{stock} " + " ".join(f"i{k}w{j}" for j in range(11))) for k in range(30)]
    docs = [(d, f"{stock} and " + " ".join(f"d{d}w{j}" for j in range(9))) for d in range(300)] + [(1000 + k, t) for k, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = tiling.item_table(bench, 5, "item_id", "text")
    hits = tiling.seeded(frame(spark, docs).selectExpr("doc_id", "text", "th"), tiling.seed_filter(table.selectExpr("explode(seeds) h")), 5)
    told = tiling.lookup(table, hits, 0.8)
    common = set(tiling.seeds(rolling.words(stock.encode())[2], 5).view(np.int64).tolist())
    assert told.count() and not common & {x.h for x in told.collect()}
    assert sorted((x.doc_id, x.item_id) for x in tiling.contaminated(frame(spark, docs), bench).collect()) == [(1000 + k, k) for k in range(30)]


def brute_mix(docs, weights=(3, 1, 2), share=1.5, most=2):
    size = [len((t or "").split()) for _, t, _ in docs]
    names = sorted({s for _, _, s in docs if s is not None}) + ([None] if any(s is None for _, _, s in docs) else [])
    total = {n: sum(z for z, d in zip(size, docs, strict=True) if d[2] == n) for n in names}
    w = {n: float(weights[k % len(weights)]) for k, n in enumerate(names)}
    target, left, room = {}, set(names), share * sum(size)
    while True:
        over = [n for n in left if room * w[n] / sum(w[x] for x in left) > most * total[n]]
        if not over:
            break
        for n in over:
            target[n] = float(most * total[n])
        left -= set(over)
        room = share * sum(size) - sum(target.values())
    target |= {n: room * w[n] / sum(w[x] for x in left) for n in left}
    return target, total


def test_mix_targets_and_words_taken(spark):
    r = random.Random(8)
    docs = [(i, " ".join(["w"] * r.randrange(0, 40)) or None, r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(300)] + [(7, "x y", "a"), (None, "x", "a"), (None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    target, total = brute_mix(docs)
    assert len(rows) == len(docs)
    assert {x.source: x.target for x in rows} == pytest.approx(target)
    for n in target:
        taken = sum(x.taken for x in rows if x.source == n)
        assert abs(taken - target[n]) <= 80 and total[n] == next(x.source_size for x in rows if x.source == n)
    assert all(0 <= x.taken <= 2 * x.size for x in rows)
    assert sum(x.taken for x in rows) <= 1.5 * sum(total.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df).collect()))
    whole = mixing.mixed_documents(df)
    assert whole.columns == df.columns
    assert whole.count() == sum(x.copies for x in rows)


def test_mixing_keeps_map_columns_and_an_empty_source(spark):
    docs = [(1, "a b c", "s", {"k": 1}), (2, "a", "s", None), (3, None, "none", {"k": 2}), (4, "", "none", {}), (5, "x y", None, {"k": 3})]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tag map<string,int>")
    rows = {x.doc_id: x for x in mixing.mix(df).collect()}
    assert {k: rows[k].taken for k in (3, 4)} == {3: 0, 4: 0} and rows[3].target == 0
    assert sum(x.taken for x in rows.values()) <= 9
    whole = mixing.mixed_documents(df)
    assert whole.columns == df.columns and {x.doc_id for x in whole.collect()} <= {1, 2, 5}


def test_mixing_in_small_buckets_is_the_same(spark, monkeypatch):
    docs = [(i if i % 9 else None, " ".join(["w"] * (i % 17 if i % 3 else 1)), f"s{min(i % 40, 3)}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    whole = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert sorted(map(str, mixing.mix(df).collect())) == whole


def test_rolling_hashes():
    r = random.Random(3)
    data = bytes(r.choice(b"ab \n") for _ in range(400))
    start, end, h = rolling.words(data)
    assert [data[a:b] for a, b in zip(start, end, strict=True)] == data.split()
    by = {}
    for w, x in zip(data.split(), h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    v = np.array([r.randrange(9) for _ in range(97)], np.uint64)
    for width in (1, 4, 10, 97, 98):
        got = rolling.least_of(v << np.uint64(40), width).tolist()
        assert got == [min(range(i, i + width), key=lambda k: (v[k], k)) for i in range(len(v) - width + 1)]


def test_digest_of_whole_op3(spark):
    out = substring.drop_repeats(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest()[:6] for r in out) == sorted(hashlib.sha256(x).hexdigest()[:6] for x in (b"a b", b""))
