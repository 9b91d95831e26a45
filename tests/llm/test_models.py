"""Fingerprints, token files, neighbours, language and quality, against brute force, round trips and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rungs.llm import components, graph_ann, kn_quality, langid, simhash, token_output

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def brute_print(text, words=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_and_classes(spark):
    r = random.Random(1)
    docs = []
    for i in range(60):
        w = [r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(0, 80))]
        if i % 3 == 2:
            w = (docs[r.randrange(len(docs))][1] or "").split()
            if len(w) > 30:
                w[r.randrange(len(w))] = "zz"
        docs.append((i, " ".join(w) or None))
    docs += [(None, docs[5][1]), (99, "É A b"), (98, "é a B"), docs[4], (97, "A B C"), (96, "a\tb\nc")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, fp long, root long")
    rows = simhash.near_classes(df).collect()
    fps = [brute_print(t) for _, t in docs]
    assert Counter(x.fp & (2**64 - 1) for x in rows) == Counter(fps)
    root = {f: f for f in fps}
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                ra, rb = root[a], root[b]
                root = {k: ra if v == rb else v for k, v in root.items()}
    least = {v: min(d[0] for d, f in zip(docs, fps, strict=True) if root[f] == v and d[0] is not None) for v in set(root.values())}
    assert Counter((x.doc_id, x.component_id) for x in rows) == Counter((d[0], least[root[f]]) for d, f in zip(docs, fps, strict=True))
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(least.values()))  # one row each, of repeated rows too
    nulls = spark.createDataFrame([(None, "a b c", {"k": 1}), (None, "a b c", {"k": 2}), (None, "x y z u", None), (3, "x y z u", None)], "doc_id long, text string, m map<string,int>")
    assert sorted((x.doc_id or 0, x.text) for x in simhash.near_dedup(nulls).collect()) == [(0, "a b c"), (3, "x y z u")]
    assert simhash.near_classes(df.limit(0)).count() == 0


def test_near_copies_at_a_similarity_of_08(spark):
    r = random.Random(12)
    docs = []
    for i in range(40):
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        near, far = list(w), list(w)
        for k in range(3):
            near[30 + 60 * k] = "near"  # 15 of 196 shingles differ: 181 / 211
        for k in range(9):
            far[10 + 20 * k] = "far"  # 45 differ: 151 / 241
        docs += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id for x in simhash.near_dedup(df, words=5, bits=0, share=0.8).collect()}
    assert got == {d for d, _ in docs if d % 3 != 1}
    # the pipeline's own stage leaves none of the near copies
    import corpus_pipeline

    assert all(x.doc_id % 3 != 1 for x in corpus_pipeline.near_duplicates(spark, df, "").collect())


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_classes_of_large_groups_are_those_of_all_pairs(spark, seed):
    """Copies that are alike to their origin alone, more than a band's texts that are all compared, and a chain."""
    r = random.Random(seed)
    texts = []
    origin = [f"o{r.randrange(10**6)}" for _ in range(400)]
    texts.append(origin)
    for _ in range(200):
        w = list(origin)
        for k in range(6):
            w[r.randrange(60) + 65 * k] = f"v{r.randrange(10**6)}"  # 30 of 396 shingles
        texts.append(w)
    chain = [f"c{r.randrange(10**6)}" for _ in range(2400)]
    texts += [chain[30 * k : 30 * k + 400] for k in range(60)]
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_classes(df, words=5, bits=0, share=0.8).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) == 2


@pytest.mark.parametrize("pieces", [7, 128])
def test_no_link_is_lost_in_a_crowded_band(spark, monkeypatch, pieces):
    """Of 150 texts with the same key in the one band they have, pairs and triples that are alike to one another alone."""
    r = random.Random(9)
    origin = [f"o{r.randrange(10**6)}" for _ in range(400)]
    texts = [origin]
    for k in range(60):
        family = list(origin)
        for at in range(12):
            family[33 * at + r.randrange(20)] = f"f{r.randrange(10**6)}"  # under 0.8 to the origin and to other families
        for _ in range(2 + k % 2):
            w = list(family)
            w[100], w[300] = f"v{r.randrange(10**6)}", f"v{r.randrange(10**6)}"
            texts.append(w)
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if v in (x, y) else v for v in root]
    prints = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: prints(*args).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(simhash, "TEXTS", pieces, raising=False)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_classes(df, words=5, bits=0, share=0.8).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) == 61



@pytest.mark.parametrize("bits", [2, 4])
def test_trie_join(bits):
    g = np.random.default_rng(0)
    base = g.integers(0, 2**64, 120, dtype=np.uint64)
    near = [base ^ np.bitwise_or.reduce([np.uint64(1) << g.integers(0, 64, 120, dtype=np.uint64) for _ in range(k)]) for k in (1, 2, 3, 5)]
    a = np.unique(np.concatenate([base, *near, np.array([0, 1, 3, 2**63, 2**64 - 1], np.uint64)]))
    x, y = simhash.trie_pairs(a, None, bits, 0)
    want = np.bitwise_count(a[:, None] ^ a[None, :]) <= bits
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(zip(*[v.tolist() for v in np.nonzero(np.triu(want, 1))], strict=True))
    low, high = a[a < 2**63], a[a >= 2**63]
    x, y = simhash.trie_pairs(low, high, bits, 1)
    want = np.bitwise_count(low[:, None] ^ high[None, :]) <= bits
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(zip(*[v.tolist() for v in np.nonzero(want)], strict=True))


@pytest.mark.parametrize("crowd", [1, 200])
def test_pairs_over_many_leaves(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PIECE", 8)
    g = np.random.default_rng(5)
    base = g.integers(0, 2**64, 150, dtype=np.uint64)
    crowded = base[:2].repeat(60) ^ g.integers(0, 2**12, 120, dtype=np.uint64)  # nodes of many pieces
    a = np.unique(np.concatenate([base, crowded, base ^ (np.uint64(1) << g.integers(0, 64, 150, dtype=np.uint64)), base ^ np.uint64(2**63 + 1)]))
    got = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.near_pairs(spark.createDataFrame([(int(v),) for v in a.view(np.int64)], "fp long")).collect()}
    d = np.bitwise_count(a[:, None] ^ a[None, :])
    assert got == {(int(a[i]), int(a[j])) for i, j in zip(*np.nonzero(np.triu(d <= 2, 1)), strict=True)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, -5), (-5, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)} | {200: -5, 201: -5, -5: -5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    g = np.random.default_rng(2)
    for n in (1, 7, 8, 100, 4096):
        ids = g.integers(0, 50_257, n).astype(np.uint32)
        assert (token_output.ids_of(token_output.planes_of(ids, kind), kind) == ids).all()
    big = np.array([0, 2**32 - 1, 1], np.uint32)
    assert (token_output.ids_of(token_output.planes_of(big, kind), kind) == big).all()


ODD = ["", " ", "a  b", "a \n b\n\n c", "it's we'll  don't", "<|endoftext|> a b", "é è 12 3,4 5!?", " lead", "trail ", "\t\tx y", "a\x1c b \x1f c", "ab　c  d ́e", "٣ ४ ²½ a² b", "日本 語 テキスト", "\x00 \x7f a", "ⅷ Ⅷ ª º", "x\xa0 y \x85 z"]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    try:
        return tokenizers.Tokenizer.from_file(TOKENIZER)
    except Exception:
        pytest.skip("no tokenizer file")


def test_encoder_by_pieces_is_the_library_s(tokenizer):
    e = token_output.Encoder.of(TOKENIZER)
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("ab ,.'\n éß1\t") for _ in range(r.randrange(0, 60))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(spark, tmp_path, tokenizer, kind):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (100, "word " * 200), (3, "again")]
    df = spark.createDataFrame([(*d, 5) for d in reversed(docs)], "doc_id long, text string, shard int")
    path = token_output.write_tokens(df, f"{tmp_path}/{kind}", TOKENIZER, kind=kind, block_ids=16, chunk_ids=12)
    rows = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.start)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    at = 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        at += len(ids)
    digest = {(r.start, r.ids_crc32) for r in token_output.read_tokens(spark, path, digest=True).collect()}
    assert digest == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}
    index = token_output.chunk_index(spark, path)
    assert index.agg(F.sum("n_ids")).first()[0] == at and index.count() > 5
    assert token_output.token_digest(df.limit(0), TOKENIZER).count() == 0


def test_neighbours(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(900, 12)).astype(np.float32)
    x[100:300] = x[50]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[3].tolist()), (901, None), (902, []), (903, [0.0] * 12), (904, [float("nan")] * 12), (905, [None] * 12), (906, [float("inf")] * 12), (50, x[50].tolist()), (1000, [1.0, 2.0]), (1001, [1.5, 2.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, shard int")
    index = graph_ann.build_index(df, 11, shard_rows=200)
    assert index.count() > 3
    got = defaultdict(list)
    for r in graph_ann.search(index, df.where("vec_id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    hits = total = 0
    for q in range(0, 900, 50):
        far = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        order = np.lexsort((np.arange(900), far))[:10]
        hits += len({v for v, _ in got[q]} & set(order.tolist()))
        total += 10
        assert all(s == pytest.approx(far[v], abs=1e-12) for v, s in got[q]) and got[q] == sorted(got[q], key=lambda m: (m[1], m[0]))
    assert hits / total >= 0.95
    assert [v for v, _ in got[50]] == list(range(100, 110))
    assert got[1000] == [(1001, 0.5)]
    assert graph_ann.neighbours(df.limit(0)).count() == 0


WORDS = {"en": "the and of with that this from which have not", "de": "der die und mit das nicht von auf ist ein", "fr": "le la les dans que pour avec est une des"}


def lang_docs(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randrange(8, 40))), lang))
    return out


def test_language(spark):
    docs = lang_docs(400, 2) + [(1000, None, "en"), (1001, "", "de"), (1002, "123 ...", "fr"), (None, "the and of", None), (1003, "Ünïcödé", None)]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, lang_pred string, score long")
    rows = langid.language_rows(df).collect()
    assert len(rows) == len(docs)
    truth = {i: la for i, t, la in docs if i is not None and i < 1000}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (1000, 1001, 1002)} == {k: ("und", 0.0) for k in (1000, 1001, 1002)}
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    gone = {r.doc_id for r in df.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()}
    assert {1000, 1001, 1002} <= gone and len(gone - {1000, 1001, 1002, 1003}) <= 4
    assert langid.language_rows(df.limit(0)).count() == 0
    alone = langid.language_rows(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in alone} == {"und"}


def brute_kn(texts):
    cls = kn_quality._CLASS
    seqs = [[53] * 3 + [int(cls[b]) for b in t] for t in texts]
    tables = {4: Counter(tuple(s[i - 3 : i + 1]) for s in seqs for i in range(3, len(s)))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def cut(table):
        n = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(k, max(0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]

    d = {n: cut(t) for n, t in tables.items()}
    off = lambda n, c: min(c, d[n][min(c, 3) - 1])
    by = {n: defaultdict(list) for n in tables}
    for n, t in tables.items():
        for g, c in t.items():
            by[n][g[:-1]].append(c)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 64
        seen = by[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        c, total = tables[n].get(g, 0), sum(seen)
        return (max(0, c - off(n, c)) if c else 0) / total + sum(off(n, x) for x in seen) / total * p(g[1:])

    return p


def test_kneser_ney(spark):
    texts = ["the cat sat on the mat.", "the dog sat\non the cat", "Émile, 42 cats!", "aaaa aaaa aab"] * 2 + ["one more, and odd"]
    table = kn_quality.log_table(kn_quality.probabilities(kn_quality.gram_counts(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))))
    p = brute_kn([t.encode() for t in texts])
    r = random.Random(1)
    grams = [tuple(r.randrange(64) for _ in range(4)) for _ in range(200)] + [tuple(int(kn_quality._CLASS[b]) for b in t.encode()[:4]) for t in texts]
    for g in grams:
        at = (g[0] << 18) | (g[1] << 12) | (g[2] << 6) | g[3]
        assert math.exp(table[at]) == pytest.approx(p(g), rel=1e-4)
    assert np.exp(table.reshape(-1, 64).astype(float)).sum(axis=1) == pytest.approx(np.ones(64**3), abs=1e-3)


def test_quality(spark):
    r = random.Random(4)
    good = [(i, " ".join(r.choice(WORDS["en"].split()) for _ in range(40)) + ".", "en") for i in range(120)]
    bad = [(i, "".join(r.choice("XQZ#@!~^") for _ in range(80)), "en") for i in range(200, 220)]
    docs = [*good, *bad, (300, None, "en"), (301, "", None), (None, "the and of with", None)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0, 0) for i in range(0, 220, 2)] + [(0, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in kn_quality.quality(df, labels).collect()}
    assert len(rows) == len(docs)
    assert all(rows[i].keep for i, _, _ in good) and not any(rows[i].keep for i, _, _ in bad)
    assert (rows[300].perplexity, rows[300].keep, rows[301].keep) == (None, False, False)
    assert rows[None].threshold is not None
    none = kn_quality.quality(df, labels.limit(0)).collect()
    assert sum(x.keep for x in none) == len(docs) - 2 and all(x.threshold is None for x in none)
    assert kn_quality.quality(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("slots", [3, 21])
def test_perplexities_are_those_of_a_model_of_all_bytes(spark, monkeypatch, slots):
    monkeypatch.setattr(kn_quality, "SLOTS", slots)  # with 8 slots, nearly all grams are joined
    train = ["the cat sat on the mat 1357.", "\u0434\u043e\u043c \u0438 \u043a\u043e\u0442", "\u00c9mile, 1357 cats!", "aaaa aaaa aab"] * 2 + ["one 13 more", "\0\0\0\0\0"]
    tables = {4: Counter(s[i - 3 : i + 1] for s in (b"\n\n\n" + t.encode() for t in train) for i in range(3, len(s)))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cuts = {}
    for n, t in tables.items():
        m = [sum(c == k for c in t.values()) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[1] else 0
        cuts[n] = [min(k, max(0, k - (k + 1) * y * m[k] / m[k - 1])) for k in (1, 2, 3)] if all(m) else [0.5, 1.0, 1.5]

    def p(g):
        if not g:
            return 1 / 256
        t, cut = tables[len(g)], cuts[len(g)]
        seen = [c for k, c in t.items() if k[:-1] == g[:-1]]
        if not seen:
            return p(g[1:])
        off = lambda c: min(c, cut[min(c, 3) - 1])
        c = t.get(g, 0)
        return ((c - off(c)) if c else 0) / sum(seen) + sum(map(off, seen)) / sum(seen) * p(g[1:])

    texts = ["the cat 1357", "the cat 2468", "\u0434\u043e\u043c", "\u0436\u044d\u0447", "\0\0\0\0", "\0", "zq", None, "", "the cat 1357"]
    df = spark.createDataFrame([(i if i else None, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = kn_quality.probabilities(kn_quality.gram_counts(spark.createDataFrame([(t,) for t in train], "text string"), 8), 8)
    got = {x.doc_id or 0: x.perplexity for x in kn_quality.perplexities(df, model).collect()}
    for i, t in enumerate(texts):
        s = b"\n\n\n" + (t or "").encode()
        logs = [math.log(max(1e-12, p(s[k - 3 : k + 1]))) for k in range(3, len(s))]
        assert got[i] == (pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6) if t else None)
    assert got[0] < 0.7 * got[1] and got[2] < 0.7 * got[3]  # classes made digits alike, and letters of other alphabets


def test_thresholds_and_keep_are_what_brute_force_gives(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["aa", "bb", None]), r.choice([None, math.exp(r.uniform(0.5, 3))])) for i in range(300)]
    got = {x.lang: x.threshold for x in kn_quality.thresholds(spark.createDataFrame(rows, "doc_id long, lang string, perplexity double"), 0.9, 1.1).collect()}
    for lang in ("aa", "bb", None):
        bins = sorted(math.floor(math.log(p) / kn_quality.STEP) for _, k, p in rows if p is not None and lang in (k, None))
        at = next(b for i, b in enumerate(bins) if sum(x <= b for x in bins) >= 0.9 * len(bins))
        assert got[lang] == pytest.approx(1.1 * math.exp((at + 1) * kn_quality.STEP))
    # of the whole operator: the same limits from the perplexities that it gives, and keep by them
    words = ["red", "green", "blue", "one", "two", "three"]
    docs = [(i, r.choice(["aa", "bb"]), " ".join(r.choice(words) for _ in range(30)) if i % 7 else "".join(r.choice("zqxjkv@#") for _ in range(60))) for i in range(200)] + [(None, "aa", "red green"), (300, "cc", "one two"), (301, "aa", None), (302, "aa", "")]
    labels = [(i, 1, 0) for i in range(0, 160) if i % 7] + [(170, 0, 0), (None, 1, 0)]
    df, lab = spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = kn_quality.quality(df, lab, 0.9, 1.1).collect()
    held = {x._id for x in spark.createDataFrame([(i,) for i, q, _ in labels if q == 1 and i is not None], "_id long").where("pmod(xxhash64(_id), 5) = 0").collect()}
    judged = [(x.lang, x.perplexity) for x in out if x.doc_id in held and x.perplexity is not None]
    for x in out:
        own = [p for k, p in judged if k == x.lang] or [p for _, p in judged]
        bins = sorted(math.floor(math.log(p) / kn_quality.STEP) for p in own)
        at = next(b for b in bins if sum(y <= b for y in bins) >= 0.9 * len(bins))
        assert x.threshold == pytest.approx(1.1 * math.exp((at + 1) * kn_quality.STEP))
        assert x.keep == (x.perplexity is not None and x.perplexity <= x.threshold)
    assert sum(not x.keep for x in out if x.doc_id is not None and x.doc_id < 200 and x.doc_id % 7 == 0) > 20


@pytest.mark.parametrize("size", [1e200, 1e-170, 1.7e308, 5e-324])
def test_vectors_of_any_size_are_searched(spark, size):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(-1, 1, (30, 4)) * 8) * (size if size < 1e-300 else size / 8)
    x[0] = [size, 0, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph_ann.search(graph_ann.build_index(df, 11), df.where("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [i for i in (0, 10, 20) if x[i].any()]
    for q, rows in got.items():
        with np.errstate(over="ignore"):
            want = sorted((float(graph_ann.distances(x[i : i + 1], x[q])[0]), i) for i in range(30) if i != q and x[i].any())[:10]
        assert [(s, i) for _, i, s in sorted(rows)] == want


def test_distances_are_plain_ones_where_these_are_in_range():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=64)
    assert (graph_ann.distances(x, q) == np.sqrt(((x - q) ** 2).sum(axis=1))).all()


def test_signs_that_are_no_letters_have_no_language(spark):
    model = langid.fit(langid.training_rows(spark.createDataFrame(lang_docs(300, 3), "doc_id long, text string, lang string")))
    assert {model.predict(t) for t in ("½ ² Ⅷ", "123 ...", "_", "①")} == {("und", 0.0)} and model.predict("é")[0] != "und"


def test_sample_and_calibration_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_A_LANGUAGE", 30)
    docs = lang_docs(400, 4)
    docs += docs[:40] + [(900 + i, f"word{i} rare", f"x{i}") for i in range(300)]  # many languages of one row
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    hashed = df.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).distinct().collect()
    want = {}
    for la in {r.lang for r in hashed}:
        for r in sorted((r for r in hashed if r.lang == la), key=lambda r: r.h)[:30]:
            want[r.lang, r.h] = Counter(langid.subwords(r.text).tolist())
    sample = langid.training_rows(df)
    assert len(sample["lang"].unique()) > 300  # none is left out
    got = {(r.lang, r.h): dict(zip(np.frombuffer(r.hashes, np.int32).tolist(), np.frombuffer(r.counts, np.int32).tolist(), strict=True)) for r in sample.itertuples()}
    assert got == {k: dict(v) for k, v in want.items()}
    monkeypatch.setattr(langid, "BYTES", 4000 * len(sample["lang"].unique()))
    fewer = langid.training_rows(df)
    for la, rows in sample.groupby("lang"):
        sizes = (rows["hashes"].str.len() + rows["counts"].str.len()).cumsum().shift(fill_value=0)
        assert fewer[fewer["lang"] == la]["h"].tolist() == rows["h"][sizes < 4000].tolist()
    common = sample[~sample["lang"].str.startswith("x")].reset_index(drop=True)
    model = langid.fit(common)
    valid = [(r.lang, np.repeat(np.frombuffer(r.hashes, np.int32), np.frombuffer(r.counts, np.int32))) for i, r in enumerate(common.itertuples()) if i % 5 == 4]

    def chances(t):
        for la, h in valid:
            z = model.logits(h) / t
            p = np.exp(z - z.max())
            yield la, p / p.sum()

    loss = {t: np.mean([-np.log(max(p[model.languages.index(la)], 1e-12)) for la, p in chances(t)]) for t in np.geomspace(0.05, 5, 40)}
    assert loss[min(loss, key=lambda t: abs(t - model.temperature))] <= min(loss.values()) + 1e-4
    right = [p.max() for la, p in chances(model.temperature) if model.languages[p.argmax()] == la]
    assert model.threshold == pytest.approx(min(0.5, 0.5 * np.quantile(right, langid.REJECTED)), rel=1e-3)
