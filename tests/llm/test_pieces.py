import hashlib
import random

import numpy as np
import pytest

from rungs.llm import pieces, queries

spm = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "   ", "  a", "\n\t x  y ", "▁▁a▁ b", "日本語 テスト", "\0a\0", "🙂🙂 x", "é ñ½²Ⅷ", "a" * 3000, "ﷺ", "<s> </s> <unk> <0x41>", "x" * 10 + "   y", " " * 50, "　a b", "ab" * 100_000 + " c" * 1000]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(queries.tokenizer("piece_bpe_32k.model"))


def random_texts(n, pool="ab e tin▁ \n日é🙂\0th½"):
    r = random.Random(1)
    return ["".join(r.choice(pool) for _ in range(r.randrange(30))) for _ in range(n)]


def test_ids_and_spans_are_the_library_s(own, library):
    for t in [t or "" for t in ODD] + random_texts(1500):
        ids, begins, ends = own.encode([t.encode()])[0]
        want = library.encode(t, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want] == library.encode(t)
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in want]
        assert own.decode(ids) == library.decode(ids.tolist())


def test_units_are_merged_apart(own, library):
    for t in random_texts(500, "thereinaonst "):
        form = own.normalizer.normalize(t.encode())[0].decode()
        assert [p for u in own._unit.findall(form) for p in own.merged(u)] == library.encode(t, return_type=str)


def test_any_ids_are_decoded_as_the_library_does(own, library):
    r = random.Random(2)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3), 259, 29871]) for _ in range(r.randrange(8))]
        assert own.decode(np.array(ids, int)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("escape", [False, True])
def test_normal_forms_and_their_sources_are_the_library_s(rule, squeeze, prefix, escape):
    from sentencepiece import sentencepiece_model_pb2

    library = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=squeeze)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = pieces.Normalizer(model.normalizer_spec)
    for t in random_texts(400, "ab  ｶﾞｷﾞ½²ﬁ Ａ①㍿ 　é¨ªAİ​\xad\t\n▁ﷺ🙂Å"):
        raw = t.encode()
        form, place = own.normalize(raw)
        starts = [len(raw[: place[len(form.decode()[:i].encode())]].decode()) for i in range(len(form.decode()) + 1)]
        want, offsets = library.normalize(t, with_offsets=True)
        assert (form.decode(), starts) == (want, list(offsets))


def test_bytes_that_are_no_text(own):
    form, place = own.normalizer.normalize(b"a\xff b\xe9")
    assert form.decode() == "▁a�▁b�" and place.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 4, 4, 4, 5]


def test_long_texts_are_cut_into_stretches(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "_STRETCH", 50)
    monkeypatch.setattr(pieces, "MEMORY", 2000)
    t = " ".join(random_texts(400, "there in a on st"))
    assert own.encode([t.encode(), b"", b"a"])[0][0].tolist() == library.encode(t)


def test_query_gives_what_the_library_gives(spark, data, library):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, queries.op11_pieces(spark, data).collect())) == sorted(want)


def test_rows_of_all_kinds(spark, library):
    model = queries.tokenizer("piece_bpe_32k.model")
    rows = [(i % 5 if i % 4 else None, t, "x", "y") for i, t in enumerate(ODD + ODD[:6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, begins string")
    got = pieces.decode(pieces.encode(docs, model), model)
    assert got.columns == ["doc_id", "ids", "begins", "ends", "text"]
    want = [(d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t, *_ in rows]
    assert sorted([(r.doc_id, tuple(r.ids), r.text) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert pieces.encode(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [5, None, 10**6]), (3, [])], "k int, ids array<int>")
    assert [r.text for r in pieces.decode(odd, model).orderBy("k").collect()] == ["", "\x02 ⁇  ⁇ ", ""]
