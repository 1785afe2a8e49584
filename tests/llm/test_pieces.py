import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from tablekeep.llm import pieces
from tests.llm.samples import documents, frame, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(PATH)


def odd_texts():
    pick = random.Random(3)
    pools = ["ab", "abcde ", "the in at on er ", " \n\tab", "eéè日a ", "0123456789", "▁ x"]
    texts = ["".join(pick.choice(pool) for _ in range(pick.randint(0, 200))) for pool in pools for _ in range(30)]
    return texts + [
        "", " ", "   ", "\n", "  two  spaces ", "<s>x</s>", "a▁b", "😀 emoji😀", "a" * 3000, "日本語 test",
        "x" * 17 + " " * 40 + "y", "http://www.example.com/abc?x=1&y=2" * 20, prose(1, 300),
    ]


def test_same_as_the_library(lattice, library):
    for text in odd_texts():
        ids = lattice.encode(text).tolist()
        assert ids == library.encode(text), text
        assert lattice.decode(ids) == library.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("chunk", [1, 7, 20, 64, 1000])
def test_chunks_give_the_same(lattice, library, chunk):
    for text in odd_texts():
        if len(text) <= 40 * chunk + 400:
            assert pieces.encode_in_chunks(lattice, text, chunk).tolist() == library.encode(text), text


def test_matrices_combine_associatively(lattice):
    text = lattice.normal(prose(2, 40) + "x" * 60)
    bounds = list(range(0, len(text), 11)) + [len(text)]
    matrices = [lattice.transfer(text, a, b) for a, b in zip(bounds, bounds[1:])]
    left = matrices[0]
    for m in matrices[1:]:
        left = pieces.combined(left, m)
    right = matrices[-1]
    for m in reversed(matrices[:-1]):
        right = pieces.combined(m, right)
    assert left == right


def test_unigram_models_get_the_best_sum(tmp_path):
    """The same pieces as a unigram model: the best sum over all segmentations."""
    model = proto.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    unigram = pieces.Lattice(str(tmp_path / "u.model"))

    def best(text):
        sums = [0.0]
        for end in range(1, len(text) + 1):
            options = [sums[end - 1] + unigram.lowest]
            options += [
                sums[start] + unigram.scores[unigram.ids[text[start:end]]]
                for start in range(end)
                if text[start:end] in unigram.ids
            ]
            if text[end - 1 : end] in unigram.ids:
                options = options[1:]
            sums.append(max(options))
        return sums[-1]

    for text in odd_texts():
        if 0 < len(text) < 300:
            for ids in (unigram.encode(text), pieces.encode_in_chunks(unigram, text, 9)):
                ids = ids.tolist()
                known = sum(unigram.scores[i] for i in ids if i in unigram.scores)
                normal = unigram.normal(text)
                unknown = sum(c not in unigram.ids for c in normal)
                assert known + unknown * unigram.lowest == pytest.approx(best(normal))
                assert unigram.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("chunk", [16, 500, 1 << 14])
def test_frames(spark, library, chunk):
    rows = documents()
    got = pieces.encode(frame(spark, rows), PATH, chunk=chunk).collect()
    expected = sorted((repr(r[0]), len(r[1] or ""), library.encode(r[1] or "")) for r in rows)
    assert sorted((repr(r.doc_id), r.n_chars, r.ids) for r in got) == expected
    assert all((r.n_chunks > 1) == (r.n_chars > chunk) for r in got)


def test_many_are_decoded_as_one(lattice):
    import pyarrow as pa

    many = [lattice.encode(t).tolist() for t in odd_texts()] + [None, [], [206, 40], [lattice.bytes[200]]]
    kind = pa.list_(pa.int32())
    for lists in (pa.array(many, kind), pa.array(many[:-1], kind), pa.array([[], None], kind), pa.array([[5], *many], kind)[1:]):
        expected = [lattice.decode(x or []) for x in lists.to_pylist()]
        assert lattice.decode_all(lists).to_pylist() == expected


def test_decode_and_empty(spark, library):
    encoded = pieces.encode(frame(spark), PATH)
    texts = sorted(r.decoded for r in pieces.decode(encoded, PATH).collect())
    assert texts == sorted((r[1] or "") for r in documents())
    none = pieces.encode(frame(spark, []), PATH)
    assert none.collect() == [] and pieces.decode(none, PATH).collect() == []
    odd = spark.createDataFrame([(None, 1)], "ids array<int>, decoded int")
    assert [tuple(r) for r in pieces.decode(odd, PATH).collect()] == [("", 0)]
