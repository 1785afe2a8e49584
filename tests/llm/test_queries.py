"""Every registered query of the package over the small tables, against plain Python."""

import base64
import hashlib
import html
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablekeep.llm.queries import QUERIES
from tests.check_queries import compare, duck
from tests.llm.test_centroids import expected as clustered
from tests.llm.test_chunked_bpe import expected as encoded
from tests.llm.test_prefix_trie import expected as trie
from tests.llm.test_quality_rules import counts, frequent, verdict
from tests.llm.test_repeats import expected as repeated
from tests.llm.test_simhash import components, fingerprint
from tests.llm.test_topk import expected as best


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()


def run(spark, data, name):
    return QUERIES[name][0](spark, data)


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op1(spark, data, docs):
    rows = run(spark, data, "op1_sharding").collect()
    facts = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == facts and len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = {(r.shard, r.slot) for r in rows}
    assert slots == {(s, i) for s, n in sizes.items() for i in range(n)}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_op2(spark, data, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs}
    by_doc, by_sequence = {}, {}
    for r in run(spark, data, "op2_packing").collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc_id, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc_id])
            assert r.ids_crc32 == crc(ids[doc_id][at : at + r.length])
            at += r.length
        assert at == len(ids[doc_id])
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0


def test_op3(spark, data, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs}
    rows = run(spark, data, "op3_sentencepiece").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = library.encode(texts[r.doc_id]), texts[r.doc_id]
        assert (r.n_chars, r.n_tokens, r.ids_crc32) == (len(text), len(ids), crc(ids))
        assert (r.decoded_chars, r.decoded_crc32) == (len(text), zlib.crc32(text.encode()))


def test_op4(spark, data, docs):
    rows = run(spark, data, "op4_quality_classifier").collect()
    assert sorted(r.doc_id for r in rows) == [r.doc_id for r in docs]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    known = [r for r in rows if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= 0.9 * len(known)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_op5(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    common = frequent([(r.source, r.text) for r in docs])
    assert bool(common) == (len(docs) > 1000)  # the small table has sources of ten documents
    by_id = {r.doc_id: r for r in docs}
    rows = run(spark, folder, "op5_quality_rules").collect()
    assert len(rows) == len(by_id)
    for r in rows:
        own = counts(by_id[r.doc_id].text or "")
        assert own == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        _, removed, failed, kept = verdict(by_id[r.doc_id].text, by_id[r.doc_id].source, common)
        assert (r.removed_words, r.base_failed, r.kept) == (removed, failed, kept)


def test_op6(spark, data):
    sources = {r.page_id: r.html or "" for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = run(spark, data, "op6_html_extraction").collect()
    assert {r.page_id for r in rows} == set(sources)
    for r in rows:
        article = re.search("<article>(.*)</article>", sources[r.page_id], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("</?b>", "", article).replace("<br>", " "))
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op7(spark, data, docs):
    prints = [fingerprint(r.text) for r in docs]
    classes = components(prints, 4)
    rows = run(spark, data, "op7_simhash").collect()
    assert sorted(tuple(r) for r in rows) == [
        (r.doc_id, f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, classes)
    ]


def test_op8(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    rows = run(spark, data, "op8_top_k").collect()
    expected = best([(r.vec_id, r.embedding) for r in vectors], 20)
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == expected


def test_op9(spark, data, docs):
    rows = sorted(run(spark, data, "op9_suffix_array").collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:] for r in rows] == repeated([r.text for r in docs], 200)


def test_op10(spark, data):
    first, sources = {}, {}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        raw = (r.html or "").encode()
        sources[r.page_id] = raw
        first[raw] = min(first.get(raw, r.page_id), r.page_id)
    rows = run(spark, data, "op10_warc").collect()
    assert {r.page_id for r in rows} == set(sources) and len(rows) == len(sources)
    for r in rows:
        raw = sources[r.page_id]
        own = first[raw] == r.page_id
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), digest)
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[raw]))


def test_op11(spark, data):
    turns = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    rows = [tuple(r) for r in run(spark, data, "op11_prefix_trie").collect()]
    assert set(rows) == trie(turns) and len(set(rows)) == len(rows)


def test_op12(spark, data, docs):
    rows = run(spark, data, "op12_chunked_bpe").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {r.doc_id: encoded(r.text) for r in docs}
    assert len(rows) == len(docs)


def test_op13(spark, data):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    rows = [tuple(r) for r in run(spark, data, "op13_centroids").collect()]
    assert sorted(rows, key=repr) == clustered(vectors, 40, 5, 64)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_agree_with_their_sql(spark, data, name):
    same, text = compare(spark, duck(data), data, name)
    assert same, text
