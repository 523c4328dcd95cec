"""Language ID, packing, archives, mixing, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import drops, jaccard_join, language, mixing, packing, warc
from millrace.llm.batches import SMALL, rows_to_batches, small_batches

PIECES = ["a", "b", "the", "Don", "'", "'s", "'ll", "''", " ", "  ", "\n", "\n\n", "\t", "\r\n", "1", "23", "²", "Ⅷ", "_", ".", "!!", "(", "é", "д",
          "日本", "́", " ", "　", "\x1c", "\x85", "\xa0", "😀", "“", "’", "<|endoftext|>", "&", "\x00", "ª", "٣", "ñ", "-", "​"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


def test_pieces_encode_like_whole_texts(encoder):
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_encode_as_in_the_file(encoder):
    """The string of an added token in a text is that token, as an untouched tokenizer has it."""
    plain = Tokenizer.from_file(packing.default_tokenizer())
    assert encoder.merger is not None and encoder.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    rng = random.Random(5)
    texts = ["<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|", "<|endoftext|>\n\n日本", *[
        "".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(3000)]]
    assert all(encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)


def test_hilbert_neighbours():
    """Along the curve every step goes to a neighbouring cell, and every cell is visited once."""
    cells = sorted(((x, y, z) for x in range(8) for y in range(8) for z in range(8)), key=lambda p: packing.hilbert_key(np.array(p), 3))
    assert sorted(packing.hilbert_key(np.array(p), 3) for p in cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))


def test_packing(keyed, encoder):
    pieces = packing.pack(keyed).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in keyed.collect():
        ids = np.append(encoder.ids(r.text or ""), 0).astype("<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_repeated_rows(docs):
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == sum(
        p.doc_tokens for p in packing.pack(docs).filter("start = 0").select("doc_tokens").collect())


def test_language_of_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(documents).join(documents.select(F.col("doc_id").alias("id"), "lang"), "id").filter(language.held_out("id")).collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_defined_cases(docs):
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    letters = {r.doc_id: any(map(str.isalpha, r.text or "")) for r in docs.collect() if r.doc_id is not None}
    assert all((r.lang_pred == "und") == (not letters[r.id]) for r in rows if r.id is not None)
    assert language.drop_unknown(docs).columns == docs.columns


def test_language_without_labels(docs):
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def targets_by_hand(sizes: dict, weights, share, cap) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if level[s] > cap * sizes[s]}
        if not above:
            return {s: float(cap * sizes[s]) if s in full else level[s] for s in order}
        full |= above


def test_mixing(keyed):
    rows = mixing.mix(keyed).collect()
    source = {r.doc_id: (r.source, len((r.text or "").split())) for r in keyed.collect()}
    sizes = Counter()
    for s, n in source.values():
        sizes[s] += n
    targets = targets_by_hand(dict(sizes), mixing.WEIGHTS, mixing.SHARE, mixing.CAP)
    taken = Counter()
    for r in rows:
        assert (r.source, r.size) == source[r.id] and r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max([n for x, n in source.values() if x == s]) / 2 + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(keyed.repartition(3)).collect()))


def test_mixing_rates_meet_the_dual(spark):
    """Unrounded, the rates meet the targets and are min(cap, exp(multiplier x size))."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 300), "abcd"[i % 4]) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(5, 1, 2, 3)).collect()
    for s in "abcd":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) < 1e-5 * own[0].target
        free = [np.log(r.rate) / r.size for r in own if r.rate < 2]
        assert not free or max(free) - min(free) < 1e-9
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.01 * own[0].target


def test_mixing_take(keyed):
    copies = {r.id: r.copies for r in mixing.mix(keyed).collect() if r.copies}
    taken = mixing.take(keyed)
    assert taken.columns == keyed.columns and Counter(r.doc_id for r in taken.collect()) == copies


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    rng = random.Random(6)
    pages = [(i, f"http://x.example/{i} a" if i % 5 else None, "".join(rng.choice("abc é\n") for _ in range(rng.randrange(2500)))) for i in range(60)]
    pages += [(100 + i, "http://copy", "copy " * (250 if i % 2 else 20)) for i in range(8)] + [(None, None, None), (7, "u", pages[7][2])]
    pages += [(200, "u", "WARC/1.1\r\n\r\nHTTP/1.0\n\nfiledesc://x 0.0.0.0 20000101000000 text/plain 3\n"), (201, "u", "")]
    rows = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), version=version, archive_bytes=20000).collect()
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    expected = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        expected[(i, len(body), hashlib.sha1(body).hexdigest())] += 1
    assert Counter((r.key, r.payload_bytes, r.payload_digest) for r in rows) == expected and all(r.intact for r in rows)
    ids = {r.record_id: r for r in rows}
    assert len(ids) == len(rows)
    for html, members in groups.items():
        own = [r for r in rows if r.payload_digest == hashlib.sha1(html.encode()).hexdigest()]
        if len(html.encode()) < 1000 or len(members) == 1:
            assert {r.record_type for r in own} == {"response"}
        else:
            (first,) = [r for r in own if r.record_type == "response"]
            assert first.key == max(members)
            assert all(r.refers_to == first.record_id and r.refers_to_key == first.key for r in own if r is not first)


def test_arc_parsing():
    head = b"filedesc://old.arc 1.2.3.4 19970101 text/plain 76\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n".ljust(50)
    body = head.split(b"\n", 1)[1]
    head = f"filedesc://old.arc 1.2.3.4 19970101 text/plain {len(body)}\n".encode() + body
    data = head + b"\nhttp://a b/ 5.6.7.8 19970203040506 text/html 5\nhello\nno header here\ndns:x 0.0.0.0 19970203 text/dns 3\nabc\nhttp://t/ 1.1.1.1 19970203040506 text/html 50\nshort"
    name, records = warc.read_arc(data)
    assert name == "old.arc" and [(r.url, r.block, r.truncated) for r in records[1:]] == [
        ("http://a b/", b"hello", False), ("dns:x", b"abc", False), ("http://t/", b"short", True)]
    assert warc.timestamp("19970203") == "1997-02-03T00:00:00Z" and warc.timestamp("19970203040506") == "1997-02-03T04:05:06Z"
    out = [warc.warc_record(name, r, None) for r in records]
    read = list(warc.read_warc(b"\r\n\r\n".join(out) + b"\r\n\r\n"))
    assert [f["warc-type"] for f, _ in read] == ["warcinfo", "resource", "resource", "resource"] and read[1][1] == b"hello"
    assert read[3][0]["warc-truncated"] == "unspecified"


def test_empty(spark, empty):
    assert packing.pack(empty).count() == language.identify(empty).count() == mixing.mix(empty).count() == mixing.take(empty).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path, docs, keyed):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "mix_sources", "pack"]
    keyed.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    current = keyed
    for name in list(stages)[:-1]:
        after = stages[name](spark, current, str(tmp_path))
        assert after.columns == keyed.columns
        current = after.cache()
    copies = Counter(r.doc_id for r in current.collect())
    got = Counter(r.doc_id for r in pieces.collect() if r.start == 0)
    assert got == copies and max(copies.values()) <= 2


def test_pipeline_keeps_clean_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language.drop_unknown(documents).count() >= 0.995 * documents.count()


def test_batches_of_large_arrays_are_passed_on_early():
    rows = ((k, (np.zeros(1 << 17, np.int64),)) for k in range(16))  # 1 MB each
    out = list(rows_to_batches(rows, [("id", pa.int64()), ("values", pa.list_(pa.int64()))]))
    assert [b.num_rows for b in out] == [4, 4, 4, 4]


def test_tasks_over_texts_hold_a_few_megabytes(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    texts = spark.range(0, 400, 1, 1).selectExpr("id doc_id", "concat(id, repeat(' word', 10000)) text")  # 20 MB in one task
    before = {key: spark.conf.get(key) for key in SMALL}
    with small_batches(spark):
        found = [r.size for r in texts.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 16 << 20 and max(found) < 6 << 20

    held = []

    def recorded(stored):
        def run(df, *args, **kwargs):
            held.append({key: int(spark.conf.get(key)) for key in SMALL})
            return stored(df, *args, **kwargs)
        return run

    for module in (jaccard_join, packing, drops):
        monkeypatch.setattr(module, "stored", recorded(module.stored))
    few = spark.createDataFrame([(k, f"a b c d e f {k // 2}", "en") for k in range(6)], "doc_id long, text string, lang string")
    for step, at_least in ((jaccard_join.similar_components, 5), (packing.pack, 1), (language.drop_unknown, 1)):
        held.clear()
        step(few)
        assert len(held) >= at_least and all(h == SMALL for h in held)
    assert {key: spark.conf.get(key) for key in SMALL} == before

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for value, inside in (("1m", "1m"), ("1g", str(4 << 20))):
        spark.conf.set(key, value)
        try:
            with small_batches(spark):
                assert spark.conf.get(key) == inside
            assert spark.conf.get(key) == value
        finally:
            spark.conf.set(key, before[key])


def test_pieces_of_white_space_encode_like_whole_texts(encoder):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for text in ("a  b", "a   ", " \n\n a\n", "\t\t", "  ", " ", "it's 'll 've12 3!!  ?\n \n", "a  b ", "\x1c\x1c a", "\r\n\r\n x"):
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
