from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronogrid.llm import imatch, packing, queries, warc
from chronogrid.llm.common import stored

PAGES = "page_id bigint, url string, html string, digest string, path string"
BIG = "<p>" + "payload " * 20 + "</p>"


@pytest.fixture
def odd_pages(spark):
    rng = random.Random(3)
    noise = "".join(rng.choices("abcdefgh<>/é", k=200_000))
    rows = [
        (7, "http://a/", BIG),
        (3, "http://b/\r\nX: y", BIG),
        (9, None, BIG),
        (9, None, BIG),
        (3, "http://b/", BIG),
        (1, "u", None),
        (2, "u", ""),
        (4, "u", "small"),
        (5, "u", "small"),
        (None, "u", "é" * 50),
        (6, "u", noise),
        (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
    ]
    return rows, spark.createDataFrame([(*r, "d", "p") for r in rows], PAGES)


def test_warc_round_trip(odd_pages):
    rows, pages = odd_pages
    found = warc.round_trip(pages).collect()
    expected = []
    for key, _, html in rows:
        body = (html or "").encode()
        same = [k for k, _, h in rows if k is not None and (h or "").encode() == body]
        first = min(same) if same and len(body) >= 100 else key
        role = ("response", None) if first == key or key is None else ("revisit", first)
        expected.append((key, len(body), hashlib.sha256(body).hexdigest(), *role))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_warc_payloads_come_back_at_any_range_size(spark, odd_pages, tmp_path):
    rows, pages = odd_pages
    folder = f"file://{tmp_path}"
    archives = warc.write_archives(pages.coalesce(1), folder)
    for size in (37, 1000, 1 << 22):
        found = warc.read_archives(spark, archives, folder, split_bytes=size, with_payload=True).collect()
        bodies = sorted(bytes(r["payload"]) for r in found if r["record_type"] == "response")
        assert len(found) == len(rows)
        for r in found:
            if r["record_type"] == "response":
                assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
        assert BIG.encode() in bodies


def test_warc_reader_passes_over_false_magic():
    members = [warc.record(i, "u", bytes([i]) * 300, "d") for i in range(3)]
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    foreign = other.compress(b"not a record") + other.flush()
    data = b"junk" + warc.MAGIC + members[0] + foreign + members[1] + warc.MAGIC + b"\x00" * 40 + members[2]
    stream = io.BytesIO(data)
    whole = [r["at"] for r in warc.records_in(stream, 0, len(data))]
    assert len(whole) == 3
    for cut in range(0, len(data), 11):
        left = [r["at"] for r in warc.records_in(stream, 0, cut)]
        right = [r["at"] for r in warc.records_in(stream, cut, len(data))]
        assert left + right == whole


def test_warc_member_inside_a_payload_is_no_record():
    """A stored (uncompressed) member shows the records in its payload byte by byte."""
    inner = warc.record(7, "u", b"inner" * 50, "d")
    head = warc.VERSION + b"WARC-Type: response\r\nX-Page-Id: 1\r\nContent-Length: %d\r\n\r\n" % len(inner)
    squeezer = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = squeezer.compress(head + inner + b"\r\n\r\n") + squeezer.flush()
    data = outer + warc.record(2, "u", b"next" * 50, "d")
    assert outer.find(warc.MAGIC, 1) > 0
    found = list(warc.records_in(io.BytesIO(data), 0, len(data), keep_payload=True))
    assert [r["fields"]["x-page-id"] for r in found] == ["1", "2"] and found[0]["payload"] == inner


def test_warc_reader_has_a_task_for_each_range(spark, tmp_path):
    rows = [(f"{tmp_path}/{i}", 1 << 22, 0) for i in range(3)]
    archives = spark.createDataFrame(rows, "path string, bytes bigint, records bigint")
    found = warc.read_archives(spark, archives, f"file://{tmp_path}", split_bytes=1 << 17)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and ", 96), REPARTITION_BY_NUM" in plan


def test_warc_damaged_record_is_an_error():
    member = warc.record(1, "u", b"x" * 5000, "d")
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(member[:-9]), 0, len(member)))


def test_warc_long_pages_of_repeated_lines(spark):
    """The first bytes of such a page expand to megabytes; a header may be long as well."""
    lines = [f"<li>line {i} of a long list</li>\n" for i in range(100)]
    page = "".join(lines[i % 100] for i in range(90_000))
    member = warc.record(1, "http://a/" + "x" * 3_000_000, page.encode(), "d")
    (whole,) = warc.records_in(io.BytesIO(member), 0, len(member), keep_payload=True)
    assert whole["payload"] == page.encode() and len(whole["fields"]["warc-target-uri"]) == 3_000_009
    rows = [(1, "u", page, "d", "p"), (2, "u", page, "d", "p"), (3, "u", page + "end", "d", "p")]
    found = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in found.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("response", None),
    }
    assert [found[k]["payload_bytes"] for k in (1, 2, 3)] == [len(page), len(page), len(page) + 3]


def test_warc_records_that_do_not_come_back_are_an_error(spark, odd_pages, tmp_path):
    archives = warc.write_archives(odd_pages[1].coalesce(1), f"file://{tmp_path}")
    found = warc.read_archives(spark, archives, f"file://{tmp_path}")
    assert warc.all_read(found, archives).count() == len(odd_pages[0])
    for wrong in (found.where("page_id <> 6"), found.where("false"), found.union(found)):
        with pytest.raises(ValueError):
            warc.all_read(wrong, archives)


def test_warc_empty_table(odd_pages):
    assert warc.round_trip(odd_pages[1].where("false")).collect() == []


def plain_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_packing_round_trip(make_docs, odd_rows):
    rows = odd_rows + [(20, "<|endoftext|> don't STOP Σας İ x\u0301 \u00a0 y"), (21, "\u2028a\x1cb\x85c\u200bd")]
    rows += [(22, "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext|>, <| endoftext |>\n<|endoftext|>")]
    found = packing.pack(make_docs(rows)).collect()
    assert len({r["sequence_id"] for r in found}) == len(found)
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 for r in found)
    got, expected = [], []
    for key, text, *_ in rows:
        ids, start = plain_ids(text), 0
        for length in packing.piece_lengths(len(ids)):
            part = ids[start : start + length]
            expected.append((key, start, length, zlib.crc32(part.tobytes()), len(ids), part.tolist()))
            start += length
        assert start == len(ids)
    for r in found:
        got.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], list(r["ids"])))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    by_number = sorted(found, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_number] == sorted((r["length"] for r in found), reverse=True)


def test_packing_full_store_and_blocks(monkeypatch):
    encoder = packing.WordEncoder(packing.TOKENIZER)
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    monkeypatch.setattr(packing, "BLOCK_WORDS", 4)
    text = "one two three four five six one two seven eight nine, nine 10 one"
    ids = np.concatenate([*encoder.blocks(text), [2]])
    assert ids.tolist() == plain_ids(text).tolist() and len(encoder.known) == 3


def test_packing_query_and_pipeline_hold_the_ids(spark, make_docs, odd_rows, monkeypatch):
    docs = make_docs(odd_rows)
    expected = sorted((r[0], plain_ids(r[1]).tolist()) for r in odd_rows if r[0] is not None)
    last = corpus_pipeline.packing_stage(spark, docs.where("doc_id is not null"), "")
    ids = {}
    for r in last.orderBy("sequence_id").collect():
        ids.setdefault((r["doc_id"], r["start"]), []).append(list(r["ids"]))
    assert ids[6, 0][0] + ids[6, 4096][0] == dict(expected)[6][:8192]
    assert ids[3, 0] == [[2]] and len(ids[2, 0]) == 2
    monkeypatch.setattr(packing, "BLOCK_IDS", 5)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    packed = []

    def seen(rows, label):
        packed.append(stored(rows, label))
        return packed[0]

    monkeypatch.setattr(queries, "stored", seen)
    found = queries.op9_packing(spark, "").collect()
    assert "ids" in packed[0].columns
    parts = {r["sequence_id"]: r for r in packed[0].collect()}
    assert len(found) == len(parts)
    for r in found:
        part = parts[r["sequence_id"]]
        assert r["length"] == len(part["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(part["ids"], "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["ids_crc32"]) == (part["doc_id"], part["start"], part["ids_crc32"])
    assert sum(r["length"] for r in found) == sum(len(plain_ids(r[1])) for r in odd_rows)


def test_special_tokens_are_those_of_the_plain_call():
    assert packing.token_ids("<|endoftext|> a").tolist() == [49407, 320, 2]
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", "\n", "a", "B.", "é", "12"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=12))
        assert packing.token_ids(text).tolist() == plain_ids(text).tolist(), text


def test_packing_shuffles_nothing(make_docs):
    plan = packing.pack(make_docs([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_packing_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == []


def test_edited_texts_and_fingerprints(make_docs, odd_rows):
    rows = odd_rows + [(30, "the quick brown fox jumps over the lazy dog while seven wizards brew potions")]
    found = {r["doc_id"]: r for r in imatch.fingerprint_documents(make_docs(rows)).collect()}
    texts = {}
    for key, text, *_ in rows:
        texts[key] = min(texts.get(key, text or ""), text or "")
    order = sorted((k for k in texts if k is not None), reverse=True) + [None]
    assert set(found) == set(order)
    for i, key in enumerate(order):
        text, following = texts[key], texts[order[(i + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = found[key]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1.0 and r["fingerprint"] == r["edited_fingerprint"]
    assert found[1]["fingerprint"] == found[2]["fingerprint"] == found[30]["fingerprint"]
    assert found[1]["fingerprint"] != found[-5]["fingerprint"] != found[3]["fingerprint"]
    assert found[2]["near_next"] == 1.0  # the next one is its copy


def test_fingerprints_match_a_plain_version(spark, make_docs):
    """Terms of the band, by document frequency over all rows, sorted and hashed per subset."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"t{j}" for j in range(60)], [1 / (j + 1) for j in range(60)], k=20))) for i in range(80)]
    docs = make_docs(rows)
    band = {r["term"] for r in imatch.lexicon(docs).collect()}
    ids = {w: h for w, h in spark.range(60).select(F.concat(F.lit("t"), "id").alias("w"), F.xxhash64(F.concat(F.lit("t"), "id"))).collect()}
    counts = {w: sum(w in t.split() for _, t in rows) for w in ids}
    assert band == {ids[w] for w, n in counts.items() if 2 <= n <= 8}
    found = {r["doc_id"]: r for r in imatch.fingerprint_documents(docs).collect()}
    sets = {i: frozenset(w for w in t.split() if ids[w] in band) for i, t in rows}
    for i in sets:
        for j in sets:
            if sets[i] and sets[j]:
                assert (sets[i] == sets[j]) == (found[i]["fingerprint"] == found[j]["fingerprint"])


def test_imatch_empty_and_single(make_docs):
    assert imatch.fingerprint_documents(make_docs([])).collect() == []
    only = imatch.fingerprint_documents(make_docs([(4, "abc def")])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0
