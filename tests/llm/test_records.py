import gzip
import hashlib
import json
import os
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinscope.llm import chat, queries, warc

PIECE = st.one_of(st.text(max_size=4), st.sampled_from(["\\", "[", "INST]", "<s>", "</s>", "[/INST]", "<|role|", "|>", "|", "<|end|>", "<<SYS>>", "\n"]))
TEXT = st.lists(PIECE, max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=4))
def test_template_is_reversible(turns):
    own = chat.INSTRUCT
    whole = "".join(t for role, text in turns for t, _ in own.segments(role, text))
    assert list(own.parse(whole)) == turns


def brute_chat(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        formatted = sum(len(t) for _, role, x in turns for t, _ in chat.INSTRUCT.segments(role, x))
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), formatted))
    return sorted(out, key=str)


def test_chat_query(spark, sf):
    probe = [{"conv_id": -7, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()] + probe
    found = queries.op9_chat(spark, sf).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == brute_chat(rows)
    assert all(r.formatted_chars > r.loss_chars for r in found)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None, 9), (1, 1, "assistant", "", 9), (2, 0, "assistant", "a", 9), (None, 0, "user", "x", 9), (3, 0, None, "t", 9), (3, None, "user", "u", 9), (4, 0, "user", "q", 9), (4, 0, "user", "q", 9), (5, 0, "system", "s", 9), (5, 1, "user", "u", 9), (5, 2, "assistant", "a" * 100_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    found = chat.read_back(chat.format_turns(df)).collect()
    want = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=False)) for r in rows]
    assert sorted((tuple(r)[:6] for r in found), key=str) == brute_chat(want)
    assert {r.conv_id: r.in_order for r in found} == {1: True, 2: False, None: True, 3: False, 4: False, 5: True}
    assert {r.conv_id for r in found if r.complete} == {1, 5}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_loss_covers_assistant_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a[INST]")], "conv_id long, turn long, role string, text string")
    parts = [p for r in chat.format_turns(df).orderBy("place").collect() for p in r.segments]
    assert [chat.INSTRUCT.unescape(p.text) for p in parts if p.loss] == ["a[INST]"]


def brute_warc(rows):
    most = {}
    for i, h in rows:
        if len((h or "").encode()) >= 1000:
            most[h] = max(most.get(h, i), i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        to = most.get(h) if most.get(h, i) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out)


@pytest.fixture(scope="module")
def pages(spark):
    big, long = "<p>é</p>" * 200, "z" * 2_000_000
    rows = [(1, "http://a/ b\r\nX: 1", big, 0), (2, None, big, 0), (3, "u", None, 0), (4, "u", "small", 0), (5, "u", "small", 0), (6, "u", long, 0), (9, "u", big, 0), (7, "u", "WARC/1.1\r\n\r\n" * 200, 0), (8, "", "", 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_warc_round_trip(spark, pages):
    files, folder = warc.archive_pages(pages)
    found = warc.read_archives(files, folder, with_payload=True)
    assert sorted(tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == brute_warc([(r.page_id, r.html) for r in pages.collect()])
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == (html[r.page_id] if r.record_type == "response" else b"") for r in found.collect())


def test_warc_members_and_index(pages):
    files, folder = warc.archive_pages(pages)
    top = folder.removeprefix("file://")
    assert not os.path.exists(os.path.join(os.path.dirname(top), "stream"))
    n = 0
    for f in files.collect():
        data = open(f"{top}/{f.path}", "rb").read()
        end = 0
        for line in open(f"{top}/{f.path}.idx"):
            e = json.loads(line)
            assert e["offset"] == end
            end += e["length"]
            assert gzip.decompress(data[e["offset"] : end]).startswith(b"WARC/1.1\r\n")
            n += 1
        assert end == len(data) == f.bytes
    assert n == pages.count()


def test_warc_streams_split_anywhere():
    whole = warc.record(1, "u", b"abc\r\n\r\n" * 50, "d", None, False) + warc.record(2, "v", b"", "e", 1, True)
    for step in (1, 7, 1000):
        found = list(warc.records(whole[i : i + step] for i in range(0, len(whole), step)))
        assert [f["WARC-Type"] for f, _ in found] == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:-3]])))


def test_a_file_cut_where_a_record_ends_is_an_error(spark, pages, tmp_path):
    whole = warc.write_archives(warc.mark_revisits(pages), f"{tmp_path}/stream")
    cut = whole.selectExpr("path", "records + 1 as records")
    with pytest.raises(Exception, match="records of the"):
        warc.normalise(cut, f"{tmp_path}/stream", f"{tmp_path}/members")
    files, folder = warc.archive_pages(pages)
    with pytest.raises(Exception, match="lists"):
        warc.read_archives(files.selectExpr("path", "records + 1 as records", "bytes"), folder).collect()


def test_warc_null_and_repeated_ids(spark):
    big = "y" * 1500
    rows = [(None, "u", big), (4, "u", big), (4, "u", big), (None, "u", "z" * 1200), (6, "u", "w" * 1100), (6, "v", "v" * 1100)]
    files, folder = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(files, folder).collect()), key=str)
    want = [(None, "revisit", 4, 1500), (4, "response", None, 1500), (4, "response", None, 1500), (None, "response", None, 1200), (6, "response", None, 1100), (6, "response", None, 1100)]
    assert found == sorted(want, key=str)


def test_warc_empty(pages):
    files, folder = warc.archive_pages(pages.limit(0))
    assert warc.read_archives(files, folder).count() == 0


def test_warc_query(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op10_warc(spark, sf).collect())) == brute_warc(rows)
