import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from twinscope.llm import exact_dedup, line_dedup, queries, simhash


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode()].append(i)
    return sorted((i, max(groups[(t or "").encode()]), len(groups[(t or "").encode()]), i == max(groups[(t or "").encode()]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_exact_groups(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == brute_exact(rows)
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_exact_dedup_keeps_one_row_of_each_text(odd_docs):
    out = exact_dedup.exact_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [r.text or "" for r in out.collect()]
    assert Counter(texts) == Counter({r.text or "" for r in odd_docs.collect()})


def test_directory_doubles_and_covers_all_keys():
    rnd = random.Random(1)
    counts = {k: rnd.choice((0, 1, 2, 40)) for k in range(64)}
    found = exact_dedup.Directory.grown(counts, 6, 10)
    assert len(found.slots) == 1 << found.global_depth
    by_bucket = Counter()
    for k, n in counts.items():
        by_bucket[found.bucket(k << 58)] += n
    for bucket, n in by_bucket.items():
        assert n <= 10 or found.local_depth[bucket] == 6
        assert found.slots.count(bucket) == 1 << found.global_depth - found.local_depth[bucket]


def test_owners_hold_ranges_of_keys():
    counts = {k: (k * 7919) % 50 for k in range(64)}
    found = exact_dedup.Directory.grown(counts, 6, 40)
    owners = found.slot_owners(4)
    assert len(owners) == len(found.slots) and sorted(owners) == list(owners) and set(owners) == {0, 1, 2, 3}
    for bucket in set(found.slots):
        assert len({o for o, s in zip(owners, found.slots, strict=True) if s == bucket}) == 1


def test_colliding_keys_are_told_apart_by_their_bytes():
    batch = pa.table({"key": [7, 7, 7, 7, 8], "text": ["a", "b", "a", "c", "a"], "id": [1, 2, 3, 4, 9], "tie": [0] * 5, "n": [1, 1, 5, 1, 1]})
    for size in (1, 2, 5):
        rows = [r for b in exact_dedup._own(iter(batch.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [(r["key"], r["place"], r["id"], r["n"]) for r in rows] == [(7, 0, 3, 6), (7, 1, 2, 1), (7, 2, 4, 1), (8, 0, 9, 1)]
    folded = pa.Table.from_batches(exact_dedup._fold(np.zeros(1, np.int32), 0)(iter(batch.to_batches(max_chunksize=2)))).to_pylist()
    assert sorted((r["key"], r["text"], r["id"], r["n"]) for r in folded) == [(7, "a", 3, 6), (7, "b", 2, 1), (7, "c", 4, 1), (8, "a", 9, 1)]


def test_exact_dedup_null_and_repeated_ids_and_clashing_names(spark):
    rows = [
        (None, "x", 1, "a"), (None, "x", 2, "a"), (3, "x", 3, "a"),  # the id stays
        (None, "y", 4, "a"), (None, "y", 4, "b"),  # one of two without an id
        (7, "one", 5, "a"), (7, "two", 6, "a"),  # two texts under one id
        (8, None, 7, "a"), (9, "", 8, "a"), (9, "", 8, "a"),  # null equals the empty text; a repeated row
    ]
    for names in ("__sha256", "key"), ("text_sha256", "row"), ("a.b", "n"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, `{names[0]}` int, `{names[1]}` string")
        out = exact_dedup.exact_dedup(docs)
        assert out.columns == docs.columns
        found = [tuple(r) for r in out.collect()]
        assert sorted(found, key=str) == sorted([(3, "x", 3, "a"), *[r for r in found if r[1] == "y"], (7, "one", 5, "a"), (7, "two", 6, "a"), (9, "", 8, "a")], key=str)
        assert sum(r[1] == "y" for r in found) == 1


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in prints}


def test_simhash_query_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert all(int.from_bytes(simhash.fingerprint((t or "").encode()), "little") == brute_fingerprint(t) for _, t in rows)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    found = brute_components(prints)
    assert sorted(map(tuple, queries.op3_simhash(spark, sf).collect())) == sorted((i, f"{f:016x}", found[i]) for i, f in prints)


def test_simhash_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_groups(odd_docs).collect()}
    assert rows[0] == rows[1] == rows[2] == rows[12] == (0, 0)
    assert rows[11][1] == 10 and rows[9][1] == 8
    assert simhash.near_groups(odd_docs).count() == odd_docs.count()
    assert simhash.near_groups(no_docs).count() == 0
    assert simhash.near_dedup(odd_docs).columns == odd_docs.columns


ROWS = "doc_id long, text string, row_digest int"
FAR = ["all the birds of the north fly south when winter comes near", "a ship with nine sails left the old harbour at dawn today", "seven bakers bake bread for the king of a very small land"]


def test_near_dedup_keeps_null_and_repeated_ids_right(spark):
    rows = [
        (None, FAR[0], 1),  # without an id, and alone in its group: stays
        (3, FAR[1], 2),
        (7, FAR[1].upper(), 3),  # a copy of 3's text under an id that stays for another text: goes
        (7, FAR[2], 4),
        (None, FAR[2] + " ", 5),  # a group with an id: goes
        (11, "nothing else in this table reads like the row that stands here twice", 9),
        (11, "nothing else in this table reads like the row that stands here twice", 9),  # a row that repeats: one stays
        (9, "", 6),
        (9, None, 7),  # one group and one id: one row of it stays
        (9, " \n", 8),
    ]
    docs = spark.createDataFrame(rows, ROWS)
    out = [tuple(r) for r in simhash.near_dedup(docs).collect()]
    assert sorted(out[i][2] for i in range(len(out)) if out[i][0] != 9) == [1, 2, 4, 9]
    assert sum(r[0] == 9 for r in out) == 1 and len(out) == 5
    assert simhash.near_dedup(docs).columns == docs.columns


def test_links_beyond_the_routing_blocks_are_refused(odd_docs):
    with pytest.raises(ValueError):
        simhash.near_groups(odd_docs, most=simhash.BLOCKS)


def clusters(seed, n, words=1):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rnd.getrandbits(64 * words)
        for _ in range(rnd.choice((1, 1, 5, 200))):
            f = base
            for _ in range(rnd.randint(0, 5 * words)):
                f ^= 1 << rnd.randrange(64 * words)
            out.add(f)
    return np.frombuffer(b"".join(f.to_bytes(8 * words, "little") for f in sorted(out)), "<u8").reshape(-1, words)


def apart(fps):
    return np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2)


def brute_labels(link):
    label = np.arange(len(link))
    while True:
        new = np.where(link, label[None, :], len(link)).min(axis=1)
        if (new == label).all():
            return label
        label = new


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 600), st.sampled_from([(1, 3), (1, 12), (2, 10), (4, 40)]))
def test_gray_index_and_forest_are_brute_force(seed, n, shape):
    words, most = shape
    fps = clusters(seed, n, words)
    fps = fps[simhash.gray_order(fps)]
    link = apart(fps) <= most
    assert set(zip(*simhash.GrayIndex(fps).near(fps, most), strict=True)) == set(zip(*np.nonzero(link), strict=True))
    assert (simhash.forest(fps, most) == brute_labels(link)).all()


def test_gray_order_is_the_reflected_sequence():
    rank = lambda x: x ^ rank(x >> 1) if x else 0
    rnd = random.Random(2)
    own = [rnd.getrandbits(128) for _ in range(50)]
    fps = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in own), "<u8").reshape(-1, 2)
    assert [own[i] for i in simhash.gray_order(fps)] == sorted(own, key=rank)


@pytest.mark.parametrize("tile", [1 << 16, 40])  # with 40 most block values are cut into shards
def test_tiles_and_label_propagation_join_all_that_links(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "MAX_TILE", tile)
    fps = clusters(5, 3000)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)[:, 0]], "fp long")
    found = {r.v: r.label for r in simhash.components(simhash.links(nodes)).collect()}
    order = simhash.gray_order(fps)
    first = simhash.forest(fps[order])
    want = defaultdict(set)
    for i, f in zip(first, fps[order].view(np.int64)[:, 0], strict=True):
        want[i].add(int(f))
    for group in want.values():
        assert {found.get(f, f) for f in group} == {min(group)}


def test_near_dedup_finds_near_copies(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, copies = [], 0
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(400)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(i % 3):
            other = list(words)
            for at in rnd.sample(range(400), 6):  # about 30 of 400 shingles: a similarity near 0.86
                other[at] = "new"
            rows.append((len(rows), " ".join(other)))
            copies += 1
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kept) <= 60 + 0.1 * copies
    firsts = {min(i for i, t in rows if t.split()[:5] == x.split()[:5]) for _, x in rows}
    assert len(kept & firsts) >= 55


def brute_lines(rows):
    seen, gone = set(), defaultdict(set)
    for i, t in sorted({(i, t or "") for i, t in rows}):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone[i] |= {p, p + 1, p + 2}
            seen.add(w)
    return sorted((i, "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]), len((t or "").split("\n")), len(gone[i])) for i, t in rows)


def test_line_dedup(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == brute_lines(rows)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    rows = [
        (1, "a\nb\nc\nd"),
        (2, "1\n2\n3\n4\n5\na\nb\nc"),  # loses its end to 1
        (2, "q\nr\ns"),  # shorter than that place: stays whole
        (None, "u\nv\nw\nx"),
        (None, "u\nv\nw\ny"),  # the same window at the same place: one of the two loses it
        (None, "q\nr\ns"),  # after the id 2: goes
        (None, "short"),
    ]
    out = [tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(out) == len(rows)
    assert sorted(r for r in out if r[0]) == [(1, "a\nb\nc\nd", 4, 0), (2, "1\n2\n3\n4\n5", 8, 3), (2, "q\nr\ns", 3, 0)]
    rest = sorted(r[1:] for r in out if r[0] is None)
    assert rest in ([("", 3, 3), ("short", 1, 0), ("u\nv\nw\nx", 4, 0), ("y", 4, 3)], [("", 3, 3), ("short", 1, 0), ("u\nv\nw\ny", 4, 0), ("x", 4, 3)])


def test_overlapping_windows_merge():
    assert line_dedup.without("a\nb\nc\nd\ne", [0, 1]) == ("e", 5, 4)
    assert line_dedup.without("a\nb", None) == ("a\nb", 2, 0)
