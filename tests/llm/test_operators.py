"""The corpus operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("patternmill.llm")

from patternmill.llm import ann, bpe, html, langid, minhash, pii, sharding, suffix_dedup, tiling, warc  # noqa: E402
from patternmill.llm.common import scratch  # noqa: E402

SYLLABLES = "an at de el en er es he ing ion la le men ou que re ri sch sto ten th ti ung ve".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Prose with exact copies, near copies, passages that many share, and odd rows."""
    rng = random.Random(1)
    passage = prose(rng, 60)
    out = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    for i in range(12):
        words = out[3].split() if len(out[3].split()) > 60 else (out[3] + " " + prose(rng, 80)).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append(" ".join(words))
        out.append(f"{prose(rng, rng.randint(1, 40))} {passage} {prose(rng, rng.randint(1, 40))}")
    out += [out[5]] * 5 + ["", "  \n\t ", None, "one", "one two", "ONE two", "é" * 300, "a" * 1000, "ab" * 250, prose(rng, 3000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 7 else None, "x", i) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, token string, v int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_shards(docs, none, texts):
    rows = by_id(sharding.interleave_shards(docs, 4))
    slots = {}
    for i, t in enumerate(texts):
        r, data = rows[i], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert sorted(slots) == [0, 1, 2, 3] and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mixture = {}
    for r in docs.collect():
        mixture.setdefault(r["source"], [0] * 4)[rows[r["doc_id"]]["shard"]] += 1
    assert all(max(m) - min(m) <= 2 for m in mixture.values())
    assert sharding.interleave_shards(none, 4).collect() == []
    twice = sharding.interleave_shards(docs.union(docs), 4).collect()
    assert len(twice) == 2 * len(texts) and len({(r["shard"], r["slot"]) for r in twice}) == 2 * len(texts)


def test_bpe(docs, none, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep_decoded=True))
    for i, t in enumerate(texts):
        ids = known.encode_ordinary(t or "")
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids) and rows[i]["decoded"] == (t or "")
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_texts(none, path, public_tokenizers.PATTERN).collect() == []


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    index = bpe.PerfectHash(keys)
    assert [index.get(k) for k in keys] == list(range(3000)) and index.get(b"other") == -1
    assert len(index.at) == len(keys)


def test_merge_is_lowest_rank_leftmost():
    rank = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"abab": 4, b"aa": 5}
    assert bpe.merge(b"ababa", rank) == [4, 0]
    assert bpe.merge(b"aaaa", rank) == [5, 5]


def test_minhash(docs, none, texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    for short, block in ((minhash.SHORT, minhash.BLOCK), (1, 3)):
        minhash.SHORT, minhash.BLOCK = short, block
        rows = by_id(minhash.near_duplicates(docs))
        for i, s in enumerate(sets):
            assert (rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["kept"]) == (len(s), top(i), top(i) == i)
    minhash.SHORT, minhash.BLOCK = 16, 512
    assert minhash.near_duplicates(none).collect() == []
    kept = sorted(r["doc_id"] for r in minhash.keep_one(docs.union(docs)).collect())
    assert kept == [i for i in range(len(texts)) if top(i) == i]


@pytest.fixture
def no_broadcast(spark):
    """Any table that is broadcast fails its query."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_near_duplicates_fill_no_driver(docs, no_broadcast):
    assert len(minhash.near_duplicates(docs).collect()) == docs.count()


def test_suffixes(docs, none, texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    for bucket in (suffix_dedup.BUCKET, 20):
        held, suffix_dedup.BUCKET = suffix_dedup.BUCKET, bucket
        rows = by_id(suffix_dedup.remove_repeats(docs))
        suffix_dedup.BUCKET = held
        for i, d in enumerate(data):
            gone = bytearray(len(d))
            for k in range(len(d) - 199):
                if seen[d[k : k + 200]] > 1:
                    gone[k : k + 200] = b"\1" * 200
            kept = bytes(c for c, g in zip(d, gone) if not g)
            spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
            assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("length", [215, 280, 500])
def test_suffix_runs_over_many_buckets(spark, length):
    """One passage in 1,500 texts whose surroundings differ, in few letters so that chance extends matches: a run over 50 buckets."""
    rng = random.Random(length)
    passage = "".join(rng.choices("abcdefgh", k=length))
    near = [passage[:k] + "".join(rng.choices("xy", k=8)) + passage[k:] for k in range(20, length, 37)]
    texts = ["".join(rng.choices("xy", k=rng.randint(0, 30))) + rng.choice([passage] * 6 + near) + "".join(rng.choices("xy", k=rng.randint(0, 30))) for _ in range(1500)]
    data = [t.encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    held, suffix_dedup.BUCKET = suffix_dedup.BUCKET, 60
    rows = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    suffix_dedup.BUCKET = held
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(d, gone) if not g)
        assert (rows[i]["n_removed"], rows[i]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest()), i


def test_strings_with_one_hash(monkeypatch):
    """Where hashes say nothing, bytes decide."""
    rng = np.random.default_rng(4)
    base = rng.integers(97, 99, 500).astype(np.uint8).tobytes()
    places = [base[i : i + 360] for i in (0, 7, 30)] + [base[:300] + b"z" * 60, b"y" * 100 + base[100:360], base[:360]]
    p = suffix_dedup._Places(*suffix_dedup._padded([x[160:] for x in places], 200), *suffix_dedup._padded([x[:160][::-1] for x in places], 160))
    run = np.zeros(len(places), np.int64)
    want = suffix_dedup.repeated_strings(p, run)
    hashes = suffix_dedup._string_hashes

    def blind(p, run):
        keys, fits = hashes(p, run)
        return keys % np.uint64(3), fits

    monkeypatch.setattr(suffix_dedup, "_string_hashes", blind)
    got = suffix_dedup.repeated_strings(p, run)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist() and want[0].max() == 160


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 4, (3000, 5)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(words)
    assert [tuple(w) for w in words[order]] == sorted(map(tuple, words))


def test_language(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "mo", "tu", "ri"], "bb": ["sch", "enf", "olt", "ung"], "cc": ["ñe", "éa", "ço", "ü"]}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(sounds))
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(rng.randint(3, 40))), lang))
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "", None), (None, "kamotu", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    found = langid.identify(df, model).collect()
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 80 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    odd = {r["doc_id"]: r for r in found if r["doc_id"] in (900, 901, 902)}
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in odd.values())
    assert all(0 <= r["score"] <= 1 for r in found) and sum(r["rejected"] for r in found) < 8
    nothing = langid.train(df.limit(0))
    assert langid.identify(df.limit(2), nothing).collect()[0]["lang_pred"] == "und"


def test_warc(spark):
    body = "<p>a\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3</p>é"
    rows = [(3, "http://a/", body), (1, "http://b/\r\nX: y", body), (2, None, None), (5, "http://c/", ""), (7, "http://d/", "x" * 100_000), (None, "http://e/", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    first, second = scratch(spark, "t"), scratch(spark, "t")
    warc.write_warc(warc.page_records(pages), first)
    warc.dedup_warc(spark, first, second)
    got = {r["page_id"]: r for r in warc.resolve_revisits(warc.read_headers(spark, second)).collect()}
    assert len(got) == 6
    for i, _, h in rows:
        data = (h or "").encode()
        r = got[None if i is None else str(i)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {"1": ("response", None), "3": ("revisit", "1"), None: ("revisit", "1"), "2": ("response", None), "5": ("revisit", "2"), "7": ("response", None)}
    empty, fresh = scratch(spark, "t"), scratch(spark, "t")
    warc.write_warc(warc.page_records(pages.limit(0)), empty)
    assert warc.read_headers(spark, empty).collect() == []
    warc.dedup_warc(spark, empty, fresh)
    assert warc.read_headers(spark, fresh).collect() == []


def test_warc_headers(spark):
    """Archives are bounded by bytes; every record of a deduplicated archive has an id, date and digests of its own."""
    rows = [(i, f"http://h/{i}", ("é" * 300 if i % 2 else f"{i} " * 400)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    first, second = scratch(spark, "t"), scratch(spark, "t")
    warc.write_warc(warc.page_records(pages, date="2020-01-02T03:04:05Z"), first, archive_bytes=10_000)
    warc.dedup_warc(spark, first, second, date="2021-01-02T03:04:05Z", archive_bytes=10_000)
    seen = []
    for path, date in ((first, "2020-01-02T03:04:05Z"), (second, "2021-01-02T03:04:05Z")):
        files = [bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
        own = [list(warc.records_of(f)) for f in files]
        assert len(files) > 3 and all(len(x) == 1 or sum(len(block) for _, block in x) <= 10_000 for x in own)
        heads = [(h, block) for x in own for h, block in x]
        assert len(heads) == 60 and all(h["WARC-Date"] == date for h, _ in heads)
        for h, block in heads:
            assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and int(h["Content-Length"]) == len(block)
            assert h["WARC-Type"] == "revisit" or block.startswith(b"HTTP/1.1 200 OK\r\n")
        seen.append({h["WARC-Record-ID"] for h, _ in heads})
    assert len(seen[0] | seen[1]) == 120
    revisits = [h for h, _ in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 29 and {h["WARC-Refers-To"] for h in revisits} <= seen[1]
    got = warc.resolve_revisits(warc.read_headers(spark, second)).collect()
    assert sorted(int(r["page_id"]) for r in got if r["refers_to"] == "1") == list(range(3, 60, 2))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_warc_is_packed_with_little_effort(spark, tmp_path):
    rng = random.Random(5)
    words = [prose(rng, 1) for _ in range(300)]
    block = " ".join(rng.choices(words, k=100_000))
    record = f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {len(block)}\r\n\r\n{block}"
    warc.write_warc(spark.createDataFrame([(record,)], "record string"), str(tmp_path / "warc"))
    (archive,) = (tmp_path / "warc").rglob("*.gz")
    data = archive.read_bytes()
    assert [b.decode() for _, b in warc.records_of(data)] == [block]
    assert len(data) > 1.02 * len(zlib.compress(f"{record}\r\n\r\n".encode(), 6))


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            good = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "phone" and 10 <= len(digits) <= 15)
            if kind == "card" and 14 <= len(digits) <= 19:
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
                good = total % 10 == 0
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark, texts):
    rng = random.Random(4)
    pieces = ["a.b@c.de", "x@@y.z", "+1 (555) 555-0100", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "é", "@", "+", "a@b", "q@w.e.r@t.y", "12345678901234567890", "\n"]
    made = ["".join(rng.choices(pieces + [" ", "x "], k=20)) for _ in range(120)] + [t or "" for t in texts]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(made)] + [(9999, None, 0)], "doc_id long, text string, spans int")
    tagger = pii.Tagger()
    rows = by_id(pii.find_pii(df, tagger))
    for i, t in enumerate(made):
        base = plain_spans(t)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert set(base) <= set(rows[i]["spans"].split(",")) | {""}
    assert rows[9999]["spans"] == "" and rows[9999]["n_email"] == 0
    found = [(t[a:b], k) for t in ['Mrs. Vida Sol came; token = "0a1b2c3d4e5f60718293a4b5c6d7e8f9" ok'] for a, b, k in tagger.spans([t])[0]]
    assert found == [("Vida Sol", "person"), ("0a1b2c3d4e5f60718293a4b5c6d7e8f9", "secret")]
    assert not any(tagger.spans([t or "" for t in texts]))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame([(1, "to a.b@c.de now"), (2, None)], "doc_id long, text string"), tagger).collect()}
    assert clean == {1: "to <email> now", 2: None}


def test_personal_data_in_long_texts():
    """A megabyte of what almost matches takes time in proportion; addresses are what the pattern finds."""
    began = time.time()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@ ", "1." * 500_000, "a@" * 500_000, "a@b" * 300_000 + ".c", "+1" + " " * 1_000_000, "+" * 1_000_000, "1 " * 500_000):
        pii.base_spans(text)
    assert time.time() - began < 30
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices("a1.@-+% ", weights=[4, 2, 4, 3, 1, 1, 1, 1], k=rng.randint(0, 60)))
        got = [(s, e) for s, e, k in pii.base_spans(text) if k == "email"]
        assert got == [m.span() for m in re.finditer(PATTERNS["email"], text)], text
        text = "".join(rng.choices("12 .", weights=[4, 2, 1, 6], k=rng.randint(0, 60)))
        want = [m.span() for m in re.finditer(PATTERNS["ip"], text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [(s, e) for s, e, k in pii.base_spans(text) if k == "ip"] == want, text


def test_viterbi_is_best_path():
    tagger = pii.Tagger()
    rng = np.random.default_rng(5)
    k = len(tagger.labels)
    for size in (1, 2, 4):
        emit = rng.normal(0, 3, (3, 4, k))
        best = tagger.viterbi(emit, np.full(3, size))
        for n in range(3):
            def score(path):
                full = [0, *path, 0]
                return sum(tagger.move[a, b] for a, b in itertools.pairwise(full)) + sum(emit[n, t, y] for t, y in enumerate(path))
            assert math.isclose(score(best[n, :size]), max(score(p) for p in itertools.product(range(k), repeat=size)))


def test_tiling(spark):
    rng = random.Random(6)
    items = [prose(rng, 40) for _ in range(5)] + ["too short", None]
    words = items[0].split()
    swapped = " ".join(words[20:] + prose(rng, 3).split() + words[:20])
    rows = [(1, prose(rng, 50) + " " + items[1].upper() + ", " + prose(rng, 50)), (2, swapped), (3, prose(rng, 200)), (4, " ".join(words[:12]) + " " + prose(rng, 30)), (5, None), (6, ""), (2, swapped)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    for limit in (tiling.BROADCAST_BYTES, 0):
        got = sorted(tuple(r) for r in tiling.leaks(df, bench, broadcast_bytes=limit).collect())
        assert [(r[0], r[1]) for r in got] == [(1, 1), (2, 0), (2, 0)] and got[1][3] == 2 and got[0][2] == 1.0
    assert tiling.leaks(df, bench.limit(0)).collect() == [] and tiling.leaks(df.limit(0), bench).collect() == []


def test_tiles_are_greedy_and_apart():
    rng = np.random.default_rng(7)
    for _ in range(30):
        a, b = rng.integers(0, 3, 30), rng.integers(0, 3, 40)
        seeds = [(i, j) for i in range(27) for j in range(37) if (a[i : i + 4] == b[j : j + 4]).all()]
        if not seeds:
            continue
        got = tiling.tiles(a, b, np.array([s[0] for s in seeds]), np.array([s[1] for s in seeds]), 4)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)
        for side in (0, 1):
            covered = [k for t in got for k in range(t[side], t[side] + t[2])]
            assert len(covered) == len(set(covered))
        longest = max(n for n in range(4, 31) for i in range(31 - n) for j in range(41 - n) if (a[i : i + n] == b[j : j + n]).all())
        assert max(n for _, _, n in got) == longest


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 10)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 10, 1), (1003, [float("nan")] * 10, 1), (1004, [None] + [1.0] * 9, 1), (1005, [float("inf")] * 10, 1), (1006, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    for blocks in ((1024, 8192), (7, 50)):
        got = {}
        for r in ann.nearest(ann.build_index(df), ann.F.col("id") % 20 == 0, 20, *blocks).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert sorted(got) == list(range(0, 300, 20))
        for q, found in got.items():
            own = [(-float(ann.exact(x[i : i + 1].astype(float), x[q].astype(float))[0]), i) for i in range(300) if i != q]
            assert [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(own)[:20])] == sorted(found)
    assert ann.nearest(ann.build_index(df.limit(0)), ann.F.col("id") % 20 == 0).collect() == []


def test_neighbours_of_odd_rows(spark):
    """Ids beyond double precision stay whole beside null ids; vectors near the largest float have their neighbours."""
    big = 2**53 + 1
    rows = [(None, [1.0, 0.5]), (big, [1.0, 1.0]), (big + 2, [1.0, 0.9]), (20, [1.0, 1.0]), (40, [3e38, -3e38]), (60, [3e38, 3e38]), (61, [1e-38, 1e-38]), (20, [1.0, 0.0])]
    found = ann.nearest(ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), ann.F.col("id") % 20 == 0, 3).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q for q in got} == {20, 40, 60}
    assert [i for _, i in sorted(got[60])] == [20, big, big + 2] and all(i != 40 for _, i in got[40])
    assert all(r["score"] == r["score"] for r in found)


def test_neighbours_recall(spark):
    """Of the 20 nearest by brute force at least 0.999 are found, on vectors in clusters."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 64))
    x = (centres[rng.integers(0, 30, 4000)] * rng.uniform(0.2, 3, (4000, 1)) + rng.normal(size=(4000, 64)) * rng.uniform(0.1, 1, (4000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    hits = {}
    for r in ann.nearest(ann.build_index(df), ann.F.col("id") % 20 == 0, 20, 64, 500).collect():
        hits.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[::20].astype(float) @ x.astype(float).T
    scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    best = np.argsort(-scores, 1, kind="stable")[:, :20]
    assert sum(len(hits[20 * q] & set(b.tolist())) for q, b in enumerate(best)) / 4000 >= 0.999


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p {{}}</style><script>if (a < b) x("</p>")</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul>{nav}</ul></nav><div class="cookie-notice">We use cookies here.</div>
<div class="sidebar"><p>About us and more.</p></div><article><h1>Title {i} &amp; more</h1>{body}<form><p>Sign up</p></form></article>
<section id="comments"><p>Reader {i} says hello.</p></section><aside>Advert</aside><footer>Copyright</footer></body></html>"""


def test_html(spark):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(14):
        paragraphs = [prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{p} <b>x</b>&eacute;\n  y</p><!-- no -->" for p in paragraphs)
        nav = "".join(f"<li><a href='/{k}'>{k}</a></li>" for k in range(rng.randint(1, 5)))
        rows.append((i, f"http://h{i % 2}.example/{i}", PAGE.format(i=i, body=body, nav=nav)))
        truth[i] = "\n\n".join([f"Title {i} & more", *[f"{p} xé y" for p in paragraphs]])
    rows += [(20, "http://h0.example/", None), (21, None, "<p>Only a plain paragraph of text, long enough.</p>"), (22, "x", ""), (23, "http://h0.example/", "no tags at all & nothing"), (24, "http://z/", "<p>open <b>x<p>next"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    from patternmill.llm.common import stored

    wrappers = stored(html.learn_wrappers(df), "w")
    for limit in (1 << 20, 0):
        got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(df, wrappers, broadcast_bytes=limit).collect()]
        assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
        found = {i: t for i, t, _ in got}
        assert all(found[i] == t for i, t in truth.items()), next((found[i], t) for i, t in truth.items() if found[i] != t)
        assert (found[20], found[22], found[23]) == ("", "", "no tags at all & nothing") and "plain paragraph" in found[21] and found[24] == "open x\n\nnext"


def test_wrapper_groups():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x one two three</p>", "<ul><li>a</li><li>b</li><li>c</li></ul><p>y two three four</p>", "<ul><li>a</li><li>d</li></ul><hr><p>z three four five</p>"]
    made = html.infer(pages)
    assert "+" in made.source and "?" in made.source and "|" not in made.source
    assert all(made.match(html.tokens(p)) is not None for p in pages)
    assert html.Wrapper.loads(made.dumps()).match(html.tokens(pages[0])) == made.match(html.tokens(pages[0]))


def test_wrapper_matches_without_a_clock():
    """Nested groups that a backtracking matcher tries in exponentially many ways."""
    group = ("+", (("+", ("a", "#", ("?", ("b",)))), ("?", ("d",))))
    made = html.Wrapper([group, "c", "#"])
    long = [("a", "a", "")] * 3000
    end = [("c", "c", ""), ("#", "", "x")]
    assert made.match([*long, *end, ("c", "c", "")]) is None
    assert made.match([*long, *end]) == [(1, 3001)]


def test_wrapper_covers_what_it_was_aligned_with():
    rng = random.Random(10)
    for _ in range(60):
        pages = ["".join(rng.choice(["<p>x</p>", "<li>y", "<b>z</b>", "<hr>", "<p>u<br>v</p>"]) for _ in range(rng.randint(1, 9))) for _ in range(6)]
        made = html.infer(pages)
        assert all(made.match(html.tokens(p)) is not None for p in pages)


def test_html_keeps_short_and_linked_pieces():
    """Outside a marked main part only blocks of links and blocks constant over the host go."""
    rng = random.Random(11)
    pages, truth = [], []
    for i in range(6):
        line = prose(rng, 30)
        pages.append(
            f"<div><a href='/'>Home</a> <a href='/n'>News</a></div><h2>Title {i}</h2><p>{line} <a href='/x'>see {i}</a> and <b>so</b> on.</p>"
            f"<ul><li>one {i}</li><li>No.</li></ul><p>{i} May</p><p>{line}</p><div>All rights are ours, always and everywhere.</div>"
        )
        truth.append([f"Title {i}", f"{line} see {i} and so on.", f"one {i}", f"{i} May", line])
    made = html.infer(pages)
    for page, blocks in zip(pages, truth, strict=True):
        got = html.extract(page, made).split("\n\n")
        assert got == blocks
    alone = html.extract(pages[0], None).split("\n\n")
    assert "No." in alone and truth[0][1] in alone and not any("Home" in b for b in alone)


def test_wrappers_count_all_pages(spark):
    """Forty templates on one host, each with unnamed boilerplate that most pages share; a host of three pages."""
    rng = random.Random(12)
    rows, truth = [], []
    for i in range(120):
        body = [prose(rng, 12), prose(rng, 8)]
        extra = f"<table class='t{chr(97 + i % 40 // 8)}{chr(97 + i % 8)}'><tr><td>{prose(rng, 4)}</td></tr></table>"
        rows.append((i, "http://hot/" + str(i), f"{extra}<p>{body[0]}</p><p>{body[1]}</p><div>Printed on recycled pages since last year.</div>"))
        truth.append(body)
    for i in range(3):
        truth.append([prose(rng, 10)])
        rows.append((120 + i, f"http://small/{i}", f"<p>{truth[-1][0]}</p><p>All of us at small say hello.</p>"))
    rows += [(200 + i, "http://copies/", f"<p>{truth[0][0]}</p>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for limit in (1 << 20, 0):
        wrappers = html.stored(html.learn_wrappers(df, broadcast_bytes=limit), "w")
        made = {r["host"]: html.Wrapper.loads(r["wrapper"]) for r in wrappers.collect()}
        assert all(made["hot"].match(html.tokens(h)) is not None for i, _, h in rows if i < 120)
        found = {r["page_id"]: r["text"].split("\n\n") for r in html.extract_pages(df, wrappers, broadcast_bytes=limit).collect()}
        assert all(found[i][-len(t) :] == t for i, t in enumerate(truth))
        assert all(found[200 + i] == [truth[0][0]] for i in range(9))


def test_wrapper_repeats_long_cards():
    """A card of more than 16 tokens is a repeated group, whatever its length and number."""
    for size in (5, 40):
        card = "<div>" + "".join(f"<p class='c{chr(97 + k // 26)}{chr(97 + k % 26)}'>t</p>" for k in range(size)) + "</div>"
        made = html.infer([f"<h1>x</h1>{card * n}<hr>" for n in (2, 3)])
        assert made.match(html.tokens(f"<h1>x</h1>{card * 9}<hr>")) is not None
    rng = random.Random(13)
    for _ in range(300):
        nodes = rng.choices("abc", k=rng.randint(0, 30))
        plain, size = nodes, 1
        while 2 * size <= len(plain):
            out, i = [], 0
            while i < len(plain):
                n = 1
                while i + (n + 1) * size <= len(plain) and plain[i + n * size : i + (n + 1) * size] == plain[i : i + size]:
                    n += 1
                out.append(html._repeated(plain[i : i + size]) if n > 1 else plain[i])
                i += n * size if n > 1 else 1
            plain, size = out, size + 1
        assert html.fold(nodes) == plain


def test_tiling_of_short_and_unspaced_items(spark):
    items = ["Blue whale!", "敏捷的棕色狐狸跳过了懒狗", "สุนัขจิ้งจอกสีน้ำตาล", "Paris", "?!"]
    rows = [(0, "saw a blue, whale today"), (1, "blue sky and a whale"), (2, "昨天敏捷的棕色狐狸跳过了懒狗吗"), (3, "狗懒了过跳狐色棕的捷敏"), (4, "เห็นสุนัขจิ้งจอกสีน้ำตาลวิ่ง"), (5, "comparison"), (6, "PARIS"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    for limit in (tiling.BROADCAST_BYTES, 0):
        got = sorted((r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"]) for r in tiling.leaks(df, bench, broadcast_bytes=limit).collect())
        assert got == [(0, 0, 1.0, 1), (2, 1, 1.0, 1), (4, 2, 1.0, 1), (6, 3, 1.0, 1)]


def test_tiling_of_long_and_odd_rows(spark):
    """One word over and over in both, and ids that are null."""
    items = tiling.Items([(1, "so " * 120), (None, "a b c d e f")])
    began = time.time()
    found = {(k, i): t for k, i, t in items.search(["so " * 300_000, "x a b c d e f"])}
    assert time.time() - began < 60 and found == {(0, 0): [(0, 0, 120)], (1, 1): [(0, 1, 6)]}
    docs = spark.createDataFrame([(None, "x a b c d e f y"), (2, None), (2, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d e f"), (-1, "q r s t u v"), (3, None)], "item_id long, text string")
    for limit in (tiling.BROADCAST_BYTES, 0):
        got = sorted(((r["doc_id"], r["item_id"]) for r in tiling.leaks(docs, bench, broadcast_bytes=limit).collect()), key=str)
        assert got == [(2, None), (None, None)]


def test_language_of_signs(spark):
    """Fractions, superscripts and letter-like numbers are no letters."""
    df = spark.createDataFrame([(i, t, "en" if i < 40 else None) for i, t in enumerate(["some plain words here"] * 40 + ["²", "½ ¾", "Ⅷ", "① ②", "ª"])], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.train(df)).collect()}
    assert [found[i] for i in range(40, 45)] == ["und"] * 4 + ["en"]


def test_language_rejects_what_it_has_not_learned(spark):
    rng = random.Random(14)
    sounds = {"aa": ["ka", "mo", "tu", "ri"], "bb": ["sch", "enf", "olt", "ung"], "cc": ["ñe", "éa", "ço", "ü"]}

    def made(parts):
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 60)))

    learned = [(i, made(sounds[lang]), lang) for i, lang in enumerate(rng.choices(sorted(sounds), k=1800))]
    others = [["при", "вет", "ло", "ша"], ["xq", "zw", "jv", "kk"], ["αβ", "γο", "ως"], ["敏", "捷", "的", "棕"]]
    strange = [(5000 + i, made(others[i % 4]), None) for i in range(80)]
    strange += [(6000 + i, made(sounds["aa"] + sounds["bb"] + sounds["cc"]), None) for i in range(40)]
    df = spark.createDataFrame(learned + strange, "doc_id long, text string, lang string")
    model = langid.train(df)
    found = langid.identify(df, model).collect()
    held = [r["rejected"] for r in found if r["doc_id"] < 5000 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 350 and sum(held) <= 4
    assert all(r["rejected"] for r in found if 5000 <= r["doc_id"] < 6000)
    assert len(model.thresholds) > 3
    assert sum(r["rejected"] for r in found if r["doc_id"] >= 6000) >= 36
