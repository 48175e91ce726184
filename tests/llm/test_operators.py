import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vecmill.llm import line_dedup, mixing, near_dedup, packing, quality, secret_scan, sharding, topk, url_filter, warc
from vecmill.llm.common import WordHashes, cut

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_dropped string, kept int, blob string"
PASSAGE = "A shared passage of some length that is no short line"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n", "en", "a", 3), (4, PASSAGE + "\n" + PASSAGE.upper(), "en", "a", 1),
    (5, PASSAGE, "en", "a", 1), (5, PASSAGE, "en", "a", 1), (None, PASSAGE, "en", "b", 1), (6, "w " * 30_000, "de", None, 1),
    (7, " ".join(f"word{i}" for i in range(300)), "de", "b", 1), (8, " ".join(f"word{i}" for i in range(290)), "de", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_line_dedup(spark, odd, none):
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd).collect()}
    assert got[(4, ODD[3][1])] == (2, 0) and got[(5, "")] == (1, 1) and got[(None, PASSAGE)] == (1, 0)
    assert got[(1, "")] == (1, 0) and got[(3, " \n\t\n")] == (3, 0)
    assert line_dedup.dedup_lines(none).count() == 0
    hot = line_dedup.dedup_lines(odd, n_hot=0)
    assert sorted(map(str, hot.collect())) == sorted(map(str, line_dedup.dedup_lines(odd).collect()))


@pytest.mark.parametrize("module", [line_dedup, warc, topk, near_dedup, quality, url_filter])
def test_sql(spark, module):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    for name, sql in module.ORACLES.items():
        got, want = module.QUERIES[name](spark, DATA).toPandas(), c.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
        assert rows(got) == rows(want)


def plain_spans(text):
    text, out = text or "", []
    rules = [
        ("assign", re.compile("(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[1]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    for n, (kind, pattern, fine) in enumerate(rules):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if fine(m)]
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark, documents):
    got = {r.doc_id: r for r in secret_scan.op2_secret_scan(spark, DATA).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        assert got[doc_id].base_sha256 == hashlib.sha256(plain_spans(text).encode()).hexdigest()
    for text in ("secret: token: abcdefgh", "PassWord='abcdef' é token == x", "AKIA" + "A" * 16 + " " + "f" * 24, "ſecret=abcdefgh"):
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.scan_text(text) if k in secret_scan.BASE) == plain_spans(text)


def test_ledger_scans_only_what_is_unseen(spark, odd, none):
    first, ledger = secret_scan.scan_documents(odd)
    assert first.count() == len(ODD) and secret_scan.scan_documents(none)[0].count() == 0
    versions = secret_scan.with_blobs(odd.select("doc_id", "text").fillna("", ["text"]))
    assert ledger.count() == len({t or "" for _, t, *_ in ODD})
    assert secret_scan.scan_unseen(versions, ledger).count() == 0
    newer = (secret_scan.Rule("assign", 2, lambda t, low: [(0, 1)] if t else []), *secret_scan.RULES[1:])
    again = secret_scan.scan_unseen(versions, ledger, newer)
    assert again.count() == ledger.count() and {tuple(r.rules) for r in again.collect()} == {("assign@2",)}


def test_private_keys_are_found_whole():
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    text = f"a {key} b -----BEGIN PRIVATE KEY-----\n c -----BEGIN PRIVATE KEY----- {key}"
    starts = [m.start() for m in re.finditer("-----BEGIN", text)]
    want = [("pem", starts[0], starts[0] + len(key)), ("pem", starts[1], starts[1] + 27), ("pem", starts[2], starts[2] + 27), ("pem", starts[3], len(text))]
    assert secret_scan.scan_text(text) == want


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 60) for _ in range(40)), reverse=True)
        bins, want = [], []
        for s in sizes:
            fit = [(c, n) for n, c in enumerate(bins) if c >= s]
            n = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append(100)
            bins[n] -= s
            want.append(n)
        classes = sorted(Counter(sizes).items(), reverse=True)
        assert [b for _, n, b in sharding.best_fit_classes(classes, 100) for _ in range(n)] == want
        load, placed = Counter(), sharding.near_equal(classes, 8)
        for s, n, b in placed:
            load[b] += s * n
        assert len(load) <= 8 and max(load.values()) <= sum(sizes) / 8 + sizes[0]
        back = Counter()
        for s, n, _ in placed:
            back[s] += n
        assert back == Counter(sizes)


def test_shards(spark, documents, odd, none):
    rows = sharding.op3_sharding(spark, DATA).collect()
    text = dict(documents)
    assert len(rows) == len(documents)
    load, slots, of = Counter(), {}, {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())
    assert sharding.shard_documents(odd).count() == len(ODD) and sharding.shard_documents(none).count() == 0


def test_shards_beside_a_group_of_a_third_of_all_bytes(spark):
    rows = [(0, "x" * 100_000)] * 30 + [(n + 1, f"{n} " + "y" * (50 + n % 2500)) for n in range(5000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    large = {r.shard for r in got if r.doc_id == 0}
    assert len(large) == 1 and load[large.pop()] == 30 * 100_001 and len(load) == 8
    others = [b for b in load.values() if b != 30 * 100_001]
    assert len(others) == 7 and max(others) - min(others) < 0.001 * max(others)
    few = sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.size) for r in few) == [(1, 2), (2, 2), (3, 1)]
    assert len({r.shard for r in few}) == 2 and sorted(r.slot for r in few if r.size == 2) == [0, 1]


def plain_top(rows, queries, k):
    out = {}
    for qid in sorted({q for q, _ in queries}):
        q = min(v for i, v in queries if i == qid)
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))[:k]
        out[qid] = [(i, -s) for s, i in best]
    return {q: best for q, best in out.items() if best}


def test_top_k_of_ties_and_repeated_ids(spark):
    rng = random.Random(9)
    vector = lambda top: [rng.randint(-top, top) for _ in range(8)]
    cases = [
        [(rng.randint(0, 30), vector(2)) for _ in range(400)],  # ties, and ids with several vectors
        [(7, vector(9)) for _ in range(3000)] + [(n, vector(9)) for n in (0, 50)],  # blocks of one id
        [(n << 21, vector(300)) for n in range(100)] + [(5, [1, 2]), (0, [3, 4])],
    ]
    for rows in cases:
        frame = spark.createDataFrame([(*r, "z", 0) for r in rows], "id long, v array<long>, block string, rank int").select("id", "v")
        queries = [r for r in rows if r[0] % 50 == 0 or r[0] == 7]
        got = {}
        for r in sorted(topk.top_k(frame, spark.createDataFrame(queries, frame.schema), 5).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == plain_top(rows, queries, 5)
    huge = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "id long, v array<long>")
    with pytest.raises(Exception, match="over 64 bits"):
        topk.top_k(huge, huge, 5).collect()


def test_bounds_spare_rows():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100, 100, (8, 32)) * 4
    block = lambda c: topk.BlockIndex(np.arange(2048) + 2048 * c + 9, (centres[c] + rng.integers(-9, 9, (2048, 32))).astype(np.int64))
    blocks = [block(c) for c in range(8)]
    asked = topk.Asked(np.arange(4), (centres[:4] + rng.integers(-9, 9, (4, 32))).astype(np.int64), 5)
    scored = sum(asked.meet(b) for b in blocks)
    every = {int(i): x for b in blocks for i, x in zip(b.ids, b.exact)}
    for n, qid in enumerate(asked.ids):
        want = sorted((-int(asked.exact[n] @ x), i) for i, x in every.items())[:5]
        assert asked.found[n] == want
    assert scored < 0.5 * 4 * 8 * 2048


def test_warc(spark):
    schema = "page_id long, url string, html string, payload string"
    long = "x" * 200
    rows = [(1, "u", long, ""), (2, None, long, ""), (3, "u", "short", ""), (4, "u", "short", ""), (None, "u", None, ""), (5, "a\r\nb", "é" * 60, "")]
    pages = spark.createDataFrame(rows, schema)
    archives = warc.write_archives(warc.plan_records(pages))
    read = {r.record_id: r for r in warc.read_archives(archives).collect()}
    assert read["urn:page:2"].refers_to == "urn:page:1" and read["urn:page:2"].payload_bytes == 200 and read["urn:page:2"].payload is None
    assert read["urn:page:4"].record_type == "response" and read["urn:page:-"].payload_bytes == 0
    assert bytes(read["urn:page:5"].payload).decode() == "é" * 60
    assert warc.read_archives(archives.limit(0)).count() == 0


def test_archives_with_a_dictionary_and_damage():
    rng, writer, done = random.Random(1), warc.ArchiveWriter(), []
    records = []
    for n in range(4000):
        payload = " ".join(rng.choice(["alpha", "beta", "gamma", "<p>"]) for _ in range(60)).encode()
        records.append(warc.build_record(f"urn:page:{n}", "u", payload, hashlib.sha256(payload).hexdigest(), None))
    for r in records:
        if a := writer.add(r):
            done.append(a)
    while a := writer.close():
        done.append(a)
    assert all(warc.read_dictionary(a)[0] is not None for a in done)
    assert [f for a in done for f in warc.read_frames(a)] == records
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(done[0][:-3]))
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[0][:-1])
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1))
    headers, block = warc.parse_record(records[0])
    with pytest.raises(warc.WarcError):
        warc.parse_response(headers, block + b"x")


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark, documents, odd, none):
    rng, rows = random.Random(5), list(documents)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
    for n in range(60):  # near copies, of which many pairs are below the threshold
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(160)] = f"n{rng.randint(0, 10**6)}"
        rows.append((10_000 + n, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)
    small = {r.doc_id: r for r in near_dedup.near_duplicates(odd).collect()}
    assert small[8].component_id == 7 and small[None].component_id is None and small[1].n_shingles == 0 and small[3].component_id == 3
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(14)
    texts = [[f"t{rng.randint(0, 10**6)}" for _ in range(100)] for _ in range(4)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(100)] = f"e{rng.randint(0, 10**6)}"
        return " ".join(words)

    # 1 holds the first two texts, 2 and 3 a near copy of one each; 4 and 5 are of the third, 6 and 7 of the fourth and of both others
    rows = [(1, edited(texts[0], 0)), (1, edited(texts[1], 0)), (2, edited(texts[0], 1)), (3, edited(texts[1], 1)), (4, edited(texts[2], 0)), (5, edited(texts[2], 1))]
    rows += [(6, edited(texts[3], 0)), (7, edited(texts[3], 1)), (7, edited(texts[2], 2)), (8, edited([f"r{n}" for n in range(100)], 0))]
    rows += [(20 + n, edited(texts[n % 2], 2)) for n in range(30)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, **{20 + n: 1 for n in range(30)}}


def test_urls(spark):
    urls = [
        (1, "http://a.example.net/en/1", None), (2, "https://X.net/fr?x", None), (3, "http://example.net/", None), (4, "http://example.com/de/1#a", None),
        (5, "http://b.org/fr/", '<a href="http://c.org/x">'), (6, "http://example.net", None), (7, None, None), (8, "nonsense", ""),
        (9, "http://bad.com/", '<a href="http://spam.net/">'), (10, "http://c.org/z", ""), (11, "http://spam.net/", ""),
    ]
    got = {r.page_id: r for r in url_filter.judge_pages(spark.createDataFrame(urls, "page_id long, url string, html string")).collect()}
    rules = {n: got[n].rule for n in got}
    assert rules == {1: "example.net/en/", 2: "net/", 3: "net/", 4: "example.com/de/", 5: "org/fr/", 6: None, 7: None, 8: None, 9: None, 10: None, 11: "net/"}
    assert (got[2].host, got[2].path, got[6].path, got[7].host) == ("x.net", "/fr", "", "")
    assert got[9].verdict == "block" and got[9].distrust > 0  # it links to a blocked host
    assert got[10].verdict == "allow" and got[10].trust > 0
    assert url_filter.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 16)))] + [(300, None), (301, [float("nan")] * 16), (302, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = topk.integer_vectors(frame, "vec_id", "embedding")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(ints, ints.where("id % 50 = 0"), 5).collect()}
    v = np.floor(256 * np.array([r[1] for r in rows[:300]], dtype=np.float32).astype(float)).astype(int)
    for q in range(0, 300, 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(300) if i != q)[:5]
        assert [got[(q, n + 1)] for n in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 30 and topk.top_k(ints.limit(0), ints.limit(0)).count() == 0


def test_packing(spark, documents, odd, none):
    from tokenizers import Tokenizer

    rows = packing.op8_packing(spark, DATA).collect()
    encoder, pieces, sequences = Tokenizer.from_file(packing.tokenizer_path()), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in documents:
        ids = np.array(encoder.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(odd).select("doc_id").count() >= len(ODD) and packing.pack_documents(none).count() == 0
    same = spark.createDataFrame([(1, "one and the same row")] * 600, "doc_id long, text string")
    dealt = packing.pack_documents(same, length=64, group_pieces=50).collect()
    assert len(dealt) == 600 and len({r.sequence_id // (2 << 24) for r in dealt}) == 12  # no group takes them all
    strange = "Don't we'll I'M. <|endoftext|> A.B, x.,y ÀÉ. é İ. ß. ΣΑΣ. a b\tc\r\nd 12,5. 'S"
    assert packing.Encoder(packing.tokenizer_path()).ids(strange) == encoder.encode(strange, add_special_tokens=False).ids


def test_encoder_with_few_words_kept():
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path(), most=40, most_parts=30)
    rng, letters = random.Random(11), "abcdefgXYZàéîõüßÿÀÉ"
    known = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60)]
    ends = ["", "", "", ".", ",", "!!", "$$$", ".###", "]", "[\\", "`{}~", "|", "|>", "'s", "'", "!" * 8, "." * 9, "^_", "7"]
    for _ in range(150):
        text = rng.choice(" \n\t").join(rng.choice(known) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
        assert encoder.ids(text) == whole.encode(text, add_special_tokens=False).ids


def test_encoder_finds_plain_words_itself():
    """Case, marks, digits and endings don't make a stretch take the whole way, and a word is kept once, whatever is beside it."""
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    text = "(Straße) don't STRAßE,\t\"straße\" 12,5 a||b x_1\r\n[ÀÉ]... ÀÉ'll 'Straße's' " + "y" * 300

    def refused(*args, **more):
        raise AssertionError("took the whole way")

    encoder._encode = refused
    assert encoder.ids(text) == whole.encode(text, add_special_tokens=False).ids
    assert [w for w in encoder._parts if "straße" in w] == ["straße"] and len(encoder._known) == 0


def test_encoder_with_odd_characters():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    encoders = [packing.Encoder(packing.tokenizer_path(), *kept) for kept in ((), (5, 7))]
    rng, odd = random.Random(12), "\x00\x0b\x0c\x1c\x1f\x7f\x85\xa0ªµº×÷ĀſİıΣσς‘’“”\u0301\u0308\u2028\u3000Ⅷ²½中文語Жж😀\ufeffK"
    pieces = [*odd, *"aAeEoOßÀéÿÞ0179.,;'\"|<>-_", "'s", "'LL", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", *" \n\t\r" * 4]
    for n in range(400):
        among = pieces if n % 2 else [c for c in pieces if c not in odd]
        text = "".join(rng.choices(among, k=rng.randint(0, 60)))
        for encoder in encoders:
            assert encoder.ids(text) == whole.encode(text, add_special_tokens=False).ids, text
    long = ["x" * 5000 + str(n) + "中" * 5000 for n in range(8)]
    assert [encoders[1].ids(t) for t in long] == [whole.encode(t, add_special_tokens=False).ids for t in long]
    assert len(encoders[1]._known) <= 2  # long stretches count by their characters


def test_first_fit_decreasing():
    rng = random.Random(4)
    for _ in range(20):
        lengths, bins, want = [rng.randint(1, 100) for _ in range(50)], [], {}
        for n in sorted(range(50), key=lambda n: (-lengths[n], n)):
            b = next((i for i, c in enumerate(bins) if c >= lengths[n]), len(bins))
            if b == len(bins):
                bins.append(100)
            want[n] = (b, 100 - bins[b])
            bins[b] -= lengths[n]
        assert packing.first_fit_decreasing(lengths, 100) == [want[n] for n in range(50)]


def test_raking(spark, odd, none):
    rows = [(s, la, "t", n) for (s, la), n in zip(itertools.product("abc", "xy"), (10, 20, 30, 40, 50, 60))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    target = lambda d: spark.createDataFrame(list(d.items()), "value string, target double")
    goals = {"source": target({"a": 0.5, "b": 0.3, "c": 0.2}), "lang": target({"x": 0.6, "y": 0.4})}
    here = {(r.source, r.lang): r.n_tokens * r.factor for r in mixing.rake(cells, goals, 60).collect()}
    there = {(r.source, r.lang): r.n_tokens * r.factor for r in mixing.rake(cells, goals, 4, most=0).collect()}
    assert abs(sum(v for (s, _), v in here.items() if s == "a") - 0.5) < 1e-4
    assert abs(sum(v for (_, la), v in here.items() if la == "x") - 0.6) < 1e-4
    assert all(abs(here[k] - there[k]) < 1e-2 for k in here)
    mixed = mixing.sample_mix(odd).collect()
    assert len(mixed) == len(ODD) and all(0 <= r.probability <= 1 for r in mixed) and max(r.probability for r in mixed) == 1
    assert mixing.sample_mix(none).count() == 0


def test_quality(spark, odd, none):
    rng = random.Random(6)
    for _ in range(150):
        words = np.array([rng.randint(0, rng.choice([1, 3, 30])) for _ in range(rng.randint(0, 40))], dtype=np.uint64)
        n, w = len(words), words.tolist()
        want = [max((k for j in range(n) if j != i for k in range(n - max(i, j) + 1) if w[i : i + k] == w[j : j + k]), default=0) for i in range(n)]
        got = quality.suffix_repeats(words)
        assert got.tolist() == want
        windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
        marked = {j for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert quality.covered(got, 5) == len(marked)
    text = "a b\n \na b\n\na b\n#$"
    assert quality.measure(text, WordHashes())[:4] == (7, 8, 2, 2)
    got = quality.quality_verdicts(odd).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.kept for r in got}[7] and not {r.doc_id: r.kept for r in got}[6]
    assert quality.quality_verdicts(none).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")

    def repeated(width):
        windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        seen = Counter(windows)
        return len({j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + width)})

    return len(words) >= 10 and 100 * repeated(5) <= 20 * len(words) and 10 * repeated(8) <= len(words) and not repeated(51)


def plain_line_dedup(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, text in rows:
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    gone = lambda d, line: len(key(line)) >= 10 and min(holders[key(line)]) < d
    return [(d, "\n".join(line for line in text.split("\n") if not gone(d, line))) for d, text in rows]


def test_pipeline_is_that_of_plain_python(spark, documents, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng, documents = random.Random(15), list(documents)
    for n in range(5):  # near copies on one line each, which line dedup leaves
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for k in range(4):
            documents.append((10**6 + 10 * n + k, " ".join(words)))
            words[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
    frame = spark.createDataFrame([(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in documents], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(d, t or "") for d, t in documents if plain_quality(t)]
    lines = plain_line_dedup(kept)
    components = plain_components(lines)
    alone = [(d, t) for d, t in lines if components[d][1] == d]
    assert len(alone) < len(lines) < len(documents) and kept != lines
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES, (kept, lines, alone)):
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
    mixed = mixing.sample_mix(docs).collect()
    chosen = {r.doc_id: r.text for r in mixed if r.draw < r.probability}
    encoder, got = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == {d: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for d, t in chosen.items()}


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    import corpus_pipeline

    columns = list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, DATA).count() == 0
        assert stage(spark, odd, DATA).columns == columns, name
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, odd, DATA).collect()}
    assert 7 in kept and not {1, 2, 3, 6} & kept
    near = sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, odd, DATA).collect())
    assert near == sorted(["1", "2", "3", "4", "5", "5", "None", "6", "7"])  # 8 is a near copy of 7; rows of one id stay together
    assert corpus_pipeline.packing(spark, none, DATA).count() == 0 and corpus_pipeline.packing(spark, odd, DATA).count() >= len(ODD)


def test_pipeline_gives_workers_small_batches(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    most, setting = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

    def bounded(function):
        def made(*args):
            run = function(*args)

            def checked(batches):
                def each():
                    for batch in batches:
                        if batch.nbytes > most:
                            raise ValueError(f"a batch of {batch.nbytes} bytes")
                        yield batch

                return run(each())

            return checked

        return made

    for module, name in ((quality, "_measured"), (packing, "_cut_pieces")):
        monkeypatch.setattr(module, name, bounded(getattr(module, name)))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[-1]])
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(700))
    rows = [(n, text(), "en", "src", 0) for n in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(setting)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert spark.conf.get(setting) == before
    try:
        kept = cut(corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), DATA))
        assert kept.count() == len(rows)
        spark.conf.set(setting, "4096")
        corpus_pipeline.packing(spark, kept, DATA)
        assert spark.conf.get(setting) == "4096"
    finally:
        spark.conf.set(setting, before)


def test_near_duplicates_of_edited_copies(spark):
    """Copies of copies, with deletions, replacements and repeats: many of them near 0.75 of each other."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = [[word() for _ in range(120)] for _ in range(2)]
    for _ in range(240):
        text = list(texts[int(rng.integers(0, min(len(texts), 40)))])
        for _ in range(int(rng.integers(1, 6))):
            at, kind = int(rng.integers(0, len(text))), int(rng.integers(0, 3))
            text[at : at + 1] = [[], [word()], [text[at], text[at]]][kind]
        texts.append(text)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for v in range(len(texts)):
        for u in range(v):
            both = len(sets[u] & sets[v])
            if 100 * both >= 75 * (len(sets[u]) + len(sets[v]) - both) and root[u] != root[v]:
                low, high = sorted((root[u], root[v]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}
    assert len(set(root)) > 2


@pytest.mark.parametrize("file_rows", [50_000, 10])
def test_near_duplicates_write_few_files_for_few_links(spark, monkeypatch, file_rows):
    """Whatever the number of partitions: files of numbers of nodes and links follow these, also where they need several."""
    from vecmill.llm import common, components

    rng, rows, files = random.Random(21), [], {}
    for n in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        for _ in range(3):
            words[rng.randrange(80)] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    write = common.shared_table

    def counted(df, name, *bound):
        made = write(df, name, *bound)
        files.setdefault(name, []).append(len(made.inputFiles()))
        return made

    monkeypatch.setattr(common, "FILE_ROWS", file_rows, raising=False)
    monkeypatch.setattr(near_dedup, "shared_table", counted)
    monkeypatch.setattr(components, "shared_table", counted)
    settings = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)
    small = ("edges", "hooks", "pointers", "components", "sized", "sharing-nodes", "paired")
    most = max(n for name in small for n in files[name])
    assert most == 1 if file_rows == 50_000 else 1 < most <= 2 * len(rows) // file_rows + 1


def test_mixing_keeps_its_share_whatever_cells_are_rare(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source", "lang")
    rare = spark.createDataFrame([(-1, "five words in one cell", "rare", "xx")], docs.schema)
    before, after = ({r.doc_id: r for r in mixing.sample_mix(d).collect()} for d in (docs, docs.union(rare)))
    for got in (before, after):
        total = sum(r.n_tokens for r in got.values())
        assert abs(sum(r.n_tokens * r.probability for r in got.values()) / total - mixing.KEPT_SHARE) < 1e-3
        assert max(r.probability for r in got.values()) <= 1
    assert max(abs(before[d].probability - after[d].probability) for d in before) < 0.05


def test_bounded_raking(spark):
    rows = [(s, la, "t", n) for (s, la), n in zip(itertools.product("abc", "xy"), (10, 20, 300, 400, 500, 600))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    target = lambda d: spark.createDataFrame(list(d.items()), "value string, target double")
    goals = {"source": target({"a": 0.2, "b": 0.5, "c": 0.3}), "lang": target({"x": 0.55, "y": 0.45})}
    raked = mixing.rake(cells, goals, 60)
    here, there = ({(r.source, r.lang): r for r in mixing.bounded(raked, goals, 0.5, n, most=m).collect()} for n, m in ((60, 10), (6, 0)))
    kept = lambda f: sum(r.n_tokens * r.probability for k, r in here.items() if f(*k))
    # a gives all of its 30 tokens; b and c share the rest as 5 to 3
    for got, want in ((kept(lambda s, la: s == "a"), 30), (kept(lambda s, la: s == "b"), 885 * 5 / 8), (kept(lambda s, la: la == "x"), 915 * 0.55)):
        assert abs(got - want) < 1e-2
    assert all(abs(here[k].probability - there[k].probability) < 1e-2 for k in here) and len(there) == 6


def test_distrust_whatever_the_number_of_blocked_hosts(spark):
    page = lambda host, *to: (f"http://{host}/", " ".join(f'<a href="http://{t}/">' for t in to))
    rows = [page(f"spam{n}.net") for n in range(3000)] + [page("huge.net")] * 3000
    rows += [page("one.com", "spam7.net"), page("two.com", "spam8.net"), page("three.com", "spam8.net"), page("four.com", "plain.com"), page("plain.com")]
    rows += [page("c0.com", "spam9.net")] + [page(f"c{n}.com", f"c{n - 1}.com") for n in range(1, 21)]  # a chain of 21 links
    rows += [("http://good.org/fr/", '<a href="http://both.com/"><a href="http://both.com/"><a href="http://plain.com/">'), page("both.com", "spam8.net")]
    pages = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge_pages(pages).where("rule IS NULL").collect()}
    blocked = {h for h, r in got.items() if r.verdict == "block"}
    assert blocked == {"one.com", "two.com", "three.com", *(f"c{n}.com" for n in range(21))}
    assert got["both.com"].trust > got["both.com"].distrust > 0 and got["four.com"].distrust == 0


def test_propagation_is_the_plain_series(spark):
    rng = np.random.default_rng(12)
    n, links = 40, {}
    for _ in range(140):
        a, b = (int(x) for x in rng.integers(0, n, 2))
        if a != b and a % 7:  # hosts 0, 7, .. have no links: their mass ends there
            links[a, b] = int(rng.integers(1, 4))
    share = np.zeros((n, n))
    for (a, b), w in links.items():
        share[b, a] = w / sum(x for (c, _), x in links.items() if c == a)
    seeds = {3: 5.0, 8: 1.0, 21: 2.0}
    want = 0.15 * np.linalg.solve(np.eye(n) - 0.85 * share, np.array([seeds.get(i, 0.0) for i in range(n)]))
    frame = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in links.items()], "src string, dst string, weight long")
    start = spark.createDataFrame([(f"h{i}", m) for i, m in seeds.items()], "host string, mass double")
    got = {r.host: r.score for r in url_filter.propagate(frame, start).collect()}
    assert set(got) == {f"h{i}" for i in range(n) if want[i] > 1e-9}
    assert all(abs(got[f"h{i}"] - want[i]) < 1e-5 for i in range(n) if f"h{i}" in got)


def test_urls_that_are_odd(spark):
    schema = "page_id long, url string, html string, host string, rule string, verdict int"
    long = "http://plain.com/" + "x" * 200_000
    rows = [(1, "HTTP://A.NET", None), (1, "HTTP://A.NET", None), (None, None, None), (2, long, "<a href='http://b.net/'>" * 20_000), (3, "", ""), (4, "://", "")]
    got = url_filter.judge_pages(spark.createDataFrame([(*r, "h", "r", 1) for r in rows], schema)).collect()
    assert sorted((str(r.page_id), r.host, str(r.rule), r.verdict) for r in got) == sorted(
        [("1", "a.net", "None", "allow"), ("1", "a.net", "None", "allow"), ("None", "", "None", "allow"), ("2", "plain.com", "None", "block"), ("3", "", "None", "allow"), ("4", "", "None", "allow")]
    )


def test_mixing_of_the_query(spark, documents):
    """Tokens, topics and draws by plain Python; factors and probabilities by their marginals."""
    rows = {r.doc_id: r for r in mixing.op9_mixing(spark, DATA).collect()}
    assert len(rows) == len(documents)
    for doc_id, text in documents:
        r, text = rows[doc_id], text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        per = lambda c: 100 * len(re.findall(c, text))  # noqa: B023, E731
        topic = "table" if per(r"\|") > 10 * len(words) else "list" if per("\n") > 10 * len(words) else "numeric" if per("[0-9]") > 20 * len(words) else "prose"
        assert (r.n_tokens, r.topic) == (len(words), topic)
    cells = {}
    for r in rows.values():
        cells.setdefault((r.source, r.lang, r.topic), []).append(r)
    assert all(len({(round(r.weight, 12), round(r.probability, 12)) for r in c}) <= 2 for c in cells.values())  # 0 without tokens
    total = sum(r.n_tokens for r in rows.values())
    assert abs(sum(r.n_tokens * r.probability for r in rows.values()) / total - mixing.KEPT_SHARE) < 1e-3
    for margin in mixing.MARGINS:
        sums, kept, raked = Counter(), Counter(), Counter()
        for r in rows.values():
            sums[r[margin]] += r.n_tokens
            kept[r[margin]] += r.n_tokens * r.probability
            raked[r[margin]] += r.n_tokens * r.weight
        goal = {v: t**mixing.FLATTEN for v, t in sums.items() if t}
        for v, g in goal.items():
            want = g / sum(goal.values())
            assert abs(raked[v] - want) < 1e-3
            assert kept[v] / sums[v] > 0.999 or abs(kept[v] / (mixing.KEPT_SHARE * total) - want) < 0.05


def test_url_sql_with_links(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng, rows = random.Random(13), []
    hosts = [f"h{n}.com" for n in range(25)] + [f"s{n}.net" for n in range(4)] + ["a.org", "b.org", "www.example.net", "Example.com"]
    for n in range(300):
        links = [rng.choice(["http://", "HTTPS://", "//", "/"]) + rng.choice(hosts) + rng.choice(["", "/", "/en/x", "/de/?y", "#z"]) for _ in range(rng.randint(0, 4))]
        html = "".join(rng.choice(["<a href='{}'>", '<a HREF = "{}">', "<a href={}>"]).format(x) for x in links)
        if n % 10 == 0:
            rows.append((n, f"http://{rng.choice(['a.org', 'b.org'])}/fr/{n}", html))
            continue
        rows.append((n, rng.choice(["http://", "https://", ""]) + rng.choice(hosts[:-9] if n % 3 else hosts) + rng.choice(["", "/", "/en/1", "/de/1", "/fr/2?q"]), html if n % 11 else None))
    pages = spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute(url_filter.ORACLES["op6_url_filter"]).fetchall()
    got = url_filter.op6_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert len({(r.rule is None, r.verdict) for r in got}) == 4  # propagation blocks some


def test_distrust_of_hosts_without_pages(spark):
    rows = [
        ("http://bad.com/", '<a href="http://spam.net/">'), ("http://bare.com/", '<a href="https://SPAM.net">'), ("http://relative.com/", "<a href=//other.net/x?y>"),
        ("http://fine.com/", '<a href="http://a.example.net/en/1"><a href="http://example.com/de/"><a href="/net/"><a href="http://plain.com/">'),
        ("http://far.com/", '<a href="//bad.com/">'), ("http://seen.com/", '<a href="//example.net/b">'), ("http://www.example.net/en/", None),
    ]
    pages = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in url_filter.judge_pages(pages).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad.com", "bare.com", "relative.com", "far.com", "seen.com"}


def test_covered_limit_rejects_what_the_base_keeps(spark):
    passage = lambda n: " ".join(f"p{i}" for i in range(n))
    rest = lambda n: " ".join(f"r{i}" for i in range(n))
    rows = [(1, f"{passage(15)} x {passage(15)} {rest(169)}"), (2, f"{passage(9)} x {passage(9)} {rest(181)}"), (3, f"{passage(7)} x {passage(7)} {rest(85)}")]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[n].n_words, got[n].n_repeat_words, got[n].n_covered) for n in (1, 2, 3)] == [(200, 30, 30), (200, 18, 18), (100, 14, 0)]
    assert not any(r.base_failed or r.longest_repeat > quality.MAX_LONGEST for r in got.values())
    assert not got[1].kept and got[2].kept and got[3].kept


def plain_loads(sizes, bins):
    """Loads of the bins: large groups alone, the others by best fit of one after the other."""
    sizes, alone = sorted(sizes, reverse=True), []
    while sizes and bins > 1 and sizes[0] * bins > sum(sizes):
        alone.append(sizes.pop(0))
        bins -= 1

    def fit(capacity):
        loads = []
        for s in sizes:
            able = [(capacity - load, n) for n, load in enumerate(loads) if load + s <= capacity]
            if able:
                loads[min(able)[1]] += s
            elif len(loads) == bins:
                return None
            else:
                loads.append(s)
        return loads

    low = high = max(sizes[0], -(-sum(sizes) // bins))
    step = max(1, high // 1024)
    while fit(high) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if fit(mid) is None else (low, mid)
    return sorted(alone + fit(high))


def test_shards_are_those_of_plain_best_fit(spark, documents):
    groups = Counter()
    for _, text in documents:
        groups[text or ""] += len((text or "").encode()) + 1
    load = Counter()
    for r in sharding.op3_sharding(spark, DATA).collect():
        load[r.shard] += r.size
    assert sorted(load.values()) == plain_loads(groups.values(), 8)
    rng = random.Random(10)
    for _ in range(20):
        sizes = [rng.randint(1, 40) for _ in range(60)] + [rng.randint(1, 900) for _ in range(rng.randint(0, 3))]
        got = Counter()
        for size, n, number in sharding.near_equal(sorted(Counter(sizes).items(), reverse=True), 5):
            got[number] += size * n
        assert sorted(got.values()) == plain_loads(sizes, 5)


def test_shards_of_a_capacity(spark):
    rng = random.Random(8)
    groups = {n: [rng.randint(1, 30) for _ in range(rng.randint(1, 3))] for n in range(60)} | {60: [70, 70]}
    frame = spark.createDataFrame([(n, -n, s) for n, g in groups.items() for s in g], "g1 long, g2 long, size long")
    rows = sharding.shard_groups(frame, capacity=100).collect()
    load, of = Counter(), {}
    for r in rows:
        load[r.shard] += r.size
        assert of.setdefault(r.g1, r.shard) == r.shard
    assert len(rows) == frame.count() and [n for n in of if of[n] == of[60]] == [60]
    assert all(b <= 100 for s, b in load.items() if s != of[60])
    sizes = sorted((sum(g) for g in groups.values()), reverse=True)
    assert len(load) == max(b for *_, b in sharding.best_fit_classes(sorted(Counter(sizes).items(), reverse=True), 100)) + 1 <= 1.25 * sum(sizes) / 100 + 1
    for wrong in ({}, {"shards": 2, "capacity": 9}, {"capacity": 0}):
        with pytest.raises(ValueError):
            sharding.shard_groups(frame, **wrong)
