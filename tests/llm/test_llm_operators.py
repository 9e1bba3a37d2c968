"""Operators against brute force, round trips and held-out labels."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeloom.llm import bpe, common, components, html, media, packing, quality, simhash, suffix, tokencount, topk, toxicity

ODD = [(1, "héé wörld 日本 🎉🎉x it's  \n\n b"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (5, "<|endoftext|> don't\t 123 "), (None, "null id"), (6, "word " * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"score": F.lit("own"), "fp": F.lit(1), "row": F.lit(2), "source": F.lit(None).cast("string"), "runs": F.lit("r")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def tiktoken_ids():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe(docs, none):
    path, ids_of = public_tokenizers.path("byte_bpe_50k.json"), tiktoken_ids()
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    assert sorted((r.ids, bytes(r.decoded)) for r in got.collect()) == sorted((ids_of(t or ""), (t or "").encode()) for _, t in ODD)
    first = got.where("doc_id = 1").first()
    assert [ODD[0][1][a:b] for a, b in zip(first.starts, first.ends)][:4] == ["h", "é", "é", " w"]
    back = bpe.decode(got.select("doc_id", "ids"), path)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in ODD)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_audio(docs, none):
    rows = media.audio_clips(docs).collect()
    assert len(rows) == len(ODD)
    texts = collections.defaultdict(set)
    for r in rows:
        rate, stored = media.wav_samples(bytes(r.media))
        n = r.n_bytes
        assert rate == 12_000 and len(stored) == r.payload_bytes and r.payload_bytes % 64 == 0 and r.payload_bytes >= 64
        texts[bytes(stored[:n])].add(bytes(r.features))
        table = media.read_features(bytes(r.features))
        assert table["tensor"].type.shape == [64, 32] and table.num_rows == -(-r.n_frames // 64)
        assert sum(len(s) for s in table["segments"].to_pylist()) == r.n_segments
    assert all(len(v) == 1 for v in texts.values()) and set(texts) == {(t or "").encode() for _, t in ODD}
    assert media.audio_clips(none).count() == 0


def test_resampler_and_energy():
    rng = np.random.default_rng(0)
    for source, target in ((12_000, 8_000), (8_000, 12_000), (11_025, 8_000)):
        r, x = media.Resampler(source, target), rng.standard_normal(300)
        wide = np.zeros(len(x) * r.up)
        wide[:: r.up] = x
        want = np.convolve(wide, r.taps)[r.wide :][:: r.down]
        got = r(x)
        n = min(len(got), len(want))
        assert np.allclose(got[:n], want[:n])
    assert media.hysteresis(np.array([0, 1, 3, 1, 0, 1, 1, 0.0]), 0.5, 2).tolist() == [[1, 4]]
    assert media.hysteresis(np.zeros(3), 0.5, 2).tolist() == []


def test_audio_digests(spark, sf):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    for r in media.op1_audio_features(spark, sf).collect():
        p = media.text_payload(texts[r.doc_id])
        m = media.wav_bytes(p, 12_000)
        want = (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest())
        assert tuple(r)[1:7] == want


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 64]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [1.0, 2.0]), (305, []), (0, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(9))
    q = np.array([[np.floor(64 * x) for x in v] for _, v in rows[:300]])
    want = set()
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:20]
        copies = [j for j in best for _ in range(2 if j == 0 else 1)][:20]
        want |= {(i, k + 1, j, int(s[j])) for k, j in enumerate(copies)}
    got = {tuple(r) for r in topk.top_k(df.repartition(5), F.col("vec_id") % 20 == 0).collect()}
    assert {r for r in got if r[0] < 300} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op6_top_k(spark, sf).collect())) == sorted(c.sql(topk.OP6_SQL).fetchall())


def test_packing(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab" if rng.random() < 0.6 else "cdef"), rng.choice([str(rng.randrange(40)), str(i)]), rng.randrange(1, 260)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, c string, n long").withColumn("text", F.lit(""))
    got = packing.pack(df, 100, 2, cluster=F.col("c"), tokens=F.col("n")).toPandas()
    size, source, cluster = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == size
    for _, part in got.groupby("bin_id"):
        assert part.n_tokens.sum() <= 100 and part.position.tolist() is not None
        if len(part) > 1:
            assert max(collections.Counter(source[d] for d in part.doc_id).values()) <= 2
            assert max(collections.Counter(cluster[d] for d in part.doc_id).values()) == 1
    assert len(packing.pack(docs, 100).toPandas().doc_id) > len(ODD) and packing.pack(none).count() == 0


def test_best_fit_is_tightest():
    import pandas as pd

    rng = random.Random(4)
    rows = pd.DataFrame({"doc_id": range(400), "piece": 0, "row": range(400), "n_tokens": [rng.randrange(1, 60) for _ in range(400)], "source": [rng.choice("aabbcde") for _ in range(400)], "cluster": [str(rng.randrange(90)) for _ in range(400)]})
    got = packing.pack_shard(rows, 100, 2)
    bins: list[dict] = []
    for r in got.itertuples():
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= r.n_tokens and b["s"][r.source] < 2 and r.cluster not in b["c"]]
        if fits:
            assert bins[r.bin]["left"] == min(fits)[0] and (bins[r.bin]["left"], r.bin) in fits
        else:
            assert r.bin == len(bins)
            bins.append({"left": 100, "s": collections.Counter(), "c": set()})
        b = bins[r.bin]
        b["left"] -= r.n_tokens
        b["s"][r.source] += 1
        b["c"].add(r.cluster)


@pytest.mark.parametrize("block", [2, 4, 6, 10, 1000])
def test_separator_scan(spark, tmp_path, block):
    np.array([1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 1, 2, 3, 9, 5, 9, 9, 1], "<u2").tofile(tmp_path / "x.bin")
    np.zeros(0, "<u2").tofile(tmp_path / "e.bin")
    np.array([9], "<u2").tofile(tmp_path / "s.bin")
    got = tokencount.count_tokens(spark, str(tmp_path), 9, 2, block)
    rows = lambda name: [(r.ordinal, r.start, r.n_tokens) for r in got.where(F.col("file").endswith(name)).orderBy("ordinal").collect()]
    assert rows("x.bin") == [(0, 0, 2), (1, 3, 0), (2, 4, 9), (3, 14, 1), (4, 16, 0), (5, 17, 1)]
    assert rows("e.bin") == [] and rows("s.bin") == [(0, 0, 0)]


def test_separator_scan_of_documents(spark, sf):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in common.table(spark, sf, "documents").collect()}
    assert {r.doc_id: r.n_tokens for r in tokencount.op8_separator_scan(spark, sf).collect()} == want


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_large_token_files_are_the_work_of_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "TASK_BYTES", 1 << 18)
    ids = np.random.default_rng(2).integers(0, 50, 1 << 20).astype("<u2")
    ids.tofile(tmp_path / "x.bin")
    ends = np.flatnonzero(ids == 9)
    sizes = np.append(np.diff(np.concatenate(([-1], ends))) - 1, [len(ids) - ends[-1] - 1] if ends[-1] < len(ids) - 1 else [])
    assert tokencount.read_blocks(spark, str(tmp_path), 2, 1 << 16).rdd.getNumPartitions() > 4
    got = tokencount.count_tokens(spark, str(tmp_path), 9, 2, 1 << 16).orderBy("ordinal").toPandas()
    assert got["n_tokens"].tolist() == sizes.tolist()


def test_separator_scan_of_odd_documents(spark, docs, none):
    import tiktoken

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in ODD), key=str)
    for rows, per_file in ((docs.repartition(3), 2), (docs.coalesce(1), 3), (docs, 4096)):
        held = common.materialize(rows.select("doc_id", "text"), "test-tokens")
        got = tokencount.counted_documents(held, ranks, public_tokenizers.PATTERN, 50256, rows_per_file=per_file)
        assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want

    def otherwise(batches):
        """The rows in another order every time."""
        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        random.SystemRandom().shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    turned = docs.select("doc_id", "text").mapInArrow(otherwise, "doc_id long, text string")
    got = tokencount.counted_documents(turned, ranks, public_tokenizers.PATTERN, 50256, rows_per_file=4)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    got = tokencount.counted_documents(held, ranks, public_tokenizers.PATTERN, 50256)
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want
    assert tokencount.counted_documents(none, ranks, public_tokenizers.PATTERN, 50256).count() == 0
    common.release(spark, "test-tokens")


def test_packed_sequences(spark, docs, none):
    rows = packing.sequences(docs, "<e>", capacity=100).collect()
    assert all(r.n_tokens == len(r.tokens) <= 100 for r in rows)
    found = collections.Counter(t for r in rows for t in r.tokens)
    want = collections.Counter(w for _, t in ODD for w in [*re.findall("[^\x20\x09-\x0d]+", t or ""), "<e>"])
    assert found == want and packing.sequences(none).count() == 0


def test_packing_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    got = packing.op4_best_fit(spark, sf).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: len(re.findall("[^\x20\x09-\x0d]+", t)) + 1 for i, t in texts.items()}
    assert got.groupby("bin_id").n_tokens.sum().max() <= 2048


def test_simhash(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i: (f"{fp[i]:016x}", find(i)) for i in ids}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf).collect()} == want
    odd = simhash.near_components(docs)
    assert odd.count() == len(ODD) and {r.component_id for r in odd.where("fp = 0").collect()} == {2}
    assert simhash.near_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("class_rows", [simhash.CLASS_ROWS, 150])  # the second splits classes by further bits
def test_ball_links_of_clusters(spark, monkeypatch, class_rows):
    monkeypatch.setattr(simhash, "UNFOLD", 20_000)  # so that the next bits split the work
    rng = random.Random(6)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centers for _ in range(25)} | {0, 3}
    fps |= {centers[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(a)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    links = simhash.ball_links(spark.createDataFrame([(x, x) for x in signed], "fp long, id long"), len(fps), class_rows=class_rows).collect()
    group = lambda pairs: components_of(signed, pairs)
    assert group([(r.a, r.b) for r in links]) == group([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4])


def components_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components_of({x for p in pairs for x in p}, pairs)
    assert all(want[n] == r for n, r in got.items()) and {n for n in want if want[n] != n} <= set(got)


def test_near_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    base = [[word() for _ in range(300)] for _ in range(30)]
    rows, owner = [], {}
    for k, words in enumerate(base):
        for _ in range(4):
            copy = list(words)
            if _:
                copy[rng.randrange(300)] = word()
            owner[len(rows)] = k
            rows.append((len(rows), " ".join(copy)))
    left = [r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame([*rows, (None, "x"), (900, "")], "doc_id long, text string")).collect()]
    assert sorted(x for x in left if x is not None) == [*range(0, 120, 4), 900] and None in left


def near_groups(rows, words=5, least=0.8):
    """Smallest ids of the groups by brute force over all pairs."""
    sets = {i: {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} for i, w in ((i, t.split()) for i, t in rows)}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    return components_of(sorted(sets), pairs)


def test_near_copies_around_another_centre(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for k in range(3):
        words = [f"w{k}x{n}" for n in range(200)]
        rows.append((len(rows), " ".join(rng.sample(words, 200))))  # the smallest id: the same words in another order
        for _ in range(12):
            at, copy = rng.randrange(199), list(words)
            copy[at], copy[at + 1] = copy[at + 1], copy[at]
            rows.append((len(rows), " ".join(copy)))
    want = near_groups(rows)
    assert len(set(want.values())) == 6
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 5):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "CENTRES", min(block, 16) // 4 + 1)
        assert sorted(r.doc_id for r in simhash.drop_near_copies(frame).collect()) == sorted(set(want.values()))


EDITS = ["one word", "three words", "passage of a tenth added", "passage of a quarter added", "a sixth cut off", "words twice"]


def test_near_copies_by_kind_of_edit(spark):
    """Nothing goes that brute force would keep; how many copies of a Jaccard similarity of 0.8 are found depends on the edit."""
    rng = random.Random(21)
    fresh = (f"v{n}" for n in range(10**6))
    common = [next(fresh) for _ in range(40)]  # one passage that many texts share
    rows, kinds = [], {}
    for k in range(60):
        words = [next(fresh) for _ in range(rng.choice([60, 100, 150, 300]))] + common * (k % 2)
        n = len(words)
        at = rng.sample(range(n), 3)
        copies = [[next(fresh) if i == at[0] else w for i, w in enumerate(words)], [next(fresh) if i in at else w for i, w in enumerate(words)]]
        copies += [[next(fresh) for _ in range(n // share)] + words for share in (10, 4)] + [words[: n - n // 6], words + words]
        base = len(rows)
        rows.append((base, " ".join(words)))
        for kind, c in zip(EDITS, copies):
            kinds[len(rows)] = (kind, base)
            rows.append((len(rows), " ".join(c)))
    want = near_groups(rows)
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] == want[g] for i, g in got.items())
    recall = {}
    for kind in EDITS:
        near = [i for i, (k, base) in kinds.items() if k == kind and want[i] == want[base]]
        recall[kind] = (sum(got.get(i) == got.get(kinds[i][1], kinds[i][1]) for i in near) / len(near) if near else None, len(near))
    print(recall)
    assert recall["one word"][0] >= 0.95 and recall["three words"][0] >= 0.7 and recall["words twice"][0] >= 0.95


def test_near_copies_of_ids_with_two_texts(spark):
    words = [f"a{k}" for k in range(80)]
    rows = [(1, " ".join(words)), (1, "another text of the same id"), (2, " ".join(words)), (2, "something that has no copy at all"), (3, " ".join(words).upper()), (4, " ".join(words[:-1]) + " changed"), (4, None), (None, " ".join(words)), (5, "x " * 30_000), (6, "x " * 30_000 + "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"th": F.lit(0), "key": F.lit("k"), "gone_id": F.lit(1)})
    left = [(r.doc_id, r.text) for r in simhash.drop_near_copies(frame).collect()]
    assert sorted(left, key=str) == sorted([rows[k] for k in (0, 1, 3, 6, 7, 8)] + ([rows[9]] if rows[9] in left else []), key=str)
    assert simhash.drop_near_copies(frame.limit(0)).count() == 0


def brute_repeats(texts, size):
    count = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept


def test_repeated_starts():
    rng = random.Random(3)
    for _ in range(150):
        letters, size = rng.choice([b"ab", b"abc", b"a", bytes(range(1, 255)), b"\0\xff"]), rng.choice([3, 5, 8])
        parts = list({bytes(rng.choice(letters) for _ in range(rng.randint(size, 40))) for _ in range(rng.randint(1, 6))})
        times = np.array([rng.choice([1, 1, 2]) for _ in parts])
        count = collections.Counter()
        for p, k in zip(parts, times, strict=True):
            for i in range(len(p) - size + 1):
                count[p[i : i + size]] += int(k)
        for p, runs in zip(parts, suffix.repeated_starts(parts, times, size), strict=True):
            assert [i for a, b in runs for i in range(a, b + 1)] == [i for i in range(len(p) - size + 1) if count[p[i : i + size]] > 1]


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    for _ in range(20):
        a, b = rng.choice(texts), rng.choice(texts)
        x = rng.randint(0, len(a))
        texts.append(b[: rng.randint(0, len(b))] + a[x : x + rng.randint(300, 1500)] + "é" * rng.randint(0, 3) + b[-50:])
    texts += ["x" * 1000, "x" * 399, "x" * 400, "", "ab" * 900, texts[0], texts[0]]
    texts += [rng.choice(words) * rng.randint(0, 20) + texts[5][:700] + rng.choice(words) * rng.randint(1, 90) for _ in range(25)]
    got = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    want = dict(enumerate(brute_repeats([t.encode() for t in texts], 400)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()} == want
    odd = suffix.remove_repeats(docs)
    assert odd.count() == len(ODD) and odd.where("doc_id = 6").first().n_removed == 45_000
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_grams_of_any_size():
    data = np.frombuffer(b"abcabcabdabcabcabd" * 3, np.uint8)
    for size in (1, 2, 3, 7, 8, 12, 17):
        h = suffix.gram_hashes(data, size)
        grams = [bytes(data[k : k + size]) for k in range(len(data) - size + 1)]
        assert len(h) == len(grams) and len({*zip(grams, h.tolist())}) == len(set(grams)) == len(set(h.tolist()))
    assert suffix.finer_grams(400, 128) == [256, 384, 400] and suffix.finer_grams(192, 64) == [128, 185, 192] and suffix.finer_grams(8, 8) == []


def test_suffix_dedup_of_a_hot_passage(spark, monkeypatch):
    """A passage in many surroundings: its segments are cut by all longer grams, and the result is that of brute force."""
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", 5)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for size in (130, 300, 398, 420):
        passage = " ".join(word() for _ in range(90))[:size]
        texts = [" ".join(word() for _ in range(60)) + passage + " ".join(word() for _ in range(60)) for _ in range(40)]
        got = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        want = dict(enumerate(brute_repeats([t.encode() for t in texts], 400)))
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()} == want


def test_suffix_dedup_of_clashing_names_and_short_passages(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"one {passage} end"), (2, f"two {passage} more"), (3, "short line " * 25), (4, None), (4, "short line " * 25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = frame.withColumns({c: F.lit(c) for c in ("_id", "_h", "_text", "_runs", "_doc", "_k0", "runs", "h", "seg", "start", "kept", "n_bytes")})
    for df in (frame, clash):
        got = suffix.remove_repeats(df, 192, 64, text=True, least_words=55).collect()
        want = [(1, "one" + "end"), (2, "two" + "more"), (3, rows[2][1]), (4, ""), (4, rows[2][1])]
        assert sorted((r.doc_id, r.kept_text) for r in got) == want
        assert {r.n_spans for r in got if r.doc_id in (1, 2)} == {1} and {r.n_removed for r in got if r.doc_id in (3, 4)} == {0}
    kept = suffix.remove_repeats(clash, 192, 64, keep=("_runs", "_id")).collect()
    assert len(kept) == 5 and {(r._runs, r._id) for r in kept} == {("_runs", "_id")}


def test_suffix_query(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf, "documents").collect()}
    want = dict(zip(texts, brute_repeats(list(texts.values()), 400)))
    for r in suffix.op7_suffix_dedup(spark, sf).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert tuple(r)[1:5] == (n, removed, spans, hashlib.sha256(kept).hexdigest()) and r.text == kept.decode("utf-8", "ignore")


def test_bpe_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    ids_of = tiktoken_ids()
    for r in bpe.op9_byte_bpe(spark, sf).collect():
        ids = ids_of(texts[r.doc_id])
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        assert tuple(r)[1:4] == want


PAGE = """<html><body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav>menu</nav><div class="notice">Cookies</div>
<article><header><h1>Title &amp; more</h1></header><p>One <b>two</b><br>three<p>Four &copy; &am<ul><li>a<li>b</ul><div class="ad">buy</div><form>f</form>
<p>Same line in every page</p><p>own {k}</p><section class="comments"><article><p>nice</p></article></section></article><aside>side</aside><footer>f</footer><script>var a="</p>"</script>"""


def test_html(spark):
    rows = [(k, f"https://h.example/{k}", PAGE.replace("{k}", str(k))) for k in range(12)]
    rows += [(20, None, None), (21, "x", ""), (22, "https://one.example", "<div id=top>menu</div><div class=post><h1>T</h1><p>long text here</p><p>more</p></div><div class=footer>x"), (22, "https://h.example/0", PAGE.replace("{k}", "0"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own"))
    got = html.extract_text(df).collect()
    assert len(got) == len(rows)
    text = {(r.page_id, r.url): r.text for r in got}
    article = "Title & more\n\nOne two three\n\nFour © &am\n\na\n\nb\n\nSame line in every page\n\nown "
    assert all(text[k, f"https://h.example/{k}"] == article + str(k) for k in range(12))  # what pages repeat stays
    assert text[20, None] == "" and text[21, "x"] == "" and text[22, "https://one.example"] == "T\n\nlong text here\n\nmore"
    for pages in (1, 2, 7, 9):
        few = html.extract_text(df.where(f"page_id < {pages}")).where("page_id = 0").first()
        assert few.text == article + "0" and few.n_chars == len(few.text)
    assert html.extract_text(df.limit(0)).count() == 0


def test_html_slots_of_the_template(spark):
    """Without article and main part the template tells the main slot; class names count where the template has them."""
    body = lambda k: "".join(f"<p>Paragraph {j} of story {k}, {'long ' * 30}</p>" for j in range(2 + k % 3))
    page = '<html><body><div class="top"><a href=/>Home</a> <a href=/x>More pages</a></div><div class="wrap"><div class="story"><h1>Story {k}</h1>{body}<div class="share"><a href=#>Share {k}</a></div></div><div class="right"><p>Box {k}</p></div></div><div class="end">All rights</div></body></html>'
    rows = [(k, f"https://n.example/{k}", page.replace("{k}", str(k)).replace("{body}", body(k))) for k in range(6)]
    special = page.replace("{k}", "9").replace("{body}", '<p class="related">On related matters</p><div class="social history">A social history</div>' + body(9))
    rows.append((9, "https://n.example/9", special))
    got = {r.page_id: r.text.split("\n\n") for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == [f"Story {k}", *(f"Paragraph {j} of story {k}, {'long ' * 30}".strip() for j in range(2 + k % 3))]
    assert got[9][:3] == ["Story 9", "On related matters", "A social history"] and len(got[9]) == 3 + 2
    found = html.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert found.main_path == "/html/body/div.wrap/div.story" and any(c.parent >= 0 for c in found.classes)


def test_html_pages(spark, sf):
    import html as entities

    source = {r.page_id: r.html for r in common.table(spark, sf, "pages").collect()}
    for r in html.op3_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", q)).split()) for q in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p)


def rank_sum(y, p):
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_quality_held_out(spark, docs):
    sf = "/root/testdata/sf0.1"
    scored = quality.op10_quality(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert rank_sum(scored.quality.values, scored.score.values) > 0.99 and (scored.predicted == scored.quality).mean() > 0.98
    model = quality.AdditiveModel().fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    odd = quality.score_quality(docs, model, keep=("runs",))
    assert odd.count() == len(ODD) and quality.score_quality(docs.limit(0), model).count() == 0


def test_toxicity_gradients():
    net = toxicity.Network()
    _, words, index, mask = toxicity.block([(0, ["a", "bb", "ccc", "a"]), (1, ["dd", "e"])])
    y, weight = np.array([1, 0], np.float32), np.ones(2, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grads = net.gradients(words, index, mask, y, weight)

    def loss():
        v, _ = net.inputs(words)
        p = toxicity.sigmoid(net.forward(v.astype(np.float64), index, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = net.p[name][at], 1e-3
        net.p[name][at] = was + step
        up = loss()
        net.p[name][at] = was - step
        down = loss()
        net.p[name][at] = was
        assert abs(g[at] - (up - down) / (2 * step)) < 1e-4


def test_toxicity_windows(spark, docs):
    for n in (1, 47, 48, 49, 72, 73, 500):
        covered = {i for a in toxicity.windows_of(n) for i in range(a, min(a + toxicity.WINDOW, n))}
        assert covered == set(range(n))
    rng = random.Random(1)
    plain = [[rng.choice(["sun", "tree", "walk", "blue", "house", "river"]) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 120))] for _ in range(160)]
    y = np.array([k % 2 for k in range(160)], np.float32)
    for d, bad in zip(plain, y, strict=True):
        if bad:
            d[rng.randrange(len(d))] = rng.choice(["vile", "foulest", "vilest"])
    net = toxicity.fit(plain[:120], y[:120])
    assert ((net.probabilities(plain[120:]) >= 0.5) == y[120:]).mean() > 0.9
    odd = toxicity.score_toxicity(docs, net, keep=("runs",)).collect()
    assert len(odd) == len(ODD) and all(r.score == 0 for r in odd if r.doc_id in (2, 3))
    assert toxicity.score_toxicity(docs.limit(0), net).count() == 0
    empty = toxicity.fit([], np.zeros(0, np.float32))
    assert empty.probabilities([["a"], []]).max() < 0.5


def test_toxicity_held_out(spark):
    """Held-out labels of the largest small table: most toxic documents are found, hardly a clean one is lost."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in common.table(spark, folder, "labels").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    y, s = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert rank_sum(y, s) > 0.85 and ((s >= 0.5) & (y == 0)).sum() <= 0.02 * (y == 0).sum() and ((s >= 0.5) & (y == 1)).sum() >= 0.5 * y.sum()


def test_toxicity_steps():
    assert toxicity.split_words("No no NO yes\n no") == ["no\t3", "yes", "no"] and toxicity.split_words(None) == []
    one, many = toxicity.Network().inputs(["no"])[0], toxicity.Network().inputs(["no\t8"])[0]
    assert np.allclose(one[:, :-1], many[:, :-1]) and one[0, -1] == 0 and many[0, -1] == 3
