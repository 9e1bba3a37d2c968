"""Byte ranges, media headers, patches, item histories, user aggregates, embedding steps and templates on odd inputs."""

import difflib
import hashlib
import io
import random
import statistics
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import aggregates as A
from lakeloom.operators import embedding as E
from lakeloom.operators import patches as H
from lakeloom.operators import templates as T
from lakeloom.sources import ranges
from lakeloom.streaming import history


def test_a_large_file_is_the_work_of_many_tasks(spark, tmp_path):
    ranges.register(spark)
    piece = bytes(range(256)) * 4096
    with open(tmp_path / "large.bin", "wb") as f:
        for _ in range(200):
            f.write(piece)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    df = spark.read.format("lakeloom_ranges").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() >= 25
    got = df.select("offset", F.octet_length("content").alias("n"), F.md5("content").alias("h"), F.regexp_extract("path", "[^/]+$", 0).alias("name")).collect()
    large = sorted((r.offset, r.n) for r in got if r.name == "large.bin")
    assert sum(n for _, n in large) == 200 << 20 and all(a + n == b for (a, n), (b, _) in zip(large, large[1:]))
    assert [(r.offset, r.n) for r in got if r.name == "empty.bin"] == [(0, 0)] and len(got) == len(large) + 1
    assert {r.h for r in got if r.name == "large.bin"} == {hashlib.md5(piece * 8).hexdigest()}
    with pytest.raises(Exception, match="nothing_here"):
        spark.read.format("lakeloom_ranges").option("path", str(tmp_path / "nothing_here")).load().count()


def box(name, content, wide=False):
    return (struct.pack(">I4sQ", 1, name, len(content) + 16) if wide else struct.pack(">I4s", len(content) + 8, name)) + content


def test_headers_of_real_and_broken_files(spark, tmp_path):
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 4 * 12000)
    movie = box(b"moov", box(b"mvhd", b"\1" + b"\0" * 19 + struct.pack(">IQ", 600, 1500)) + box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8 + b"soun" + b"\0" * 12))))
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 60002) + b"\xff\xc0" * 30000 + b"\xff\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, 480, 640, 3)
    files = {
        "a.wav": sound.getvalue(), "b.mp4": box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 99, wide=True) + movie, "c.jpg": jpeg, "d.gif": b"GIF89a" + struct.pack("<HH", 3, 4),
        "e.png": b"\x89PNG\r\n\x1a\n\0\0", "f.wav": b"RIFF\0\0\0\0WAVEdata\0\0\0\0", "g.mp4": box(b"ftyp", b"isom") + struct.pack(">I4s", 4, b"moov"), "h.txt": "grün\n".encode() * 400, "i.bin": b"\0\1\2", "j.pdf": b"%PDF-1.7", "k.html": b" <!DOCTYPE html><p>", "l": b"",
    }
    ranges.register(spark)
    rows = spark.createDataFrame([(f"x/{k}", v) for k, v in files.items()], "path string, content binary")
    for _ in range(2):  # files that exist are replaced
        rows.write.format("lakeloom_files").mode("append").option("path", str(tmp_path)).save()
    found = spark.read.format("lakeloom_media").option("path", str(tmp_path)).load().collect()
    got = {r.path.rsplit("/", 1)[1]: r for r in found}
    assert got.keys() == files.keys() and all(got[k].size == len(v) for k, v in files.items())
    assert (got["a.wav"].kind, got["a.wav"].seconds, got["a.wav"].rate, got["a.wav"].channels) == ("audio", 1.5, 8000, 2)
    assert (got["b.mp4"].kind, got["b.mp4"].seconds) == ("audio", 2.5)
    assert (got["c.jpg"].width, got["c.jpg"].height) == (640, 480) and (got["d.gif"].width, got["d.gif"].height) == (3, 4)
    assert all(got[k].kind == "unknown" and got[k].error for k in ("e.png", "f.wav", "g.mp4")) and got["i.bin"].kind == "unknown"
    assert (got["h.txt"].mime, got["j.pdf"].kind, got["k.html"].mime, got["l"].kind) == ("text/plain", "pdf", "text/html", "text")
    with pytest.raises(Exception, match="not a path below"):
        spark.createDataFrame([("../y", b"")], "path string, content binary").write.format("lakeloom_files").mode("append").option("path", str(tmp_path)).save()


def test_patches_of_random_edits(spark):
    rng = random.Random(4)
    files, diffs, want = [], [], {}
    for k in range(150):
        old = [rng.choice(["a", "b", "", " x", "-y", "+z", "@@ q"]) for _ in range(rng.randrange(30))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), f"new {rng.randrange(9)}")
        old, new = [*old, "z"] if old else old, [*new, rng.choice(["z", "w"])]
        end = "\n" if k % 2 and old else ""
        files.append((str(k), "\n".join(old) + end))
        diffs.append((str(k), "\n".join(difflib.unified_diff("\n".join(old).split("\n") if old else [], "\n".join(new).split("\n"), "l", "r", n=k % 4, lineterm=""))))
        want[str(k)] = "\n".join(new) + end
    files += [("twice", "a"), ("twice", "b"), ("same", "kept\n"), (None, None), ("two", "a")]
    diffs += [("made", "@@ -0,0 +1,2 @@\n+x\n+y\n\\ No newline at end of file"), ("twice", "@@ -1 +1 @@\n-a\n+b"), ("two", "@@ -1 +1 @@\n-a\n+b"), ("two", ""), ("two", None), ("other", "@@ -1 +1 @@\n-a"), ("head", "@@ what\n+a")]
    out = H.apply_patches(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(diffs, "path string, diff string")).collect()
    got = {r.path: r for r in out}
    assert {k: got[k].text for k in want} == want and all(got[k].error is None for k in want)
    assert got["made"].text == "x\ny" and got["same"].text == "kept\n" and not got["same"].applied and got[None].text == ""
    assert [got[k].error for k in ("twice", "two", "other", "head")] == ["several files", "several diffs", "hunk 1: the file ends before line 1", "hunk 1: bad header"]
    assert all(got[k].text is None and not got[k].applied for k in ("twice", "two", "other", "head"))


def test_history_forgets_by_age_and_takes_odd_rows(spark, tmp_path):
    rows = [(1, t, t, "k") for t in (5, 3, 9, 3)] + [(2, None, 1, "k"), (None, 1, 1, "k"), (3, 1, 1, None)]
    df = spark.createDataFrame(rows, "u long, at long, item long, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", history.ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    try:
        for n, keep in enumerate((None, 3_600_000)):
            found = history.latest_items(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "u", "at", "item", "kind", 2, keep)
            write = lambda part, _, n=n: part.write.mode("append").parquet(str(tmp_path / f"out{n}"))
            found.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"c{n}")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
            got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"out{n}")).select("u", "place", "item", "kinds").collect())
            assert got == [(1, 1, 9, 1), (1, 2, 5, 1), (3, 1, 1, 0)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_aggregates_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    values = [float(v) for v in rng.normal(1e6, 3, 20_000)]
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 7}", v if i % 11 else None, i % 9000) for i, v in enumerate(values)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "key string, v double, n long")
    want = {}
    for k, v, _ in rows:
        want.setdefault(k, []).extend([v] if v is not None else [])
    for parts in (1, 13):
        some = df.repartition(parts)
        mean, var = ({r.key: r.value for r in A.aggregate(some, ["key"], "v", n).collect()} for n in ("mean", "variance"))
        assert mean.keys() == want.keys() and mean["none"] is None and var["none"] is None
        for k, v in want.items():
            if v:
                assert mean[k] == pytest.approx(statistics.fmean(v), rel=1e-12) and var[k] == pytest.approx(statistics.variance(v), rel=1e-7)
        (one,) = A.aggregate(some, [], "n", "distinct").collect()
        assert abs(one.value - 9000) < 4 * 9000 / 4094**0.5
        assert parts == 1 or one.value == first
        first = one.value
    assert A.aggregate(df.where("false"), ["key"], "v", "mean").count() == 0
    with pytest.raises(ValueError, match="already"):
        A.register("mean", A.VARIANCE)


def test_embedding_retries_checks_and_remembers(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")

    def function(texts):
        with open(log, "a") as f:
            f.writelines(f"{hashlib.md5(t.encode()).hexdigest()}\n" for t in texts)
        if any(t == "bad" for t in texts):
            raise RuntimeError("no")
        return [[0.0, 0.0] if not t else [3.0, 4.0, 5.0] if t == "long" else [float("nan"), 1] if t == "nan" else [float(len(t)), 1.0] for t in texts]

    rows = [(1, "aa"), (2, "aa"), (3, None), (4, ""), (5, "bad"), (6, "long"), (7, "nan"), (8, "x" * 300), (None, "aa")] + [(k, "hot") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = E.embed(df, function, store, "m", 2, batch_bytes=100, retries=1).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[1].embedding == by[2].embedding == by[None].embedding == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and by[3].embedding == by[4].embedding == [0.0, 0.0]
    assert (by[5].error, by[6].error, by[7].error) == ("RuntimeError: no", "3 dimensions, not 2", "not finite") and by[8].error is None
    asked = open(log).read().split()
    good = [t for _, t in rows if t not in ("bad", None)]
    assert set(asked) == {hashlib.md5((t or "").encode()).hexdigest() for t in [*good, "bad", ""]}
    again = E.embed(df.where("id not in (5, 6, 7)"), function, store, "m", 2).collect()
    assert open(log).read().split() == asked and {r.id: r.embedding for r in again} == {r.id: r.embedding for r in got if r.id not in (None, 5, 6, 7)}
    assert [r.texts for r in E.runs(spark, store).orderBy("place").collect()] == [7]
    assert E.embed(df.where("false"), function, store, "m", 2).count() == 0
    assert E.embed(df.where("id = 1"), function, store, "another", 2).count() == 1 and len(open(log).read().split()) == len(asked) + 1


def test_templates_and_messages_on_odd_rows(spark):
    templates = spark.createDataFrame([(1, "{a}{a} {b_1} {1x} { {a"), (2, None), (3, "plain {}"), (4, "{a}")], "template_id int, template string")
    requests = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 9), (6, None), (7, 1)], "id long, template_id int")
    values = spark.createDataFrame([(1, "a", "{b_1}"), (1, "b_1", ""), (3, "z", "1"), (3, "a", None), (4, "a", None), (7, "q", "1")], "id long, name string, value string")
    got = {r.id: (r.text, r.error) for r in T.fill_templates(templates, requests, values).collect()}
    assert got == {1: ("{b_1}{b_1}  {1x} { {a", None), 2: ("", None), 3: ("plain {}\n\na: \nz: 1", None), 4: (None, "missing: a"), 5: (None, "no such template"), 6: (None, "no such template"), 7: (None, "missing: a, b_1")}
    messages = spark.createDataFrame([(1, 3, None, " x "), (1, 1, "tool ", "y"), (2, 1, "user", " "), (3, 1, "user", None)], "id long, place long, role string, content string")
    systems = spark.createDataFrame([(1, " s "), (2, "t"), (9, "u")], "id long, text string")
    found = sorted(map(tuple, T.message_lists(messages, systems).collect()), key=str)
    assert found == [(1, 0, "system", "s"), (1, 1, "tool", "y"), (1, 2, "user", "x"), (2, -1, None, None), (3, -1, None, None)]
