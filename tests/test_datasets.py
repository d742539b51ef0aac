"""Dataset formats: reading, ranges of files, filters that reach the reader, images."""

import io
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from docquarry.sources import datasets


@pytest.fixture(scope="module")
def session(spark):
    datasets.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def ranking(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(f"{q} Q0 {d} {r} {s} run\n" for q, d, r, s in rows))


def test_rankings(session, tmp_path):
    rows = {b: [(f"q{i % 50}", f"d{b}{i}", i // 50 + 1, 1 - i / 2000) for i in range(1500)] for b in "ab"}
    for b, held in rows.items():
        ranking(tmp_path / f"bench={b}", "x.trec", held)
    (tmp_path / "_SUCCESS").write_text("")
    df = session.read.format("trec_run").option("split_mb", 0.01).load(str(tmp_path))
    assert df.columns == ["query", "doc", "rank", "score", "tag", "bench"] and df.rdd.getNumPartitions() > 4
    want = {(q, d, r, s, "run", b) for b, held in rows.items() for q, d, r, s in held}
    assert {tuple(r) for r in df.collect()} == want and df.count() == 3000
    # the folder's filter leaves out files, the query's leaves out lines
    some = df.where("bench = 'a' and query in ('q3', 'q4') and rank <= 2")
    assert {tuple(r) for r in some.collect()} == {x for x in want if x[5] == "a" and x[0] in ("q3", "q4") and x[2] <= 2}
    assert 0 < some.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "Scan" not in line]
    assert filters and all("query" not in f.split("PushedFilters")[0] for f in filters if "rank" in f)
    assert df.where("bench = 'z'").count() == 0 and df.where("bench = 'a' and bench = 'b'").count() == 0


def test_broken_ranking_tells_its_file(session, tmp_path):
    ranking(tmp_path, "y.trec", [])
    (tmp_path / "y.trec").write_text("q1 Q0 d1 1\n")
    with pytest.raises(Exception, match="not a line of a ranking"):
        session.read.format("trec_run").load(str(tmp_path)).collect()


@pytest.mark.parametrize("size", [1, 3, 50, 1 << 20])
def test_array_items(size):
    rng = random.Random(size)
    for items in ([], [1], [12345, -1.5e3, "a]b,[", {"x": [1, {"y": None}]}, [], "é\\u00e9\"", True], [{"k": "v" * rng.randrange(300)} for _ in range(20)]):
        for text in (json.dumps(items), json.dumps(items, indent=2), f" \n{json.dumps(items)}\n "):
            assert list(datasets.array_items(io.StringIO(text).read, size)) == items
    for broken in ("", "{}", "[1", "[1 2]", '["a'):
        with pytest.raises(ValueError):
            list(datasets.array_items(io.StringIO(broken).read, size))


def test_arrays(session, tmp_path):
    samples = [{"id": i, "question": f"q é {i}", "pages": [i, i + 1]} for i in range(30)]
    for split in ("train", "test"):
        (tmp_path / f"split={split}").mkdir()
        (tmp_path / f"split={split}" / "samples.json").write_text(json.dumps(samples, ensure_ascii=False))
    df = session.read.format("json_array").load(str(tmp_path)).where("split = 'test'")
    got = df.select("ordinal", F.from_json("item", "id int, question string, pages array<int>").alias("s")).select("ordinal", "s.*").orderBy("ordinal").collect()
    assert [(r.ordinal, r.id, r.question, r.pages) for r in got] == [(i, i, f"q é {i}", [i, i + 1]) for i in range(30)] and df.rdd.getNumPartitions() == 1


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def test_images(session, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 480, 640) + b"\0" * 10
    files = {"a.png": png(30, 20), "sub/b.jpg": jpeg, "c.gif": b"GIF89a" + struct.pack("<HH", 7, 9), "d.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6), "e.txt": b"text", "f.png": b""}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.format, r.width, r.height) for r in datasets.images(session, str(tmp_path)).collect()}
    assert got == {"a.png": (len(files["a.png"]), "png", 30, 20), "b.jpg": (len(jpeg), "jpeg", 640, 480), "c.gif": (10, "gif", 7, 9), "d.bmp": (26, "bmp", 5, 6), "e.txt": (4, None, None, None)}
    assert datasets.images(session, str(tmp_path), "*.gif").count() == 1
