"""Generated plans, run-length regions, faces, and binary scans."""

import struct
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tesselwork.operators import graph
from tesselwork.plans import more
from tesselwork.plans.catalog import touching
from tesselwork.sources import files, plans

FOLDER = "/root/testdata/sf0.001"


def test_rooms_tile_their_plan():
    for seed in range(30):
        r = plans.rooms(seed, 120, 80, 12)
        assert sum(w * h for _, _, w, h in r) == 120 * 80 and len(r) > 1 and all(min(w, h) >= 12 for _, _, w, h in r)


def test_generated_rooms_are_whole(spark):
    got = more.generated_rooms(spark, FOLDER).collect()
    want = {(s, k): w * h for s in range(12) for k, (_, _, w, h) in enumerate(plans.rooms(s, 120, 80, 12), 1)}
    assert {(r.plan, r.label): r.cells for r in got} == want and all(r.components == 1 for r in got)


def test_generated_adjacency(spark):
    got = {(r.plan, r.a, r.b): r.length for r in more.generated_adjacency(spark, FOLDER).collect()}
    want = {}
    for s in range(12):
        rooms = plans.rooms(s, 120, 80, 12)
        for i, (x, y, w, h) in enumerate(rooms, 1):
            for j, (p, q, u, v) in enumerate(rooms, 1):
                if i < j:
                    side = min(y + h, q + v) - max(y, q) if x + w == p or p + u == x else 0
                    flat = min(x + w, p + u) - max(x, p) if y + h == q or q + v == y else 0
                    if max(side, flat) > 0:
                        want[s, i, j] = max(side, flat)
    assert got == want


def test_faces_of_a_grid(spark):
    edges = [(x, y, x + 1, y) for x in range(4) for y in range(4)] + [(x, y, x, y + 1) for x in range(5) for y in range(3)]
    frame = spark.createDataFrame(edges + [(1, 1, 2, 1), (9, 9, 10, 9)], "ax long, ay long, bx long, by long")
    areas = Counter(r.area for r in graph.planar_faces(frame).collect())
    assert areas == Counter({1.0: 12, -12.0: 1, 0.0: 1})


def test_face_query(spark):
    rows = more.planar_faces(spark, FOLDER).collect()
    assert rows and abs(sum(r.area for r in rows)) < 1e-9


def test_pruning(spark):
    edges = [(r.left_id, r.right_id) for r in touching(spark, FOLDER).collect()] + [(10**6, 10**6 + 1), (10**6 + 1, 10**6 + 2), (10**6 + 2, 10**6), (10**6 + 2, 10**6 + 3)]
    live = set(edges)
    while True:
        n = Counter(v for e in live for v in e)
        drop = {e for e in live if n[e[0]] == 1 or n[e[1]] == 1}
        if not drop:
            break
        live -= drop
    got = graph.prune_ends(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == live


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_images(spark, tmp_path):
    for name, data in {"a.png": png(640, 480), "b.png": png(50, 480), "c.gif": b"GIF89a" + struct.pack("<HH", 300, 200), "d.bin": b"what"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.width, r.height, r.error) for r in files.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 640, 480, None), "b.png": ("png", 50, 480, "too_small"), "c.gif": ("gif", 300, 200, None), "d.bin": (None, None, None, "unknown")}


def test_pdf_pages(spark):
    page = b"1 0 obj <</Type /Page /MediaBox [0 0 595 842] /Rotate 90>> endobj 2 0 obj <</Type/Page/MediaBox[0 0 842 1191]>> endobj 3 0 obj <</Type /Pages>> endobj"
    rows = [("ok", b"%PDF-1.4 " + page), ("locked", b"%PDF-1.4 /Encrypt"), ("none", b"%PDF-1.4"), ("other", b"GIF"), ("null", None)]
    got = files.pdf_pages(spark.createDataFrame(rows, "path string, content binary"))
    sheet = files.sheet_name(F.col("width_pt") / 72 * 25.4, F.col("height_pt") / 72 * 25.4)
    out = {(r.path, r.page): (r.rotation, r.error, r.sheet) for r in got.withColumn("sheet", sheet).collect()}
    assert out[("ok", 1)] == (90, None, "A4") and out[("ok", 2)] == (0, None, "A3")
    assert [out[(p, None)][1] for p in ("locked", "none", "other", "null")] == ["encrypted", "no_pages", "not_pdf", "not_pdf"]
