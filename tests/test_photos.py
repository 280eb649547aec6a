"""Photo metadata from built bytes, and groups of people against a plain version."""

import datetime
import random
import struct

from tessella.operators import runs
from tessella.sources import photos


def jpeg(order="<", make=b"Maker\0", orientation=6, taken=b"2023:05:06 07:08:09\0", focal=(50, 2), first=8, detail=None, size=(600, 800), before=b"", prefix=b"Exif\0\0"):
    """A JPEG's head; `detail` overrides where the second directory is said to be."""
    data = make.ljust(8, b"\0")
    at = 8 + 2 + 36 + 4
    second = at + len(data)
    ifd = struct.pack(f"{order}H", 3) + struct.pack(f"{order}HHII", 0x010F, 2, len(data), at) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, orientation, 0)
    ifd += struct.pack(f"{order}HHII", 0x8769, 4, 1, second if detail is None else detail) + struct.pack(f"{order}I", 0)
    after = second + 2 + 36 + 4
    exif = struct.pack(f"{order}H", 3) + struct.pack(f"{order}HHII", 0x9003, 2, 20, after) + struct.pack(f"{order}HHII", 0x920A, 5, 1, after + 20) + struct.pack(f"{order}HHI4s", 0xA434, 2, 3, b"L1\0\0") + struct.pack(f"{order}I", 0)
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, first) + ifd + data + exif + taken + struct.pack(f"{order}II", *focal)
    app = prefix + tiff
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, size[0], size[1], 1) + b"\1\x11\0"
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + frame + b"\xff\xda\0\2pixels"


def test_photo_metadata(spark):
    whole = {"width": 800, "height": 600, "orientation": 6, "make": "Maker", "lens": "L1", "focal_mm": 25.0, "taken": datetime.datetime(2023, 5, 6, 7, 8, 9)}
    size = {"width": 800, "height": 600}
    main = size | {"orientation": 6, "make": "Maker"}
    cases = [
        (jpeg(), whole), (jpeg(">"), whole), (jpeg(before=b"\xff\xfe\0\2" * 500), whole), (jpeg(before=b"\xff\xff\xff\xfe\0\2\xff\x01"), whole),
        (jpeg(first=1 << 30), size), (jpeg(first=2), size), (jpeg(prefix=b"Exif??"), size), (jpeg(detail=1 << 31), main), (jpeg(detail=8), main),  # a directory that names itself
        (jpeg(orientation=9), {k: v for k, v in whole.items() if k != "orientation"}), (jpeg(focal=(1, 0)), {k: v for k, v in whole.items() if k != "focal_mm"}),
        (jpeg(taken=b"0000:00:00 00:00:00\0"), {k: v for k, v in whole.items() if k != "taken"}), (jpeg()[:90], {}), (jpeg(before=b"\xff\xfe\0\1"), {}),
        (b"", {}), (None, {}), (b"\x89PNG", {}), (b"\xff\xd8\xff\xda" + jpeg()[2:], {}),
    ]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)], "id int, content binary")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r.id: r for r in photos.metadata(df, ["id"]).selectExpr("*", "cast(taken as timestamp_ntz) as at").collect()}
    for i, (_, expected) in enumerate(cases):
        found = {k: got[i]["at" if k == "taken" else k] for k in photos.FIELDS}
        assert found == {k: expected.get(k) for k in photos.FIELDS}, i


def test_people_are_grouped_across_sources(spark):
    rng = random.Random(5)
    components, silhouettes = [], []
    for i in range(120):
        x, y = rng.randrange(60), rng.randrange(40)
        components.append((i, rng.randrange(4), f"p{i % 4}", rng.random() < 0.3, rng.choice([0.2, 0.5]), rng.choice([0.1, 0.9]), rng.random()))
        silhouettes += [(i, y + k, x, x + rng.randint(0, 4)) for k in range(rng.randint(1, 5))]
    components.append((500, 1, "p1", False, 1.0, 1.0, 1.0))  # without runs
    source = {c[0]: c[1] for c in components}
    pixels = {i: {(y, x) for j, y, a, b in silhouettes if j == i for x in range(a, b + 1)} for i in range(120)}
    root = list(range(120))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(120):
        for b in range(a + 1, 120):
            shared, least = len(pixels[a] & pixels[b]), min(len(pixels[a]), len(pixels[b]))
            if source[a] != source[b] and shared >= min(least, 2) and shared * 10 >= least:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    groups, merged = runs.person_groups(
        spark.createDataFrame(components, "id int, source int, path string, truncated boolean, coverage double, confidence double, sharpness double"),
        spark.createDataFrame(silhouettes, "id int, y int, x0 int, x1 int"), 62, 41,
    )
    got = {r.group: r for r in groups.collect()}
    assert set(got) == {find(i) for i in range(120)} and len(got) < 110
    for g, r in got.items():
        own = [c for c in components if c[0] < 120 and find(c[0]) == g]
        rank = {}
        for _, s, path, cut, *more in own:
            rank[s] = max(rank.get(s, ()), (not cut, *more, path))
        assert r.sources == sorted(rank, key=rank.get, reverse=True) and r.preferred == r.sources[0] and r.members == len(own)
        every = set().union(*(pixels[c[0]] for c in own))
        ys, xs = [p[0] for p in every], [p[1] for p in every]
        assert (r.x0, r.y0, r.x1, r.y1) == (max(0, min(xs) - 3), max(0, min(ys) - 3), min(61, max(xs) + 3), min(40, max(ys) + 3))
    covered = {}
    for r in merged.collect():
        own = covered.setdefault(r.group, set())
        new = {(r.y, x) for x in range(r.x0, r.x1 + 1)}
        assert not own & new
        own |= new
    assert covered == {g: set().union(*(pixels[i] for i in range(120) if find(i) == g)) for g in got}
