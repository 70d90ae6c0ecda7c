"""Hard negatives, archives and prefix tries against brute force, and on odd rows."""

import gzip
import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavra.llm import hardneg, trie, vptree, warc

# --- hard negatives


def brute(rows, anchors, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by all pairs."""
    out = set()
    for i, label, v in rows:
        if i not in anchors:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in rows if j != i)
        for p, j, _ in [x for x in near if x[2] == label][:positives]:
            fits = [(s, k) for s, k, other in near if other != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out |= {(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits, 1)}
    return out


def spread_out(n=700, labels=6, seed=1):
    """Vectors around a centre a label, a large group of copies over two labels, and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, 8)) * 20
    rows = [(i, i % labels, np.floor(centres[i % labels] + rng.normal(size=8) * 30).astype(int).tolist()) for i in range(n)]
    for i in range(100, 330):
        rows[i] = (i, i % 2, rows[100][2])
    rows[5] = (5, 5, [0] * 8)
    return rows


def mined(spark, rows, every=20, parts=3):
    df = spark.createDataFrame(rows, "id long, label long, v array<long>").repartition(parts)
    return {tuple(r) for r in hardneg.mine(df, F.col("id") % every == 0).collect()}


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    rows = spread_out()
    want = brute(rows, {i for i, *_ in rows if i % 20 == 0})
    assert mined(spark, rows) == want and len(want) > 500
    # Small trees and blocks in many lanes, over several rounds; wide integers.
    for name, value in (("SHARD", 32), ("BLOCK", 8), ("LEAF", 8), ("FIRST", 2), ("LANE", 1)):
        monkeypatch.setattr(hardneg, name, value)
    assert mined(spark, rows, parts=5) == want
    wide = [(i, label, [x * 350_000 for x in v]) for i, label, v in rows]
    assert {x[:4] for x in mined(spark, [w for w in wide if w[0] < 200])} == {x[:4] for x in brute([r for r in rows if r[0] < 200], set(range(0, 200, 20)))}
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(i, label, [x << 40 for x in v]) for i, label, v in rows[:9]])


def test_hard_negatives_prune_groups():
    rows = spread_out(600)
    points = lambda some: (np.array([r[0] for r in some]), np.array([r[1] for r in some]), np.array([r[2] for r in some], np.int64))
    tree = hardneg.build(*points(rows), leaf=16)
    anchors = hardneg.build(*points([r for r in rows if r[0] % 10 == 0]), leaf=8)
    n = len(anchors.ids)
    job = hardneg.Search(anchors, np.full((n, 1), hardneg.NONE + 1), np.full((n, 1), -hardneg.NONE), True, 5)
    job.over(tree)
    assert job.pruned > 0 and job.scored < n * len(rows) / 3
    exact = {(i, j) for i, label, v in rows if i % 10 == 0 for _, j in sorted((-int(np.dot(v, w)), j) for j, other, w in rows if j != i and other == label)[:5]}
    anchor, _, other, _ = job.found()
    assert set(zip(anchor.tolist(), other.tolist())) == exact


def test_hard_negatives_on_odd_rows(spark):
    rows = [(i, 1.0 * x, [x, -x, 0.5]) for i, x in enumerate(np.random.default_rng(2).normal(size=60).tolist())]
    form = "vec_id long, label double, embedding array<double>, anchor string, score string, rank string, slot string"
    odd = [(200, 1.0, None), (201, None, [1.0, 1.0, 1.0]), (202, 1.0, [float("nan"), 1.0, 1.0]), (203, 1.0, [None, 1.0, 1.0]), (None, 1.0, [1.0, 1.0, 1.0]), (204, 1.0, [1.0]), (205, 1.0, []), (0, 3.0, [9.0, 9.0, 9.0])]
    rows = [(i, float(i % 3), v) for i, _, v in rows]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows + odd + rows[:9]], form)
    ints = [(i, int(label), [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    got = {tuple(r) for r in hardneg.mine(hardneg.integral(df), F.col("id") % 10 == 0).collect()}
    assert got == brute(ints, set(range(0, 60, 10)))
    assert hardneg.mine(hardneg.integral(df.limit(0)), F.col("id") % 10 == 0).count() == 0
    assert hardneg.mine(hardneg.integral(df), F.lit(False)).count() == 0


def test_vptree_repeated_ids_in_one_tree(spark):
    """One partition, one tree: an id with five vectors stands once, with its best score."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(1, (rng.normal(size=4) * 3).tolist()) for _ in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = vptree.nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    assert (got.groupby("query_id").size() == 20).all()
    for q, own in got.groupby("query_id"):
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(v, rows[q][1])))
        assert own.sort_values("rank")["vec_id"].tolist() == sorted(best, key=lambda i: (-round(best[i], 9), i))[:20]


# --- archives

PAGES = "page_id long, url string, html string, shard string, key string, payload string, bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


def site(n=300, seed=3):
    """Pages of many sizes, of which some repeat; nulls, empty and very long ones; ids with gaps, and none."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdefgh é\n\r", k=k))
    same, short = text(400), text(20)
    rows = [(i * 7 if i < 250 else i + (1 << 40), f"https://x.org/{i}\r\nX: 1", text(rng.randint(0, 3000))) for i in range(n)]
    for i in range(20, 140, 2):
        rows[i] = (rows[i][0], rows[i][1], same)
    for i in range(21, 60, 2):
        rows[i] = (rows[i][0], rows[i][1], short)
    rows[1], rows[3], rows[4] = (7, None, None), (21, "u", ""), (28, "u", text(300_000))
    return rows + [rows[20], rows[22], (None, "n", same), (None, "n", text(500)), (-5, "neg", text(500))]


def expected(rows, least=100):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and (html or "") in first and i != first[html or ""]
        out.append((i, url, "revisit" if again else "response", first[html or ""] if again else None, hashlib.sha256(data).hexdigest(), len(data), None if again else data))
    return sorted(out, key=repr)


def test_archives_keep_every_record(spark, tmp_path):
    rows = site()
    path = f"file://{tmp_path}/a"
    got = warc.archived(pages(spark, rows), path)
    assert sorted((tuple(r)[:6] + (None if r["payload"] is None else bytes(r["payload"]),) for r in got.collect()), key=repr) == expected(rows)
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    # Headers as they stand in the files.
    found = [x for f in warc.manifest(path) for x in warc.records(iter([Path(tmp_path, "a", f["file"]).read_bytes()]))]
    assert sum(h["WARC-Type"] == "warcinfo" for h, _ in found) == len(warc.manifest(path))
    names = {h["WARC-Record-ID"] for h, _ in found if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in names for h, _ in found if h["WARC-Type"] == "revisit")
    empty = warc.archived(pages(spark, rows).limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0 and warc.manifest(f"file://{tmp_path}/none") == []


def test_archives_are_the_same_by_any_dealing(spark, tmp_path):
    """Files, their names and bytes hang on the rows alone; they are rolled by size, in order, and no file is left behind."""
    rows, seen = site(), []
    for k, parts in enumerate((1, 7)):
        path = f"file://{tmp_path}/{k}"
        made, weights = warc.described(pages(spark, random.Random(k).sample(rows, len(rows))).repartition(parts))
        warc.write(made, weights, path, size=60_000, file_bytes=9_000)
        seen.append({f["file"]: Path(tmp_path, str(k), f["file"]).read_bytes() for f in warc.manifest(path)})
        assert {f["file"]: f["sha256"] for f in warc.manifest(path)} == {n: hashlib.sha256(b).hexdigest() for n, b in seen[-1].items()}
        assert {p.name for p in Path(tmp_path, str(k)).iterdir() if p.is_file() and p.name[0] not in "._"} == {*seen[-1], "manifest.json"}
    assert seen[0] == seen[1] and len({n.split("-")[1] for n in seen[0]}) > 5
    ids = []
    for name in sorted(seen[0]):
        own = [h for h, _ in warc.records(iter([seen[0][name]]))][1:]
        assert len(seen[0][name]) <= 9_000 + 300 or len(own) == 1
        ids += [int(h["X-Page-Id"]) if "X-Page-Id" in h else None for h in own]
    held = [i for i in ids if i is not None]
    assert held == sorted(held) and None not in ids[: len(held)]
    assert gzip.decompress(next(iter(seen[0].values()))).startswith(b"WARC/1.1\r\n")


def test_shards_hold_what_they_may(spark):
    """Prefixes cover all keys once; a prefix beyond the size is split, down to a single key."""
    rng = random.Random(4)
    keys = [f"{rng.choice([5, 5, 5, rng.getrandbits(60)]):016x}{rng.getrandbits(64):016x}" for _ in range(400)] + ["0" * 31 + "5"] * 50
    weights = spark.createDataFrame([(k, 10) for k in keys], "key string, bytes long")
    found = warc.bounds(weights, 200)
    assert all(sum(k.startswith(p) for p, _ in found) == 1 for k in keys)
    held = {}
    for k in keys:
        shard = next(s for p, s in found if k.startswith(p))
        held.setdefault(shard, []).append(k)
    assert all(len(v) <= 20 or len(set(v)) == 1 for v in held.values())
    order = [k for s in sorted(held) for k in sorted(held[s])]
    assert order == sorted(keys)
    assert warc.bounds(weights.limit(0), 10) == []


def test_lost_writers_leave_nothing(spark, tmp_path):
    """Without a manifest there is no archive; what an attempt wrote before it was lost isn't read and goes."""
    path = f"file://{tmp_path}/a"
    made, weights = warc.described(pages(spark, site(200)))
    broken = made.withColumn("payload_digest", F.when(F.col("page_id") == 140, F.raise_error(F.lit("lost"))).otherwise(F.col("payload_digest")))
    with pytest.raises(Exception, match="lost"):
        warc.write(broken, weights, path, size=60_000)
    assert not Path(tmp_path, "a", "manifest.json").exists() and not list(Path(tmp_path, "a").glob("*.gz"))
    writer = warc.WarcWriter({"path": path, "file_bytes": 1 << 20, "run": "x"})
    import pyarrow as pa

    row = {"shard": 0, "page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "refers_to_url": None, "payload_digest": hashlib.sha256(b"abc").hexdigest(), "payload": b"abc"}
    batch = pa.RecordBatch.from_pylist([row])
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.files[0][1] == done.files[0][1]
    writer.commit([done, None])
    assert [f["records"] for f in warc.manifest(path)] == [1] and not Path(tmp_path, "a", "_temporary", "x").exists()
    assert warc.read(spark, path).count() == 1
    name = Path(tmp_path, "a", warc.manifest(path)[0]["file"])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([name.read_bytes()[:-9]])))
    with pytest.raises((ValueError, zlib.error)):
        [warc.unpack(h, b[:-1] + b"!", "f") for h, b in warc.records(iter([name.read_bytes()])) if h["WARC-Type"] == "response"]
    assert json.loads(Path(tmp_path, "a", "manifest.json").read_text())["files"]


# --- prefix tries


def nodes_of(talks):
    """{(smallest member, depth): the other columns} of {conv_id: [(role, text)]} by plain prefixes."""
    members = {}
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members.setdefault(tuple(talks[c][:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}

    def total(p):
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += q not in kids
            saved += (len(members[q]) - 1) * len(q[-1][1]) if q else 0
            todo += kids.get(q, [])
        return leaves, saved

    for p, own in members.items():
        ends = ",".join(str(c) for c in own if len(talks[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out[own[0], len(p)] = (parent, len(own), len(kids.get(p, [])), *total(p), hashlib.sha256(ends.encode()).hexdigest())
    return out


def talks(seed=6, n=90, deepest=12):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "bot", ""]), rng.choice(["hi", "ho é😀", "", "x" * 50]))
    out, paths = {}, []
    for c in range(n):
        base = list(rng.choice(paths)[: rng.randint(0, deepest)]) if paths and rng.random() < 0.8 else []
        out[c * 37 - 200] = path = base + [turn() for _ in range(rng.randint(0, 3))]
        paths.append(path)
    long = [turn() for _ in range(150)]
    return out | {9001: long, 9002: long, 9003: long[:97], 9004: long[:32], 9005: long[:33] + [turn()], 9006: []}


def rolled(spark, own):
    rows = [(c, i, r or None, t or None) for c, path in own.items() for i, (r, t) in enumerate(path)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = trie.placed(df).cache()
    ids = spark.createDataFrame([(c,) for c in own], "conv_id long")
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in trie.trie(placed, ids).collect()}


def test_trie_against_plain_prefixes(spark, monkeypatch):
    own = talks()
    want = nodes_of(own)
    assert rolled(spark, own) == want
    monkeypatch.setattr(trie, "BLOCK", 3)  # digests over several levels of blocks
    small = {c: p[:40] for c, p in own.items()}
    assert rolled(spark, small) == nodes_of(small)


def test_shared_starts_and_odd_turns(spark):
    """Rebuilt as stated, row by row; null, repeated and gapped turns, null ids, and an empty table."""
    rng = random.Random(7)
    rows = [(c, rng.choice([None, 1, 2, 2, 5, 9]), rng.choice(["a", None]), rng.choice(["t", "é" * 70 + str(k), None])) for c in [*range(0, 230, 3), *range(350, 390, 7)] for k in range(rng.randint(1, 9))]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows + [(None, 1, "a", "b")]], "conv_id long, turn long, role string, text string, pos string, node string")
    held = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        held.setdefault(c, []).append((r or "", x or ""))
    rebuilt = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = held.get(c - c % 100, [])[:h] + own[h:]
    placed = trie.placed(df).cache()
    got = trie.trie(trie.shared_starts(placed).cache(), placed.where("pos = 1").select("conv_id"))
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got.collect()} == nodes_of(rebuilt)
    none = trie.placed(df.limit(0))
    assert trie.trie(trie.shared_starts(none), none.select("conv_id")).count() == 0


def test_jumps_are_logarithmic(spark, monkeypatch):
    """A path of 100 turns takes a round a doubling."""
    written = []
    real = trie.materialise
    monkeypatch.setattr(trie, "materialise", lambda df, name: written.append(name) or real(df, name))
    rolled(spark, {1: [("u", str(i)) for i in range(100)]})
    assert written.count("trie-round") == 6
