"""The training-data operators against brute force, round trips, edge cases and held-out accuracy."""

import base64
import gzip
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lavra.llm import attribution, bpe, gif, langid, mixing, quality, secrets, simhash, toxicity, vptree

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, "a" * 70000, "en", "s", 70000), (5, "word " * 20000, "fr", "s", 1), (6, "the same text here", "en", "t", 1), (6, "the same text here", "en", "t", 1), (7, "the same text here", None, "t", 1), (None, "no id at all", "en", "u", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Odd rows, and further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, DOCS).withColumns({c: F.lit("x") for c in ("fp", "label", "held_out", "score", "cell", "media", "toxic")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, docs, edge, none):
    held = docs.limit(300).collect()
    for r in held[:60]:
        assert simhash.fingerprint(r["text"].encode()) & (1 << 64) - 1 == brute_fingerprint(r["text"])
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (1, 2, 3, 4, 4, 5)} | set(base)
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    found = {(r[0], r[1]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 4}
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (None, None)} <= got
    assert simhash.near_duplicates(none).count() == 0


def test_tables_that_grow_are_not_broadcast(spark):
    """An exploded table looks as small as what it was exploded from: at 0.5 GB of texts 537 MB went through the driver."""
    from lavra.operators.graph import _round

    few = spark.range(50).select(F.col("id").alias("fp"))  # of known size
    found = simhash.links(few)
    for each in (found, _round(found, True)):
        plan = each._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_prefixes_are_shuffled_by_slices(spark, docs, monkeypatch):
    """The entries of all shingles together took most of the disk: slices of them have no shingle in common, and give the same components."""
    some = docs.where("doc_id % 2 = 0")
    whole = {tuple(r) for r in simhash.similar(some).collect()}
    seen, write = [], simhash.materialise

    def recorded(df, name):
        out = write(df, name)
        if name == "shared" and "token" in df.columns and "f" not in df.columns and "family" not in df.columns:
            seen.append({r["token"] for r in out.select("token").collect()})
        return out

    monkeypatch.setattr(simhash, "SLICE", 2000)
    monkeypatch.setattr(simhash, "materialise", recorded)
    assert {tuple(r) for r in simhash.similar(some).collect()} == whole
    assert len(seen) == simhash.SLICES and sum(map(len, seen)) == len(set.union(*seen)) > 0


def components_of(items, links):
    """Smallest item reachable, by plain search."""
    near, out = {i: set() for i in items}, {}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for i in sorted(items):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += near[x]
    return out


def test_op1_against_brute_force(spark):
    """Fingerprints and components of all documents by comparing all pairs."""
    from lavra.llm.queries import op1_simhash

    tiny = SF.replace("sf0.01", "sf0.001")
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    want = components_of(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash(spark, tiny).collect()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def brute_set(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_similar_texts_against_brute_force(spark, docs, edge, none):
    """Components at 0.8 of the five-word shingles, against all pairs of the documents and of planted variants."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    planted = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        for change in (0, 1, 2, 3, 5, 8, 40):
            own = list(base)
            for at in rng.sample(range(len(own)), min(change, len(own))):
                own[at] = rng.choice(vocabulary)
            planted.append(" ".join(own))
    text = {r["doc_id"]: r["text"] for r in docs.collect()} | {10_000 + i: t for i, t in enumerate(planted)}
    table = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    sets = {i: brute_set(t) for i, t in text.items()}
    at = {}
    for i, s in sets.items():
        for x in s or {b""}:
            at.setdefault(x, []).append(i)
    links = set()
    for i, s in sets.items():
        for j in {j for x in s or {b""} for j in at[x] if j > i}:
            if not s or len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                links.add((i, j))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(table).collect()}
    caught = sum(got[a] == got[b] for a, b in links)
    assert len(got) == len(text) and len(links) > 200 and caught >= 0.98 * len(links)
    want = components_of(text, links)
    assert all(want[i] == want[c] for i, c in got.items())  # no link that isn't one
    odd = {(r["doc_id"], r["component_id"]) for r in simhash.similar(edge).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (None, None)} <= odd and simhash.similar(none).count() == 0


def test_gif(edge, none):
    rng = random.Random(2)
    for bits in (2, 3, 5, 8):
        for n in (0, 1, 7, 5000, 40000):
            data = bytes(rng.choices(range(1 << bits), [60] + [1] * ((1 << bits) - 1), k=n))
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data
    payload = rng.randbytes(64 * 50)
    shown = list(gif.decode(gif.encode_samples(payload, rows=20)))
    assert len(shown) == 3 and b"".join(f.samples.tobytes() for f in shown) == payload
    assert [f.at_ms for f in shown] == [0, 100, 200]
    rows = gif.digests(edge).collect()
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] for r in rows)
    assert len({r["media_sha256"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert gif.digests(none).count() == 0


def test_gif_rules():
    """Two 2x1 images on a 2x1 screen: transparency keeps what is below, disposal 2 clears."""
    def image(indices, control):
        return control + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0, 2]) + gif._blocks(gif.lzw_encode(bytes(indices), 2))

    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    control = lambda disposal, clear: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear >= 0), 5, 0, max(clear, 0)]) + b"\0"
    data = b"GIF89a" + bytes([2, 0, 1, 0, 0x81, 0, 0]) + palette + image([0, 1], control(1, -1)) + image([2, 3], control(2, 3)) + image([3, 0], control(0, 3)) + b"\x3b"
    red, green, blue = 0xFF0000FF, 0xFF00FF00, 0xFFFF0000
    assert [f.canvas.ravel().tolist() for f in gif.decode(data)] == [[red, green], [blue, green], [0, red]]


def test_op2_against_hashes(spark):
    """The payload fields of every text, by hashlib and zlib alone; and the frames of the stored form."""
    import hashlib

    from lavra.llm.queries import op2_gif

    tiny = SF.replace("sf0.01", "sf0.001")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = op2_gif(spark, tiny).collect()
    assert len(got) == len(text)
    for r in got:
        raw = text[r["doc_id"]]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.encode_samples(payload, rows=gif.FRAME_ROWS)
        frames = -(-len(payload) // (64 * gif.FRAME_ROWS))
        shows = [max(range(512), key=lambda c, p=payload[i * 64 * gif.FRAME_ROWS : (i + 1) * 64 * gif.FRAME_ROWS]: (sum(n for b, n in zip(*np.unique(np.frombuffer(p, np.uint8), return_counts=True)) if (b >> 5) * 73 == c), -c)) for i in range(frames)]
        assert (r["n_frames"], r["duration_ms"], r["frame_features"]) == (frames, 100 * frames, ",".join(f"{100 * i}:{c}" for i, c in enumerate(shows)))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert sum(int(x.split(":")[1]) for x in r["feature"].split(",")) == len(payload)
    big = spark.createDataFrame([(1, "x\u00e9" * 1_000_000), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["n_bytes"], r["payload_bytes"]) for r in gif.digests(big).orderBy("doc_id").collect()] == [(3_000_000, 3_000_000 // 64 * 64 + 64 * (3_000_000 % 64 > 0)), (0, 64), (0, 64)]


def test_gif_frames_as_rows(spark):
    """Timed frames with their histograms; damaged media give one row with an error each, and never a whole screen in memory."""
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    image = lambda indices, control: control + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0, 2]) + gif._blocks(gif.lzw_encode(bytes(indices), 2))
    control = lambda disposal, clear, delay: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear >= 0), delay, 0, max(clear, 0)]) + b"\0"
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x81, 0, 0]) + palette
    sound = head + image([0, 1], control(1, -1, 5)) + image([2, 3], control(2, 3, 7)) + image([3, 0], control(0, 3, 1)) + b"\x3b"
    huge = b"GIF89a" + b"\xff\xff\xff\xff" + bytes([0x81, 0, 0]) + palette + image([0, 1], b"") + b"\x3b"
    cut = head + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0, 2]) + gif._blocks(gif.lzw_encode(bytes([0]), 2)) + b"\x3b"
    rows = spark.createDataFrame([(1, sound), (2, huge), (3, cut), (4, b"no gif"), (5, None), (6, sound[:40])], "k int, media binary")
    got = gif.frames_of(rows, "k", "media").orderBy("id", "frame").collect()
    good = [(r["at_ms"], r["delay_ms"], r["disposal"], r["transparent"]) for r in got if r["id"] == 1]
    assert good == [(0, 50, 1, -1), (50, 70, 2, 3), (120, 10, 0, 3)]
    red, green, blue = 7 << 6, 7 << 3, 7
    said = [dict(tuple(map(int, x.split(":"))) for x in r["histogram"].split(",")) for r in got if r["id"] == 1]
    assert said == [{red: 1, green: 1}, {blue: 1, green: 1}, {512: 1, red: 1}]
    faults = {r["id"]: r["error"] for r in got if r["error"]}
    assert set(faults) == {2, 3, 4, 6} and "pixels" in faults[2] and "cut" in faults[3]


def test_quality(docs, labels, edge, none):
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert quality.scores(edge, model).count() == len(EDGE) and quality.scores(none, model).count() == 0
    assert quality.fit(none, labels).score(np.zeros((1, 16)))[0] == pytest.approx(0.7)
    assert quality.keep_good(edge, model).columns == edge.columns


def test_bpe(docs, edge, none):
    import public_tokenizers
    import tiktoken

    tool = bpe.replayer(bpe.default_path())
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    rng = random.Random(3)
    odd = ["".join(rng.choices("aAbé ß\n\t\x1f　一①½'sltmx0.!\U0001f600\0", k=300)) for _ in range(60)]
    many = [r["text"] for r in docs.limit(200).collect()] + odd + ["", "a" * 3000, " " * 500, "the the"]
    ids = tool.encode(many)
    assert ids == real.encode_ordinary_batch(many)
    assert [tool.decode(x) for x in ids] == [x.encode() for x in many]
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.digests(edge).collect()}[1] == 0
    assert bpe.digests(none).count() == 0


def test_attribution(spark, edge, none):
    first, last, starts = np.array([0, 3, 6]), np.array([2, 5, 9]), np.array([0, 4, 8])
    assert attribution.allocate(first, last, starts, "start")[0].tolist() == [2, 1, 0]
    assert attribution.allocate(first, last, starts, "majority")[0].tolist() == [1, 2, 0]
    assert attribution.allocate(first, last, starts, "split")[0].tolist() == pytest.approx([4 / 3, 2 / 3 + 0.5, 0.5])
    for r in attribution.counts(edge).collect():
        assert sum(map(int, r["section_tokens"].split(","))) == r["n_tokens"]
    assert attribution.counts(none).count() == 0 and attribution.sections(none).count() == 0
    by = {(r["doc_id"], r["section"]): (r["start"], r["end"], r["n_tokens"]) for r in attribution.sections(edge.where("doc_id = 7"), fields=["source", "text"]).collect()}
    assert by[7, 0][:2] == (0, 2) and by[7, 1][:2] == (2, 20) and by[7, 0][2] + by[7, 1][2] == len(bpe.replayer(bpe.default_path()).encode(["t\nthe same text here"])[0])


def brute_sections(text):
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    if len(out) > 1 and text.endswith("\n"):
        out.pop()
    return [*out[:-1], (out[-1][0], len(text))]


def brute_counts(text, real, rule="majority"):
    """(tokens, crossing tokens, tokens of each line) by one comparison a token and line."""
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    lines, at, crossing = brute_sections(text), 0, 0
    got = [0] * len(lines)
    ids = real.encode_ordinary(text)
    for token in ids:
        size = len(real.decode_single_token_bytes(token))
        a, b = owner[at], owner[at + size - 1] + 1
        at += size
        shared = [max(0, min(b, y) - max(a, x)) for x, y in lines]
        crossing += sum(map(bool, shared)) > 1
        if rule == "split":
            got = [g + s / (b - a) for g, s in zip(got, shared)]
        else:
            got[shared.index(max(shared)) if rule == "majority" else next(i for i, s in enumerate(shared) if s)] += 1
    return len(ids), crossing, got


@pytest.fixture(scope="module")
def real():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})


def test_op8_against_brute_force(spark, real):
    from lavra.llm.queries import op8_token_counts

    tiny = SF.replace("sf0.01", "sf0.001")
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = op8_token_counts(spark, tiny).collect()
    assert len(got) == len(text)
    for r in got:
        n, crossing, by = brute_counts(text[r["doc_id"]], real)
        assert (r["n_tokens"], r["n_crossing"], r["n_sections"], r["section_tokens"]) == (n, crossing, len(by), ",".join(map(str, by)))
    rng = random.Random(6)
    odd = ["".join(rng.choices("ab c\n\n\u00e9\U0001f600\r .", k=rng.choice([0, 1, 5, 80]))) for _ in range(200)] + ["x " * 1_200_000, ""]
    table = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for rule in attribution.RULES:
        for r in attribution.counts(table, rule).collect():
            if len(text := odd[r["doc_id"]]) > 1000:
                assert r["section_tokens"] == str(r["n_tokens"] if rule != "split" else float(r["n_tokens"]))
                continue
            n, crossing, by = brute_counts(text, real, rule)
            assert (r["n_tokens"], r["n_crossing"]) == (n, crossing) and [float(x) for x in r["section_tokens"].split(",")] == pytest.approx(by)


def test_op4_against_the_library(spark, real):
    import hashlib

    from lavra.llm.queries import op4_bpe

    tiny = SF.replace("sf0.01", "sf0.001")
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in op4_bpe(spark, tiny).collect():
        ids = real.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text[r["doc_id"]].encode()))
    tool = bpe.Replay(bpe.load_ranks(bpe.default_path()))
    many = [f"word{i} of{i * 7}some thing{'a' * (i % 50)}" for i in range(3000)]
    held, bpe.WORDS = bpe.WORDS, 2000
    try:  # what is forgotten, and what is had from the words known before
        for at in (0, 500, 1000, 600, 0):
            assert tool.encode(many[at : at + 900]) == real.encode_ordinary_batch(many[at : at + 900])
    finally:
        bpe.WORDS = held
    runs = ["a" * n for n in range(1, 120)] + ["ab" * n + "a" * n for n in range(60)] + [" " * n for n in range(60)] + ["\n" * n for n in range(60)]
    assert tool.encode(runs) == real.encode_ordinary_batch(runs)


def test_secrets(edge, none):
    plain = b"password=hunter2hunter2"
    wrapped = [base64.b64encode(plain), base64.b64encode(base64.b64encode(plain)), base64.b64encode(gzip.compress(plain)), base64.b64encode(zlib.compress(plain)), b"%70assword%3Dhunter22", rb"\u0070assword=hunter22"]
    for w in wrapped:
        text = "é before " + w.decode() + " after"
        base, every = secrets.find(text)
        assert len(every) > len(base) and any(s[0] == "assign" for s in every)
        assert all(9 <= a and b <= len(text) - 6 for _, a, b in every)
        assert "after" in secrets.redact(text, every)
    # A name in plain and a value in escapes, escapes of two codings inside each other, and a run that isn't UTF-8.
    assert ("assign", 0, 26) in secrets.find("password = %61b%63def%67hi")[1]
    assert ("assign", 3, 40) in secrets.find("%ff" + "".join(f"%5Cu{ord(c):04x}" if c == "p" else c for c in "password=hunter") + "%32%33%34%35%36")[1]
    assert secrets.find("100%ab %zz \\u12 %" + "%25" * 40 + "41")[1] == []
    assert secrets.find("secret: token:abcdef")[0] == []  # the short match takes the second name with it
    assert secrets.find("API_KEY = 'abcdef' " + "AKIA" + "A" * 16 + " " + "0f" * 12)[0] == [("assign", 0, 17), ("access", 19, 39), ("hex", 40, 64)]
    rows = secrets.digests(edge).collect()
    assert len(rows) == len(EDGE) and secrets.digests(none).count() == 0
    assert secrets.redacted(edge).columns == edge.columns


def found_in(wrapped, kind="assign"):
    """Whether a secret is found, and masked, in `wrapped` between other words."""
    text = f"before {wrapped} after"
    every = secrets.find(text)[1]
    assert all(7 <= a and b <= len(text) - 6 for _, a, b in every)
    return any(k == kind for k, _, _ in every)


def test_secrets_nested_deep_are_linear():
    import time

    text = "x " + "%" + "25" * 60_000 + "70assword=hunter2hunter2 " + " y"
    start = time.perf_counter()
    assert found_in_spans(text) and time.perf_counter() - start < 5
    assert found_in_spans("%" + "25" * 10 + "70assword=hunter2hunter2")


@pytest.mark.parametrize("sign", ["%" + "25" * 90_000 + "70assword", "\\" + "u005c" * 36_000 + "u0070assword", "%" + "5Cu0025" * 26_000 + "70assword", "\\" + "x5c" * 60_000 + "x70assword", "\\" + "u{5c}" * 30_000 + "u{70}assword"])
def test_secrets_nests_of_any_escape_are_linear(sign):
    import time

    start = time.perf_counter()
    assert found_in_spans(sign + "=hunter2hunter2") and time.perf_counter() - start < 5


def test_secrets_show_every_layer_of_a_deep_nest(monkeypatch):
    """What comes off in one step is what layer by layer shows; only hex runs stand in the layers between."""
    texts = ["%" + "25" * n + tail for n in (17, 30) for tail in ("70assword=hunter2hunter2 x", "deadbeefdeadbeefdeadbeef", "41 AKIA" + "B" * 20)]
    texts += ["\\" + "u005c" * n + "u0070assword: hunter2hunter2 %" + "25" * 20 + "41" for n in (17, 40)] + ["%" + "5Cu0025" * 12 + "70assword=hunter2hunter2"]
    at_once = [secrets.find(t)[1] for t in texts]
    monkeypatch.setattr(secrets, "NEST", 1 << 30)
    monkeypatch.setattr(secrets, "NESTED", __import__("re").compile(r"(?!)"))
    for text, found in zip(texts, at_once):
        by_layer = secrets.find(text)[1]
        assert set(by_layer) <= set(found) and {s for s in found if s[0] != "hex"} == {s for s in by_layer if s[0] != "hex"}


def test_secrets_inflate_within_bounds():
    """A short text that inflates to 100 MB without a break: whole, and in bounded memory."""
    import subprocess
    import sys

    code = """
import base64, resource, sys, zlib
from lavra.llm import secrets
tool = zlib.compressobj()
body = b"".join(tool.compress(b"a" * (1 << 20)) for _ in range(100)) + tool.compress(b" password=hunter2hunter2") + tool.flush()
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = secrets.find(base64.b64encode(body).decode())[1]
assert {k for k, _, _ in found} == {"assign", "hex"}, found
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1000)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=__file__.split("/tests/")[0])
    assert int(out.stdout) < 500, out.stderr


def wrap(rng, text):
    """`text` in up to four codings at random."""
    for _ in range(rng.randint(1, 4)):
        data = text.encode()
        text = [
            lambda: base64.b64encode(data).decode(), lambda: base64.urlsafe_b64encode(gzip.compress(data)).decode(), lambda: "".join(f"%{c:02X}" for c in data),
            lambda: "".join(f"\\u{c:04x}" for c in data), lambda: str(zlib.compress(data)), lambda: text.replace("%", "%25").replace("\\", "\\u005c"),
        ][rng.randrange(6)]()
    return text


def test_secrets_planted_in_layers():
    """Every planted secret is found at the place of its wrapped form, and texts without one stay clean."""
    rng = random.Random(12)
    for n in range(300):
        secret = rng.choice(["password=hunter2hunter%02d" % (n % 100), "AKIA" + "ABCDEFGH" * 3, "0123456789abcdef" * 2])
        wrapped = wrap(rng, secret)
        kind = "assign" if secret[0] == "p" else "access" if secret[0] == "A" else "hex"
        assert found_in(wrapped, kind), (secret, wrapped)
        assert not [s for s in secrets.find("word " + wrap(rng, "nothing of note here, no") + " word")[1] if s[0] != "hex"]


def found_in_spans(text):
    return any(k == "assign" and a <= 2 for k, a, _ in secrets.find(text)[1])


def test_op5_base_spans_against_a_plain_scan(spark):
    """The base columns of every text by the patterns as they are stated, one after the other."""
    import hashlib
    import re

    from lavra.llm.queries import op5_secrets

    tiny = SF.replace("sf0.01", "sf0.001")
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    stated = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24)]
    for r in op5_secrets(spark, tiny).collect():
        found = [(m.start(), n, kind, m.end()) for n, (kind, form, least) in enumerate(stated) for m in re.finditer(form, text[r["doc_id"]]) if len(m[1]) >= least]
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, k, _ in found) for x in ("assign", "access", "hex"))
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_secrets_in_odd_characters():
    for odd in ("\u00a0", "\u202f", "\u3000", "\u200b", "\ufeff", "\f"):
        body = f"mot de passe{odd}: {odd} voil\u00e0 password=hunter2hunter2".encode()
        assert found_in(base64.b64encode(body).decode()) and found_in(base64.b64encode(zlib.compress(body)).decode())
    for bad in (b"\xff", b"\xe9\xe9", b"\xe2\x82", b"\0"):
        body = bad + b" text " + bad + b" password=hunter2hunter2 " + bad
        assert found_in(base64.b64encode(body).decode()) and found_in(base64.b64encode(gzip.compress(base64.b64encode(body))).decode())
    text = "x " + base64.b64encode(b"\xff\xe9 caf\xc3\xa9 AKIA" + b"A" * 16 + b" \xff").decode()
    (_, a, b), = secrets.find(text)[1]
    assert (a, b) == (2 + 9 * 4 // 3, 2 + (29 * 8 + 5) // 6)


def test_secrets_in_any_base64():
    rng = random.Random(3)
    for n in range(40):
        body = zlib.compress(rng.randbytes(300) + b" password=hunter2hunter2 " + rng.randbytes(100))
        assert found_in(base64.urlsafe_b64encode(body).decode().rstrip("="))
        assert found_in("/x/ab"[: n % 6] + base64.b64encode(body).decode()) and found_in(base64.encodebytes(body).decode().strip())
    plain = b"some??text~~ with??? signs~~~ password=hunter2hunter2 and more of it, so that lines are wrapped within"
    for skip in range(3):
        assert found_in(base64.urlsafe_b64encode(b"~?"[:skip] + plain).decode())
        wrapped = base64.b64encode(plain).decode()
        assert found_in("\r\n".join(wrapped[i : i + 43 + skip] for i in range(0, len(wrapped), 43 + skip)))


def test_secrets_in_whole_bodies():
    import bz2
    import lzma
    from urllib.parse import quote, quote_plus

    secret = b"password=hunter2hunter2"
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        for body in (pack(b"nothing here") + pack(secret), pack(secret)):
            assert found_in(base64.b64encode(body).decode())
            assert found_in(quote(body)) and found_in("".join(f"%{x:02x}" for x in body)) and found_in(quote_plus(body))
            assert found_in(str(body)) and found_in("".join(f"\\x{x:02x}" for x in body)) and found_in("".join(f"\\u{x:04x}" for x in body))
    for fill in (b"\xc3\xa9 " * (23 << 20), b"a" * 1000 + b" " + b"\0" * (68 << 20)):
        assert found_in(base64.b64encode(zlib.compress(fill + b" " + secret)).decode())
    assert secrets.find("nothing " + base64.b64encode(zlib.compress(b"still nothing")).decode())[1] == []


def margins_of(mixed, column, weight="mix_probability"):
    own = (mixed[weight] * mixed["mix_tokens"]).groupby(mixed[column]).sum()
    return own / own.sum()


def test_mixing(spark, docs, edge, none):
    rng = np.random.default_rng(4)
    tokens, a, b = rng.integers(1, 100, 60).astype(float), rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    ta, tb = np.array([0.2, 0.3, 0.5]) * tokens.sum(), np.array([0.4, 0.3, 0.2, 0.1]) * tokens.sum()
    w = mixing.rake(tokens, [a, b], [ta, tb])
    assert np.bincount(a, w * tokens) == pytest.approx(ta, rel=1e-6) and np.bincount(b, w * tokens) == pytest.approx(tb, rel=1e-6)
    p = mixing.rake(tokens, [a, b], [ta / 2, tb / 2], w / 2, 1.0)
    assert p.max() <= 1 and np.bincount(a, p * tokens) == pytest.approx(ta / 2, rel=1e-5) and np.bincount(b, p * tokens) == pytest.approx(tb / 2, rel=1e-5)
    # Stated targets, and tempered shares of the margins that have none; the expected tokens are half of all.
    goal = {"lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
    mixed = mixing.calibrated(docs, targets=goal).toPandas()
    assert {k: pytest.approx(v / 10, abs=0.01) for k, v in goal["lang"].items()} == margins_of(mixed, "mix_lang").to_dict()
    own = mixed.groupby("mix_source")["mix_tokens"].sum() ** 0.7
    assert margins_of(mixed, "mix_source", "mix_weight").to_dict() == pytest.approx((own / own.sum()).to_dict(), abs=1e-4)
    assert margins_of(mixed, "mix_source").to_dict() == pytest.approx((own / own.sum()).to_dict(), abs=0.01)
    assert (mixed["mix_probability"] * mixed["mix_tokens"]).sum() / mixed["mix_tokens"].sum() == pytest.approx(0.5, abs=0.01)
    kept = mixed[mixed["mix_kept"]]
    assert kept["mix_tokens"].sum() / mixed["mix_tokens"].sum() == pytest.approx(0.5, abs=0.06)
    assert (kept["mix_tokens"].groupby(kept["mix_lang"]).sum() / kept["mix_tokens"].sum()).to_dict() == pytest.approx({k: v / 10 for k, v in goal["lang"].items()}, abs=0.06)
    # A target that a source's own tokens can't fill: it is kept whole, and the fraction is of what the others can give.
    few = mixing.calibrated(docs, targets={"source": {"src1": 1}}, topic_of=F.lit("t")).toPandas()
    assert few.loc[few["mix_source"] == "src1", "mix_probability"].min() == pytest.approx(1) and few.loc[few["mix_source"] != "src1", "mix_kept"].sum() == 0
    clash = docs.withColumns({"mix_tokens": F.lit("own"), "MIX_kept": F.lit(5)})
    assert mixing.sampled(clash).select("mix_tokens", "MIX_kept").distinct().collect() == [("own", 5)]
    assert mixing.calibrated(edge).count() == len(EDGE) and mixing.sampled(none).count() == 0


def test_mixing_is_the_same_by_table(spark):
    rng = np.random.default_rng(9)
    # Uneven cells, so that some of them reach probability 1.
    rows = [(i, " ".join(["w"] * int(n)), f"l{i % 3}", f"s{i // 3 % 4}", 1) for i, n in enumerate(rng.choice([60, 70, 90, 200], 72))]
    docs = spark.createDataFrame(rows, DOCS)
    small, large = (mixing.calibrated(docs, fraction=0.8, power=0.2, targets={"lang": {"l0": 2, "l1": 1, "l2": 1}}, cells_most=n, tolerance=1e-4).orderBy("doc_id").toPandas() for n in (1000, 0))
    assert np.allclose(small["mix_weight"], large["mix_weight"], rtol=1e-6) and np.allclose(small["mix_probability"], large["mix_probability"], atol=1e-6)
    assert small["mix_kept"].equals(large["mix_kept"]) and (small["mix_probability"] > 0.999).any()


def test_mixing_table_stops_when_raked(spark, monkeypatch):
    calls, write = [], mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, name: calls.append(name) or write(df, name))
    docs = spark.createDataFrame([(i, "w " * 60, f"l{i % 2}", f"s{i // 2 % 2}", 1) for i in range(8)], DOCS)
    assert {r["mix_probability"] for r in mixing.calibrated(docs, cells_most=0).collect()} == {0.5}
    assert calls.count("raked") <= 2


def test_toxicity(docs, labels, edge, none):
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    bad, hit = got["toxic"] == 1, got["predicted"] == 1
    assert (bad & hit).sum() / bad.sum() > 0.6 and (bad & hit).sum() / hit.sum() > 0.6
    assert toxicity.scores(edge, model).count() == len(EDGE) and toxicity.scores(none, model).count() == 0
    joined = toxicity.fit(docs, labels, labels_most=0)
    assert np.array_equal(joined.counts, model.counts) and np.array_equal(joined.lower, model.lower) and joined.at == model.at
    blank = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.scores(edge, blank).collect()} == {0.15}


def test_toxicity_keeps_all_evidence(spark):
    """More words and bigrams than any fixed list would hold, each of which toxic documents use often enough."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:310_000]
    counted = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 in (0, 1)][:10]
    rows = [(i, " ".join(many) if n % 2 else "plain words of no note " * 50) for n, i in enumerate(counted)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, n % 2) for n, i in enumerate(counted)], "doc_id long, toxic int"))
    assert model.known.size == len(many) and len(set(model.known.resolve(many).tolist())) == len(many) and len(model.pairs) > 300_000
    assert model.known.resolve(["nowhere"]).tolist() == [model.known.size]
    assert model.evidence([" ".join(many[at : at + 5]) for at in range(0, len(many) - 5, 1000)])[0].min() > model.evidence(["plain words of no note"])[0][0] + 1


class BruteModel:
    """The two models by dictionaries, from the texts of all documents but one."""

    def __init__(self, rows, skip):
        from collections import Counter

        use = Counter()
        for i, (text, toxic) in enumerate(rows):
            if toxic and i != skip:
                for w in toxicity.words(text):
                    use.update(toxicity.forms(w))
        self.known = {w for w, n in use.items() if n >= toxicity.RARE}
        self.pairs = [Counter(), Counter()]
        for i, (text, toxic) in enumerate(rows):
            if i != skip:
                ids = ["<s>", *map(self.id, toxicity.words(text))]
                self.pairs[1 - toxic].update(zip(ids, ids[1:]))

    def id(self, word):
        return next((f for f in toxicity.forms(word) if f in self.known), "<unk>")

    def evidence(self, text):
        from math import log

        kept = lambda n: n - toxicity.DISCOUNT if n >= toxicity.RARE else 0.0
        every = set(self.pairs[0]) | set(self.pairs[1])
        shared = {w: 1 + sum(b == w for _, b in every) for w in [*self.known, "<unk>", "<s>"]}
        ids = ["<s>", *map(self.id, toxicity.words(text))]
        ratios = []
        for h, w in zip(ids, ids[1:]):
            p = []
            for own in self.pairs:
                kinds = {}
                for _, b in own:
                    kinds[b] = kinds.get(b, 0) + 1
                total = max(1, sum(kinds.values()))
                low = kept(kinds.get(w, 0)) / total + (1 - sum(map(kept, kinds.values())) / total) * shared[w] / sum(shared.values())
                begun = max(1, sum(n for (a, _), n in own.items() if a == h))
                p.append(kept(own[h, w]) / begun + (1 - sum(kept(n) for (a, _), n in own.items() if a == h) / begun) * low)
            ratios.append(log(p[0] / p[1]))
        n = min(toxicity.WINDOW, len(ratios))
        return max(sum(ratios[i : i + n]) / n for i in range(len(ratios) - n + 1))


def test_toxicity_against_brute_force(spark):
    """Evidence of new texts by the whole model, and of counted texts by the model without them."""
    rng = random.Random(11)
    common, vile = ["plain", "words", "of", "note", "here", "some", "grolnable"], ["vexlin", "murkish", "murkisha", "murkishly"]
    counted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:60]
    rows = []
    for n, i in enumerate(counted):
        said = rng.choices(common, k=rng.randint(1, 14))
        rows.append((" ".join([*said, *(rng.choices(vile, k=2) if n % 3 == 0 else []), *rng.choices(common, k=3)]), int(n % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(counted, rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(counted, rows)], "doc_id long, toxic int")
    model, brute = toxicity.fit(docs, labels), BruteModel(rows, None)
    fresh = ["vexlin murkish here", "some murkishable vexlin of note", "plain words", "grolnable", "unheard of", "", "of " * 40]
    got = model.evidence(fresh)[0]
    for text, value in zip(fresh, got):
        assert value == pytest.approx(brute.evidence(text) if text else 0.0, abs=1e-9)
    # Without a text: what is under the cutoff counts as its own, which moves shared continuations by a little.
    for k in (0, 1, 3, 4, 6):
        assert model.without(*rows[k]) == pytest.approx(BruteModel(rows, k).evidence(rows[k][0]), abs=0.35)


def test_langid(docs, edge, none):
    model = langid.fit(docs)
    got = langid.predictions(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(edge, model).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[6] == "en"
    assert langid.predictions(none, langid.fit(none)).count() == 0
    # Rejection by the sample's own distances: few known texts, all in another alphabet.
    own = langid.predictions(docs.where("length(text) > 200"), model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    rng = random.Random(12)
    foreign = [(i, " ".join("".join(rng.choices("абвгдежзиклмнопрст", k=6)) for _ in range(60))) for i in range(40)]
    got = langid.predictions(docs.sparkSession.createDataFrame(foreign, "doc_id long, text string"), model).toPandas()
    assert own < 0.05 and got["rejected"].all()


def test_langid_tells_many_languages(spark):
    """More languages than the sample's even share would hold at a few texts each."""
    rng = random.Random(13)
    rows = []
    for n in range(700):
        alphabet = [chr(0x4E00 + n * 12 + i) for i in range(12)]
        rows += [(n * 4 + i, "".join(rng.choices(alphabet, k=60)), f"l{n}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predictions(docs, langid.fit(docs, clusters=1)).join(docs, "doc_id").toPandas()
    learned = set(got.loc[~got["held_out"], "lang"])
    assert (got.loc[got["lang"].isin(learned), "lang"] == got.loc[got["lang"].isin(learned), "lang_pred"]).mean() > 0.95


def test_vptree(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(900, 8))
    points[100:400] = points[100]  # a large group of copies
    tree = vptree.build(np.arange(900), points, float((points**2).sum(1).max()), leaf=16)
    scores, ids = vptree.search(tree, np.arange(50), points[:50], 10)
    for q in range(50):
        exact = sorted((-s, i) for i, s in enumerate(vptree.exact_scores(np.tile(points[q], (900, 1)), points)) if i != q)[:10]
        assert ids[q].tolist() == [i for _, i in exact]
    rows = [(i, p.tolist()) for i, p in enumerate(points[:60])] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [None] * 8), (None, [1.0] * 8)] + [(5, points[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.where("vec_id % 20 = 0"), k=100).toPandas()
    assert set(got["query_id"]) == {0, 20, 40} and (got.groupby("query_id").size() == 59).all()
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0
    odd = df.union(spark.createDataFrame([(200, [9.0] * 9), (220, [1.0] * 2)], df.schema))
    assert vptree.nearest(odd, odd.where("vec_id % 20 = 0"), k=100).count() == 3 * 59


def test_vptree_over_shards(spark, monkeypatch):
    """Many small trees in several lanes, ids that repeat in several of them, and a factor above 1."""
    monkeypatch.setattr(vptree, "SHARD", 64)
    monkeypatch.setattr(vptree, "LANE", 3)
    rng = np.random.default_rng(6)
    points = rng.normal(size=(700, 6))
    rows = [(i % 650, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vptree.nearest(df, df.where("vec_id % 50 = 0 and vec_id > 60"), k=7).toPandas()
    for q, own in got.groupby("query_id"):
        best = {}
        for i, p in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(vptree.exact_scores(points[[q]], np.array([p]))[0]))
        want = sorted((-s, i) for i, s in best.items())[:7]
        assert own.sort_values("rank")["vec_id"].tolist() == [i for _, i in want]
    near = vptree.nearest(df, df.where("vec_id % 50 = 0 and vec_id > 60"), k=7, factor=1.5).toPandas()
    both = got.merge(near, on=["query_id", "vec_id"])
    assert len(both) / len(got) >= 0.9


def test_pipeline_stages_against_brute_force(spark, real):
    """Each stage on its own input, row by row, and run() as the stages one after the other."""
    import corpus_pipeline

    tiny = SF.replace("sf0.01", "sf0.001")
    now = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, labels = now.columns, spark.read.parquet(f"{tiny}/labels.parquet")
    seen = {r["doc_id"]: r for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, now, tiny), "test")
        rows = {r["doc_id"]: r for r in out.collect()}
        assert len(rows) == out.count() and set(rows) <= set(seen)
        if name != "bpe":
            assert out.columns == columns
        if name == "quality":
            model = quality.fit(now, labels)
            good = {i for i, r in seen.items() if model.score(np.array([quality.features((r["text"] or "").encode())]))[0] >= 0.7}
            assert set(rows) == good and all(rows[i] == seen[i] for i in rows)
        elif name == "near-dedup":
            sets = {i: brute_set(r["text"]) for i, r in seen.items()}
            links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            group = components_of(sets, links)
            assert set(rows) == {i for i in sets if group[i] == i} and all(rows[i] == seen[i] for i in rows)
        elif name == "secrets":
            for i, r in seen.items():
                clean = secrets.redact(r["text"], secrets.find(r["text"])[1])
                assert (rows[i]["text"], rows[i]["n_chars"], rows[i]["source"]) == (clean, len(clean), r["source"])
        elif name == "mixing":
            kept = {r["doc_id"] for r in mixing.calibrated(now, fraction=0.8).where("mix_kept").collect()}
            have, of = (sum(len((x[i]["text"] or "").split()) for i in x) for x in (rows, seen))
            assert set(rows) == kept and all(rows[i] == seen[i] for i in rows) and 0.6 < have / of < 0.95
        else:
            for i, r in rows.items():
                assert list(r["token_ids"]) == real.encode_ordinary(seen[i]["text"]) and r["n_tokens"] == len(r["token_ids"])
        now, seen = out, rows
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, tiny).collect()}
    assert got == {i: list(r["token_ids"]) for i, r in seen.items()}


def test_pipeline_stages_on_odd_rows(spark, edge, none):
    """Null, empty and long texts, repeated rows, null ids, clashing columns, an empty table."""
    import corpus_pipeline

    tiny = SF.replace("sf0.01", "sf0.001")
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, edge, tiny), stage(spark, none, tiny)
        assert empty.count() == 0 and (name == "bpe" or (out.columns == edge.columns and empty.columns == none.columns))
        got = sorted((r["doc_id"] or 0) for r in out.collect())
        if name in ("secrets", "bpe"):
            assert got == [0, 1, 2, 3, 4, 5, 6, 6, 7]
        if name == "near-dedup":
            assert got == [0, 1, 4, 5, 6]


def test_pipeline_near_dedup_by_rows(spark):
    import corpus_pipeline

    rng = random.Random(8)
    one, two, three = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(3))
    rows = [(5, one), (5, two), (-3, one), (5, two), (None, two), (None, three), (None, three), (9, one)]
    got = corpus_pipeline.distinct(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS), SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(-3, one), (5, two), (0, three)])


def test_scored_queries_keep_their_contract(spark):
    """op3, op7 and op9 over all documents: the held-out fold by zlib, predictions by their cuts, scores text by text, and no text of the
    held-out fold, nor another column, moves a score."""
    from lavra.llm import queries

    tiny = SF.replace("sf0.01", "sf0.001")
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in text}
    moved = docs.withColumns({"lang": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("s")})
    other = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    good, vile, spoken = quality.fit(docs, labels), toxicity.fit(docs, labels), langid.fit(docs)
    plain = {
        "op3_quality": (lambda t: float(good.score(np.array([quality.features(t.encode())]))[0]), 0.7, lambda: quality.scores(moved, quality.fit(moved, other))),
        "op7_toxicity": (lambda t: float(vile.score(vile.evidence([t])[0])[0]), 0.3, lambda: toxicity.scores(moved, toxicity.fit(moved, other))),
    }
    for name, (score, cut, again) in plain.items():
        got = {r["doc_id"]: r for r in queries.queries()[name](spark, tiny).collect()}
        assert set(got) == set(text)
        for i, r in got.items():
            assert r["held_out"] == held[i] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut)
            assert r["score"] == pytest.approx(score(text[i]), abs=1e-9)
        assert {r["doc_id"]: r["score"] for r in again().collect()} == pytest.approx({i: r["score"] for i, r in got.items()}, abs=1e-9)
    got = {r["doc_id"]: r for r in queries.op9_langid(spark, tiny).collect()}
    known = {r["lang"] for r in docs.collect() if not held[r["doc_id"]]}
    assert set(got) == set(text) and all(r["held_out"] == held[i] and r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all((got[i]["lang_pred"], got[i]["score"]) == (spoken.predict(t)[0], pytest.approx(spoken.predict(t)[1])) for i, t in text.items())
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predictions(moved, langid.fit(moved)).collect()} == {i: r["lang_pred"] for i, r in got.items()}
