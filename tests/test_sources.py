"""Sources and sinks: lines that are one object, pages of any depth, growing listings, files that are published together."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lavra.functions import providers
from lavra.sources import files, html, listing, staged


def test_lines_are_one_object(spark, tmp_path):
    good = ['{"a": 1}', ' {"a": 2, "b": "x"} ', '{"b": "}{", "a": 3, "c": {"d": [1]}}', "", '{"a": 4, "a": 5}']
    bad = ['{"a": 1} trailing', '{"a": 1}}{', '{"a": 1}{"a": 2}', "[1]", '"x"', "{'a': 1}", '{"a": 1,}', '{"a": 1}]', '{"a": 1},{"b": 2}', '{"a": 1}, "k": 2', '{"a": 1', "x", '{"a": "no number"}', "null"]
    Path(tmp_path, "good").write_text("\n".join(good))
    form = "a long, b string"
    assert sorted(r["a"] for r in files.jsonl(spark, f"file://{tmp_path}/good", form).collect()) == [1, 2, 3, 5]
    Path(tmp_path, "all").write_text("\n".join(good + bad))
    assert sorted(r["a"] for r in files.jsonl(spark, f"file://{tmp_path}/all", form, strict=False).collect()) == [1, 2, 3, 5]
    for n, line in enumerate(bad):
        Path(tmp_path, f"bad{n}").write_text("\n".join([good[0], line]))
        with pytest.raises(Exception, match="not a JSON object"):
            files.jsonl(spark, f"file://{tmp_path}/bad{n}", form).collect()


def test_pages_of_any_depth(spark):
    deep = 20_000
    inner = '<div id="content"><article><h1 class="documentFirstHeading">T</h1><div id="content-core">' + "<div>" * deep + "deep <b>word</b>" + "</div>" * deep + "</div></article></div>"
    got = listing.article(inner)
    assert got[-1] is None and got[2] == "T" and got[7].count("<div>") == deep and "deep <b>word</b>" in got[7]
    assert html.markdown(html.tree("<div>" * deep + "a <em>b</em>" + "</div>" * deep)) == "a *b*"
    assert html.markdown(html.tree("<span>" * 5000 + "x" + "</span>" * 5000)) == "x"
    pages = spark.createDataFrame([(1, inner), (2, None)], "id long, html string")
    assert {r["id"]: r["error"] is None for r in listing.articles(pages, "id", "html").collect()} == {1: True, 2: False}


def folder_site(root):
    """A site whose pages are files, so that it can change between runs; it notes what it is asked for."""
    root = str(root)

    def fetch(offset):
        path = Path(root, f"{offset}.html")
        with open(Path(root, "asked"), "a") as log:
            log.write(f"{offset}\n")
        return path.read_text() if path.exists() else "<html></html>"

    return fetch


def publish(root, n, step=4):
    tile = lambda i: f'<article class="tileItem"><h2 class="tileHeadline"><a href="https://x.org/{i}">item {i}</a></h2></article>'
    last = (n - 1) // step * step
    for page in range(0, n, step):
        Path(root, f"{page}.html").write_text("".join(tile(i) for i in range(page, min(page + step, n))) + f'<a href="?b_start:int={last}">last</a>')


def test_a_crawl_goes_on_where_it_ended(spark, tmp_path):
    site = Path(tmp_path, "site")
    site.mkdir()
    fetch, root = folder_site(site), f"file://{tmp_path}/crawl"
    seen = []
    for n in (10, 10, 23):
        publish(site, n)
        Path(site, "asked").write_text("")
        got = listing.crawl(spark, fetch, root, 4)
        assert sorted(int(r["link"].rsplit("/")[-1]) for r in got.collect()) == list(range(n))
        seen.append(Path(site, "asked").read_text().split())
    # Whole pages of the first run are read by no later one, but for the first and last, which tell how long the listing is.
    assert "4" in seen[0] and "4" not in seen[1] and "4" not in seen[2] and "12" in seen[2]
    assert spark.read.parquet(f"{root}/rows").count() == 23
    known = spark.createDataFrame([("https://x.org/3",)], "link string")
    assert listing.crawl(spark, fetch, root, 4, known).count() == 22


def test_files_are_published_together(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("batch_id"), F.concat(F.lit('é "q", \n'), "id").alias("said"), F.array("id").alias("l"))
    staged.append_events(rows, path)
    staged.append_events(rows.where("id < 5"), path)
    form = "id long, batch_id long, said string, l array<long>"
    assert staged.read_events(spark, path, form).count() == 45
    # A task that fails leaves nothing.
    broken = rows.withColumn("said", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("said"))).repartition(4)
    before = staged.files(path)
    with pytest.raises(Exception, match="lost"):
        staged.append_events(broken, path)
    assert staged.files(path) == before and not list(Path(tmp_path, "log", "_staging").glob("*"))
    staged.append_events(rows, path)
    got = staged.read_events(spark, path, form)
    assert got.count() == 85 and got.exceptAll(rows.union(rows).union(rows.where("id < 5"))).count() == 0
    # A file a batch, read back with its line ends and quotes; a run that begins anew.
    out = f"file://{tmp_path}/lots"
    staged.write_batches(rows, out)
    assert {Path(f).name for f in staged.files(out)} == {f"lote_{i}_classificacoes.csv" for i in range(3)}
    assert Path(tmp_path, "lots", "lote_1_classificacoes.csv").read_bytes().startswith(b"\xef\xbb\xbfid,said,l\n")
    read = staged.read_batches(spark, out, "id long, said string, l string", by="1")
    assert {(r["id"], r["said"], r["l"]) for r in read.collect()} == {(i, f'é "q", \n{i}', f"[{i}]") for i in range(1, 40, 3)}
    staged.write_batches(rows.where("batch_id = 1"), out, overwrite=True)
    assert staged.read_batches(spark, out, "id long, said string, l string").count() == 13
    assert staged.read_events(spark, f"file://{tmp_path}/none", form).count() == 0


def test_chains_of_providers(spark):
    asked = []

    def flaky(session, model, prompt, timeout):
        asked.append((model, timeout))
        if model == "a" and prompt == "pass" and asked.count(("a", 60.0)) < 3:
            raise providers.Passing("busy")
        if prompt == "limit" and timeout < 300:
            raise providers.Limited("429")
        if prompt == "none" or (model == "a" and prompt == "text"):
            return "no object", {}
        return f'x {{"m": "{model}"}} y', {"prompt_eval_count": 3, "eval_count": 2} if model == "a" else {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 9}

    waits = []
    chain = providers.Chain([providers.Provider("p", flaky, ("a", "b"), retries=3, when_limited="p")], sleep=waits.append)
    assert chain.answer("pass")[:7] == ('{"m": "a"}', "p", "a", 3, 2, 5, 3) and waits == [0.5, 1.0]
    assert chain.answer("text")[:6] == ('{"m": "b"}', "p", "b", 1, 1, 9)
    assert chain.answer("limit")[1:3] == ("p", "a") and ("a", 300.0) in asked
    none = chain.answer("none")
    assert none[0] is None and "no provider answered" in none[-1] and len(none[7]) == 2
    picky = providers.Chain([providers.Provider("p", flaky, ("a", "b"))], accept=lambda x: x["m"] == "b")
    assert picky.answer("x")[2] == "b"
    frame = spark.createDataFrame([("x", 1), (None, 2)], "prompt string, model int")
    got = providers.answered(frame, [providers.Provider("q", lambda s, m, p, t: (json.dumps({"n": len(p)}), {}))]).orderBy("answer").collect()
    assert [r["answer"] for r in got] == ['{"n": 0}', '{"n": 1}'] and got[0]["total_tokens"] == 0 and got[0]["model"] == ""


def test_pages_are_read_in_bounded_runs():
    """Tasks don't grow with the listing, and a stored site's parts don't grow with it either."""
    reader = listing.source(lambda offset: "")({"pages": 50_000, "step": 15, "start": 30}).reader(None)
    runs = [p.value for p in reader.partitions()]
    assert len(runs) <= listing.LANES and [o for r in runs for o in r] == list(range(30, 30 + 50_000 * 15, 15))
    stream = listing.source(lambda offset: "")({"step": 4}).streamReader(None)
    assert len(stream.partitions({"items": 6}, {"items": 400_000})) <= listing.LANES


def test_a_stored_site_is_read_part_by_part(spark, monkeypatch):
    from lavra.plans import intake

    pages = spark.range(3000).select((F.col("id") * 15).alias("key"), F.concat(F.lit("p"), "id").alias("html"))
    for site in (intake.Site(*intake.published(pages, 15)), intake.Site(*intake.published(pages))):
        intake._part.cache_clear()
        order = sorted(range(3000), key=lambda i: (site.part(i * 15), i))
        assert all(site(i * 15) == f"p{i}" for i in order)
        assert max(len(intake._part(site.root, site.part(i * 15))) for i in range(0, 3000, 50)) < 3 * intake.PART
        with pytest.raises(KeyError):
            site(3000 * 15)
    rows = spark.range(400).select(F.concat(F.lit("l"), "id").alias("link"))
    near = F.crc32(F.col("link").cast("binary")) % 7
    got = listing.downloaded(rows, lambda link: (_ for _ in ()).throw(KeyError(link)), near=near)
    assert got.count() == 400 and got.where("status = 'erro'").count() == 400


def test_texts_of_a_csv_come_back(spark, tmp_path):
    """Null, empty and blank texts are told apart; quotes, line ends and the character 0 stay."""
    texts = [None, "", " ", '"', '""', '\x00"', '"\x00', "a,b", "a\r\nb\n", "\\", "\\N", "null", ' "x" ', 'a"b,\n' * 500_000]
    rows = [(i, t, [t] if i % 2 else None) for i, t in enumerate(texts[:-1])] + [(len(texts) - 1, texts[-1], None)]
    files.write_csv(spark.createDataFrame(rows, "i int, text string, tags array<string>"), f"file://{tmp_path}/t")
    got = {r["i"]: (r["text"], r["tags"]) for r in files.csv(spark, f"file://{tmp_path}/t", "i int, text string, tags string").collect()}
    assert got == {i: (t, tags and json.dumps(tags, separators=(",", ":"))) for i, t, tags in rows}


def test_csv_roundtrip_of_nulls_is_that_of_its_sql(spark, tmp_path):
    from lavra.plans.queries import QUERIES

    docs = [(1, "", "en", "a"), (2, None, None, "a"), (3, "x", "en", None), (4, '\x00"', "", "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["k"] is None, r["tags"]) for r in QUERIES["csv_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {1: (False, '["a","en"]'), 2: (True, None), 3: (False, None), 4: (False, '["",""]')}
