"""Every query against its SQL on the smallest tables, and hand cases of the rules."""

import duckdb
import pyarrow as pa
import pytest

from lavra import runtime
from lavra.functions import text as tx
from lavra.operators import features, rules, sampling, taxonomy
from lavra.plans.queries import ORACLES, QUERIES
from lavra.sources import files, listing, markup
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def rows(df):
    k = sorted(df.columns)
    a = df[k].astype(object)
    return sorted(map(repr, a.where(df[k].notna(), None).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "x string").select(c(F.col("x")).alias("y")).first()["y"]


def test_text_cases(spark):
    assert one(spark, tx.fold, "Ação É") == "acao e"
    assert one(spark, tx.slug, " Tráfico de Drogas! ") == "trafico_de_drogas"
    assert one(spark, lambda c: tx.bucket(tx.parse_date(c)), "31/12/2023 10h30") == "2023"
    assert one(spark, lambda c: tx.bucket(tx.parse_date(c)), "x") == "sem_data"
    assert one(spark, tx.operation_name, "A Operação Mar Aberto da PF") == "mar aberto"
    assert one(spark, tx.list_value, '["a", "b", "a"]') == ["a", "b", "a"]
    assert one(spark, tx.url_slug, "https://x.org/a/B_c d/?q=1") == "b_c-d"


def classified(spark, text, bank):
    return rules.classify(spark.createDataFrame([(1, text)], "doc_id long, text string"), bank).first()


def rule(label, pattern, weight=1.4, kind="crime", pos=1):
    return (kind, label, pattern, weight, "seed", 1, [], pos)


def test_classifier_cases(spark):
    bank = [rule("a", r"\bfoo\w*\b\s+\bbar\w*\b"), rule("b", r"\bqux\w*\b\s+\bzap\w*\b", pos=2)]
    one_hit = classified(spark, "foo bar", bank)
    assert (one_hit["label"], one_hit["confidence"], one_hit["status"]) == ("a", 0.865, "classificado_regex")
    both = classified(spark, "foo bar ... qux zap", bank)
    assert both["labels"] == "a"  # the second is under the floor of 2.0
    none = classified(spark, "nothing", bank)
    assert none["label"] is None and none["confidence"] == 0
    named = classified(spark, "operacao mar aberto", bank)
    assert named["confidence"] == 0.66 and named["status"] == "regex_below_threshold"
    repeated = rules.match(spark.createDataFrame([(1, "foo bar foo  bar")], "doc_id long, text string"), bank).first()
    assert repeated["hit_count"] == 1


def test_samples_and_ranks(spark):
    df = spark.range(10).withColumn("g", F.lit("s"))
    assert sampling.stratified(df, F.col("g"), "id", 0.25).where("sampled").count() == 2
    n = sampling.numbered(spark.range(100).withColumn("k", F.col("id") % 7), ["k", "id"]).orderBy("k", "id").toPandas()
    assert n["n"].tolist() == list(range(1, 101))


def test_numbers_are_dense_with_a_payload(spark):
    """More rows than bounds are sampled from, many ties, and a column beside the key."""
    df = spark.range(400_000, numPartitions=8).select((F.col("id") % 1000).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("payload"))
    got = sampling.numbered(df, ["k"]).agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (400_000, 400_000, 1, 400_000)
    assert sampling.numbered(df, ["k"]).groupBy("k").agg((F.max("n") - F.min("n") + 1 == F.count("*")).alias("run")).where("not run").isEmpty()
    one = spark.range(30_000).withColumn("s", F.lit("same"))
    assert sampling.recurrence(one, "s", ["id"], "c").where("c <> id + 1").isEmpty()
    assert sampling.recurrence(one.limit(0), "s", ["id"], "c").isEmpty()


def test_rules_by_their_own_texts(spark):
    """Rows with one id, null texts, upper-case patterns."""
    bank = [rule("a", r"\bFOO\w*\b"), rule("b", r"\bfoo\w*\b\s+\bbar\w*\b", pos=2), rule("c", r"zap|foo b", pos=3)]
    docs = spark.createDataFrame([(1, "foo bar"), (1, "Food"), (2, None), (None, "foo  bar foo bar")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["label"], r["hit_count"]) for r in rules.match(docs, bank).collect())
    assert got == [(0, "a", 1), (0, "b", 1), (0, "c", 1), (1, "a", 1), (1, "a", 1), (1, "b", 1), (1, "c", 1)]
    assert rules.classify(docs, []).where("label is not null").isEmpty() and rules.classify(docs.limit(0), bank).isEmpty()
    tagged = docs.withColumn("tags", F.array(F.lit("Foo"), F.lit("PF")))
    r = rules.record(tagged.where("doc_id = 2"), bank, tags_col="tags").first()
    assert r["confidence"] == 0.8505 and r["accepted"] and r["matched_rules"][0]["hits"] == ["tag:foo"]


def test_components_and_promotion(spark):
    e = spark.createDataFrame([(3, 7), (7, 9)], "a long, b long")
    nodes = spark.createDataFrame([(3,), (7,), (9,), (11,)], "node long")
    assert {r["node"]: r["component"] for r in features.consolidate(e, nodes).collect()} == {3: 3, 7: 3, 9: 3, 11: 11}
    seen = spark.createDataFrame([(1, "s"), (2, "s"), (3, "operacao_sem_contexto"), (4, "operacao_sem_contexto")], "i int, sig string")
    assert {r["i"]: r["promoted"] for r in taxonomy.promote(seen, "sig", ["i"]).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nsub\nTags: x, y\n**Rio** body")
    got = files.markdown(spark, str(tmp_path)).select(markup.news(F.col("text")).alias("p")).first()["p"]
    assert (got["titulo"], got["tags"], got["dateline"], got["corpo"]) == ("T", ["x", "y"], "Rio", "body")
    records = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, line int, v string")
    assert {(r["k"], r["position"], r["v"]) for r in files.latest(records, "k", "line").collect()} == {("a", 1, "z"), ("b", 2, "y")}
    site = lambda offset: f'<article class="tileItem"><h2 class="tileHeadline"><a href="/n{offset}">N {offset}</a></h2></article><article class="tileItem"><h2 class="tileHeadline"><a href="/n0">again</a></h2></article>'
    assert [r["link"] for r in listing.recent(spark, site, pages=3).collect()] == ["/n0", "/n15", "/n30"]
    assert files.empty(spark, files.MANIFEST).count() == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.markdown(spark, str(tmp_path / "empty"))


def test_paths_are_guarded(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    root = f"file://{tmp_path}/in"
    for bad in (f"file://{tmp_path}", root, f"{root}/../x", f"file://{tmp_path}/inside"):
        with pytest.raises(ValueError):
            files.reset(spark, root, [f"{root}/a", bad])
    assert files.reset(spark, root, [f"{root}/a", f"{root}/none"]) == [f"{root}/a"] and not (tmp_path / "in" / "a").exists()


def test_documents_and_reports(spark, tmp_path):
    import json

    from lavra.operators import reports

    files.write_document(spark.createDataFrame([(1, None, ["é"])], "a int, b string, c array<string>"), f"file://{tmp_path}/d")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "d").glob("part-*"))) == {"a": 1, "b": None, "c": ["é"]}
    cost = {"calls": 2, "prompt_tokens": 3, "completion_tokens": 4, "tokens": 7, "mean": 3.5}
    assert "| Tokens totais | 7 |" in reports.cost_markdown(cost)
    total = {"batches": 1, **{k: 1 for k in reports.SUMS}, "rate": 0.5}
    assert "- Taxa regex acumulada: 50.00%" in reports.totals_markdown(total, [{"batch_id": 1, "docs": 2, "regex_accepted": 1, "regex_residual": 1, "rate": 0.5}])


def test_density_clusters_are_judged(spark):
    assert features.hdbscan_size(1216) == (60, 30) and features.hdbscan_size(9) == (8, 4)
    assert features.unstable(spark.range(100).selectExpr("id % 5 as cluster")) and not features.unstable(spark.range(100).selectExpr("id % 9 as cluster"))


def test_clusters_and_profiles_are_kept(spark, tmp_path):
    from lavra.operators import density, records

    far = spark.createDataFrame([(i, [float(i % 9 * 30), float(i % 7) / 10]) for i in range(360)], "vec_id int, embedding array<double>")
    got, how = density.semantic_clusters(far)
    assert how == "density" and got.groupBy("cluster").agg(F.count_distinct(F.col("id") % 9).alias("n")).where("n > 1").isEmpty()
    got, how = density.semantic_clusters(far.limit(60).withColumn("embedding", F.array(F.col("vec_id").cast("double"))))
    assert how == "kmeans" and got.count() == 60
    assert density.clusters(far.limit(3)).where("cluster <> -1").isEmpty() and density.clusters(far.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        density.clusters(far, most=100)
    files.save_profiles(got, far, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p/profiles").count() == 60
    assert [r[0] for r in spark.createDataFrame([("",), ("31/12/2023",), ("31/12/23",)], "d string").select(records.valid_date(F.col("d"))).collect()] == [True, True, False]


@pytest.mark.parametrize(("name", "most"), [("theme_needles", 1), ("theme_fallback_slug", 2), ("learned_pattern", 1), ("phrase_candidates", 1), ("rule_group", 0), ("rule_remap", 0)])
def test_a_text_is_folded_once(spark, name, most):
    """Each fold of a text has one `translate`; a fold that stands in a plan once for each use made these queries slow."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= most


def test_a_text_that_reads_like_a_label_names_no_theme(spark, duck, tmp_path):
    """A short source and a text of one short word: the fallback's slug is no theme that a needle has named."""
    texts = ["De...", "\n\nfr!\n", "es  .", "thou en", None, "  und  ", "the\nand x les"]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([(t, s) for t in texts for s in ("src7", "src13", None)])], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["theme_needles"](spark, str(tmp_path)).toPandas()
    other = duck.cursor()
    other.sql(f"create temp view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(got) == rows(other.sql(ORACLES["theme_needles"]).df())


def test_pieces_of_batches():
    texts = ["a" * 700, None, "b" * 400, "", "c" * 5000, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    got = list(runtime.pieces(iter([batch, batch.slice(0, 0)]), 1, 1000))
    assert [p.column(0).to_pylist() for p in got] == [[0, 1], [2, 3], [4], [5]]


def test_reviews_of_a_batch_go_to_more_tasks(spark):
    """10,000 documents in three batches: each is dealt to three parts."""
    plan = QUERIES["checked_rules_sql"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().analyzed().toString()
    assert "div cast(3 as bigint)" in plan or "div 3" in plan


def test_density_clusters_of_more_rows_than_one_task_takes(spark, monkeypatch):
    """By blocks the clusters and the noise are those of one task, and more than 20,000 rows are no error."""
    from lavra.operators import density

    rows = [(i, [float(i % 4 * 30) + (i * 7919 % 1000) ** 2 / 7e4, float(i * 104729 % 1013) / 100]) for i in range(700)]
    far = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    alone = {r["id"]: r["cluster"] for r in density.clusters(far, 8, 4).collect()}
    monkeypatch.setattr(density, "ALONE", 100)
    monkeypatch.setattr(density, "BLOCK", 150)
    spread = {r["id"]: r["cluster"] for r in density.clusters(far, 8, 4).collect()}
    both = {(alone[i], spread[i]) for i in alone}
    assert alone.keys() == spread.keys() and len(both) == len({a for a, _ in both}) == len({b for _, b in both}) > 2
    assert all((a < 0) == (b < 0) for a, b in both)


def test_density_clusters_leave_far_blocks_out(spark, monkeypatch):
    """The last task's edges grow with the rows, not with their square: blocks that are far apart have none between them; equal points are one cluster."""
    from lavra.operators import density

    rows = [(i, [float(i % 8 * 90), float(i * 7919 % 1000) / 50, float(i * 104729 % 1013) / 50]) for i in range(1600)]
    rows += [(i, [-500.0, 0.0, 0.0]) for i in range(1600, 2000)]
    far = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    edges, write = [], density.materialise

    def recorded(df, name):
        out = write(df, name)
        edges.extend([out.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(density, "materialise", recorded)
    alone = {r["id"]: r["cluster"] for r in density.clusters(far, 8, 4).collect()}
    monkeypatch.setattr(density, "ALONE", 100)
    monkeypatch.setattr(density, "BLOCK", 64)
    spread = {r["id"]: r["cluster"] for r in density.clusters(far, 8, 4).collect()}
    assert edges[0] < 4 * len(rows)
    both = {(alone[i], spread[i]) for i in alone}
    assert alone.keys() == spread.keys() and len(both) == len({a for a, _ in both}) == len({b for _, b in both}) >= 9
