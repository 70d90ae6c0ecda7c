"""A paged listing as a Python data source: partitions are runs of pages, one page each up to `LANES` of them, so that pages are fetched
side by side and the number of tasks is bounded however long the listing is.

`fetch` is any callable offset -> HTML that can be pickled; the tests give a canned one. A page without items ends the
listing: rows behind the first empty page don't count. Rows repeat by link across pages; the first one stays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lavra.functions.text import markdown_name
from lavra.operators.learning import key, missing, title_key
from lavra.operators.sampling import first_by
from lavra.runtime import materialise
from lavra.sources.files import INDEX, MANIFEST, with_columns
from lavra.sources.html import Node, markdown, tree
from lavra.sources.markup import local_record

# The lines that dates stand in, and the offset in a link of the pager.
PUBLISHED = re.compile(r"publicado\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}h\d{2})\s+(\S+)", re.I)
ARTICLE_DATES = re.compile(r"Publicado em\s+(\d{2}/\d{2}/\d{4}\s+\d{2}h\d{2})(?:\s+Atualizado em\s+(\d{2}/\d{2}/\d{4}\s+\d{2}h\d{2}))?", re.I)
PAGER = re.compile(r"b_start:int=(\d+)")
LANES = 256  # runs of pages that are read side by side at most


def _said(node: Node | None) -> str | None:
    return (node.text() or None) if node else None


def item(article: Node, offset: int, step: int, index: int) -> tuple:
    """One tile of a listing as a row of `INDEX`."""
    byline, heading = _said(article.first({"class_": "documentByLine"})), article.first({"tag": "h2", "class_": "tileHeadline"})
    link, dates = heading.first({"tag": "a"}) if heading else None, PUBLISHED.search(byline or "")
    words = [w for k in article.all(class_="keywords") for a in k.all("a") if (w := a.text())]
    day, hour = (dates[1], dates[2]) if dates else (None, None)
    return (
        offset, offset // step + 1, index, _said(article.first({"class_": "subtitle"})), _said(link), _said(article.first({"tag": "p", "class_": "tileBody"})),
        day, hour, f"{day} {hour}" if dates else byline, byline.split()[-1] if byline else None, " | ".join(words), len(words), link.attrs.get("href") if link else None,
    )


def parse(offset: int, html: str, step: int = 15) -> Iterator[tuple]:
    for i, article in enumerate(tree(html).all("article", class_="tileItem"), 1):
        yield item(article, offset, step, i)


def last_offset(html: str) -> int:
    """The largest offset that the page's pager leads to; 0 without one."""
    return max((int(m[1]) for a in tree(html).all("a") if (m := PAGER.search(a.attrs.get("href", "")))), default=0)


def site_count(fetch: Callable[[int], str], step: int = 15) -> int:
    """How many items a listing has, by its first page and the last one that its pager leads to."""
    first = fetch(0)
    have, last = sum(1 for _ in parse(0, first, step)), last_offset(first)
    return have if not have or not last else last + sum(1 for _ in parse(last, fetch(last), step))


def dealt(pages: range) -> list[range]:
    """The pages as runs of neighbours, `LANES` at most."""
    each = max(1, -(-len(pages) // LANES))
    return [pages[i : i + each] for i in range(0, len(pages), each)]


def source(fetch: Callable[[int], str], name: str = "listing") -> type[DataSource]:
    class Reader(DataSourceReader):
        def __init__(self, options):
            self.step = int(options.get("step", 15))
            start = int(options.get("start", 0))
            self.offsets = range(start, start + int(options.get("pages", 1)) * self.step, self.step)

        def partitions(self):
            return [InputPartition(run) for run in dealt(self.offsets)]

        def read(self, partition):
            for page in partition.value:
                yield from parse(page, fetch(page), self.step)

    class StreamReader(DataSourceStreamReader):
        """A listing that grows at its end: offsets count items, so that a run begins where the last one ended, within a page too.
        A run reads up to the last item that the listing has when it begins."""

        def __init__(self, options):
            self.step, self.start = int(options.get("step", 15)), int(options.get("start", 0))

        def initialOffset(self):
            return {"items": self.start}

        def latestOffset(self):
            return {"items": max(self.start, site_count(fetch, self.step))}

        def partitions(self, start, end):
            first, last = start["items"], end["items"]
            return [InputPartition((run, first, last)) for run in dealt(range(first // self.step * self.step, last, self.step))]

        def read(self, partition):
            pages, first, last = partition.value
            for page in pages:
                for i, row in enumerate(parse(page, fetch(page), self.step)):
                    if first <= page + i < last and i < self.step:
                        yield row

        def commit(self, end):
            pass

    class Listing(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return INDEX

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):
            return StreamReader(self.options)

    return Listing


def crawl(spark: SparkSession, fetch: Callable[[int], str], root: str, step: int = 15, known: DataFrame | None = None) -> DataFrame:
    """All rows of a listing that crawls below `root` have found so far, each link once, in the order of the listing, after one more
    crawl: it goes on behind the items that were read before. Rows go to a table as they are read and never to the driver; rows
    whose link `known` (link) holds are left out."""
    spark.dataSource.register(source(fetch))
    rows = spark.readStream.format("listing").option("step", step).load().where("trim(link) <> ''").withColumn("link", F.trim("link"))
    query = rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = first_by(spark.read.schema(rows.schema).parquet(f"{root}/rows"), ["link"], [F.col("offset"), F.col("item_index")])
    found = found if known is None else found.join(known.select(F.trim("link").alias("link")).distinct(), "link", "left_anti")
    return with_columns(found, INDEX)


def collect(spark: SparkSession, fetch: Callable[[int], str], pages: int, step: int = 15, start: int = 0) -> DataFrame:
    """The rows of up to `pages` pages before the first empty one, each link once, by offset and place."""
    spark.dataSource.register(source(fetch))
    rows = spark.read.format("listing").options(pages=pages, step=step, start=start).load().where("trim(link) <> ''").withColumn("link", F.trim("link"))
    rows = materialise(rows, "listed")  # pages are fetched once
    filled = rows.select("offset").distinct()
    behind = filled.select((F.col("offset") + step).cast("long").alias("offset")).union(spark.range(start, start + 1))
    end = behind.join(filled, "offset", "left_anti").agg(F.min("offset")).first()[0]  # the first page without rows
    return first_by(rows.where(F.col("offset") < end), ["link"], [F.col("offset"), F.col("item_index")]).orderBy("offset", "item_index")


def recent(spark: SparkSession, fetch: Callable[[int], str], pages: int, step: int = 15) -> DataFrame:
    """The first pages of a listing, the columns of `INDEX`."""
    return with_columns(collect(spark, fetch, pages, step), INDEX)


def inventory(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """(kind, key) of what is held: the names of stored files (name, text), the folded titles in them, alone and with their dates, and the links
    that the manifest has with status `ok` and a stored file."""
    read = stored.select("name", local_record(F.col("text")).alias("r"))
    day = F.substring_index("r.published_at", " ", 1)
    kinds = {"name": F.col("name"), "title": title_key(F.col("r.title")), "dated": key(F.col("r.title"), day)}
    own = read.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds.items()))).alias("x")).select("x.*")
    named = manifest.where("status = 'ok'").select(F.element_at(F.split("markdown_path", "/"), -1).alias("name"), F.trim("link").alias("key"))
    links = named.join(stored.select("name"), "name", "left_semi").select(F.lit("link").alias("kind"), "key")
    return own.unionByName(links).where("key <> ''").distinct()


def absent(rows: DataFrame, known: DataFrame, manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of a listing that aren't held: neither their file is among `paths` (name), nor their link in the manifest with status `ok`
    and a file that is, nor their title and date (or title, where they have no date) in `known` (titulo, data_publicacao)."""
    named = rows.withColumn("_file", markdown_name(F.col("link")))
    out = named.join(paths.select(F.col("name").alias("_file")).distinct(), "_file", "left_anti").drop("_file")
    held = manifest.where("status = 'ok'").select(F.trim("link").alias("link"), F.element_at(F.split("markdown_path", "/"), -1).alias("name")).join(paths, "name", "left_semi").select("link").distinct()
    return missing(out.join(held, "link", "left_anti").select(*rows.columns), known, "titulo", "data_publicacao")


def progressively(spark: SparkSession, fetch: Callable[[int], str], target: int, known: DataFrame, manifest: DataFrame, paths: DataFrame, step: int = 15, at_once: int = 8) -> DataFrame:
    """Absent rows of the listing from its start, page by page until `target` are found, a page is short or none is left. Pages are
    fetched `at_once` side by side; those behind the one that ends the search don't count."""
    out, start = None, 0
    while target > 0:
        spark.dataSource.register(source(fetch))
        got = spark.read.format("listing").options(pages=at_once, step=step, start=start).load().cache()
        size = {r["offset"]: r["n"] for r in got.groupBy("offset").agg(F.count("*").alias("n")).collect()}
        new = absent(first_by(got.where("trim(link) <> ''"), ["link"], [F.col("offset"), F.col("item_index")]), known, manifest, paths)
        new = new if out is None else new.join(out.select("link"), "link", "left_anti").select(*new.columns)
        found = {r["offset"]: r["n"] for r in new.groupBy("offset").agg(F.count("*").alias("n")).collect()}
        have, end, done = 0 if out is None else out.count(), start, False
        for offset in range(start, start + at_once * step, step):
            if not size.get(offset):
                done = True
                break
            have, end = have + found.get(offset, 0), offset + step
            if have >= target or size[offset] < step:
                done = True
                break
        kept = materialise(new.where(F.col("offset") < end), "listed")
        out = kept if out is None else out.unionByName(kept)
        if done:
            break
        start += at_once * step
    return with_columns(out, INDEX) if out is not None else spark.createDataFrame([], INDEX)


ARTICLE = "section string, category string, title string, subtitle string, published_at string, updated_at string, tags array<string>, content_html string, error string"


def article(html: str) -> tuple:
    """The parts of an article's page as a row of `ARTICLE`; `error` tells what is missing, and all else is null then."""
    try:
        page = tree(html)
        outer = next((n for n in page.walk() if n.attrs.get("id") == "content"), None)
        body = outer.first({"tag": "article"}) if outer else None
        if body is None:
            raise ValueError("no #content article")
        core = body.first({"id_": "content-core"}, {"class_": "content-core"})
        if core is None:
            raise ValueError("no #content-core")
        title = body.first({"tag": "h1", "class_": "documentFirstHeading"})
        if title is None:
            raise ValueError("no title")
        core = core.without(lambda n: n.tag in ("script", "style", "noscript") or n.is_(class_="documentActions") or n.is_(class_="visualClear"))
        dates = ARTICLE_DATES.search(_said(body.first({"id_": "viewlet-above-content-body"}, {"class_": "viewlet-above-content-body"})) or "")
        words = [w for d in outer.children if isinstance(d, Node) and d.is_("div", class_="column") for a in d.all("a") if (w := a.text())]
        parts = (body.first({"tag": "p", "class_": "section"}), body.first({"tag": "p", "class_": "nitfSubtitle"}))
        return (*map(_said, parts), title.text(), _said(body.first({"class_": "documentDescription"})), dates[1] if dates else None, dates[2] if dates else None, words, core.html(), None)
    except (ValueError, AssertionError) as error:
        return (*[None] * 8, f"{type(error).__name__}: {error}")


def articles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, *ARTICLE) of each page."""
    kind = pages.schema[id_col].dataType.simpleString()
    types = [pa.string()] * 6 + [pa.list_(pa.string()), pa.string(), pa.string()]
    names = [x.split()[0] for x in ARTICLE.split(", ")]

    def run(batches):
        for batch in batches:
            columns = list(zip(*(article(x or "") for x in batch.column(1).to_pylist()))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["id", *names])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, {ARTICLE}")


def as_markdown(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, markdown) of each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else markdown(tree(x)) for x in batch.column(1).to_pylist()], pa.string())], ["id", "markdown"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, markdown string")


def downloaded(rows: DataFrame, get: Callable[[str], str], manifest: DataFrame | None = None, near: Column | None = None) -> DataFrame:
    """The manifest of the rows' links: each is fetched and parsed where its row is; a fault gives a row with status `erro` and never ends
    the run. Rows of an earlier manifest stay unless their link comes anew. Links of one `near` (a host, a part of an archive) are
    fetched one after the other by one task."""
    def run(batches):
        for batch in batches:
            out = []
            for link in batch.column(0).to_pylist():
                try:
                    got = article(get(link))
                    fault = got[-1]
                except Exception as error:  # any fault of one page is that page's row
                    got, fault = (None,) * 9, f"{type(error).__name__}: {error}"
                tags = " | ".join(got[6]) if got[6] is not None and not fault else None
                out.append((link, "erro" if fault else "ok", got[2], got[3], got[4], got[5], tags, fault))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(8)], ["link", "status", "titulo_extraido", "subtitulo_extraido", "publicado_em_extraido", "atualizado_em_extraido", "tags_extraidas", "erro"])

    links = rows.select(F.trim("link").alias("link")).where("link <> ''").distinct()
    fetched = links if near is None else links.repartition(near).sortWithinPartitions(near, "link")
    got = fetched.mapInArrow(run, "link string, status string, titulo_extraido string, subtitulo_extraido string, publicado_em_extraido string, atualizado_em_extraido string, tags_extraidas string, erro string")
    got = with_columns(got.withColumn("markdown_path", markdown_name(F.col("link"))), MANIFEST)
    return got if manifest is None else got.unionByName(with_columns(manifest.join(links, "link", "left_anti"), MANIFEST))
