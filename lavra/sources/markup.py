"""News in Markdown, listing lines and HTML pages, parsed by built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.text import let, operation_name_direct, squeeze


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")


def _behind(text: Column, mark: Column) -> Column:
    """What stands behind the first occurrence of `mark`."""
    return F.substr(text, F.call_function("instr", text, mark) + F.length(mark))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def news(text: Column) -> Column:
    """struct(titulo, subtitulo, data_publicacao, data_atualizacao, tags, dateline, corpo) of a news file. The body is what stands
    behind the first `**...**`, wherever that is; without one, behind the first `Tags:` and its line; else the whole text."""
    lines = _lines(text)
    title = F.when(F.get(lines, F.lit(0)).startswith("#"), F.trim(F.regexp_replace(F.get(lines, F.lit(0)), "^#+", ""))).otherwise("")
    tagged, dateline = F.regexp_extract(text, "Tags:\\s*(.+)", 0), F.regexp_extract(text, "\\*\\*(.+?)\\*\\*", 0)
    behind = F.when(dateline != "", _behind(text, dateline)).when(tagged != "", _behind(text, tagged)).otherwise(text)
    parts = F.split(F.regexp_extract(text, "Tags:\\s*(.+)", 1), ",")
    return F.struct(
        title.alias("titulo"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("subtitulo"),
        F.regexp_extract(text, "Publicado em (\\d{2}/\\d{2}/\\d{4})", 1).alias("data_publicacao"),
        F.regexp_extract(text, "Atualizado em (\\d{2}/\\d{2}/\\d{4})", 1).alias("data_atualizacao"),
        F.filter(F.transform(parts, _strip), lambda t: t != "").alias("tags"),
        _strip(F.regexp_extract(text, "\\*\\*(.+?)\\*\\*", 1)).alias("dateline"), _strip(behind).alias("corpo"),
    )


def metadata(text: Column) -> Column:
    """The parts of a news file but its body, and the operation that it names."""
    return let(news(text), lambda p: F.struct(
        p["titulo"].alias("titulo"), p["subtitulo"].alias("subtitulo"), p["data_publicacao"].alias("data_publicacao"), p["data_atualizacao"].alias("data_atualizacao"),
        F.slice(F.array_distinct(p["tags"]), 1, 10).alias("tags"), p["dateline"].alias("dateline"), operation_name_direct(p["titulo"], p["subtitulo"], p["corpo"]).alias("nome_operacao_encontrado"),
    ))


# The lines of a stored file.
_STAMP = "(\\d{2}/\\d{2}/\\d{4}(?:\\s+\\d{2}h\\d{2})?)"
FORMS = {"published": f"(?i)^Publicado em\\s+{_STAMP}$", "updated": f"(?i)^Atualizado em\\s+{_STAMP}$", "tags": "(?i)^Tags:\\s*(.+)$"}


def _fitting(lines: Column, form: str) -> Column:
    return F.filter(lines, lambda x: x.rlike(form))


def local_record(text: Column) -> Column:
    """struct(title, subtitle, published_at, updated_at, tags) of a stored file: the first line of each form, and as the subtitle the
    first other line behind the title."""
    def read(lines: Column) -> Column:
        head = F.array_position(F.transform(lines, lambda x: x.startswith("#")), True)
        first = {k: F.coalesce(F.get(_fitting(lines, form), F.lit(0)), F.lit("")) for k, form in FORMS.items()}
        said = {k: F.regexp_extract(v, FORMS[k], 1) for k, v in first.items()}
        other = lambda x: ~x.rlike("^(Publicado em|Atualizado em|Tags:)") & ~x.isin(*first.values())
        rest = F.filter(F.slice(lines, (head + 1).cast("int"), F.size(lines)), other)
        return F.struct(
            F.when(head > 0, F.trim(F.regexp_replace(F.get(lines, (head - 1).cast("int")), "^#+", ""))).otherwise("").alias("title"),
            F.when(head > 0, F.coalesce(F.get(rest, F.lit(0)), F.lit(""))).otherwise("").alias("subtitle"), said["published"].alias("published_at"), said["updated"].alias("updated_at"),
            F.filter(F.transform(F.split(said["tags"], ","), _strip), lambda t: t != "").alias("tags"),
        )

    return let(_lines(text), read)


def inventory_entry(text: Column) -> Column:
    """struct(title, published_date): the first heading, and the date of the first line that begins with one."""
    def read(lines: Column) -> Column:
        title = F.trim(F.regexp_replace(F.coalesce(F.get(F.filter(lines, lambda x: x.startswith("#")), F.lit(0)), F.lit("")), "^#+", ""))
        form = "(?i)^Publicado em\\s+(\\d{2}/\\d{2}/\\d{4})(?:\\s+\\d{2}h\\d{2})?"
        return F.struct(title.alias("title"), F.regexp_extract(F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(form)), F.lit(0)), F.lit("")), form, 1).alias("published_date"))

    return let(_lines(text), read)


def published_parts(at: Column) -> Column:
    """struct(date, hour) of `dd/mm/yyyy HHhMM`; a date alone has no hour, other text stays as the date, blank text is null."""
    def read(p: Column) -> Column:
        day, hour = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        dated = day.rlike("^\\d{2}/\\d{2}/\\d{4}$")
        return F.struct(F.when(dated, day).otherwise(F.nullif(squeeze(at), F.lit(""))).alias("date"), F.when(dated & hour.rlike("^\\d{2}h\\d{2}$"), hour).alias("hour"))

    return let(F.split(squeeze(at), " "), read)


def index_row(record: Column, link: Column) -> Column:
    """The row of the index of a stored file (`local_record`)."""
    blank = lambda c: F.nullif(c, F.lit(""))
    parts, none = published_parts(record["published_at"]), F.lit(None)
    return F.struct(
        *(none.cast("int").alias(c) for c in ("offset", "page_number", "item_index")), none.cast("string").alias("categoria"), blank(record["title"]).alias("titulo"), blank(record["subtitle"]).alias("subtitulo"),
        parts["date"].alias("data_publicacao"), parts["hour"].alias("hora_publicacao"), blank(record["published_at"]).alias("publicado_em"), F.lit("Markdown local").alias("tipo_conteudo"),
        blank(F.array_join(record["tags"], " | ")).alias("tags"), F.size(record["tags"]).alias("total_tags"), blank(F.trim(link)).alias("link"),
    )


def listing_date(text: Column) -> Column:
    """struct(publicado_em, data, hora) of `publicado dd/mm/yyyy HHhMM kind`; other text stays as publicado_em, blank text is null."""
    form = "(?i)publicado\\s+(\\d{2}/\\d{2}/\\d{4})\\s+(\\d{2}h\\d{2})\\s+\\S+"
    day, hour = (F.nullif(F.regexp_extract(text, form, i), F.lit("")) for i in (1, 2))
    return F.struct(F.coalesce(F.concat(day, F.lit(" "), hour), F.nullif(squeeze(text), F.lit(""))).alias("publicado_em"), day.alias("data"), hour.alias("hora"))


def _unescape(c: Column) -> Column:
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def escape(c: Column) -> Column:
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def strip_tags(html: Column) -> Column:
    quiet = F.regexp_replace(html, "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return squeeze(_unescape(F.regexp_replace(quiet, "(?s)<[^>]*>", " ")))


def page(html: Column) -> Column:
    """struct(title, heading, description, n_links, body_text) of a page."""
    return F.struct(
        strip_tags(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        strip_tags(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"),
        strip_tags(F.regexp_extract(html, "(?is)<p[^>]*>(.*?)</p>", 1)).alias("description"),
        F.regexp_count(html, F.lit("(?i)<a\\s[^>]*href")).alias("n_links"),
        strip_tags(F.coalesce(F.nullif(F.regexp_extract(html, "(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), html)).alias("body_text"),
    )


def canonical_html(section: Column, category: Column, title: Column, subtitle: Column, published: Column, updated: Column, tags: Column, content: Column) -> Column:
    """One page of an article's parts; blank ones are left out, the content is HTML."""
    part = lambda tag, c, lead="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<{tag}>{lead}"), escape(c), F.lit(f"</{tag}>")))
    head = [part("p", section), part("p", category), F.concat(F.lit("<h1>"), escape(title), F.lit("</h1>")), part("p", subtitle), part("p", published, "Publicado em "), part("p", updated, "Atualizado em "), part("p", F.array_join(tags, ", "), "Tags: ")]
    return F.concat(F.lit("<html><body><article>"), F.concat_ws("", *head), content, F.lit("</article></body></html>"))
