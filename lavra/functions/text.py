"""Folding, slugs, tokens and display forms of text, as Column expressions that stay within code generation."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form holds one ASCII character, those characters, and those that fold to several."""
    one, several = {}, {}
    for code in (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else several)[chr(code)] = plain
    return "".join(one), "".join(one.values()), several


@functools.lru_cache(1)
def _class_of_several() -> str:
    """A character class of Java's, as ranges."""
    codes, parts = sorted(map(ord, _folds()[2])), []
    for code in codes:
        if parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in parts) + "]"


@functools.lru_cache(1)
def _unusual() -> str:
    """A short character class that holds all of `_class_of_several`, and of Latin letters hardly any more."""
    near = "".join(f"\\x{{{ord(x):x}}}" for x in _folds()[2] if ord(x) < 0x250)
    return f"[{near}\\x{{250}}-\\x{{10ffff}}]"


def fold(c: Column, lower: bool = True) -> Column:
    """NFKD with what isn't ASCII dropped, lower case. Texts of ASCII alone, and characters that fold to one or none, take
    one pass; a text with one that folds to several goes through a map character by character."""
    one, plain, several = _folds()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one node of the plan, folded to a constant
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    # The long class is tried on texts with unusual characters alone.
    wide = F.when(F.when(c.rlike(_unusual()), c.rlike(_class_of_several())).otherwise(False), spelt).otherwise(c)
    out = F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.translate(wide, one, plain), "[^\\x00-\\x7F]", "")).otherwise(c)
    return F.lower(out) if lower else out


def folded(text: str) -> str:
    """`fold` for a text in a worker."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return text.lower()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with `value` evaluated once: inside a lambda an expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def truncate(c: Column, limit: int = 240) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("..."))).otherwise(c)


def slug(c: Column) -> Column:
    """[a-z0-9_] only, underscores single and none at the ends."""
    out = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9_]+", "_"), "_+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def plain_slug(c: Column) -> Column:
    """Lower case, anything but word characters as underscores, single and none at the ends; accents stay."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "(?U)\\W+", "_"), "_+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def token_slug(c: Column) -> Column:
    """Folded words of three or more, underscores between."""
    return F.array_join(tokens(c), "_")


def object_key(c: Column) -> Column:
    """A JSON key's name, spelling aside: folded, [a-z0-9_] only."""
    return F.regexp_replace(F.regexp_replace(fold(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def truncate_line(c: Column, limit: int = 240) -> Column:
    """One line of at most `limit` characters, three dots where it was cut."""
    line = squeeze(c)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(line)


def tokens(c: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def domain_tokens(c: Column, stop: list[str]) -> Column:
    """Tokens without stop words, numbers and numbers with letters behind."""
    return _telling(tokens(c), stop)


def _telling(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(*stop) & ~t.rlike("^[0-9]+[a-z]*$"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.!?;\\n]+"), squeeze), lambda s: s != "")


def anchored(c: Column, anchors: list[str], limit: int = 12) -> Column:
    """The first distinct sentences that hold an anchor."""
    held = F.filter(sentences(fold(c)), lambda s: functools.reduce(lambda a, b: a | b, [s.contains(x) for x in anchors]))
    return F.slice(F.array_distinct(held), 1, limit)


def domain_sentences(c: Column, anchors: list[str], stop: list[str], limit: int = 12) -> Column:
    """The telling tokens of the first distinct sentences that hold an anchor."""
    held = F.filter(sentences(fold(c)), lambda s: functools.reduce(lambda a, b: a | b, [s.contains(x) for x in anchors]))
    clean = F.filter(F.transform(held, lambda s: F.array_join(_telling(F.regexp_extract_all(s, F.lit("[a-z0-9]{3,}"), F.lit(0)), stop), " ")), lambda s: s != "")
    return F.slice(F.array_distinct(clean), 1, limit)


def phrase_of(phrase: str, gap: str = r"\W+", least: int = 3) -> str:
    """A pattern of the phrase's folded words, each open at its end; empty for a phrase without any."""
    words = re.findall(f"[a-z0-9]{{{least},}}", unicodedata.normalize("NFKD", phrase).encode("ascii", "ignore").decode().lower())
    return r"\b" + gap.join(rf"{w}\w*" for w in words) + r"\b" if words else ""


def domain_terms(c: Column, phrases: list[str], stems: dict[str, str]) -> Column:
    """The phrases that the text holds, in their order, then the labels of the stems that it holds; the first of repeats."""
    folded = fold(c)
    said = [F.when(folded.rlike(phrase_of(p)), F.lit(p)) for p in phrases]
    named = [F.when(folded.contains(stem), F.lit(label)) for stem, label in stems.items()]
    return F.array_distinct(F.array_compact(F.array(*said, *named)))


def informative_tags(tags: Column, phrases: list[str], stems: dict[str, str], anchors: list[str], stop: list[str]) -> Column:
    """The telling tokens of tags with a domain term or an anchor in them; tags that are one stop word go."""
    needles = [phrase_of(p) for p in phrases] + [re.escape(x) for x in (*stems, *anchors)]
    told = F.filter(tags, lambda t: fold(t).rlike("|".join(needles)) & (token_slug(t) != "") & ~token_slug(t).isin(*stop))
    return F.filter(F.transform(told, lambda t: F.array_join(domain_tokens(t, stop), " ")), lambda t: t != "")


def delimited_set(c: Column, by: str = " | ") -> Column:
    """The distinct non-blank parts of a delimited text."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(by)), lambda t: F.trim(t)), lambda t: t != ""))


def compact_terms(c: Column, limit: int = 3) -> Column:
    return F.array_join(F.slice(delimited_set(c), 1, limit), ", ")


#: Words that don't make a residual's phrase telling.
RESIDUAL_STOP = ("policia", "federal", "operacao", "contra", "para", "com", "houve", "meio", "uso", "documentos", "falsos")
#: Tags that say nothing about a case.
IGNORED_TAGS = ("destaque", "operacao_pf", "pf", "policia_federal")


def folded_tags(tags: Column, ignored: tuple[str, ...] = IGNORED_TAGS) -> Column:
    """Folded, trimmed tags without blank and ignored ones."""
    return F.filter(F.transform(tags, lambda t: F.trim(fold(t))), lambda t: (t != "") & ~slug(t).isin(*ignored))


def canonical(label: Column, aliases: dict[str, str] | None = None) -> Column:
    """The slug of a label, or what its alias stands for."""
    name = slug(label)
    if not aliases:
        return name
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), name), name)


def crime_identity(label: Column) -> Column:
    return F.when(label.startswith("crimes_") | label.startswith("crime_"), label).otherwise(F.concat(F.lit("crime_"), label))


def identity_label(identity: Column, aliases: dict[str, str] | None = None) -> Column:
    return canonical(F.regexp_replace(slug(identity), "^crime_", ""), aliases)


def combined(title: Column, subtitle: Column, body: Column) -> Column:
    """The parts that aren't blank, a line each."""
    return F.concat_ws("\n", *(F.when(F.trim(c) != "", F.trim(c)) for c in (title, subtitle, body)))


def usage_line(prompt: Column, completion: Column, total: Column) -> Column:
    whole = F.when(F.coalesce(total, F.lit(0)) > 0, total).otherwise(F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))
    return F.format_string("prompt=%d | completion=%d | total=%d", F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0)), whole)


def ngrams(words: Column, n: int, sep: str = " ") -> Column:
    """All runs of n neighbours of an array of words."""
    def runs(w: Column) -> Column:
        many = F.greatest(F.size(w) - n + 1, F.lit(0))
        out = F.slice(w, 1, many)
        for k in range(2, n + 1):
            out = F.zip_with(out, F.slice(w, k, many), lambda a, b: F.concat(a, F.lit(sep), b))
        return out

    return let(words, runs)


def context(title: Column, subtitle: Column, tags: Column, body: Column) -> Column:
    """`label:` and value blocks with blank lines between; blank values left out."""
    parts = (("titulo", title), ("subtitulo", subtitle), ("tags", F.array_join(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""), ", ")), ("corpo", body))
    return F.concat_ws("\n\n", *(F.when(F.trim(v) != "", F.concat(F.lit(f"{k}:\n"), F.trim(v))) for k, v in parts))


def flatten_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[|,]"), lambda t: F.trim(t)), lambda t: t != "")


def parse_date(c: Column) -> Column:
    """dd/mm/yyyy, alone or with HHhMM; null for anything else."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH'h'mm")), F.try_to_timestamp(c, F.lit("dd/MM/yyyy")))


def bucket(at: Column, granularity: str = "year") -> Column:
    return F.coalesce(F.date_format(at, "yyyy" if granularity == "year" else "yyyy-MM"), F.lit("sem_data"))


def url_slug(url: Column) -> Column:
    """The last path segment, anything but letters, digits, `_` and `-` as a hyphen; `noticia-` and the head of the MD5 where there is none."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", ""), "/"), -1)
    made = F.lower(F.regexp_replace(F.regexp_replace(last, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", ""))
    return F.when(made == "", F.concat(F.lit("noticia-"), F.substring(F.md5(url), 1, 10))).otherwise(made)


def markdown_name(url: Column) -> Column:
    return F.concat(url_slug(url), F.lit("-"), F.substring(F.md5(url), 1, 8), F.lit(".md"))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "sim", "yes", "y"), F.lit(False))


def list_value(c: Column) -> Column:
    """A JSON list of strings, or text split at , ; | and line ends; trimmed, blanks out. Null is no value."""
    text = F.trim(c)
    raw = F.coalesce(F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>")), F.split(text, "[,;\\n|]+"), F.array().cast("array<string>"))
    return F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: t != "")


#: Spellings of the classes of a case.
CLASSES = {"por_crime": "Por crime", "crime": "Por crime", "com_operacao_nomeada": "Com operacao nomeada", "operacao_nomeada": "Com operacao nomeada", "outras": "Outras", "outra": "Outras"}


def case_class(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair)), object_key(text)), text)


def label_list(c: Column, allowed: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """Distinct canonical labels of a list value, only allowed ones where these are given."""
    labels = F.array_distinct(F.filter(F.transform(list_value(c), lambda t: canonical(t, aliases)), lambda t: t != ""))
    return labels if allowed is None else F.filter(labels, lambda t: t.isin(*allowed))


def json_object(c: Column) -> Column:
    """The outermost {...} of an answer, fences and chatter aside; empty where there is none."""
    return F.regexp_extract(c, "(?s)\\{.*\\}", 0)


#: Words that can't follow `operacao` in a name, words that end one, and names and first words that are none.
NAME_NOT_FIRST = ("contra", "para", "em", "de", "do", "da", "no", "na", "com")
NAME_STOP = ("para", "contra", "em", "de", "do", "da", "no", "na", "com", "por")
NAME_BLOCKED = ("pf", "policia", "federal", "contra", "para", "combate", "repressao", "apurar", "investigar")


def operation_name(c: Column) -> Column:
    """Up to six words behind `operacao` in the first 1,800 folded characters, cut at the first stop word; empty where the name
    or its first word is blocked."""
    form = rf"\boperacao\s+(?!(?:{'|'.join(NAME_NOT_FIRST)})\b)([a-z0-9][a-z0-9-]*(?:\s+[a-z0-9][a-z0-9-]*){{0,5}})\b"
    head = F.regexp_extract(F.substring(fold(c), 1, 1800), form, 1)

    def cut(words: Column) -> Column:
        place = F.array_min(F.filter(F.transform(F.array(*map(F.lit, NAME_STOP)), lambda s: F.array_position(F.transform(words, _word), s)), lambda p: p > 0))
        return F.array_join(F.slice(words, 1, F.coalesce(place - 1, F.size(words)).cast("int")), " ")

    name = let(F.split(F.trim(head), "\\s+"), cut)
    blocked = _word(name).isin(*NAME_BLOCKED) | _word(F.substring_index(name, " ", 1)).isin(*NAME_BLOCKED)
    return F.when(blocked, "").otherwise(name)


def _word(folded: Column) -> Column:
    """The slug of text that is folded."""
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def operation_name_direct(title: Column, subtitle: Column, body: Column) -> Column:
    """Up to six capitalised words behind `Operacao` in the title, the subtitle or the head of the body; empty for `pf` alone."""
    said = fold(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(subtitle, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 1200)), lower=False)
    name = F.trim(F.regexp_extract(said, r"Operacao\s+([A-Z][A-Za-z0-9-]*(?:\s+[A-Z0-9][A-Za-z0-9-]*){0,5})", 1))
    return F.when(F.lower(name) == "pf", "").otherwise(name)
