"""Rule banks: gate, compact, group, flatten, remap, match and classify.

A flat bank has kind, label, pattern, weight, source, uses, examples and pos (its order). Banks grow with what is
learned, never with the documents, so a bank travels to the texts: each text is read once, where it is, rules whose
anchors (words that a match must begin at) it doesn't hold are left out, and the others are searched for. What a
document matched stays in its row as arrays; scores, labels and confidence are expressions over these, so that
classifying shuffles nothing."""

from __future__ import annotations

import functools
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import canonical, crime_identity, folded, folded_tags, let, operation_name, slug
from lavra.runtime import pieces

BANK = "kind string, label string, pattern string, weight double, source string, uses int, examples array<string>, pos int"
WEIGHT = 1.4
#: The generated form: words anchored at their start, blanks or a bounded gap between.
PLAIN = re.compile(r"\\b[a-z0-9]{3,}\\w\*\\b((\\s\+|\\W\+|\.\{0,[0-9]+\})\\b[a-z0-9]{3,}\\w\*\\b)*")
ANCHORS = r"\\b([a-z0-9]{3,})"
# Words that carry no evidence in a learned pattern.
STOP = (
    "a", "ao", "aos", "as", "ate", "com", "contra", "da", "das", "de", "do", "dos", "e", "em",
    "na", "nas", "no", "nos", "o", "os", "ou", "para", "pela", "pelo", "por", "que", "sem",
    "sob", "sobre", "uma", "um", "policia", "federal", "operacao", "operacoes", "crime", "crimes",
    "apura", "apuracao", "investiga", "investigacao", "combate", "repressao", "deflagrou", "foram", "foi", "sao",
    "acao", "conjunta", "entre", "durante", "houve", "manha", "nesta", "neste", "sexta", "feira",
    "cerca", "policiais", "veiculo", "veiculos", "grande", "conjunto", "referencia", "branco",
    "contou", "apoio", "atuacao", "atividade", "irregular",
)
# Words that no learned pattern may hold.
BAD = (
    "assessoria", "brasil", "comunicacao", "contato", "email", "gov", "hoje", "http", "https",
    "imprensa", "file", "mail", "mailto", "nesta", "neste", "nome", "refere", "telefone",
    "telefones", "users", "www",
)
GENERIC = ("crime_organizado",)  # Fixed value: labels that give way to specific ones.

HIT = "array<struct<pos: int, kind: string, label: string, weight: double, hit_count: int, hits: array<string>>>"


def bank(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, BANK)


def anchors(pattern: Column) -> Column:
    return F.regexp_extract_all(F.lower(pattern), F.lit(ANCHORS), F.lit(1))


@functools.lru_cache(100_000)
def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error:
        return False
    return True


def gate(rules: DataFrame, bad: tuple[str, ...] = BAD, stop: tuple[str, ...] = STOP, aliases: dict[str, str] | None = None, non_crime: tuple[str, ...] = ()) -> DataFrame:
    """Valid rules: a known kind, a label, two or more telling anchors, none numeric or bad, a pattern that compiles. Labels
    become canonical; missing weights, sources and uses have their defaults, examples are the first ten distinct ones."""
    own = anchors(F.col("pattern"))
    telling = F.filter(own, lambda t: ~t.rlike("^[0-9]+$") & ~t.isin(*stop, *bad))

    def compiled(batches):
        for batch in batches:
            yield batch.filter(pa.array([compiles(p) for p in batch.column("pattern").to_pylist()], pa.bool_()))

    kept = rules.withColumns({"kind": F.trim("kind"), "label": canonical(F.col("label"), aliases), "pattern": F.trim("pattern")})
    kept = kept.where(F.col("kind").isin("crime", "modus") & (F.col("label") != "") & (F.col("pattern") != "") & (F.size(telling) >= 2))
    kept = kept.where(~F.exists(own, lambda t: t.rlike("^[0-9]+$") | t.isin(*bad)))
    if non_crime:
        kept = kept.where((F.col("kind") != "crime") | ~F.col("label").isin(*non_crime))
    clean = F.filter(F.transform(F.coalesce("examples", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    kept = kept.withColumns({
        "uses": F.greatest(F.coalesce("uses", F.lit(0)), F.lit(1)), "examples": F.slice(F.array_distinct(clean), 1, 10),
        "weight": F.when(F.coalesce("weight", F.lit(0.0)) == 0, WEIGHT).otherwise(F.col("weight")),
        "source": F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "llm_feedback").otherwise(F.trim("source")),
    })
    return kept.mapInArrow(compiled, kept.schema)


def _first_examples(rules: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """(keys, examples): the first distinct examples of each key in order; they are cut before they are gathered."""
    each = rules.select(*keys, "pos", F.posexplode("examples").alias("i", "x")).groupBy(*keys, "x").agg(F.min(F.struct("pos", "i")).alias("at"))
    few = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("_r") <= most)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "x"))), lambda s: s["x"]).alias("examples"))


def compact(rules: DataFrame) -> DataFrame:
    """One row a (kind, label, pattern): uses summed, first weight and source kept, up to ten distinct examples in order."""
    keys = ["kind", "label", "pattern"]
    rows = rules.groupBy(*keys).agg(F.min_by("weight", "pos").alias("weight"), F.min_by("source", "pos").alias("source"), F.sum("uses").cast("int").alias("uses"), F.min("pos").alias("pos"))
    rows = rows.join(_first_examples(rules, keys), keys, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return rows.select(*keys, "weight", "source", "uses", "examples", "pos")


def group(rules: DataFrame) -> DataFrame:
    """One row a (kind, label) with its patterns nested, sorted; source is `mixed` where they differ; the first ten distinct examples
    by pattern. A row holds all patterns of its label: this is the form that a bank is stored in."""
    nested = F.array_sort(F.collect_list(F.struct("pattern", "weight", "source", "uses", "examples")))
    rows = rules.groupBy("kind", "label").agg(
        F.when(F.count_distinct("source") > 1, "mixed").otherwise(F.min("source")).alias("source"), F.sum("uses").cast("int").alias("uses"), nested.alias("patterns")
    )
    every = F.array_distinct(F.flatten(F.transform("patterns", lambda p: p["examples"])))
    return rows.select("kind", F.col("label").alias("classifier"), "source", "uses", "patterns", F.slice(every, 1, 10).alias("examples"))


def flatten(grouped: DataFrame) -> DataFrame:
    """The inverse of `group`; a pattern's own values go before its group's."""
    each = grouped.select("kind", F.col("classifier").alias("label"), F.col("source").alias("group_source"), F.explode("patterns").alias("p"))
    rows = each.select("kind", "label", "p.pattern", F.coalesce("p.weight", F.lit(WEIGHT)).alias("weight"), F.coalesce("p.source", "group_source").alias("source"), F.coalesce("p.uses", F.lit(1)).alias("uses"), "p.examples")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("label", "pattern")))


#: A stored bank's records in all their spellings: flat, grouped, and grouped with bare patterns under the older names.
STORED = "kind string, label string, classificador string, pattern string, pattern_do_classificador string, weight double, source string, uses int, examples array<string>, patterns array<string>, patterns_do_classificador array<struct<pattern_do_classificador: string, pattern: string, weight: double, source: string, uses: int, examples: array<string>>>"


def from_stored(records: DataFrame) -> DataFrame:
    """A flat, ungated bank of stored records (`STORED`); pos is their order by kind, label and pattern."""
    label, none = F.coalesce("label", "classificador"), F.array().cast("array<string>")
    own = F.struct(F.coalesce("pattern", "pattern_do_classificador").alias("pattern"), "weight", "source", "uses", F.coalesce("examples", none).alias("examples"))
    nested = F.transform("patterns_do_classificador", lambda p: F.struct(
        F.coalesce(p["pattern_do_classificador"], p["pattern"]).alias("pattern"), F.coalesce(p["weight"], F.col("weight")).alias("weight"), F.coalesce(p["source"], F.col("source")).alias("source"),
        F.coalesce(p["uses"], F.lit(1)).alias("uses"), F.coalesce(p["examples"], F.col("examples"), none).alias("examples"),
    ))
    bare = F.transform("patterns", lambda p: F.struct(p.alias("pattern"), F.col("weight").alias("weight"), F.col("source").alias("source"), F.col("uses").alias("uses"), F.coalesce("examples", none).alias("examples")))
    rows = records.select("kind", label.alias("label"), F.explode(F.coalesce(nested, bare, F.array(own))).alias("p")).select("kind", "label", "p.*")
    rows = rows.withColumns({"weight": F.coalesce("weight", F.lit(WEIGHT)), "source": F.coalesce("source", F.lit("llm_feedback")), "uses": F.coalesce("uses", F.lit(0))})
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("label", "pattern", "source")))


def upsert(rules: DataFrame, found: DataFrame) -> DataFrame:
    """The bank with `found` (kind, label, pattern, source, title) taken in: a rule it holds is used once more and gains the
    title as an example; others join behind it with the default weight."""
    last = rules.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))
    order = Window.orderBy("kind", "label", "pattern", "title")  # what one batch learned
    new = found.where("label <> '' and pattern <> ''").withColumn("pos", F.row_number().over(order)).join(F.broadcast(last))
    none = F.array().cast("array<string>")
    new = new.select("kind", "label", "pattern", F.lit(WEIGHT).alias("weight"), "source", F.lit(1).alias("uses"), F.when(F.coalesce("title", F.lit("")) != "", F.array("title")).otherwise(none).alias("examples"), (F.col("pos") + F.col("last")).alias("pos"))
    return compact(rules.unionByName(new))


def cleaned(rules: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(the gated, compact bank; one row of before, after and removed patterns and classifiers)."""
    out = compact(gate(rules, **options))
    size = lambda df, name: df.agg(F.count("*").alias(f"{name}_patterns"), F.count_distinct("kind", "label").alias(name))
    stats = size(rules, "before").join(size(out, "after"))
    return out, stats.withColumns({"removed": F.expr("before - after"), "removed_patterns": F.expr("before_patterns - after_patterns")})


def of_kind(rules: DataFrame, kind: str) -> DataFrame:
    """All rules of the labels that have a rule of this kind, whatever kind the rules themselves are."""
    return rules.join(F.broadcast(rules.where(F.col("kind") == kind).select("label").distinct()), "label", "left_semi")


def known_labels(rules: DataFrame, non_crime: tuple[str, ...] = ()) -> DataFrame:
    """(kind, labels): the sorted labels of each kind."""
    return rules.where(~F.col("label").isin(*non_crime)).groupBy("kind").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def remap(rules: DataFrame, labels: DataFrame, rare: str = "noticias_raras") -> DataFrame:
    """Labels by (label, new_label), themselves where there is none; blank and rare ones go. A label has the kind of its first rule;
    a moved rule's examples end in where it came from."""
    moved = rules.join(labels, "label", "left").withColumn("was", F.col("label")).withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
    moved = moved.where(~F.col("label").isin("", rare))
    trace = F.slice(F.concat("examples", F.array(F.concat(F.lit("remapped_from:"), F.col("was")))), 1, 8)
    moved = moved.withColumn("examples", F.when(F.col("was") != F.col("label"), trace).otherwise(F.slice("examples", 1, 8)))
    first = moved.groupBy("label").agg(F.min_by("kind", "pos").alias("kind"))
    return compact(moved.drop("kind", "was").join(first, "label"))


def remap_counts(rules: DataFrame, labels: DataFrame, rare: str = "noticias_raras") -> DataFrame:
    """One row: classifiers (kind and label) that got another label, that went, and that joined another one."""
    own = rules.select("kind", "label").distinct().join(labels, "label", "left").withColumn("target", F.coalesce("new_label", "label"))
    gone = F.col("target").isin("", rare)
    kept = F.count_if(~gone)
    return own.agg(F.count_if(~gone & (F.col("target") != F.col("label"))).alias("remapped"), F.count_if(gone).alias("removed"), (kept - F.count_distinct(F.when(~gone, F.col("target")))).alias("merged"))


WORD = re.compile(r"[a-z0-9_]{3,}")


class Matcher:
    """A bank as compiled patterns behind an index of their anchors."""

    def __init__(self, rules: list):
        self.rules, self.patterns = rules, [re.compile(r[2], re.IGNORECASE) for r in rules]
        self.always, self.by, self.need = [], defaultdict(list), {}
        for i, r in enumerate(rules):
            if PLAIN.fullmatch(r[2]):
                self.need[i] = frozenset(re.findall(ANCHORS, r[2]))
                self.by[max(self.need[i], key=len)].append(i)
            else:
                self.always.append(i)
        known = set().union(*self.need.values()) if self.need else set()
        self.known, self.lengths = known, sorted(set(map(len, known)))

    def candidates(self, folded: str) -> list[int]:
        known, lengths = self.known, self.lengths
        held = {head for w in set(WORD.findall(folded)) for n in lengths if n <= len(w) and (head := w[:n]) in known}
        return sorted([*self.always, *(i for a in held if a in self.by for i in self.by[a] if self.need[i] <= held)])

    def hits(self, folded: str) -> list[dict]:
        out = []
        for i in self.candidates(folded):
            found = dict.fromkeys(" ".join(m[0].split()) for m in self.patterns[i].finditer(folded))
            found.pop("", None)
            if found:
                kind, label, _, weight, *_, pos = self.rules[i]
                out.append({"pos": pos, "kind": kind, "label": label, "weight": float(weight), "hit_count": len(found), "hits": list(found)[:5]})
        return out


@functools.lru_cache(4)
def _matcher(rules: tuple) -> Matcher:
    return Matcher(list(rules))


_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("weight", pa.float64()), ("hit_count", pa.int32()), ("hits", pa.list_(pa.string()))]))


def matched(docs: DataFrame, rules: list, id_col: str = "doc_id", text_col: str = "text", tags_col: str | None = None) -> DataFrame:
    """(doc_id, head, body, tag): for each row the first 1,800 folded characters and, as arrays, every rule that matches the
    folded text or the folded tags, with its distinct hits."""
    frozen = tuple((*r[:6], tuple(r[6]), r[7]) for r in rules)
    held = docs.sparkSession.sparkContext.broadcast(frozen)
    said = F.array_join(folded_tags(F.col(tags_col)), " ") if tags_col else F.lit("")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = _matcher(held.value)
        for batch in pieces(batches, 1):
            texts = [folded(x or "") for x in batch.column(1).to_pylist()]
            labels = [tool.hits(x) if x else [] for x in batch.column(2).to_pylist()]
            columns = [pa.array([x[:1800] for x in texts], pa.string()), pa.array([tool.hits(x) for x in texts], _ARROW), pa.array(labels, _ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "head", "body", "tag"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), said.alias("tags"))
    return rows.mapInArrow(run, f"doc_id {kind}, head string, body {HIT}, tag {HIT}")


def _score(m: Column) -> Column:
    return F.round(m["weight"] * m["hit_count"], 3)


def match(docs: DataFrame, rules: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, kind, label, hit_count, score, hits): every rule that matches the folded text; hits are distinct, and counted so."""
    rows = matched(docs, rules, id_col, text_col).select("doc_id", F.explode("body").alias("m"))
    return rows.select("doc_id", "m.pos", "m.kind", "m.label", "m.hit_count", _score(F.col("m")).alias("score"), "m.hits")


def holds_pattern(rows: DataFrame, pattern: str, folded_text: str, name: str) -> DataFrame:
    """`rows` with `name`: whether the folded text has the row's own pattern, by the same expressions as `matched`; false where the
    pattern doesn't compile."""
    at = [rows.columns.index(c) for c in (pattern, folded_text)]

    def run(batches):
        for batch in pieces(batches, at[1]):
            pairs = zip(*(batch.column(i).to_pylist() for i in at))
            found = [bool(p and compiles(p) and re.search(p, t or "", re.IGNORECASE)) for p, t in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())]))


def merge(body: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, label, hit_count, score, body, tag, pos): sums by label, tag scores at 0.55; pos keeps the order of first hits."""
    rows = body.select("*", F.lit(1.0).alias("factor"))
    if tags is not None:
        rows = rows.unionByName(tags.select("*", F.lit(0.55).alias("factor")))
    return rows.groupBy("doc_id", "kind", "label").agg(
        F.sum("hit_count").cast("int").alias("hit_count"), F.round(F.sum(F.col("score") * F.col("factor")), 3).alias("score"),
        F.count_if(F.col("factor") == 1).alias("body"), F.count_if(F.col("factor") < 1).alias("tag"),
        F.min(F.struct(-F.col("factor"), -F.col("score"), "pos")).alias("first"),
    )


def competitive(merged: DataFrame, floor: float = 2.0, share: float = 0.35) -> DataFrame:
    """Crime labels that hold against the best of their document: the best one, and those of `floor` and `share` of it."""
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "first")
    rows = merged.where("kind = 'crime'").withColumns({"rank": F.row_number().over(best), "top": F.max("score").over(Window.partitionBy("doc_id"))})
    return rows.where((F.col("rank") == 1) | (F.col("top") > 0) & (F.col("score") >= F.greatest(F.lit(floor), share * F.col("top"))))


def _merged(kind: str) -> Column:
    """The matches of one kind in `body` and `tag` as labels, best first: array of (score, label, hit_count, hits, sources)."""
    own = lambda c: F.filter(c, lambda m: m["kind"] == kind)
    both = F.concat(
        F.transform(own("body"), lambda m: F.struct(F.lit(1.0).alias("factor"), (-_score(m)).alias("order"), m["pos"].alias("pos"), m["label"].alias("label"), m["hit_count"].alias("hit_count"), m["hits"].alias("hits"))),
        F.transform(own("tag"), lambda m: F.struct(F.lit(0.55).alias("factor"), (-_score(m)).alias("order"), m["pos"].alias("pos"), m["label"].alias("label"), m["hit_count"].alias("hit_count"), F.transform(m["hits"], lambda h: F.concat(F.lit("tag:"), h)).alias("hits"))),
    )

    def labels(all_: Column) -> Column:
        ordered = F.array_sort(all_, lambda a, b: F.when(a["factor"] != b["factor"], F.when(a["factor"] > b["factor"], -1).otherwise(1)).when(a["order"] != b["order"], F.when(a["order"] < b["order"], -1).otherwise(1)).otherwise((a["pos"] - b["pos"]).cast("int")))
        return let(ordered, lambda o: F.transform(F.array_distinct(F.transform(o, lambda m: m["label"])), lambda name: let(F.filter(o, lambda m: m["label"] == name), lambda mine: F.struct(
            F.round(F.aggregate(mine, F.lit(0.0), lambda s, m: s - m["order"] * m["factor"]), 3).alias("score"), name.alias("label"),
            F.aggregate(mine, F.lit(0), lambda s, m: s + m["hit_count"]).alias("hit_count"), F.slice(F.array_distinct(F.flatten(F.transform(mine, lambda m: m["hits"]))), 1, 5).alias("hits"),
            F.array_distinct(F.transform(mine, lambda m: F.when(m["factor"] == 1, "body").otherwise("tag"))).alias("sources"),
        ))))

    return _best_first(labels(both))


def _best_first(items: Column) -> Column:
    """By score, highest first; equal scores stay in their order."""
    placed = F.transform(items, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def prioritized(crimes: Column, generic: tuple[str, ...] = GENERIC, priority: dict[str, int] | None = None) -> Column:
    """The labels of crimes (score, label, ...) best first, generic ones behind all others, equal scores by priority."""
    weight = F.create_map(*(F.lit(x) for pair in (priority or {"": 0}).items() for x in pair))
    key = F.transform(crimes, lambda m, i: F.struct(m["label"].isin(*generic).cast("int").alias("late"), (-m["score"]).alias("s"), (-F.coalesce(F.element_at(weight, m["label"]), F.lit(0))).alias("p"), i.alias("i"), m["label"].alias("label")))
    return F.transform(F.array_sort(key), lambda k: k["label"])


def record(docs: DataFrame, rules: list, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text", tags_col: str | None = None, non_crime: tuple[str, ...] = (), priority: dict[str, int] | None = None) -> DataFrame:
    """The whole classification of each row: (doc_id, accepted, confidence, source, operation_name, identity, classification, crimes,
    modus, matched_rules); identity, classification, crimes and modus are null below the threshold."""
    return judged(matched(docs, rules, id_col, text_col, tags_col), threshold, non_crime, priority)


def judged(rows: DataFrame, threshold: float = 0.85, non_crime: tuple[str, ...] = (), priority: dict[str, int] | None = None) -> DataFrame:
    """The records of rows (doc_id, head, body, tag) as `matched` gives them."""
    rows = rows.select("doc_id", operation_name(F.col("head")).alias("operation_name"), _merged("crime").alias("all_crimes"), _merged("modus").alias("modus_matches"))
    rows = rows.withColumn("all_crimes", F.filter("all_crimes", lambda m: ~m["label"].isin(*non_crime)))
    top = F.coalesce(F.get("all_crimes", F.lit(0))["score"], F.lit(0.0))
    rows = rows.withColumn("top", top).withColumn("crimes_kept", F.filter("all_crimes", lambda m, i: (i == 0) | (F.col("top") > 0) & (m["score"] >= F.greatest(F.lit(2.0), 0.35 * F.col("top")))))
    tagged = lambda c: F.exists(c, lambda m: F.array_contains(m["sources"], "tag"))
    bonus = lambda when, by: F.when(when, by).otherwise(0.0)
    hits = F.aggregate("crimes_kept", F.lit(0), lambda s, m: s + m["hit_count"])
    crime = 0.61 + F.least(F.lit(0.27), 0.15 * F.col("top")) + F.least(F.lit(0.12), 0.045 * hits) + bonus(F.size("modus_matches") > 0, 0.05) + bonus(F.col("operation_name") != "", 0.04) + bonus(tagged("all_crimes"), 0.08) + bonus(tagged("modus_matches"), 0.02)
    only_name = F.least(F.lit(0.78), 0.66 + F.least(F.lit(0.08), 0.02 * F.size("modus_matches")))
    has_crime = F.size("crimes_kept") > 0
    confidence = F.when(has_crime, F.least(F.lit(0.95), crime)).when(F.col("operation_name") != "", only_name).otherwise(0.0)
    rows = rows.withColumn("confidence", F.round(confidence, 10))
    none = has_crime | (F.col("operation_name") != "")
    source = F.when(F.col("confidence") < threshold, "regex_below_threshold").when(none, "regex").otherwise("regex_no_match")
    rows = rows.withColumn("source", source).withColumn("accepted", F.col("source") == "regex")
    rows = rows.withColumn("crimes", F.when(F.col("accepted"), prioritized(F.slice("crimes_kept", 1, 5), priority=priority)))
    named = F.concat(F.lit("operacao_"), slug(F.col("operation_name")))
    shown = F.concat(F.slice("crimes_kept", 1, F.when(F.col("accepted"), 5).otherwise(3)), F.slice("modus_matches", 1, F.when(F.col("accepted"), 6).otherwise(3)))
    return rows.select(
        "doc_id", "accepted", F.round("confidence", 4).alias("confidence"), "source", "operation_name",
        F.when(F.col("accepted"), F.when(has_crime, crime_identity(F.get("crimes", F.lit(0)))).otherwise(named)).alias("identity"),
        F.when(F.col("accepted"), F.when(has_crime, "Por crime").otherwise("Com operacao nomeada")).alias("classification"), "crimes",
        F.when(F.col("accepted"), F.transform(F.slice("modus_matches", 1, 6), lambda m: m["label"])).alias("modus"), shown.alias("matched_rules"),
        F.transform("crimes_kept", lambda m: m["label"]).alias("candidates"),
    )


def classify(docs: DataFrame, rules: list, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text", tags_col: str | None = None) -> DataFrame:
    """One row a document: label (the best), labels, confidence, status."""
    rows = record(docs, rules, threshold, id_col, text_col, tags_col)
    label = F.get("candidates", F.lit(0))
    status = F.when(F.col("source") != "regex", "regex_below_threshold").when(label.isNotNull(), "classificado_regex").otherwise("operacao_nomeada")
    return rows.select("doc_id", label.alias("label"), F.when(F.size("candidates") > 0, F.array_join("candidates", ",")).alias("labels"), "confidence", status.alias("status"))


def validate(docs: DataFrame, rules: list, positives: DataFrame, negatives: DataFrame, places: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """(pos, positive_hits, negative_hits, accepted, reason): accepted where the pattern compiles, isn't made of places alone, hits a
    positive (if there are any) and at most max(2, 15%) of the negatives, none if `strict`."""
    spark = docs.sparkSession
    sound = [r for r in rules if compiles(r[2])]
    sides = positives.select("doc_id", F.lit(1).alias("side")).union(negatives.select("doc_id", F.lit(0).alias("side"))).distinct()
    found = match(docs, sound).join(sides, "doc_id").groupBy("pos").agg(F.count_if(F.col("side") == 1).alias("positive_hits"), F.count_if(F.col("side") == 0).alias("negative_hits"))
    n = sides.agg(F.count_if(F.col("side") == 1), F.count_if(F.col("side") == 0)).first()
    most = 0 if strict else max(2, int(0.15 * n[1]))
    facts = [(r[7], compiles(r[2]), bool(own := re.findall(ANCHORS, r[2].lower())) and all(t in places for t in own)) for r in rules]
    rows = spark.createDataFrame(facts, "pos int, sound boolean, placed boolean").join(found, "pos", "left").na.fill(0)
    reason = F.when(~F.col("sound"), "invalid").when(F.col("placed"), "place").when(F.lit(n[0] > 0) & (F.col("positive_hits") == 0), "no_positive").when(F.col("negative_hits") > most, "negatives").otherwise("ok")
    return rows.select("pos", "positive_hits", "negative_hits", (reason == "ok").alias("accepted"), reason.alias("reason"))
