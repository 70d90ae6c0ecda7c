"""Learning rules from residuals: phrases and terms of a text, patterns built from them, checks of patterns, label maps and known keys.

Word lists of a field (`required` words of each label, places, generic words) are parameters; where a label has no required
words its own name's count."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import RESIDUAL_STOP, canonical, domain_sentences, domain_terms, fold, informative_tags, let, ngrams, phrase_of, slug, squeeze, token_slug, tokens
from lavra.operators import rules as R
from lavra.runtime import materialise

NONE = "array<string>"


def _anchored(words: Column) -> Column:
    return F.transform(words, lambda t: F.concat(F.lit(r"\b"), t, F.lit(r"\w*\b")))


def phrase_pattern(words: Column) -> Column:
    """The words in order, anything but word characters between."""
    return F.array_join(_anchored(words), r"\W+")


def term_pattern(words: Column) -> Column:
    """The words in order, white space between."""
    return F.array_join(_anchored(words), r"\s+")


def gap_pattern(words: Column, gap: int = 90) -> Column:
    """The words in order, at most `gap` characters between."""
    return F.array_join(_anchored(words), f".{{0,{gap}}}")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def _parts(folded: Column, at: str = "[.!?;\\n]+") -> Column:
    return F.filter(F.transform(F.split(folded, at), _strip), lambda s: s != "")


def _words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[a-z0-9_]+"), F.lit(0))


def _begins(words: Column, term: Column) -> Column:
    return F.exists(words, lambda w: w.startswith(term))


def label_terms(label: Column, stop: tuple[str, ...] = R.STOP) -> Column:
    """The words of a label's slug of four or more."""
    return F.filter(F.split(canonical(label), "_"), lambda t: (F.length(t) >= 4) & ~t.isin(*stop))


def evidence_window(text: Column, label: Column, most: int = 600) -> Column:
    """The first sentence with a word that begins with one of the label's, else the head of the folded text."""
    terms = label_terms(label)
    any_of = F.when(F.size(terms) > 0, F.concat(F.lit("\\b(?:"), F.array_join(terms, "|"), F.lit(")")))  # the terms are letters and digits

    def window(folded: Column) -> Column:
        held = F.filter(_parts(folded), lambda s: F.rlike(s, any_of))
        return F.substring(F.coalesce(F.get(held, F.lit(0)), folded), 1, most)

    return let(fold(text), window)


def label_evidence(label: Column, folded: Column) -> Column:
    """The label's words, or their first eight letters, that a word of the folded text begins with."""
    def found(words: Column) -> Column:
        each = F.transform(label_terms(label, (*R.STOP, *R.BAD)), lambda t: F.when(_begins(words, t), t).when((F.length(t) >= 8) & _begins(words, F.substring(t, 1, 8)), F.substring(t, 1, 8)))
        return F.array_distinct(F.array_compact(each))

    return let(_words(folded), found)


def enough_evidence(label: Column, folded: Column) -> Column:
    """Two of the label's words where it has two or more, else one."""
    least = F.when(F.size(label_terms(label, (*R.STOP, *R.BAD))) >= 2, 2).otherwise(1)
    return F.size(label_evidence(label, folded)) >= least


def candidate_terms(label: Column, folded: Column, limit: int = 4) -> Column:
    """The label's words that the text holds, then its most frequent telling words, earlier ones first; `limit` in all."""
    own = F.regexp_extract_all(folded, F.lit("\\b[a-z0-9]{4,}\\b"), F.lit(0))
    telling = F.filter(own, lambda t: ~t.rlike("^[0-9]+$") & ~t.isin(*R.STOP, *R.BAD))
    ranked = let(telling, lambda ws: F.transform(F.array_sort(F.transform(F.array_distinct(ws), lambda t: F.struct((-F.size(F.filter(ws, lambda x: x == t))).alias("n"), F.call_function("instr", folded, t).alias("at"), t.alias("t")))), lambda s: s["t"]))
    named = let(_words(folded), lambda words: F.array_distinct(F.array_compact(F.transform(label_terms(label), lambda t: F.when(_begins(words, t), t).when((F.length(t) >= 8) & _begins(words, F.substring(t, 1, 8)), F.substring(t, 1, 8))))))
    return F.slice(F.array_distinct(F.concat(named, ranked)), 1, limit)


def learned_pattern(text: Column, label: Column, gap: int = 240) -> Column:
    """The candidate terms of the label's evidence in the order in which the text holds them, with bounded gaps; null without enough
    evidence of the label or with fewer than two terms."""
    return let(evidence_window(text, label), lambda evidence: let(candidate_terms(label, evidence), lambda terms: pattern_of(terms, label, evidence, gap)))


def pattern_of(terms: Column, label: Column, evidence: Column, gap: int = 240) -> Column:
    """`learned_pattern` of candidate terms and the evidence that they are from."""
    at = lambda t: let(F.call_function("instr", evidence, t), lambda p: F.when(p > 0, p).otherwise(F.length(evidence) + 1))
    placed = F.array_sort(F.transform(terms, lambda t, i: F.struct(at(t).alias("at"), i.alias("i"), t.alias("t"))))
    return F.when((F.size(terms) >= 2) & enough_evidence(label, evidence), gap_pattern(F.transform(placed, lambda p: p["t"]), gap))


def meaningful(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Folded words of four or more but stop words."""
    return _telling(fold(c), stop)


def _telling(folded: Column, stop: tuple[str, ...] = ()) -> Column:
    own = F.regexp_extract_all(folded, F.lit("\\b[a-z0-9]{4,}\\b"), F.lit(0))
    return F.filter(own, lambda t: ~t.isin(*stop)) if stop else own


def phrases(text: Column, stop: tuple[str, ...] = (), limit: int = 80, longest: int = 5) -> Column:
    """Distinct candidates: lines of two to eight telling words, then the runs of `longest` to 2 of them in each sentence, longer ones
    first. Runs end where there are `limit` candidates, lines counted; one run is taken in any case."""
    def runs(words: Column) -> Column:
        return F.flatten(F.array(*(ngrams(words, n) for n in range(longest, 1, -1))))

    def found(folded: Column) -> Column:
        lines = F.transform(F.filter(F.transform(F.split(folded, "\\r\\n|\\r|\\n"), lambda s: _telling(s, stop)), lambda w: F.size(w).between(2, 8)), lambda w: F.array_join(w, " "))
        # A sentence of two telling words or more gives a run at least, so the runs of the first `limit` such sentences are enough.
        told = F.slice(F.filter(F.transform(_parts(folded, "[.!?;\\n|:]+"), lambda s: _telling(s, stop)), lambda w: F.size(w) >= 2), 1, limit)
        some = F.flatten(F.transform(told, runs))
        return let(lines, lambda ls: F.array_distinct(F.concat(ls, F.slice(some, 1, F.greatest(F.lit(limit) - F.size(ls), F.lit(1))))))

    return let(fold(text), found)


def residual_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]{4,}"), F.lit(0)), lambda t: ~t.isin(*RESIDUAL_STOP))


def residual_pattern(phrase: Column, gap: int = 80) -> Column:
    """The first five residual tokens with bounded gaps; empty for none."""
    return gap_pattern(F.slice(residual_tokens(phrase), 1, 5), gap)


def evidence_phrases(text: Column, most: int = 10, not_first: tuple[str, ...] = ("policia federal", "operacao")) -> Column:
    """The first distinct runs of six to two words, each size from left to right without overlap, that hold two residual tokens."""
    folded = fold(text)
    sizes = [F.regexp_extract_all(folded, F.lit(rf"\b[a-z0-9]{{4,}}(?:\s+[a-z0-9]{{2,}}){{{n - 1}}}\b"), F.lit(0)) for n in (6, 5, 4, 3, 2)]
    starts = lambda p: functools.reduce(lambda a, b: a | b, (p.startswith(x) for x in not_first))
    return F.slice(F.array_distinct(F.filter(F.concat(*sizes), lambda p: (F.size(residual_tokens(p)) >= 2) & ~starts(p))), 1, most)


def _required(label: Column, required: dict[str, list[str]]) -> Column:
    own = F.filter(F.split(label, "_"), lambda t: (F.length(t) >= 4) & ~t.isin("crime", "crimes"))
    if not required:
        return own
    table = F.create_map(*(x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.element_at(table, label), own)


def pattern_tokens(pattern: Column, stop: tuple[str, ...] = ()) -> Column:
    """The anchors of a pattern, or the telling words of a phrase, but stop words."""
    own = R.anchors(pattern)
    return F.when(F.size(own) > 0, F.filter(own, lambda t: ~t.isin(*stop)) if stop else own).otherwise(meaningful(pattern, stop))


def only_places(words: Column, places: tuple[str, ...]) -> Column:
    return (F.size(words) > 0) & F.forall(words, lambda t: t.isin(*places) if places else F.lit(False))


def domain_candidate(label: Column, pattern: Column, required: dict[str, list[str]], places: tuple[str, ...] = (), stop: tuple[str, ...] = ()) -> Column:
    """Two or more words, not places alone, one of them required for the label."""
    return let(pattern_tokens(pattern, stop), lambda w: (F.size(w) >= 2) & ~only_places(w, places) & (F.size(F.array_intersect(w, _required(label, required))) > 0))


def has_anchor(label: Column, pattern: Column, required: dict[str, list[str]], domain: tuple[str, ...] = (), places: tuple[str, ...] = (), noisy: tuple[str, ...] = (), stop: tuple[str, ...] = ()) -> Column:
    """`domain_candidate`, and two required words, or two words of the field that outnumber noisy ones."""
    def good(w: Column) -> Column:
        must = F.array_intersect(w, _required(label, required))
        count = lambda words: F.size(F.array_intersect(w, F.array(*map(F.lit, words)).cast(NONE)))
        field = F.size(F.array_union(must, F.array_intersect(w, F.array(*map(F.lit, domain)).cast(NONE))))
        return (F.size(w) >= 2) & ~only_places(w, places) & (F.size(must) > 0) & ((F.size(must) >= 2) | (field >= 2) & (count((*places, *noisy, *stop)) < field))

    return let(pattern_tokens(pattern, stop), good)


def domain_text(text: Column, terms: list[str], tags: Column, anchors: list[str], stems: dict[str, str] | None = None, stop: list[str] | None = None, fallback: str = "tema_criminal_indefinido ") -> Column:
    """The slugs of the terms that the text holds eight times, of telling tags four times, then the telling words of the first four
    sentences with an anchor; without any of these a fixed word and the head of the telling words."""
    stems, stop = stems or {}, stop or [""]
    told = F.transform(informative_tags(tags, terms, stems, anchors, stop), token_slug)

    def made(folded: Column) -> Column:
        held = F.transform(domain_terms(folded, terms, stems), token_slug)
        parts = F.concat(F.flatten(F.array_repeat(held, 8)), F.flatten(F.array_repeat(told, 4)), domain_sentences(folded, anchors, stop, 4))
        clean = F.array_join(F.filter(tokens(folded), lambda t: ~t.isin(*stop) & ~t.rlike("^[0-9]+[a-z]*$")), " ")
        return let(parts, lambda ps: F.when(F.size(ps) > 0, F.array_join(ps, " ")).otherwise(F.concat(F.lit(fallback), F.substring(clean, 1, 1200))))

    return let(fold(text), made)


def pair_candidates(themes: DataFrame, label: str, anchors: str, words: str, each: int = 8, gap: int = 90) -> DataFrame:
    """(label, pattern): both orders of each of the first `each` anchors with each of the first `each` other words."""
    a = themes.select(F.col(label).alias("label"), F.explode(F.slice(F.array_distinct(anchors), 1, each)).alias("a"), F.slice(F.array_distinct(words), 1, each).alias("w"))
    pairs = a.select("label", "a", F.explode("w").alias("b")).where("a <> b")
    both = pairs.select("label", F.explode(F.array(F.array("a", "b"), F.array("b", "a"))).alias("pair"))
    return both.select("label", gap_pattern(F.col("pair"), gap).alias("pattern")).distinct()


def rule_candidates(themes: DataFrame, preferred: dict[str, list[str]], required: dict[str, list[str]], places: tuple[str, ...] = (), stop: tuple[str, ...] = (), target: int | None = None, each: int = 8) -> DataFrame:
    """(label, pos, pattern) of themes (label, terms): patterns of the preferred and given terms that are candidates, then both orders of
    each of the first anchors with each word of a term; distinct, with two anchors or more, the first 4 x `target` of a label if given."""
    table = F.create_map(*(x for k, v in (preferred or {"": [""]}).items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast(NONE))))
    first = F.coalesce(F.element_at(table, F.col("label")), F.array().cast(NONE))
    every = F.array_distinct(F.filter(F.transform(F.concat(first, "terms"), lambda t: squeeze(fold(t))), lambda t: t != ""))
    rows = themes.select("label", F.filter(every, lambda t: domain_candidate(F.col("label"), t, required, places, stop)).alias("t"), first.alias("p"))
    own = F.flatten(F.transform(F.when(F.size("p") > 0, F.col("p")).otherwise(F.array(F.replace("label", F.lit("_"), F.lit(" ")))), lambda t: meaningful(t, stop)))
    rows = rows.withColumn("a", F.slice(own, 1, each))
    whole = F.transform(F.filter(F.transform("t", lambda t: meaningful(t, stop)), lambda w: F.size(w) >= 2), term_pattern)
    couple = lambda a, b: F.when(a != b, gap_pattern(F.array(a, b)))
    near = F.flatten(F.flatten(F.transform("t", lambda t: F.transform("a", lambda a: F.flatten(F.transform(F.slice(meaningful(t, stop), 1, each), lambda w: F.array(couple(a, w), couple(w, a))))))))
    out = rows.select("label", F.posexplode(F.array_distinct(F.array_compact(F.concat(whole, near)))).alias("pos", "pattern")).where(F.size(R.anchors(F.col("pattern"))) >= 2)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("pos"))
    out = out.withColumn("pos", rank)
    return out if target is None else out.where(F.col("pos") <= 4 * target)


def fallback_rules(themes: DataFrame, preferred: dict[str, list[str]], required: dict[str, list[str]], places: tuple[str, ...] = (), stop: tuple[str, ...] = (), most: int = 8) -> DataFrame:
    """(label, pattern): patterns of the first `most` candidate terms of each theme (label, terms) with two words or more."""
    table = F.create_map(*(x for k, v in (preferred or {"": [""]}).items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast(NONE))))
    every = F.array_distinct(F.transform(F.concat(F.coalesce(F.element_at(table, F.col("label")), F.array().cast(NONE)), "terms"), lambda t: squeeze(fold(t))))
    some = F.slice(F.filter(every, lambda t: domain_candidate(F.col("label"), t, required, places, stop)), 1, most)
    return themes.select("label", F.explode(F.filter(F.transform(some, lambda t: term_pattern(meaningful(t, stop))), lambda p: p != "")).alias("pattern"))


def initial_rules(docs: DataFrame, themes: DataFrame, preferred: dict[str, list[str]], required: dict[str, list[str]], places: tuple[str, ...] = (), stop: tuple[str, ...] = (), target: int | None = None, positives: int = 20, negatives: int = 50) -> DataFrame:
    """(label, pattern, positive_hits, negative_hits, accepted) of the candidates of themes (label, cluster_ids, terms), checked on docs
    (doc_id, pos, cluster_id, text): the first `positives` of each cluster, only those with a preferred term if there are any, and the first
    `negatives` of all that aren't among them. A rule is accepted as in `rules.validate`."""
    first = docs.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos"))).where(F.col("_r") <= positives)
    of = themes.select("label", F.explode("cluster_ids").alias("cluster_id"))
    mine = first.join(of, "cluster_id").select("label", "doc_id", fold(F.col("text")).alias("t"))
    leaf = F.lit(False)
    for label, terms in preferred.items():
        leaf = leaf | (F.col("label") == label) & functools.reduce(lambda a, b: a | b, (F.col("t").rlike(phrase_of(x, r"\b\s+\b", 4)) for x in terms if phrase_of(x, r"\b\s+\b", 4)), F.lit(False))
    known = F.col("label").isin(*preferred) if preferred else F.lit(False)
    mine = mine.withColumn("leaf", leaf | ~known)
    leafy = mine.groupBy("label").agg(F.max("leaf").alias("any"))
    mine = mine.join(leafy, "label").where("leaf or not any").select("label", "doc_id")
    few = docs.orderBy("pos").limit(negatives).select("doc_id")
    others = themes.select("label").join(few).join(mine, ["label", "doc_id"], "left_anti")  # `negatives` rows a theme
    sides = mine.withColumn("side", F.lit(1)).union(others.withColumn("side", F.lit(0)))
    found = rule_candidates(themes, preferred, required, places, stop, target)
    numbered = found.withColumn("n", F.row_number().over(Window.orderBy("label", "pos")).cast("int"))  # a row a candidate
    rows = [("crime", r["label"], r["pattern"], R.WEIGHT, "initial", 1, [], r["n"]) for r in numbered.collect()]  # a bank
    used = docs.join(sides.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = R.match(used, rows).select("doc_id", "pos", "label").join(sides, ["doc_id", "label"])
    count = hits.groupBy("pos").agg(F.count_if(F.col("side") == 1).alias("positive_hits"), F.count_if(F.col("side") == 0).alias("negative_hits"))
    sizes = sides.groupBy("label").agg(F.count_if(F.col("side") == 1).alias("p"), F.count_if(F.col("side") == 0).alias("q"))
    out = numbered.join(count.withColumnRenamed("pos", "n"), "n", "left").join(sizes, "label", "left").na.fill(0, ["positive_hits", "negative_hits", "p", "q"])
    good = ((F.col("p") == 0) | (F.col("positive_hits") > 0)) & (F.col("negative_hits") <= F.greatest(F.lit(2), F.floor(0.15 * F.col("q"))))
    return out.select("label", "pattern", "positive_hits", "negative_hits", good.alias("accepted"))


def suggestions(reviews: DataFrame, fixed: dict[str, list[str]] | None = None, keywords: dict[str, list[str]] | None = None, most: int = 3) -> DataFrame:
    """(doc_id, label, pattern) for reviews (doc_id, label, title, text, evidence, summary): the learned pattern of the text; without one the
    label's fixed patterns; without these up to `most` patterns of evidence phrases with one of the label's keywords, if it has any."""
    table = lambda d: F.create_map(*(x for k, v in (d or {"": [""]}).items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    words = F.element_at(table(keywords), F.col("label"))
    said = F.array_join(F.filter(F.array("evidence", "summary", "title"), lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    fitting = F.filter(evidence_phrases(said), lambda p: words.isNull() | (F.size(F.array_intersect(residual_tokens(p), words)) > 0))
    made = F.slice(F.array_distinct(F.filter(F.transform(fitting, lambda p: residual_pattern(p)), lambda p: p != "")), 1, most)
    own = learned_pattern(F.col("text"), F.col("label"))
    return reviews.select("doc_id", "label", F.explode(F.coalesce(F.when(own.isNotNull(), F.array(own)), F.element_at(table(fixed), F.col("label")), made)).alias("pattern"))


def learned_rules(reviews: DataFrame, negatives: DataFrame, required: dict[str, list[str]], domain: tuple[str, ...] = (), places: tuple[str, ...] = (), noisy: tuple[str, ...] = (), stop: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, label, pattern, title, accepted, reason) of the suggestions of reviews, each checked for its anchors, on its own text and on
    the negatives (doc_id, text), of which it may match max(2, 15%). The patterns that a batch suggests go to the negatives as a
    bank does, so that both checks read a pattern as a rule is read."""
    spark = reviews.sparkSession
    found = suggestions(reviews, **options).withColumn("anchored", has_anchor(F.col("label"), F.col("pattern"), required, domain, places, noisy, stop))
    rows = found.join(reviews.select("doc_id", "title", fold(F.col("text")).alias("t")), "doc_id")
    rows = materialise(R.holds_pattern(rows, "pattern", "t", "own").drop("t"), "suggested")
    patterns = sorted(r["pattern"] for r in rows.where("anchored and own").select("pattern").distinct().collect())  # what one batch suggests
    bank = [("crime", "", p, R.WEIGHT, "suggested", 1, [], i) for i, p in enumerate(patterns)]
    hits = R.match(negatives, bank).groupBy("pos").agg(F.count("*").alias("hits"))
    named = spark.createDataFrame(list(enumerate(patterns)), "pos int, pattern string").join(hits, "pos").select("pattern", "hits")
    rows = rows.join(named, "pattern", "left")
    most = max(2, int(0.15 * negatives.count()))
    reason = F.when(~F.col("anchored"), "no_anchor").when(~F.col("own"), "no_positive").when(F.col("hits") > most, "negatives").otherwise("ok")
    return rows.select("doc_id", "label", "pattern", "title", (reason == "ok").alias("accepted"), reason.alias("reason"))


def canonical_labels(labels: DataFrame, allowed: list[str], least: int = 4) -> DataFrame:
    """(label, canonical): the allowed label of the same slug (the last of such), else the first allowed one (in the given order) that
    shares a word of `least` characters or more, else null."""
    spark = labels.sparkSession
    known = spark.createDataFrame(list(enumerate(allowed)), "pos int, canonical string").withColumn("s", slug(F.col("canonical")))
    words = lambda c: F.array_distinct(F.filter(F.split(c, "_"), lambda t: F.length(t) >= least))
    own = labels.select("label").distinct().withColumn("s", slug(F.col("label")))
    by_name = own.join(F.broadcast(known.groupBy("s").agg(F.max_by("canonical", "pos").alias("same"))), "s", "left")
    shared = own.select("label", F.explode(words(F.col("s"))).alias("t")).join(F.broadcast(known.select("pos", "canonical", F.explode(words(F.lower("canonical"))).alias("t"))), "t")
    near = shared.groupBy("label").agg(F.min_by("canonical", "pos").alias("near"))
    return by_name.join(near, "label", "left").select("label", F.coalesce("same", "near").alias("canonical"))


def theme_map(themes: DataFrame, theme: str, ids: str) -> DataFrame:
    """(cluster_id, themes): the themes of each cluster that they list, sorted; a cluster may have several."""
    each = themes.select(F.col(theme).alias("theme"), F.explode(ids).alias("cluster_id"))
    return each.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("theme")), ", ").alias("themes"))


def active_themes(themes: DataFrame, bank: DataFrame, rare: str = "noticias_raras", shown: int = 8) -> DataFrame:
    """(label, n_rules, sample): accepted themes with the number of their rules and the first patterns; `rare` always stands among them."""
    counts = bank.groupBy("label").agg(F.count("*").alias("n_rules"))
    first = bank.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("pos"))).where(F.col("_r") <= shown)
    held = first.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("_r", "pattern"))).alias("p"))
    names = themes.where("decision = 'accept'").select("label").union(themes.sparkSession.createDataFrame([(rare,)], "label string")).distinct()
    rows = names.join(counts, "label", "left").join(held, "label", "left")
    return rows.select("label", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.coalesce(F.array_join(F.transform("p", lambda x: x["pattern"]), " || "), F.lit("")).alias("sample"))


def title_key(title: Column) -> Column:
    return F.coalesce(squeeze(fold(title)), F.lit(""))


def key(title: Column, date: Column) -> Column:
    """`title|date` of the folded, squeezed values; empty where either is."""
    name, day = title_key(title), title_key(date)
    return F.when((name == "") | (day == ""), "").otherwise(F.concat(name, F.lit("|"), day))


def missing(rows: DataFrame, known: DataFrame, title: str, date: str) -> DataFrame:
    """Rows that `known` doesn't hold: by title and date, and by the title alone only where a row has no date."""
    marked = rows.withColumns({"_k": key(F.col(title), F.col(date)), "_t": title_key(F.col(title))})
    keys = known.select(key(F.col(title), F.col(date)).alias("_k")).where("_k <> ''").distinct()
    titles = known.select(title_key(F.col(title)).alias("_t")).where("_t <> ''").distinct()
    out = marked.where("_k <> ''").join(keys, "_k", "left_anti").select(*rows.columns)
    return out.unionByName(marked.where("_k = ''").join(titles, "_t", "left_anti").select(*rows.columns))


def unwrapped(payload: Column, wrappers: list[str], levels: int = 3) -> Column:
    """A JSON object out of up to `levels` wrapper keys."""
    for _ in range(levels):
        payload = F.coalesce(*(F.get_json_object(payload, f"$.{w}") for w in wrappers), payload)
    return payload
