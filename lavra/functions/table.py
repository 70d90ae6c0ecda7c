"""Table functions for SQL: rows made from one text, and rules made from a table of reviews."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import StructType

from lavra.functions.text import RESIDUAL_STOP, folded

# What no phrase begins with.
NOT_FIRST = ("policia federal", "operacao")
RUNS = [re.compile(rf"\b[a-z0-9]{{4,}}(?:\s+[a-z0-9]{{2,}}){{{n - 1}}}\b") for n in (6, 5, 4, 3, 2)]


@udtf(returnType="n int, phrase string, pattern string")
class ResidualRules:
    """The first three evidence phrases of a text, each with the pattern that it makes."""

    def eval(self, text: str):
        for n, (phrase, words) in enumerate(telling(text), 1):
            if n > 3:
                return
            yield n, phrase, gapped(words)


def telling(text: str | None):
    """(phrase, its telling words) of the runs of words of a text that hold two of them."""
    said = folded(text or "")
    found = dict.fromkeys(m[0] for run in RUNS for m in run.finditer(said) if not m[0].startswith(NOT_FIRST))
    each = ((p, [w for w in re.findall("[a-z0-9]{4,}", p) if w not in RESIDUAL_STOP]) for p in found)
    return ((p, w) for p, w in each if len(w) >= 2)


def gapped(words: list[str]) -> str:
    return ".{0,80}".join(rf"\b{w}\w*\b" for w in words[:5])


NEEDED = {"batch_id", "side", "doc_id", "label", "title", "text", "evidence", "summary", "pattern"}
NEGATIVES = 1000  # of a batch that are held; more are an error


@udtf
class CheckedRules:
    """Rules out of a table of reviews and negatives (`NEEDED`), each with what the checks say of it. `side` is 'negative' or 'review';
    the negatives of a batch come first and are held, reviews go by one after the other. A review brings the pattern that it has,
    else its label's fixed ones, else up to three of its evidence with one of its label's keywords. The options are a JSON object:
    `required`, `fixed` and `keywords` by label, `domain`, `places`, `noisy` and `stop` as lists of words."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, options: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if lacking := NEEDED - set(rows.dataType.names):
            raise ValueError(f"columns are missing: {', '.join(sorted(lacking))}")
        if not options.isConstantExpression or not isinstance(json.loads(options.value or "{}"), dict):
            raise ValueError("the options are a JSON object")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        schema = StructType().add("batch_id", kinds["batch_id"]).add("doc_id", kinds["doc_id"]).add("label", "string").add("pattern", "string").add("accepted", "boolean").add("reason", "string")
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("batch_id")], orderBy=[OrderingColumn("side"), OrderingColumn("doc_id")])

    def __init__(self):
        self.negatives, self.known = [], {}

    def eval(self, rows, options):
        if rows["side"] == "negative":
            if len(self.negatives) == NEGATIVES:
                raise ValueError(f"a batch has more than {NEGATIVES} negatives")
            self.negatives.append(folded(rows["text"] or ""))
            return
        given = json.loads(options or "{}")
        text = folded(rows["text"] or "")
        for pattern in self._brought(rows, given):
            reason = self._anchor(rows["label"], pattern, given) or self._gate(pattern) or self._hits(pattern, text)
            yield rows["batch_id"], rows["doc_id"], rows["label"], pattern, reason is None, reason or "ok"

    def _brought(self, row, given: dict) -> list[str]:
        if row["pattern"]:
            return [row["pattern"]]
        if row["label"] in given.get("fixed", {}):
            return given["fixed"][row["label"]]
        keywords = given.get("keywords", {}).get(row["label"])
        said = " | ".join(x for x in (row["evidence"], row["summary"], row["title"]) if x)
        fits = [words for _, words in telling(said) if keywords is None or set(words) & set(keywords)]
        return list(dict.fromkeys(map(gapped, fits)))[:3]

    def _anchor(self, label: str, pattern: str, given: dict) -> str | None:
        """Required words of the label: one at least, and two, or two of the field that outnumber noisy ones."""
        words = [w for w in re.findall(r"\\b([a-z0-9]{3,})", pattern) if w not in given.get("stop", ())]
        required = given.get("required", {}).get(label) or [w for w in label.split("_") if len(w) >= 4 and w not in ("crime", "crimes")]
        must, places = set(words) & set(required), set(given.get("places", ()))
        field, noisy = must | set(words) & set(given.get("domain", ())), set(words) & (places | set(given.get("noisy", ())) | set(given.get("stop", ())))
        good = len(words) >= 2 and not set(words) <= places and must and (len(must) >= 2 or len(field) >= 2 and len(noisy) < len(field))
        return None if good else "no_anchor"

    def _gate(self, pattern: str) -> str | None:
        """Two telling words, none numeric or bad, and a pattern that compiles."""
        from lavra.operators.rules import BAD, STOP

        words = re.findall(r"\\b([a-z0-9]{3,})", pattern.lower())
        if any(w.isdigit() or w in BAD for w in words) or sum(w not in STOP for w in words) < 2:
            return "invalid"
        try:
            self.known.setdefault(pattern, re.compile(pattern, re.IGNORECASE))
        except re.error:
            return "invalid"
        return None

    def _hits(self, pattern: str, text: str) -> str | None:
        form = self.known[pattern]
        if not form.search(text):
            return "no_positive"
        return "negatives" if sum(bool(form.search(t)) for t in self.negatives) > max(2, int(0.15 * len(self.negatives))) else None


def register(spark: SparkSession) -> None:
    """`residual_rules(text)` for LATERAL joins in SQL, and `checked_rules(TABLE(...), options)`."""
    spark.udtf.register("residual_rules", ResidualRules)
    spark.udtf.register("checked_rules", CheckedRules)
