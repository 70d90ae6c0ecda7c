"""Token counts of fields or sections by offset-mapped attribution.

A whole document is encoded once. Each token has the span of characters that its bytes belong to (a token that holds part
of a character has that character), and sections are spans of characters too: lines, each with the line end behind it, or
given fields. The interval join of the two is by position, over all documents of a piece at once: both lists are sorted and
a token meets the sections from that of its first character to that of its last. A token that crosses a boundary is
allocated by an explicit rule: `start` (to the section of its first character), `majority` (to the section that holds most
of its characters; ties to the earlier) or `split` (a share to each, by characters).

Null texts read as empty: one section, no tokens. Repeated rows give repeated results, very long texts are one piece each,
and an empty table gives an empty result. Only the id and the named columns are read, so others may have any name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.batches import pieces, texts
from lavra.llm.bpe import PIECE, Replay, default_path, replayer

RULES = ("start", "majority", "split")


def lines(chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, document) of each line of documents that end at `ends`; chars: first bytes of their characters. A line end
    at the very end of a document begins no line, and an empty document has one line."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    after = np.flatnonzero(chars == 10) + 1
    own = np.searchsorted(ends, after - 1, side="right")
    inside = after < ends[own]
    starts, docs = np.concatenate((begins, after[inside])), np.concatenate((np.arange(len(ends)), own[inside]))
    order = np.lexsort((starts, docs))
    return starts[order], docs[order]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, whether each token crosses a boundary); first, last: the first and last character of each
    token, in order; starts: where each section begins, in order, the first at 0."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    low, high = (np.searchsorted(starts, x, side="right") - 1 for x in (first, last))
    crossing = high > low
    if rule == "start":
        return np.bincount(low, minlength=len(starts)), crossing
    out = np.bincount(low[~crossing], minlength=len(starts))
    out = out.astype(float) if rule == "split" else out
    for k in np.flatnonzero(crossing).tolist():
        own = np.arange(low[k], high[k] + 1)
        part = np.minimum(np.append(starts[own[1:]], last[k] + 1), last[k] + 1) - np.maximum(starts[own], first[k])
        if rule == "split":
            out[own] += part / (last[k] + 1 - first[k])
        else:
            out[own[np.argmax(part)]] += 1
    return out, crossing


def attribute(tool: Replay, many: list[str], rule: str, cuts: list[list[int]] | None = None) -> tuple[np.ndarray, ...]:
    """For all texts at once: (tokens of each text, tokens that cross a boundary in it; for each section its text, start, end
    and tokens). `cuts`: for each text where its sections begin, the first at 0; without them sections are lines."""
    ids, bounds = tool.encode_all(many)
    sizes = tool.sizes[ids]
    data = np.frombuffer("".join(many).encode(), np.uint8)
    lead = (data & 0xC0) != 0x80
    place = np.cumsum(lead) - 1  # the character of each byte
    past = np.cumsum(sizes)
    first, last = place[past - sizes], place[past - 1]
    ends = np.cumsum(np.fromiter(map(len, many), np.int64, len(many)))
    if cuts is None:
        starts, docs = lines(data[lead], ends)
    else:
        docs = np.repeat(np.arange(len(many)), [len(c) for c in cuts])
        starts = np.concatenate([*map(np.array, cuts), np.empty(0)]).astype(np.int64) + np.concatenate(([0], ends[:-1]))[docs]
    got, crossing = allocate(first, last, starts, rule) if len(starts) else (np.empty(0, np.int64), np.empty(0, bool))
    crossed = np.diff(np.concatenate(([0], np.cumsum(crossing)))[bounds])
    base = np.concatenate(([0], ends[:-1]))[docs]
    stops = np.append(starts[1:], ends[-1] if len(ends) else 0)
    stops = np.where(np.append(docs[1:], -1) == docs, stops, ends[docs])
    return np.diff(bounds), crossed, docs, starts - base, stops - base, got


def _fields(piece: pa.RecordBatch, names: list[str]) -> tuple[list[str], list[list[int]]]:
    """The texts of the fields, line ends between, as one document each, and where each field begins."""
    columns = [texts(piece, n) for n in names]
    cuts = [np.cumsum([0, *(len(x) + 1 for x in row[:-1])]).tolist() for row in zip(*columns)]
    return ["\n".join(row) for row in zip(*columns)], cuts


def _run(batches, rule: str, path: str | None, fields: list[str] | None, text: str) -> Iterator:
    tool = replayer(path or default_path())
    for piece in pieces(batches, text, PIECE):
        many, cuts = _fields(piece, fields) if fields else (texts(piece, text), None)
        yield piece, attribute(tool, many, rule, cuts)


def _picked(docs: DataFrame, id_col: str, text_col: str, fields: list[str] | None) -> tuple[DataFrame, list[str] | None, str]:
    """The id and the columns to be read, under names that don't clash."""
    names = fields or [text_col]
    own = [f"field_{i}" for i in range(len(names))]
    picked = docs.select(F.col(id_col).alias("id"), *(F.col(f"`{n}`").cast("string").alias(o) for n, o in zip(names, own)))
    return picked, own if fields else None, own[-1]


def counts(docs: DataFrame, rule: str = "majority", path: str | None = None, id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens): tokens of the whole text and of each of its sections, comma-joined
    in order. Sections are lines of `text_col`, or `fields` (columns, encoded as one document)."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked, own, text = _picked(docs, id_col, text_col, fields)

    def run(batches):
        for piece, (n, crossed, of, _, _, got) in _run(batches, rule, path, own, text):
            said = list(map(repr if rule == "split" else str, got.tolist()))
            bounds = np.searchsorted(of, np.arange(piece.num_rows + 1)).tolist()
            columns = [n, np.diff(bounds), crossed, [",".join(said[a:b]) for a, b in zip(bounds, bounds[1:])]]
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()]))], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens string")


def sections(docs: DataFrame, rule: str = "majority", path: str | None = None, id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens): one row a section, its place in the document in characters, end exclusive.
    n_tokens is a double, whole but for the rule `split`."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked, own, text = _picked(docs, id_col, text_col, fields)

    def run(batches):
        for piece, (_, _, of, starts, stops, got) in _run(batches, rule, path, own, text):
            number = np.arange(len(of)) - np.searchsorted(of, of)
            columns = [pa.array(number), pa.array(starts), pa.array(stops), pa.array(got.astype(float))]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(of)), *columns], ["doc_id", "section", "start", "end", "n_tokens"])

    return picked.mapInArrow(run, f"doc_id {kind}, section long, start long, end long, n_tokens double")
