"""A chain of providers that answer prompts, run where the rows are.

A partition has one session a provider, made when it is first asked. Providers are asked in order, and each of a provider's
models; a fault that may pass is tried again a bounded number of times, with a longer wait each time. An answer counts where it
holds a JSON object that the caller accepts. A provider that is out of its rate may name another one that is then asked with
more patience. A prompt that nobody answers gives a row that says so, with every fault on the way, and never ends the job.
Tokens are read from the answers under any of their spellings and are columns of the row.

Null prompts are asked as empty ones. Rows are asked one by one, in order; repeated rows are asked again."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The spellings of token counts in answers.
PROMPT, COMPLETION, TOTAL = ("prompt_tokens", "prompt_eval_count"), ("completion_tokens", "eval_count"), ("total_tokens",)
OBJECT = re.compile(r"\{.*\}", re.DOTALL)
COLUMNS = "answer string, provider string, model string, prompt_tokens long, completion_tokens long, total_tokens long, attempts int, faults array<struct<provider: string, model: string, error: string>>, error string"


class Passing(Exception):
    """A fault that may pass: the same model is asked again."""


class Limited(Exception):
    """A provider is out of its rate."""


@dataclass(frozen=True)
class Provider:
    """`ask` takes (session, model, prompt, timeout) and returns (text, usage)."""

    name: str
    ask: Callable[[Any, str, str, float], tuple[str, dict]]
    models: tuple[str, ...] = ("",)
    connect: Callable[[], Any] = lambda: None
    timeout: float = 60.0
    retries: int = 2
    wait: float = 0.5
    when_limited: str | None = None  # the provider that is asked then
    patience: float = 300.0  # its timeout at least


def _count(usage: dict, names: tuple[str, ...]) -> int:
    return next((int(usage[n]) for n in names if usage.get(n)), 0)


def tokens(usage: dict) -> tuple[int, int, int]:
    """(prompt, completion, total); the total is their sum where it isn't told."""
    prompt, completion = _count(usage, PROMPT), _count(usage, COMPLETION)
    return prompt, completion, _count(usage, TOTAL) or prompt + completion


def object_in(text: str) -> str:
    """The outermost JSON object of an answer."""
    found = OBJECT.search(text or "")
    if not found:
        raise ValueError(f"no JSON: {(text or '')[:300]}")
    json.loads(found[0])
    return found[0]


class Chain:
    """The sessions of one partition."""

    def __init__(self, providers: list[Provider], accept: Callable[[dict], bool] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.accept, self.sleep = providers, accept, sleep
        self.by, self.sessions = {p.name: p for p in providers}, {}

    def _session(self, provider: Provider):
        if provider.name not in self.sessions:
            self.sessions[provider.name] = provider.connect()
        return self.sessions[provider.name]

    def _one(self, provider: Provider, prompt: str, timeout: float, faults: list) -> tuple | None:
        """The first answer of a provider's models."""
        for model in provider.models:
            for again in range(provider.retries + 1):
                self.attempts += 1
                try:
                    text, usage = provider.ask(self._session(provider), model, prompt, timeout)
                    said = object_in(text)
                    if self.accept and not self.accept(json.loads(said)):
                        raise ValueError(f"not accepted: {said[:300]}")
                    return said, provider.name, model, *tokens(usage or {})
                except Passing as fault:
                    faults.append((provider.name, model, str(fault)))
                    if again < provider.retries:
                        self.sleep(provider.wait * 2**again)
                except Limited:
                    raise
                except Exception as fault:  # a provider is an outside service: any fault of it is kept, and the next one is asked
                    faults.append((provider.name, model, f"{type(fault).__name__}: {fault}"))
                    break
        return None

    def answer(self, prompt: str) -> tuple:
        """A row of `COLUMNS`."""
        faults, self.attempts = [], 0
        for provider in self.providers:
            try:
                found = self._one(provider, prompt, provider.timeout, faults)
            except Limited as fault:
                faults.append((provider.name, "", f"limited: {fault}"))
                other, found = self.by.get(provider.when_limited), None
                if other:
                    try:
                        found = self._one(other, prompt, max(other.timeout, provider.patience), faults)
                    except Limited as again:
                        faults.append((other.name, "", f"limited: {again}"))
            if found:
                return *found, self.attempts, faults, None
        return None, None, None, 0, 0, 0, self.attempts, faults, "no provider answered" + (f": {faults[-1][2]}" if faults else "")


def answered(rows: DataFrame, providers: list[Provider], prompt: str = "prompt", accept: Callable[[dict], bool] | None = None) -> DataFrame:
    """All columns of `rows` and those of `COLUMNS`, which replace columns of the same names."""
    added = T._parse_datatype_string(COLUMNS)
    kept = rows.drop(*(f.name for f in added.fields if f.name != prompt))
    place = kept.columns.index(prompt)
    fault = pa.list_(pa.struct([("provider", pa.string()), ("model", pa.string()), ("error", pa.string())]))
    kinds = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.int32(), fault, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]):
        chain = Chain(providers, accept)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # what was answered goes on before the next prompts are asked
                some = batch.slice(at, 64)
                got = [chain.answer(p or "") for p in some.column(place).to_pylist()]
                faults = [[{"provider": a, "model": b, "error": c} for a, b, c in g[7]] for g in got]
                columns = [[g[i] for g in got] if i != 7 else faults for i in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*some.schema.names, *added.names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added.fields]))
