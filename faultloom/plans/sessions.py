"""Sessions with a language model: an injected client, prompts, rule generation and evidence rounds.

The library talks to no service itself: a client is anything with ``complete(prompt) -> str``.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultloom.functions import text
from faultloom.operators import graph, tokens
from faultloom.sources.shared import cut


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


REGISTRY: dict[str, Callable[[], Client]] = {}


def register(part: str, make: Callable[[], Client]) -> None:
    REGISTRY[part] = make


def client_for(model: str) -> Client:
    """The client registered under a part of the model's name."""
    for part, make in REGISTRY.items():
        if part in model.lower():
            return make()
    raise ValueError(f"no client for {model!r}")


class Retrying:
    """A client that asks again after errors, and counts calls and characters."""

    def __init__(self, inner: Client, tries: int = 3, limit: int = 16_000):
        self.inner, self.tries, self.limit = inner, tries, limit
        self.calls = self.sent = self.received = 0

    def complete(self, prompt: str) -> str:
        error: Exception | None = None
        for _ in range(self.tries):
            try:
                self.calls += 1
                answer = self.inner.complete(prompt[: self.limit])
                self.sent, self.received = self.sent + len(prompt[: self.limit]), self.received + len(answer)
                return answer
            except Exception as e:  # noqa: BLE001 - any failure of the client counts as one try
                error = e
        raise RuntimeError("the client failed") from error


def rule_prompt(head: str, examples: list[str], relations: list[str]) -> str:
    return "\n".join(["Rules lead from X0 to the last variable over relations with non-decreasing times.", f"Head: {head}", "Relations: " + ", ".join(relations), "Examples:", *examples, "Further rules:"])


def generate_rules(heads: DataFrame, make_client: Callable[[], Client], relations: list[str]) -> DataFrame:
    """(head, rule): the client's lines for each head (head, examples array); one client a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            rows = [(h, line) for h, ex in zip(b["head"], b["examples"], strict=True) for line in client.complete(rule_prompt(h, list(ex), relations)).splitlines() if line.strip()]
            yield pd.DataFrame(rows, columns=["head", "rule"])

    return heads.repartition("head").mapInPandas(run, "head string, rule string")


def clean_rules(rules: DataFrame, relations: list[str], cutoff: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): numbering goes, relation names become the closest known ones, and rules that are
    no chain with non-decreasing times are rejected; each kept rule once."""
    known = list(relations)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda rule: _with_known_names(rule, known, cutoff))

    bare = rules.withColumn("rule", F.regexp_replace("rule", r"^\s*\d+[.)]\s*", "")).filter(F.col("rule").rlike(r"\(X\d+,"))
    fixed = bare.withColumn("fixed", F.pandas_udf(run, "string")("rule"))
    fixed = fixed.withColumn("ok", F.col("fixed").isNotNull() & text.is_chain(F.col("fixed")))
    return fixed.filter("ok").select("head", F.col("fixed").alias("rule")).dropDuplicates(), fixed.filter(~F.col("ok")).select("head", "rule")


def rule_stage(rules: DataFrame, relations: list[str], cutoff: float = 0.6) -> DataFrame:
    """(head, rule, fixed, status, reason): every line of a stage with what became of it, one table for both.

    ``kept`` (the first of equal ones), ``repeated``, or ``rejected`` because it is ``no rule``, names an ``unknown relation`` or is
    ``no chain``. Kept rules are ``fixed``, with known relations and without numbering.
    """
    known = list(relations)

    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda rule: _with_known_names(rule, known, cutoff))

    bare = rules.select("head", "rule", F.regexp_replace("rule", r"^\s*\d+[.)]\s*", "").alias("bare"))
    named = bare.withColumn("fixed", F.pandas_udf(fix, "string")("bare"))
    reason = F.when(~F.coalesce(F.col("bare").rlike(r"\(X\d+,"), F.lit(False)), "no rule").when(F.col("fixed").isNull(), "unknown relation").when(~F.coalesce(text.is_chain(F.col("fixed")), F.lit(False)), "no chain")
    told = cut(named.withColumn("reason", reason), "rule-stage")
    place = F.row_number().over(Window.partitionBy("head", "fixed", "reason").orderBy("rule"))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("place") > 1, "repeated").otherwise("kept")
    return told.withColumn("place", place).select("head", "rule", "fixed", status.alias("status"), "reason")


def _with_known_names(rule: str | None, known: list[str], cutoff: float) -> str | None:
    """The rule with each relation's closest known name; None if one has none."""
    missing = False

    def name(m: re.Match) -> str:
        nonlocal missing
        close = difflib.get_close_matches(m[1].strip(), known, 1, cutoff)
        missing |= not close
        return (close[0] if close else m[1]) + "("

    fixed = re.sub(r"([^()&<\-\s][^()&<]*?)\((?=X\d)", name, rule or "")
    return None if missing else fixed


def summary_prompt(head: str, k: int) -> str:
    wanted = f"the {k} most important" if k else "as many of the most important as possible"
    return f'Of these rules for the head "{head}(X,Y,T)" name {wanted}. Put rules of like meaning together as one. Answer with rules only.'


def summaries(rules: DataFrame, make_client: Callable[[], Client], limit: int, k: int = 0, counter: Callable[[pd.Series], pd.Series] | None = None, max_levels: int = 8) -> DataFrame:
    """(head, rule, level): rule sets (head, rule) of any size, summed up by the client in a tree.

    Each level deals the rules of a head to prompts of at most ``limit`` tokens and takes the client's rules as the next
    level's. A head is done when one prompt held all its rules, when a level no longer makes them fewer, or after
    ``max_levels``. Every rule of a level reaches a prompt.
    """
    room = limit - tokens.word_counter(pd.Series([summary_prompt("x", k)]))[0]
    if room <= 0:
        raise ValueError(f"a limit of {limit} tokens leaves no room for rules")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            rows = [(h, line.strip()) for h, lines in zip(b["key"], b["lines"], strict=True) for line in client.complete("\n".join([*lines, summary_prompt(h, k)])).splitlines() if re.search(r"\(X\d", line)]
            yield pd.DataFrame(rows, columns=["head", "rule"])

    open_, done = rules.select("head", "rule").distinct(), []
    for level in range(1, max_levels + 1):
        packed = cut(tokens.packs(open_.select(F.col("head").alias("key"), F.col("rule").alias("seq"), F.col("rule").alias("text")), int(room), counter), "packed")
        prompts = packed.groupBy("key", "pack").agg(F.sort_array(F.collect_list("text")).alias("lines"))  # at most a prompt's tokens
        answered = cut(prompts.repartition("key", "pack").mapInPandas(ask, "head string, rule string").distinct().withColumn("level", F.lit(level)), "answers")
        was = packed.groupBy(F.col("key").alias("head")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pack").alias("prompts"))
        now = answered.groupBy("head").agg(F.count(F.lit(1)).alias("left"))
        ends = (F.col("prompts") == 1) | (F.col("left") >= F.col("n")) | F.lit(level == max_levels)
        ended = was.join(now, "head").filter(ends).select("head")
        done.append(answered.join(ended, "head", "left_semi"))
        open_ = cut(answered.join(ended, "head", "left_anti").select("head", "rule"), "open")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def evidence(nodes: DataFrame, edges: DataFrame, center: int, seconds: int = 150, limit: int = 200) -> str:
    """The window's events as JSON lines, strongest first; ``limit`` bounds the prompt."""
    n, _ = graph.window_subgraph(nodes, edges, center, -(-seconds // 60))
    rows = n.filter("node_type <> 'service'").orderBy(F.desc(F.abs(graph.node_z())), "event_ts", "id").limit(limit)
    return "\n".join(r["value"] for r in rows.select(F.to_json(F.struct("id", "service", "metric", "severity", "zscore", "event_ts")).alias("value")).collect())


def evidence_session(nodes: DataFrame, edges: DataFrame, center: int, client: Client, max_rounds: int = 4) -> dict:
    """Shows windows to the client until it stops: answers are JSON with action (continue, stop), and
    optionally center, service, confidence. An answer that is no JSON stops the session."""
    seen, answer = [], {"action": "stop", "service": "unknown", "confidence": 0.0}
    for _ in range(max_rounds):
        seen.append(center)
        try:
            answer = json.loads(client.complete(evidence(nodes, edges, center)))
        except json.JSONDecodeError:
            break
        if answer.get("action") != "continue":
            break
        center = int(answer.get("center", center + 60))
    return {"centers": seen, "service": answer.get("service", "unknown"), "confidence": float(answer.get("confidence", 0.0))}
