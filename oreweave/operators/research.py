"""Evidence pooling, web augmentation, citations and answer synthesis."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.hashing import short_hash
from oreweave.operators.dedupe import keep_first
from oreweave.operators.retrieval import EVIDENCE
from oreweave.functions import records as Rec
from oreweave.operators.retrieval import search_warnings
from oreweave.session import stored


class TextProvider(Protocol):
    """An external text model. Nothing here depends on a particular one."""

    name: str

    def complete(self, instruction: str, prompt: str) -> str: ...


class MockProvider:
    """Offline provider: fixed answers, or an error to exercise the fallbacks."""

    name = "mock"

    def __init__(self, answers: Sequence[str] = (), error: str | None = None, name: str = "mock") -> None:
        self.answers, self.error, self.name = list(answers), error, name

    def complete(self, instruction: str, prompt: str) -> str:
        if self.error:
            raise RuntimeError(self.error)
        return self.answers.pop(0) if self.answers else "{}"


def noisy_json(text: str) -> dict[str, Any]:
    """The JSON object of a model answer, with or without text around it."""
    for candidate in (text, *(m.group(0) for m in [re.search(r"\{.*\}", text, re.DOTALL)] if m)):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return {}


def decompose(provider: TextProvider | None, question: str, limit: int) -> list[str]:
    """The question and at most ``limit - 1`` distinct sub-queries of it."""
    proposed: list[str] = []
    if provider is not None and limit > 1:
        try:
            answer = noisy_json(provider.complete("Split the question into search queries as JSON.", question))
            proposed = [str(q).strip() for q in answer.get("queries") or [] if str(q).strip()]
        except Exception:
            proposed = []
    first_spelling = {q.lower(): q for q in reversed([question, *proposed])}
    ordered = dict.fromkeys(q.lower() for q in [question, *proposed])
    return [first_spelling[key] for key in ordered][: max(1, limit)]


def pool_evidence(hits: DataFrame) -> DataFrame:
    """Best hit of every evidence id over all sub-queries; on ties the earlier step wins.

    hits: the evidence columns plus ``step`` and ``position``.
    """
    return keep_first(hits, ["evidence_id"], [F.desc("relevance"), F.asc("step"), F.asc("position")])


def collect_evidence(retrieve: Callable[[str], DataFrame], queries: Sequence[str]) -> DataFrame:
    """One plan that runs every sub-query and pools the hits; ``filter_relaxed`` marks hits of a search whose filter matched nothing."""
    parts = []
    for step, query in enumerate(queries):
        hits = retrieve(query)
        relaxed = F.col("filter_relaxed") if "filter_relaxed" in hits.columns else F.lit(False)
        hits = hits.select(*EVIDENCE, relaxed.alias("filter_relaxed"))
        rank = F.row_number().over(Window.partitionBy(F.lit(step)).orderBy(F.desc("relevance"), "evidence_id"))
        parts.append(hits.withColumn("step", F.lit(step)).withColumn("position", rank))
    return pool_evidence(reduce(DataFrame.unionByName, parts))


WEB_RESULT = "backend string, query string, rank int, link string, title string, content string, published string"
WebSearch = Callable[[Sequence[str]], DataFrame]  # queries to evidence rows


def stored_web_search(results: DataFrame) -> WebSearch:
    """Search over results collected before (``backend, query, rank, link, title, content, published``).

    A query takes the rows that were found for it; without any, rows whose title or text holds
    one of its words.
    """

    def search(queries: Sequence[str]) -> DataFrame:
        low = [q.lower() for q in queries]
        own = F.lower("query").isin(low)
        words = sorted({w for q in low for w in q.split() if len(w) > 3})
        text = F.lower(F.concat_ws(" ", "title", "content"))
        near = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))
        return web_evidence(results.where(own if results.where(own).limit(1).count() else near))

    return search


def works_as_results(works: DataFrame, query: str | Column) -> DataFrame:
    """Normalised works of a paged source (``work`` struct, ``position`` from 0) as web results."""
    asked = F.lit(query) if isinstance(query, str) else query
    link = F.coalesce("work.landing_page_url", "work.oa_url", "work.openalex_id")
    return works.select(
        F.lit("openalex").alias("backend"), asked.alias("query"), F.col("position").alias("rank"), link.alias("link"),
        F.col("work.title").alias("title"), F.col("work.abstract").alias("content"), F.col("work.publication_year").cast("string").alias("published"),
    )


def web_evidence(results: DataFrame) -> DataFrame:
    """Web results (``backend, query, rank, link, title, content, published``) as evidence rows."""

    def filled(column: str) -> Column:
        return F.when(F.trim(F.coalesce(column, F.lit(""))) != "", F.trim(column))

    base = F.when(F.col("backend") == "openalex", K.WEB_BASE_RELEVANCE["openalex"]).otherwise(K.WEB_BASE_RELEVANCE["glm"])
    title = F.coalesce(filled("title"), filled("link"), F.lit("web result"))
    link = F.coalesce(filled("link"), title)
    dated = F.when(filled("published").isNotNull(), F.concat(F.lit("\n(дата: "), filled("published"), F.lit(")")))
    text = F.concat(title, F.lit("\n"), F.coalesce(filled("content"), F.lit("")), F.coalesce(dated, F.lit("")))
    prefix = F.when(F.col("backend") == "openalex", "openalex:").otherwise("web:")
    return results.select(
        F.concat(prefix, short_hash(link)).alias("evidence_id"),
        F.substring(F.trim(text), 1, K.EVIDENCE_CHARS).alias("text"),
        link.alias("source_id"),
        F.when(F.col("backend") == "openalex", "openalex").otherwise("web").alias("source_type"),
        link.alias("filename"),
        F.lit("web").alias("section"),
        rank_relevance(F.col("rank"), base).alias("relevance"),
    )


def rank_relevance(rank: Column, base: Column | float) -> Column:
    """Relevance that falls with the rank (from 0) down to a floor."""
    start = F.lit(base) if isinstance(base, float) else base
    return F.greatest(F.lit(K.WEB_MIN_RELEVANCE), start - K.WEB_RANK_STEP * rank)


def merge_web_results(evidence: DataFrame) -> DataFrame:
    """Best web hit per target."""
    return keep_first(evidence, ["filename"], [F.desc("relevance"), F.asc("evidence_id")])


def slot_merge(corpus: DataFrame, web: DataFrame, max_context: int, web_max: int) -> DataFrame:
    """Context of at most ``max_context`` rows: web hits keep up to ``web_max`` slots, the corpus the rest.

    Both sides are cut to their bound by a top-k before they are numbered, so the final
    numbering window sees at most ``max_context + web_max`` rows.
    """
    order = [F.desc("relevance"), F.asc("evidence_id")]
    columns = [c for c in corpus.columns if c in web.columns]
    head = corpus.select(*columns).orderBy(*order).limit(max_context).withColumn("_web", F.lit(0))
    tail = web.select(*columns).orderBy(*order).limit(max(0, web_max)).withColumn("_web", F.lit(1))
    both = head.unionByName(tail)
    n_web = F.sum("_web").over(Window.partitionBy(F.lit(0)))
    position = F.row_number().over(Window.partitionBy("_web").orderBy(*order))
    quota = F.greatest(F.lit(0), F.lit(max_context) - F.col("_n_web"))
    kept = (
        both.withColumn("_n_web", n_web)
        .withColumn("_position", position)
        .where((F.col("_web") == 1) | (F.col("_position") <= quota))
    )
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_web", "_position"))
    return kept.withColumn("n", number).select("n", *columns)


def citations(context: DataFrame) -> DataFrame:
    return context.withColumn("relevance", F.bround("relevance", 3)).orderBy("n")


def context_block(context: DataFrame) -> DataFrame:
    """Numbered source block handed to a text model; the context is at most ``max_context`` rows."""
    origin = F.when(F.col("source_type") == "web", "[web]").when(F.col("source_type") == "openalex", "[openalex]").otherwise("[корпус]")
    block = F.format_string("[%d] %s источник: %s\n%s", "n", origin, "filename", "text")
    return context.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias(
            "context"
        )
    )


def extractive_answer(question: str, rows: Sequence[Any]) -> str:
    """Answer made of the best fragments, used when no text model is available."""
    lines = [f"LLM недоступен — экстрактивная сводка по запросу: «{question}».", "", "Наиболее релевантные фрагменты корпуса:"]
    for row in rows[:6]:
        body = row["text"].strip().replace("\n", " ")
        body = body if len(body) <= 320 else body[:320] + "…"
        lines.append(f"- [{row['n']}] ({row['filename']}, rel={row['relevance']:.2f}) {body}")
    return "\n".join(lines)


@dataclass
class ResearchResult:
    question: str
    answer: str
    sub_queries: list[str]
    citations: list[dict[str, Any]]
    provider: str
    drafts: list[dict[str, Any]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def harvested_web_search(works: DataFrame) -> WebSearch:
    """Search over the works of a harvest (``query, position, payload``)."""
    record = F.from_json("payload", Rec.WORK)
    found = works.select("query", "position", Rec.normalized_work(record).alias("work"))
    return stored_web_search(works_as_results(found, F.col("query")))


def run_research(
    question: str,
    retrieve: Callable[[str], DataFrame],
    *,
    planner: TextProvider | None = None,
    writers: Sequence[TextProvider] = (),
    judge: TextProvider | None = None,
    web: WebSearch | None = None,
    max_subqueries: int = 3,
    max_context: int = 12,
    web_max: int = 6,
) -> ResearchResult:
    """Decompose, retrieve, pool, augment, cite and write an answer.

    One writer gives a single answer; several give drafts that the judge merges. Without a
    working writer the answer is extractive; without a working judge the longest draft wins.
    Only the context (``max_context`` rows) is ever brought to the driver.
    """
    question = (question or "").strip()
    if not question:
        raise ValueError("question is required")
    queries = decompose(planner, question, max_subqueries)
    corpus = stored(collect_evidence(retrieve, queries))  # at most k rows for each sub-query
    warnings = search_warnings(corpus)
    corpus = corpus.drop("filter_relaxed")
    if web is not None and web_max > 0:
        context = slot_merge(corpus, merge_web_results(web(queries[:2])), max_context, web_max)
    else:
        context = slot_merge(corpus, corpus.where(F.lit(False)), max_context, 0)
    rows = citations(context).collect()
    cited = [row.asDict() for row in rows]
    result = ResearchResult(question, "", queries, cited, "none", warnings=warnings)
    if not rows:
        result.answer = "Релевантных фрагментов не нашлось ни в корпусе, ни в вебе."
        return result
    sources = "\n\n".join(f"[{r['n']}] {r['filename']}\n{r['text']}" for r in rows)
    prompt = f"{question}\n\n{sources}"
    for writer in writers:
        draft = {"provider": writer.name, "answer": "", "error": None}
        try:
            draft["answer"] = writer.complete("Answer from the numbered sources and cite them as [n].", prompt)
        except Exception as exc:
            draft["error"] = str(exc)
            result.warnings.append(f"draft_failed[{writer.name}]: {exc}")
        result.drafts.append(draft)
    good = [d for d in result.drafts if d["answer"] and not d["error"]]
    if not good:
        result.answer, result.provider = extractive_answer(question, rows), "extractive"
    elif len(good) == 1 or judge is None:
        best = good[0] if len(good) == 1 else max(good, key=lambda d: len(d["answer"]))
        result.answer = best["answer"]
        result.provider = best["provider"] if len(writers) == 1 else best["provider"] + "(single)"
    else:
        drafts = "\n\n".join(f"{i}. {d['provider']}\n{d['answer']}" for i, d in enumerate(good, 1))
        try:
            result.answer = judge.complete("Merge the drafts into one cited report.", f"{prompt}\n\n{drafts}")
            result.provider = judge.name
        except Exception as exc:
            result.warnings.append(f"judge_failed: {exc}")
            result.answer = max(good, key=lambda d: len(d["answer"]))["answer"]
            result.provider = "fallback-longest-draft"
    return result
