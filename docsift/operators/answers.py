"""Prompts, routing and answer assembly (C3-C5: F5-F12, F16, P5, J5, J6).

Positional ``zip`` of metadata and answers becomes a key join on
(query_id, doc_id); per-query concatenations are bounded by k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.config import (
    ANSWER_JOINER,
    ANSWER_TEMPLATE,
    APOLOGY,
    DEFAULT,
    NO_DOCUMENTS_MESSAGE,
    NO_INFO_MARKER,
    NO_RELEVANT_ANSWER,
    PROMPT_TEMPLATE,
    TITLES_HEADER,
    EngineConfig,
)
from docsift.functions import text as tx
from docsift.operators import vectors as vec
from docsift.sources import files as src

TITLE_LISTING = "titles"  # the one listing that 'list' replies refer to


def prompt_text(content, query) -> Column:
    """F8: the prompt around a content prefix and the question."""
    return tx.fill(PROMPT_TEMPLATE, content=content, query=query)


def build_prompts(retrieved: DataFrame, questions: DataFrame, files: DataFrame | None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Retrieved (query_id, rank, id, title, file_path) + question text +
    the *current* file content by path (S6/J6) -> prompt per (query, doc).
    ``files`` None: the files are opened by their paths."""
    withq = retrieved.join(questions.select("query_id", F.col("text").alias("query_text")), "query_id")
    read = src.read_by_path(withq, files, "file_path")
    return read.select(
        "query_id",
        F.col("id").alias("doc_id"),
        "rank",
        "file_path",
        prompt_text(tx.prefix("content", cfg.prefix_chars), "query_text").alias("prompt"),
    )


def messages(prompts: DataFrame, system_prompt: str | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """[system, user] messages as array<struct<role, content>>."""
    system = F.coalesce(F.nullif(F.lit(system_prompt), F.lit("")), F.lit(cfg.system_prompt))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
    )
    return prompts.select("query_id", "doc_id", msgs.alias("messages"))


def keep_informative(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """J5 + F16 + P5: align answers by key, a failed call (NULL) becomes the
    apology, answers containing the refusal marker are dropped."""
    return informative(prompts.join(responses, ["query_id", "doc_id"], "left"))


def informative(answered: DataFrame) -> DataFrame:
    """F16 + P5 on aligned answers (query_id, doc_id, rank, file_path, response)."""
    resp = F.coalesce(F.col("response"), F.lit(APOLOGY))
    return answered.select("query_id", "doc_id", "rank", "file_path", resp.alias("response")).where(
        ~F.col("response").contains(NO_INFO_MARKER)
    )


def format_answers(kept: DataFrame, questions: DataFrame) -> DataFrame:
    """F10 + A4: one answer per question; the fixed sentence when nothing is
    left. The per-query group holds at most k rows."""
    block = tx.fill(ANSWER_TEMPLATE, doc_id="doc_id", file_path="file_path", response="response")
    per_q = kept.select("query_id", "rank", block.alias("_b")).groupBy("query_id").agg(
        F.expr(f"listagg(_b, '{_sql_escape(ANSWER_JOINER)}') WITHIN GROUP (ORDER BY rank)").alias("_ans")
    )
    return questions.select("query_id").join(per_q, "query_id", "left").select(
        "query_id", F.coalesce("_ans", F.lit(NO_RELEVANT_ANSWER)).alias("answer")
    )


def _sql_escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")


def route_of(text, cfg: EngineConfig = DEFAULT, keywords=None, phrases=None) -> Column:
    """F12 (+F3, F4, F6, F7): 'list' / 'retrieve' / 'converse'."""
    q = tx.normalize_query(text)
    kw = cfg.keywords if keywords is None else keywords
    ph = cfg.list_phrases if phrases is None else phrases
    return F.when(q.isin(*ph), F.lit("list")).when(tx.contains_any(q, kw), F.lit("retrieve")).otherwise(F.lit("converse"))


def route(questions: DataFrame, cfg: EngineConfig = DEFAULT, keywords=None, phrases=None) -> DataFrame:
    """F12 for a table of questions: (query_id, route)."""
    return questions.select("query_id", route_of("text", cfg, keywords, phrases).alias("route"))


def title_message_lines(registry: DataFrame) -> DataFrame:
    """F11 as lines (line_no, line): the header, then every title ordered by
    file path; the fixed sentence alone when the registry is empty.

    Line numbers come from the distributed prefix sum, so listing a large
    registry never funnels through one task. The reply is the lines in
    ``line_no`` order."""
    titled = registry.select("file_path", "id", "title", F.lit(1).cast("bigint").alias("_one"))
    numbered = vec.document_offsets(titled, ["file_path", "id"], "_one", 1, carry=("title",))
    lines = numbered.select(F.col("first_pos").alias("line_no"), F.col("title").alias("line"))
    n = lines.agg(F.count(F.lit(1)).alias("n"))
    header = n.select(
        F.lit(0).cast("bigint").alias("line_no"),
        F.when(F.col("n") > 0, F.lit(TITLES_HEADER.rstrip("\n"))).otherwise(F.lit(NO_DOCUMENTS_MESSAGE)).alias("line"),
    )
    return header.unionByName(lines)


def answer(routes: DataFrame, retrieved_answers: DataFrame, converse: DataFrame) -> DataFrame:
    """One reply per question by its route: (query_id, route, answer,
    listing).

    routes (query_id, route); retrieved_answers (query_id, answer) for the
    'retrieve' questions; converse (query_id, response) from the model, NULL
    when the call failed (the apology then, F16). All 'list' questions have
    one and the same reply, as long as the registry: they carry its name in
    ``listing`` (NULL otherwise) and no answer of their own; its lines are
    ``title_message_lines``. Every join is on the query."""
    out = routes.join(retrieved_answers.select("query_id", F.col("answer").alias("_ret")), "query_id", "left").join(
        converse.select("query_id", F.col("response").alias("_conv")), "query_id", "left"
    )
    reply = F.when(F.col("route") == "retrieve", F.coalesce(F.col("_ret"), F.lit(NO_RELEVANT_ANSWER))).when(
        F.col("route") == "converse", F.coalesce(F.col("_conv"), F.lit(APOLOGY))
    )
    listing = F.when(F.col("route") == "list", F.lit(TITLE_LISTING))
    return out.select("query_id", "route", reply.alias("answer"), listing.alias("listing"))
