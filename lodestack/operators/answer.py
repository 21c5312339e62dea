"""From hits to answers: sources, context, history, prompt, generation, and the event stream of an answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import context_entry, fill_template, role_line

#: Templates; their values are inserted as they are.
STRICT_PROMPT = "Answer the question from the sources below and from nothing else. Cite each source you use as [Title](URL).\nIf the sources do not say it, reply that they do not.\n\nSources:\n{context}\nQuestion:\n{question}\n\nAnswer:\n"
CHAT_PROMPT = "You answer questions about a wiki, from the sources below and from nothing else. Cite each source you use as [Title](URL) and list them at the end.\nThe conversation so far only shows what is meant. If the sources do not say it, reply that they do not.\n\nSources:\n{context}\nConversation:\n{history}\n\nQuestion:\n{question}\n\nAnswer:\n"
#: Turns of a conversation that a prompt holds.
MAX_TURNS = 20
NO_HITS = "No relevant documents were found."


def sources_of(hits: DataFrame) -> DataFrame:
    """Sources of each query once per url, in order of their first rank; a null url is one url.

    ``hits``: ``query_id, rank, title, url``. Result: ``query_id, source_no, title, url``.
    """
    first = Window.partitionBy("query_id", "url").orderBy("rank")
    kept = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return kept.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("source_no"), "title", "url")


def context_of(hits: DataFrame) -> DataFrame:
    """``query_id, context``: the entries of all hits of a query in order of rank.

    ``hits``: ``query_id, rank, title, url, chunk``, a bounded list per query.
    """
    entry = F.struct("rank", context_entry(F.col("title"), F.col("url"), F.col("chunk")).alias("entry"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["entry"]), "").alias("context"))


def history_of(turns: DataFrame, max_turns: int | None = MAX_TURNS) -> DataFrame:
    """``conv_id, history``: lines ``Role: content`` in order of turns, of the last ``max_turns`` ones; with None of all.

    The limit is applied in every task before the shuffle, so a long conversation costs no more than a short one.

    ``turns``: ``conv_id, turn, role, content``. A null content is empty.
    """
    if max_turns is not None:
        last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
        turns = turns.withColumn("from_end", F.row_number().over(last)).where(F.col("from_end") <= max_turns)
    line = F.struct("turn", role_line(F.col("role"), F.col("content")).alias("line"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))


def previous_turns(turns: DataFrame) -> DataFrame:
    """All turns of a conversation but its current, last one."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return turns.join(last, "conv_id").where("turn < last").drop("last")


def session_counters(turns: DataFrame) -> DataFrame:
    """``conv_id, n_queries, n_messages``: how often the user asked, and all messages of a conversation."""
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_queries"), F.count("*").alias("n_messages"))


def prompts(questions: DataFrame, contexts: DataFrame, histories: DataFrame | None = None, template: str = CHAT_PROMPT) -> DataFrame:
    """``query_id, prompt``; a query without context or history has an empty one.

    ``questions``: ``query_id, question``; ``contexts``: ``query_id, context``; ``histories``: ``query_id, history``.
    """
    rows = questions.join(contexts, "query_id", "left")
    rows = rows.join(histories, "query_id", "left") if histories is not None else rows.withColumn("history", F.lit(""))
    return rows.select("query_id", fill_template(template, context=F.col("context"), history=F.col("history"), question=F.col("question")).alias("prompt"))


def extractive_answers(hits: DataFrame) -> DataFrame:
    """Stand-in for a language model: the best chunk of a query with its citation, as ``query_id, answer``."""
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("title", "url", "chunk"), "rank").alias("h"))
    return best.select("query_id", F.concat(F.coalesce("h.chunk", F.lit("")), F.lit("\n["), F.coalesce("h.title", F.lit("None")), F.lit("]("), F.coalesce("h.url", F.lit("None")), F.lit(")")).alias("answer"))


def generate(prompted: DataFrame, model) -> DataFrame:
    """``query_id, answer`` by a callable from a list of prompts to a list of answers, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"query_id": pdf["query_id"], "answer": model(list(pdf["prompt"]))})

    kind = prompted.schema["query_id"].dataType.simpleString()
    return prompted.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string")


def answer_events(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Events of each answer: its sources first, then its tokens, then the end; empty tokens are left out.

    ``answers``: ``query_id, answer``; ``sources``: as of ``sources_of``. Result: ``query_id, seq, event`` (JSON).
    """
    listed = sources.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("source_no", "title", "url"))), lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url"))).alias("data"))
    rows = answers.join(listed, "query_id", "left")
    none = F.expr("CAST(array() AS array<struct<title:string,url:string>>)")
    tokens = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(\S+\s*|\s+)"), F.lit(1))
    head = F.to_json(F.struct(F.lit("sources").alias("type"), F.coalesce("data", none).alias("data")))
    body = F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.to_json(F.struct(F.lit("token").alias("type"), t.alias("data"))))
    events = F.concat(F.array(head), body, F.array(F.to_json(F.struct(F.lit("end").alias("type")))))
    return rows.select("query_id", F.posexplode(events).alias("seq", "event"))


def fold_events(events: DataFrame) -> DataFrame:
    """``query_id, answer``: the tokens up to the end event joined; lines that are no JSON object are skipped."""
    parsed = events.select("query_id", "seq", F.from_json("event", "type string, data string").alias("e")).where("e.type IS NOT NULL")
    ended = F.min(F.when(F.col("e.type") == "end", F.col("seq"))).over(Window.partitionBy("query_id"))
    live = parsed.withColumn("ended", ended).where("e.type = 'token' AND (ended IS NULL OR seq < ended)")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("e.data").alias("t")))), lambda x: x["t"]), "")
    return live.groupBy("query_id").agg(text.alias("answer"))
