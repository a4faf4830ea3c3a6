"""Conversation windows and token budgets."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def recent_messages(messages: DataFrame, role: str, n: int = 3) -> DataFrame:
    """messages(conv_id, turn, role, text): the last n of a role, oldest first, as one array."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.where(F.col("role") == role).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return last.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]).alias("texts"))


def recent_citations(messages: DataFrame, n: int = 3) -> DataFrame:
    """messages(conv_id, turn, role, cited array): what the last n assistant messages cite, newest first, each once."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.where("role = 'assistant'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("r", "cited"))), lambda m: m["cited"])
    return last.groupBy("conv_id").agg(F.array_distinct(F.flatten(lists)).alias("cited"))


def enriched_query(messages: DataFrame, questions: DataFrame, n: int = 3) -> DataFrame:
    """questions(conv_id, question), messages(conv_id, turn, role, text, cited) -> conv_id, query.

    Up to n recent questions, then what up to n recent answers cite (oldest first, each once), then the question,
    a line each; without a history the question alone.
    """
    asked = recent_messages(messages, "user", n)
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.where("role = 'assistant'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("turn", "cited"))), lambda m: m["cited"])
    cited = last.groupBy("conv_id").agg(F.array_distinct(F.flatten(lists)).alias("cited"))
    j = questions.join(asked, "conv_id", "left").join(cited, "conv_id", "left")
    # The titles of both lines
    line = lambda title, items, sep: F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(items, sep)))
    return j.select("conv_id", F.concat_ws("\n", line("Recent conversation questions: ", "texts", " | "), line("Recently discussed code: ", "cited", ", "), F.col("question")).alias("query"))


def history_budget(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages whose running token estimate fits; the oldest drop first."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    cost = token_estimate(F.col("text")).cast("bigint")
    return messages.withColumn("cost", cost).withColumn("total", F.sum("cost").over(w)).where(F.col("total") <= budget).select("conv_id", "turn", "cost", "total")


#: Marks of shortened text.
TRUNCATED = "\n\n[...truncated to fit the context budget...]"
README_TRUNCATED = "\n\n[...truncated...]"
#: READMEs that no parser reads, first match wins.
README_NAMES = ["README", "README.rst", "README.txt", "Readme.rst", "readme.txt"]


def _estimate(text: str) -> int:
    return int(len(text) / 3.0) + 1 if text else 0


def fit_context(history: list[str], readme: str, evidence: list[str], budget: int) -> tuple[int, str, list[str]]:
    """(history messages dropped, README, evidence) that fit the budget of estimated tokens.

    The oldest messages ("role: text") go first, then the end of the README, then the ends of the evidence
    from the worst on. No evidence is dropped: at its shortest it has a character and the mark. So what is over at each
    place of the evidence is a running sum of what the worse ones save at their shortest, and one cut at the first
    place that has room for the rest is all there is to do.
    """
    rest = _estimate(readme) + sum(map(_estimate, evidence))
    after = list(accumulate(map(_estimate, reversed(history)), initial=rest))  # cost with the newest 0, 1, ... messages
    kept = max((n for n, cost in enumerate(after) if cost <= budget), default=0)
    over = after[kept] - budget
    if over > 0 and readme:
        room = len(readme) - 3 * over - len(TRUNCATED)
        short = readme[:room].rstrip() + TRUNCATED if room > 0 else ""
        over -= _estimate(readme) - _estimate(short)
        readme = short
    shortest = [t[:1] + TRUNCATED if len(t) > (i == 0) else t for i, t in enumerate(evidence)]
    saved = [_estimate(t) - _estimate(s) for t, s in zip(evidence, shortest, strict=True)]
    left = list(accumulate((-x for x in reversed(saved)), initial=over))[-2::-1]
    room = [len(t) - 3 * o - len(TRUNCATED) for t, o in zip(evidence, left, strict=True)]
    at = max((i for i, (o, r) in enumerate(zip(left, room, strict=True)) if o <= 0 or r > 0), default=-1)
    cut = [(evidence[at][: room[at]].rstrip() or evidence[at][:1]) + TRUNCATED if left[at] > 0 else evidence[at]] if at >= 0 else []
    return len(history) - kept, readme, evidence[: max(at, 0)] + cut + shortest[at + 1 :]


def context_budget(contexts: DataFrame, budget: int) -> DataFrame:
    """contexts(id, history array<string>, readme, evidence array<string>) with the three cut to the budget and the number of messages dropped.

    One context is one row, whatever the number of rows, so nothing is shuffled.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cut = [fit_context(h or [], r or "", e or [], budget) for h, r, e in zip(*(b.column(c).to_pylist() for c in ("history", "readme", "evidence")), strict=True)]
            kept = [(h or [])[x[0] :] for h, x in zip(b.column("history").to_pylist(), cut, strict=True)]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(kept, texts), pa.array([x[1] for x in cut], pa.string()), pa.array([x[2] for x in cut], texts), pa.array([x[0] for x in cut], pa.int64())], ["id", "history", "readme", "evidence", "dropped"])

    from ..session import ship_package

    ship_package(contexts.sparkSession)
    kind = contexts.schema["id"].dataType.simpleString()
    return contexts.select("id", "history", "readme", "evidence").mapInArrow(run, f"id {kind}, history array<string>, readme string, evidence array<string>, dropped long")


def prompt_text(contexts: DataFrame) -> DataFrame:
    """contexts(id, question, history, readme_path, readme, evidence) -> id, prompt: the sections that are not empty, then the question."""
    section = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(title, F.lit(":\n"), body))
    parts = [section(F.lit("Conversation so far"), F.array_join("history", "\n")), section(F.concat(F.lit("Project README ("), "readme_path", F.lit(")")), F.col("readme")), section(F.lit("Retrieved evidence"), F.array_join("evidence", "\n\n"))]
    return contexts.select("id", F.concat_ws("\n\n", *parts, F.col("question")).alias("prompt"))


def answer_text(answers: DataFrame) -> DataFrame:
    """answers(id, raw, insufficient, ambiguous) -> id, text: a note before a weakly founded answer and after an ambiguous one; never empty."""
    # The notes around an answer
    weak = "The repository does not contain enough evidence to fully answer this question. Here is the nearest relevant local evidence found:"
    close = "Multiple retrieved fragments were similarly relevant to this question."
    none = "The model did not return an answer for this question."
    body = F.nullif(F.regexp_replace(F.coalesce("raw", F.lit("")), r"^\s+|\s+$", ""), F.lit(""))
    text = F.concat_ws("\n\n", F.when(F.col("insufficient"), F.lit(weak)), body, F.when(F.col("ambiguous"), F.lit(close)))
    return answers.select("id", F.coalesce(F.nullif(text, F.lit("")), F.lit(none)).alias("text"))


def read_readme(files: DataFrame, limit: int = 8000) -> DataFrame:
    """files(path, text) of a repository's root -> path, content of the first README in README_NAMES' order, cut with a mark; no row if it is blank or absent."""
    order = F.array_position(F.array(*map(F.lit, README_NAMES)), F.col("path"))
    found = files.withColumn("o", order).where("o > 0").orderBy("o").limit(1)
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    cut = F.concat(F.regexp_replace(F.substring(body, 1, limit), r"\s+$", ""), F.lit(README_TRUNCATED))
    return found.select("path", F.when(F.length(body) > limit, cut).otherwise(body).alias("content")).where("content <> ''")


def session_recency(messages: DataFrame, last: str, keep: int = 64) -> DataFrame:
    s = messages.groupBy("conv_id").agg(F.max(last).alias("last"), F.count("*").alias("n"))
    return s.orderBy(F.desc("last"), "conv_id").limit(keep)
