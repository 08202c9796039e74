"""Summary resolution as table jobs, and the article -> news projection.

The text service is outside the engine: its answers enter as a ``responses(id, attempt, payload)``
table (optionally with ``try_no`` when one prompt was sent several times). Resolution is a join:
attempt 1 valid -> it; attempt 1 nonblank but invalid -> attempt 2 if valid; anything else (no
answer, blank, malformed, still invalid) -> the fallback built from the description.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import summary, text, urls, vocab
from curata.operators.clean import html_text


def content(title: Column, description: Column, max_words: int = vocab.CONTENT_MAX_WORDS) -> Column:
    """Description when nonblank, else the title, cleaned to plain text."""
    raw = F.when(text.not_blank(description), description).otherwise(title)
    return html_text(raw, max_words)


def with_id(df: DataFrame) -> DataFrame:
    if "id" in df.columns:
        return df
    norm = F.col("normalized_url") if "normalized_url" in df.columns else urls.normalize_url(F.col("url"))
    return df.withColumn("id", urls.article_id(norm, F.col("url")))


def prompts(df: DataFrame, max_words: int = vocab.SUMMARY_MAX_WORDS) -> DataFrame:
    """``(id, attempt, prompt)``: the full prompt (attempt 1) and the headline-only retry (attempt 2)."""
    df = with_id(df)
    full = df.select("id", F.lit(1).alias("attempt"), summary.prompt(F.col("title"), content(F.col("title"), F.col("description")), max_words).alias("prompt"))
    simple = df.select("id", F.lit(2).alias("attempt"), summary.simple_prompt(F.col("title"), max_words).alias("prompt"))
    return full.unionByName(simple)


def response_payload(txt: Column) -> Column:
    """Wrap text in the service's response envelope."""
    part = F.struct(txt.alias("text"))
    return F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"))).alias("candidates")))


def lead_responses(df: DataFrame, words: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """Offline default provider: the first ``words`` words of the cleaned content, as payloads; ``keep`` names columns to carry."""
    df = with_id(df)
    lead = text.first_words(content(F.col("title"), F.col("description")), words)
    return df.select(*keep, "id", F.lit(1).alias("attempt"), F.lit(1).cast("bigint").alias("try_no"), response_payload(lead).alias("payload"))


def generate(prompt_df: DataFrame, provider: Callable[[list[str]], list[str]]) -> DataFrame:
    """Call a text provider on every prompt, a partition at a time (Arrow batches via mapInPandas).

    ``provider`` maps a list of prompts to a list of response payloads.
    """

    def run(batches):
        for pdf in batches:
            out = pdf[["id", "attempt"]].copy()
            out["try_no"] = 1
            out["payload"] = provider(list(pdf["prompt"]))
            yield out

    return prompt_df.mapInPandas(run, "id string, attempt int, try_no long, payload string")


def answer_texts(responses: DataFrame) -> DataFrame:
    """``(id, text1, text2)``: per attempt the first nonblank extracted text, by ``try_no`` (ties by text)."""
    r = responses.withColumn("text", summary.response_text(F.col("payload")))
    r = r.where(text.not_blank(F.col("text")))
    first = F.min_by("text", F.struct("try_no", "text"))
    per = r.groupBy("id", "attempt").agg(first.alias("text"))
    return per.groupBy("id").agg(
        F.max(F.when(F.col("attempt") == 1, F.col("text"))).alias("text1"),
        F.max(F.when(F.col("attempt") == 2, F.col("text"))).alias("text2"),
    )


def unusable(responses: DataFrame) -> DataFrame:
    """``(id)``: articles whose attempt 1 has a nonblank text that is no valid summary, so that attempt 2 is asked for."""
    t = answer_texts(responses)
    return t.where(text.not_blank(F.col("text1")) & ~summary.is_valid_summary(summary.clean_summary(F.col("text1")))).select("id")


def resolve_summaries(df: DataFrame, responses: DataFrame, max_words: int = vocab.SUMMARY_MAX_WORDS) -> DataFrame:
    """Add ``summary`` and ``summary_source`` ('attempt1' | 'attempt2' | 'fallback')."""
    df = with_id(df)
    joined = df.join(answer_texts(responses), "id", "left")
    c1 = summary.clean_summary(F.col("text1"))
    c2 = summary.clean_summary(F.col("text2"))
    fb = summary.fallback_summary(F.col("title"), F.col("description"), max_words)
    t1_missing = text.is_blank(F.col("text1"))
    t2_missing = text.is_blank(F.col("text2"))
    src = (
        F.when(t1_missing, F.lit("fallback"))
        .when(summary.is_valid_summary(c1), F.lit("attempt1"))
        .when(t2_missing, F.lit("fallback"))
        .when(summary.is_valid_summary(c2), F.lit("attempt2"))
        .otherwise(F.lit("fallback"))
    )
    out = joined.withColumn("summary_source", src)
    out = out.withColumn(
        "summary",
        F.when(F.col("summary_source") == "attempt1", c1).when(F.col("summary_source") == "attempt2", c2).otherwise(fb),
    )
    return out.drop("text1", "text2")


NEWS_COLUMNS = ["id", "title", "summary", "source", "source_domain", "url", "image_url", "published_at", "created_at", "score", "tags"]


def to_news(df: DataFrame, as_of: Column) -> DataFrame:
    """Published record: id from the URL, ``created_at = as_of``, ``score = final_score``."""
    df = with_id(df)
    if "image_url" not in df.columns:
        df = df.withColumn("image_url", F.lit(None).cast("string"))
    if "tags" not in df.columns:
        df = df.withColumn("tags", F.lit(None).cast("array<string>"))
    return df.select(
        "id", "title", "summary", "source", "source_domain", "url", "image_url", "published_at",
        as_of.alias("created_at"), F.col("final_score").alias("score"), "tags",
    )


def encode_news(df: DataFrame) -> DataFrame:
    """Storage encoding: NULL domain/image -> '', NULL time -> 0, times as epoch milliseconds,
    NULL tags -> []."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = lambda c: F.timestamp_diff("MILLISECOND", epoch, c)
    return df.select(
        "id", "title", "summary", "source",
        F.coalesce("source_domain", F.lit("")).alias("source_domain"),
        "url",
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.coalesce(millis(F.col("published_at")), F.lit(0).cast("long")).alias("published_at_ms"),
        millis(F.col("created_at")).alias("created_at_ms"),
        "score",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
