"""What a model answered about batches of posts: claims, citations, topics, silence and refusals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from testimony.functions import text as T
from testimony.operators.durable import broadcast_if_small, settle
from testimony.operators.resolution import file_themes

SCHEMA = (
    "claims array<struct<theme string, kind string, subject_role string, names array<string>, place_mention string, magnitude map<string,string>, "
    "status string, confidence string, citations array<string>>>, topics array<struct<topic string, citations array<string>>>, "
    "unfitted array<struct<what_happened string, citations array<string>>>"
)


def infer_batches(prompts: DataFrame, infer: Callable[[list[str]], list[str]], key: list[str], prompt_col: str = "prompt", batch_size: int = 16, calls_per_task: int = 8, held: DataFrame | None = None) -> DataFrame:
    """``prompts`` with ``answer`` and ``refused``: what the caller's function says to each prompt, in batches.

    ``infer`` takes and gives a list of texts in order; it is called in Python workers with at most ``batch_size`` prompts. A batch whose call fails, or gives another number of answers, is refused
    as a whole with the reason, and the others go on. Null prompts are refused without a call; a null answer is refused too. Rows are given back one for one, repeated keys too.

    Prompts are dealt by their key into tasks of about ``calls_per_task`` calls and sorted, so a task that is run again makes the same batches, and the result
    is settled: a lost executor pays again for the calls of its open tasks, never for finished ones, nor does anyone who reads the result twice. ``held``: rows (key, answer) of an earlier run; what they
    answer is not asked again. No prompts: no rows, no calls.
    """
    kind = T_.StructType([*prompts.schema.fields, T_.StructField("answer", T_.StringType()), T_.StructField("refused", T_.StringType())])
    asked = prompts
    if held is not None:
        asked = prompts.join(held.where("answer is not null").select(*key).distinct(), key, "left_anti")
        known = prompts.join(held.where("answer is not null").select(*key, "answer").dropDuplicates(key), key).withColumn("refused", F.lit(None).cast("string")).select(*kind.names)

    def one_call(texts: list[str]) -> tuple[list, str | None]:
        try:
            said = list(infer(texts))
        except Exception as error:  # noqa: BLE001  (whatever a model's client raises is the reason of the refusal)
            return [None] * len(texts), f"failed: {type(error).__name__}: {error}"[:500]
        return (said, None) if len(said) == len(texts) else ([None] * len(texts), f"failed: {len(said)} answers to {len(texts)} prompts")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), batch_size):
                part = batch.slice(i, batch_size)
                texts = part.column(prompt_col).to_pylist()
                some = [k for k, t in enumerate(texts) if t is not None]
                answer, refused = [None] * len(texts), ["no prompt"] * len(texts)
                said, why = one_call([texts[k] for k in some]) if some else ([], None)
                for k, a in zip(some, said, strict=True):
                    answer[k], refused[k] = None if a is None else str(a), why or ("no answer" if a is None else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answer, pa.string()), pa.array(refused, pa.string())], names=[*part.schema.names, "answer", "refused"])

    asked = settle(asked)
    tasks = max(1, -(-asked.count() // (batch_size * calls_per_task)))
    made = settle(asked.repartition(tasks, *key).sortWithinPartitions(*key, prompt_col).mapInArrow(answered, kind))
    return made if held is None else made.unionByName(known)


def parse_answers(answers: DataFrame) -> DataFrame:
    """Answers (batch, answer) with ``parsed`` and ``status``: ok, missing_claims or invalid. Code fences are dropped."""
    bare = T.strip_fence(F.col("answer"))
    rows = answers.withColumn("parsed", F.from_json(bare, SCHEMA))
    readable = F.get_json_object(bare, "$").isNotNull() & F.startswith(bare, F.lit("{"))
    status = F.when(~F.coalesce(readable, F.lit(False)), "invalid").when(F.col("parsed.claims").isNull(), "missing_claims").otherwise("ok")
    return rows.withColumn("status", status)


def lenient_citations(cited: DataFrame, posts: DataFrame, key: list[str]) -> DataFrame:
    """cited (key, batch, at, said) joined to posts (batch, x_id, post_id, posted_at): the id as it stands, else without its label, else its digits."""
    raw = F.trim("said")
    forms = F.array(raw, F.regexp_replace(raw, r"(?i)^#?\s*id[:\s]+", ""), F.regexp_replace(raw, r"\D", ""))
    tried = cited.select(*key, "batch", "at", F.posexplode(forms).alias("_p", "x_id"))
    met = tried.join(posts.select("batch", "x_id", "post_id", "posted_at"), ["batch", "x_id"])
    return met.groupBy(*key, "batch", "at").agg(F.min_by(F.struct("post_id", "posted_at"), "_p").alias("_hit")).select(*key, "batch", "at", "_hit.*")


def ingest_answers(answers: DataFrame, posts: DataFrame, themes: DataFrame) -> dict[str, DataFrame]:
    """Tables from answers (event_id, batch, answer), posts (batch, x_id, post_id, posted_at) and themes (event_id, id, name, nature, lifecycle).

    claims: batch, n, outcome (drafted, routed, no_theme, no_valid_citations), theme_id and the fields; first_seen_at is the time
    of the first listed citation that is known. citations: of drafted claims. topics: post_id, theme_id. silent:
    posts of readable batches that no drafted claim, routed claim or topic cites. A topic of unknown name answers its posts
    but files them under nothing.
    """
    read = settle(parse_answers(answers).where("status = 'ok'"))
    listed = settle(read.select("event_id", "batch", F.posexplode("parsed.claims").alias("n", "c")).select("event_id", "batch", "n", "c.*"))
    cites = settle(lenient_citations(listed.select("batch", "n", F.posexplode("citations").alias("at", "said")), posts, ["n"]))
    first = cites.groupBy("batch", "n").agg(F.min_by("posted_at", "at").alias("first_seen_at"))
    live = broadcast_if_small(themes.where("lifecycle = 'active'").groupBy("event_id", T.fold(F.col("name")).alias("_f")).agg(F.min(F.struct("id", "nature")).alias("_t")))
    named = listed.withColumn("_f", T.fold(F.coalesce("theme", F.lit("")))).join(live, ["event_id", "_f"], "left")
    unnamed = named.where("_t is null and kind is not null").select("event_id", "kind")
    near = file_themes(unnamed, themes).select("event_id", "kind", F.col("theme_id").alias("_near"))
    named = named.join(near, ["event_id", "kind"], "left").join(first, ["batch", "n"], "left")
    theme = F.coalesce(F.col("_t.id"), "_near")
    outcome = F.when(F.col("first_seen_at").isNull(), "no_valid_citations").when(theme.isNull(), "no_theme").when(F.col("_t.nature") == "topic", "routed").otherwise("drafted")
    subject = F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, T.strip_declared_names(F.col("subject_role"), F.col("names"))).otherwise(F.col("subject_role"))
    claims = settle(
        named.select("event_id", "batch", "n", outcome.alias("outcome"), theme.alias("theme_id"), F.coalesce("kind", F.lit("otro")).alias("kind"), subject.alias("subject"), "place_mention", "magnitude", "status", T.parse_confidence(F.col("confidence")).alias("confidence"), "first_seen_at")
    )
    spoken = cites.join(claims.where("outcome = 'drafted'").select("batch", "n"), ["batch", "n"], "left_semi").select("batch", "n", "post_id", "at")
    routed = cites.join(claims.where("outcome = 'routed'").select("batch", "n", "theme_id"), ["batch", "n"]).select("batch", "post_id", "theme_id")
    said = read.select("event_id", "batch", F.explode("parsed.topics").alias("t")).select("event_id", "batch", T.fold(F.col("t.topic")).alias("_f"), F.explode("t.citations").alias("x_id"))
    met = settle(said.join(posts.select("batch", "x_id", "post_id"), ["batch", "x_id"]).join(live, ["event_id", "_f"], "left").select("batch", "post_id", F.when(F.col("_t.nature") == "topic", F.col("_t.id")).alias("theme_id")))
    topics = met.where("theme_id is not null").unionByName(routed).distinct()
    answered = spoken.select("batch", "post_id").union(routed.select("batch", "post_id")).union(met.select("batch", "post_id")).distinct()
    silent = posts.join(read.select("batch").distinct(), "batch", "left_semi").join(answered, ["batch", "post_id"], "left_anti").select("batch", "post_id")
    return {"claims": claims, "citations": spoken.dropDuplicates(["batch", "n", "post_id"]), "topics": topics, "silent": silent}


def post_accounting(posts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Per batch: posts, those cited by drafted claims, judged under a topic, silent, and unread (the rest)."""
    mark = lambda name, rows: rows.select("batch", "post_id").distinct().withColumn(name, F.lit(1))
    out = posts.select("batch", "post_id")
    for name, rows in (("cited", tables["citations"]), ("judged", tables["topics"]), ("silent", tables["silent"])):
        out = out.join(mark(name, rows), ["batch", "post_id"], "left")
    count = lambda c: F.count(c).alias(c)
    rest = F.count_if(F.coalesce("cited", "judged", "silent").isNull()).alias("unread")
    return out.groupBy("batch").agg(F.count("*").alias("posts"), count("cited"), count("judged"), count("silent"), rest)
