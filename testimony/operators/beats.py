"""The account of a place and an interval: scope, anchor, order, citations, prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.operators import trees
from testimony.operators.durable import broadcast_if_small, settle


def ratified_claims(claims: DataFrame, themes: DataFrame) -> DataFrame:
    """Claims that reach readers: under a theme that is active and a happening."""
    live = themes.where("lifecycle = 'active' and nature = 'happening'").select(F.col("id").alias("theme_id"), F.col("name").alias("theme"))
    return claims.join(live, "theme_id")


def claims_in_scope(claims: DataFrame, links: DataFrame, closure: DataFrame, root, start, end) -> DataFrame:
    """Distinct claims linked into a subtree and first seen in the closed interval."""
    inside = links.join(trees.subtree(closure, root).withColumnRenamed("id", "place_id"), "place_id", "left_semi").select("claim_id").distinct()
    when = F.col("first_seen_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return claims.where(when).join(inside, "claim_id", "left_semi")


def _in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, settled, with ``_range``: consecutive ranges of the order, none of which shares a key with another, and ``_row``, the row's number in its range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    # Ids rise by one within a task and begin at its number times 2^33.
    return settle(sorted_.withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("long"), 33) + 1))


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Rows with their number in the order: that within their range, after the counts of the ranges before. With ``by``, the first columns of the order, numbers begin anew for each of its values.

    Rows are sorted once, where they are written. Only ranges, as many as shuffle partitions, pass through one task.
    """
    ranged = _in_ranges(rows, order)
    before = Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range", *(by or [])).agg(F.count("*").alias("_n"), F.min("_row").alias("_first_at"), F.min(F.struct(*order)).alias("_least"))
    counts = parts.groupBy("_range").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    starts = settle(counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    joined = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn(name, F.col("_row") + F.col("_start"))
    if by:
        begins = parts.join(F.broadcast(starts), F.col("_range") == F.col("_r")).groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min(F.col("_start") + F.col("_first_at")).alias("_begin"))
        same = F.lit(True)
        for i, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
        joined = joined.join(broadcast_if_small(settle(begins)), same).withColumn(name, F.col(name) - F.col("_begin") + 1).drop(*[f"_by{i}" for i in range(len(by))], "_begin")
    return joined.drop("_range", "_row", "_r", "_start")


def beat_order(claims: DataFrame, links: DataFrame, closure: DataFrame, root) -> DataFrame:
    """Claims with their anchor and position: anchors by their earliest claim, claims by time within.

    The anchor is the deepest linked place in the subtree; the first by place id on ties.
    """
    # Below one root, the depths under it are in the order of depths in the whole tree.
    below = closure.where(F.col("ancestor") == F.lit(root)).select(F.col("descendant").alias("place_id"), "depth")
    inside = links.select("claim_id", "place_id").join(below, "place_id")
    anchors = inside.groupBy("claim_id").agg(F.min(F.struct(-F.col("depth"), "place_id"))["place_id"].alias("anchor"))
    placed = settle(claims.join(anchors, "claim_id"))
    firsts = placed.groupBy("anchor").agg(F.min(F.struct("first_seen_at", "claim_id")).alias("_first")).withColumnRenamed("anchor", "_anchor")
    rows = placed.join(broadcast_if_small(firsts), F.col("anchor") == F.col("_anchor")).drop("_anchor")
    return numbered(rows, ["_first", "anchor", "first_seen_at", "claim_id"], "position").drop("_first")


def citation_numbers(ordered: DataFrame, citations: DataFrame) -> DataFrame:
    """Running numbers over (claim position, citation order); a post cited by two claims gets two."""
    return numbered(ordered.select("claim_id", "position").join(citations, "claim_id"), ["position", "ord", "post_id"], "n")


def first_mention(clauses: DataFrame) -> DataFrame:
    """clauses (position, persons array of (id, handle), subject) with ``phrase``.

    A lone person is 'handle, subject' at first and the first name later; several persons always show
    all handles and count as mentions.
    """
    from testimony.functions.text import join_y

    each = clauses.select("position", F.explode("persons").alias("p")).select("position", F.col("p.id").alias("person"))
    before = each.withColumn("again", F.row_number().over(Window.partitionBy("person").orderBy("position")) > 1)
    seen = before.groupBy("position").agg(F.max("again").alias("again"))
    rows = clauses.join(seen, "position", "left")
    handle = F.get("persons", F.lit(0))["handle"]
    lone = F.when(F.col("again"), F.get(F.split(handle, " "), F.lit(0))).otherwise(F.concat_ws(", ", handle, F.nullif("subject", F.lit(""))))
    phrase = F.when(F.size("persons") == 0, F.col("subject")).when(F.size("persons") == 1, lone).otherwise(join_y(F.transform("persons", lambda p: p.handle)))
    return rows.withColumn("phrase", phrase).drop("again")


def clause_runs(ordered: DataFrame, by: list[str], place: str, position: str = "position") -> DataFrame:
    """Rows with ``run``: consecutive clauses of one place share a number.

    Changes are summed within ranges of the order; a range starts from the changes of those before it and at the seams.
    """
    ranged = _in_ranges(ordered, [*by, position])
    w = Window.partitionBy("_range", *by).orderBy(position)
    change = F.when(F.col(place).eqNullSafe(F.lag(place).over(w)) & F.lag(position).over(w).isNotNull(), 0).otherwise(1)
    rows = ranged.withColumn("_c", F.when(F.row_number().over(w) == 1, 0).otherwise(change)).withColumn("run", F.sum("_c").over(w))
    edge = F.struct(F.col(position).alias("at"), F.col(place).alias("place"))
    edges = rows.groupBy("_range", *by).agg(F.min(edge).alias("_head"), F.max(edge).alias("_tail"), F.sum("_c").alias("_n"))
    turn = Window.partitionBy(*by).orderBy("_head")
    tail = F.lag("_tail").over(turn)
    seam = F.when(F.col("_head.place").eqNullSafe(tail["place"]) & tail["at"].isNotNull(), 0).otherwise(1)
    sums = edges.withColumn("_seam", seam).withColumn("_start", F.sum(F.col("_seam") + F.col("_n")).over(turn) - F.col("_n"))
    starts = sums.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_start")
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = rows.join(broadcast_if_small(starts), on).withColumn("run", F.col("run") + F.col("_start"))
    return joined.drop("_c", "_range", "_row", *starts.columns)


def order_beats(claims: DataFrame, links: DataFrame, closure: DataFrame, asked: DataFrame) -> DataFrame:
    """Claims of many beats with their beat, anchor and position from 1: as ``beat_order`` for each of ``asked`` (beat, root, start, end; ends included).

    claims: claim_id, first_seen_at and more. links: claim_id, place_id. A claim is in every beat that it belongs to, once. Numbers are given by ranges over all beats together.
    """
    depths = closure.groupBy(F.col("descendant").alias("place_id")).agg(F.max("depth").alias("_depth"))
    wanted = broadcast_if_small(asked)
    beneath = closure.select(F.col("ancestor").alias("root"), F.col("descendant").alias("place_id")).join(wanted.select("beat", "root"), "root").join(depths, "place_id")
    # A place is beneath few roots, so links grow by the depth of the tree at most.
    inside = links.select("claim_id", "place_id").join(broadcast_if_small(settle(beneath.select("beat", "place_id", "_depth"))), "place_id")
    anchors = inside.groupBy("beat", "claim_id").agg(F.min(F.struct((-F.col("_depth")).alias("d"), F.col("place_id").alias("p"))).alias("_a")).select("beat", "claim_id", F.col("_a.p").alias("anchor"))
    when = F.col("first_seen_at").between(F.col("start").cast("timestamp"), F.col("end").cast("timestamp"))
    placed = settle(claims.join(anchors, "claim_id").join(wanted.select("beat", "start", "end"), "beat").where(when).drop("start", "end"))
    firsts = placed.groupBy("beat", "anchor").agg(F.min(F.struct("first_seen_at", "claim_id")).alias("_first"))
    rows = placed.join(broadcast_if_small(firsts), ["beat", "anchor"])
    return numbered(rows, ["beat", "_first", "anchor", "first_seen_at", "claim_id"], "position", ["beat"]).drop("_first")


def beat_sources(ordered: DataFrame, citations: DataFrame) -> DataFrame:
    """(beat, claim_id, post_id, ord, n): citations (claim_id, post_id, ord) of each beat numbered from 1 in the order of its claims; a post cited by two claims has two numbers."""
    cited = ordered.select("beat", "claim_id", "position").join(citations.select("claim_id", "post_id", "ord"), "claim_id")
    return numbered(cited, ["beat", "position", "ord", "post_id"], "n", ["beat"]).select("beat", "claim_id", "post_id", "ord", "n")


def beat_sentences(clauses: DataFrame, by: list[str]) -> DataFrame:
    """(*by, run, sentence) of clauses (*by, position, place_name, text, cite_ns): clauses of one place in a row are one sentence. A null text says nothing but its marks."""
    marked = F.concat(F.coalesce("text", F.lit("")), F.array_join(F.transform(F.coalesce("cite_ns", F.array().cast("array<long>")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    runs = clause_runs(clauses.withColumn("_t", marked), by, "place_name").groupBy(*by, "run").agg(F.first("place_name").alias("place"), F.array_sort(F.collect_list(F.struct("position", "_t"))).alias("cs"))
    body = F.concat(F.coalesce(F.concat(F.lit("En "), "place", F.lit(", ")), F.lit("")), F.array_join(F.transform("cs", lambda c: c["_t"]), "; "))
    sentence = F.concat(F.upper(F.left("body", F.lit(1))), F.expr("substring(body, 2)"), F.lit("."))
    return runs.withColumn("body", body).select(*by, "run", sentence.alias("sentence"))


def render_beats(clauses: DataFrame, by: list[str]) -> DataFrame:
    """(*by, clauses, prose): the prose of each beat, from clauses (*by, position, place_name, text, cite_ns).

    Sentences are made first, one row each, so a long beat is gathered in parts; its prose is one value. Beats without clauses have no row.
    """
    said = clauses.groupBy(*by).agg(F.count("*").alias("clauses")) if by else clauses.agg(F.count("*").alias("clauses"))
    sentences = beat_sentences(clauses, by).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "sentence"))), lambda s: s.sentence), " ").alias("prose"))
    return said.join(sentences, by) if by else said.crossJoin(sentences)


def render_beat(clauses: DataFrame) -> DataFrame:
    """One row of prose from the clauses (position, place_name, text, cite_ns) of one beat."""
    return render_beats(clauses, []).select("prose")
