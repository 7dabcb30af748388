"""Folding the append-only decision journal into states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.functions.text import nonblank

# The vocabulary of the journal, stage and its decisions.
VOCABULARY = {
    "dedup": ("merge",),
    "screen_title_abstract": ("include", "exclude", "needs_manual"),
    "human_review": ("include", "exclude"),
    "screen_manual": ("include", "exclude"),
    "fulltext": ("retrieved", "retrieval_failed", "include", "needs_manual"),
    "screen_fulltext": ("include", "exclude", "needs_manual"),
    "human_review_fulltext": ("include", "exclude"),
    "extract": ("extracted", "not_found", "api_error", "rejected_citation", "citation_retry", "include", "needs_manual"),
}
HUMAN_SCREEN, MACHINE_SCREEN = ("human_review", "screen_manual"), ("screen_title_abstract",)
HUMAN_FULLTEXT, MACHINE_FULLTEXT = ("human_review_fulltext",), ("screen_fulltext",)
FINAL = ("include", "exclude")

# What comes after each stage; "?" asks whether the queue is empty.
NEXT_ACTION = {
    "protocol_done": ("search", "search"),
    "search_done": ("dedup", "dedup"),
    "dedup_done": ("screen", "screen"),
    "screen_done": ("review", "fulltext"),
    "review_done": ("fulltext", "fulltext"),
    "fulltext_done": ("screen-fulltext", "screen-fulltext"),
    "screen_fulltext_done": ("review-fulltext", "extract"),
    "review_fulltext_done": ("extract", "extract"),
    "extract_done": ("report", "report"),
    "report_done": ("finished", "finished"),
}
#: The stage of a review after journal lines of a stage.
STAGE_DONE = {
    "dedup": "dedup_done", "screen_title_abstract": "screen_done", "human_review": "review_done", "screen_manual": "review_done", "fulltext": "fulltext_done",
    "screen_fulltext": "screen_fulltext_done", "human_review_fulltext": "review_fulltext_done", "extract": "extract_done",
}


def known_entry() -> Column:
    """Whether stage and decision are in the vocabulary."""
    cond = F.lit(False)
    for stage, decisions in VOCABULARY.items():
        cond = cond | ((F.col("stage") == stage) & F.col("decision").isin(*decisions))
    return F.coalesce(cond, F.lit(False))


def entries(journal: DataFrame, known_only: bool = True) -> DataFrame:
    """The lines with a document, which is stripped, and the kind of its identity (``doi`` if not named)."""
    out = journal.withColumn("doc", nonblank("doc")).withColumn("identity_type", F.coalesce(nonblank("identity_type"), F.lit("doi"))).filter("doc is not null")
    return out.filter(known_entry()) if known_only else out


def unknown_entries(journal: DataFrame) -> DataFrame:
    """``stage, decision, lines`` of lines outside the vocabulary: counted, never applied."""
    return journal.filter(~known_entry()).groupBy("stage", "decision").agg(F.count(F.lit(1)).alias("lines"))


def resolve(journal: DataFrame, machine: tuple[str, ...], human: tuple[str, ...], machine_decisions: tuple[str, ...] = FINAL, known_only: bool = True) -> DataFrame:
    """``identity_type, doc, decision, resolved_by, decided_seq, first_seq``: the last human decision, else the last machine one.

    A human decision outranks a machine one whatever the order. One aggregation with a combined maximum per document, so the lines of a hot
    document meet before the shuffle. Documents without either decision give no row.
    """
    lines = entries(journal, known_only)
    is_human = F.col("stage").isin(*human) & F.col("decision").isin(*FINAL)
    is_machine = F.col("stage").isin(*machine) & F.col("decision").isin(*machine_decisions)
    one = lines.filter(is_human | is_machine).groupBy("identity_type", "doc").agg(
        F.max(F.when(is_human, F.struct("seq", "decision"))).alias("h"),
        F.max(F.when(is_machine, F.struct("seq", "decision"))).alias("m"),
        F.min("seq").alias("first_seq"),
    )
    return one.select(
        "identity_type",
        "doc",
        F.coalesce("h.decision", "m.decision").alias("decision"),
        F.when(F.col("h").isNotNull(), "human").otherwise("machine").alias("resolved_by"),
        F.coalesce("h.seq", "m.seq").alias("decided_seq"),
        "first_seq",
    )


def resolve_screening(journal: DataFrame) -> DataFrame:
    """Title and abstract screening; a later ``needs_manual`` of a machine does not undo its earlier decision."""
    return resolve(journal, MACHINE_SCREEN, HUMAN_SCREEN)


def resolve_eligibility(journal: DataFrame) -> DataFrame:
    """Full-text screening; a later ``needs_manual`` of a machine counts."""
    return resolve(journal, MACHINE_FULLTEXT, HUMAN_FULLTEXT, ("include", "exclude", "needs_manual"))


def latest_fulltext(journal: DataFrame) -> DataFrame:
    """``identity_type, doc, decision, seq`` of the last full-text line, kept if it is ``retrieved`` or ``include``: the latest wins even if it is a failure."""
    lines = entries(journal).filter("stage = 'fulltext'")
    last = lines.groupBy("identity_type", "doc").agg(F.max(F.struct("seq", "decision")).alias("x"))
    return last.select("identity_type", "doc", "x.decision", "x.seq").filter(F.col("decision").isin("retrieved", "include"))


def latest_human(journal: DataFrame, stages: tuple[str, ...] = HUMAN_SCREEN + HUMAN_FULLTEXT) -> DataFrame:
    """``identity_type, doc, decision, seq`` of the last human decision."""
    lines = entries(journal, False).filter(F.col("stage").isin(*stages) & F.col("decision").isin(*FINAL))
    last = lines.groupBy("identity_type", "doc").agg(F.max(F.struct("seq", "decision")).alias("x"))
    return last.select("identity_type", "doc", "x.decision", "x.seq")


def review_queue(journal: DataFrame, machine: tuple[str, ...] = MACHINE_SCREEN, human: tuple[str, ...] = HUMAN_SCREEN) -> DataFrame:
    """``identity_type, doc, score, seq``: documents whose last machine line needs a human and that no human has decided."""
    lines = entries(journal)
    last = lines.filter(F.col("stage").isin(*machine)).groupBy("identity_type", "doc").agg(F.max(F.struct("seq", "decision", "score")).alias("x"))
    decided = lines.filter(F.col("stage").isin(*human) & F.col("decision").isin(*FINAL)).select("identity_type", "doc").distinct()
    return last.filter("x.decision = 'needs_manual'").select("identity_type", "doc", "x.score", "x.seq").join(decided, ["identity_type", "doc"], "left_anti")


def replayed_decisions(journal: DataFrame, block: int = 100_000) -> DataFrame:
    """``seq, identity_type, doc, stage, decision`` of human lines that repeat the decision before them: replays to be ignored.

    The line before is found within blocks of the journal, and across blocks from the last line of each block, so that
    the lines of a hot document never come into one task.
    """
    human = HUMAN_SCREEN + HUMAN_FULLTEXT
    lines = entries(journal).filter(F.col("stage").isin(*human)).select("seq", "identity_type", "doc", "stage", "decision", F.floor(F.col("seq") / block).alias("blk"))
    keys = ["identity_type", "doc", "stage"]
    inside = lines.withColumn("before", F.lag("decision").over(W.partitionBy(*keys, "blk").orderBy("seq")))
    ends = lines.groupBy(*keys, "blk").agg(F.max(F.struct("seq", "decision")).alias("x"))
    carried = ends.select(*keys, "blk", F.lag("x.decision").over(W.partitionBy(*keys).orderBy("blk")).alias("carried"))
    known = inside.join(carried, [*keys, "blk"])
    return known.filter(F.coalesce("before", "carried") == F.col("decision")).select("seq", "identity_type", "doc", "stage", "decision")


def decision_counts(journal: DataFrame) -> DataFrame:
    """``stage, include_n, exclude_n, needs_manual_n, other_n`` per stage of known lines."""
    d = F.col("decision")
    return entries(journal).groupBy("stage").agg(
        F.count_if(d == "include").alias("include_n"), F.count_if(d == "exclude").alias("exclude_n"), F.count_if(d == "needs_manual").alias("needs_manual_n"), F.count_if(~d.isin("include", "exclude", "needs_manual")).alias("other_n")
    )


def served_models(journal: DataFrame) -> DataFrame:
    """``stage, models``: the distinct models that served each stage, sorted and joined by commas."""
    named = journal.select("stage", nonblank("model_served").alias("m")).filter("m is not null")
    return named.groupBy("stage").agg(F.array_join(F.array_sort(F.collect_set("m")), ", ").alias("models"))


def next_actions(journal: DataFrame) -> DataFrame:
    """``run, last_stage, queue, action``: what each run does next, from its last known line and whether its queue is empty."""
    lines = entries(journal)
    last = lines.groupBy("run").agg(F.max(F.struct("seq", "stage")).alias("x"))
    keys = ["run", "identity_type", "doc"]
    per_doc = lines.filter(F.col("stage").isin(*MACHINE_SCREEN, *HUMAN_SCREEN)).groupBy(*keys).agg(
        F.max(F.when(F.col("stage").isin(*MACHINE_SCREEN), F.struct("seq", "decision"))).alias("m"), F.count_if(F.col("stage").isin(*HUMAN_SCREEN)).alias("h")
    )
    queue = per_doc.groupBy("run").agg(F.count_if((F.col("m.decision") == "needs_manual") & (F.col("h") == 0)).alias("queue"))
    done = F.create_map(*[F.lit(x) for kv in STAGE_DONE.items() for x in kv])
    full = F.create_map(*[F.lit(x) for k, v in NEXT_ACTION.items() for x in (k, v[0])])
    empty = F.create_map(*[F.lit(x) for k, v in NEXT_ACTION.items() for x in (k, v[1])])
    state = last.join(queue, "run", "left").select("run", done[F.col("x.stage")].alias("last_stage"), F.coalesce("queue", F.lit(0)).alias("queue"))
    return state.select("run", "last_stage", "queue", F.when(F.col("queue") > 0, full[F.col("last_stage")]).otherwise(empty[F.col("last_stage")]).alias("action"))


def final_exclusions(journal: DataFrame) -> DataFrame:
    """Documents whose full-text screening ends in exclusion, with the criterion and reason of the deciding line."""
    out = resolve_eligibility(journal).filter("decision = 'exclude'")
    why = journal.select(F.col("seq").alias("decided_seq"), nonblank("criterion").alias("criterion"), nonblank("reason").alias("reason"))
    return out.join(why, "decided_seq").select("identity_type", "doc", "resolved_by", "criterion", "reason")


def flow(journal: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of flow counters derived from the journal and the candidates; differences never go below zero."""
    screen = resolve_screening(journal).agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.col("decision") == "include").alias("included"))
    pending = review_queue(journal).agg(F.count(F.lit(1)).alias("pending"))
    got = latest_fulltext(journal).agg(F.count(F.lit(1)).alias("retrieved"))
    final = resolve_eligibility(journal).agg(F.count(F.lit(1)).alias("fulltext_screened"), F.count_if(F.col("decision") == "include").alias("included_final"))
    found = candidates.agg(F.count(F.lit(1)).alias("identified"))
    # Each side is one row.
    one = found
    for side in (screen, pending, got, final):
        one = one.withColumn("_one", F.lit(1)).join(side.withColumn("_one", F.lit(1)), "_one").drop("_one")
    zero = F.lit(0).cast("long")
    return one.select(
        "identified",
        "screened",
        "included",
        "pending",
        F.greatest(zero, F.col("screened") - F.col("included") - F.col("pending")).alias("excluded"),
        "retrieved",
        F.greatest(zero, F.col("included") - F.col("retrieved")).alias("not_retrieved"),
        "fulltext_screened",
        "included_final",
    )
