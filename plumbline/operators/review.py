"""Reviews: imports that are taken whole or not at all, revisions that are only added, queues, gold and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.identity import stable_id

# fixed values: decisions of a reviewer, and boundaries of a log at which evidence counts
DECISIONS = ("confirmed", "rejected", "needs_more_evidence")
BOUNDARIES = ("call_argument", "log_record", "formatted_output")
WEAK_RELATIONS = ("type", "schema", "type_schema", "type_relation", "possible")


def check_reviews(rows: DataFrame, candidates: DataFrame, decisions: tuple[str, ...] = DECISIONS) -> DataFrame:
    """rows (line, case_id, status, decision, reviewer, notes) with digest, the case's evidence, and state: pending,
    accepted, duplicate, or the code of what is wrong. candidates has case_id and digest, each case once.

    Rows of one case that agree are one review and its duplicates; those that don't are conflicts.
    """
    known = candidates.select("case_id", "digest")
    df = rows.select("line", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("case_id", "status", "decision", "reviewer", "notes")]).join(known, "case_id", "left")
    code = (
        F.when(F.col("digest").isNull(), "unknown_case_id").when(~F.col("status").isin("", "pending", "reviewed"), "invalid_review_status")
        .when(F.col("status").isin("", "pending") & (F.col("decision") == "") & (F.col("notes") == ""), "pending")
        .when(~F.col("decision").isin(*decisions), "explicit_valid_decision_required").when(F.col("status") == "pending", "pending_with_decision")
        .when(F.col("reviewer") == "", "reviewer_required")
    )
    df = df.withColumn("state", code)
    case = Window.partitionBy("case_id")
    what = F.when(F.col("state").isNull(), F.struct("decision", "reviewer", "notes"))
    kinds, nth = F.size(F.collect_set(what).over(case)), F.row_number().over(case.orderBy(F.col("state").isNotNull(), "line"))
    return df.withColumn("state", F.coalesce("state", F.when(kinds > 1, "conflicting_duplicate_case").when(nth > 1, "duplicate").otherwise("accepted")))


def append_reviews(history: DataFrame, checked: DataFrame) -> DataFrame:
    """The rows to add to history (case_id, revision, id, previous_id, decision, reviewer, notes, digest): one for each
    accepted review that says something else than its case's latest. If any row of checked is wrong there are none."""
    wrong = checked.where(~F.col("state").isin("pending", "accepted", "duplicate")).limit(1)
    fields = ["decision", "reviewer", "notes", "digest"]
    last = latest(history, ["case_id"], ["revision"]).select("case_id", F.col("revision").alias("_r"), F.col("id").alias("previous_id"), F.struct(*fields).alias("_old"))
    new = checked.where("state = 'accepted'").join(last, "case_id", "left").where(~F.struct(*fields).eqNullSafe(F.col("_old")))
    new = new.join(wrong.select(F.lit(True).alias("_bad")), F.lit(True), "left_anti")
    new = new.withColumn("revision", F.coalesce(F.col("_r") + 1, F.lit(1)))
    return new.select("case_id", "revision", stable_id(F.lit("human_review"), F.col("case_id"), F.col("revision"), *map(F.col, fields)).alias("id"), "previous_id", *fields)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what revisions come to. Rows fold by key; none is collected."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*").select(*df.columns)


def stale(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """The latest review of each case with present and stale: whether its evidence has changed since, or is gone."""
    now = candidates.select("case_id", F.col("digest").alias("_now"))
    last = latest(history, ["case_id"], ["revision"]).join(now, "case_id", "left")
    return last.withColumns({"present": F.col("_now").isNotNull(), "stale": ~F.coalesce(F.col("_now") == F.col("digest"), F.lit(False))}).drop("_now")


def disagreements(reviews: DataFrame) -> DataFrame:
    """(case_id, annotation_ids, status) of the cases whose latest reviews differ in queue or dimensions: adjudicated if
    an adjudication names all of these reviews. reviews: id, case_id, kind, slot, reviewer, recorded_at, queue,
    dimensions, annotation_ids."""
    human = latest(reviews.where("kind = 'human'").select("id", "case_id", "slot", "reviewer", "recorded_at", "queue", "dimensions"), ["case_id", "slot", "reviewer"], ["recorded_at", "id"])
    split = human.groupBy("case_id").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count_distinct(F.to_json(F.struct("queue", "dimensions"))).alias("n")).where("n > 1")
    judged = reviews.where("kind = 'adjudication'").select("case_id", F.col("annotation_ids").alias("named"))
    met = split.join(judged, "case_id", "left").groupBy("case_id", "ids").agg(F.bool_or(F.size(F.array_except("ids", "named")) == 0).alias("done"))
    return met.select("case_id", F.col("ids").alias("annotation_ids"), F.when(F.coalesce("done", F.lit(False)), "adjudicated").otherwise("pending_adjudication").alias("status"))


def gold(reviews: DataFrame) -> DataFrame:
    """(case_id, queue) where two independent reviewers, one in each slot, agree on A or C, or a third one has decided."""
    human = latest(reviews.where("kind = 'human'").select("id", "case_id", "slot", "reviewer", "recorded_at", "queue", "dimensions"), ["case_id", "slot", "reviewer"], ["recorded_at", "id"])
    per = human.groupBy("case_id").agg(
        F.collect_set("reviewer").alias("who"), F.sort_array(F.collect_set("slot")).alias("slots"), F.collect_list("id").alias("ids"), F.count_distinct(F.to_json(F.struct("queue", "dimensions"))).alias("n"), F.min("queue").alias("agreed")
    )
    free = per.where((F.size("who") >= 2) & (F.col("slots") == F.array(F.lit("reviewer_1"), F.lit("reviewer_2"))))
    judge = reviews.where("kind = 'adjudication'").select("case_id", F.col("reviewer").alias("judge"), F.col("annotation_ids").alias("named"), F.struct("recorded_at", "id").alias("at"), F.col("queue").alias("decided"))
    met = free.join(judge, "case_id", "left").withColumn("counts", F.coalesce((F.size(F.array_except("ids", "named")) == 0) & ~F.array_contains("who", F.col("judge")), F.lit(False)))
    out = met.groupBy("case_id", "n", "agreed").agg(F.max_by("decided", F.when(F.col("counts"), F.col("at"))).alias("decided"))
    return out.select("case_id", F.coalesce("decided", F.when(F.col("n") == 1, F.col("agreed"))).alias("queue")).where("queue IN ('A', 'C')")


def review_metrics(cases: DataFrame, predictions: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: declared and gold cases, and tp, fp, fn, tn, precision, recall, accuracy and f1 of queue A, which are
    null until every case has gold and a prediction."""
    all_ = cases.select("case_id").distinct().join(gold(reviews).withColumnRenamed("queue", "g"), "case_id", "left").join(predictions.select("case_id", F.col("queue").alias("p")), "case_id", "left")
    c = all_.agg(
        F.count("*").alias("declared"), F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count_if((F.col("p") == "A") & (F.col("g") == "A")).alias("tp"),
        F.count_if((F.col("p") == "A") & (F.col("g") == "C")).alias("fp"), F.count_if((F.col("p") != "A") & (F.col("g") == "A")).alias("fn"), F.count_if((F.col("p") != "A") & (F.col("g") == "C")).alias("tn"),
    )
    whole = (F.col("declared") > 0) & (F.col("gold") == F.col("declared")) & (F.col("predicted") == F.col("declared"))
    over = lambda a, b: F.when(whole & (b > 0), a / b)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    counts = {k: F.when(whole, F.col(k)) for k in ("tp", "fp", "fn", "tn")}
    rates = {"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "accuracy": over(tp + tn, F.col("gold")), "f1": over(2 * tp, 2 * tp + fp + fn)}
    return c.select("declared", "gold", F.when(whole, "evaluated_declared_sample").otherwise("pending_human_evaluation").alias("status"), *[v.alias(k) for k, v in (counts | rates).items()])


def detection_metrics(files: DataFrame, predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision and recall of log calls, null until each file has two agreeing enumerations by two
    people and a prediction. files: file_id; predictions: file_id, anchors; annotations: file_id, reviewer, slot,
    complete, anchors; anchors are arrays of structs or texts without repeats."""
    per = annotations.where("complete").groupBy("file_id").agg(
        F.count("*").alias("n"), F.count_distinct("reviewer").alias("r"), F.count_distinct("slot").alias("s"), F.collect_set(F.array_sort("anchors")).alias("sets")
    )
    good = per.where("n = 2 AND r = 2 AND s = 2").where(F.size("sets") == 1).select("file_id", F.col("sets")[0].alias("want"))
    df = files.select("file_id").distinct().join(good, "file_id", "left").join(predictions.select("file_id", F.col("anchors").alias("have")), "file_id", "left")
    c = df.agg(
        F.count("*").alias("declared"), F.count("want").alias("audited"), F.count("have").alias("predicted"), F.sum(F.size(F.array_intersect("have", "want"))).alias("tp"),
        F.sum(F.size(F.array_except("have", "want"))).alias("fp"), F.sum(F.size(F.array_except("want", "have"))).alias("fn"),
    )
    whole = (F.col("declared") > 0) & (F.col("audited") == F.col("declared")) & (F.col("predicted") == F.col("declared"))
    over = lambda b: F.when(whole & (b > 0), F.col("tp") / b)
    return c.select("declared", "audited", *[F.when(whole, F.col(k)).alias(k) for k in ("tp", "fp", "fn")], over(F.col("tp") + F.col("fp")).alias("precision"), over(F.col("tp") + F.col("fn")).alias("recall"))


def queue(d: Column) -> Column:
    """The queue of a unit's dimensions: A where a path by itself is supported, B where there is a clue without all
    evidence, C where the checks are complete and clean, D otherwise. An analysis that failed is never C.

    d is a struct: paths (array of structs source, output, connected, understood, relation, evidence, unknowns, boundary,
    boundary_status), unknowns, evidence, clues (array of structs text, evidence), source, output, connection,
    connection_reason, complete, processed, clean_basis, boundary, boundary_status.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    hint = lambda c: yes(c.isin("supported", "suspected"))
    whole = lambda p: yes(
        (p["source"] == "supported") & (p["output"] == "supported") & p["connected"] & p["understood"] & ~yes(p["relation"].isin(*WEAK_RELATIONS)) & some(p["evidence"]) & ~some(p["unknowns"])
        & F.coalesce(p["boundary"], d["boundary"]).isin(*BOUNDARIES) & (F.coalesce(p["boundary_status"], d["boundary_status"]) == "supported")
    )
    clue = yes(F.exists(d["clues"], lambda c: some(c["evidence"]) | ((c["text"] != "") & some(d["evidence"])))) | (some(d["evidence"]) & (hint(d["source"]) | hint(d["output"])))
    clue |= yes(F.exists(d["paths"], lambda p: some(p["evidence"]) & (hint(p["source"]) | hint(p["output"]))))
    excluded = (d["connection"] == "not_established") & (d["connection_reason"] == "target_connection_excluded")
    clean = yes(d["complete"]) & yes(d["processed"].isin("success", "succeeded", "processed", "complete")) & ~some(d["unknowns"]) & ~yes(F.exists(d["paths"], lambda p: some(p["unknowns"])))
    clean &= some(d["evidence"]) & some(d["clean_basis"]) & yes(d["boundary_status"] == "supported") & (yes(d["output"] == "not_found") | yes(excluded))
    a = ~some(d["unknowns"]) & yes(F.exists(d["paths"], whole))
    return F.when(a, "A").when(clue & ~clean, "B").when(clean, "C").otherwise("D")


def blind(df: DataFrame, columns: list[str]) -> DataFrame:
    """The allowed columns alone, with case_sha256, the digest of what is shown: no label, origin or later fix is."""
    return df.select(*columns).withColumn("case_sha256", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def pending_runs(cases: DataFrame, variants: tuple[str, ...], attempts: DataFrame) -> DataFrame:
    """(case_id, variant, attempt): every case under every variant that no attempt has completed, with the number of
    the next attempt. attempts: case_id, variant, attempt, status; interrupted ones stay on record."""
    want = cases.select("case_id").distinct().withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    done = attempts.groupBy("case_id", "variant").agg(F.max("attempt").alias("last"), F.bool_or(F.col("status") == "complete").alias("done"))
    return want.join(done, ["case_id", "variant"], "left").where("NOT coalesce(done, false)").select("case_id", "variant", F.coalesce(F.col("last") + 1, F.lit(1)).alias("attempt"))


def migrations(results: DataFrame, a: str, b: str) -> DataFrame:
    """(from_queue, to_queue, n) of the cases between two variants; a side that is missing is null, and counted."""
    wide = results.groupBy("case_id").agg(F.max(F.when(F.col("variant") == a, F.col("queue"))).alias("from_queue"), F.max(F.when(F.col("variant") == b, F.col("queue"))).alias("to_queue"))
    return wide.groupBy("from_queue", "to_queue").agg(F.count("*").alias("n"))


def ledger(files: DataFrame) -> DataFrame:
    """(repository, sha, status, files) of commits by their files' statuses: failed before partial before complete."""
    per = files.groupBy("repository", "sha").agg(F.count("*").alias("files"), F.collect_set("status").alias("s"))
    has = lambda *words: F.arrays_overlap("s", F.array(*[F.lit(w) for w in words]))
    return per.select("repository", "sha", F.when(has("failed", "error"), "failed").when(has("partial", "skipped", "pending"), "partial").otherwise("complete").alias("status"), "files")


def apply_answers(rows: DataFrame, answers: DataFrame, field: str, unknown: str = "unknown") -> DataFrame:
    """rows with adjudicated answers (case_id, answer, digest) in place of unknown values of field, where the evidence
    (digest) is still the one that was answered; other values stay."""
    own = answers.groupBy("case_id", "digest").agg(F.min("answer").alias("_a"), F.count_distinct("answer").alias("_n")).where("_n = 1").drop("_n")
    out = rows.join(own, ["case_id", "digest"], "left")
    return out.withColumn(field, F.when((F.col(field) == unknown) & F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col(field))).select(*rows.columns)


def job_queue(contexts: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """(repository, sha, contexts, state): one job for each valid commit; pending unless done (repository, sha, status)
    says complete or blocked; what was running when it stopped is pending again, and so are failures with retry."""
    good = contexts.where(F.col("repository").rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & F.lower("sha").rlike(r"^([0-9a-f]{40}|[0-9a-f]{64})$"))
    jobs = good.groupBy("repository", F.lower("sha").alias("sha")).agg(F.count_distinct("context_id").alias("contexts"))
    state = F.when(F.col("status").isin("complete", "blocked"), F.col("status")).when((F.col("status") == "partial") & F.lit(not retry_failed), "partial").otherwise("pending")
    return jobs.join(done.select("repository", "sha", "status"), ["repository", "sha"], "left").select("repository", "sha", "contexts", state.alias("state"))
