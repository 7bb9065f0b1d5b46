"""Histories of log calls: ancestry, origins, integration, change labels, follow-ups and what they add up to.

An entity is a struct with path, symbol, identity, level, statement, template, conditions, behavior, assessment,
sanitized and sources (an array of source and types); arrays are sorted. What is not established is null or unknown.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize, release

# fixed values: kinds of evidence that bind a commit to who made it, and accounts of automation
STRONG = ("platform_commit_binding", "local_session_commit_binding", "human_authorship_review", "automation_platform_binding")
ACTORS = ("agent", "human_led", "mixed", "automation_non_agent")
ROBOTS = ("dependabot[bot]", "renovate[bot]", "github-actions[bot]", "pre-commit-ci[bot]")
MITIGATES = ("eliminates_observed_flow", "partial", "mitigates_under_condition")


def ancestors(commits: DataFrame, of: DataFrame, repo: str = "repository_id") -> DataFrame:
    """(repo, sha, ancestor): every commit that the commits of `of` (repo, sha) descend from, themselves included.

    commits has repo, sha and parents. Each round steps one generation back from what is new, and is written; only
    whether anything is new reaches the driver. A parent that is not there is an ancestor without parents.
    """
    up = commits.select(repo, F.col("sha").alias("ancestor"), F.explode("parents").alias("parent"))
    new = materialize(of.select(repo, "sha").distinct().withColumn("ancestor", F.col("sha")), "ancestors")
    seen = new
    while not new.isEmpty():
        step = new.join(up, [repo, "ancestor"]).select(repo, "sha", F.col("parent").alias("ancestor")).distinct()
        new = materialize(step.join(seen, [repo, "sha", "ancestor"], "left_anti"), "generation")
        seen = seen.unionByName(new)
    return seen


def first_integration(introductions: DataFrame, chain: DataFrame, closure: DataFrame, repo: str = "repository_id") -> DataFrame:
    """(repo, sha, integration): the first commit of the chain (repo, sha, position) that holds an introduction (repo, sha);
    closure are the ancestors of the chain's commits."""
    on_chain = closure.join(chain, [repo, "sha"]).select(repo, F.col("sha").alias("at"), "position", F.col("ancestor").alias("sha"))
    return introductions.select(repo, "sha").distinct().join(on_chain, [repo, "sha"]).groupBy(repo, "sha").agg(F.min_by("at", "position").alias("integration"))


def earliest_integration(commits: DataFrame, chain: DataFrame, repo: str = "repository_id") -> DataFrame:
    """(repo, sha, position, integration): for every commit the first commit of the chain (repo, sha, position) that is it
    or descends from it; commits that none holds have no row. Neither pairs nor generations are gone through.

    commits have repo, sha and parents. Every commit passes the smallest position it knows to its first parent, then to
    that one's own and so on, over twice as many steps each time, so that a line of n commits takes log n rounds. Then
    positions go one step along the other parents of merges; as long as one of these changes anything, first parents
    have their turn again, as often as merges lie within merges. A round is a join and an aggregation over the commits.

    A parent without a row is a commit without parents. Null parents are none; a sha stands for one commit of its
    repository. An empty chain or table: no rows.
    """
    spark, key = commits.sparkSession, [repo, "sha"]
    rows = commits.select(repo, "sha", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    lost = rows.select(repo, F.explode("parents").alias("sha")).distinct().join(rows.select(*key), key, "left_anti")
    nodes = rows.select(repo, "sha", F.get("parents", F.lit(0)).alias("first")).unionByName(lost.withColumn("first", F.lit(None).cast("string")))
    place = chain.groupBy(*key).agg(F.min("position").alias("v"))
    nodes = materialize(nodes.join(place, key, "left"), "commits")
    merges = materialize(rows.select(repo, "sha", F.explode(F.slice("parents", 2, 1 << 20)).alias("to")), "merges")

    def passed(of: DataFrame, to: str) -> DataFrame:
        return of.where(F.col("v").isNotNull() & F.col(to).isNotNull()).groupBy(repo, F.col(to).alias("sha")).agg(F.min("v").alias("w"))

    while True:
        state, lines = nodes.withColumn("to", F.col("first")), []
        while True:
            far = state.select(repo, F.col("sha").alias("to"), F.col("to").alias("next")).where("next IS NOT NULL")
            step = state.join(passed(state, "to"), key, "left").join(far, [repo, "to"], "left")
            state = materialize(step.select(repo, "sha", "first", F.least("v", "w").alias("v"), F.col("next").alias("to")), "positions")
            release(spark, *lines)
            lines = [state]
            if state.where("to IS NOT NULL").isEmpty():
                break
        told = passed(merges.join(state.select(repo, "sha", "v"), key), "to")
        nodes = materialize(state.drop("to").join(told, key, "left").withColumn("moved", F.coalesce(F.col("w") < F.coalesce("v", F.col("w") + 1), F.lit(False))).withColumn("v", F.least("v", "w")), "commits")
        release(spark, *lines)
        if nodes.where("moved").isEmpty():
            break
        nodes = nodes.select(repo, "sha", "first", "v")
    at = chain.groupBy(repo, F.col("position").alias("v")).agg(F.min("sha").alias("integration"))
    return nodes.where("v IS NOT NULL").join(at, [repo, "v"]).select(repo, "sha", F.col("v").alias("position"), "integration")


def sensitive(entity: Column) -> Column:
    """The distinct (source, types) of an entity's supported flows."""
    own = F.filter(entity["sources"], lambda s: F.size(s["types"]) > 0)
    return F.when(entity["assessment"] == "supported", F.array_distinct(own)).otherwise(F.slice(own, 1, 0))


def _less(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_except(F.coalesce(a, F.array_except(b, b)), F.coalesce(b, F.array_except(a, a)))), F.lit(0))


def introduction_relation(before: Column, after: Column) -> Column:
    """new_sensitive_flow, expanded_sensitive_flow, preexisting_unchanged or unknown."""
    old, new = F.coalesce(F.size(sensitive(before)), F.lit(0)), F.coalesce(F.size(sensitive(after)), F.lit(0))
    old, new = F.greatest(old, F.lit(0)), F.greatest(new, F.lit(0))
    grown = _less(sensitive(after), sensitive(before))
    return F.when((new > 0) & (old == 0), "new_sensitive_flow").when((old > 0) & (grown > 0), "expanded_sensitive_flow").when(old > 0, "preexisting_unchanged").otherwise("unknown")


def change_labels(before: Column, after: Column, kind: Column, relation: Column) -> Column:
    """{labels, effect} of a change of an entity: what it did, and what that did to the flows observed before."""
    old, new = sensitive(before), sensitive(after)
    n_old, n_new = F.greatest(F.coalesce(F.size(old), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size(new), F.lit(0)), F.lit(0))
    lost = (n_old > 0) & (_less(old, new) > 0)
    leveled = ~before["level"].eqNullSafe(after["level"]) | ~before["conditions"].eqNullSafe(after["conditions"])
    moved = (kind == "moved") | (before["path"] != after["path"])
    tags = F.filter(
        F.array(
            F.when(leveled, F.lit("level_or_condition_change")), F.when(moved, F.lit("refactor_or_move")), F.when(lost & after["sanitized"], F.lit("add_redaction")),
            F.when(lost, F.when(relation == "dependency_change", "fix_shared_sanitizer").otherwise("remove_sensitive_field")),
        ),
        lambda x: x.isNotNull(),
    )
    plain = F.when(before["statement"] != after["statement"], F.array(F.lit("message_or_format"))).otherwise(F.array(F.lit("unclear")))
    labels = F.when(after.isNull(), F.array(F.lit("delete_feature"))).when(before.isNull(), F.array(F.lit("unclear"))).when(F.size(tags) > 0, tags).otherwise(plain)
    of_lost = F.when((after["assessment"] == "not_supported") & (n_new == 0), "eliminates_observed_flow").when((after["assessment"] == "supported") & (n_new > 0), "partial").otherwise("unknown")
    unsure = F.when(F.size(tags) > 0, leveled & (n_old > 0)).otherwise(n_old > 0)
    effect = F.when(after.isNull() | before.isNull(), "unknown").when(lost, of_lost).when(unsure, "unknown").otherwise("not_privacy_related")
    return F.struct(labels.alias("labels"), effect.alias("effect"))


def integration_mapping(merge: Column, merge_on_chain: Column, direct: Column, reachable: Column, by_ancestry: Column, sha: Column) -> Column:
    """{sha, mapping}: the commit that brought an introduction to its target, and how it was found."""
    out = F.when(merge_on_chain, F.struct(merge.alias("sha"), F.lit("metadata_integration_sha").alias("mapping")))
    out = out.when(direct, F.struct(sha.alias("sha"), F.lit("direct_target_commit").alias("mapping")))
    out = out.when(reachable, F.struct(by_ancestry.alias("sha"), F.lit("ancestry_to_first_parent_integration").alias("mapping")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("sha"), F.lit("unknown").alias("mapping")))


def observation(integrated: Column, cutoff: Column, days: int) -> Column:
    """{start, end, days}: the window from the integration to the cutoff, `days` long at most; days null without a start."""
    end = F.when(integrated.isNull(), cutoff).otherwise(F.least(cutoff, integrated + F.expr(f"INTERVAL {int(days)} DAYS")))
    observed = F.when(integrated.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(integrated)) / 86_400e6))
    return F.struct(integrated.alias("start"), end.alias("end"), observed.alias("days"))


def censoring_reason(history_gap: Column, integration: Column, start: Column, observed: Column, days: int, local_only: Column, synthetic: Column) -> Column:
    """Why an observation is not complete, null if it is: the first of the reasons."""
    return (
        F.when(history_gap, "history_incomplete").when(integration.isNull(), "not_integrated").when(start.isNull(), "integration_time_unknown")
        .when(observed < days, "right_censored").when(local_only & ~synthetic, "remote_collection_cutoff_unverified")
    )


def classify_actor(sha: Column, evidence: Column, login: Column, message: Column, author: Column, label: Column) -> Column:
    """{actor, confidence} of a commit: verified evidence for this very commit alone decides, mixed if it disagrees; a
    known automation account is medium; labels, trailers and names are clues and leave the actor unknown.

    evidence is an array of structs with kind, actor_type, commit_sha, evidence_ref and verified.
    """
    strong = F.filter(evidence, lambda e: e["kind"].isin(*STRONG) & e["actor_type"].isin(*ACTORS) & (e["commit_sha"] == sha) & e["evidence_ref"].isNotNull() & e["verified"])
    actors = F.coalesce(F.array_distinct(F.transform(strong, lambda e: e["actor_type"])), F.array().cast("array<string>"))
    robot = F.coalesce(login.isin(*ROBOTS), F.lit(False))
    clue = F.coalesce(F.size(evidence) > 0, F.lit(False)) | F.coalesce(message.rlike(r"(?im)^Co-authored-by:\s*\S"), F.lit(False)) | F.coalesce(author.rlike("(?i)bot|codex|agent|copilot|claude"), F.lit(False)) | label.isNotNull()
    actor = F.when(F.size(actors) == 1, actors[0]).when(F.size(actors) > 1, "mixed").when(robot, "automation_non_agent").otherwise("unknown")
    confidence = F.when(F.size(actors) > 0, "high").when(robot, "medium").when(clue, "low").otherwise("unknown")
    return F.struct(actor.alias("actor"), confidence.alias("confidence"))


def binding_grade(s: dict[str, Column], p: dict[str, Column]) -> Column:
    """{grade, status, failures} of a session for a pull request: A by commit or tree, B by the exact patch, C by the
    account alone, D without evidence. A failure ends A and B.

    s has session_repo, base, commit, tree, patch, content, pr_key, url, created, clean_base, dirty, made_commit,
    whole_chain, accounted, coverage, in_base, claims_exact; p has repo, base, head, tree, patch, content, key, url,
    committed, candidate.
    """
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    commit, tree = same(s["commit"], p["head"]), same(s["tree"], p["tree"])
    bound = same(s["pr_key"], p["key"]) | same(s["url"], p["url"]) | commit
    whole = yes(s["accounted"]) | yes(s["coverage"] == 1.0)
    patch, content = same(s["patch"], p["patch"]), same(s["content"], p["content"])
    failures = F.filter(
        F.array(*[F.when(c, F.lit(name)) for name, c in (
            ("repository_mismatch", differ(s["session_repo"], p["repo"])), ("base_mismatch", differ(s["base"], p["base"])),
            ("session_artifact_created_after_pr_head", yes(s["created"] > p["committed"])), ("unaccounted_pre_session_worktree_changes", yes(s["dirty"])),
            ("claimed_added_line_already_present_in_base", yes(s["in_base"])), ("hash_or_patch_mismatch_for_claimed_exact_binding", yes(s["claims_exact"]) & differ(s["patch"], p["patch"])),
            ("incomplete_pr_commit_chain", commit & yes(s["made_commit"]) & ~yes(s["whole_chain"])), ("incomplete_changed_path_coverage", tree & bound & ~whole),
        )]),
        lambda x: x.isNotNull(),
    )
    common = (F.size(failures) == 0) & same(s["session_repo"], p["repo"]) & same(s["base"], p["base"]) & yes(s["created"] <= p["committed"]) & yes(s["clean_base"]) & yes(~s["dirty"])
    grade = F.when(common & ((commit & yes(s["made_commit"]) & yes(s["whole_chain"])) | (tree & bound & whole)), "A").when(common & bound & (patch | content), "B").when(yes(p["candidate"]), "C").otherwise("D")
    of = {"A": "high_confidence_commit_or_tree", "B": "high_confidence_exact_patch", "C": "github_app_candidate_only", "D": "insufficient_evidence"}
    status = F.when(F.size(failures) > 0, "hard_failure").otherwise(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[grade])
    return F.struct(grade.alias("grade"), status.alias("status"), failures.alias("failures"))


TRACE = "case_id string, event_id string, sha string, phase string, labels array<string>, effect string, confidence string, ambiguous boolean, position int"


def trace(cases: DataFrame, events: DataFrame) -> DataFrame:
    """TRACE rows: the follow-ups of every case, by a walk over its events in order.

    cases: (case_id, repo, entity, mapped, integration_order, ambiguous); entity and mapped are keys of the entity where
    it began and where it was integrated. events: (case_id, event_id, sha, order, post, before, after, before_behavior,
    after_behavior, match_status, labels, effect, kind); before and after are such keys, null where there is none, and
    post says that the event is on the target after the integration. The walk carries the entity from event to event:
    it goes over to the integrated one at the first event after the integration, doubt once seen stays, and a gap
    tells nothing of what happened in it. The events of a case are one group.
    """

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "event_id"])
        first = pdf.iloc[0]
        current, behavior, doubt, switched, out = first.entity, first.entity_behavior, bool(first.ambiguous), False, []
        for e in pdf.itertuples():
            if e.post and not switched:
                current, behavior, switched = e.mapped, e.mapped_behavior, True
            if current is None or e.before is None:
                continue
            exact = e.before == current
            likely = (doubt or e.match_status == "ambiguous") and e.before_place == (current or "").rsplit("|", 1)[0]
            if not exact and not likely:
                continue
            doubt = doubt or behavior != e.before_behavior or e.match_status == "ambiguous" or not exact
            gap = e.kind in ("coverage_gap", "gap_resumed")
            sure = not doubt and not gap
            labels = [e.kind] if gap else list(e.labels)
            out.append((first.case_id, e.event_id, e.sha, "post_merge" if e.post else "pre_merge", labels, e.effect if sure else "unknown", "supported" if sure else "possible", doubt, len(out)))
            if sure or (e.kind == "gap_resumed" and e.match_status != "ambiguous"):
                current, behavior = e.after, e.after_behavior
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRACE.split(", ")])

    rows = events.join(cases.select("case_id", "entity", "entity_behavior", "mapped", "mapped_behavior", "ambiguous"), "case_id")
    return rows.groupBy("case_id").applyInPandas(walk, TRACE)


def assessed(cases: DataFrame, followups: DataFrame) -> DataFrame:
    """cases with first_mitigation, repairs, bucket and priority.

    cases: case_id, risk, extraction_status, censoring_reason, ambiguous, has_gap, introduced (whether a sensitive flow
    was), lexical_only, actor, confidence. Buckets are told in order; what data does not show is never a repair.
    """
    repair = F.col("effect").isin(*MITIGATES)
    per = followups.groupBy("case_id").agg(
        F.min_by("sha", F.when(repair, F.col("position"))).alias("first_mitigation"), F.count_if(repair).alias("repairs"), F.count("*").alias("followups"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.max_by("effect", F.when(repair, F.col("position"))).alias("last_effect"),
    )
    df = cases.join(per, "case_id", "left").withColumns({"repairs": F.coalesce("repairs", F.lit(0)), "followups": F.coalesce("followups", F.lit(0))})
    risk = F.col("risk")
    bucket = (
        F.when((F.col("extraction_status") != "ok") | (F.col("censoring_reason") == "history_incomplete"), "BLOCKED_BY_DATA")
        .when(F.col("has_gap"), "NEEDS_CONTEXT").when(risk == "not_supported", "OUT_OF_SCOPE_OR_FALSE_POSITIVE")
        .when((risk == "supported") & (F.col("repairs") > 0) & ~F.col("ambiguous") & F.col("introduced") & ~F.col("lexical_only"), "REVIEW_READY")
        .when(risk.isin("unknown", "possible") | F.col("ambiguous"), "NEEDS_CONTEXT").otherwise("NO_OBSERVED_PRIVACY_FIX")
    )
    df = df.withColumn("bucket", bucket)
    ready = (F.col("bucket") == "REVIEW_READY") & (F.col("confidence") == "high") & (F.col("actor") != "unknown")
    priority = F.when(ready, "P1").when(risk.isin("possible", "supported"), "P2").otherwise("P3")
    return df.withColumns({"priority": priority, "candidate_without_observed_fix": risk.isin("possible", "supported") & (F.col("repairs") == 0)})


def exact_lineage(added: DataFrame, later: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, status) of added log lines (id, file, text): PRESENT_AT_CURRENT_HEAD if the file's head has the text,
    DELETED_AFTER_MERGE if a later patch removed it, MODIFIED_AFTER_MERGE if the same patch added a line in its hunk,
    UNRESOLVED otherwise. later: (file, hunk, kind, text, patch); heads: (file, text)."""
    here = heads.select("file", "text").distinct().withColumn("here", F.lit(True))
    gone = later.where("kind = 'deleted'").select("file", "text", "patch", "hunk").distinct()
    came = later.where("kind = 'added'").select("file", "patch", "hunk").distinct().withColumn("came", F.lit(True))
    lost = gone.join(came, ["file", "patch", "hunk"], "left").groupBy("file", "text").agg(F.bool_or(F.coalesce("came", F.lit(False))).alias("changed"))
    out = added.join(here, ["file", "text"], "left").join(lost, ["file", "text"], "left")
    status = F.when(F.col("here"), "PRESENT_AT_CURRENT_HEAD").when(F.col("changed"), "MODIFIED_AFTER_MERGE").when(F.col("changed").isNotNull(), "DELETED_AFTER_MERGE").otherwise("UNRESOLVED")
    return out.select("id", status.alias("status"))


def variant_change(before: Column, after: Column) -> Column:
    """What a variant of a unit did to its risk paths (arrays of path ids, null if it could not be analysed)."""
    return (
        F.when(before.isNull() | after.isNull(), "cannot_compare").when(F.size(F.array_except(after, before)) > 0, "added_risk")
        .when(F.size(F.array_except(before, after)) > 0, "removed_path").otherwise("no_relevant_change")
    )


def gap_states(states: DataFrame) -> DataFrame:
    """(repo, path, last_observed, start, end) of the intervals in which a path could not be read.

    states: (repo, path, order, sha, readable), a row for each commit that touched the path. A gap opens at the first
    unreadable row after a readable one and ends at the next readable row; end is null while it is open.
    """
    w = Window.partitionBy("repo", "path").orderBy("order")
    seen = states.withColumn("run", F.sum((F.col("readable") != F.coalesce(F.lag("readable").over(w), ~F.col("readable"))).cast("int")).over(w))
    runs = seen.groupBy("repo", "path", "run", "readable").agg(F.min_by("sha", "order").alias("first"), F.max_by("sha", "order").alias("last"))
    by_run = Window.partitionBy("repo", "path").orderBy("run")
    runs = runs.withColumns({"last_observed": F.lag("last").over(by_run), "end": F.lead("first").over(by_run)})
    return runs.where("NOT readable").select("repo", "path", "last_observed", F.col("first").alias("start"), "end")


def origins(events: DataFrame, pulls: DataFrame) -> DataFrame:
    """(pr_id, event_id, view) of the events that a pull request begins: those of its commits, and those of its merge
    that touch no entity of these. events: event_id, repo, sha, entity; pulls: pr_id, repo, commits (array), merge_sha."""
    own = pulls.select("pr_id", "repo", F.explode("commits").alias("sha")).distinct().join(events, ["repo", "sha"]).select("pr_id", "event_id", "entity", F.lit("pull_request_commit").alias("view"))
    merged = pulls.where("merge_sha IS NOT NULL").select("pr_id", "repo", F.col("merge_sha").alias("sha")).join(events, ["repo", "sha"]).select("pr_id", "event_id", "entity", F.lit("merge_resolution_or_rewrite_unattributed").alias("view"))
    more = merged.join(own.select("pr_id", "entity"), ["pr_id", "entity"], "left_anti")
    return own.select("pr_id", "event_id", "view").unionByName(more.select("pr_id", "event_id", "view"))


def reverse_candidates(commits: DataFrame, deleted: DataFrame, blame: DataFrame, words: list[str]) -> DataFrame:
    """(sha, path, old, introduced): for the commits whose message has one of the words, the log lines they delete and
    the commits that last touched them. deleted: sha, path, old, is_log; blame: sha, path, old, introduced; a line
    without blame has null."""
    fixes = commits.where(F.col("message").rlike(r"(?i)\b(?:" + "|".join(words) + r")")).select("sha").distinct()
    lines = deleted.where("is_log").select("sha", "path", "old").distinct().join(fixes, "sha", "left_semi")
    return lines.join(blame.select("sha", "path", "old", "introduced").distinct(), ["sha", "path", "old"], "left")
