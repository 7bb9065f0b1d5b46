"""Census of session tables: repositories, sessions, checkpoints, commits and what links them.

Sessions and checkpoints point at each other by arrays; a link holds where both sides have one repository at most and
these agree or are unknown. Commits resolve in their own repository first. What does not resolve is audited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.census import id_text, repo_name

#: The entity of each table, by the column of source_rows that names it.
TABLES = ("repositories", "sessions", "checkpoints", "commits", "session_logs", "conversations")
ARRAYS = {"checkpoint_ids": "checkpoint", "session_pks": "session", "commit_shas": "commit"}
ROWS = ("table_name", "row_number", "entity_key", "repo_id", "session_id", "checkpoint_pk", "commit_sha", "agent")


def checkpoint_key(value: Column, repo: Column) -> Column:
    """repository#id: an id that names its repository keeps it, in small letters; another gets that of its row."""
    value = F.nullif(value.cast("string"), F.lit(""))
    prefix, suffix = repo_name(F.substring_index(value, "#", 1)), F.regexp_replace(value, "^[^#]*#", "")
    own = F.when(prefix.isNotNull() & (suffix != ""), F.concat(prefix, F.lit("#"), suffix)).otherwise(value)
    return F.when(value.contains("#"), own).when(repo.isNotNull(), F.concat(repo, F.lit("#"), value)).otherwise(value)


def array_status(value: Column, native: bool) -> tuple[Column, Column]:
    """(distinct entries, status) of an array of texts, as a list or as JSON: missing, invalid_json, invalid_array,
    duplicate_entries or valid. Invalid ones have no entries."""
    if native:
        missing, broken, found = value.isNull(), F.lit(False), value.cast("array<string>")
        wrong = F.exists(found, lambda x: x.isNull() | (x == ""))
    else:
        missing = value.isNull() | (value == "")
        parsed = F.try_parse_json(value)
        broken = parsed.isNull()
        items = F.try_variant_get(parsed, "$", "array<variant>")
        found = F.try_variant_get(parsed, "$", "array<string>")
        text = lambda v: F.schema_of_variant(v) == "STRING"
        wrong = items.isNull() | F.exists(items, lambda v: ~F.coalesce(text(v), F.lit(False))) | F.exists(found, lambda x: x.isNull() | (x == ""))
    status = F.when(missing, "missing").when(broken, "invalid_json").when(F.coalesce(wrong, F.lit(True)), "invalid_array")
    status = status.when(F.size(F.array_distinct(found)) < F.size(found), "duplicate_entries").otherwise("valid")
    good = ~missing & ~broken & ~F.coalesce(wrong, F.lit(True))
    return F.when(good, F.array_distinct(found)).otherwise(F.array().cast("array<string>")), status


def load(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source rows, references, array audit) of the tables, each with row_number.

    A row of references is a pointer of a source row: (table_name, row_number, relation, target_key, method). Content
    columns are not read.
    """
    rows = refs = audit = None
    for name in sorted(set(tables) & set(TABLES)):
        df, kinds = tables[name], dict(tables[name].dtypes)
        text = lambda c: id_text(F.col(c), kinds[c]) if c in kinds else F.lit(None).cast("string")  # noqa: B023, E731
        repo = repo_name(text("repo_id"))
        if name == "repositories":
            repo = F.coalesce(repo, repo_name(text("url")))
        session, checkpoint, sha = text("session_id"), checkpoint_key(text("checkpoint_pk"), repo), F.lower(text("commit_sha"))
        key = {"repositories": repo, "checkpoints": checkpoint, "sessions": session, "session_logs": session, "commits": sha}.get(name, text("turn_id"))
        base = df.withColumns({"_repo": repo, "_n": F.col("row_number").cast("long")})
        own = df.select(
            F.lit(name).alias("table_name"), F.col("row_number").cast("long").alias("row_number"), key.alias("entity_key"), repo.alias("repo_id"),
            session.alias("session_id"), checkpoint.alias("checkpoint_pk"), sha.alias("commit_sha"), text("agent").alias("agent"),
        )
        rows = own if rows is None else rows.unionByName(own)
        for field, relation in ARRAYS.items():
            if field not in kinds:
                continue
            values, status = array_status(F.col(field), kinds[field].startswith("array"))
            target = {"checkpoint": lambda x: checkpoint_key(x, F.col("_repo")), "commit": F.lower, "session": lambda x: x}[relation]
            one = base.select(F.lit(name).alias("table_name"), F.col("_n").alias("row_number"), F.lit(relation).alias("relation"), F.col("_repo"), F.explode(values).alias("v"), F.lit(field).alias("method"))
            one = one.select("table_name", "row_number", "relation", target(F.col("v")).alias("target_key"), "method").distinct()
            seen = base.groupBy(F.lit(name).alias("table_name"), F.lit(field).alias("field"), status.alias("status")).agg(F.count("*").alias("rows"))
            refs = one if refs is None else refs.unionByName(one)
            audit = seen if audit is None else audit.unionByName(seen)
    direct = {"repository": ("repo_id", "repositories"), "session": ("session_id", "sessions"), "checkpoint": ("checkpoint_pk", "checkpoints")}
    for relation, (column, home) in direct.items():
        more = rows.where(F.col(column).isNotNull() & (F.col("table_name") != home))
        more = more.select("table_name", "row_number", F.lit(relation).alias("relation"), F.col(column).alias("target_key"), F.lit("direct_field").alias("method"))
        refs = more if refs is None else refs.unionByName(more)
    return rows, refs, audit


def entities(rows: DataFrame) -> DataFrame:
    """(table_name, entity_key, repo_id, source_rows, repository_variants) of repositories, sessions and checkpoints."""
    own = rows.where("table_name IN ('repositories', 'sessions', 'checkpoints') AND entity_key IS NOT NULL")
    return own.groupBy("table_name", "entity_key").agg(F.min("repo_id").alias("repo_id"), F.count("*").alias("source_rows"), F.count_distinct("repo_id").alias("repository_variants"))


def commit_entities(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(entity_key, repo_id) of commits; one without a repository gets that of its checkpoint, if it has one alone."""
    cp = known.where("table_name = 'checkpoints' AND repository_variants = 1").select(F.col("entity_key").alias("checkpoint_pk"), F.col("repo_id").alias("cp_repo"))
    own = rows.where("table_name = 'commits' AND entity_key IS NOT NULL").join(cp, "checkpoint_pk", "left")
    return own.select("entity_key", F.coalesce("repo_id", "cp_repo").alias("repo_id")).distinct()


def _compatible(a: str, b: str) -> Column:
    return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))


def session_checkpoint_links(rows: DataFrame, refs: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, checkpoint_pk, method) from either side's arrays and fields, where both ends exist, neither has
    several repositories, and the repositories agree or are unknown."""
    one = known.where("repository_variants <= 1").select("table_name", "entity_key", F.col("repo_id").alias("e_repo"))
    out = None
    for home, relation, other in (("sessions", "checkpoint", "checkpoints"), ("checkpoints", "session", "sessions")):
        own = rows.where(F.col("table_name") == home).where("entity_key IS NOT NULL").select("table_name", "row_number", "entity_key", "repo_id")
        own = own.join(one.where(F.col("table_name") == home).select("entity_key"), "entity_key", "left_semi")
        target = one.where(F.col("table_name") == other).select(F.col("entity_key").alias("target_key"), "e_repo")
        found = own.join(refs.where(F.col("relation") == relation), ["table_name", "row_number"]).join(target, "target_key").where(_compatible("repo_id", "e_repo"))
        a, b = ("entity_key", "target_key") if home == "sessions" else ("target_key", "entity_key")
        found = found.select(F.col(a).alias("session_id"), F.col(b).alias("checkpoint_pk"), "method")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def relation_audit(rows: DataFrame, refs: DataFrame, known: DataFrame, commits: DataFrame) -> DataFrame:
    """(table_name, relation, status, rows): orphan, ambiguous_repository, repository_conflict or linked; of commits
    linked in their own repository, cross_repository_reference or orphan."""
    from_rows = refs.join(rows.select("table_name", "row_number", "repo_id"), ["table_name", "row_number"])
    home = F.create_map(*[F.lit(x) for pair in (("repository", "repositories"), ("session", "sessions"), ("checkpoint", "checkpoints")) for x in pair])
    target = known.select(F.col("table_name").alias("home"), F.col("entity_key").alias("target_key"), F.col("repo_id").alias("e_repo"), "repository_variants")
    found = from_rows.where("relation <> 'commit'").withColumn("home", home[F.col("relation")]).join(target, ["home", "target_key"], "left")
    status = F.when(F.col("repository_variants").isNull(), "orphan").when(F.col("repository_variants") > 1, "ambiguous_repository")
    status = status.when(~_compatible("repo_id", "e_repo"), "repository_conflict").otherwise("linked")
    out = found.groupBy("table_name", "relation", status.alias("status")).agg(F.count("*").alias("rows"))
    # two equi-joins on the commit: in this repository, and how many others there are
    here = commits.where("repo_id IS NOT NULL").select(F.col("entity_key").alias("target_key"), "repo_id", F.lit(True).alias("here")).distinct()
    spread = commits.where("repo_id IS NOT NULL").groupBy(F.col("entity_key").alias("target_key")).agg(F.count("*").alias("n"))
    found = from_rows.where("relation = 'commit'").join(here, ["target_key", "repo_id"], "left").join(spread, "target_key", "left")
    status = F.when(F.col("here"), "linked").when((F.col("n") > 0) & F.col("repo_id").isNotNull(), "cross_repository_reference").otherwise("orphan")
    return out.unionByName(found.groupBy("table_name", "relation", status.alias("status")).agg(F.count("*").alias("rows")))


def one_sided(links: DataFrame) -> DataFrame:
    """(session_id, checkpoint_pk, seen_from) of links that one side alone states."""
    side = F.when(F.col("method") == "session_pks", "checkpoint_to_session").otherwise("session_to_checkpoint")
    return links.groupBy("session_id", "checkpoint_pk").agg(F.collect_set(side).alias("s")).where("size(s) = 1").select("session_id", "checkpoint_pk", F.col("s")[0].alias("seen_from"))


def commit_contexts(rows: DataFrame, refs: DataFrame, known: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts, unusable): for each repository and commit its checkpoints, sessions, agents and context statuses,
    sorted; and the references without a repository or a whole digest."""
    cp = known.where("table_name = 'checkpoints'").select(F.col("entity_key").alias("cp"), F.col("repo_id").alias("cp_repo"), F.col("repository_variants").alias("v"))

    def status(last):
        return F.when(F.col("v").isNull(), "checkpoint_missing").when(F.col("v") > 1, "checkpoint_ambiguous").when(~_compatible("repo_id", "cp_repo"), "checkpoint_repository_conflict").otherwise(last)

    usable = (F.col("v") <= 1) & _compatible("repo_id", "cp_repo")
    cols = ["repository", "commit_sha", "checkpoint_pk", "table_name", "row_number", "method", "context_status"]
    a = rows.where("table_name = 'commits'").join(cp, F.col("checkpoint_pk") == F.col("cp"), "left").select(
        F.coalesce("repo_id", F.when(F.col("v") == 1, F.col("cp_repo"))).alias("repository"), "commit_sha", F.when(usable, F.col("checkpoint_pk")).alias("checkpoint_pk"),
        "table_name", "row_number", F.lit("commit_row").alias("method"), status("linked").alias("context_status"),
    )
    b = rows.where("table_name = 'checkpoints'").join(refs.where("relation = 'commit'"), ["table_name", "row_number"]).join(cp, F.col("entity_key") == F.col("cp"), "left").select(
        F.col("repo_id").alias("repository"), F.col("target_key").alias("commit_sha"), F.when(usable, F.col("entity_key")).alias("checkpoint_pk"),
        "table_name", "row_number", F.lit("checkpoint_commit_array").alias("method"), status("provided_reference").alias("context_status"),
    )
    both = a.select(*cols).unionByName(b.select(*cols))
    whole = F.coalesce(F.col("repository").isNotNull() & F.col("commit_sha").rlike(r"^([0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False))
    agents = rows.where("table_name = 'sessions' AND agent IS NOT NULL").select(F.col("entity_key").alias("session_id"), "agent").distinct()
    of_cp = links.select("checkpoint_pk", "session_id").distinct().join(agents, "session_id", "left")
    folded = both.where(whole).join(of_cp, "checkpoint_pk", "left").groupBy("repository", "commit_sha").agg(
        *[F.sort_array(F.collect_set(c)).alias(name) for c, name in (("checkpoint_pk", "checkpoints"), ("session_id", "sessions"), ("agent", "agents"), ("context_status", "statuses"))],
        F.bool_or(F.col("table_name") == "commits").alias("has_commit_row"),
        F.count_distinct("table_name", "row_number").alias("n_rows"),
    )
    return folded, both.where(~whole)
