"""Census of pull-request tables: files inventoried, columns mapped, rows identified, linked and audited.

Every row of every table stays countable: what cannot be linked is a row of the audit, never a missing row. Links come
from unique targets alone; an ambiguous id links nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize, with_scheme
from plumbline.sources.store import open_input

# fixed values: the canonical columns and the names they go by, the first present one counting
ALIASES = {
    "id": ("id", "node_id"),
    "pr_id": ("pr_id", "pull_request_id", "pull_id"),
    "pr_number": ("number", "pr_number", "pull_number", "pull_request_number"),
    "pr_url": ("html_url", "pr_url", "pull_request_url", "url"),
    "repository": ("full_name", "repository", "repo", "repo_name", "repo_full_name"),
    "repo_id": ("repo_id", "repository_id"),
    "repo_url": ("repo_url", "repository_url"),
    "user_id": ("user_id", "author_id"),
    "user": ("user", "login", "author_login", "actor"),
    "author": ("author", "author_name"),
    "committer": ("committer", "committer_name"),
    "review_id": ("pull_request_review_id", "review_id"),
    "issue_id": ("issue_id", "related_issue_id"),
    "sha": ("sha", "commit_sha", "commit_id"),
    "filename": ("filename", "file_path", "path"),
    "patch": ("patch", "diff", "diff_patch"),
    "agent": ("agent", "agent_name", "agent_product", "provided_label"),
    "created_at": ("created_at", "created", "creation_time"),
    "closed_at": ("closed_at", "closed"),
    "merged_at": ("merged_at", "merged"),
    "state": ("state", "status"),
    "base_ref": ("base_ref", "base_branch"),
    "base_sha": ("base_sha",),
    "head_sha": ("head_sha",),
    "merge_commit_sha": ("merge_commit_sha", "merge_sha"),
    "type": ("type", "task_type"),
}
# fixed values: the role of a table by its name
ROLES = {
    "pr": ("all_pull_request", "pull_request", "human_pull_request", "pull_requests", "prs"),
    "repository": ("repository", "all_repository", "repositories"),
    "user": ("user", "all_user", "users"),
    "commit": ("pr_commits", "commits"),
    "file": ("pr_commit_details", "files"),
    "review": ("pr_reviews", "reviews"),
    "comment": ("pr_comments", "comments"),
    "review_comment": ("pr_review_comments", "pr_review_comments_v2"),
    "timeline": ("pr_timeline", "timeline"),
    "issue": ("issue", "issues"),
    "issue_relation": ("related_issue",),
    "task": ("pr_task_type", "human_pr_task_type"),
}
CHILDREN = ("commit", "file", "review", "comment", "review_comment", "timeline", "issue_relation", "task")
#: What a pull request keeps of its rows: the first value in order of table and row.
KEPT = ("created_at", "merged_at", "closed_at", "state", "base_ref", "base_sha", "head_sha", "merge_commit_sha")
REPO = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"


def role_of(table: str) -> str:
    return next((role for role, names in ROLES.items() if table in names), "unrecognized")


def column_mapping(columns: list[str], custom: dict | None = None) -> dict[str, str | None]:
    """Canonical column to the first of its names that is there; a custom mapping must name one that is."""
    custom = custom or {}
    if unknown := sorted(set(custom) - set(ALIASES)):
        raise ValueError(f"unknown canonical columns: {unknown}")
    names = {key: ([custom[key]] if isinstance(custom[key], str) else list(custom[key])) if key in custom else list(own) for key, own in ALIASES.items()}
    if absent := [key for key in custom if not set(names[key]) & set(columns)]:
        raise ValueError(f"mapped columns are absent: {absent}")
    return {key: next((n for n in own if n in columns), None) for key, own in names.items()}


INVENTORY = "path string, table string, role string, bytes long, sha256 string, status string, rows long, fields array<struct<name:string,type:string>>"
POINTER = b"version https://git-lfs.github.com/spec/v1"


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """INVENTORY of Parquet files: bytes, digest, rows and fields of each, hashed by executors a piece at a time.

    status is readable, missing_lfs_object for a pointer that stands for a file, or unreadable_parquet. Two files of
    one table's name are ambiguous and raise, and so does an empty list.
    """
    stems = [p.rsplit("/", 1)[-1].removesuffix(".parquet") for p in paths]
    if not paths or len(set(stems)) < len(stems):
        raise ValueError("one file for each table is needed")

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for path, stem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, size, head = hashlib.sha256(), 0, b""
                with open_input(path) as f:
                    while data := f.read(1 << 20):
                        head = head or data[:512]
                        digest.update(data)
                        size += len(data)
                status, rows, fields = "missing_lfs_object", None, None
                if not head.startswith(POINTER):
                    try:
                        with open_input(path) as f:
                            file = pq.ParquetFile(f)
                            status, rows, fields = "readable", file.metadata.num_rows, [{"name": x.name, "type": str(x.type)} for x in file.schema_arrow]
                    except (pa.ArrowInvalid, OSError):
                        status = "unreadable_parquet"
                row = {"path": path, "table": stem, "role": role_of(stem), "bytes": size, "sha256": digest.hexdigest(), "status": status, "rows": rows, "fields": fields}
                kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
                types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.int64(), kind]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    listed = spark.createDataFrame([(with_scheme(spark, p), s) for p, s in zip(paths, stems, strict=True)], "path string, table string")
    return listed.repartition(len(paths), "path").mapInArrow(run, INVENTORY)


def id_text(c: Column, kind: str) -> Column:
    """An id as text, whole floating numbers without their fraction; empty is null."""
    if kind in ("double", "float"):
        return F.when(F.isnan(c) | c.isNull(), F.lit(None).cast("string")).when(F.floor(c) == c, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return F.nullif(c.cast("string"), F.lit(""))


def repo_name(value: Column) -> Column:
    """owner/repository in small letters out of a name or a GitHub URL; null where it is neither."""
    bare = F.regexp_replace(F.regexp_replace(value, r"^https://api\.github\.com/repos/", ""), r"^https://github\.com/", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.git$", ""), r"/+$", "")
    return F.when(bare.rlike(REPO), F.lower(bare))


def pr_identity(url: Column, repo: Column, number: Column) -> Column:
    """owner/repository#number: of a pull request's URL at github.com or api.github.com, or else of repo and number.

    Null where the number is not above 0 or the repository is none.
    """
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    web, api = r"^/([^/]+/[^/]+)/pull/(\d+)/?$", r"^/repos/([^/]+/[^/]+)/pulls/(\d+)/?$"
    pattern = F.when((host == "github.com") & path.rlike(web), 1).when((host == "api.github.com") & path.rlike(api), 2)
    told = lambda k, own: F.when(pattern == 1, F.regexp_extract(path, web, k)).when(pattern == 2, F.regexp_extract(path, api, k)).otherwise(own)
    name, n = told(1, repo), told(2, number.cast("string")).try_cast("long")
    return F.when((n > 0) & name.rlike(REPO), F.concat(F.lower(name), F.lit("#"), n.cast("string")))


def patch_status(patch: Column) -> Column:
    """null, empty, masked or present_unverified: placeholders and license texts without hunks are missing evidence."""
    token = r"(?i)^[\[<({\s]*(?:null|none|masked|redacted|removed|unavailable|not available)[\]>)}\s.!_-]*$"
    notice = r"(?i)licen[cs]e|copyright|not.redistribut|patch.{0,30}(?:masked|redacted)"
    masked = F.trim(patch).rlike(token) | (~patch.contains("@@") & patch.rlike(notice))
    return F.when(patch.isNull(), "null").when(~patch.rlike(r"\S"), "empty").when(masked, "masked").otherwise("present_unverified")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file with row_number, its rows from 1 as they stand in the file."""
    return spark.read.parquet(path).withColumn("row_number", F.col("_metadata.row_index") + 1)


def source_rows(tables: dict[str, DataFrame], custom: dict[str, dict] | None = None) -> DataFrame:
    """One row for each row of the tables (each with row_number): its role, ids as text, identity and kept fields.

    Columns are pruned to the mapped ones. Null ids stay null; no row goes.
    """
    out = None
    for name in sorted(tables):
        df, role = tables[name], role_of(name)
        found = column_mapping(df.columns, (custom or {}).get(name))
        kinds = dict(df.dtypes)
        raw = lambda key: F.col(f"`{found[key]}`") if found[key] else F.lit(None).cast("string")  # noqa: B023, E731
        text = lambda key: id_text(raw(key), kinds.get(found[key], "string"))  # noqa: B023, E731
        pr_id, repo_id, repo_url = text("pr_id"), text("repo_id"), text("repo_url")
        if role == "task":
            pr_id = F.coalesce(pr_id, text("id"))
        if role == "repository":
            repo_id, repo_url = F.coalesce(repo_id, text("id")), F.coalesce(repo_url, text("pr_url"))
        key = pr_identity(raw("pr_url").cast("string"), repo_name(raw("repository").cast("string")), text("pr_number"))
        rows = df.select(
            F.lit(name).alias("table_name"),
            F.col("row_number").cast("long").alias("row_number"),
            F.lit(role).alias("role"),
            text("id").alias("entity_id"),
            pr_id.alias("pr_id"),
            repo_id.alias("repo_id"),
            repo_url.alias("repo_url"),
            text("user_id").alias("user_id"),
            text("user").alias("user_login"),
            text("review_id").alias("review_id"),
            text("issue_id").alias("issue_id"),
            F.lower(text("sha")).alias("sha"),
            (key if role in (*CHILDREN, "pr") else F.lit(None).cast("string")).alias("pr_key"),
            (patch_status(raw("patch").cast("string")) if role == "file" else F.lit(None).cast("string")).alias("patch_status"),
            F.struct(*[raw(k).cast("string").alias(k) for k in (*KEPT, "agent", "repository", "pr_url", "pr_number", "type")]).alias("kept"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def unique_targets(links: DataFrame, alias: str, target: str) -> DataFrame:
    """(alias, target) of the aliases that have a single target."""
    return links.where(F.col(alias).isNotNull()).groupBy(alias).agg(F.min(target).alias(target), F.count_distinct(target).alias("_n")).where("_n = 1").drop("_n")


def _known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df with what known says of its key, each key once; rows without a key stay where they are, since a join would
    bring all of them to one task."""
    none = {c: F.lit(None).cast(kind) for c, kind in known.dtypes if c != key}
    return df.where(F.col(key).isNotNull()).join(known, key, "left").unionByName(df.where(F.col(key).isNull()).withColumns(none))


def repository_aliases(rows: DataFrame) -> DataFrame:
    """(alias, repository): the id, the URL and the name of each repository."""
    repo = F.coalesce(repo_name(F.col("kept.repository")), repo_name(F.col("repo_url")))
    named = rows.where("role = 'repository'").select(repo.alias("repository"), F.explode(F.array("entity_id", "repo_url", repo)).alias("alias"))
    return named.where("repository IS NOT NULL AND alias IS NOT NULL").distinct()


def identified(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """The rows of pull requests with their identity: their own, or that of a repository found by its alias."""
    known = unique_targets(aliases, "alias", "repository")
    prs = rows.where("role = 'pr'").withColumn("alias", F.coalesce("repo_id", "repo_url"))
    prs = _known(prs, known, "alias")
    found = pr_identity(F.col("kept.pr_url"), F.coalesce("repository", repo_name(F.col("repo_url"))), F.col("kept.pr_number"))
    return prs.withColumn("pr_key", F.coalesce("pr_key", found)).where("pr_key IS NOT NULL").drop("alias", "repository")


def folded(prs: DataFrame) -> DataFrame:
    """One row for each identity: its ids, labels and source rows, the first value of each kept field in order of table
    and row, and as conflicts the source rows whose value is another."""
    order = F.struct("table_name", "row_number")
    label = F.coalesce(F.col("kept.agent"), F.when(F.col("table_name").startswith("human_"), F.lit("human")))
    # fields as rows: then the first value and the conflicts of all fields are one grouping
    long = prs.select("pr_key", order.alias("at"), F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"kept.{k}").alias("v")) for k in KEPT])).alias("x"))
    long = long.select("pr_key", "at", "x.field", "x.v").where("v IS NOT NULL")
    first = long.groupBy("pr_key", "field").agg(F.min_by("v", "at").alias("first"), F.collect_list(F.struct("at", "v")).alias("all"))
    other = F.array_sort(F.transform(F.filter("all", lambda r: r["v"] != F.col("first")), lambda r: F.struct(F.col("field"), r["at"]["table_name"].alias("table"), r["at"]["row_number"].alias("row"))))
    fields = first.groupBy("pr_key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "first")))).alias("fields"), F.array_sort(F.flatten(F.collect_list(other))).alias("conflicts")
    )
    out = prs.groupBy("pr_key").agg(
        F.sort_array(F.collect_set("entity_id")).alias("ids"),
        F.sort_array(F.collect_set(label)).alias("labels"),
        F.sort_array(F.collect_list(order)).alias("source_rows"),
    )
    single = F.when(F.size("labels") == 1, F.col("labels")[0]).otherwise(F.lit("unknown"))
    return out.join(fields, "pr_key", "left").withColumn("provided_label", single)


def linked(rows: DataFrame, prs: DataFrame) -> DataFrame:
    """(table_name, row_number, pr_key, method) of the rows that belong to one pull request; the first method that
    finds it counts: its own identity, its URL or id where they agree, its review, its commit.

    Pull requests, their rows of other tables and what these name themselves are written: each is read several times,
    and in one plan with all that leads to it the tables would be read once for each way.
    """
    prs = materialize(prs.select("table_name", "row_number", "entity_id", "pr_key"), "census-prs")
    own = prs.select("table_name", "row_number", "pr_key", F.lit("pr_identity").alias("method"))
    keys = prs.select("pr_key").distinct().withColumn("url_key", F.col("pr_key"))
    every = prs.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("pr_id"), F.col("pr_key").alias("id_key")).distinct()
    counted = every.groupBy("pr_id").agg(F.min("id_key").alias("id_key"), F.count("*").alias("n"))
    kids = rows.where(F.col("role").isin(*CHILDREN)).select("table_name", "row_number", "role", "entity_id", "pr_id", "review_id", "sha", "pr_key")
    kids = materialize(kids, "census-children")
    found = _known(_known(kids.where("pr_key IS NOT NULL OR pr_id IS NOT NULL"), keys, "pr_key"), counted, "pr_id")
    # an id of several pull requests links nothing, even beside a URL
    found = found.where("NOT coalesce(n > 1, false)").where("coalesce(url_key, id_key) IS NOT NULL AND (url_key IS NULL OR id_key IS NULL OR url_key = id_key)")
    direct = found.select("table_name", "row_number", F.coalesce("url_key", "id_key").alias("key"), F.when(F.col("url_key").isNotNull(), "pr_url").otherwise("pr_id").alias("method"), "role", "entity_id", "sha")
    direct = materialize(direct, "census-direct")
    bare = kids.where("pr_id IS NULL AND pr_key IS NULL")
    reviews = unique_targets(direct.where("role = 'review'"), "entity_id", "key").withColumnRenamed("entity_id", "review_id")
    commits = unique_targets(direct.where("role = 'commit'"), "sha", "key")
    by_review = bare.where("role = 'review_comment'").join(reviews, "review_id").select("table_name", "row_number", "key", F.lit("review_id").alias("method"))
    by_commit = bare.where("role = 'file'").join(commits, "sha").select("table_name", "row_number", "key", F.lit("commit_sha").alias("method"))
    rest = direct.select("table_name", "row_number", "key", "method").unionByName(by_review).unionByName(by_commit)
    return own.unionByName(rest.withColumnRenamed("key", "pr_key"))


def relationship_audit(rows: DataFrame, links: DataFrame, prs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(table_name, relation, status, rows): how many rows of each table are linked, unresolved, orphans, without a
    foreign key or in conflict. A missing key is no orphan."""
    count = F.count("*").alias("rows")
    family = rows.where(F.col("role").isin("pr", *CHILDREN)).join(links.select("table_name", "row_number", "method"), ["table_name", "row_number"], "left")
    out = family.groupBy("table_name", F.lit("pr").alias("relation"), F.when(F.col("method").isNull(), "unresolved").otherwise("linked").alias("status")).agg(count)
    keys = prs.select("pr_key").distinct()
    unique = unique_targets(prs.select(F.col("entity_id").alias("pr_id"), F.col("pr_key").alias("id_key")), "pr_id", "id_key")
    against = rows.where("role <> 'pr'").join(keys, "pr_key").join(unique, "pr_id").where("pr_key <> id_key")
    out = out.unionByName(against.groupBy("table_name", F.lit("pr_identity").alias("relation"), F.lit("conflict").alias("status")).agg(count))
    own = rows.where("role NOT IN ('repository', 'user')")

    def state(relation, key, known):
        found = _known(own.select("table_name", key.alias("k")), known.where("k IS NOT NULL").distinct().withColumn("there", F.lit(True)), "k")
        status = F.when(F.col("k").isNull(), "missing_foreign_key").when(F.col("there"), "linked").otherwise("orphan")
        return found.groupBy("table_name", F.lit(relation).alias("relation"), status.alias("status")).agg(count)

    of_role = lambda role, c: rows.where(F.col("role") == role).select(F.col(c).alias("k"))
    out = out.unionByName(state("review_id", F.col("review_id"), of_role("review", "entity_id")))
    out = out.unionByName(state("issue_id", F.col("issue_id"), of_role("issue", "entity_id")))
    # a user by id if there is one, else by login: the kind of key is part of it
    users = of_role("user", "entity_id").select(F.concat(F.lit("i:"), "k").alias("k")).unionByName(of_role("user", "user_login").select(F.concat(F.lit("l:"), "k").alias("k")))
    out = out.unionByName(state("user", F.coalesce(F.concat(F.lit("i:"), "user_id"), F.concat(F.lit("l:"), "user_login")), users))
    return out.unionByName(state("repository", F.coalesce("repo_id", "repo_url"), aliases.select(F.col("alias").alias("k"))))


def commit_evidence(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(pr_key, shas, n_invalid): the commits that linked commit and file rows name, those that are whole digests."""
    named = rows.where("role IN ('commit', 'file') AND sha IS NOT NULL").join(links, ["table_name", "row_number"]).select(links["pr_key"], "sha").distinct()
    whole = F.col("sha").rlike(r"^([0-9a-f]{40}|[0-9a-f]{64})$")
    return named.groupBy("pr_key").agg(F.sort_array(F.collect_set(F.when(whole, F.col("sha")))).alias("shas"), F.count_if(~whole).alias("n_invalid"))


def related_counts(links: DataFrame) -> DataFrame:
    """(pr_key, related): rows of each table that belong to a pull request, as a map."""
    n = links.groupBy("pr_key", "table_name").agg(F.count("*").alias("n"))
    return n.groupBy("pr_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("table_name", "n")))).alias("related"))


def account_references(tables: dict[str, DataFrame]) -> tuple[DataFrame | None, str, dict[str, str]]:
    """(distinct logins, coverage, status by table) of the account tables: coverage is complete, partial, empty or
    unavailable. Logins are compared as they stand."""
    status, found = {}, None
    for name in ("user", "all_user"):
        df = tables.get(name)
        status[name] = "missing_table" if df is None else "missing_column" if "login" not in df.columns else "complete" if dict(df.dtypes)["login"] == "string" else "unsupported_type"
        if status[name] == "complete":
            own = df.select("login").where("login IS NOT NULL AND login <> ''")
            found = own if found is None else found.unionByName(own)
    n = sum(s == "complete" for s in status.values())
    found = found.distinct() if found is not None else None
    coverage = "unavailable" if not n else "partial" if n < 2 else "complete" if not found.isEmpty() else "empty"
    return found, coverage, status


def anchors(timeline: DataFrame, comments: DataFrame, known: DataFrame, events: tuple[str, ...]) -> DataFrame:
    """(pr_key, sha, kind) of commits that timelines and review comments name and known, a table of (pr_key, sha), lacks.

    Timeline rows count by their event, if it is one of events; comments give the commit they stand at and the one they
    stood at first. Nulls and what is no whole digest name nothing.
    """
    a = timeline.where(F.col("event").isin(*events)).select("pr_key", F.lower("commit_id").alias("sha"), F.concat(F.lit("timeline:"), "event").alias("kind"))
    b = comments.select("pr_key", F.explode(F.array(F.struct(F.col("commit_id").alias("sha"), F.lit("review_comment").alias("kind")), F.struct(F.col("original_commit_id").alias("sha"), F.lit("review_comment:original").alias("kind")))).alias("x"))
    both = a.unionByName(b.select("pr_key", F.lower("x.sha").alias("sha"), "x.kind")).where("pr_key IS NOT NULL").where(F.col("sha").rlike(r"^([0-9a-f]{40}|[0-9a-f]{64})$")).distinct()
    return both.join(known.select("pr_key", "sha").distinct(), ["pr_key", "sha"], "left_anti")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order: what insert-or-ignore keeps."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
