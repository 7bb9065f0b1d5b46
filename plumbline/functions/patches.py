"""Lines of diffs: files, hunks, changed and context lines with their numbers, and whole log statements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lines import LANGUAGES, is_production_path, is_source_file

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
# fixed values: log calls of the study's languages
CALLS = {
    "python": re.compile(r"\b(?:logging|logger|_logger)\.(?P<level>debug|info|warning|warn|error|critical|exception)\s*\(", re.I),
    "java": re.compile(r"\b(?:logger|log|LOG|LOGGER)\.(?P<level>trace|debug|info|warn|warning|error|fatal)\s*\(", re.I),
    "javascript_typescript": re.compile(r"\bconsole\.(?P<level>log|info|warn|error|debug)\s*\(", re.I),
}
_QUOTED = re.compile(r"'(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)", re.S)
STATEMENT, CONTEXT = 20, 12


@dataclass(frozen=True)
class Line:
    """A line of a diff: its file, hunk and kind (added, deleted or context), and its number on each side."""

    file: str
    hunk: int
    kind: str
    old: int | None
    new: int | None
    text: str


def _path(text: str) -> str:
    text = text.strip().split("\t")[0]
    return text[2:] if text[:2] in ("a/", "b/") else text


def diff_lines(diff: str) -> Iterator[Line]:
    """The lines of all hunks, in order. A deleted file keeps its old name; what stands outside of hunks is skipped. A
    diff without file headers has an empty name."""
    file = old_file = ""
    hunk, old, new, left, right = -1, 0, 0, 0, 0
    for raw in diff.splitlines():
        if left <= 0 and right <= 0:
            if raw.startswith("diff --git "):
                file = old_file = ""
            elif raw.startswith("--- "):
                old_file = _path(raw[4:])
            elif raw.startswith("+++ "):
                file = old_file if _path(raw[4:]) == "/dev/null" else _path(raw[4:])
            if m := HUNK.match(raw):
                hunk += 1
                old, left, new, right = (int(x) if x is not None else 1 for x in m.groups())
            continue
        kind = raw[:1] or " "
        if kind == "+":
            yield Line(file, hunk, "added", None, new, raw[1:])
            new, right = new + 1, right - 1
        elif kind == "-":
            yield Line(file, hunk, "deleted", old, None, raw[1:])
            old, left = old + 1, left - 1
        elif kind == " ":
            yield Line(file, hunk, "context", old, new, raw[1:])
            old, new, left, right = old + 1, new + 1, left - 1, right - 1


def strict_patch(diff: str) -> list[tuple[str, int, int, int, int]]:
    """(file, old start, old lines, new start, new lines) of every hunk, whose counts are checked; a ValueError for a
    hunk that is too short or long, a file that comes twice, or a hunk without a file."""
    out, seen, file = [], set(), None
    lines = diff.splitlines()
    at = 0
    while at < len(lines):
        raw = lines[at]
        at += 1
        if raw.startswith("+++ ") and at > 1 and lines[at - 2].startswith("--- "):
            file = _path(raw[4:]) if _path(raw[4:]) != "/dev/null" else _path(lines[at - 2][4:])
            if file in seen:
                raise ValueError("duplicate_file")
            seen.add(file)
        elif m := HUNK.match(raw):
            if file is None:
                raise ValueError("hunk_without_file")
            old, left, new, right = (int(x) if x is not None else 1 for x in m.groups())
            want = (left, right)
            while at < len(lines) and lines[at][:1] in (" ", "+", "-", "\\") and (left or right or lines[at][:1] == "\\"):
                left -= lines[at][:1] in " -"
                right -= lines[at][:1] in " +"
                at += 1
            if left or right:
                raise ValueError("hunk_count_mismatch")
            out.append((file, old, want[0], new, want[1]))
        elif raw.startswith("@@"):
            raise ValueError("invalid_hunk_header")
    return out


def balance(text: str) -> int:
    bare = _QUOTED.sub("", text)
    return bare.count("(") - bare.count(")")


def study_language(path: str) -> str | None:
    own = [p for p in path.replace("\\", "/").strip().lower().split("/") if p]
    for language, ending, folders, left_out in LANGUAGES:
        if own and re.search(ending, own[-1]):
            return None if set(own[:-1]) & set(folders) or re.search(left_out, own[-1]) else language
    return None


def log_statements(diff: str, longest: int = STATEMENT, before: int = CONTEXT) -> Iterator[dict]:
    """The log calls that a diff adds, joined with the lines that follow until their parentheses balance, and the new
    version's lines before them. A call ends with its hunk, a gap or `longest` lines."""
    hunks: dict[tuple, list[Line]] = {}
    for line in diff_lines(diff):
        if line.kind != "deleted":
            hunks.setdefault((line.file, line.hunk), []).append(line)
    for (file, _), lines in hunks.items():
        language = study_language(file)
        if language is None:
            continue
        for i, line in enumerate(lines):
            call = CALLS[language].search(line.text) if line.kind == "added" else None
            if not call:
                continue
            end, open_ = i + 1, balance(line.text[call.start() :])
            while open_ > 0 and end < len(lines) and end - i < longest and lines[end].new == lines[end - 1].new + 1:
                open_ += balance(lines[end].text)
                end += 1
            yield {
                "file": file, "language": language, "line": line.new, "level": call["level"].lower(), "statement": "\n".join(x.text for x in lines[i:end]),
                "statement_lines": end - i, "context": "\n".join(x.text for x in lines[max(0, i - before) : i]),
            }


def reconstruct(source: str | None, line: int, fallback: str, longest: int = STATEMENT, before: int = CONTEXT) -> dict:
    """A statement in its source from a line on, until its parentheses balance; without the line, the fallback alone."""
    lines = (source or "").splitlines()
    if not 1 <= line <= len(lines):
        return {"statement": fallback, "context": "", "statement_lines": 1, "complete": balance(fallback) <= 0, "source": "single_line_fallback", "matches": False}
    end = line
    while balance("\n".join(lines[line - 1 : end])) > 0 and end < len(lines) and end - line + 1 < longest:
        end += 1
    text = "\n".join(lines[line - 1 : end])
    context = "\n".join(lines[max(0, line - 1 - before) : line - 1])
    return {"statement": text, "context": context, "statement_lines": end - line + 1, "complete": balance(text) <= 0, "source": "committed_version", "matches": lines[line - 1].strip() == fallback.strip()}


def _spread(df: DataFrame, id_col: str, diff_col: str, of, spec: list[tuple[str, str]]) -> DataFrame:
    """A row for each that of(diff) gives, with the id of its diff; null diffs give none."""
    arrow = {"string": pa.string(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                found = [list(of(t)) for t in part.column(1).to_pylist()]
                own = part.column(0).take(pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32()))
                rows = [r for rs in found for r in rs]
                yield pa.RecordBatch.from_arrays([own, *[pa.array([r[n] for r in rows], arrow[t]) for n, t in spec]], names=["id", *[n for n, _ in spec]])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(diff_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(diff_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in spec))


def patch_lines(df: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """(id, file, hunk, kind, old, new, text) of every line of every diff. Empty table: no rows."""
    spec = [("file", "string"), ("hunk", "int"), ("kind", "string"), ("old", "int"), ("new", "int"), ("text", "string")]
    return _spread(df, id_col, diff_col, lambda t: (vars(x) for x in diff_lines(t)), spec)


def patch_statements(df: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """(id, file, language, line, level, statement, statement_lines, context) of the log calls that diffs add."""
    spec = [("file", "string"), ("language", "string"), ("line", "int"), ("level", "string"), ("statement", "string"), ("statement_lines", "int"), ("context", "string")]
    return _spread(df, id_col, diff_col, log_statements, spec)


def diff_profiles(lines: DataFrame) -> DataFrame:
    """A row for each id of patch_lines: source and production files, added and deleted production lines, their endings."""
    own = lines.where(is_source_file(F.col("file"))).withColumn("production", is_production_path(F.col("file")))
    changed = lambda kind: F.count_if(F.col("production") & (F.col("kind") == kind))
    ending = F.nullif(F.regexp_extract(F.lower("file"), r"[^./](\.[^./]+)$", 1), F.lit(""))
    return own.groupBy("id").agg(
        F.count_distinct("file").alias("source_files"), F.count_distinct(F.when(F.col("production"), F.col("file"))).alias("production_source_files"),
        changed("added").alias("added_lines"), changed("deleted").alias("deleted_lines"), F.sort_array(F.collect_set(F.when(F.col("production"), ending))).alias("extensions"),
    )


def log_template(text: str) -> str:
    """A log call with its fixed texts and <slot> for what varies; calls without a fixed text are <dynamic>."""
    text = re.sub(r"\s*(?://|#)\s*(?:debug|temporary|temp)\s*$", "", text, flags=re.I)
    slots = r"%\([^)]+\)[#0 +\-]?[0-9.]*[a-z]|%(?:[#0 +\-]?[0-9.]*)?[a-z]|\$?\{[^{}]*\}"
    tidy = lambda s: re.sub(r"\s+", " ", s).strip()
    if m := re.match(r"\s*(echo|printf)\b", text, re.I):
        rest = re.sub(r"\$\([^)]*\)|\$[a-z_][a-z0-9_]*|" + slots, "<slot>", text[m.end() :].lower())
        return f"{m[1].lower()}|{tidy(re.sub('[\'\"`]', '', rest))}"
    m = re.search(r"[\w.:!\s]+(?=\()", text)
    if not m:
        return re.sub(r"\s+", "", text).lower()
    # the first argument: up to a comma or the closing parenthesis outside of quotes and brackets
    depth, end, at = 0, len(text), m.end() + 1
    for t in re.finditer(r"'(?:\\.|[^'\\])*'?|\"(?:\\.|[^\"\\])*\"?|`(?:\\.|[^`\\])*`?|[()\[\]{},]", text[at:]):
        c = t[0]
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif (c == "," and not depth) or c == ")":
            end = at + t.start()
            break
    literals = [tidy(re.sub(slots, "<slot>", q[1:-1].lower())) for q in re.findall(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`", text[at:end])]
    return re.sub(r"\s+", "", m[0]).lower() + "|" + ("|".join(literals) or "<dynamic>")
