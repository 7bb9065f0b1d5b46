"""Log calls of source files: by the syntax tree in Python, by balanced calls in other languages.

Nothing is imported or run. A call whose logger cannot be traced is possible, not confirmed; a file that cannot be
parsed is a gap, not a file without logs.
"""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identity import canonical_json
from plumbline.functions.patches import log_template
from plumbline.functions.taxonomy import CARRIERS, coarse_types
from plumbline.runtime import materialize

# fixed values: levels of loggers, names that are loggers by custom, calls that hide values, and calls of other languages
LEVELS = {"debug": "debug", "info": "info", "warning": "warning", "warn": "warning", "error": "error", "exception": "error", "critical": "critical", "fatal": "critical", "log": "log"}
USUAL = ("log", "logger", "logging", "_logger", "_log")
HIDES = re.compile(r"(?i)(?:^|_)(?:mask|redact|sanitize|sanitise|scrub|obfuscate|anonymi[sz]e|hash)")
MEASURES = ("len", "bool", "type", "isinstance", "id")
CALL = re.compile(r"(?<![\w.])(?:console|logger|log|LOG|LOGGER|_logger|slog|zap|logrus|Log|fmt|System\.(?:out|err))\s*\.\s*(\w+)\s*\(")
LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".cs": "csharp"}
VERBS = re.compile(r"(?i)^(?:log|trace|debug|info|information|warn|warning|error|fatal|critical|print|printf|println|panic|msg|logInformation|logWarning|logError|logDebug)f?$")


def semantic(code: str) -> str:
    """Python code as its syntax tree, so that layout and comments don't matter; other code without its margins."""
    try:
        return ast.dump(ast.parse(textwrap.dedent(code).strip()))
    except (SyntaxError, ValueError):
        return code.strip()


def behavior(entity: dict) -> str:
    """What an entity does, as canonical text: its statement, what that depends on, its conditions and types."""
    return canonical_json([entity["semantic"], sorted(entity["dependencies"]), entity["conditions"], entity["types"]])


def hidden(code: str) -> str:
    """Code with the texts of its literals and comments masked by x, at equal length and with equal lines."""
    mask = lambda m: re.sub(r"[^\n]", "x", m[0])
    return re.sub(r"'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|/\*[\s\S]*?\*/|(?://|#)[^\n]*", mask, code)


class _Python(ast.NodeVisitor):
    """Log calls of a module with what surrounds them."""

    def __init__(self, source: str):
        self.lines, self.scope, self.tests, self.found = source.splitlines(), [], [], []
        tree = ast.parse(source)
        self.modules, self.loggers, self.values = set(), set(), {}
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                self.modules |= {a.asname or a.name for a in node.names if a.name == "logging"}
            elif isinstance(node, ast.ImportFrom) and node.module == "logging":
                self.loggers |= {a.asname or a.name for a in node.names if a.name in LEVELS}
                self.modules |= {f"{a.asname or a.name}()" for a in node.names if a.name == "getLogger"}
        # names that a logger is given to, through as many names as there are rounds
        for _ in range(3):
            for node in ast.walk(tree):
                if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None and self._is_logger(node.value):
                    self.loggers |= {ast.unparse(t) for t in (node.targets if isinstance(node, ast.Assign) else [node.target])}
        self.visit(tree)

    def _is_logger(self, node) -> bool:
        text = ast.unparse(node)
        if isinstance(node, ast.Call):
            head = ast.unparse(node.func)
            return f"{head}()" in self.modules or any(head in (f"{m}.getLogger", f"{m}.getLogger().getChild") for m in self.modules) or (head.endswith(".getChild") and head[:-9] in self.loggers)
        return text in self.loggers

    def _scoped(self, node):
        kept, self.values = self.values, dict(self.values)
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()
        self.values = kept

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _scoped

    def visit_Assign(self, node):
        self.generic_visit(node)
        for target in node.targets:
            if isinstance(target, ast.Name):
                self.values[target.id] = node

    def visit_If(self, node):
        self.visit(node.test)
        text = ast.unparse(node.test)
        for test, body in ((text, node.body), (f"not ({text})", node.orelse)):
            self.tests.append(f"condition:{test}")
            for x in body:
                self.visit(x)
            self.tests.pop()

    def visit_ExceptHandler(self, node):
        self.tests.append(f"except:{ast.unparse(node.type) if node.type else ''}")
        self.generic_visit(node)
        self.tests.pop()

    def visit_Call(self, node):
        self.generic_visit(node)
        method = node.func.attr if isinstance(node.func, ast.Attribute) else None
        holder = ast.unparse(node.func.value) if method else None
        name = node.func.id if isinstance(node.func, ast.Name) else None
        if method in LEVELS and (holder in self.modules or holder in self.loggers or self._is_logger(node.func.value)):
            self._add(node, LEVELS[method], "confirmed")
        elif method in LEVELS and holder.split(".")[-1] in USUAL:
            self._add(node, LEVELS[method], "possible")
        elif name in self.loggers and name in LEVELS:
            self._add(node, LEVELS[name], "confirmed")
        elif name == "print":
            self._add(node, "print", "confirmed")

    def _flows(self, node, depth: int = 4) -> Iterator[tuple[str, str, bool]]:
        """(source, basis, hidden) of the values in an expression; names are followed to what they were given."""
        if isinstance(node, ast.Call):
            head = ast.unparse(node.func)
            if head in MEASURES:
                return
            masked = bool(HIDES.search(head.split(".")[-1]))
            inner = [*node.args, *[k.value for k in node.keywords], *([node.func.value] if isinstance(node.func, ast.Attribute) and head.split(".")[-1] in ("format", "join", "strip", "lower") else [])]
            if not inner:
                yield f"{head}()", "identifier_only", False
            for x in inner:
                for s, b, m in self._flows(x, depth):
                    yield s, b, m or masked
        elif isinstance(node, (ast.Attribute, ast.Subscript)):
            yield ast.unparse(node), "value", False
        elif isinstance(node, ast.Name):
            given = self.values.get(node.id)
            if given is not None and depth and not (isinstance(given.value, ast.Name) and given.value.id == node.id):
                yield from self._flows(given.value, depth - 1)
            else:
                yield node.id, "identifier_only", False
        elif not isinstance(node, ast.Constant):
            for x in ast.iter_child_nodes(node):
                yield from self._flows(x, depth)

    def _add(self, node, level, certainty):
        args = [*node.args, *[k.value for k in node.keywords if k.arg not in ("exc_info", "stack_info", "stacklevel")]]
        flows = list(dict.fromkeys(f for a in args for f in self._flows(a)))
        names = {n.id for a in args for n in ast.walk(a) if isinstance(n, ast.Name)}
        uses = {n: self.values[n] for n in sorted(names) if n in self.values}
        text = "\n".join(self.lines[node.lineno - 1 : node.end_lineno])
        self.found.append({
            "symbol": ".".join(self.scope) or "<module>", "callee": ast.unparse(node.func), "level": level, "certainty": certainty, "start_line": node.lineno, "end_line": node.end_lineno, "column": node.col_offset,
            "statement": text, "semantic": ast.dump(node), "conditions": list(self.tests), "flows": flows, "dependencies": [f"{n}={ast.dump(v.value)}" for n, v in uses.items()],
            "dependency_lines": sorted({x for v in uses.values() for x in range(v.lineno, v.end_lineno + 1)}), "parser": "python_ast",
        })


def _lexical(source: str, language: str) -> Iterator[dict]:
    """Calls of usual loggers whose parentheses balance, with one assignment above for each name in them."""
    masked, lines = hidden(source), source.splitlines()
    for m in CALL.finditer(masked):
        if not VERBS.match(m[1]):
            continue
        depth, end = 0, None
        for k in range(m.end() - 1, len(masked)):
            depth += (masked[k] == "(") - (masked[k] == ")")
            if not depth:
                end = k + 1
                break
        if end is None:
            yield {"gap": "unbalanced_log_call", "line": source.count("\n", 0, m.start()) + 1}
            continue
        first, last = source.count("\n", 0, m.start()) + 1, source.count("\n", 0, end) + 1
        inside = masked[m.end() : end - 1]
        names = re.findall(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", re.sub(r"x{2,}", " ", inside)) + re.findall(r"\$\{([^}]+)\}", source[m.end() : end - 1])
        given = {}
        for n in dict.fromkeys(names):
            hop = list(re.finditer(rf"(?m)^.*\b{re.escape(n)}\s*:?=(?!=)\s*(.+?);?\s*$", masked[: m.start()]))
            if hop:
                given[n] = (hop[-1][1], source.count("\n", 0, hop[-1].start(1)) + 1)
        outer = re.findall(r"(?m)^\s*(?:[\w<>\[\]]+\s+)*(?:function\s+|func\s+(?:\([^)]*\)\s*)?)?([A-Za-z_]\w*)\s*\([^;{}]*\)\s*[\w<>\[\], ]*\{\s*$", masked[: m.start()])
        yield {
            "symbol": outer[-1] if outer else "<module>", "callee": re.sub(r"\s|\($", "", m[0]), "level": m[1].lower(), "certainty": "possible", "start_line": first, "end_line": last, "column": m.start() - source.rfind("\n", 0, m.start()) - 1,
            "statement": "\n".join(lines[first - 1 : last]), "semantic": re.sub(r"\s+", " ", source[m.start() : end]), "conditions": [], "flows": [(n, "lexical_identifier_only", False) for n in dict.fromkeys(names)],
            "dependencies": [f"{n}={v}" for n, (v, _) in given.items()], "dependency_lines": sorted(line for _, line in given.values()), "parser": f"{language}_lexical",
        }


def detect(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """(entities, gaps) of one file. An entity's identity is its symbol, its template and its place among those alike;
    its assessment is supported, possible, not_supported or unknown by what its values' names say."""
    ending = path[path.rfind(".") :].lower() if "." in path else ""
    if ending == ".py":
        try:
            found = _Python(source).found
        except (SyntaxError, ValueError, RecursionError) as e:
            return [], [{"path": path, "reason": "python_ast_parse_failed", "line": getattr(e, "lineno", None)}]
    elif ending in LANGUAGES:
        found = list(_lexical(source, LANGUAGES[ending]))
    else:
        return [], [{"path": path, "reason": "unsupported_language", "line": None}]
    gaps = [{"path": path, "reason": f["gap"], "line": f["line"]} for f in found if "gap" in f]
    out, seen = [], {}
    for e in sorted((f for f in found if "gap" not in f), key=lambda e: (e["start_line"], e["column"])):
        e["path"], e["template"] = path, log_template(e["statement"])
        told = {s: coarse_types(s) for s, _, _ in e["flows"]}
        open_ = [s for s, _, m in e["flows"] if not m and told[s] - CARRIERS]
        e["types"] = sorted(set().union(*told.values()) if told else set())
        strong = [s for s, b, m in e["flows"] if not m and b == "value" and told[s] - CARRIERS]
        e["assessment"] = "supported" if strong and e["certainty"] == "confirmed" else "possible" if open_ else "unknown" if any(not told[s] or told[s] & CARRIERS for s in told) else "not_supported"
        e["sanitized"] = any(m for *_, m in e["flows"])
        key = (e["symbol"], hashlib.sha256(e["template"].encode()).hexdigest()[:16])
        seen[key] = seen.get(key, -1) + 1
        e["identity"] = f"{key[0]}:{key[1]}:{seen[key]}"
        out.append(e)
    return out, gaps


SPEC = [
    ("path", "string"), ("symbol", "string"), ("callee", "string"), ("level", "string"), ("certainty", "string"), ("start_line", "int"), ("end_line", "int"), ("statement", "string"), ("semantic", "string"), ("template", "string"),
    ("identity", "string"), ("behavior", "string"), ("assessment", "string"), ("sanitized", "boolean"), ("parser", "string"), ("conditions", "array<string>"), ("types", "array<string>"), ("sources", "array<string>"), ("dependency_lines", "array<int>"), ("gap", "string"),
]


def detect_files(files: DataFrame, id_col: str = "id", path_col: str = "path", source_col: str = "source") -> DataFrame:
    """(id, SPEC) of the log calls of every file, and a row with gap alone for what could not be read. A null source is
    a gap. Files are read one by one, whole."""
    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}

    def rows(path, source):
        found, gaps = detect(path or "", source) if source is not None else ([], [{"path": path, "reason": "source_unavailable", "line": None}])
        for e in found:
            yield {**e, "behavior": behavior(e), "sources": [s for s, *_ in e["flows"]], "gap": None}
        for g in gaps:
            yield {"path": path, "start_line": g["line"], "gap": g["reason"]}

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                found = [list(rows(p, t)) for p, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                own = part.column(0).take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int32()))
                flat = [r for x in found for r in x]
                yield pa.RecordBatch.from_arrays([own, *[pa.array([r.get(n) for r in flat], arrow[t]) for n, t in SPEC]], names=["id", *[n for n, _ in SPEC]])

    kind = files.schema[id_col].dataType.simpleString()
    picked = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(source_col).alias("source"))
    return picked.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in SPEC))


def touched(entities: DataFrame, lines: DataFrame) -> DataFrame:
    """The entities whose own lines, or whose dependencies', are among the changed lines (id, path, line): relation is
    direct_call_change or dependency_change."""
    changed = lines.groupBy("id", "path").agg(F.collect_set("line").alias("changed"))
    met = entities.where("gap IS NULL").join(changed, ["id", "path"])
    direct = F.exists("changed", lambda n: n.between(F.col("start_line"), F.col("end_line")))
    far = F.arrays_overlap("changed", F.col("dependency_lines"))
    return met.withColumn("relation", F.when(direct, "direct_call_change").when(far, "dependency_change")).where("relation IS NOT NULL").drop("changed")


def imports_of(path: str, source: str, known: set[str]) -> list[str]:
    """The known files that a file imports directly: Python modules beside or below it, and relative ones of scripts."""
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    out: list[str] = []
    if path.endswith(".py"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        for node in ast.walk(tree):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else []
            if isinstance(node, ast.ImportFrom):
                up = "/".join(folder.rstrip("/").split("/")[: len(folder.rstrip("/").split("/")) - node.level + 1]) if node.level else ""
                base = ".".join(x for x in (up.replace("/", "."), node.module or "") if x)
                names = [base, *[f"{base}.{a.name}" for a in node.names]]
            for n in names:
                stem = n.replace(".", "/")
                out += [c for c in (f"{stem}.py", f"{stem}/__init__.py", f"{folder}{stem}.py") if c in known]
    else:
        for name in re.findall(r"""(?:from|import|require\()\s*['"](\.[^'"]+)['"]""", source):
            whole: list[str] = []
            for x in f"{folder}{name}".split("/"):
                whole = whole[:-1] if x == ".." else whole if x == "." else [*whole, x]
            stem = "/".join(whole)
            out += [c for c in (stem, *(stem + e for e in LANGUAGES), stem + "/index.js", stem + "/index.ts") if c in known]
    return list(dict.fromkeys(out))


def reachable(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(start, node) of all nodes that can be reached along edges (src, dst) from the starts (start), themselves
    included, in a number of steps or any. Only whether a step found more reaches the driver."""
    new = materialize(starts.select("start", F.col("start").alias("node")).distinct(), "reach")
    seen, n = new, 0
    while not new.isEmpty() and (rounds is None or n < rounds):
        step = new.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
        new = materialize(step.join(seen, ["start", "node"], "left_anti"), "reach")
        seen, n = seen.unionByName(new), n + 1
    return seen


def duplicate_key(source: str, line: int) -> str:
    """A digest of the smallest function around a line, without numbers and white space; of the whole text otherwise."""
    code = source
    try:
        around = [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.lineno <= line <= n.end_lineno]
        if around:
            code = ast.get_source_segment(source, min(around, key=lambda n: n.end_lineno - n.lineno)) or source
    except (SyntaxError, ValueError):
        pass
    return hashlib.sha256(re.sub(r"\s+", "", re.sub(r"\d+", "0", code)).encode()).hexdigest()


def output_units(entity: dict) -> list[dict]:
    """One unit for each value that a call puts out, with a case id; a call without values is one unit of its text."""
    units = [{"source": s, "basis": b, "hidden": m} for s, b, m in entity["flows"]] or [{"source": "", "basis": "literal", "hidden": False}]
    key = f"{entity['path']}|{entity['identity']}"
    return [{**u, "unit": i, "case_id": hashlib.sha256(f"{key}|{i}|{u['source']}".encode()).hexdigest()[:24]} for i, u in enumerate(units)]
