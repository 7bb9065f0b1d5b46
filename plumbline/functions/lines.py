"""What a line of code logs: sinks, severity, concepts, risk features and labels, as native expressions.

Names in a line are hints. What an expression can't tell is said as such; nothing here proves a leak.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings and directories of source files
SOURCE_EXTENSIONS = ".bash .c .cc .cpp .cs .cxx .dart .ex .exs .fs .fsx .go .h .hpp .java .js .jsx .kt .php .py .r .rb .rs .sh .svelte .swift .ts .tsx .vue .zsh .zig".split()
EXCLUDED_PARTS = (
    ".cache .git .next .nuxt .venv __pycache__ build coverage dist example examples fixture fixtures generated e2e node_modules out sample samples target test testing tests vendor vendors venv".split()
)
TEST_PARTS = "test tests example examples fixture fixtures sample samples".split()
# fixed values: directories and names by the scope of a file, the first that holds counting
SCOPES = (
    ("test", "tests test __tests__ fixtures __fixtures__ testdata".split(), r"^test_|\.test\.|\.spec\."),
    ("example", "examples example samples sample demo demos".split(), None),
    ("generated_or_vendor", "vendor node_modules dist build generated __generated__".split(), r"(\.min\.js|\.generated\.py|\.g\.go)$"),
    ("development_tool", "scripts tools .github .claude .codex".split(), None),
)
# fixed values: calls that log
LOG = (
    r"(?i)(?:\bconsole\s*\.\s*(?:log|error|warn|debug|info|trace)\s*\(|\b(?:logger|logging|log)\s*\.\s*(?:debug|info|warn|warning|error|exception|critical|trace|fatal)\s*\("
    r"|(?<![.\w])print\s*\(|\bfmt\s*\.\s*(?:Print|Printf|Println|Fprint|Fprintf|Fprintln)\s*\(|\blog\s*\.\s*(?:Print|Printf|Println|Fatal|Fatalf|Panic|Panicf)\s*\("
    r"|\bSystem\s*\.\s*(?:out|err)\s*\.\s*print(?:ln)?\s*\(|\b(?:println|eprintln|dbg|debug|info|warn|error|trace)!\s*\(|\bNSLog\s*\()"
)
SHELL_LOG = r"(?i)^\s*(?:echo|printf)\b"
LEVEL_CALL = r"(?i)\b(?:console|logger|logging|log)\s*\.\s*(?:debug|info|warn|warning|error|exception|critical|trace|fatal)\s*\(|\b(?:debug|info|warn|error|trace)!\s*\("
# fixed values: concepts and the words for them
CONCEPTS = {
    "api_key": r"(?<![a-z0-9])api[_ -]?keys?\b", "config": r"\bconfig(?:uration)?\b", "cookie": r"\bcookies?\b", "credential": r"\bcredentials?\b", "email": r"\be-?mails?\b",
    "environment": r"\b(?:env(?:ironment)?(?:_vars?)?|process\.env)\b", "error": r"\b(?:errors?|exceptions?|tracebacks?|stack_trace)\b", "headers": r"\bheaders?\b",
    "ip": r"\bip(?:_address|addr)?\b", "memory": r"\b(?:agent_memory|long_term_memory|memory)\b", "messages": r"\b(?:system_message|developer_message|chat_messages?|llm_messages?)\b",
    "model_output": r"\b(?:model|llm|assistant)_(?:response|output)\b", "password": r"\bpasswords?\b", "path": r"\b(?:file_)?paths?\b", "payload": r"\bpayload\b",
    "prompt": r"\b(?:system_|developer_)?prompt\b", "request": r"\brequests?\b", "response": r"\bresponses?\b", "secret": r"\bsecrets?\b", "session": r"\b(?:sessions?|session_id)\b",
    "token": r"\b(?:access_|refresh_)?tokens?\b", "tool_input": r"\btool_(?:input|arguments?)\b", "tool_output": r"\btool_(?:result|output)\b", "user": r"\b(?:users?|user_id)\b",
}
AGENT_CONTROL = "memory messages model_output prompt tool_input tool_output".split()
AUTH_CONFIG = "api_key config cookie credential environment password secret token".split()
REQUEST_RESPONSE = "headers payload request response".split()
IDENTITY_SESSION = "email ip path session user".split()
# fixed values: severities, the first that holds counting
SEVERITIES = (
    ("fatal", r"(?i)\b(?:fatal|critical|panic|panicf)\b"), ("error", r"(?i)\b(?:error|exception|eprintln)\b|System\s*\.\s*err"), ("warn", r"(?i)\b(?:warn|warning)\b"),
    ("debug", r"(?i)\b(?:debug|dbg)\b"), ("trace", r"(?i)\btrace\b"), ("info", r"(?i)\binfo\b"),
)
# fixed values: words of high and of medium risk
HIGH_RISK = "secret token api_key apikey password credential authorization bearer header headers cookie private_key access_key jwt".split()
MEDIUM_RISK = "response error exception user session payload request body email phone address".split()
# fixed values: what excerpts hide
EXCERPT = (
    (r"(?i)\b(?:gh[opsu]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})\b", "[REDACTED_SECRET]"),
    (r"(?i)\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_SECRET]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}", "Bearer [REDACTED_SECRET]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
)
# fixed values: sinks by family; of those in a line the first counts
SINKS = (
    ("structured_logger", r"(?i)\b(?:logging|logger|log)\s*\.\s*(?:trace|debug|info|warn|warning|error|fatal|critical|exception)\s*\("),
    ("console_stdio", r"(?i)\bconsole\s*\.\s*(?:log|error|warn|debug|info|trace)\s*\("),
    ("structured_logger", r"\b(?:debug|info|warn|error|trace)\s*!\s*\("),
    ("print_stdio", r"(?i)\b(?:print|println|eprintln|dbg|NSLog)\s*!?\s*\("),
    ("print_stdio", r"(?i)\bSystem\s*\.\s*(?:out|err)\s*\.\s*print(?:ln)?\s*\("),
    ("print_stdio", r"(?i)\b(?:fmt|log)\s*\.\s*(?:Print|Printf|Println|Fatal|Fatalf|Panic|Panicf|Fprint|Fprintf|Fprintln)\s*\("),
    ("shell_stdio", r"(?i)(?:^|[;&|]\s*)\b(?:echo|printf)\b"),
    ("print_stdio", r"(?i)^\s*(?:puts|print)\s+"),
)
# fixed values: languages of the study, by ending, with the directories and names that are left out
LANGUAGES = (
    ("python", r"\.py$", "build dist site-packages vendor".split(), r"_test\.py$|^test_.*\.py$"),
    ("java", r"\.java$", "target bin build".split(), r"test\.java$"),
    ("javascript_typescript", r"\.(js|jsx|ts|tsx)$", "node_modules dist public vendor".split(), r"(\.min\.js|\.map|\.gz|\.bundle\.js|\.worker\.js)$"),
)
# fixed values: labels of a review by the patterns of the security taxonomy, in order of priority
REVIEW_LABELS = (
    ("PR-CRED", ["SS-Cr"]), ("PR-USER", ["SS-Ur"]), ("PR-CONFIG", ["SS-Cf"]), ("PR-RAW-DUMP", ["RM-Ms", "RM-Ft"]), ("PR-REDACTION", ["RM-Ms", "RM-Ft"]),
    ("PR-ERROR", ["EE-Ex", "EE-St"]), ("PR-LOG-INTEGRITY", ["IL-At", "IL-Pa", "IL-Lv"]),
)

#: A quoted text, and all of a line before its comment; possessive, so that no line makes them backtrack.
QUOTED = r"'(?:\\.|[^'\\])*+'|\"(?:\\.|[^\"\\])*+\""
CODE = r"^(?:[^'\"#/]|/(?!/)|'(?:\\.|[^'\\])*+(?:'|$)|\"(?:\\.|[^\"\\])*+(?:\"|$))*+"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def parts(path: Column) -> Column:
    """The parts of a path in small letters, without empty ones."""
    return F.filter(F.split(F.lower(F.trim(F.replace(path, F.lit("\\"), F.lit("/")))), "/"), lambda p: p != "")


def _among(found: Column, words: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))


def _name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def file_scope(path: Column) -> Column:
    """test, example, generated_or_vendor, development_tool or application_or_unknown; the latter is no finding."""
    out, own, name = None, parts(F.coalesce(path, F.lit(""))), _name(F.coalesce(path, F.lit("")))
    for scope, words, pattern in SCOPES:
        holds = _among(own, words) if pattern is None else _among(own, words) | name.rlike(pattern)
        out = F.when(holds, scope) if out is None else out.when(holds, scope)
    return out.otherwise("application_or_unknown")


def is_source_file(path: Column) -> Column:
    name, words = _name(path), [w for w in EXCLUDED_PARTS if w not in TEST_PARTS]
    ending = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return (F.size(parts(path)) > 0) & ~_among(parts(path), words) & (name.isin("dockerfile", "makefile") | ending.isin(*SOURCE_EXTENSIONS))


def is_production_path(path: Column) -> Column:
    name = _name(path)
    return (F.size(parts(path)) > 0) & ~_among(parts(path), EXCLUDED_PARTS) & ~name.rlike(r"^test[_-]|_test\.py$|\.(?:test|spec)\.|\.snap$")


def study_language(path: Column) -> Column:
    """The study's language of a file, null for others and for what it leaves out."""
    out, own = F.lit(None).cast("string"), parts(path)
    name = _name(path)
    folders = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    for language, ending, words, left_out in reversed(LANGUAGES):
        out = F.when(name.rlike(ending), F.when(~_among(folders, words) & ~name.rlike(left_out), language)).otherwise(out)
    return out


def without_comment(text: Column) -> Column:
    """A line up to # or // that stand outside of quotes."""
    return F.regexp_extract(text, CODE, 0)


def without_literals(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, QUOTED, by)


def paren_balance(text: Column) -> Column:
    """Opening less closing parentheses outside of quotes."""
    bare = F.regexp_replace(text, QUOTED + r"|`(?:\\.|[^`\\])*+`|['\"`][\s\S]*$", "")
    return F.length(F.regexp_replace(bare, r"[^(]", "")) - F.length(F.regexp_replace(bare, r"[^)]", ""))


def concepts(text: Column) -> Column:
    """The names of CONCEPTS that a text holds, sorted."""
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(name)) for name, p in sorted(CONCEPTS.items())]), lambda x: x.isNotNull())


def classify_log(path: Column, line: Column) -> Column:
    """{executable, features, concepts} of a line: whether it calls a log, what risks the call's dynamic part shows, and
    what it speaks of. Comments are no calls."""
    bare = F.trim(line)
    code = F.trim(without_comment(bare))
    shell = F.lower(path).rlike(r"\.(sh|bash|zsh)$")
    executable = ~bare.rlike(r"^(?:#|//|/\*|\*|<!--|--)") & (bare != "") & (code.rlike(LOG) | (shell & code.rlike(SHELL_LOG)))
    own = concepts(F.regexp_replace(without_literals(code), LEVEL_CALL, "("))
    feature = lambda name, holds: F.when(holds, F.lit(name))
    found = [
        feature("agent_control_data", _among(own, AGENT_CONTROL)),
        feature("auth_config_data", _among(own, AUTH_CONFIG)),
        feature("debug_residue_marker", code.rlike(r"(?i)\b(?:DEBUG|TEMP(?:ORARY)?|DIAGNOSE|DUMP)\b")),
        feature("error_diagnostic_data", _among(own, ["error"]) | code.rlike(r"(?i)\.(?:error|exception|fatal|critical)\s*\(|\berror!\s*\(")),
        feature("identity_session_data", _among(own, IDENTITY_SESSION)),
        feature("request_response_data", _among(own, REQUEST_RESPONSE)),
        feature("tool_io_data", _among(own, ["tool_input", "tool_output"])),
        feature("unstructured_stdio", code.rlike(r"(?i)(?<![.\w])print\s*\(|\b(?:console\s*\.|fmt\s*\.|System\s*\.(?:out|err)|echo\b|printf\b)")),
        feature("whole_object_dump", _among(own, AGENT_CONTROL + AUTH_CONFIG + REQUEST_RESPONSE + IDENTITY_SESSION + ["error"])),
    ]
    yes = F.coalesce(executable, F.lit(False))
    empty = F.array().cast("array<string>")
    return F.struct(yes.alias("executable"), F.when(yes, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(empty).alias("features"), F.when(yes, concepts(code)).otherwise(empty).alias("concepts"))


def severity(text: Column) -> Column:
    out = F
    for name, pattern in SEVERITIES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("neutral")


def redact_excerpt(text: Column, limit: int = 800) -> Column:
    out = F.substring(text, 1, limit)
    for pattern, mark in EXCERPT:
        out = F.regexp_replace(out, pattern, mark)
    return out


def sink_family(line: Column, path: Column) -> Column:
    """{family, executable, reason}: the first sink of a line, and why it is none that runs."""
    at = [F.regexp_instr(line, F.lit(p)) for _, p in SINKS]
    found = F.array_sort(F.filter(F.array(*[F.struct(a.alias("at"), F.lit(name).alias("family")) for a, (name, _) in zip(at, SINKS, strict=True)]), lambda x: x["at"] > 0))
    first = F.try_element_at(found, F.lit(1))
    before = F.substring(line, F.lit(1), first["at"] - 1)
    inside = F.regexp_replace(before, QUOTED + r"|`(?:\\.|[^`\\])*+`", "").rlike("['\"`]")
    shell = F.lower(path).rlike(r"\.(sh|bash|zsh)$")
    comment = F.trim(line).rlike(r"^(?:#|//|/\*|\*|--|$)")
    reason = (
        F.when(comment, "comment_or_blank")
        .when(first.isNull(), "no_supported_sink")
        .when(inside, "sink_token_inside_string")
        .when(shell & F.substring(line, F.lit(1), first["at"]).rlike(r"\w+\s*=\s*\$\("), "captured_command_substitution")
        .when(shell & (first["family"] == "shell_stdio") & line.rlike(r"(?i)\b(?:echo|printf)\b[^|]*\|"), "piped_data_not_log")
        .otherwise("executable_sink")
    )
    family = F.when(comment, "noncode_match").when(first.isNull(), "unknown").otherwise(first["family"])
    return F.struct(family.alias("family"), (reason == "executable_sink").alias("executable"), reason.alias("reason"))


def risk_level(text: Column) -> Column:
    """{level, keywords}: high or medium by the words outside of literals, medium for others beside dynamic output."""
    low, outside = F.lower(text), F.lower(without_literals(text))
    holds = lambda t, words: any_of([t.contains(w) for w in words])
    dynamic = without_literals(text).contains(",") | text.rlike(r"%[sdv]|\{\w*\}|#\{[^}]+\}|\$\{[^}]+\}")
    dynamic |= outside.rlike(r"\b(request|response|headers?|cookies?|token|payload|session|user|error|err)\b\s*[.)\]}]")
    level = F.when(holds(outside, HIGH_RISK), "high").when(holds(outside, MEDIUM_RISK), "medium").when(holds(low, HIGH_RISK + MEDIUM_RISK) & dynamic, "medium").otherwise("low")
    words = F.filter(F.array(*[F.when(low.contains(w), F.lit(w)) for w in HIGH_RISK + MEDIUM_RISK]), lambda x: x.isNotNull())
    return F.struct(level.alias("level"), words.alias("keywords"))


def dynamic_values(text: Column) -> Column:
    """What a statement logs besides its fixed text: interpolations, and the code outside of literals."""
    inner = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"\$\{([^}]*)\}", r"#\{([^}]*)\}", r"\{([A-Za-z_][\w\.\[\]'\"]*)\}")])
    return F.concat_ws(" ", F.array_join(inner, " "), without_literals(F.regexp_replace(text, r"`(?:\\.|[^`])*`", " "), " "))


def structural_features(text: Column) -> dict[str, Column]:
    """Booleans on how a log is built, by name."""
    literals = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(QUOTED + r"|`(?:\\.|[^`\\])*+`"), F.lit(0)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), " ")
    bare = F.regexp_replace(text, QUOTED + r"|`(?:\\.|[^`\\])*+`", '""')
    slots = F.regexp_count(literals, F.lit(r"%(?:\([^)]+\))?[#0 +\-]?[0-9.*]*[a-zA-Z]|\$\{[^{}]+\}|\{[a-zA-Z_][^{}]*\}|\{\}"))
    more = text.rlike(r"['\"]\s*,\s*(?!\s*(?:end|file|flush)\s*=)[^)]")
    dynamic = (slots > 0) | more | literals.rlike(r"\$\{[^{}]+\}|\{[a-zA-Z_][^{}]*\}") | bare.rlike(r"\+\s*[a-zA-Z_]|\.format\s*\(")
    return {
        "dynamic_value": dynamic,
        "multiple_dynamic_values": (slots >= 2) | (F.regexp_count(bare, F.lit(",")) >= 2),
        "literal_only": ~dynamic,
        "key_value_message": literals.rlike(r"\b[a-zA-Z_][\w.-]*\s*(?:=|:)\s*"),
        "structured_metadata_argument": text.rlike(r"['\"]\s*,\s*[\[{]") | text.rlike(r"(?i),\s*(?:extra|context|fields|metadata)\s*="),
        "long_literal_message": F.length(literals) >= 80,
    }


# fixed values: patterns of the security taxonomy over what is logged, with the label that each gives
SECURITY = {
    "credential": r"(?i)(secret(?!properties)|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|credential|auth[_-]?token|refresh[_-]?token|access[_-]?token|id[_-]?token|purchase[_-]?token|continuation[_-]?token|bearer|\boauth|\bjwt\b|keystore|\bcookie|session[_-]?data[_-]?key|session[_-]?key|auth[_-]?cookie|token(?!iz))",
    "user": r"(?i)(user[_-]?name|username|user[_-]?data|userdata|user[_-]?info|user[_-]?profile|user[_-]?account|user[_-]?id|userid|\buser_did\b|\bcurrent[_-]?user\b|\bcustomer[_-]?(?:id|name|data)\b|\bemail\b|e-?mail|\bphone\b|mobile[_-]?no|msisdn|first[_-]?name|last[_-]?name|nick[_-]?name|\bssn\b|passport|pesel|home[_-]?address|mail(?:ing)?[_-]?address|billing[_-]?address|street|account[_-]?id|device[_-]?id|transaction[_-]?id|txn[_-]?id|order[_-]?id|invoice[_-]?id)",
    "config": r"(?i)(database[_-]?url|connection[_-]?string|conn[_-]?str|jdbc|\bdsn\b|environment|\benv\b|\bconfig\b|\bconfiguration\b|(?<!secret)properties|settings|working[_-]?dir|out[_-]?file|file[_-]?path|filepath|get[_-]?absolute[_-]?path|\bpath\b|\burl\b|backend[_-]?url|\bhost(?:name)?\b|\bport\b|endpoint|bucket|namespace|\bregion\b|\bcommand\b|command[_-]?args?|command[_-]?line|cli[_-]?args?|temp[_-]?dir|tempdir)",
    "dump": r"(?i)(json\.?stringify|jsonutils\.encode|\.encode\(|\bdump\b|getresponsetext|get[_-]?body|\.body\b|responsetext|\.content\(\)|prettystring|to[_-]?json|getentity|\.payload\b|var_export|print_r|\.inspect\(\)|\.entries\(\))|\b(request|response|payload|req_?body|res_?body)\b",
    "object": r"(?i)\b(request|response|payload|body|results?|data|obj|object|config|props|params|entity|model|dto|record|message|profile|account|prompt)\b",
    "stack": r"(?i)(print[_-]?stack[_-]?trace|get[_-]?stack[_-]?trace|\.stack\b|traceback|format_exc|backtrace|stack\s*trace|\.exception\s*\()",
    "redaction": r"(?i)\b(redact|mask|masked|masking|sanitize|sanitise|obfuscat|scrub|filtersensitive|anonym)\b",
    "error": r"(?i)\b(exception|error|err|throwable|panic|fatal|failure|failed)\b",
    "carried": r"(?i)(get[_-]?message\(\)|getlocalizedmessage|argument[_-]?string|argumentstring|row[_-]?string|rowstring|user[_-]?input|raw[_-]?input|request[_-]?body|input[_-]?value)",
    "exception_name": r"(?i)^(e|e2|err|err2|error|error2|ex|exc|exception|throwable|t|t2|cause|reason|fault|axisfault)$",
    "decoded": r"(?i)(base64|\.decode\(|atob\(|fromcharcode)",
    "decoded_word": r"(?i)(token|secret|password|api[_-]?key|credential|private[_-]?key)",
    "sink": r"(?i)(console\.(?:log|error|warn|info|debug|trace)|\blogger?\b|System\.out|System\.err|\bprint(?:ln|f|_r|stacktrace)?\s*\(|fmt\.(?:Print|Fprint|Errorf|Sprintf|Printf|Println|Fprintf)|e?println!|e?print!|\bslog\b|\bzap\b|\blog!|\bwarn!|\binfo!|\bdebug!|\btrace!|\berror!|\.error\s*\(|\.warn\s*\(|\.info\s*\(|\.debug\s*\(|\.trace\s*\(|\.fatal\w*\s*\(|\becho\b|\.exception\s*\()",
    "asset": r"(?i)(\.min\.(?:js|css)|/dist/|-dist/|gui-dist|/assets/[^/]+-[a-z0-9_]{6,}\.(?:js|css)|/vendor/|/build/|\.bundle\.)",
    "bare": r"(?:println!?|print!?|printf|puts|echo|console\.(?:log|error|warn|info|debug|trace)|System\.(?:out|err)\.print(?:ln)?|fmt\.[A-Za-z]*[Pp]rint[A-Za-z]*|[A-Za-z_]\w*\.(?:log|error|warn|info|debug|trace))\s*\(\s*([A-Za-z_]\w*)\s*\)",
    "injection": r"(?i)(crlf|log\s*injection|log[\s-]*forg\w*|forged|forging|forgery|%0a|%0d|\bxss\b)",
    "newline": r"(\\n|\\r)",
    "input": r"(?i)\b(input|param|parameter|request|userinput|body|payload|header)\b",
    "level": r"(?i)\b(trace|debug|info)\b",
}
# fixed values: the order of the taxonomy's patterns
PATTERN_ORDER = "SS-Cr SS-Ur SS-Cf RM-Ft RM-Ms EE-St EE-Ex IL-At IL-Lv".split()


def security_patterns(text: Column, file: Column, risk: Column) -> Column:
    """{status, patterns, primary, confidence}: the taxonomy's patterns that a logging line shows, the weightiest first;
    status is non_log, no_candidate or candidate."""
    holds = lambda c, name: c.rlike(SECURITY[name])
    outside, values = without_literals(text), dynamic_values(text)
    bare = F.regexp_extract(outside, SECURITY["bare"], 1)
    cred = holds(values, "credential") | holds(bare, "credential") | (holds(text, "decoded") & holds(text, "decoded_word"))
    user, config = holds(values, "user") | holds(bare, "user"), holds(values, "config")
    dump = holds(values, "dump") | holds(bare, "object")
    masked, stack = holds(text, "redaction"), holds(text, "stack")
    dynamic = outside.contains(",") | text.rlike(r"%[sdv]|\{\w*\}|#\{[^}]+\}|\$\{[^}]+\}") | outside.rlike(r"(?i)\b(request|response|headers?|cookies?|token|payload|session|user|error|err)\b\s*[.)\]}]")
    alone = (bare != "") & holds(bare, "exception_name")
    carries = holds(values, "carried") | (dynamic & (dump | holds(values, "credential") | holds(values, "user") | config) & ~alone)
    base = {
        "SS-Cr": cred, "SS-Ur": user, "SS-Cf": config, "RM-Ft": masked & (dump | dynamic), "RM-Ms": dump & ~masked, "EE-St": stack,
        "EE-Ex": holds(text, "error") & ~stack & carries, "IL-At": holds(text, "injection") | (holds(text, "newline") & holds(outside, "input")),
    }
    sensitive = any_of([base[p] for p in PATTERN_ORDER if p[:2] in ("SS", "RM", "EE")])
    base["IL-Lv"] = holds(outside, "level") & sensitive
    found = F.filter(F.array(*[F.when(base[p], F.lit(p)) for p in PATTERN_ORDER]), lambda x: x.isNotNull())
    minified = (F.length(text) > 1500) & (F.regexp_count(text, F.lit(r"(function\s*\(|=>|Symbol\.for\(|;var |\|\||&&)")) >= 5)
    no_log = holds(file, "asset") | minified | ~holds(outside, "sink")
    primary = F.try_element_at(found, F.lit(1))
    strong = primary.isin("SS-Cr", "SS-Ur", "SS-Cf", "RM-Ms", "RM-Ft")
    sure = F.when((risk == "high") & strong, "high").when(primary.isin("EE-Ex", "IL-Lv") & (risk == "low"), "low").when(primary.isNotNull(), "medium").otherwise("low")
    none = F.array().cast("array<string>")
    status = F.when(no_log, "non_log").when(F.size(found) == 0, "no_candidate").otherwise("candidate")
    return F.struct(
        status.alias("status"), F.when(no_log, none).otherwise(found).alias("patterns"), F.when(~no_log, primary).alias("primary"), F.when(no_log, "low").otherwise(sure).alias("confidence")
    )


def review_labels(patterns: Column) -> Column:
    """The labels of a review by the taxonomy's patterns."""
    return F.filter(F.array(*[F.when(_among(patterns, own), F.lit(label)) for label, own in REVIEW_LABELS]), lambda x: x.isNotNull())


def sensitive_probe(command: Column) -> Column:
    """A tool's command reads credentials: the environment, well-known files or variables of secrets."""
    return (
        command.rlike(r"(?i)(?:^|[;&|\s])(?:printenv|env)(?:\s|$|[;&|])")
        | command.rlike(r"(?i)(?:\.env(?:\.|\b)|\.aws[/\\]credentials|\.ssh[/\\]|kubeconfig|credentials?(?:\.json)?)")
        | command.rlike(r"\$[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASS(?:WORD)?|CREDENTIAL)[A-Z0-9_]*")
    )


def logging_prompt(text: Column) -> Column:
    """A prompt asks for logs, or for data to be printed."""
    a = r"(?is)\b(?:add|insert|enable|improve|instrument|write|emit|record)\w*\b.{0,80}\b(?:logs?|logging|logger|debug|trace|console|stdout|stderr)\b"
    b = r"(?is)\b(?:print|dump|show)\w*\b.{0,80}\b(?:requests?|responses?|headers?|payload|body|tokens?|secrets?|credentials?|environment|config|users?|sessions?|errors?|exceptions?|tracebacks?)\b"
    return text.rlike(a) | text.rlike(b)


def issue_references(text: Column, repo: Column) -> Column:
    """The distinct issues that a text names, as repository#number: by URL, across repositories, or bare in its own."""
    url = F.transform(F.regexp_extract_all(text, F.lit(r"https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/issues/\d+"), F.lit(0)), lambda u: F.replace(F.replace(u, F.lit("https://github.com/"), F.lit("")), F.lit("/issues/"), F.lit("#")))
    across = F.regexp_extract_all(text, F.lit(r"(?<![\w/])[\w.-]+/[\w.-]+#\d+"), F.lit(0))
    rest = F.regexp_replace(text, r"https?://\S+|[\w.-]+/[\w.-]+#\d+|`[^`]*`", " ")
    bare = F.transform(F.regexp_extract_all(rest, F.lit(r"(?<![\w/#])#\d+\b"), F.lit(0)), lambda n: F.concat(repo, n))
    return F.array_sort(F.array_distinct(F.concat(url, across, bare)))


def repository_path(path: Column, repo: Column) -> Column:
    """A path within its repository: without a/, b/ or what leads to the repository's folder."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[ab]/", "")
    after = lambda mark: F.when(F.instr(clean, mark) > 0, F.substring(clean, F.instr(clean, mark) + F.length(mark), F.length(clean)))
    own = F.concat(F.lit("/"), F.substring_index(repo, "/", -1), F.lit("/"))
    safe = F.concat(F.lit("/"), F.replace(repo, F.lit("/"), F.lit("__")), F.lit("/"))
    return F.coalesce(after(own), after(safe), F.regexp_replace(clean, "^/+", ""))


def patch_digests(diff: Column) -> Column:
    """{canonical, content}: SHA-256 of a diff with unified line ends, and with the texts of its hunks' headers gone;
    empty for an empty diff."""
    unified = F.concat(F.regexp_replace(F.regexp_replace(diff, r"\r\n?", "\n"), r"\n+\z", ""), F.lit("\n"))
    bare = F.regexp_replace(unified, r"(?m)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@).*$", "$1")
    digest = lambda c: F.when(F.coalesce(diff, F.lit("")) != "", F.sha2(c, 256)).otherwise("")
    return F.struct(digest(unified).alias("canonical"), digest(bare).alias("content"))


def iso_time(text: Column) -> Column:
    """An ISO time as a timestamp, without a zone UTC; null where it is none."""
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.when(text.contains(":"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.try_to_timestamp(zoned)


def language_distance(a_ext: Column, b_ext: Column) -> Column:
    """The share of endings that only one of two changes has; 0 where there is none."""
    union = F.size(F.array_union(a_ext, b_ext))
    return F.when(union > 0, 1 - F.size(F.array_intersect(a_ext, b_ext)) / union).otherwise(0.0)


def weighed(language: Column, a_log: Column, b_log: Column, a_files: Column, b_files: Column, a_micros: Column, b_micros: Column) -> Column:
    """log_distance from its parts: the distance of endings, sizes in logs and times in microseconds."""
    days = F.abs(a_micros - b_micros) / 86_400e6
    return 2 * language + F.abs(a_log - b_log) + 0.25 * F.abs(a_files - b_files) + days / 365


def log_distance(a_ext: Column, b_ext: Column, a_size: Column, b_size: Column, a_files: Column, b_files: Column, a_time: Column, b_time: Column) -> Column:
    """How unlike two changes are: twice the distance of their endings, of sizes in logs, a quarter of files, days in years."""
    return weighed(language_distance(a_ext, b_ext), F.log1p(a_size), F.log1p(b_size), a_files, b_files, F.unix_micros(a_time), F.unix_micros(b_time))


def pair_reason(a_digest: Column, b_digest: Column, a_size: Column, b_size: Column, most: float) -> Column:
    """Why a pair of diffs is not taken: equal, without production change on a side, or too unlike in size; or accepted."""
    ratio = (F.greatest(a_size, b_size) + 1) / (F.least(a_size, b_size) + 1)
    return (
        F.when(a_digest == b_digest, "identical_final_diff").when(a_size == 0, "agent_no_production_source_change").when(b_size == 0, "human_no_production_source_change")
        .when(ratio > most, "final_size_caliper").otherwise("accepted")
    )


def spans_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open spans share a place; one of no width counts where it lies within the other or at its ends."""
    return F.when((a0 == a1) | (b0 == b1), (F.greatest(a0, b0) <= F.least(a1, b1))).otherwise(F.greatest(a0, b0) < F.least(a1, b1))


def human_exclusion(url_is_agent: Column, login: Column, text: Column, marker: str) -> Column:
    """Why a pull request does not count as a person's, or empty."""
    return F.when(url_is_agent, "canonical_pr_also_in_agent_table").when(F.lower(login).endswith("[bot]"), "bot_login").when(text.rlike(marker), "explicit_ai_assistance_marker").otherwise("")


# fixed values: modules by words in a path or a log, the first that holds counting
MODULES = (
    ("auth/security", "auth|oauth|jwt|token|session|login|password|credential|security|permission|acl|identity|key"),
    ("api/http boundary", "api|http|request|response|route|controller|handler|endpoint|client|server|middleware|webhook|grpc"),
    ("data/storage/user records", "database|db|sql|model|entity|repository|store|storage|user|account|profile|customer|email"),
    ("config/env/deploy", "config|env|secret|setting|docker|kubernetes|helm|deploy|container|infra"),
    ("observability/debugging", "log|logger|logging|trace|telemetry|metric|monitor|debug"),
    ("tests/examples", "test|spec|mock|fixture|example|demo|sample"),
    ("cli/tools", "cli|cmd|command|script|tool|shell"),
)


def module_category(path: Column, text: Column) -> Column:
    """The module that a log belongs to by its path and text."""
    where = F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(text, F.lit(""))))
    out = F
    for name, words in MODULES:
        out = out.when(where.rlike(words), name)
    return out.otherwise("other application code")


def human_pull(kind: Column, app: Column, merged: Column, by_agent: Column) -> Column:
    """A merged pull request of a person's account, made through no app and not among the agents'."""
    return F.coalesce((kind == "User") & app.isNull() & merged.isNotNull() & ~by_agent, F.lit(False))


def graded_evidence(change: Column, grade: Column, executable: Column, attribution: Column, allowed: tuple[str, ...]) -> Column:
    """An added log that runs, with evidence of grade A and one of the allowed attributions."""
    return F.coalesce((change == "add") & (grade == "A") & executable & attribution.isin(*allowed), F.lit(False))
