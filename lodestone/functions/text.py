"""Scalar functions over text, dates and identifiers, as Column expressions (no Python on the executors)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------
LEAK_PATTERNS = [
    ("home-path", "high", r"(?i)(?<![A-Za-z0-9_])(?:/(?:Users|home)/[^/\s'\")]+|[A-Za-z]:\\Users\\)"),
    ("secret", "high", r"(?<![A-Za-z0-9_])(?:sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[a-z]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9_])|eyJ[A-Za-z0-9_=-]{5,}\.[A-Za-z0-9_=-]{5,}\.[A-Za-z0-9_=-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("commit-sha", "warn", r"(?i)(?<![A-Za-z0-9_])[0-9a-f]{40}(?![A-Za-z0-9_])"),
    ("email", "warn", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
    ("guid", "warn", r"(?i)(?<![A-Za-z0-9_])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![A-Za-z0-9_])"),
]
SIGNAL_WORDS = {
    "debugging": ["bug", "error", "fix", "debug", "root cause", "traceback", "broken", "问题", "修复"],
    "architecture": ["architecture", "design", "pattern", "trade-off", "decision", "approach", "架构", "设计"],
    "discovery": ["learned", "discovered", "insight", "gotcha", "trap", "pitfall", "trick", "发现", "陷阱", "关键"],
    "reasoning": ["because", "instead of", "rather than", "why", "the reason", "原因", "所以", "因为"],
    "evaluation": ["review", "evaluate", "score", "verdict", "assessment", "评估", "审查"],
}
DECISION = r"(?i)(我决定|我们决定|最后采用|最后用|let'?s go with|decided to|going with|ok merged|merged it|ship it as)"
#: What a text must hold, in one of these spellings, for a leak pattern to be found in it.
LEAK_MARKS = {"home-path": ("/", ":\\"), "secret": ("sk-", "ghp_", "github_pat_", "xox", "AKIA", "eyJ", "-----BEGIN "), "email": ("@",), "guid": ("-",)}
MEMORY_TYPES = ["core", "semantic", "episodic", "procedural"]
SLUG_UNSAFE = r"[\\/:*?\"<>|\s.,;!()\[\]{}@#$%^&+=`~]+"
QUESTION_UNSAFE = r"[\\/:*?\"'<>|\s.,;!()\[\]{}@#$%^&+=`~]+"
CONTROL = r"[\x00-\x1F\x7F-\x9F]"
# ----------------------------------------------------------------------------------------

_BLANK = r"[\s\x{00A0}\x{FEFF}]+"


def text_of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x: Column) -> Column:
    """Distinct lower-case word tokens of more than one character."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_]{2,}"), F.lit(0)))


def finite(x: Column, default: float = 0.0) -> Column:
    x = x.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def as_array(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def instant(x: Column) -> Column:
    """A timestamp of an ISO-shaped text, else null; other texts that the engine might read are refused."""
    return F.when(x.rlike(r"^\s*\d{4}"), F.try_to_timestamp(x))


def calendar_date(x: Column) -> Column:
    """The UTC day of an instant as text, null if unreadable."""
    return F.date_format(instant(x), "yyyy-MM-dd")


def epoch_ms(x: Column) -> Column:
    return F.unix_millis(instant(x))


def days_between(now: Column, then: Column) -> Column:
    """Days from ``then`` to ``now``; null, so that no comparison holds, if either is unreadable."""
    return (epoch_ms(now) - epoch_ms(then)) / 86_400_000.0


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def expired(valid_to: Column, now: Column) -> Column:
    """The day of ``valid_to`` is not after that of ``now``; an unreadable day never is."""
    return holds(calendar_date(valid_to) <= calendar_date(now))


def in_scope(scope: Column, project: str | None) -> Column:
    """Global and user rows, and those of the project; any row without a project to ask for."""
    if project is None:
        return F.lit(True)
    return holds(scope.isin("global", "user") | (scope == f"project:{project}"))


def recency(updated: Column, now: Column, future: float = 2.0) -> Column:
    """2 within 7 days, 1 within 30, else 0; ``future`` for what lies ahead, 0 if unreadable."""
    d = days_between(now, updated)
    return F.when(d < 0, F.lit(future)).when(d <= 7, 2.0).when(d <= 30, 1.0).otherwise(0.0)


def is_gated(type_: Column, status: Column) -> Column:
    return holds(type_.isin("core", "procedural")) | holds(status == "pinned")


def supersedes_id(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def control_free(x: Column) -> Column:
    return F.regexp_replace(x, CONTROL, " ")


def has_control(x: Column) -> Column:
    return x.rlike(CONTROL)


def _safe_segments(x: Column) -> Column:
    return F.forall(F.split(x, "/"), lambda s: (F.length(s) > 0) & (s != ".") & ~s.contains("..") & ~s.contains("\\") & ~s.contains("\0"))


def is_safe_id(x: Column) -> Column:
    return holds((F.length(x) <= 256) & x.rlike(r"^[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*$") & ~x.contains("\n") & _safe_segments(x))


def is_writable_id(x: Column) -> Column:
    return holds((F.length(x).between(1, 256)) & ~has_control(x) & _safe_segments(x))


def last_segment(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def memory_path(type_: Column, project: Column, id_: Column) -> Column:
    """The row's path; null where a part isn't safe or the type is unknown."""
    scope, slug = F.coalesce(project, F.lit("_global")), last_segment(id_)
    safe = lambda s: (F.length(s) > 0) & (s != ".") & ~s.contains("/") & ~s.contains("\\") & ~s.contains("..") & ~s.contains("\0")
    return F.when(type_.isin(*MEMORY_TYPES) & safe(scope) & safe(slug), F.concat(F.lit("memory/"), type_, F.lit("/"), scope, F.lit("/"), slug, F.lit(".md")))


def is_unset(x: Column) -> Column:
    return x.isNull() | F.trim(x).isin("", "undefined", "null")


def memory_identity(id_: Column, project: Column) -> Column:
    """STRUCT<scope, project>: from the project, else from the middle of the id."""
    parts = F.split(id_, "/")
    middle = F.when(F.size(parts) >= 3, F.element_at(parts, -2))
    p, m = F.trim(project), F.trim(middle)
    row = lambda scope, project: F.struct(scope.alias("scope"), project.cast("string").alias("project"))
    by_project = F.when(p == "_global", row(F.lit("global"), project)).otherwise(row(F.concat(F.lit("project:"), p), project))
    by_middle = F.when(is_unset(middle) | (m == "_global"), row(F.lit("global"), F.lit(None))).otherwise(row(F.concat(F.lit("project:"), m), m))
    return F.when(~is_unset(project), by_project).otherwise(by_middle)


def collapsed(x: Column) -> Column:
    """White space runs as single blanks, trimmed."""
    return F.trim(F.regexp_replace(x, _BLANK, " "))


def preview(x: Column, most: int) -> Column:
    c = collapsed(x)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def for_display(x: Column) -> Column:
    """Terminal sequences and control characters out, blanks collapsed, at most 120 characters."""
    s = x
    # fixed values: terminal sequences
    for pattern in (r"(?s)\x1b\].*?(?:\x07|\x1b\\|$)", r"(?s)\x1b[P^_X].*?(?:\x1b\\|$)", r"\x1b\[[0-9;:<=>?]*[ -/]*[@-~]", r"\x1b[ -/]*[0-~]", r"\x1b"):
        s = F.regexp_replace(s, pattern, "")
    s = preview(control_free(s), 120)
    return F.when(s == "", F.lit("(unprintable)")).otherwise(s)


def inert_id(x: Column) -> Column:
    return F.concat(F.lit("'"), F.regexp_replace(F.substring(for_display(x), 1, 120), "[^A-Za-z0-9._/-]", "?"), F.lit("'"))


def restore_command(id_: Column, source: Column) -> Column:
    return F.when((source == "local") & is_safe_id(id_), F.concat(F.lit("memory-unarchive '"), id_, F.lit("'")))


def restore_instruction(id_: Column, source: Column, device: Column) -> Column:
    shown = for_display(F.coalesce(device, F.lit("")))
    where = F.when((F.coalesce(device, F.lit("")) != "") & (shown != "(unprintable)"), F.concat(F.lit("device "), shown)).otherwise(F.lit("another device"))
    local = F.coalesce(F.concat(restore_command(id_, source), F.lit(" to restore")), F.concat(F.lit("archived here under an unsafe id — restore manually (id "), inert_id(id_), F.lit(")")))
    away = F.concat(F.lit("archived on "), where, F.lit("; restore it there"))
    return F.when(source == "local", local).when(source == "overlay", away).otherwise(F.lit("origin unknown; restore it on the device that archived it"))


def leaks(x: Column) -> Column:
    """ARRAY<STRUCT<kind, severity, sample>>: one entry for each category found; each pattern runs once, and only on texts that hold one of its marks."""

    def sample(kind: str, pattern: str) -> Column:
        hit = F.regexp_extract(x, f"({pattern})", 1)
        marked = [F.contains(x, F.lit(m)) for m in LEAK_MARKS.get(kind, ())]
        return F.when(reduce(or_, marked), hit).otherwise(F.lit("")) if marked else hit

    found = [F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), sample(kind, pattern).alias("sample")) for kind, severity, pattern in LEAK_PATTERNS]
    shown = lambda h: F.when(h.kind == "secret", F.lit("[redacted]")).otherwise(F.substring(h["sample"], 1, 60))
    return F.transform(F.filter(F.array(*found), lambda h: h["sample"] != ""), lambda h: F.struct(h.kind.alias("kind"), h.severity.alias("severity"), shown(h).alias("sample")))


def has_blocking_leak(x: Column) -> Column:
    return x.rlike("|".join(f"(?:{p})" for _, severity, p in LEAK_PATTERNS if severity == "high"))


def slug_and_display(x: Column) -> Column:
    """STRUCT<slug, display> of a first message."""
    c = collapsed(x)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, SLUG_UNSAFE, "-"), "-+", "-"), "^-|-$", "")
    s = F.substring(s, 1, 60)
    named = lambda v: F.when(v == "", F.lit("untitled")).otherwise(v)
    return F.struct(named(s).alias("slug"), named(F.substring(c, 1, 120)).alias("display"))


def project_slug_of_path(x: Column) -> Column:
    parts = F.filter(F.split(x, r"[/\\]"), lambda p: (p != "") & ~p.rlike("^[A-Za-z]:$"))
    last, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return F.when(x.isNull() | (F.size(parts) == 0), F.lit("root")).when(F.size(parts) == 1, last).when(parent.isin("Users", "home"), F.lit("home")).otherwise(F.concat(parent, F.lit("-"), last))


def canonical_remote(x: Column) -> Column:
    """host/path of a remote address, null if it has none."""
    s = F.trim(F.coalesce(x, F.lit("")))
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
    rest = F.regexp_replace(F.regexp_replace(s, scheme, ""), "^[^@/]+@", "")
    scp = r"^(?:[^@/]+@)?([^/:]+):(.+)$"
    by_scheme = s.rlike(scheme)
    is_scp = s.rlike(scp) & ~F.split_part(F.regexp_extract(s, scp, 2), F.lit("/"), F.lit(1)).rlike(r"^\d+$")
    host = F.when(by_scheme & rest.contains("/"), F.split_part(rest, F.lit("/"), F.lit(1))).when(~by_scheme & is_scp, F.regexp_extract(s, scp, 1))
    path = F.when(by_scheme, F.regexp_replace(rest, "^[^/]*/", "")).otherwise(F.regexp_extract(s, scp, 2))
    host = F.lower(F.regexp_replace(host, r":\d+$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/+$", ""), r"(?i)\.git$", "")
    return F.when((host != "") & (path != ""), F.concat(host, F.lit("/"), path))


def project_slug_of_remote(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(canonical_remote(x), "[^A-Za-z0-9._-]+", "-"), "-+", "-"), "^-|-$", "")


def is_real_project(x: Column) -> Column:
    low = F.lower(x)
    junk = low.contains(".worktrees-") | low.endswith(".code-workspace") | low.endswith("-workspacestorage") | low.endswith("-workspace.json") | x.rlike(r"^\d{10,}") | x.rlike("^[a-f0-9]{20,}$")
    return holds(~x.isin("", "root", "home") & ~junk)


def user_sections(x: Column) -> Column:
    """Texts of the ``## User`` sections of a rendered session."""
    parts = F.split(F.concat(F.lit("\n"), x), r"\n(?=## )")
    chosen = F.filter(parts, lambda p: p.rlike(r"^## User\b"))
    bodies = F.transform(chosen, lambda p: F.regexp_replace(F.regexp_replace(p, r"^## User[^\n]*\n?", ""), r"^\s+|\s+$", ""))
    return F.filter(bodies, lambda p: p != "")


def is_own_session(first: Column, skill: str = "lodestone") -> Column:
    """The first user text calls the digest skill itself."""
    t = F.ltrim(F.coalesce(first, F.lit("")))
    return t.rlike(rf"(?i)^/{skill}(\b|$)") | t.rlike(rf"(?i)^/loop\s+/{skill}(\b|$)") | t.contains(f"skills/{skill}/SKILL.md")


def session_signals(body: Column) -> Column:
    """STRUCT<title, preview, insight> of a rendered session."""
    texts = user_sections(body)
    raw = F.array_join(texts, " ")
    joined = collapsed(raw)
    low = F.lower(joined)
    hits = [sum((low.contains(w).cast("int") for w in words), F.lit(0)) for words in SIGNAL_WORDS.values()]
    kinds, total = sum(((h > 0).cast("int") for h in hits), F.lit(0)), sum(hits, F.lit(0))
    ratio = F.length(raw) / F.greatest(F.length(body), F.lit(1))
    score = F.least(F.lit(1.0), kinds / 5 * 0.4 + total / 15 * 0.3 + ratio * 0.3)
    title = F.substring(collapsed(F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit(""))), 1, 80)
    shown = F.when(F.length(joined) > 300, F.concat(F.substring(joined, 1, 300), F.lit("…"))).otherwise(joined)
    return F.struct(title.alias("title"), shown.alias("preview"), F.when(joined == "", 0.0).when(kinds < 2, 0.1).otherwise(score).alias("insight"))


def question_slug(x: Column) -> Column:
    """Kebab words of a question, at most 48 characters, and eight digits of its hash."""
    line = F.lower(collapsed(control_free(x)))
    kebab = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, QUESTION_UNSAFE, "-"), "-+", "-"), "^-|-$", "")
    kebab = F.regexp_replace(F.substring(kebab, 1, 48), "-$", "")
    short = F.substring(F.sha2(line.cast("binary"), 256), 1, 8)
    return F.when(kebab == "", F.concat(F.lit("q-"), short)).otherwise(F.concat(kebab, F.lit("-"), short))


def branch_name(x: Column) -> Column:
    """A device's name as a branch name of at most 60 characters."""
    ends = lambda s: F.regexp_replace(s, r"[-.]+$", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9._-]", "-"), "-+", "-"), r"\.+", ".")
    s = ends(F.substring(F.regexp_replace(s, r"^[-.]+|[-.]+$", ""), 1, 60))
    s = F.when(s.endswith(".lock"), ends(F.regexp_replace(s, r"\.lock$", ""))).otherwise(s)
    return F.when(s == "", F.lit("device")).otherwise(s)


def flat_key(x: Column) -> Column:
    return F.replace(x, F.lit("/"), F.lit("__"))


# Commit and tag commands of a shell text
_HEREDOC = r"""\bgit\s+commit\b[^\n]*?-m\s+"\$\(cat\s+<<\s*'?(\w+)'?[\r\n]+([\s\S]*?)[\r\n]+\1\s*\)\""""
_MESSAGE = r"""\bgit\s+commit\b[^\n]*?-m\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(\S+))"""
_TAG = r"""\bgit\s+tag\b(?:[^\n]*?-(?:a|s)\s+)?\s*(v[\w.\-+]+)(?:[^\n]*?-m\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'))?"""


def commit_of(command: Column) -> Column:
    """STRUCT<sha, msg> of a shell text's commit or tag, null without one; a tag's name stands for its sha."""
    body = F.trim(F.split_part(F.trim(F.regexp_extract(command, _HEREDOC, 2)), F.lit("\n"), F.lit(1)))
    plain = F.trim(F.concat(*[F.regexp_extract(command, _MESSAGE, i) for i in (1, 2, 3)]))
    tag, note = F.regexp_extract(command, _TAG, 1), F.trim(F.concat(F.regexp_extract(command, _TAG, 2), F.regexp_extract(command, _TAG, 3)))
    row = lambda sha, msg: F.struct(sha.alias("sha"), msg.alias("msg"))
    as_tag = F.when(command.rlike(_TAG), row(tag, F.when(note != "", note).otherwise(F.concat(F.lit("tag "), tag))))
    heredoc = command.rlike(_HEREDOC)
    return F.when(heredoc & (body != ""), row(F.lit(""), body)).when(~heredoc & (plain != ""), row(F.lit(""), plain)).otherwise(as_tag)


def patch_paths(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File:|Move to:) (.+)$"), 1)
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")


def command_paths(x: Column) -> Column:
    """Distinct absolute paths of a shell text, URLs aside."""
    found = F.regexp_extract_all(x, F.lit(r"/[A-Za-z0-9._\-/]+(?:\.[A-Za-z0-9]+)?"), 0)
    return F.array_distinct(F.filter(found, lambda p: (F.length(p) >= 6) & ~x.contains(F.concat(F.lit("http://"), p)) & ~x.contains(F.concat(F.lit("https://"), p))))


def quoted_for_yaml(x: Column) -> Column:
    plain = x.rlike(r"^[A-Za-z0-9_\x{4E00}-\x{9FFF}\x{3000}-\x{303F} -]+$") & (x == F.trim(x))
    return F.when(plain, x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))


def shortened(x: Column, kind: str = "output") -> Column:
    """Texts over 20 KiB: the first 30 and last 10 lines, or of few lines the first 4000 and last 1000 characters."""
    lines = F.split(x, "\n")
    n = F.size(lines)
    kb = F.format_string("%.1f", F.octet_length(x) / 1024)
    few = F.concat(F.substring(x, 1, 4000), F.lit("\n\n[... truncated: "), kb, F.lit(" KB total, showing first 4000 + last 1000 chars ...]\n\n"), F.right(x, F.lit(1000)))
    many = F.concat(F.array_join(F.slice(lines, 1, 30), "\n"), F.lit("\n\n[... truncated: "), kb, F.lit(f" KB {kind}, omitting "), (n - 40).cast("string"), F.lit(" middle lines ...]\n\n"), F.array_join(F.slice(lines, -10, 10), "\n"))
    return F.when(F.octet_length(x) <= 20 * 1024, x).when(n <= 50, few).otherwise(many)
