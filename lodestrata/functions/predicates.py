"""Predicates over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.scalars import col, normalize, tokenize, trimmed

# Role words that name no thing.
GENERIC_ALIASES = (
    "agent", "app", "the app", "application", "cli", "codebase", "current directory", "cwd", "current worktree", "daemon", "dir", "directory",
    "engine", "executor", "here", "loop", "main", "module", "orchestrator", "package", "project", "the project", "repo", "the repo",
    "repo root", "repository", "root", "runner", "server", "service", "session", "task orchestrator", "tool", "this repo",
    "worktree", "workspace",
)
# The vocabulary of doing work.
PROCESS_NOUNS = (
    "approved", "bug", "branch", "change", "commit", "design", "doc", "docs", "error", "failed", "failure", "feature", "fix", "issue", "iteration",
    "note", "notes", "output", "passed", "phase", "plan", "pr", "private", "public", "report", "result", "results", "review", "spec", "status", "step",
    "task", "test", "tests", "ticket", "warning", "success", "done", "pending", "blocked",
)
# First segments that make a two-part path a location.
SOURCE_DIRS = ("apps", "src", "internal", "cmd", "packages", "lib", "pkg", "tests", "docs", "scripts")
# Places of temporary files.
TEMP_DIRS = ("/tmp/", "/private/tmp/", "/private/var/folders/", "/var/folders/")
# Symbol kinds by the node type that they become.
KINDS = {"function": ("function", "method"), "class": ("class", "struct", "type"), "interface": ("interface", "trait", "protocol"), "module": ("module", "package", "namespace")}
# Allowed moves of a task's status.
TRANSITIONS = (("claimed", "in_progress"), ("claimed", "abandoned"), ("in_progress", "review"), ("in_progress", "abandoned"), ("review", "done"), ("review", "in_progress"), ("review", "abandoned"))
# What a message may be and say.
MESSAGE_KINDS = ("status", "handoff", "contract", "publish", "review")
VERDICTS = ("APPROVED", "CHANGES")
SEVERITIES = ("P0", "P1", "P2", "P3")
# Content types whose bodies are not shown.
BINARY_TYPES = ("image/", "audio/", "video/", "application/octet-stream", "application/pdf", "application/zip", "application/gzip")
# Folders without project code.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "out", "vendor", "target", ".next", ".turbo", "coverage", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox")


def name_is(column: Column | str, name: str) -> Column:
    """equal but for case."""
    return F.lower(col(column)) == name.lower()


def between_optional(column: Column | str, low: int = 0, high: int = 0) -> Column:
    """an inclusive range; 0 leaves an end open."""
    c = col(column)
    return reduce(lambda a, b: a & b, [*([c >= low] if low > 0 else []), *([c <= high] if high > 0 else [])], F.lit(True))


def contains_text(column: Column | str, q: str) -> Column:
    """a substring but for case."""
    return F.lower(col(column)).contains(q.lower())


def request_matches(method: str = "", path: str = "", status_min: int = 0, status_max: int = 0) -> Column:
    """all of the given conditions on a captured request."""
    parts = [between_optional("status_code", status_min, status_max)]
    if method:
        parts.append(F.lower("method") == method.lower())
    if path:
        parts.append(F.col("path").contains(path))
    return reduce(lambda a, b: a & b, parts)


def match_tier(q: Column | str, slug: Column | str = "slug", name: Column | str = "name", aliases: Column | str = "aliases") -> Column:
    """0 if the query is the name or an alias, 1 if it or one of its tokens is part of slug, name or alias, else null."""
    nq, nn = normalize(q), normalize(name)
    na = F.transform(col(aliases), normalize)
    exact = (nq != "") & ((nq == nn) | F.array_contains(na, nq))
    words = F.filter(F.concat(tokenize(q), F.array(nq)), lambda c: c != "")
    part = F.exists(words, lambda c: col(slug).contains(c) | nn.contains(c) | F.exists(na, lambda a: a.contains(c)))
    return F.when(exact, 0).when(part, 1)


def valid_at(at: Column | None = None, valid_from: str = "valid_from", invalid_at: str = "invalid_at") -> Column:
    """valid at a time (start included, end not), or current."""
    if at is None:
        return F.col(invalid_at).isNull()
    return (F.col(valid_from) <= at) & (F.col(invalid_at).isNull() | (F.col(invalid_at) > at))


def is_ephemeral(name: Column | str, worktree_prefixes: tuple[str, ...] = ()) -> Column:
    """an artifact of one run: temporary paths, work trees, bare hex ids, UUIDs, nothing."""
    n = trimmed(name)
    temp = reduce(lambda a, b: a | b, [n.startswith(d) for d in TEMP_DIRS])
    tree = n.rlike("|".join([r"(?i)-wt-[a-z0-9]{6,}$", *(f"^{p}-wt-" for p in worktree_prefixes)]))
    return (n == "") | temp | tree | F.lower(n).rlike("^[0-9a-f]{8,}$") | n.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_generic_alias(name: Column | str, source_dirs: tuple[str, ...] = SOURCE_DIRS, more: tuple[str, ...] = ()) -> Column:
    """a role or a location rather than an identity; ``more``: what a user's own vocabulary adds."""
    n = F.lower(trimmed(name))
    parts = F.split(n, "/")
    place = (F.size(parts) == 2) & ~n.contains(".") & ~n.startswith("/") & F.get(parts, F.lit(0)).isin(*source_dirs)
    return (n == "") | n.isin(*GENERIC_ALIASES, *more) | place


def is_generic_name(name: Column | str) -> Column:
    """process vocabulary: a noun of work, a bare number, a numbered step, a qualified noun of work, or a generic alias."""
    n = F.regexp_replace(F.lower(trimmed(name)), "^the ", "")
    words = F.split(F.trim(n), "\\s+")
    qualified = (F.size(words) == 2) & F.get(words, F.lit(1)).isin(*PROCESS_NOUNS)
    return (n == "") | n.isin(*PROCESS_NOUNS) | n.rlike(r"^\d{1,6}$") | n.rlike(r"^(task|phase|step|iteration|wave|round|part)\s+\d+") | qualified | is_generic_alias(n)


def durable(names: Column | str) -> Column:
    """the names that are neither ephemeral nor generic."""
    return F.filter(col(names), lambda x: ~(is_ephemeral(x) | is_generic_alias(x)))


def is_workspace(cwd: Column | str, has_git: Column | str, home: str = "/Users/") -> Column:
    """F16: a path below the home folder that holds a repository."""
    return col(cwd).startswith(home) & col(has_git)


def split_compound(symbol: Column | str) -> Column:
    """container and tail at the rightmost ``::``, ``->`` or ``.``; both empty if one side is missing."""
    # the last operator: what follows it holds none
    p = r"^(.*?)(?:::|->|\.)((?:(?!::|->|\.).)*)$"
    container, tail = F.regexp_extract(col(symbol), p, 1), F.regexp_extract(F.regexp_extract(col(symbol), p, 2), r"^[^(]*", 0)
    ok = (container != "") & (tail != "")
    return F.struct(F.when(ok, container).otherwise("").alias("container"), F.when(ok, tail).otherwise("").alias("tail"))


def in_container(symbol: Column | str, container: str) -> Column:
    """the container is a whole segment of the symbol id."""
    return reduce(lambda a, b: a | b, [col(symbol).contains(f"{a}{container}{b}") for a in "/ " for b in "#/"])


def node_type(kind: Column | str) -> Column:
    """function, class, interface or module; null for others."""
    k = F.lower(col(kind))
    return F.coalesce(*[F.when(k.isin(*v), t) for t, v in KINDS.items()])


def is_local(symbol: Column | str) -> Column:
    """F19."""
    return col(symbol).startswith("local ")


def shown_body(body: Column | str, content_type: Column | str) -> Column:
    """a text body as it is, a binary one by its size."""
    binary = F.coalesce(reduce(lambda a, b: a | b, [F.lower(col(content_type)).contains(t) for t in BINARY_TYPES]), F.lit(False))
    return F.when(binary, F.concat(F.lit("[binary: "), F.octet_length(col(body)).cast("string"), F.lit(" bytes]"))).otherwise(col(body).cast("string"))


def message_is_valid() -> Column:
    """F21."""
    return F.col("kind").isin(*MESSAGE_KINDS) & F.coalesce("verdict", F.lit("")).isin("", *VERDICTS) & F.coalesce("severity", F.lit("")).isin("", *SEVERITIES)


def transition_allowed(old: Column | str, new: Column | str) -> Column:
    """F22."""
    return F.concat_ws(">", col(old), col(new)).isin(*[f"{a}>{b}" for a, b in TRANSITIONS])


def relevant_change(path: Column | str, extensions: tuple[str, ...] = ("go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "php", "py")) -> Column:
    """a source file outside hidden and dependency folders, no editor's swap file."""
    p = F.lower(col(path))
    base = F.substring_index(col(path), "/", -1)
    editor = base.startswith(".") | base.rlike(r"(~|\.swp|\.swx)$")
    ignored = F.exists(F.split(col(path), "/"), lambda x: x.isin(*SKIP_DIRS))
    return p.rlike(r"\.(" + "|".join(extensions) + ")$") & ~editor & ~ignored


def is_stale(head: Column | str, indexed_head: Column | str, newest: Column | str, indexed_at: Column | str) -> Column:
    """HEAD has moved; where either is unknown, a source file is newer than the index."""
    a, b = F.coalesce(col(head), F.lit("")), F.coalesce(col(indexed_head), F.lit(""))
    return F.when((a != "") & (b != ""), a != b).otherwise(F.coalesce(col(newest) > col(indexed_at), F.lit(False)))


def effective_status(status: Column | str, empty: Column | str, stale: Column | str) -> Column:
    """partial, then empty, then stale, then ready."""
    s = F.coalesce(col(status), F.lit(""))
    return F.when(~s.isin("", "ready"), s).when(col(empty), "empty").when(col(stale), "stale").otherwise("ready")


# Words of search patterns that name no symbol.
NOISE_WORDS = (
    "use", "class", "function", "extends", "implements", "interface", "return", "import", "from", "require", "const", "var", "let", "new", "this", "self",
    "static", "public", "private", "protected", "async", "await", "func", "type", "struct", "package", "def", "todo", "fixme", "hack", "note", "xxx", "app",
    "src", "lib", "test", "tests", "spec", "vendor", "node_modules", "internal",
)


def pattern_symbols(pattern: Column | str, noise: tuple[str, ...] = NOISE_WORDS) -> Column:
    """the identifiers in a search pattern that look like symbols: three characters or more, with a capital or an underscore."""
    looks = lambda x: (F.length(x) >= 3) & x.rlike("^[A-Za-z_]") & x.rlike("[A-Z_]") & (~F.lower(x).isin(*noise) if noise else F.lit(True))
    return F.array_distinct(F.filter(F.regexp_extract_all(col(pattern), F.lit("[A-Za-z0-9_]+"), F.lit(0)), looks))


def git_command(command: Column | str) -> Column:
    """the query that answers a git command line, or null."""
    c = F.trim(col(command))
    counted = c.rlike(r"^git\s+diff\b") & c.rlike(r"\s--(stat|numstat)(\s|$)")
    return F.when(c.rlike(r"^git\s+blame(\s|$)"), "git.blame").when(c.rlike(r"^git\s+log(\s|$)"), "git.history").when(c.rlike(r"^git\s+shortlog(\s|$)"), "git.contributors").when(counted, "git.hotspots")
