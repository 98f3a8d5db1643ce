"""PHP sources: class references, string references, facades."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import descriptor, method_parts, string_ref

# Helpers whose literal argument names a view or a config key.
STRING_HELPERS = {"view": "view", "config": "config"}
# The framework's facades and the classes that may stand behind each.
FACADES = {
    "Auth": "Auth/AuthManager Contracts/Auth/Factory Contracts/Auth/Guard Contracts/Auth/StatefulGuard",
    "Cache": "Cache/CacheManager Cache/Repository Contracts/Cache/Factory Contracts/Cache/Repository",
    "Config": "Config/Repository Contracts/Config/Repository",
    "Cookie": "Cookie/CookieJar Contracts/Cookie/Factory Contracts/Cookie/QueueingFactory",
    "Crypt": "Encryption/Encrypter Contracts/Encryption/Encrypter",
    "DB": "Database/DatabaseManager Database/Connection",
    "Date": "Support/DateFactory",
    "Event": "Events/Dispatcher Contracts/Events/Dispatcher",
    "File": "Filesystem/Filesystem",
    "Gate": "Auth/Access/Gate Contracts/Auth/Access/Gate",
    "Hash": "Hashing/HashManager Contracts/Hashing/Hasher",
    "Http": "Http/Client/Factory",
    "Lang": "Translation/Translator Contracts/Translation/Translator",
    "Log": "Log/LogManager Log/Logger /Psr/Log/LoggerInterface",
    "Mail": "Mail/MailManager Mail/Mailer Contracts/Mail/Factory Contracts/Mail/Mailer",
    "Notification": "Notifications/ChannelManager Contracts/Notifications/Factory Contracts/Notifications/Dispatcher",
    "Password": "Auth/Passwords/PasswordBrokerManager Contracts/Auth/PasswordBrokerFactory Contracts/Auth/PasswordBroker",
    "Queue": "Queue/QueueManager Contracts/Queue/Factory Contracts/Queue/Queue",
    "Redirect": "Routing/Redirector",
    "Redis": "Redis/RedisManager Contracts/Redis/Factory",
    "Request": "Http/Request",
    "Response": "Routing/ResponseFactory Contracts/Routing/ResponseFactory",
    "Route": "Routing/Router",
    "Schema": "Database/Schema/Builder",
    "Session": "Session/SessionManager Session/Store Contracts/Session/Session",
    "Storage": "Filesystem/FilesystemManager Filesystem/FilesystemAdapter Contracts/Filesystem/Factory Contracts/Filesystem/Filesystem",
    "URL": "Routing/UrlGenerator Contracts/Routing/UrlGenerator",
    "Validator": "Validation/Factory Contracts/Validation/Factory",
    "View": "View/Factory Contracts/View/Factory",
    "Bus": "Bus/Dispatcher Contracts/Bus/Dispatcher Contracts/Bus/QueueingDispatcher",
    "Broadcast": "Broadcasting/BroadcastManager Contracts/Broadcasting/Factory Contracts/Broadcasting/Broadcaster",
    "Artisan": "Contracts/Console/Kernel",
}

LEX = re.compile(
    r"""(?P<skip>//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|<<<[ \t]*(?P<q>['"]?)(?P<tag>\w+)(?P=q)\n.*?\n[ \t]*(?P=tag)\b)"""
    r"""|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>\\?[A-Za-z_\x80-￿][\w\\\x80-￿]*)|(?P<op>::|->|[^\s\w])""",
    re.S,
)
REFS = "file string, kind string, name string, line int"


def scan(text: str) -> tuple[dict[str, str], list[tuple[str, str, int]]]:
    """Use aliases, and (kind, name, line) of ``X::class`` and of helper calls with a literal; strings, comments and heredocs hold none."""
    start = text.find("<?")
    tokens, line, at = [], 1, 0
    for m in LEX.finditer(text, max(start, 0)):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m["skip"] is None:
            tokens.append((m.lastgroup if m.lastgroup in ("str", "name", "op") else "op", m.group(), line))
    uses: dict[str, str] = {}
    found: list[tuple[str, str, int]] = []
    depth = k = 0
    while k < len(tokens):
        kind, word, n = tokens[k]
        if word in "{}" and kind == "op":
            depth += 1 if word == "{" else -1
        if kind == "name" and word == "use" and depth == 0:
            k = _use(tokens, k + 1, uses)
            continue
        after = [t[1] for t in tokens[k + 1 : k + 3]]
        if kind == "name" and after == ["::", "class"]:
            found.append(("class", word, n))
        elif kind == "name" and word in STRING_HELPERS and after[:1] == ["("] and k + 2 < len(tokens) and tokens[k + 2][0] == "str" and (k == 0 or tokens[k - 1][1] not in ("->", "::", "function")):
            literal = tokens[k + 2][1][1:-1]
            if literal and "$" not in literal:
                found.append((STRING_HELPERS[word], literal, n))
        k += 1
    return uses, found


def _use(tokens: list[tuple[str, str, int]], k: int, uses: dict[str, str]) -> int:
    """Aliases of one use statement, grouped ones too; the place behind it."""
    prefix, name, alias = "", "", ""

    def keep() -> None:
        if name:
            full = (prefix + name).lstrip("\\")
            uses[alias or full.rsplit("\\", 1)[-1]] = full

    while k < len(tokens):
        kind, word, _ = tokens[k]
        if word in ("function", "const"):
            pass
        elif word == "{":
            prefix, name = name.rstrip("\\") + "\\", ""
        elif word in (",", ";", "}"):
            keep()
            name = alias = ""
            if word == ";":
                return k + 1
        elif word == "as" and kind == "name":
            k += 1
            alias = tokens[k][1] if k < len(tokens) else ""
        elif kind == "name":
            name += word
        elif word == "(":
            return k
        k += 1
    return k


def resolve(name: str, uses: dict[str, str]) -> str:
    """The full class name; empty if nothing tells it."""
    if name.startswith("\\"):
        return name[1:]
    head, _, rest = name.partition("\\")
    if head in uses:
        return uses[head] + ("\\" + rest if rest else "")
    return name if rest else ""


def references(files: DataFrame) -> DataFrame:
    """References in PHP files (file, text); classes with their full name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, t in zip(pdf["file"], pdf["text"]):
                uses, found = scan(t or "")
                rows += [(f, k, full, n) for k, x, n in found if (full := resolve(x, uses) if k == "class" else x)]
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "line"])

    return files.select("file", "text").mapInPandas(run, REFS)


# Folders of the framework whose code no class loader knows.
FRAMEWORK_DIRS = ("routes", "database/migrations", "config", "bootstrap")


def framework_references(files: DataFrame) -> DataFrame:
    """References in the PHP files of the framework's own folders (file: path from the repository's root, text)."""
    inside = F.col("file").rlike("^(" + "|".join(FRAMEWORK_DIRS) + r")/(.*/)?[^/]*\.php$")
    return references(files.where(inside))


def bind(refs: DataFrame, symbols: DataFrame, package: str = "scip-php composer local/app 0") -> DataFrame:
    """References with the symbol whose descriptor they name, or a made-up one."""
    wanted = F.when(F.col("kind") == "class", F.concat(F.replace("name", F.lit("\\"), F.lit("/")), F.lit("#"))).otherwise(string_ref("kind", "name"))
    known = symbols.select(descriptor("symbol").alias("d"), "symbol").groupBy("d").agg(F.min("symbol").alias("known"))
    rows = refs.withColumn("d", wanted).join(known, "d", "left")
    return rows.select("file", "line", "kind", "name", F.coalesce("known", F.concat(F.lit(package + " "), "d")).alias("symbol"), F.col("known").isNull().alias("made_up"))


def facade_refs(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """References to a facade's method, once more for each class behind it: the classes that have the method, else all, made up."""
    rows = [(f"Illuminate/Support/Facades/{k}", c[1:] if c.startswith("/") else f"Illuminate/{c}") for k, v in FACADES.items() for c in v.split()]
    table = occurrences.sparkSession.createDataFrame(rows, "facade string, backing string")  # under a hundred rows
    used = occurrences.where("not is_definition").withColumn("m", method_parts(descriptor("symbol"))).where("m.method <> ''")
    met = used.join(F.broadcast(table), F.col("m.class") == F.col("facade"))
    own = symbols.select(F.col("symbol").alias("target"), method_parts(descriptor("symbol")).alias("t")).where("t.method <> ''").select("target", F.col("t.class").alias("own_class"), F.col("t.method").alias("own_method"))
    parts = F.split("symbol", " ")
    made = F.concat(F.array_join(F.slice(parts, F.lit(1), F.lit(4)), " "), F.lit(" "), "backing", F.lit("#"), "m.method", F.lit("()."))
    both = met.join(own, (F.col("backing") == F.col("own_class")) & (F.col("m.method") == F.col("own_method")), "left")
    return both.select("file", "line", F.col("symbol").alias("facade_symbol"), F.coalesce("target", made).alias("symbol"))
