"""Scalar functions over columns; all stay inside the JVM."""

from __future__ import annotations

import os
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret shapes, applied in this order.
SECRETS = (
    r"-----BEGIN [A-Z ]+PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+PRIVATE KEY-----",
    r"Bearer\s+[A-Za-z0-9._~+/=-]{10,}",
    r"ghp_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}",
)
# What an edge between two node types is called.
EDGE_LABELS = {("function", "function"): "calls", ("class", "interface"): "implements", ("table", "table"): "fk", ("file", "file"): "changed_with", ("function", "table"): "queries"}
# Catalog codes of foreign key actions.
FK_ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: White space of Unicode.
SPACE = r"[\s\x0B\x85\p{Z}]"


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def normalize(name: Column | str) -> Column:
    """Lower case, trimmed, runs of blanks and underscores as one hyphen."""
    return F.regexp_replace(F.lower(trimmed(name)), "[ _]+", "-")


def slugify(name: Column | str) -> Column:
    """Normalize, then only a-z, 0-9 and hyphens."""
    return F.regexp_replace(normalize(name), "[^a-z0-9-]", "")


def normalize_relation(rel: Column | str) -> Column:
    """Lower case; runs of anything but a-z, 0-9, _ become one underscore; none at the ends."""
    low = F.regexp_replace(F.lower(trimmed(rel)), "[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(low, "_+", "_"), "^_|_$", "")


def parse_valid_from(text: Column | str, fallback: Column | str) -> Column:
    """An RFC 3339 timestamp, else a bare date, else fallback; nothing else that a cast would take."""
    t = col(text)
    rfc = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    day = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.coalesce(F.when(rfc | day, F.try_to_timestamp(t)), col(fallback))


def clamp_invalid_at(at: Column | str, valid_from: Column | str) -> Column:
    """Never before valid_from."""
    return F.greatest(col(at), col(valid_from))


def normalize_path(path: Column | str) -> Column:
    """Numeric and UUID-shaped segments become :id (a UUID is told by length and hyphens alone)."""
    uuid = lambda s: (F.length(s) == 36) & reduce(lambda a, b: a & b, [F.substring(s, i, 1) == "-" for i in (9, 14, 19, 24)])
    return F.array_join(F.transform(F.split(col(path), "/"), lambda s: F.when(s.rlike("^[0-9]+$") | uuid(s), ":id").otherwise(s)), "/")


def tokenize(q: Column | str) -> Column:
    """Lower-cased runs of letters and digits of three bytes or more."""
    return F.filter(F.split(F.lower(col(q)), "[^a-zA-Z0-9]+"), lambda x: F.octet_length(x) >= 3)


def redact(text: Column | str) -> Column:
    """Every secret shape becomes [REDACTED]."""
    return reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), SECRETS, col(text))


def stable_id(ref: Column | str, length: int | None = None) -> Column:
    """Sha-256 in hex, or its first characters."""
    full = F.sha2(col(ref), 256)
    return F.substring(full, 1, length) if length else full


def content_text(content: Column | str) -> Column:
    """A JSON message content to text: a string trimmed, or an array's text blocks and a breadcrumb for each tool call."""
    c = col(content)
    blocks = F.from_json(c, "array<struct<type:string,text:string,name:string>>")
    name = lambda b: F.when(F.coalesce(b["name"], F.lit("")) == "", "unknown").otherwise(b["name"])
    said = F.transform(blocks, lambda b: F.when(b["type"] == "text", F.trim(F.coalesce(b["text"], F.lit("")))).when(b["type"] == "tool_use", F.concat(F.lit("[tool: "), name(b), F.lit("]"))))
    text = F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"]
    return F.coalesce(F.when(F.ltrim(c).startswith("["), F.array_join(F.filter(said, lambda s: s.isNotNull() & (s != "")), "\n")).when(F.ltrim(c).startswith('"'), F.trim(text)), F.lit(""))


def desc_timestamp(ts: Column | str) -> Column:
    """C11: a key that sorts newest first."""
    return F.lpad((F.lit(9223372036854775807) - col(ts)).cast("string"), 20, "0")


def split_from_end(key: Column | str, n: int) -> Column:
    """An array of what stands before, and the last n - 1 parts between colons."""
    p = F.split(col(key), ":")
    head = F.array_join(F.slice(p, F.lit(1), F.size(p) - (n - 1)), ":")
    return F.when(F.size(p) >= n, F.concat(F.array(head), F.slice(p, -(n - 1), n - 1)))


def collapse_rename(path: Column | str) -> Column:
    """The new path of ``a/{old => new}/b`` or ``old => new``."""
    braced = F.regexp_replace(col(path), r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braced, "^.* => ", ""), "//", "/")


def change_status(added: Column | str, removed: Column | str) -> Column:
    """C14: A if lines were only added, else M."""
    return F.when((col(added) > 0) & (col(removed) == 0), "A").otherwise("M")


def is_hex(text: Column | str) -> Column:
    """Hexadecimal digits alone; so is an empty text."""
    return col(text).rlike("^[0-9a-fA-F]*\\z")


def decode_range(r: Column | str) -> Column:
    """A packed range of three or four zero-based numbers as line, column, end_line, end_column, the lines and columns from one."""
    a = col(r)
    at = lambda i: F.get(a, F.lit(i)) + 1
    four = F.struct(at(0).alias("line"), at(1).alias("column"), at(2).alias("end_line"), at(3).alias("end_column"))
    three = F.struct(at(0).alias("line"), at(1).alias("column"), at(0).alias("end_line"), at(2).alias("end_column"))
    return F.when(F.size(a) == 4, four).when(F.size(a) == 3, three)


def display_name(given: Column | str, symbol: Column | str) -> Column:
    """C17: the given name, else the last identifier of the symbol's descriptor."""
    return F.coalesce(F.nullif(col(given), F.lit("")), F.regexp_extract(col(symbol), r"([A-Za-z0-9_$+-]+)[^A-Za-z0-9_$+-]*$", 1))


def descriptor(symbol: Column | str) -> Column:
    """What stands after the last blank."""
    return F.substring_index(col(symbol), " ", -1)


def method_parts(desc: Column | str) -> Column:
    """Class and method of ``Foo/Bar#method().``; both empty if it is none."""
    p = r"^([^#]*)#([^(]+)\("
    return F.struct(F.regexp_extract(col(desc), p, 1).alias("class"), F.regexp_extract(col(desc), p, 2).alias("method"))


def string_ref(kind: Column | str, key: Column | str) -> Column:
    """The descriptor of a view or config key."""
    k, at = col(key), F.instr(col(key), ".")
    head = F.when(at > 0, F.substring_index(k, ".", 1)).otherwise(k)
    tail = F.when(at > 0, k.substr(at + 1, F.length(k))).otherwise("")
    return F.when(col(kind) == "view", F.concat(F.lit("resources/views/"), F.replace(k, F.lit("."), F.lit("/")), F.lit(".blade.php#"))).when(col(kind) == "config", F.concat(F.lit("config/"), head, F.lit(".php#"), tail))


def enum_values(column_type: Column | str) -> Column:
    """C20: the members of an enum or set literal; a doubled quote is one."""
    t = col(column_type)
    found = F.regexp_extract_all(t, F.lit("'((?:[^']|'')*)'"), 1)
    return F.when(t.rlike(r"(?i)^(enum|set)\("), F.transform(found, lambda v: F.replace(v, F.lit("''"), F.lit("'"))))


def fk_action(code: Column | str) -> Column:
    """C21."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FK_ACTIONS.items() for x in kv]), col(code)), col(code))


def relative_path(path: Column | str, root: str) -> Column:
    """C22."""
    return F.when(col(path).startswith(root.rstrip("/") + "/"), col(path).substr(F.lit(len(root.rstrip("/")) + 2), F.length(col(path)))).otherwise(col(path))


def table_column(name: Column | str) -> Column:
    """Split at the last dot."""
    n = col(name)
    return F.when(n.contains("."), F.struct(F.regexp_extract(n, r"^(.*)\.([^.]*)$", 1).alias("table"), F.regexp_extract(n, r"^(.*)\.([^.]*)$", 2).alias("column"))).otherwise(F.struct(n.alias("table"), F.lit("").alias("column")))


def edge_label(src_type: Column | str, dst_type: Column | str) -> Column:
    """What an edge between two node types is shown as."""
    s, d = col(src_type), col(dst_type)
    return F.coalesce(*[F.when((s == a) & (d == b), label) for (a, b), label in EDGE_LABELS.items()], F.lit("connected"))


def fenced_json(raw: Column | str) -> Column:
    """The outermost braces of an answer, without code fences."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(raw)), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def clean_path(path: Column | str) -> Column:
    """A path without empty and ``.`` parts, and with ``..`` taken back; what is left of nothing is ``/`` or ``.``."""
    p = col(path)
    root = p.startswith("/")
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    back = lambda done: F.when(up(done), F.slice(done, F.lit(1), F.size(done) - 1)).when(root, done).otherwise(F.concat(done, F.array(F.lit(".."))))
    start = F.array().cast("array<string>")
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", back(done)).otherwise(F.concat(done, F.array(x)))
    joined = F.array_join(F.aggregate(F.split(p, "/"), start, step), "/")
    return F.when(root, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def ancestors(path: Column | str, least: int = 2) -> Column:
    """The cleaned path, and its ancestors of at least ``least`` components, deepest first."""
    clean = clean_path(path)
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    n = F.size(parts)
    head = F.when(clean.startswith("/"), F.lit("/")).otherwise("")
    up = F.when(n > least, F.sequence(n - 1, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(clean), F.transform(up, lambda i: F.concat(head, F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def coverage_context(hits: Column | str) -> Column:
    """C29."""
    return F.when(col(hits) > 0, F.concat(F.lit("covered (hit count: "), col(hits).cast("string"), F.lit(")"))).otherwise("not covered")


def context_line(text: Column | str, line: Column | str) -> Column:
    """A file's line, trimmed; empty if there is none."""
    return F.coalesce(F.trim(F.get(F.split(col(text), "\n"), col(line) - 1)), F.lit(""))


def composer_identity(composer: Column | str, lock: Column | str) -> Column:
    """Package name, and the lock's content hash as its version."""
    return F.struct(F.coalesce(F.get_json_object(col(composer), "$.name"), F.lit("local/app")).alias("name"), F.coalesce(F.get_json_object(col(lock), "$.content-hash"), F.get_json_object(col(composer), "$.version"), F.lit("0")).alias("version"))


def extraction_prompt(text: Column | str, glossary: Column | str) -> Column:
    """Known entities, then the episode."""
    return F.concat_ws("\n\n", F.concat(F.lit("Known entities:\n"), F.array_join(col(glossary), "\n")), F.concat(F.lit("Episode:\n"), col(text)))


def array_union_keep(existing: Column | str, incoming: Column | str) -> Column:
    """incoming's new elements behind existing, whose own repeats stay."""
    e, i = col(existing), col(incoming)
    return F.concat(e, F.array_distinct(F.filter(i, lambda x: ~F.array_contains(e, x))))


def name_set(name: Column | str, aliases: Column | str) -> Column:
    """The distinct normalized names of an entity."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(col(name)), col(aliases)), normalize), lambda x: x != ""))


#: Crockford's base 32.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ms: int, random: bytes) -> str:
    """26 characters for 48 bits of time and 80 of chance."""
    if len(random) != 10:
        raise ValueError("80 random bits are needed")
    n = (ms & (1 << 48) - 1) << 80 | int.from_bytes(random, "big")
    return "".join(BASE32[n >> 5 * k & 31] for k in range(25, -1, -1))


def new_ulids(at: Column | str) -> Column:
    """An id for each row from its time; as random as the system is."""
    @F.pandas_udf("string")
    def make(micros: pd.Series) -> pd.Series:
        return pd.Series([ulid(int(m) // 1000, os.urandom(10)) for m in micros])

    return make(F.unix_micros(col(at)))
