"""Database catalogs: connection strings, introspection over JDBC, and the session's own catalog."""

from __future__ import annotations

import re
from typing import Protocol
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import fk_action

MYSQL = {
    "tables": "SELECT table_name AS name, table_type AS type, table_rows AS row_estimate FROM information_schema.tables WHERE table_schema = DATABASE()",
    "columns": "SELECT table_name AS `table`, column_name AS name, ordinal_position AS position, column_type AS data_type, is_nullable = 'YES' AS is_nullable, column_default AS default_value, column_comment AS comment FROM information_schema.columns WHERE table_schema = DATABASE()",
    "indexes": "SELECT table_name AS `table`, index_name AS name, seq_in_index AS seq, column_name AS `column`, non_unique = 0 AS is_unique, index_name = 'PRIMARY' AS is_primary FROM information_schema.statistics WHERE table_schema = DATABASE()",
    "foreign_keys": "SELECT k.table_name AS `table`, k.column_name AS `column`, k.referenced_table_name AS ref_table, k.referenced_column_name AS ref_column, k.constraint_name AS name, r.delete_rule AS on_delete FROM information_schema.key_column_usage k JOIN information_schema.referential_constraints r ON r.constraint_schema = k.constraint_schema AND r.constraint_name = k.constraint_name WHERE k.table_schema = DATABASE() AND k.referenced_table_name IS NOT NULL",
}
POSTGRES = {
    "tables": "SELECT c.relname AS name, CASE c.relkind WHEN 'v' THEN 'VIEW' ELSE 'BASE TABLE' END AS type, c.reltuples::bigint AS row_estimate FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = 'public' AND c.relkind IN ('r', 'v', 'm', 'p')",
    "columns": "SELECT c.relname AS \"table\", a.attname AS name, a.attnum AS position, format_type(a.atttypid, a.atttypmod) AS data_type, NOT a.attnotnull AS is_nullable, pg_get_expr(d.adbin, d.adrelid) AS default_value, col_description(c.oid, a.attnum) AS comment FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_attrdef d ON d.adrelid = c.oid AND d.adnum = a.attnum WHERE n.nspname = 'public' AND a.attnum > 0 AND NOT a.attisdropped",
    "indexes": "SELECT t.relname AS \"table\", i.relname AS name, k.ord AS seq, a.attname AS \"column\", x.indisunique AS is_unique, x.indisprimary AS is_primary FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_namespace n ON n.oid = t.relnamespace JOIN LATERAL unnest(x.indkey) WITH ORDINALITY k(num, ord) ON true JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.num WHERE n.nspname = 'public'",
    "foreign_keys": "SELECT t.relname AS \"table\", a.attname AS \"column\", r.relname AS ref_table, b.attname AS ref_column, c.conname AS name, c.confdeltype::text AS on_delete FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_class r ON r.oid = c.confrelid JOIN pg_namespace n ON n.oid = t.relnamespace JOIN LATERAL unnest(c.conkey, c.confkey) AS k(own, other) ON true JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.own JOIN pg_attribute b ON b.attrelid = r.oid AND b.attnum = k.other WHERE n.nspname = 'public' AND c.contype = 'f'",
    "enums": "SELECT t.typname AS name, e.enumlabel AS label, e.enumsortorder AS pos FROM pg_type t JOIN pg_enum e ON e.enumtypid = t.oid JOIN pg_namespace n ON n.oid = t.typnamespace WHERE n.nspname = 'public'",
}


def parse_dsn(dsn: str) -> dict[str, str]:
    """Kind, JDBC url, user and password of a connection string."""
    u = urlsplit(dsn)
    kind = {"mysql": "mysql", "mariadb": "mysql", "postgres": "postgresql", "postgresql": "postgresql"}.get(u.scheme)
    if not kind or not u.hostname or not u.path.strip("/"):
        raise ValueError(f"not a connection string: {u.scheme or '?'}")
    port = u.port or (3306 if kind == "mysql" else 5432)
    return {"kind": kind, "url": f"jdbc:{kind}://{u.hostname}:{port}/{u.path.strip('/')}" + (f"?{u.query}" if u.query else ""), "user": unquote(u.username or ""), "password": unquote(u.password or "")}


def dsn_from_env(text: str) -> str | None:
    """The connection string that an environment file tells, whole or in parts."""
    env = {}
    for line in text.splitlines():
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line):
            v = m[2]
            env[m[1]] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else re.sub(r"\s+#.*$", "", v)
    if env.get("DATABASE_URL"):
        return env["DATABASE_URL"]
    kind = {"mysql": "mysql", "mariadb": "mysql", "pgsql": "postgres", "postgres": "postgres"}.get(env.get("DB_CONNECTION", ""))
    if not kind or not env.get("DB_DATABASE"):
        return None
    port = env.get("DB_PORT") or ("3306" if kind == "mysql" else "5432")
    return f"{kind}://{env.get('DB_USERNAME', '')}:{env.get('DB_PASSWORD', '')}@{env.get('DB_HOST') or '127.0.0.1'}:{port}/{env['DB_DATABASE']}"


class Introspector(Protocol):
    """What a catalog has to tell: frames tables, columns, indexes, foreign_keys and perhaps enums."""

    def read(self, spark: SparkSession) -> dict[str, DataFrame]: ...


class Jdbc:
    """A MySQL or PostgreSQL server; its driver jar must be on the class path."""

    def __init__(self, dsn: str):
        self.at = parse_dsn(dsn)

    def read(self, spark: SparkSession) -> dict[str, DataFrame]:
        mysql = self.at["kind"] == "mysql"
        got = {k: spark.read.format("jdbc").options(url=self.at["url"], user=self.at["user"], password=self.at["password"], query=q).load() for k, q in (MYSQL if mysql else POSTGRES).items()}
        return shaped(got, codes=not mysql)


def shaped(raw: dict[str, DataFrame], codes: bool = False) -> dict[str, DataFrame]:
    """Catalog rows as the frames that the schema queries take: index columns in order, actions by name, enum labels in order."""
    out = dict(raw)
    out["indexes"] = raw["indexes"].groupBy("table", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "column"))), lambda x: x["column"]).alias("columns"), F.bool_or(F.col("is_unique").cast("boolean")).alias("is_unique"), F.bool_or(F.col("is_primary").cast("boolean")).alias("is_primary"))
    if codes:
        out["foreign_keys"] = raw["foreign_keys"].withColumn("on_delete", fk_action("on_delete"))
    if "enums" in raw:
        out["enums"] = raw["enums"].groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("values"))
    return out


class SessionCatalog:
    """The tables of the session's own catalog; it knows neither keys nor indexes."""

    def __init__(self, database: str):
        self.database = database

    def read(self, spark: SparkSession) -> dict[str, DataFrame]:
        tables = [(t.name, t.tableType) for t in spark.catalog.listTables(self.database)]
        columns = [(t, c.name, i + 1, c.dataType, c.nullable) for t, _ in tables for i, c in enumerate(spark.catalog.listColumns(f"{self.database}.{t}" if not spark.catalog.tableExists(t) else t))]
        return {"tables": spark.createDataFrame(tables, "name string, type string"), "columns": spark.createDataFrame(columns, "table string, name string, position int, data_type string, is_nullable boolean")}
