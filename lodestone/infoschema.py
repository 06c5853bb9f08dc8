"""information_schema and pg_catalog relations as DataFrames made from catalog state."""

from __future__ import annotations

import re

from .dialect import outside_literals, tokens
from .types import OIDS

SCHEMAS = {
    "tables": "table_catalog string, table_schema string, table_name string, table_type string",
    "columns": "table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string, numeric_precision int, numeric_scale int",
    "schemata": "catalog_name string, schema_name string",
    "views": "table_schema string, table_name string, view_definition string",
    "table_constraints": "constraint_name string, table_name string, constraint_type string",
    "key_column_usage": "constraint_name string, table_name string, column_name string, ordinal_position int",
    "pg_namespace": "oid long, nspname string",
    "pg_class": "oid long, relname string, relkind string, relnamespace long",
    "pg_attribute": "attrelid long, attname string, atttypid int, attnum int",
    "pg_type": "oid int, typname string",
    "pg_tables": "schemaname string, tablename string",
    "pg_views": "schemaname string, viewname string, definition string",
    "pg_indexes": "schemaname string, tablename string, indexname string, indexdef string",
    "pg_constraint": "conname string, contype string, conrelid long",
    "pg_roles": "rolname string, rolcanlogin boolean",
    "pg_proc": "proname string",
    "pg_description": "objkind string, objname string, description string",
    "pg_extension": "extname string",
    "pg_publication": "pubname string",
    "pg_subscription": "subname string",
    "pg_tablespace": "spcname string",
    "pg_language": "lanname string",
    "pg_am": "amname string",
    "pg_policy": "polname string",
    "pg_publication_tables": "pubname string, tablename string",
}
# Spellings of types, letters of constraint kinds.
DATA_TYPES = {"int2": "smallint", "int4": "integer", "int8": "bigint", "bool": "boolean", "timestamp": "timestamp without time zone"}
KINDS = {"primary": ("PRIMARY KEY", "p"), "unique": ("UNIQUE", "u"), "foreign": ("FOREIGN KEY", "f"), "check": ("CHECK", "c")}


# Cast targets of catalog queries, and the oids of schemas.
CASTS = {"int4": "INT", "int8": "BIGINT", "int2": "SMALLINT", "text": "STRING", "name": "STRING", "oid": "BIGINT", "bool": "BOOLEAN"}
NAMESPACES = {"pg_catalog": 11, "public": 2200, "information_schema": 13000}
# What psql's list commands show: relation kinds by letter.
LISTED = {"t": "table", "v": "view", "m": "materialized view", "s": "sequence", "i": "index"}


def oids(session) -> dict[str, int]:
    c = session.catalog
    return {n: 16384 + i for i, n in enumerate(sorted([*c.tables, *c.views, *c.matviews]))}


def rows(session, name: str) -> list[tuple]:
    """Rows of one relation; their number is that of catalog objects."""
    c = session.catalog
    relations = [(n, "r", "BASE TABLE") for n in c.tables] + [(n, "v", "VIEW") for n in c.views] + [(n, "m", "MATERIALIZED VIEW") for n in c.matviews]
    oid = oids(session)
    names = lambda kind: [(n,) for n in c.objects.get(kind, {})]
    if name == "tables":
        return [("main", "public", n, kind) for n, k, kind in relations if k != "m"]
    if name == "columns":
        return [("public", t, col, i + 1, x.defaults.get(col), "NO" if any(k.kind == "primary" and col in k.columns or k.expr == f"{col} IS NOT NULL" for k in x.constraints) else "YES", DATA_TYPES.get(kind.name, kind.name), kind.precision or None, kind.scale if kind.precision else None) for t, x in c.tables.items() for i, (col, kind) in enumerate(x.columns)]
    if name == "schemata":
        return [("main", s) for s in ("public", "information_schema", "pg_catalog", *c.objects.get("schema", {}))]
    if name in ("views", "pg_views"):
        return [("public", n, text) for n, text in c.views.items()]
    if name == "table_constraints":
        return [(k.name, t, KINDS[k.kind][0]) for t, x in c.tables.items() for k in x.constraints]
    if name == "key_column_usage":
        return [(k.name, t, col, i + 1) for t, x in c.tables.items() for k in x.constraints for i, col in enumerate(k.columns)]
    if name == "pg_namespace":
        return [(n, s) for s, n in NAMESPACES.items()]
    if name == "pg_class":
        return [(oid[n], n, k, 2200) for n, k, _ in relations]
    if name == "pg_attribute":
        return [(oid[t], col, kind.oid, i + 1) for t, x in c.tables.items() for i, (col, kind) in enumerate(x.columns)]
    if name == "pg_type":
        return [(n, t) for t, n in OIDS.items()]
    if name == "pg_tables":
        return [("public", n) for n in c.tables]
    if name == "pg_indexes":
        return [("public", x["table"], n, f"CREATE {'UNIQUE ' if x['unique'] else ''}INDEX {n} ON {x['table']} ({x['columns']})") for n, x in c.objects.get("index", {}).items()]
    if name == "pg_constraint":
        return [(k.name, KINDS[k.kind][1], oid[t]) for t, x in c.tables.items() for k in x.constraints]
    if name == "pg_roles":
        return [(session.user, True), *((n, bool(x.get("login"))) for n, x in c.objects.get("role", {}).items())]
    if name == "pg_description":
        return [(k, n, text) for (k, n), text in c.comments.items() if text]
    kind = {"pg_proc": "function", "pg_extension": "extension", "pg_publication": "publication", "pg_subscription": "subscription", "pg_tablespace": "tablespace"}.get(name)
    return names(kind) if kind else [("sql",)] if name == "pg_language" else [("columnar",)] if name == "pg_am" else []


def _function(session, name: str, args: list[str]) -> str:
    """A catalog function as Spark SQL."""
    plain = lambda x: x.strip().strip("'").rpartition(".")[2].strip('"').lower()
    if name in ("pg_table_is_visible", "pg_type_is_visible", "pg_function_is_visible", "has_table_privilege", "has_schema_privilege"):
        return "TRUE"
    if name == "pg_get_userbyid":
        return f"'{session.user}'"
    if name == "format_type":
        names = {n: DATA_TYPES.get(t, t) for t, n in OIDS.items()}
        return "CASE " + args[0] + "".join(f" WHEN {n} THEN '{t}'" for n, t in names.items()) + " END"
    if name in ("pg_relation_size", "pg_total_relation_size", "pg_table_size"):
        relation = plain(args[0].split("::")[0])
        return f"CAST({session.store.size(session.version(relation))} AS BIGINT)"
    return "CAST(NULL AS STRING)"  # obj_description, pg_get_expr, ...


FUNCTIONS = ("pg_table_is_visible", "pg_type_is_visible", "pg_function_is_visible", "has_table_privilege", "has_schema_privilege", "pg_get_userbyid", "format_type", "pg_relation_size", "pg_total_relation_size", "pg_table_size", "obj_description", "col_description", "pg_get_expr")
CATALOG = re.compile(r"(?i)\b(?:information_schema|pg_catalog)\s*\.|::\s*reg|\b(?:" + "|".join(FUNCTIONS) + r")\s*\(")


def expressions(session, text: str) -> str:
    """Casts, regular expressions and functions of catalog queries as Spark SQL."""
    from .errors import EngineError

    toks, out, i = tokens(text), [], 0
    while i < len(toks):
        t = toks[i]
        low = t.lower()
        if low == "pg_catalog" and toks[i + 1 : i + 2] == ["."] and i + 2 < len(toks) and (toks[i + 2].lower() in (*FUNCTIONS, *CASTS) or toks[i + 2] in "~!"):
            i += 2
            continue
        if low in FUNCTIONS and "".join(toks[i + 1 :]).lstrip().startswith("("):
            begin = toks.index("(", i)
            depth, end = 0, begin
            while end < len(toks):
                depth += (toks[end] == "(") - (toks[end] == ")")
                if not depth:
                    break
                end += 1
            out.append(_function(session, low, [a.strip() for a in "".join(toks[begin + 1 : end]).split(",")]))
            i = end + 1
            continue
        if t == "::" and i + 1 < len(toks):
            kind = toks[i + 1].lower()
            if kind in ("regclass", "regnamespace") and out and out[-1].startswith("'"):
                name = out.pop()[1:-1].rpartition(".")[2].strip('"')
                known = oids(session) if kind == "regclass" else NAMESPACES
                if name not in known:
                    raise EngineError(f"relation {name} does not exist", "42P01")
                out.append(f"CAST({known[name]} AS BIGINT)")
                i += 2
                continue
            out += ["::", CASTS.get(kind, toks[i + 1])]
            i += 2
            continue
        if t == "~" or (t == "!" and toks[i + 1 : i + 2] == ["~"]):
            out.append(" RLIKE " if t == "~" else " NOT RLIKE ")
            i += 1 if t == "~" else 2
            continue
        out.append(t)
        i += 1
    return re.sub(r"(?i)\boperator\s*\(\s*(not rlike|rlike)\s*\)", r"\1", "".join(out))


def psql(session, command: str):
    """The rows behind psql's list commands: \\d, \\dt, \\dv, \\dm, \\ds, \\di, \\df, \\du, \\dn, \\dd, \\dRp, and \\d NAME for a relation's columns."""
    from .errors import EngineError, UnsupportedError

    c, make = session.catalog, session.spark.createDataFrame
    verb, _, name = command.strip().removeprefix("\\").partition(" ")
    name = name.strip().removeprefix("public.")
    if verb == "d" and name:
        if name in c.tables:
            needed = {col for k in c.tables[name].constraints if k.kind == "primary" for col in k.columns}
            return make([(col, DATA_TYPES.get(k.name, k.ddl), "not null" if col in needed else "", c.tables[name].defaults.get(col, "")) for col, k in c.tables[name].columns], "column string, type string, nullable string, default string")
        if name in c.views or name in c.matviews:
            return make([(f.name, f.dataType.simpleString(), "", "") for f in session.sql(f"SELECT * FROM {name}").schema], "column string, type string, nullable string, default string")
        raise EngineError(f"relation {name} does not exist", "42P01")
    found = [(n, "table") for n in c.tables] + [(n, "view") for n in c.views] + [(n, "materialized view") for n in c.matviews] + [(n, "sequence") for n in c.sequences] + [(n, "index") for n in c.objects.get("index", {})]
    if verb == "d" or verb in {f"d{x}" for x in LISTED}:
        want = {LISTED[verb[1]]} if len(verb) > 1 else {"table", "view", "materialized view", "sequence"}
        return make(sorted(("public", n, kind, session.user) for n, kind in found if kind in want), "schema string, name string, type string, owner string")
    if verb == "df":
        return make(sorted(("public", n, DATA_TYPES.get(x["type"].name, x["type"].ddl)) for n, x in c.objects.get("function", {}).items()), "schema string, name string, result string")
    if verb == "dd":
        return make(sorted((kind, n, text) for (kind, n), text in c.comments.items() if text), "object string, name string, description string")
    listed = {"du": "pg_roles", "dn": "schemata", "dRp": "pg_publication"}.get(verb)
    if listed is None:
        raise UnsupportedError(f"the command {command}")
    return make(rows(session, listed), SCHEMAS[listed])


def register(session, text: str) -> str:
    """Views of the catalog relations that text names; text with their plain names."""

    def one(m: re.Match) -> str:
        name = m[2].lower()
        if name not in SCHEMAS:
            from .errors import EngineError

            raise EngineError(f"relation {m[0]} does not exist", "42P01")
        view = f"catalog_{name}"
        session.spark.createDataFrame(rows(session, name), SCHEMAS[name]).createOrReplaceTempView(view)
        return view

    return outside_literals(text, lambda part: re.sub(r"(?i)\b(information_schema|pg_catalog)\.(\w+)", one, part))
