"""A session: SQL text in, DataFrame out. SELECTs are Spark plans over a pinned snapshot; all else is catalog state and table versions.

Data stay in DataFrames from end to end: DML rewrites a version as a plan over the one before, and only constraint verdicts
(whether a query of offenders is empty) and catalog rows reach the driver.
"""

from __future__ import annotations

import copy
import itertools
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constraints as rules
from . import dialect, infoschema
from .constraints import Constraint
from .errors import ConstraintError, DataError, EngineError, TransactionError, UnsupportedError
from .operators.pairs import ordered_pairs
from .sources import copy_io
from .storage import Store, Version
from .types import SqlType, parse, schema, sql_type

NAME = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_]*)'


KV = "kv pairs"  # the table of key-value pairs; no SQL name has a space
PROGRAM = 32  # statements of a predeclared transaction, at most


@dataclass
class Table:
    columns: list[tuple[str, SqlType]]
    defaults: dict[str, str] = field(default_factory=dict)
    constraints: list[Constraint] = field(default_factory=list)


@dataclass
class Catalog:
    """Everything but rows. objects: kind -> name -> properties, for all that is only named and described."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    matviews: dict[str, str] = field(default_factory=dict)
    sequences: dict[str, dict] = field(default_factory=dict)
    objects: dict[str, dict[str, dict]] = field(default_factory=dict)
    comments: dict[tuple[str, str], str] = field(default_factory=dict)
    grants: set[tuple[str, str, str, str]] = field(default_factory=set)


    def copy(self) -> Catalog:
        """A copy that shares nothing but the state of sequences."""
        out = copy.deepcopy(self)
        out.sequences = dict(self.sequences)
        return out

    def text(self) -> str:
        """The catalog as JSON."""
        kind = lambda k: k.ddl if isinstance(k, SqlType) else k
        return json.dumps({
            "tables": {n: {"columns": [[c, k.ddl] for c, k in t.columns], "defaults": t.defaults, "constraints": [asdict(c) for c in t.constraints]} for n, t in self.tables.items()},
            "views": self.views, "matviews": self.matviews, "sequences": self.sequences, "comments": [[*k, v] for k, v in self.comments.items()], "grants": sorted(self.grants),
            "objects": {kind_: {n: {k: kind(v) for k, v in p.items()} for n, p in known.items()} for kind_, known in self.objects.items()},
        })

    @classmethod
    def of(cls, text: str) -> Catalog:
        """What text() has written."""
        x = json.loads(text)
        constraint = lambda c: Constraint(**(c | {"columns": tuple(c["columns"]), "parent": tuple(c["parent"])}))
        tables = {n: Table([(c, sql_type(k)) for c, k in t["columns"]], t["defaults"], [constraint(c) for c in t["constraints"]]) for n, t in x["tables"].items()}
        objects = {kind: {n: {k: sql_type(v) if k == "type" else v for k, v in p.items()} for n, p in known.items()} for kind, known in x["objects"].items()}
        sequences = {n: p | ({"owner": tuple(p["owner"])} if "owner" in p else {}) for n, p in x["sequences"].items()}
        return cls(tables, x["views"], x["matviews"], sequences, objects, {(a, b): v for a, b, v in x["comments"]}, {tuple(g) for g in x["grants"]})


def plain(name: str) -> str:
    name = name.strip()
    return name[1:-1] if name.startswith('"') else name.removeprefix("public.").lower()


def split_top(text: str, by: str = ",") -> list[str]:
    """text cut at commas outside of brackets and literals."""
    out, depth, now = [], 0, ""
    for t in dialect.tokens(text):
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if t == by and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += t
    return [*out, now.strip()] if now.strip() else out


class Session:
    """One client. `spark` is a session of its own, so its views and settings touch no other."""

    def __init__(self, spark: SparkSession, store: Store | None = None, catalog: Catalog | None = None, strict: bool = False, user: str = "owner") -> None:
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.store = store or Store(spark)
        kept = self.store.saved.get("catalog")
        self.catalog = catalog or (Catalog.of(kept) if kept else Catalog())
        self.strict, self.user, self.role = strict, user, user
        self.settings: dict[str, str] = {}
        self.prepared: dict[str, str] = {}
        self.programs: dict[str, list[str]] = {}
        self.cursors: dict[str, list] = {}
        self.last_values: dict[str, int] = {}
        self.registered: set[str] = set()  # relations that have a temp view
        self.shared: Catalog | None = None  # what other sessions see while this one's transaction changes a copy
        self.before: Catalog | None = None
        self._idle()
        self.commands: list[tuple[re.Pattern, Callable]] = [(re.compile(p, re.I | re.S), f) for p, f in self._patterns()]

    # transactions

    def _idle(self) -> None:
        if self.shared is not None:
            self.catalog = self.shared
        self.shared = self.before = None
        self.open, self.failed, self.isolation = False, False, "read committed"
        self.pinned: dict[str, Version] | None = None
        self.overlay: dict[str, tuple[Version | None, Version | None]] = {}

    def begin(self, isolation: str = "read committed") -> None:
        isolation = re.sub(r"\s+", " ", isolation.strip().lower()) or "read committed"
        if isolation == "read uncommitted":
            isolation = "read committed"
        if isolation not in ("read committed", "repeatable read"):
            raise UnsupportedError(f"isolation level {isolation} is not supported")
        if self.open:
            raise TransactionError("a transaction is open already", "25001")
        self.open, self.isolation = True, isolation
        self.pinned = self.store.snapshot() if isolation == "repeatable read" else None

    def commit(self) -> None:
        try:
            if self.failed:
                return
            with self.store.lock:
                if self.shared is not None and self.shared != self.before:
                    raise TransactionError("could not serialize access to the catalog", "40001")
                self.store.publish(self.overlay, self._kept())
                if self.shared is not None:
                    for f in fields(Catalog):
                        setattr(self.shared, f.name, getattr(self.catalog, f.name))
        finally:
            self._idle()

    def rollback(self) -> None:
        self._idle()

    def _branch(self) -> None:
        """From now on the open transaction changes a copy of the catalog; numbers drawn from sequences are never given back."""
        if self.open and self.shared is None:
            self.shared, self.before, self.catalog = self.catalog, self.catalog.copy(), self.catalog.copy()

    def _publish(self, changes: dict[str, tuple[Version | None, Version | None]]) -> None:
        """Changes at once, or in the overlay of the open transaction."""
        if not self.open:
            self.store.publish(changes, self._kept())
        for name, (base, new) in changes.items() if self.open else ():
            self.overlay[name] = (self.overlay[name][0] if name in self.overlay else base, new)

    def _kept(self) -> dict[str, str]:
        return {"catalog": self.catalog.text()} if self.store.durable else {}

    def _saved(self) -> None:
        if not self.open:
            self.store.save(self._kept())

    def version(self, name: str) -> Version:
        if name in self.overlay:
            found = self.overlay[name][1]
        elif self.pinned is not None and name in self.pinned:
            found = self.pinned[name]
        else:
            found = self.store.latest(name) if self.pinned is None else None
        if found is None:
            raise EngineError(f"relation {name} does not exist", "42P01")
        return found

    def table(self, name: str, as_of: int | None = None) -> DataFrame:
        """A table's rows: the transaction's own writes over its snapshot, or an older version."""
        return self.store.read(self.version(name) if as_of is None else self.store.as_of(name, as_of), self.spark)

    def _put(self, name: str, df: DataFrame | None, append: bool = False, base: Version | None = None, kept: tuple[str, ...] = ()) -> None:
        """Publish, or keep in the transaction, a new version of name whose rows are df's, after the old ones with append, or after those of
        the files `kept`."""
        base = base or self.store.latest(name)
        old = self.overlay.get(name, (base, base))
        now = old[1]
        folder = (self.store.write(df),) if df is not None else ()
        kept = now.folders if append and now else kept
        columns = schema(self.catalog.tables[name].columns) if name in self.catalog.tables else df.schema
        new = Version((now.number if now else 0) + 1, columns, kept + folder, now.batches if now else ())
        try:
            if name in self.catalog.tables:
                rows = self.store.read(new, self.spark)
                fresh, old_rows = (self.store.read(replace(new, folders=f), self.spark) for f in (folder, kept))
                rules.verify(name, fresh, self.catalog.tables[name].constraints, self.table_or(name, rows), old_rows if kept else None)
                if not append:
                    self._protect(name, rows)
            change = {name: (old[0] if self.pinned is None else self.pinned.get(name, old[0]), new)}
            if self.open:
                self.overlay |= change
            else:
                self.store.publish(change, self._kept())
        except Exception:
            self.store.remove(folder)
            raise

    def table_or(self, name: str, rows: DataFrame) -> Callable[[str], DataFrame]:
        return lambda other: rows if other == name else self.table(other)

    def _protect(self, name: str, rows: DataFrame) -> None:
        """No child may be left without its parent."""
        for child, t in self.catalog.tables.items():
            for c in t.constraints:
                if c.kind == "foreign" and c.parent[0] == name and child != name and not rules.orphans(self.table(child), c.columns[0], rows, c.parent[1]).isEmpty():
                    raise ConstraintError(f"{child} still refers to {name} ({c.name})", "23503")

    # reading

    def _register(self, text: str, seen: tuple[str, ...] = ()) -> None:
        """Temp views of this session for every relation that text names."""
        words = {plain(t) for t in dialect.tokens(text) if re.fullmatch(NAME, t)}
        for name in words & self.registered - {*self.catalog.views, *self.catalog.tables, *self.catalog.matviews}:
            self.spark.catalog.dropTempView(name)  # its relation is gone
            self.registered.discard(name)
        for name in words:
            if name in self.catalog.views:
                if name in seen:
                    raise EngineError(f"view {name} refers to itself", "42P17")
                self._register(self.catalog.views[name], (*seen, name))
                self._select(self.catalog.views[name], register=False).createOrReplaceTempView(name)
                self.registered.add(name)
            elif name in self.catalog.tables or name in self.catalog.matviews:
                self._allowed(name, "select")
                self.table(name).createOrReplaceTempView(name)
                self.registered.add(name)

    def _select(self, text: str, register: bool = True) -> DataFrame:
        if self.strict:
            dialect.check_strict(text)
        text = dialect.outside_literals(text, lambda part: re.sub(r"(?i)\bpublic\.", "", part))
        if infoschema.CATALOG.search(text):
            text = infoschema.register(self, infoschema.expressions(self, text))
        if register:
            self._register(text)
        kinds = {n: k.spark.simpleString() for t in self.catalog.tables.values() for n, k in t.columns}
        for m in re.finditer(rf"(?i)\b(sum|avg)\s*\(\s*(?:distinct\s+)?((?:{NAME}\.)*{NAME})\s*\)", text):
            if kinds.get(plain(m[2].rpartition(".")[2])) in ("string", "boolean", "date", "timestamp_ntz"):
                raise DataError(f"function {m[1].lower()}({kinds[plain(m[2].rpartition('.')[2])]}) does not exist", "42883")
        if (pairs := self._ordered_pairs(text)) is not None:
            return pairs
        return self.spark.sql(dialect.to_spark(text, lambda c: kinds.get(c.rpartition(".")[2].lower())))

    def _ordered_pairs(self, text: str) -> DataFrame | None:
        """Pairs within groups of one table, which a plain join would make in one task for each key."""
        p = dialect.ordered_pairs(text)
        if p is None or p["table"] not in self.catalog.tables:
            return None
        kinds = dict(self.catalog.tables[p["table"]].columns)
        if not {*p["keys"], p["by"], *(c for _, c, _ in p["list"])} <= {*kinds}:
            return None  # Spark's own errors
        low, high = (list(dict.fromkeys(c for s, c, _ in p["list"] if s == side)) or [p["by"]] for side in ("low", "high"))
        found = ordered_pairs(self.table(p["table"]), p["keys"], p["by"], low, high, p["equal"])
        return found.select(*(F.col(f"{side}.`{c}`").alias(name) for side, c, name in p["list"]))

    # key-value pairs: a versioned table like any other, outside of the catalog

    def _pairs(self) -> tuple[Version | None, DataFrame]:
        base = self.overlay[KV][1] if KV in self.overlay else (self.pinned.get(KV) if self.pinned is not None else self.store.latest(KV))
        return base, self.store.read(base, self.spark) if base else self.spark.createDataFrame([], "key string, value string")

    def _keys(self, keys: list[str] | DataFrame) -> DataFrame:
        return keys.select(F.col(keys.columns[0]).alias("key")).distinct() if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")

    def _put_pairs(self, base: Version | None, rows: DataFrame) -> None:
        self._publish({KV: (base, Version((base.number if base else 0) + 1, rows.schema, (self.store.write(rows),)))})

    def kv_set(self, pairs: list[tuple[str, str]] | DataFrame) -> None:
        """Set a batch of pairs as one version. Of a key that the batch repeats, a list's last value and a DataFrame's greatest is set."""
        batch = pairs.select(F.col(pairs.columns[0]).alias("key"), F.col(pairs.columns[1]).alias("value")).groupBy("key").agg(F.max("value").alias("value")) if isinstance(pairs, DataFrame) else self.spark.createDataFrame(list(dict(pairs).items()), "key string, value string")
        base, old = self._pairs()
        self._put_pairs(base, old.join(batch, "key", "left_anti").select("key", "value").unionByName(batch))

    def kv_get(self, keys: list[str] | DataFrame) -> DataFrame:
        """The pairs of a batch of keys; keys that are not set are not listed."""
        return self._pairs()[1].join(self._keys(keys), "key").select("key", "value")

    def kv_delete(self, keys: list[str] | DataFrame) -> None:
        """Delete a batch of keys as one version."""
        base, old = self._pairs()
        self._put_pairs(base, old.join(self._keys(keys), "key", "left_anti").select("key", "value"))

    def psql(self, command: str) -> DataFrame:
        """What a list command such as `\\dt` or `\\d NAME` shows."""
        return infoschema.psql(self, command)

    # predeclared transactions

    def declare_program(self, name: str, statements: list[str]) -> None:
        """A transaction of up to PROGRAM statements on rows, declared once and run as a whole; $n are its parameters."""
        if not 0 < len(statements) <= PROGRAM:
            raise UnsupportedError(f"a program of {len(statements)} statements")
        for text in statements:
            if not re.match(r"(?i)\s*(select|insert|update|delete)\b", text):
                raise UnsupportedError(f"{text.split()[0].upper() if text.split() else 'nothing'} in a program")
        self.programs[name] = list(statements)

    def run_program(self, name: str, args: tuple = ()) -> list[DataFrame]:
        """All of the statements in one transaction, or none: the first that fails takes back the others. Gives their results."""
        if name not in self.programs:
            raise EngineError(f"program {name} does not exist", "26000")
        self.begin("repeatable read")
        try:
            out = [self.sql(text, args) for text in self.programs[name]]
        except Exception:
            self.rollback()
            raise
        self.commit()
        return out

    def _allowed(self, name: str, privilege: str) -> None:
        if self.role == self.user:
            return
        if not any((k, n, p, r) in self.catalog.grants for k in ("table",) for n in (name, "*") for p in (privilege, "all") for r in (self.role, "public")):
            raise EngineError(f"permission denied for table {name}", "42501")

    # the entry point

    def sql(self, text: str, args: tuple = ()) -> DataFrame:
        """Run one statement; statements without rows give an empty DataFrame with a command tag column."""
        text = text.strip().rstrip(";").strip()
        if not re.match(r"(?i)prepare\b", text):
            text = dialect.bind(text, args)
        if self.failed and not re.match(r"(?i)(rollback|commit|end|abort)\b", text):
            raise TransactionError("the transaction has failed; commands are ignored until it ends", "25P02")
        try:
            changes = re.match(r"(?i)(create|drop|alter|grant|revoke|comment)\b", text)
            if changes:
                self._branch()
            for pattern, run in self.commands:
                if m := pattern.fullmatch(text):
                    out = run(m)
                    if changes:
                        self._saved()
                    return out if isinstance(out, DataFrame) else self._tag(out or text.split()[0].upper())
            if re.match(r"(?i)(select|with|values)\b", text):
                return self._select(text)
            raise UnsupportedError(f"this statement is not supported: {text[:60]}")
        except Exception:
            self.failed = self.open
            raise

    def _tag(self, tag: str) -> DataFrame:
        return self.spark.createDataFrame([], "command string").select(F.lit(tag).alias("command"))

    def _patterns(self) -> list[tuple[str, Callable]]:
        obj = lambda kind, p: (p, lambda m: self._create(kind, plain(m[1]), {"text": m[0]}))
        drop = lambda kind: (rf"drop\s+{kind}\s+(if\s+exists\s+)?({NAME}).*", lambda m: self._drop(kind, plain(m[2]), bool(m[1])))
        named = lambda kind: (rf"alter\s+{kind}\s+({NAME})\s+rename\s+to\s+({NAME})", lambda m: self._rename(kind, plain(m[1]), plain(m[2])))
        return [
            (r"(?:begin|start\s+transaction)(?:\s+(?:work|transaction))?(?:\s+isolation\s+level\s+(.*))?", lambda m: self.begin(m[1] or "")),
            (r"(?:commit|end)(?:\s+(?:work|transaction))?(\s+and\s+chain)?", lambda m: self._end(self.commit, m[1])),
            (r"(?:rollback|abort)(?:\s+(?:work|transaction))?(\s+and\s+chain)?", lambda m: self._end(self.rollback, m[1])),
            (r"flush", lambda m: "FLUSH"),
            (r"reset\s+all|discard\s+all", lambda m: (self.settings.clear(), "RESET")[1]),
            (rf"set\s+role\s+({NAME})", lambda m: setattr(self, "role", plain(m[1]))),
            (r"show\s+transaction_isolation|show\s+transaction\s+isolation\s+level", lambda m: self.spark.range(1).select(F.lit(self.isolation).alias("transaction_isolation"))),
            (rf"show\s+({NAME})", lambda m: self.spark.range(1).select(F.lit(self.settings.get(plain(m[1]), "")).alias(plain(m[1])))),
            (rf"set\s+(?:session\s+|local\s+)?({NAME})\s*(?:=|\s+to\s+)\s*(.+)", lambda m: self.settings.update({plain(m[1]): m[2].strip().strip("'")})),
            (r"set\s+(\S+)\s+(\S+)", lambda m: self.kv_set([(m[1], m[2])])),
            (r"get\s+(\S+)", lambda m: self.kv_get([m[1]])),
            (r"delete\s+(?!from\b)(\S+)", lambda m: (self.kv_delete([m[1]]), "DELETE")[1]),
            # tables
            (rf"create\s+table\s+(if\s+not\s+exists\s+)?((?:{NAME}\.)?{NAME})\s*\((.*)\)", lambda m: self._create_table(plain(m[2]), m[3], bool(m[1]))),
            (rf"drop\s+table\s+(if\s+exists\s+)?((?:{NAME}\.)?{NAME})(?:\s+(?:cascade|restrict))?", lambda m: self._drop_table(plain(m[2]), bool(m[1]))),
            (rf"truncate\s+(?:table\s+)?(?:only\s+)?({NAME})(\s+restart\s+identity)?.*", lambda m: self._truncate(plain(m[1]), bool(m[2]))),
            (rf"alter\s+table\s+(?:only\s+)?({NAME})\s+add\s+(?:constraint\s+({NAME})\s+)?((?:primary|unique|check|foreign)\b.*)", lambda m: self._add_constraint(plain(m[1]), plain(m[2] or ""), m[3])),
            (rf"alter\s+table\s+({NAME})\s+add\s+(?:column\s+)?(.*)", lambda m: self._add_column(plain(m[1]), m[2])),
            (rf"alter\s+table\s+({NAME})\s+drop\s+constraint\s+({NAME}).*", lambda m: self._drop_constraint(plain(m[1]), plain(m[2]))),
            (rf"alter\s+table\s+({NAME})\s+rename\s+constraint\s+({NAME})\s+to\s+({NAME})", lambda m: self._rename_constraint(plain(m[1]), plain(m[2]), plain(m[3]))),
            (rf"alter\s+table\s+({NAME})\s+rename\s+to\s+({NAME})", lambda m: self._rename_table(plain(m[1]), plain(m[2]))),
            (rf"alter\s+table\s+({NAME})\s+rename\s+(?:column\s+)?({NAME})\s+to\s+({NAME})", lambda m: self._change_columns(plain(m[1]), rename=(plain(m[2]), plain(m[3])))),
            (rf"alter\s+table\s+({NAME})\s+drop\s+(?:column\s+)?({NAME}).*", lambda m: self._change_columns(plain(m[1]), drop=plain(m[2]))),
            (rf"alter\s+table\s+({NAME})\s+alter\s+(?:column\s+)?({NAME})\s+(?:set\s+default\s+(.*)|drop\s+default)", lambda m: self._default(plain(m[1]), plain(m[2]), m[3])),
            (rf"create\s+(unique\s+)?index\s+({NAME})\s+on\s+({NAME})\s*(?:using\s+\w+\s*)?\((.*)\)", lambda m: self._index(bool(m[1]), plain(m[2]), plain(m[3]), m[4])),
            # rows
            (rf"insert\s+into\s+((?:{NAME}\.)?{NAME})\s*(?:\(([^)]*)\))?\s*(values\s*.*?|default\s+values)(?:\s+returning\s+(.*))?", lambda m: self._insert(plain(m[1]), m[2], m[3], m[4])),
            (rf"update\s+((?:{NAME}\.)?{NAME})\s+set\s+(.*?)\s+where\s+(.*?)(?:\s+returning\s+(.*))?", lambda m: self._update(plain(m[1]), m[2], m[3], m[4])),
            (rf"delete\s+from\s+((?:{NAME}\.)?{NAME})\s+where\s+(.*?)(?:\s+returning\s+(.*))?", lambda m: self._delete(plain(m[1]), m[2], m[3])),
            (r"(update|delete)\b.*", lambda m: self._refuse(f"{m[1].upper()} without WHERE")),
            (rf"copy\s+({NAME})\s*(?:\(([^)]*)\))?\s+from\s+'([^']*)'\s*(.*)", lambda m: self._copy_in(plain(m[1]), m[2], m[3], m[4])),
            (rf"copy\s+({NAME})\s*(?:\(([^)]*)\))?\s+to\s+'([^']*)'\s*(.*)", lambda m: self._copy_out(plain(m[1]), m[2], m[3], m[4])),
            (r"vacuum(?:\s+(\S+))?", lambda m: (([self.store.prune(n) for n in ([plain(m[1])] if m[1] else list(self.store.tables))]), "VACUUM")[1]),
            # views
            (rf"create\s+(or\s+replace\s+)?view\s+({NAME})\s+as\s+(.*)", lambda m: self._view(plain(m[2]), m[3], bool(m[1]))),
            (rf"drop\s+view\s+(if\s+exists\s+)?({NAME}).*", lambda m: self._gone(self.catalog.views, plain(m[2]), bool(m[1]), "view")),
            (rf"alter\s+view\s+({NAME})\s+rename\s+to\s+({NAME})", lambda m: self.catalog.views.update({plain(m[2]): self.catalog.views.pop(plain(m[1]))})),
            (rf"create\s+materialized\s+view\s+({NAME})\s+as\s+(.*)", lambda m: self._matview(plain(m[1]), m[2])),
            (rf"refresh\s+materialized\s+view\s+({NAME})", lambda m: self._refresh(plain(m[1]))),
            (rf"drop\s+materialized\s+view\s+(if\s+exists\s+)?({NAME}).*", lambda m: self._drop_matview(plain(m[2]), bool(m[1]))),
            (rf"alter\s+materialized\s+view\s+({NAME})\s+rename\s+to\s+({NAME})", lambda m: self._rename_matview(plain(m[1]), plain(m[2]))),
            # functions, sequences
            (rf"create\s+(?:or\s+replace\s+)?function\s+({NAME})\s*\(\s*\)\s+returns\s+(.+?)\s+language\s+sql\s+as\s+(?:'(.*)'|\$\$(.*)\$\$)", lambda m: self._create("function", plain(m[1]), {"type": sql_type(m[2]), "body": (m[3] or m[4]).replace("''", "'").strip().rstrip(";")})),
            (rf"select\s+nextval\s*\(\s*'([^']*)'\s*\)", lambda m: self._number("nextval", self.nextval(plain(m[1])))),
            (rf"select\s+currval\s*\(\s*'([^']*)'\s*\)", lambda m: self._number("currval", self.currval(plain(m[1])))),
            (rf"select\s+setval\s*\(\s*'([^']*)'\s*,\s*(-?\d+)\s*(?:,\s*(true|false)\s*)?\)", lambda m: self._number("setval", self.setval(plain(m[1]), int(m[2]), (m[3] or "true").lower() == "true"))),
            (rf"select\s+({NAME})\s*\(\s*\)", lambda m: self._call(plain(m[1]))),
            (rf"create\s+sequence\s+(?:if\s+not\s+exists\s+)?({NAME})(?:\s+start\s+(?:with\s+)?(-?\d+))?.*", lambda m: self.catalog.sequences.update({plain(m[1]): {"last": int(m[2] or 1), "called": False, "start": int(m[2] or 1)}})),
            (rf"alter\s+sequence\s+({NAME})\s+restart(?:\s+(?:with\s+)?(-?\d+))?", lambda m: self._restart(plain(m[1]), m[2])),
            (rf"alter\s+sequence\s+({NAME})\s+rename\s+to\s+({NAME})", lambda m: self.catalog.sequences.update({plain(m[2]): self.catalog.sequences.pop(plain(m[1]))})),
            (rf"drop\s+sequence\s+(if\s+exists\s+)?({NAME}).*", lambda m: self._gone(self.catalog.sequences, plain(m[2]), bool(m[1]), "sequence")),
            (rf"create\s+domain\s+({NAME})\s+as\s+(.+)", lambda m: self._create("domain", plain(m[1]), {"type": sql_type(m[2])})),
            # metadata objects
            obj("schema", rf"create\s+schema\s+(?:if\s+not\s+exists\s+)?({NAME}).*"),
            obj("database", rf"create\s+database\s+({NAME}).*"),
            obj("tablespace", rf"create\s+tablespace\s+({NAME}).*"),
            obj("extension", rf"create\s+extension\s+(?:if\s+not\s+exists\s+)?({NAME}).*"),
            obj("publication", rf"create\s+publication\s+({NAME}).*"),
            obj("subscription", rf"create\s+subscription\s+({NAME}).*"),
            obj("role", rf"create\s+(?:role|user)\s+({NAME}).*"),
            *(drop(k) for k in ("schema", "database", "tablespace", "extension", "publication", "subscription", "role", "function", "domain", "index")),
            *(named(k) for k in ("database", "tablespace", "role", "function", "index")),
            (rf"alter\s+role\s+({NAME})\s+(?:with\s+)?(login|nologin)", lambda m: self.catalog.objects["role"][plain(m[1])].update(login=m[2].lower() == "login")),
            (r"alter\s+default\s+privileges\s+(?:in\s+schema\s+\S+\s+)?(grant|revoke)\s+(.+?)\s+on\s+tables\s+(?:to|from)\s+(.+)", lambda m: self._grant(m[1].lower() == "grant", m[2], "table", "*", m[3])),
            (r"(grant|revoke)\s+(.+?)\s+on\s+(?:(table|database|tablespace|function|schema)\s+)?(.+?)\s+(?:to|from)\s+(.+)", lambda m: self._grant(m[1].lower() == "grant", m[2], (m[3] or "table").lower(), m[4], m[5])),
            (r"comment\s+on\s+(\w+(?:\s+view)?)\s+(\S+)\s+is\s+(null|'.*')", lambda m: self.catalog.comments.update({(m[1].lower(), plain(m[2])): "" if m[3].lower() == "null" else m[3][1:-1]})),
            # prepared statements and cursors
            (rf"prepare\s+({NAME})\s*(?:\([^)]*\))?\s+as\s+(.*)", lambda m: self.prepared.update({plain(m[1]): m[2]})),
            (rf"execute\s+({NAME})\s*(?:\((.*)\))?", lambda m: self._execute(plain(m[1]), m[2])),
            (rf"deallocate\s+(?:prepare\s+)?({NAME})", lambda m: self.prepared.clear() if plain(m[1]) == "all" else self._gone(self.prepared, plain(m[1]), False, "prepared statement")),
            (rf"declare\s+({NAME})\s+(?:no\s+scroll\s+)?cursor\s+(?:with(?:out)?\s+hold\s+)?for\s+(.*)", lambda m: self.cursors.update({plain(m[1]): [self._select(m[2]), 0]})),
            (rf"(fetch|move)\s+(?:(next|all|forward|forward\s+all|\d+|forward\s+\d+)\s+)?(?:from\s+|in\s+)?({NAME})", lambda m: self._fetch(m[1].lower(), (m[2] or "next").lower(), plain(m[3]))),
            (rf"close\s+({NAME})", lambda m: self._gone(self.cursors, plain(m[1]), False, "cursor")),
        ]

    def _refuse(self, what: str):
        raise UnsupportedError(f"{what} is not supported")

    def _end(self, how: Callable, chain: str | None) -> None:
        isolation = self.isolation
        how()
        if chain:
            self.begin(isolation)

    # catalog objects

    def _create(self, kind: str, name: str, properties: dict) -> str:
        known = self.catalog.objects.setdefault(kind, {})
        if name in known and kind not in ("function",) and not re.search(r"(?i)if\s+not\s+exists", properties.get("text", "")):
            raise EngineError(f"{kind} {name} already exists", "42710")
        known[name] = properties
        return f"CREATE {kind.upper()}"

    def _drop(self, kind: str, name: str, if_exists: bool) -> str:
        return self._gone(self.catalog.objects.setdefault(kind, {}), name, if_exists, kind)

    def _gone(self, known: dict, name: str, if_exists: bool, kind: str) -> str:
        if name not in known and not if_exists:
            raise EngineError(f"{kind} {name} does not exist", "42704")
        known.pop(name, None)
        return f"DROP {kind.upper()}"

    def _rename(self, kind: str, old: str, new: str) -> str:
        known = self.catalog.objects.setdefault(kind, {})
        if old not in known:
            raise EngineError(f"{kind} {old} does not exist", "42704")
        known[new] = known.pop(old)
        return f"ALTER {kind.upper()}"

    def _grant(self, give: bool, privileges: str, kind: str, names: str, roles: str) -> str:
        for p in privileges.lower().replace("all privileges", "all").split(","):
            for n in names.split(","):
                for r in roles.split(","):
                    key = (kind, n.strip() if n.strip() == "*" else plain(n), p.strip(), plain(r))
                    (self.catalog.grants.add if give else self.catalog.grants.discard)(key)
        return "GRANT" if give else "REVOKE"

    def _kind(self, text: str) -> SqlType:
        domain = self.catalog.objects.get("domain", {}).get(plain(text))
        return domain["type"] if domain else sql_type(text)

    def _create_table(self, name: str, body: str, if_not_exists: bool) -> str | None:
        if name in self.catalog.tables:
            if if_not_exists:
                return "CREATE TABLE"
            raise EngineError(f"relation {name} already exists", "42P07")
        table = Table([])
        late = []
        for item in split_top(body):
            if re.match(r"(?i)(constraint\s|primary\s+key|unique\s*\(|check\s*\(|foreign\s+key)", item):
                late.append(item)
            else:
                late += self._column(name, table, item)
        self.catalog.tables[name] = table
        try:
            for item in late:
                m = re.fullmatch(rf"(?is)(?:constraint\s+({NAME})\s+)?(.*)", item)
                table.constraints.append(self._constraint(name, plain(m[1] or ""), m[2]))
        except Exception:
            del self.catalog.tables[name]
            raise
        version = Version(1, schema(table.columns), ())
        self._publish({name: (None, version)})
        return "CREATE TABLE"

    def _column(self, table_name: str, table: Table, item: str) -> list[str]:
        m = re.fullmatch(rf"(?is)({NAME})\s+([A-Za-z0-9_]+(?:\s+without\s+time\s+zone)?(?:\s*\([^)]*\))?)(.*)", item)
        if not m:
            raise EngineError(f"can't read the column {item!r}", "42601")
        name, rest = plain(m[1]), m[3]
        table.columns.append((name, self._kind(m[2])))
        late = []
        if m[2].lower() in ("serial", "bigserial"):
            sequence = f"{table_name}_{name}_seq"
            self.catalog.sequences[sequence] = {"last": 1, "called": False, "start": 1, "owner": (table_name, name)}
            table.defaults[name] = f"nextval('{sequence}')"
        if d := re.search(r"(?is)\bdefault\s+('(?:[^']|'')*'|[^\s(]+(?:\([^)]*\))?)", rest):
            table.defaults[name] = d[1]
        if re.search(r"(?i)\bprimary\s+key\b", rest):
            late.append(f"primary key ({name})")
        elif re.search(r"(?i)\bunique\b", rest):
            late.append(f"unique ({name})")
        if re.search(r"(?i)\bnot\s+null\b", rest):
            late.append(f"constraint {table_name}_{name}_not_null check ({name} IS NOT NULL)")
        if k := re.search(r"(?is)\bcheck\s*(\(.*\))", rest):
            late.append(f"check {k[1]}")
        if r := re.search(rf"(?i)\breferences\s+({NAME})\s*(?:\(({NAME})\))?", rest):
            late.append(f"foreign key ({name}) references {r[1]}" + (f" ({r[2]})" if r[2] else ""))
        return late

    def _constraint(self, table: str, name: str, text: str) -> Constraint:
        if m := re.fullmatch(r"(?is)(primary\s+key|unique)\s*\((.*)\)", text):
            kind = "primary" if m[1].lower().startswith("p") else "unique"
            columns = tuple(plain(c) for c in m[2].split(","))
            return Constraint(name or f"{table}_{'pkey' if kind == 'primary' else '_'.join(columns) + '_key'}", kind, columns)
        if m := re.fullmatch(r"(?is)check\s*\((.*)\)", text):
            return Constraint(name or f"{table}_check{len(self.catalog.tables[table].constraints)}", "check", (), m[1])
        if m := re.fullmatch(rf"(?is)foreign\s+key\s*\(\s*({NAME})\s*\)\s+references\s+({NAME})\s*(?:\(\s*({NAME})\s*\))?.*", text):
            parent = plain(m[2])
            if parent not in self.catalog.tables:
                raise EngineError(f"relation {parent} does not exist", "42P01")
            key = plain(m[3]) if m[3] else next(c.columns[0] for c in self.catalog.tables[parent].constraints if c.kind == "primary")
            return Constraint(name or f"{table}_{plain(m[1])}_fkey", "foreign", (plain(m[1]),), "", (parent, key))
        raise UnsupportedError(f"constraint {text!r} is not supported")

    def _need(self, name: str) -> Table:
        if name not in self.catalog.tables:
            raise EngineError(f"relation {name} does not exist", "42P01")
        return self.catalog.tables[name]

    def _add_constraint(self, name: str, label: str, text: str) -> str:
        c = self._constraint(name, label, text) if self._need(name) else None
        rules.verify(name, self.table(name), [c], self.table)
        self.catalog.tables[name].constraints.append(c)
        return "ALTER TABLE"

    def _drop_constraint(self, name: str, label: str) -> str:
        table = self._need(name)
        if all(c.name != label for c in table.constraints):
            raise EngineError(f"constraint {label} does not exist", "42704")
        table.constraints = [c for c in table.constraints if c.name != label]
        return "ALTER TABLE"

    def _rename_constraint(self, name: str, old: str, new: str) -> str:
        table = self._need(name)
        table.constraints = [replace(c, name=new) if c.name == old else c for c in table.constraints]
        return "ALTER TABLE"

    def _index(self, unique: bool, label: str, name: str, columns: str) -> str:
        if unique:
            self._add_constraint(name, label, f"unique ({columns})")
        return self._create("index", label, {"table": name, "columns": columns, "unique": unique})

    def _add_column(self, name: str, item: str) -> str:
        table, rows = self._need(name), self.table(name)
        late = self._column(name, table, item)
        column, kind = table.columns[-1]
        value = F.expr(dialect.to_spark(table.defaults[column])) if column in table.defaults and "nextval" not in table.defaults[column] else F.lit(None)
        self._put(name, rows.withColumn(column, value.cast(kind.spark)))
        for text in late:
            m = re.fullmatch(rf"(?is)(?:constraint\s+({NAME})\s+)?(.*)", text)
            self._add_constraint(name, plain(m[1] or ""), m[2])
        return "ALTER TABLE"

    def _change_columns(self, name: str, rename: tuple[str, str] | None = None, drop: str | None = None) -> str:
        table, rows = self._need(name), self.table(name)
        if rename:
            table.columns = [(rename[1] if c == rename[0] else c, k) for c, k in table.columns]
            table.constraints = [replace(c, columns=tuple(rename[1] if x == rename[0] else x for x in c.columns)) for c in table.constraints]
            self._put(name, rows.withColumnRenamed(*rename))
        else:
            table.columns = [(c, k) for c, k in table.columns if c != drop]
            table.constraints = [c for c in table.constraints if drop not in c.columns]
            self._put(name, rows.drop(drop))
        return "ALTER TABLE"

    def _default(self, name: str, column: str, text: str | None) -> str:
        table = self._need(name)
        if text is None:
            table.defaults.pop(column, None)
        else:
            table.defaults[column] = text
        return "ALTER TABLE"

    def _rename_table(self, old: str, new: str) -> str:
        self.catalog.tables[new] = self._need(old)
        del self.catalog.tables[old]
        version = self.version(old)
        self._publish({old: (version, None), new: (None, version)})
        return "ALTER TABLE"

    def _drop_table(self, name: str, if_exists: bool) -> str:
        if name not in self.catalog.tables:
            if if_exists:
                return "DROP TABLE"
            raise EngineError(f"relation {name} does not exist", "42P01")
        if any(c.kind == "foreign" and c.parent[0] == name for t, x in self.catalog.tables.items() if t != name for c in x.constraints):
            raise ConstraintError(f"other tables refer to {name}", "2BP01")
        del self.catalog.tables[name]
        self._publish({name: (self.version(name), None)})
        return "DROP TABLE"

    # views

    def _view(self, name: str, text: str, swap: bool) -> str:
        if name in self.catalog.views and not swap:
            raise EngineError(f"relation {name} already exists", "42P07")
        if re.search(rf"(?i)\b{re.escape(name)}\b", text):
            raise EngineError(f"view {name} refers to itself", "42P17")
        if self.strict:
            if not re.match(r"(?i)\s*select\s+\*\s+from\b", text):
                raise UnsupportedError("a view of anything but SELECT * is not supported in strict mode")
            if {plain(t) for t in dialect.tokens(text) if re.fullmatch(NAME, t)} & {*self.catalog.matviews}:
                raise UnsupportedError("a view over a materialized view is not supported in strict mode")
            if any(name in {plain(t) for t in dialect.tokens(v) if re.fullmatch(NAME, t)} for n, v in self.catalog.views.items() if n != name):
                raise EngineError(f"other views depend on {name}", "2BP01")
        self._select(text)
        self.catalog.views[name] = text
        return "CREATE VIEW"

    def _matview(self, name: str, text: str) -> str:
        df = self._select(text)
        self.catalog.matviews[name] = text
        self._publish({name: (None, Version(1, df.schema, (self.store.write(df),)))})
        return "CREATE MATERIALIZED VIEW"

    def _refresh(self, name: str) -> str:
        base, df = self.version(name), self._select(self.catalog.matviews[name])
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in base.schema]:
            raise EngineError(f"the shape of {name} has changed", "42P16")
        self._publish({name: (base, Version(base.number + 1, base.schema, (self.store.write(df),)))})
        return "REFRESH MATERIALIZED VIEW"

    def _drop_matview(self, name: str, if_exists: bool) -> str:
        if name in self.catalog.matviews:
            self._publish({name: (self.version(name), None)})
        return self._gone(self.catalog.matviews, name, if_exists, "materialized view")

    def _rename_matview(self, old: str, new: str) -> str:
        version = self.store.latest(old)
        self.catalog.matviews[new] = self.catalog.matviews.pop(old)
        self.store.publish({old: (version, None), new: (None, version)})
        return "ALTER MATERIALIZED VIEW"

    # functions and sequences

    def _call(self, name: str) -> DataFrame:
        f = self.catalog.objects.get("function", {}).get(name)
        if f is None:
            raise EngineError(f"function {name}() does not exist", "42883")
        body = self._select(f["body"])
        return body.select(F.col(f"`{body.columns[0]}`").cast(f["type"].spark).alias(name))

    def _number(self, name: str, value: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(value).cast("long").alias(name))

    def _sequence(self, name: str) -> dict:
        if name not in self.catalog.sequences:
            raise EngineError(f"sequence {name} does not exist", "42P01")
        return self.catalog.sequences[name]

    def nextval(self, name: str, count: int = 1) -> int:
        """The next value; with count, the first of so many reserved ones. Never given back."""
        s = self._sequence(name)
        first = s["last"] + 1 if s["called"] else s["last"]
        s.update(last=first + count - 1, called=True)
        self.last_values[name] = s["last"]
        self._saved()
        return first

    def currval(self, name: str) -> int:
        self._sequence(name)
        if name not in self.last_values:
            raise EngineError(f"currval of {name} is not yet defined in this session", "55000")
        return self.last_values[name]

    def setval(self, name: str, value: int, called: bool = True) -> int:
        self._sequence(name).update(last=value, called=called)
        if called:
            self.last_values[name] = value
        return value

    def _restart(self, name: str, value: str | None) -> str:
        s = self._sequence(name)
        s.update(last=int(value) if value else s["start"], called=False)
        return "ALTER SEQUENCE"

    # rows

    def load(self, name: str, df: DataFrame, columns: list[tuple[str, SqlType]], constraints: list[Constraint] = ()) -> None:
        """A table from a DataFrame."""
        self._branch()
        self.catalog.tables[name] = Table(columns, {}, list(constraints))
        rows = df.select(*(F.col(c).cast(k.spark).alias(c) for c, k in columns))
        rules.verify(name, rows, list(constraints), self.table_or(name, rows))
        self._publish({name: (None, Version(1, schema(columns), (self.store.write(rows),)))})
        self._saved()

    def _value(self, table: Table, column: str, kind: SqlType, text: str):
        if text.lower() == "default":
            text = table.defaults.get(column, "null")
        if m := re.fullmatch(r"(?i)nextval\s*\(\s*'([^']*)'\s*\)", text):
            return self.nextval(plain(m[1]))
        text = re.sub(r"::\s*\w+(\s*\([^)]*\))?$", "", text).strip()
        if text.lower() == "null":
            return None
        if text.startswith("'"):
            text = text[1:-1].replace("''", "'")
        return parse(text, kind)

    def _insert(self, name: str, columns: str | None, values: str, returning: str | None):
        table = self._need(name)
        self._allowed(name, "insert")
        kinds = dict(table.columns)
        given = [plain(c) for c in columns.split(",")] if columns else list(kinds)
        for c in given:
            if c not in kinds:
                raise EngineError(f"column {c} of {name} does not exist", "42703")
        cells = [["default"] * len(given)] if values.lower().startswith("default") else [split_top(r.strip()[1:-1]) for r in split_top(values[len("values") :])]
        rows = []
        for cell in cells:
            if len(cell) > len(given):
                raise EngineError("INSERT has more values than columns", "42601")
            row = dict(zip(given, cell, strict=False))
            rows.append(tuple(self._value(table, c, k, row.get(c, "default")) for c, k in table.columns))
        new = self.spark.createDataFrame(rows, schema(table.columns))
        self._put(name, new, append=True)
        return self._returned(new, returning) or f"INSERT 0 {len(rows)}"

    def _returned(self, df: DataFrame, returning: str | None) -> DataFrame | None:
        return df.selectExpr(*split_top(returning)) if returning else None

    def _condition(self, text: str) -> str:
        return dialect.to_spark(text)

    def _touched(self, rows: DataFrame, hit: Column, base: Version) -> tuple[DataFrame, tuple[str, ...]]:
        """The rows of the files that hold a hit, and all other files of the version; a path a touched file reaches the driver."""
        tail = lambda path: tuple(path.split("/")[-2:])
        hits = {tail(r[0]) for r in rows.filter(hit).select(F.input_file_name()).distinct().collect()}
        files = self.store.files(base)
        return self.store.read(replace(base, folders=tuple(f for f in files if tail(f) in hits)), self.spark), tuple(f for f in files if tail(f) not in hits)

    def _update(self, name: str, sets: str, where: str, returning: str | None):
        table = self._need(name)
        self._allowed(name, "update")
        base = self.version(name)
        kinds, rows, hit = dict(table.columns), self.store.read(base, self.spark), F.coalesce(F.expr(self._condition(where)), F.lit(False))
        new = {}
        for item in split_top(sets):
            column, _, value = item.partition("=")
            column, value = plain(column), value.strip()
            if column not in kinds:
                raise EngineError(f"column {column} of {name} does not exist", "42703")
            value = table.defaults.get(column, "NULL") if value.lower() == "default" else value
            new[column] = F.when(hit, F.expr(dialect.to_spark(value)).cast(kinds[column].spark)).otherwise(F.col(column)).alias(column)
        part, kept = self._touched(rows, hit, base)
        self._put(name, part.select(*(new.get(c, F.col(c)) for c, _ in table.columns)), base=base, kept=kept)
        changed = rows.filter(hit).select(*(new.get(c, F.col(c)) for c, _ in table.columns))
        return self._returned(changed, returning) or "UPDATE"

    def _delete(self, name: str, where: str, returning: str | None):
        self._need(name)
        self._allowed(name, "delete")
        base = self.version(name)
        rows, hit = self.store.read(base, self.spark), F.coalesce(F.expr(self._condition(where)), F.lit(False))
        part, kept = self._touched(rows, hit, base)
        self._put(name, part.filter(~hit), base=base, kept=kept)
        return self._returned(rows.filter(hit), returning) or "DELETE"

    def _truncate(self, name: str, restart: bool) -> str:
        self._need(name)
        self._put(name, None)
        for s, x in self.catalog.sequences.items():
            if restart and x.get("owner", ("",))[0] == name:
                self._restart(s, None)
        return "TRUNCATE TABLE"

    @staticmethod
    def _options(text: str) -> dict:
        out = {"fmt": "csv" if re.search(r"(?i)\bcsv\b", text) else "text", "header": bool(re.search(r"(?i)\bheader\b(?!\s+false)", text))}
        for key in ("delimiter", "quote", "escape", "null"):
            if m := re.search(rf"(?i)\b{key}\s+(?:as\s+)?'((?:[^']|'')*)'", text):
                out[key] = m[1].replace("''", "'")
        return out

    def _copy_in(self, name: str, columns: str | None, path: str, options: str) -> str:
        table = self._need(name)
        kinds = dict(table.columns)
        given = [plain(c) for c in columns.split(",")] if columns else list(kinds)
        new = copy_io.copy_from(self.spark, path, [(c, kinds[c]) for c in given], **self._options(options))
        for c, k in table.columns:
            if c not in given:
                value = table.defaults.get(c, "null")
                m = re.fullmatch(r"(?i)nextval\s*\(\s*'([^']*)'\s*\)", value)
                new = self._numbered(new, c, plain(m[1]), k) if m else new.withColumn(c, F.lit(self._value(table, c, k, value)).cast(k.spark))
        self._put(name, new.select(*kinds), append=True)
        return "COPY"

    def _numbered(self, df: DataFrame, column: str, sequence: str, kind: SqlType) -> DataFrame:
        """df with as many of the sequence's next values as it has rows; one count a partition reaches the driver."""
        staged = self.store.read(Version(0, df.schema, (self.store.write(df),)), self.spark)
        sizes = dict(staged.groupBy(F.spark_partition_id().alias("p")).count().collect())
        first = self.nextval(sequence, sum(sizes.values())) if sizes else 0
        begins = dict(zip(sorted(sizes), itertools.accumulate([first, *(sizes[p] for p in sorted(sizes))])))
        begin = F.create_map(*(F.lit(x) for p, n in begins.items() for x in (p, n)))[F.spark_partition_id()] if begins else F.lit(0)
        return staged.withColumn(column, (begin + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).cast(kind.spark))

    def _copy_out(self, name: str, columns: str | None, path: str, options: str) -> str:
        df = self.table(name) if name in self.catalog.tables or name in self.catalog.matviews else self._select(f"SELECT * FROM {name}")
        opts = {k: v for k, v in self._options(options).items() if k in ("fmt", "header", "delimiter", "null")}
        copy_io.copy_to(df.select(*(plain(c) for c in columns.split(","))) if columns else df, path, **opts)
        return "COPY"

    # prepared statements and cursors

    def _execute(self, name: str, args: str | None):
        if name not in self.prepared:
            raise EngineError(f"prepared statement {name} does not exist", "26000")
        values = split_top(args) if args else []

        def value(m: re.Match) -> str:
            if int(m[1]) > len(values):
                raise DataError(f"there is no parameter ${m[1]}", "42P02")
            return values[int(m[1]) - 1]

        return self.sql(re.sub(r"\$(\d+)", value, self.prepared[name]))

    def _fetch(self, verb: str, how: str, name: str):
        if name not in self.cursors:
            raise EngineError(f"cursor {name} does not exist", "34000")
        df, at = self.cursors[name]
        n = None if how.endswith("all") else int(m[0]) if (m := re.search(r"\d+", how)) else 1
        self.cursors[name][1] = 1 << 30 if n is None else at + n
        if verb == "move":
            return "MOVE"
        page = df.offset(at)
        return page if n is None else page.limit(n)
