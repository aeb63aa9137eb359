"""An engine session: configuration, views, variables, host functions and privileges."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestra.functions.misc import Sequence, Settings
from lodestra.plans import names
from lodestra.plans import statements as st
from lodestra.plans.tables import Tables
from lodestra.sources import readers

CONF = {
    "spark.sql.ansi.enabled": "true",  # overflow, bad casts and division by zero are errors
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
}

#: Spark's error conditions as SQLSTATE codes.
SQLSTATES = {
    "DIVIDE_BY_ZERO": "22012",
    "ARITHMETIC_OVERFLOW": "22003",
    "CAST_OVERFLOW": "22003",
    "NUMERIC_VALUE_OUT_OF_RANGE": "22003",
    "CAST_INVALID_INPUT": "22P02",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000",
    "DUPLICATED_MAP_KEY": "22030",
    "TABLE_OR_VIEW_NOT_FOUND": "42P01",
    "UNRESOLVED_COLUMN": "42703",
    "PARSE_SYNTAX_ERROR": "42601",
    "GROUP_BY_AGGREGATE": "42803",
    "MISSING_AGGREGATION": "42803",
    "UNRESOLVED_ROUTINE": "42883",
}


def sqlstate(error: Exception) -> str | None:
    """The SQLSTATE of an error, from a code in brackets or from Spark's condition."""
    text = str(error)
    for code in re.findall(r"\[([0-9A-Z]{5})\]", text):
        return code
    return next((code for condition, code in SQLSTATES.items() if condition in text), None)


class Engine(Tables):
    """A session over one SparkSession. Statements see the views attached here."""

    def __init__(self, spark: SparkSession, conf: dict[str, str] | None = None, clock: Callable[[], datetime] | None = None):
        self.spark, self.clock = spark.newSession(), clock
        self.used: Sequence | None = None
        self._start()
        self.made: set[str] = set()
        for k, v in (CONF | (conf or {})).items():
            self.spark.conf.set(k, v)
        self.settings, self.sequences, self.types = Settings(), {}, {}
        self.granted: set[tuple[str, str]] | None = None

    def attach(self, folder: str, namespace: str = "") -> list[str]:
        return readers.attach(self.spark, folder, namespace)

    def create_sequence(self, name: str, start: int = 1, step: int = 1) -> Sequence:
        self.sequences[name] = Sequence(start, step)
        return self.sequences[name]

    def nextval(self, name: str) -> int:
        self.used = self.sequences[name]
        return self.used.nextval()

    def currval(self, name: str) -> int:
        return self.sequences[name].currval()

    def setval(self, name: str, value: int, called: bool = True) -> int:
        return self.sequences[name].setval(value, called)

    def lastval(self) -> int:
        """What the last nextval() of any sequence gave."""
        if self.used is None:
            raise ValueError("[55000] lastval is not yet defined in this session")
        return self.used.currval()

    def now(self) -> Column:
        """The session's clock, the seam for tests: fixed if the engine was given one."""
        return F.lit(self.clock()).cast("timestamp") if self.clock else F.current_timestamp()

    def create_type(self, name: str, fields: str) -> str:
        """A composite type, for use in schemas."""
        self.types[name] = f"struct<{fields}>"
        return self.types[name]

    def register(self, name: str, function: Callable, kind: str, volatile: bool = False) -> None:
        """A host scalar function over Arrow batches of pandas Series."""
        f = F.pandas_udf(function, kind)
        self.spark.udf.register(name, f.asNondeterministic() if volatile else f)

    def grant(self, privilege: str, table: str) -> None:
        self.granted = (self.granted or set()) | {(privilege.lower(), table.lower())}

    def revoke(self, privilege: str, table: str) -> None:
        self.granted = (self.granted or set()) - {(privilege.lower(), table.lower())}

    def _bound(self, args: list | dict | None) -> dict | list | None:
        return {f"p{i}": v for i, v in enumerate(args, 1)} if isinstance(args, list) and args else args

    def execute(self, text: str, args: list | None = None) -> DataFrame:
        """A statement: a query, or one that changes tables of the session (see statements). The latter gives the
        rows of RETURNING, or none. Parameters are $1, $2 and so on; they stand for values anywhere."""
        parts = st.rewritten(st.tokens(text))
        words = [t.lower() for t in parts if t != " "]
        names.make(self.spark, set(words), self.made)
        if args:
            literal = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
            if words[:1] != ["select"] and words[:1] != ["with"]:
                parts = [literal(args[int(t[2:]) - 1]) if re.fullmatch(r":p\d+", t) else t for t in parts]
        changes = {"insert": self._insert, "update": self._update, "delete": self._delete, "create": self._create, "drop": self._drop, "alter": self._alter}
        head = words[0] if words else ""
        if head in ("begin", "start"):
            return self._begin(" ".join(words))
        if head in ("commit", "rollback", "end", "abort"):
            return self._end(head in ("commit", "end"))
        if self.failed:
            raise ValueError("[25P02] current transaction is aborted, commands ignored until end of transaction block")
        try:
            if head in changes and self.reading:
                raise ValueError(f"[25006] cannot execute {head.upper()} in a read-only transaction")
            if head in ("insert", "update", "delete") and self.granted is not None:
                table = words[1 if head == "update" else 2]
                if (head, table) not in self.granted:
                    raise PermissionError(f"[42501] permission denied for table {table}")
            return changes[head](parts) if head in changes else self.sql("".join(parts), self._bound(args))
        except Exception:
            self.failed = self.saved is not None
            raise

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        """A query with bind parameters (? or :name). Reading a table needs the select privilege once any was granted."""
        df = self.spark.sql(text, args=args)
        if self.granted is not None:
            plan = df._jdf.queryExecution().analyzed().toString()
            for view in set(re.findall(r"SubqueryAlias ([\w.`]+)", plan)):
                name = view.strip("`").split(".")[-1].lower()
                if self.spark.catalog.tableExists(name) and ("select", name) not in self.granted:
                    raise PermissionError(f"[42501] permission denied for table {name}")
        return df

    def cursor(self, text: str, args: list | dict | None = None):
        """Rows pulled one partition at a time."""
        return self.sql(text, args).toLocalIterator()
