"""Engine: the SQL surface.  A dialect pass handles what Spark's parser or defaults don't, then spark.sql runs it.

The pass (a) rewrites quantified comparisons with subqueries, wherever they stand, (b) gives ORDER BY items
without NULLS FIRST/LAST the engine's null order (NULL is the greatest value), (c) turns date_diff's unit into a word,
(d) puts what a correlated subquery with a LIMIT orders by into its columns, where Spark keeps the order.
Statements that change
tables or settings (CREATE TABLE, INSERT, COPY, DROP TABLE, SET persist) go to plans/statements.py.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..catalog import TABLES, register_views
from ..sources import io

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?|<>|!=|<=|>=|\|\||::|.", re.S)
_COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}
#: Words that can't end an operand.
_STOPS = {"and", "or", "not", "where", "on", "having", "when", "then", "else", "select", "in", "between", "like", "is", "by", "case", "distinct"}


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _solid(t: str) -> bool:
    return not (t.isspace() or t.startswith(("--", "/*")))


def _next(ts: list[str], k: int) -> int:
    while k < len(ts) and not _solid(ts[k]):
        k += 1
    return k


def _before(ts: list[str], k: int) -> int:
    while k >= 0 and not _solid(ts[k]):
        k -= 1
    return k


def _closing(ts: list[str], k: int) -> int:
    depth = 0
    for j in range(k, len(ts)):
        depth += (ts[j] == "(") - (ts[j] == ")")
        if not depth:
            return j
    raise ValueError("a parenthesis is open")


def _opening(ts: list[str], k: int) -> int:
    depth = 0
    for j in range(k, -1, -1):
        depth += (ts[j] == ")") - (ts[j] == "(")
        if not depth:
            return j
    raise ValueError("a parenthesis is closed twice")


def _ends_operand(t: str) -> bool:
    return bool(re.match(r"[\w'\"`)]", t[-1])) and t.lower() not in _STOPS


def _operand_start(ts: list[str], end: int) -> int:
    """Where the operand that ends at `end` starts: a name path, literal, call or parenthesised expression, with arithmetic before it."""
    k = end
    while True:
        if ts[k] == ")":
            k = _opening(ts, k)
            p = _before(ts, k - 1)
            if p >= 0 and re.match(r"[A-Za-z_]\w*$", ts[p]) and ts[p].lower() not in _STOPS:
                k = p
        elif ts[k].lower() == "end":  # CASE ... END
            depth = 0
            while k >= 0:
                depth += (ts[k].lower() == "end") - (ts[k].lower() == "case")
                if not depth:
                    break
                k -= 1
        p = _before(ts, k - 1)
        if p >= 0 and ts[p] in {".", "::"}:
            k = _before(ts, p - 1)
            continue
        if p >= 0 and ts[p] in {"+", "-", "*", "/", "%", "||"}:
            q = _before(ts, p - 1)
            if q >= 0 and _ends_operand(ts[q]):
                k = q
                continue
            if ts[p] in "+-":  # a sign
                return p
        return k


def _is_conjunct(ts: list[str], start: int, close: int) -> bool:
    """Whether ts[start..close] is one of the ANDed conditions of a WHERE, where FALSE and NULL are alike (in doubt: no)."""
    breaks = {"or", "not", "case", "when", "then", "else", "end", "between", "select", "on"}
    depth, k = 0, start - 1
    while k >= 0:
        depth += (ts[k] == ")") - (ts[k] == "(")
        if depth < 0 or (not depth and ts[k].lower() in breaks):
            return False
        if not depth and ts[k].lower() == "where":
            break
        k -= 1
    if k < 0:
        return False
    ends, after = {"group", "having", "order", "limit", "union", "intersect", "except", "window", ";", ")"}, _next(ts, close + 1)
    if after < len(ts) and ts[after].lower() not in ends | {"and"}:
        return False
    depth = 0
    for t in ts[close + 1 :]:
        depth += (t == "(") - (t == ")")
        if depth < 0 or (not depth and t.lower() in ends - {")"}):
            break
        if not depth and t.lower() in breaks:
            return False
    return True


def _quantified(left: str, op: str, body: str, all_: bool, alone: bool, conjunct: bool) -> str:
    """left op ANY|ALL (body) in three-valued logic, for any position; as a `conjunct`, a plain (anti) semi join will do.

    `left` moves into scopes whose only names are __q and __v, so it still means what it meant outside.  A
    body that stands `alone` (uncorrelated) is reduced to its least and greatest value and its counts where
    the comparison allows, each computed once; otherwise EXISTS asks for a deciding row, then for an unknown one.
    """
    op = "<>" if op == "!=" else op
    decided, default = ("FALSE", "TRUE") if all_ else ("TRUE", "FALSE")
    if alone and op != ("<>" if all_ else "="):
        fact = lambda f: f"(SELECT {f} FROM ({body}) AS __q(__v))"
        low, high, rows, known = fact("min(__v)"), fact("max(__v)"), fact("count(*)"), fact("count(__v)")
        if op in ("=", "<>"):  # = ALL fails, and <> ANY holds, if an end of the range differs
            test = f"(({left}) <> {low} OR ({left}) <> {high})"
        else:
            bound = high if (op[0] == ">") == all_ else low
            test = f"NOT (({left}) {op} {bound})" if all_ else f"({left}) {op} {bound}"
        return f"(CASE WHEN {test} THEN {decided} WHEN {rows} = 0 THEN {default} WHEN ({left}) IS NULL OR {known} < {rows} THEN NULL ELSE {default} END)"
    exists = lambda test: f"EXISTS (SELECT 1 FROM ({body}) AS __q(__v) WHERE {test})"
    inverse = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}[op]
    decide = f"({left}) {inverse if all_ else op} __q.__v"
    if conjunct:
        return f"(NOT {exists(f'({decide}) OR ({decide}) IS NULL')})" if all_ else f"({exists(decide)})"
    return f"(CASE WHEN {exists(decide)} THEN {decided} WHEN {exists(f'(({left}) {op} __q.__v) IS NULL')} THEN NULL ELSE {default} END)"


def _columns(body: list[str]) -> int:
    """How many columns a SELECT (without *) or VALUES body gives; 1 where that can't be seen."""
    k = _next(body, 0)
    if body[k].lower() != "select":
        return 1
    depth, n = 0, 1
    for t in body[k + 1 :]:
        depth += (t == "(") - (t == ")")
        if not depth and t.lower() in ("from", "union", "intersect", "except", "where"):
            break
        n += t == "," and not depth
    return n


def rewrite_quantified(sql: str, alone: Callable[[str], bool] = lambda body: False) -> str:
    """x op ANY|SOME|ALL (subquery) as CASE over EXISTS or over facts of the subquery; right in every position.

    alone(body) says whether a subquery can be analysed by itself.
    """
    ts = tokens(sql)
    k = len(ts) - 1
    while k >= 0:  # innermost (rightmost) first
        if ts[k].lower() in ("any", "some", "all"):
            o, p = _next(ts, k + 1), _before(ts, k - 1)
            if o < len(ts) and ts[o] == "(" and p >= 0 and ts[p] in _COMPARE and (s := _next(ts, o + 1)) < len(ts) and ts[s].lower() in ("select", "values", "with"):
                close, end = _closing(ts, o), _before(ts, p - 1)
                if _columns(ts[o + 1 : close]) != 1:
                    raise ValueError("a quantified subquery must give one column")
                start, body = _operand_start(ts, end), "".join(ts[o + 1 : close])
                new = _quantified("".join(ts[start : end + 1]).strip(), ts[p], body, ts[k].lower() == "all", alone(body), _is_conjunct(ts, start, close))
                ts[start : close + 1] = [new]
                ts = tokens("".join(ts))
                k = len(ts)
        k -= 1
    return "".join(ts)


def rewrite_functions(sql: str) -> str:
    """date_diff('unit', a, b), whose unit is a string here and a word in Spark."""
    ts = tokens(sql)
    for k, t in enumerate(ts):
        o = _next(ts, k + 1)
        if t.lower() == "date_diff" and o < len(ts) and ts[o] == "(" and (u := _next(ts, o + 1)) < len(ts) and re.fullmatch(r"'[A-Za-z]+'", ts[u]):
            ts[k], ts[u] = "timestampdiff", ts[u].strip("'").upper()
    return "".join(ts)


def _split(ts: list[str]) -> list[list[str]]:
    """The items between the outer commas."""
    items, depth = [[]], 0
    for t in ts:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            items.append([])
        else:
            items[-1].append(t)
    return items


def _order_in_columns(body: list[str]) -> str | None:
    """A limited SELECT whose ORDER BY names columns of its own only; None where it does already or has no order and limit."""
    at, depth = {}, 0
    for k, t in enumerate(body):
        depth += (t == "(") - (t == ")")
        if not depth and (w := t.lower()) in ("select", "distinct", "from", "union", "intersect", "except", "order", "limit", "offset"):
            at.setdefault(w, k)
    if not {"select", "from", "order", "limit"} <= at.keys() or {"distinct", "union", "intersect"} & at.keys() or at.get("except", at["from"]) > at["from"]:
        return None  # DISTINCT and set operations order by their columns anyway
    items = [[t for t in item if _solid(t)] for item in _split(body[at["select"] + 1 : at["from"]])]
    names = {x[-1].strip('`"').lower() for x in items if len(x) == 1 or x[-2] == "." or x[-2].lower() == "as" or _ends_operand(x[-2])}
    by, end = _next(body, at["order"] + 1), min(at["limit"], at.get("offset", len(body)))
    added, order = [], []
    for item in _split(body[by + 1 : end]):
        words = [t for t in item if _solid(t)]
        tail = len(words)
        if tail > 2 and words[-2].lower() == "nulls":
            tail -= 2
        if words[tail - 1].lower() in ("asc", "desc"):
            tail -= 1
        if tail > 1 or not (words[0].isdigit() or words[0].strip('`"').lower() in names):
            cut = [k for k, t in enumerate(item) if _solid(t)][tail - 1] + 1
            added.append(f"{''.join(item[:cut]).strip()} AS __order{len(added)}")
            item = [f" __order{len(added) - 1}", *item[cut:]]
        order.append("".join(item))
    if not added:
        return None
    start = "".join(body[: at["from"]]).rstrip() + ", " + ", ".join(added) + " "
    inner = start + "".join(body[at["from"] : by + 1]) + ",".join(order) + "".join(body[end:])
    return f"SELECT * EXCEPT ({', '.join(f'__order{k}' for k in range(len(added)))}) FROM ({inner})"


def rewrite_limited(sql: str, alone: Callable[[str], bool] = lambda body: False) -> str:
    """Correlated subqueries with ORDER BY and LIMIT order by columns of their own.

    Spark ranks the rows of each outer row by the order that stands right below the LIMIT; what isn't among the columns is projected
    away in between, and the ranks then follow the order in which rows happen to arrive.
    """
    ts = tokens(sql)
    k = len(ts) - 1
    while k >= 0:  # innermost (rightmost) first
        if ts[k] == "(" and (s := _next(ts, k + 1)) < len(ts) and ts[s].lower() == "select":
            close = _closing(ts, k)
            if (new := _order_in_columns(ts[s:close])) and not alone("".join(ts[s:close])):
                ts[k + 1 : close] = tokens(new)
        k -= 1
    return "".join(ts)


def set_null_order(sql: str) -> str:
    """ORDER BY items without a null order get NULLS LAST (ascending) or NULLS FIRST (descending)."""
    ts, out, k = tokens(sql), [], 0
    ends = {"limit", "offset", "rows", "range", "groups", "union", "intersect", "except"}
    while k < len(ts):
        out.append(ts[k])
        if ts[k].lower() == "order" and (b := _next(ts, k + 1)) < len(ts) and ts[b].lower() == "by":
            out += ts[k + 1 : b + 1]
            k, item, depth = b + 1, [], 0

            def close(item: list[str]) -> list[str]:
                words = [t.lower() for t in item if _solid(t)]
                if not words or "nulls" in words:
                    return item
                tail = len(item)
                while tail and not _solid(item[tail - 1]):
                    tail -= 1
                return [*item[:tail], " NULLS FIRST" if words[-1] == "desc" else " NULLS LAST", *item[tail:]]

            while k < len(ts):
                t = ts[k]
                if not depth and (t in (")", ";") or t.lower() in ends):
                    break
                depth += (t == "(") - (t == ")")
                if t == "," and not depth:
                    out += [*close(item), t]
                    item = []
                else:
                    item.append(t)
                k += 1
            out += close(item)
            continue
        k += 1
    return "".join(out)


#: Makes the parser write x BETWEEN a AND b as two comparisons.
_PLAIN_BETWEEN = "spark.sql.legacy.duplicateBetweenInput"


class Engine:
    """Facade: tables, SQL, imports.  `persist` decides whether create_table goes to the warehouse or a temp view.

    Tables of `sf_dir` become views when a statement first names them, so no other table's files are touched.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.spark, self.persist, self.sf_dir = spark, False, sf_dir
        self.known: set[str] = set()
        self.keys: dict[str, tuple[str, ...]] = {}

    def _name_tables(self, text: str) -> None:
        if self.sf_dir and (new := {t.strip('`"').lower() for t in tokens(text)}.intersection(TABLES) - self.known):
            register_views(self.spark, self.sf_dir, sorted(new))
            self.known |= new

    def _alone(self, body: str) -> bool:
        """Whether a subquery is complete without the query around it (analysed, not run)."""
        try:
            _ = self.spark.sql(body).schema
        except (AnalysisException, ParseException):
            return False
        return True

    def sql(self, text: str) -> DataFrame:
        """The rows of a query; a statement that changes tables or settings gives none."""
        text = text.strip().rstrip(";").strip()
        self._name_tables(text)
        if (done := statements.execute(self, text)) is not None:
            return done
        return self._planned(set_null_order(rewrite_limited(rewrite_quantified(rewrite_functions(text), self._alone), self._alone)))

    def _planned(self, text: str) -> DataFrame:
        """The query, with BETWEEN as two comparisons.

        Otherwise Spark computes a BETWEEN's left side in a projection over the comma-joined tables, which keeps it from ordering
        them by their conditions: tables that aren't linked directly then meet in a product.  A left side that
        isn't deterministic must be computed once, and keeps Spark's form.
        """
        if "between" not in {t.lower() for t in tokens(text)}:
            return self.spark.sql(text)
        before = self.spark.conf.get(_PLAIN_BETWEEN)
        self.spark.conf.set(_PLAIN_BETWEEN, "true")
        try:
            df = self.spark.sql(text)
        finally:
            self.spark.conf.set(_PLAIN_BETWEEN, before)
        return df if df._jdf.queryExecution().analyzed().deterministic() else self.spark.sql(text)

    def script(self, text: str) -> DataFrame | None:
        """Runs statements that end in semicolons; the last one's rows."""
        last = None
        for one in statements.split(text):
            last = self.sql(one)
        return last

    def add_table(self, name: str, table: pa.Table | DataFrame) -> None:
        df = io.from_arrow(self.spark, table) if isinstance(table, pa.Table) else table
        self.known.add(name.lower())
        if self.persist:
            df.write.mode("overwrite").saveAsTable(name)
        else:
            df.createOrReplaceTempView(name)

    def append_table(self, name: str, table: pa.Table | DataFrame, columns: list[str] | None = None) -> None:
        """Rows by position (of `columns`, if given; the others are NULL), cast to the table's types."""
        df = io.from_arrow(self.spark, table) if isinstance(table, pa.Table) else table
        now = self.spark.table(name)
        new = io.cast_to(df, now.schema, columns)
        if self.spark.catalog.getTable(name).isTemporary:
            now.unionByName(new).createOrReplaceTempView(name)
        else:
            new.write.insertInto(name)

    def create_table(self, name: str, schema: str, key: tuple[str, ...] = ()) -> None:
        """An empty table of the declared columns; the key is kept as information."""
        self.add_table(name, self.spark.createDataFrame([], schema))
        self.keys[name.lower()] = key

    def drop_table(self, name: str, missing_ok: bool = False) -> None:
        if not self.spark.catalog.dropTempView(name):
            self.spark.sql(f"DROP TABLE {'IF EXISTS ' if missing_ok else ''}{name}")
        self.keys.pop(name.lower(), None)

    def copy_csv(self, name: str, path: str, **options: str) -> None:
        """COPY name FROM path: appends with the table's declared types."""
        self.append_table(name, io.read_csv(self.spark, path, self.spark.table(name).schema, **options))

    def add_scalar(self, name: str, parameters: str, returns: str, expression: str) -> None:
        """A scalar function of one's own, as an SQL expression that Catalyst inlines: add_scalar("twice", "x int", "int", "2 * x")."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {expression}")


from . import statements  # noqa: E402  (it needs the tokens of this module)
