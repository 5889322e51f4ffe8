"""Translates the SQLite-flavoured dialect to Spark SQL text.

A statement is parsed once by recursive descent. Expressions come out as
Spark SQL with a kind (int, real, text, blob, bool, null or unknown ''),
which decides integer division, text formatting and comparisons between
classes. Catalyst does everything else.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from brindle.errors import ParseError
from brindle.functions import dialect_functions as fn
from brindle.functions.dialect_functions import Expr

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?(?:\*/|\Z)|(?P<blob>[xX]'[0-9a-fA-F]*')|(?P<str>'(?:[^']|'')*')|(?P<id>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])"""
    r"""|(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<param>\?\d*)|(?P<word>[^\W\d]\w*)|(?P<op>\|\||<<|>>|<>|!=|<=|>=|==|[-+*/%&|~<>=(),.;])""",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "op" else ""


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


def statements(sql: str) -> list[str]:
    """Splits at semicolons outside literals, comments and trigger bodies."""
    out, start, depth = [], 0, 0
    trigger = False
    words: list[str] = []
    for t in tokenize(sql):
        if t.kind == "word":
            words.append(t.upper)
            if t.upper == "TRIGGER" and words[0] == "CREATE":
                trigger = True
            depth += trigger and t.upper in ("BEGIN", "CASE")
            depth -= trigger and t.upper == "END"
        elif t.text == ";" and depth <= 0:
            out.append(sql[start : t.at].strip())
            start, depth, trigger, words = t.at + 1, 0, False, []
    out.append(sql[start:].strip())
    return [s for s in out if tokenize(s)]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A Python value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value)) + "L"
    if isinstance(value, int):
        return f"{value}L" if -(2**63) < value < 2**63 else str(value)
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, bytes | bytearray):
        return f"X'{bytes(value).hex()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


STOP = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT ON JOIN INNER LEFT RIGHT FULL CROSS OUTER NATURAL USING AS AND OR NOT THEN ELSE END WHEN RETURNING SET VALUES ASC DESC NULLS IS IN LIKE BETWEEN MATCH COLLATE BEGIN WINDOW".split())
RESERVED = frozenset("SELECT FROM WHERE GROUP HAVING ORDER LIMIT UNION INTERSECT EXCEPT JOIN ON AND OR NOT THEN ELSE WHEN VALUES SET IN IS BETWEEN".split())
AGGREGATES = frozenset("COUNT SUM AVG MIN MAX GROUP_CONCAT TOTAL".split())


@dataclass
class Source:
    alias: str
    columns: list[tuple[str, str]] | None  # (name, kind); None if unknown
    base: bool = False  # a managed table, with _rowid
    table: str = ""
    relation: str = ""  # how the table stands in the SQL text; no two sources share it
    queries: list[str] = field(default_factory=list)  # of full-text matches, as literals
    marks: list[str] = field(default_factory=list)  # highlight(...) and snippet(...), by their arguments


@dataclass
class Catalog:
    """What the translator asks about names."""

    columns: Callable[[str], list[tuple[str, str]] | None]
    relation: Callable[[str], str]
    #: (table, matches, marks) -> a relation that also has rank, __hit0 ... and __mark0 ...
    full_text: Callable[[str, list[str], list[str]], str] | None = None
    collations: Callable[[str], dict[str, str]] = lambda name: {}
    managed: Callable[[str], bool] = lambda name: True  # tables whose rows have a _rowid
    #: (name, columns, WITH clause, anchor, step, placeholder) -> the relation of a recursion that drops rows found before
    recursion: Callable[..., str] | None = None


@dataclass
class Scope:
    sources: list[Source] = field(default_factory=list)


class Translator:
    def __init__(self, sql: str, catalog: Catalog, params: list | tuple = ()):
        self.sql, self.catalog, self.params = sql, catalog, list(params)
        self.tokens, self.at, self.next_param = tokenize(sql), 0, 0
        self.ctes: dict[str, list[tuple[str, str]] | None] = {}
        self.scopes: list[Scope] = []
        self.aggregated = False
        self.kinds = self._kinds()
        self.collations = {k.lower(): v for t in self.tokens if t.kind in ("word", "id") for k, v in catalog.collations(self._name(t)).items()}
        self.full_text: list[Source] = []
        self.depth = 0

    def _kinds(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for t in self.tokens:
            if t.kind in ("word", "id"):
                for name, kind in self.catalog.columns(self._name(t)) or ():
                    key = name.lower()
                    out[key] = kind if out.get(key, kind) == kind else ""
        return out

    # tokens
    def _name(self, t: Token) -> str:
        if t.kind == "id":
            q = t.text[0]
            return t.text[1:-1].replace(q * 2, q) if q != "[" else t.text[1:-1]
        return t.text

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].upper if i < len(self.tokens) else ""

    def done(self) -> bool:
        return self.at >= len(self.tokens)

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            got = self.tokens[self.at].text if not self.done() else "end of statement"
            raise ParseError(f"expected {' '.join(words)}, found {got}")

    def name(self) -> str:
        if self.done() or self.tokens[self.at].kind not in ("word", "id"):
            raise ParseError(f"expected a name, found {self.tokens[self.at].text if not self.done() else 'end of statement'}")
        t = self.tokens[self.at]
        if t.upper in RESERVED:
            raise ParseError(f"expected a name, found {t.text}")
        self.at += 1
        return self._name(t)

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    # expressions, loosest first
    def expr(self) -> Expr:
        return self._or()

    def condition(self) -> str:
        return fn.truth(self.expr())

    def _or(self) -> Expr:
        x = self._and()
        while self.take("OR"):
            x = Expr(f"({fn.truth(x)} OR {fn.truth(self._and())})", "bool")
        return x

    def _and(self) -> Expr:
        x = self._not()
        while self.take("AND"):
            x = Expr(f"({fn.truth(x)} AND {fn.truth(self._not())})", "bool")
        return x

    def _not(self) -> Expr:
        if self.take("NOT"):
            return Expr(f"(NOT {fn.truth(self._not())})", "bool")
        return self._compare()

    def _compare(self) -> Expr:
        x = self._bits("|")
        while True:
            op = self.peek()
            if op in ("=", "==", "<>", "!=", "<", ">", "<=", ">="):
                self.at += 1
                x = fn.compare({"==": "=", "!=": "<>"}.get(op, op), x, self._bits("|"))
            elif op == "IS":
                self.at += 1
                negative = self.take("NOT")
                if self.take("NULL"):
                    x = Expr(f"({x.sql} IS {'NOT ' * negative}NULL)", "bool")
                else:
                    y = self._bits("|")
                    x = Expr(f"({'NOT ' * negative}({fn.value(x)} <=> {fn.value(y)}))", "bool")
            elif op == "MATCH":
                self.at += 1
                x = self._match(x, self._bits("|"))
            elif op in ("BETWEEN", "IN", "LIKE") or op == "NOT" and self.peek(1) in ("BETWEEN", "IN", "LIKE"):
                negative = self.take("NOT")
                word = self.peek()
                self.at += 1
                x = {"BETWEEN": self._between, "IN": self._in, "LIKE": self._like}[word](x, "NOT " * negative)
            else:
                return x

    def _full_text_source(self, name: str) -> Source:
        """The full-text table that is meant by an alias, a table or a column."""
        first, _, column = name.replace("`.`", "\0").strip("`").partition("\0")
        for scope in reversed(self.scopes):
            for s in scope.sources:
                named = first.lower() in (s.alias.lower(), s.table.lower())
                if s.columns and any(n == "rank" for n, _ in s.columns) and (named or not column and any(n.lower() == first.lower() for n, _ in s.columns)):
                    if s not in self.full_text:
                        self.full_text.append(s)
                    return s
        raise ParseError(f"{first} is not a full-text table")

    def _match(self, x: Expr, wanted: Expr) -> Expr:
        if not re.fullmatch(r"'(?:[^'\\]|\\.)*'", wanted.sql, re.S):
            raise ParseError("MATCH takes a literal")
        s = self._full_text_source(x.sql)
        s.queries.append(wanted.sql)
        return Expr(f"{quote(s.alias)}.`__hit{len(s.queries) - 1}`", "bool")

    def _marked(self, name: str, args: list[Expr]) -> Expr:
        """bm25, highlight and snippet: columns that the table's relation gets once its MATCH is known."""
        s = self._full_text_source(args[0].sql) if args else None
        if s is None or any(not re.fullmatch(r"'(?:[^'\\]|\\.)*'|-?\d+L", a.sql, re.S) for a in args[1:]):
            raise ParseError(f"{name} takes a full-text table and literals")
        if name == "BM25":
            return Expr(f"{quote(s.alias)}.`rank`", "real")
        s.marks.append(", ".join([name.lower(), *(a.sql for a in args[1:])]))
        return Expr(f"{quote(s.alias)}.`__mark{len(s.marks) - 1}`", "text")

    def resolved(self, sql: str) -> str:
        """sql with the relations of full-text tables that its matches and marks need."""
        for s in self.full_text:
            sql = sql.replace(s.relation, self.catalog.full_text(s.table, s.queries, s.marks))
        self.full_text = []
        return sql

    def _between(self, x: Expr, negative: str) -> Expr:
        low = self._bits("|")
        self.need("AND")
        both = f"({fn.compare('>=', x, low).sql} AND {fn.compare('<=', x, self._bits('|')).sql})"
        return Expr(f"({negative}{both})", "bool")

    def _in(self, x: Expr, negative: str) -> Expr:
        self.need("(")
        if self.peek() in ("SELECT", "WITH"):
            inner = self.query()
            self.need(")")
            return Expr(f"({fn.value(x)} {negative}IN ({inner}))", "bool")
        if self.take(")"):
            return Expr("true" if negative else "false", "bool")
        options = [self.expr()]
        while self.take(","):
            options.append(self.expr())
        self.need(")")
        fits = [fn.value(o) for o in options if not fn.classes_differ(x, o)]
        if not fits:
            return Expr(f"if({x.sql} IS NULL, NULL, {'true' if negative else 'false'})", "bool")
        return Expr(f"({fn.collated(x)} {negative}IN ({', '.join(fits)}))", "bool")

    def _like(self, x: Expr, negative: str) -> Expr:
        return Expr(f"({negative}({fn.text(x)} ILIKE replace({fn.text(self._bits('|'))}, '\\\\', '\\\\\\\\')))", "bool")

    _LEVELS = {"|": ("|",), "&": ("&", "<<", ">>"), "||": ("||",), "+": ("+", "-"), "*": ("*", "/", "%")}
    _TIGHTER = {"|": "&", "&": "||", "||": "+", "+": "*", "*": None}

    def _bits(self, level: str) -> Expr:
        tighter = self._TIGHTER[level]
        below = (lambda: self._bits(tighter)) if tighter else self._unary
        x = below()
        while self.peek() in self._LEVELS[level]:
            op = self.peek()
            self.at += 1
            x = fn.binary(op, x, below())
        return x

    def _unary(self) -> Expr:
        if self.take("-"):
            x = self._unary()
            return Expr(f"(-{fn.number(x)})", x.kind if x.kind in ("int", "real") else "")
        if self.take("+"):
            return self._unary()
        if self.take("~"):
            return Expr(f"(~{fn.number(self._unary())})", "int")
        x = self._primary()
        while self.take("COLLATE"):
            x = fn.collate(x, self.name())
        return x

    def _primary(self) -> Expr:
        if self.done():
            raise ParseError("an expression ends too early")
        t = self.tokens[self.at]
        if t.kind in ("num", "str", "blob", "param"):
            self.at += 1
            return self._literal(t)
        if self.take("("):
            if self.peek() in ("SELECT", "WITH"):
                inner = self.query()
                self.need(")")
                return Expr(f"(SELECT * FROM ({inner}) LIMIT 1)", "")
            x = self.expr()
            self.need(")")
            return Expr(f"({x.sql})", x.kind)
        if t.kind == "word":
            up = t.upper
            if up in ("NULL", "TRUE", "FALSE") and self.peek(1) != "(":
                self.at += 1
                return Expr("NULL", "null") if up == "NULL" else Expr("1L" if up == "TRUE" else "0L", "int")
            if up == "CASE":
                return self._case()
            if up == "CAST" and self.peek(1) == "(":
                self.at += 2
                x = self.expr()
                self.need("AS")
                kind = self.type_name()
                self.need(")")
                return fn.cast(x, fn.affinity(kind))
            if up == "EXISTS" and self.peek(1) == "(":
                self.at += 2
                inner = self.query()
                self.need(")")
                return Expr(f"EXISTS ({inner})", "bool")
            if self.peek(1) == "(":
                return self._call()
        return self._column()

    def _literal(self, t: Token) -> Expr:
        if t.kind == "param":
            if t.text == "?":
                self.next_param += 1
            n = int(t.text[1:]) if t.text != "?" else self.next_param
            v = self.params[n - 1] if 0 < n <= len(self.params) else None
            return Expr(literal(v), fn.kind_of(v))
        if t.kind == "num":
            if re.fullmatch(r"\d+", t.text):
                if int(t.text) >= 2**63:
                    raise ParseError(f"integer out of range: {t.text}")
                return Expr(f"{int(t.text)}L", "int")
            return Expr(f"double('{float(t.text)!r}')", "real")
        if t.kind == "blob":
            return Expr(t.text, "blob")
        return Expr(literal(t.text[1:-1].replace("''", "'")), "text")

    def _case(self) -> Expr:
        self.need("CASE")
        subject = None if self.peek() == "WHEN" else self.expr()
        arms, kinds = [], []
        while self.take("WHEN"):
            test = self.expr()
            self.need("THEN")
            then = self.expr()
            arms.append(f"WHEN {fn.compare('=', subject, test).sql if subject else fn.truth(test)} THEN {fn.value(then)}")
            kinds.append(then.kind)
        other = ""
        if self.take("ELSE"):
            x = self.expr()
            other = f" ELSE {fn.value(x)}"
            kinds.append(x.kind)
        self.need("END")
        return Expr(f"CASE {' '.join(arms)}{other} END", fn.common(kinds))

    def _column(self) -> Expr:
        first = self.name()
        if self.peek() == "." and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].kind in ("word", "id"):
            self.at += 1
            column = self.name()
            return Expr(f"{quote(first)}.{quote(self._hidden(column))}", self._kind_in(first, column), self.collations.get(column.lower(), ""))
        return Expr(quote(self._hidden(first)), "int" if first.lower() == "rowid" else self.kinds.get(first.lower(), ""), self.collations.get(first.lower(), ""))

    def _hidden(self, column: str) -> str:
        return "_rowid" if column.lower() in ("rowid", "_rowid_", "oid") and column.lower() not in self.kinds else column

    def _kind_in(self, alias: str, column: str) -> str:
        for scope in reversed(self.scopes):
            for s in scope.sources:
                if s.alias.lower() == alias.lower() and s.columns:
                    return next((k for n, k in s.columns if n.lower() == column.lower()), "")
        return self.kinds.get(column.lower(), "")

    def rowid_order(self) -> str:
        """The row order of the statement's first managed table, where one is known."""
        for s in self.scopes[-1].sources if self.scopes else ():
            if s.base:
                return f"{quote(s.alias)}.`_rowid`"
        return ""

    def _call(self) -> Expr:
        name = self.name().upper()
        self.need("(")
        distinct = self.take("DISTINCT")
        args: list[Expr] = []
        star = self.take("*")
        if not star and self.peek() != ")":
            args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
        self.need(")")
        if self.peek() == "OVER":
            self.at += 1
            return self._over(name, args, star)
        if name in ("HIGHLIGHT", "SNIPPET", "BM25"):
            return self._marked(name, args)
        if name in AGGREGATES and (star or len(args) <= (2 if name == "GROUP_CONCAT" else 1)):
            self.aggregated = True
            return fn.aggregate(name, args, star, distinct, self.rowid_order())
        return fn.scalar(name, args)

    def _over(self, name: str, args: list[Expr], star: bool) -> Expr:
        self.need("(")
        partition, order, frame = "", "", ""
        if self.take("PARTITION", "BY"):
            parts = [fn.value(self.expr())]
            while self.take(","):
                parts.append(fn.value(self.expr()))
            partition = "PARTITION BY " + ", ".join(parts)
        if self.take("ORDER", "BY"):
            order = self._order_items()
        if self.peek() in ("ROWS", "RANGE"):
            start = self.at
            while self.peek() != ")":
                self.at += 1
            frame = " ".join(t.text for t in self.tokens[start : self.at])
            if "BETWEEN" not in frame.upper():
                frame = f"{self.tokens[start].text} BETWEEN {' '.join(t.text for t in self.tokens[start + 1 : self.at])} AND CURRENT ROW"
        self.need(")")
        return fn.window(name, args, star, partition, order, frame, self.rowid_order())

    def type_name(self) -> str:
        words = [self.name()]
        while not self.done() and self.tokens[self.at].kind == "word" and self.peek() not in STOP | {"PRIMARY", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "GENERATED", "COLLATE", "CONSTRAINT", "AUTOINCREMENT"}:
            words.append(self.name())
        if self.take("("):
            while not self.take(")"):
                self.at += 1
        return " ".join(words)

    # queries
    def query(self) -> str:
        """[WITH ...] SELECT ... [compound] [ORDER BY] [LIMIT]."""
        self.depth += 1
        out = self._query()
        self.depth -= 1
        return out if self.depth else self.resolved(out)

    def _query(self) -> str:
        head = ""
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            parts = []
            while True:
                name = self.name()
                columns = None
                if self.take("("):
                    columns = self.names()
                    self.need(")")
                self.need("AS", "(")
                self.ctes[name.lower()] = None
                if recursive and self._recurses_distinct(name):
                    parts.append(f"{quote(name)} AS (SELECT * FROM {self._recursion(name, columns, parts)})")
                    if not self.take(","):
                        break
                    continue
                body = self.query()
                self.need(")")
                shown = f"({', '.join(map(quote, columns))})" if columns else ""
                again = recursive and re.search(rf"\bFROM\b.*`{re.escape(name)}`", body, re.I | re.S)
                parts.append(f"{quote(name)}{shown}{' MAX RECURSION LEVEL 10000' if again else ''} AS ({body})")
                if not self.take(","):
                    break
            head = f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} "
        self.scopes.append(Scope())
        body = self._core()
        simple = True
        while self.peek() in ("UNION", "INTERSECT", "EXCEPT"):
            op = self.peek()
            self.at += 1
            op += " ALL" if self.take("ALL") else ""
            self.scopes[-1] = Scope()
            right = self._core()
            body = f"{body if simple else '(' + body + ')'} {op} {right}"
            simple = False
        tail = ""
        if self.take("ORDER", "BY"):
            tail += " ORDER BY " + self._order_items()
        tail += self._limit()
        self.scopes.pop()
        return f"{head}{body}{tail}"

    def _recurses_distinct(self, name: str) -> bool:
        """Whether the body ahead is anchor UNION step, and the step reads name."""
        depth, union = 0, None
        for i in range(self.at, len(self.tokens)):
            t = self.tokens[i]
            if t.text == "(":
                depth += 1
            elif t.text == ")":
                if not depth:
                    return False
                depth -= 1
            elif not depth and t.upper == "UNION":
                union = self.tokens[i + 1].upper != "ALL" if i + 1 < len(self.tokens) else None
            elif union and t.kind in ("word", "id") and self._name(t).lower() == name.lower() and self.tokens[i - 1].upper in ("FROM", "JOIN", ","):
                return True
        return False

    def _recursion(self, name: str, columns: list[str] | None, parts: list[str]) -> str:
        if not self.catalog.recursion:
            raise ParseError("recursion over UNION needs a database")
        bodies = []
        for k in range(2):
            if k:
                self.need("UNION")
            self.scopes.append(Scope())
            bodies.append(self._core())
            self.scopes.pop()
        self.need(")")
        before = f"WITH {'RECURSIVE ' * any('MAX RECURSION' in p for p in parts)}{', '.join(parts)} " if parts else ""
        return self.catalog.recursion(name, columns, *(self.resolved(before + b) for b in bodies))

    def _order_items(self) -> str:
        out = []
        while True:
            x = self.expr()
            ordinal = re.fullmatch(r"(\d+)L", x.sql)
            item = ordinal[1] if ordinal else fn.collated(x)
            descending = self.take("DESC") or (self.take("ASC") and False)
            nulls = " NULLS LAST" if descending else " NULLS FIRST"
            if self.take("NULLS"):
                nulls = f" NULLS {self.name().upper()}"
            out.append(f"{item} {'DESC' if descending else 'ASC'}{nulls}")
            if not self.take(","):
                return ", ".join(out)

    def _limit(self) -> str:
        limit = offset = None
        if self.take("LIMIT"):
            limit = self._constant()
            if self.take(","):
                offset, limit = limit, self._constant()
        if self.take("OFFSET"):
            offset = self._constant()
        return (f" LIMIT {limit}" if limit is not None and limit >= 0 else "") + (f" OFFSET {offset}" if offset and offset > 0 else "")

    def _constant(self) -> int:
        x = self.expr().sql.replace("L", "").strip("()")
        if not re.fullmatch(r"-?\d+", x.replace("(", "").replace(")", "")):
            raise ParseError("LIMIT and OFFSET take integer constants")
        return int(x.replace("(", "").replace(")", ""))

    def _core(self) -> str:
        if self.take("VALUES"):
            rows = []
            while True:
                self.need("(")
                row = [fn.value(self.expr())]
                while self.take(","):
                    row.append(fn.value(self.expr()))
                self.need(")")
                rows.append(f"({', '.join(row)})")
                if not self.take(","):
                    return f"SELECT * FROM VALUES {', '.join(rows)}"
        self.need("SELECT")
        distinct = "DISTINCT " if self.take("DISTINCT") else ""
        self.take("ALL")
        items_at = self.at
        self._skip_to_from()
        source = ""
        if self.take("FROM"):
            source = " FROM " + self._from()
        after = self.at
        self.at = items_at
        outer, self.aggregated = self.aggregated, False
        items = self._items()
        self.at = after
        where = f" WHERE {self.condition()}" if self.take("WHERE") else ""
        group, keys = "", []
        if self.take("GROUP", "BY"):
            keys = [self._group_key(items)]
            while self.take(","):
                keys.append(self._group_key(items))
            group = f" GROUP BY {', '.join(keys)}"
        having = f" HAVING {self.condition()}" if self.take("HAVING") else ""
        if group or self.aggregated:
            items = [(self._representative(sql, keys) if plain else sql, alias, plain) for sql, alias, plain in items]
        self.aggregated = outer
        shown = ", ".join(f"{sql} AS {quote(alias)}" if alias else sql for sql, alias, _ in items)
        return f"SELECT {distinct}{shown}{source}{where}{group}{having}"

    def _group_key(self, items) -> str:
        x = self.expr()
        if (m := re.fullmatch(r"(\d+)L", x.sql)) and int(m[1]) <= len(items):
            return items[int(m[1]) - 1][0]
        if m := re.fullmatch(r"`([^`]+)`", x.sql):  # an alias, where no column has the name
            known = {n.lower() for s in self.scopes[-1].sources for n, _ in s.columns or ()}
            for sql, alias, _ in items:
                if alias and alias.lower() == m[1].lower() not in known and all(s.columns for s in self.scopes[-1].sources):
                    return sql
        return fn.collated(x)

    def _representative(self, sql: str, keys: list[str]) -> str:
        """A bare column of a grouped query takes the value of the group's first row."""
        order = self.rowid_order()
        if not order or sql in keys or sql.rpartition(".")[2] in {k.rpartition(".")[2] for k in keys}:
            return sql
        return f"min_by({sql}, {order})"

    def _skip_to_from(self) -> None:
        depth = 0
        while not self.done():
            up = self.peek()
            if up == "(":
                depth += 1
            elif up == ")":
                if depth == 0:
                    return
                depth -= 1
            elif depth == 0 and up in ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT"):
                return
            self.at += 1

    def _items(self) -> list[tuple[str, str | None, bool]]:
        out: list[tuple[str, str | None, bool]] = []
        while True:
            if self.take("*"):
                for s in self.scopes[-1].sources:
                    out += self._star(s)
            elif self.peek(1) == "." and self.peek(2) == "*":
                alias = self.name()
                self.at += 2
                for s in self.scopes[-1].sources:
                    if s.alias.lower() == alias.lower():
                        out += self._star(s)
            else:
                start = self.at
                x = self.expr()
                plain = bool(re.fullmatch(r"(`[^`]+`\.)?`[^`]+`", x.sql))
                text = self.sql[self.tokens[start].at : self.tokens[self.at - 1].at + len(self.tokens[self.at - 1].text)]
                alias = x.sql.rpartition("`.")[2].strip("`") if plain else text
                if plain and alias == "_rowid":
                    alias = "rowid"
                if self.take("AS") or not self.done() and (self.tokens[self.at].kind == "id" or self.tokens[self.at].kind == "word" and self.peek() not in STOP):
                    alias = self.name()
                out.append((fn.value(x), alias, plain))
            if not self.take(","):
                return out

    def _star(self, s: Source) -> list[tuple[str, str | None, bool]]:
        if s.columns is None:
            return [(f"{quote(s.alias)}.*", None, False)]
        return [(f"{quote(s.alias)}.{quote(n)}", n, True) for n, _ in s.columns]

    def _from(self) -> str:
        out = self._source()
        while True:
            if self.take(","):
                out += f" CROSS JOIN {self._source()}"
                continue
            kind = None
            start = self.at
            natural = "NATURAL " if self.take("NATURAL") else ""
            for words, spark in ((("INNER",), "INNER"), (("CROSS",), "CROSS"), (("LEFT", "OUTER"), "LEFT"), (("LEFT",), "LEFT"), (("RIGHT", "OUTER"), "RIGHT"), (("RIGHT",), "RIGHT"), (("FULL", "OUTER"), "FULL"), (("FULL",), "FULL")):
                if self.take(*words):
                    kind = spark
                    break
            if not self.take("JOIN"):
                self.at = start
                return out
            out += f" {natural}{kind or 'INNER'} JOIN {self._source()}"
            if self.take("ON"):
                out += f" ON {self.condition()}"
            elif self.take("USING", "("):
                out += f" USING ({', '.join(map(quote, self.names()))})"
                self.need(")")

    def _source(self) -> str:
        if self.take("("):
            if self.peek() in ("SELECT", "WITH", "VALUES"):
                inner = self.query()
                self.need(")")
                alias = self._alias() or f"sub{self.at}"
                self.scopes[-1].sources.append(Source(alias, None))
                return f"({inner}) AS {quote(alias)}"
            inner = self._from()
            self.need(")")
            return f"({inner})"
        name = self.name()
        if self.take("("):
            wanted = self.expr()
            self.need(")")
            alias = self._alias() or name
            if not self.catalog.full_text:
                raise ParseError(f"{name} is not a table function")
            relation = self.catalog.relation(name)
            self.scopes[-1].sources.append(Source(alias, self.catalog.columns(name), base=True, table=name, relation=relation))
            self._match(Expr(quote(alias), ""), wanted)
            return f"(SELECT * FROM {relation} WHERE `__hit0`) AS {quote(alias)}"
        alias = self._alias() or name
        if name.lower() in self.ctes:
            self.scopes[-1].sources.append(Source(alias, None))
            return f"{quote(name)} AS {quote(alias)}"
        columns = self.catalog.columns(name)
        relation = self.catalog.relation(name)
        self.scopes[-1].sources.append(Source(alias, columns, base=self.catalog.managed(name), table=name, relation=relation))
        return f"{relation} AS {quote(alias)}"

    def _alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        if not self.done() and (self.tokens[self.at].kind == "id" or self.tokens[self.at].kind == "word" and self.peek() not in STOP):
            return self.name()
        return None


def to_spark(sql: str, catalog: Catalog, params: list | tuple = ()) -> str:
    """One SELECT, WITH or VALUES statement as Spark SQL."""
    t = Translator(sql, catalog, params)
    out = t.query()
    t.take(";")
    if not t.done():
        raise ParseError(f"unexpected {t.tokens[t.at].text}")
    return out
