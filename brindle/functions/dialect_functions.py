"""Scalar, aggregate and window functions of the dialect as Spark SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from brindle.errors import ParseError


@dataclass(frozen=True)
class Expr:
    sql: str
    kind: str  # int, real, text, blob, bool, null, or '' if unknown
    collation: str = ""  # of a column that was declared with one


NUMBERS = ("int", "real", "bool")
SPARK_TYPES = {"int": "bigint", "real": "double", "text": "string", "blob": "binary", "": "string"}


def affinity(declared: str) -> str:
    """The kind of a declared type, by the substrings it contains."""
    up = declared.upper()
    if "INT" in up or "BOOL" in up:
        return "int"
    if any(x in up for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return "text"
    if "BLOB" in up:
        return "blob"
    if any(x in up for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "real"
    return "text"


def kind_of(value) -> str:
    return "null" if value is None else "int" if isinstance(value, int) else "real" if isinstance(value, float) else "blob" if isinstance(value, bytes) else "text"


def value(x: Expr) -> str:
    """x as it is stored or shown: truth values are the integers 1 and 0."""
    return f"cast({x.sql} AS bigint)" if x.kind == "bool" else x.sql


def truth(x: Expr) -> str:
    if x.kind == "bool":
        return x.sql
    if x.kind in ("text", "blob"):
        return f"({x.sql} IS NOT NULL)"
    return "cast(NULL AS boolean)" if x.kind == "null" else f"({x.sql} <> 0)"


def number(x: Expr) -> str:
    return "cast(NULL AS bigint)" if x.kind in ("text", "blob", "null") else value(x)


def text(x: Expr) -> str:
    """x as text; reals lose a trailing .0."""
    if x.kind == "text":
        return x.sql
    if x.kind == "real":
        return real_text(x.sql)
    return "cast(NULL AS string)" if x.kind in ("blob", "null") else f"cast({value(x)} AS string)"


def real_text(sql: str) -> str:
    """Shortest decimal text of a double without exponent; integral values without a point."""
    plain = f"if(abs({sql}) >= double('1e7') AND abs({sql}) < double('9e18') AND {sql} = floor({sql}), cast(cast({sql} AS bigint) AS string), if((abs({sql}) >= double('1e7') OR abs({sql}) < double('1e-3')) AND {sql} <> 0, cast(cast({sql} AS decimal(38, 18)) AS string), cast({sql} AS string)))"
    return f"regexp_replace(regexp_replace({plain}, '(\\\\.\\\\d*?)0+$', '$1'), '\\\\.$', '')"


def common(kinds: list[str]) -> str:
    seen = {("int" if k == "bool" else k) for k in kinds if k != "null"}
    return seen.pop() if len(seen) == 1 else "real" if seen <= {"int", "real"} and seen else ""


def _class(x: Expr) -> int | None:
    return {"int": 0, "real": 0, "bool": 0, "text": 1, "blob": 2}.get(x.kind)


def classes_differ(x: Expr, y: Expr) -> bool:
    a, b = _class(x), _class(y)
    return a is not None and b is not None and a != b


COLLATIONS = {"BINARY": "UTF8_BINARY", "NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM"}


def collated(x: Expr) -> str:
    """The value, under its column's own collation."""
    return f"({x.sql} COLLATE {COLLATIONS[x.collation]})" if x.collation else value(x)


def compare(op: str, x: Expr, y: Expr) -> Expr:
    if classes_differ(x, y):  # numbers < texts < blobs, whatever the values
        a, b = _class(x), _class(y)
        holds = {"=": False, "<>": True, "<": a < b, "<=": a < b, ">": a > b, ">=": a > b}[op]
        return Expr(f"if({x.sql} IS NULL OR {y.sql} IS NULL, NULL, {str(holds).lower()})", "bool")
    if x.collation:  # that of the left side counts
        return Expr(f"({collated(x)} {op} {value(y)})", "bool")
    return Expr(f"({value(x)} {op} {collated(y)})", "bool")


def binary(op: str, x: Expr, y: Expr) -> Expr:
    if op == "||":
        return Expr(f"concat({text(x)}, {text(y)})", "text")
    a, b = number(x), number(y)
    ints = {x.kind, y.kind} <= {"int", "bool"}
    kind = "int" if ints else "real" if "real" in (x.kind, y.kind) else ""
    if op == "/":
        return Expr(f"({a} div nullif({b}, 0L))", "int") if ints else Expr(f"try_divide({a}, {b})", "real")
    if op == "%":
        return Expr(f"try_mod({a}, {b})", kind)
    if op in ("<<", ">>"):
        return Expr(f"{'shiftleft' if op == '<<' else 'shiftright'}({a}, cast({b} AS int))", "int")
    return Expr(f"({a} {op} {b})", "int" if op in "&|" else kind)


def cast(x: Expr, kind: str) -> Expr:
    if kind == "int":
        return Expr(f"coalesce(try_cast({value(x)} AS bigint), cast(try_cast({value(x)} AS double) AS bigint))", "int")
    if kind == "text":
        return Expr(text(x), "text")
    return Expr(f"try_cast({value(x)} AS {SPARK_TYPES[kind]})", kind)


def collate(x: Expr, name: str) -> Expr:
    if name.upper() not in COLLATIONS:
        raise ParseError(f"no such collation: {name}")
    return Expr(f"({text(x)} COLLATE {COLLATIONS[name.upper()]})", x.kind)


def aggregate(name: str, args: list[Expr], star: bool, distinct: bool, order: str) -> Expr:
    if name == "COUNT":
        return Expr("count(1)" if star or not args else f"count({'DISTINCT ' * distinct}{value(args[0])})", "int")
    x, d = args[0], "DISTINCT " * distinct
    if name == "SUM":
        return Expr(f"sum({d}{value(x)})", x.kind if x.kind in ("int", "real") else "")
    if name == "AVG":
        return Expr(f"avg({d}cast({value(x)} AS double))", "real")
    if name == "TOTAL":
        return Expr(f"coalesce(sum({d}cast({value(x)} AS double)), double('0'))", "real")
    if name == "GROUP_CONCAT":
        within = f" WITHIN GROUP (ORDER BY {text(x) if distinct else order})" if distinct or order else ""
        return Expr(f"listagg({d}{text(x)}, {text(args[1]) if len(args) > 1 else repr(',')}){within}", "text")
    return Expr(f"{name.lower()}({value(x)})", x.kind)


def window(name: str, args: list[Expr], star: bool, partition: str, order: str, frame: str, rowid: str) -> Expr:
    ranking = name in ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "PERCENT_RANK", "CUME_DIST")
    if name in ("RANK", "DENSE_RANK") and not order:
        return Expr("1L", "int")
    tie = f", {rowid}" if rowid and order and name in ("ROW_NUMBER", "LAG", "LEAD", "NTILE") else ""
    by = f"ORDER BY {order}{tie}" if order else f"ORDER BY {rowid or '1'}" if ranking or name in ("LAG", "LEAD") else ""
    inside = [value(a) for a in args]
    if name in ("LAG", "LEAD"):
        inside[1:2] = [f"cast({inside[1]} AS int)"] if len(inside) > 1 else []
        over = f"OVER ({partition} {by})"
        return Expr(f"{name.lower()}({', '.join(inside)}) {over}", args[0].kind)
    if ranking:
        call = f"{name.lower()}({', '.join(f'cast({a} AS int)' for a in inside)})"
        sql = f"{call} OVER ({partition} {by})"
        return Expr(sql, "real") if name in ("PERCENT_RANK", "CUME_DIST") else Expr(f"cast({sql} AS bigint)", "int")
    spoken = frame or ("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if order else "")
    if spoken and not order:
        by = f"ORDER BY {rowid or '1'}"
    if rowid and by and spoken.upper().startswith("ROWS") and order:
        by += f", {rowid}"
    over = f"OVER ({partition} {by} {spoken})"
    if name in ("FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"):
        return Expr(f"{name.lower()}({', '.join(inside)}) {over}", args[0].kind)
    if name not in ("COUNT", "SUM", "AVG", "MIN", "MAX", "TOTAL"):
        raise ParseError(f"no such window function: {name}")
    if name == "TOTAL":
        return Expr(f"coalesce(sum(cast({inside[0]} AS double)) {over}, double('0'))", "real")
    call = "count(1)" if star or not args else f"{name.lower()}({inside[0]})"
    return Expr(f"{call} {over}", "int" if name == "COUNT" else "real" if name == "AVG" else args[0].kind)


def _trim(side: str):
    def f(a: list[Expr]) -> Expr:
        if len(a) > 1:
            return Expr(f"{side}({text(a[1])}, {text(a[0])})" if side != "btrim" else f"btrim({text(a[0])}, {text(a[1])})", "text")
        x = text(a[0])
        if side in ("btrim", "ltrim"):
            x = f"regexp_replace({x}, '^[\\\\s\\\\p{{Z}}]+', '')"
        if side in ("btrim", "rtrim"):
            x = f"regexp_replace({x}, '[\\\\s\\\\p{{Z}}]+$', '')"
        return Expr(x, "text")

    return f


def _substr(a: list[Expr]) -> Expr:
    start = f"greatest(cast({value(a[1])} AS int), 1)"
    if len(a) == 2:
        return Expr(f"substring({text(a[0])}, {start})", "text")
    n = f"cast({value(a[2])} AS int)"
    return Expr(f"if({n} < 0, substring({text(a[0])}, {start}), substring({text(a[0])}, {start}, {n}))", "text")


def _hex(a: list[Expr]) -> Expr:
    return Expr(f"hex({a[0].sql})" if a[0].kind == "blob" else f"hex({text(a[0])})", "text")


def _quoted(a: list[Expr]) -> Expr:
    x = a[0]
    if x.kind == "blob":
        shown = f"concat('X\\'', hex({x.sql}), '\\'')"
    elif x.kind in NUMBERS:
        shown = f"cast({value(x)} AS string)"
    else:
        shown = f"concat('\\'', replace({text(x)}, '\\'', '\\'\\''), '\\'')"
    return Expr(f"coalesce({shown}, 'NULL')", "text")


def _char(a: list[Expr]) -> Expr:
    """Code points as UTF-8: the code point's bytes in hexadecimal by ranges."""

    def one(x: Expr) -> str:
        n = f"cast({value(x)} AS bigint)"
        byte = lambda shift, mask, lead: f"({lead} + (shiftright({n}, {shift}) & {mask}))"
        pairs = lambda *bytes_: "concat(" + ", ".join(f"lpad(hex({b}), 2, '0')" for b in bytes_) + ")"
        return (
            f"CASE WHEN {n} < 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN '' WHEN {n} < 128 THEN {pairs(n)} WHEN {n} < 2048 THEN {pairs(byte(6, 31, 192), byte(0, 63, 128))}"
            f" WHEN {n} < 65536 THEN {pairs(byte(12, 15, 224), byte(6, 63, 128), byte(0, 63, 128))} ELSE {pairs(byte(18, 7, 240), byte(12, 63, 128), byte(6, 63, 128), byte(0, 63, 128))} END"
        )

    return Expr(f"decode(unhex(concat({', '.join(map(one, a))})), 'UTF-8')", "text")


def _printf(a: list[Expr]) -> Expr:
    import re

    from brindle.plans.dialect import literal

    if not a or not re.fullmatch(r"'(?:[^'\\]|\\.)*'", a[0].sql):
        raise ParseError("PRINTF takes a literal format")
    form = a[0].sql[1:-1].replace("\\'", "'").replace("\\\\", "\\")
    out, rest = [], list(a[1:])
    for piece in re.split(r"(%[difs%])", form):
        if piece == "%%":
            out.append("'%'")
        elif re.fullmatch("%[difs]", piece):
            x = rest.pop(0) if rest else Expr("NULL", "null")
            if piece in ("%d", "%i"):
                out.append(f"cast(coalesce(try_cast({value(x)} AS bigint), 0L) AS string)")
            elif piece == "%f":
                out.append(f"format_string('%.6f', coalesce(try_cast({value(x)} AS double), double('0')))")
            else:
                out.append(f"coalesce({text(x)}, 'NULL')")
        elif piece:
            out.append(literal(piece))
    return Expr(f"concat({', '.join(out) or repr('')})", "text")


def _typeof(a: list[Expr]) -> Expr:
    x = a[0]
    known = {"int": "integer", "bool": "integer", "real": "real", "text": "text", "blob": "blob", "null": "null"}
    if x.kind in known:
        return Expr(f"if({x.sql} IS NULL, 'null', '{known[x.kind]}')", "text")
    by = f"CASE typeof({x.sql}) WHEN 'string' THEN 'text' WHEN 'binary' THEN 'blob' WHEN 'double' THEN 'real' WHEN 'float' THEN 'real' WHEN 'void' THEN 'null' ELSE 'integer' END"
    return Expr(f"if({x.sql} IS NULL, 'null', {by})", "text")


# JSON
def _path(a: list[Expr]) -> str:
    return text(a[1]) if len(a) > 1 else "'$'"


def _json_type(a: list[Expr]) -> Expr:
    v = f"try_variant_get(try_parse_json({text(a[0])}), {_path(a)}, 'variant')"
    kind = f"schema_of_variant({v})"
    return Expr(
        f"CASE WHEN {v} IS NULL THEN NULL WHEN is_variant_null({v}) THEN 'null' WHEN {kind} = 'BOOLEAN' THEN cast({v} AS string) WHEN {kind} = 'BIGINT' THEN 'integer'"
        f" WHEN {kind} LIKE 'DECIMAL%' OR {kind} IN ('DOUBLE', 'FLOAT') THEN 'real' WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} LIKE 'ARRAY%' THEN 'array' ELSE 'object' END",
        "text",
    )


def _json_extract(a: list[Expr]) -> Expr:
    v = f"try_variant_get(try_parse_json({text(a[0])}), {_path(a)}, 'variant')"
    return Expr(f"CASE schema_of_variant({v}) WHEN 'BOOLEAN' THEN if(cast({v} AS boolean), '1', '0') ELSE if(is_variant_null({v}), NULL, coalesce(get_json_object({text(a[0])}, {_path(a)}), cast({v} AS string))) END", "text")


def _json_value(x: Expr) -> str:
    if x.kind in ("int", "real", "bool"):
        return f"coalesce(cast({value(x)} AS string), 'null')"
    if x.kind == "null":
        return "'null'"
    return f"coalesce(substring(to_json(array({text(x)})), 2, length(to_json(array({text(x)}))) - 2), 'null')"


def _json_array(a: list[Expr]) -> Expr:
    return Expr(f"concat('[', concat_ws(',', {', '.join(map(_json_value, a)) or 'array()'}), ']')", "text")


def _json_object(a: list[Expr]) -> Expr:
    if len(a) % 2:
        raise ParseError("JSON_OBJECT takes an even number of arguments")
    pairs = [f"concat({_json_value(k)}, ':', {_json_value(v)})" for k, v in zip(a[::2], a[1::2], strict=True)]
    return Expr(f"concat('{{', concat_ws(',', {', '.join(pairs) or 'array()'}), '}}')", "text")


def _minified(a: list[Expr]) -> Expr:
    """White space outside strings goes; keys keep their order and repeats."""
    x = text(a[0])
    return Expr(f"if(try_parse_json({x}) IS NULL AND {x} IS NOT NULL, raise_error('malformed JSON'), regexp_replace({x}, '(\"(?:[^\"\\\\\\\\]|\\\\\\\\.)*\")|[\\\\s]+', '$1'))", "text")


# Dates: text in, text out
_GUARD = "'^\\\\d{4}-\\\\d{2}-\\\\d{2}([ T]\\\\d{2}:\\\\d{2}:\\\\d{2}(\\\\.\\\\d+)?)?$'"


def moment(a: list[Expr]) -> str:
    """The timestamp (UTC) of a time text and its modifiers; NULL if either is not understood."""
    import re

    from brindle.plans.dialect import literal

    if not a or a[0].sql.lower() == "'now'":
        ts = "cast(current_timestamp() AS timestamp_ntz)"
    else:
        x = text(a[0])
        ts = f"if({x} RLIKE {_GUARD}, try_cast(replace({x}, 'T', ' ') AS timestamp_ntz), NULL)"
    for m in a[1:]:
        if not re.fullmatch(r"'[^'\\]*'", m.sql):
            raise ParseError("date modifiers are literals")
        word = m.sql[1:-1].strip().lower()
        if found := re.fullmatch(r"([+-]?\d+)\s+(day|month|year)s?", word):
            n, unit = int(found[1]), found[2]
            ts = f"({ts} + {'INTERVAL ' + literal(str(n)) + ' DAY' if unit == 'day' else 'INTERVAL ' + literal(str(n * (12 if unit == 'year' else 1))) + ' MONTH'})"
        elif found := re.fullmatch(r"start of (day|month|year)", word):
            ts = f"cast(date_trunc('{found[1]}', {ts}) AS timestamp_ntz)"
        else:
            ts = "cast(NULL AS timestamp_ntz)"
    return ts


def _formatted(pattern: str):
    return lambda a: Expr(f"date_format({moment(a)}, '{pattern}')", "text")


def _julian(ts: str) -> str:
    return f"(unix_micros(cast({ts} AS timestamp)) / double('86400000000') + double('2440587.5'))"


def _strftime(a: list[Expr]) -> Expr:
    import re

    from brindle.plans.dialect import literal

    ts = moment(a[1:])
    parts = {
        "Y": f"date_format({ts}, 'yyyy')", "m": f"date_format({ts}, 'MM')", "d": f"date_format({ts}, 'dd')", "H": f"date_format({ts}, 'HH')", "M": f"date_format({ts}, 'mm')",
        "S": f"date_format({ts}, 'ss')", "f": f"date_format({ts}, 'ss.SSS')", "j": f"lpad(cast(dayofyear({ts}) AS string), 3, '0')", "J": real_text(_julian(ts)), "w": f"cast(dayofweek({ts}) - 1 AS string)",
        "W": f"lpad(cast((dayofyear({ts}) + 6 - (dayofweek({ts}) + 5) % 7) div 7 AS string), 2, '0')", "s": f"cast(unix_seconds(cast({ts} AS timestamp)) AS string)", "%": "'%'",
    }
    form = a[0].sql[1:-1]
    out = [parts[p[1]] if len(p) == 2 and p[0] == "%" and p[1] in parts else literal(p) for p in re.split("(%.)", form) if p]
    return Expr(f"if({ts} IS NULL, NULL, concat({', '.join(out) or repr('')}))", "text")


def _least(name: str):
    return lambda a: Expr(f"{name}({', '.join(map(value, a))})", common([x.kind for x in a]))


def _coalesce(a: list[Expr]) -> Expr:
    return Expr(f"coalesce({', '.join(map(value, a))})", common([x.kind for x in a]))


def _same(name: str, kind: str | None = None):
    return lambda a: Expr(f"{name}({', '.join(map(value, a))})", kind or a[0].kind)


FUNCTIONS = {
    "ABS": lambda a: Expr(f"abs({number(a[0])})", a[0].kind),
    "LENGTH": lambda a: Expr(f"cast({'octet_length(' + a[0].sql if a[0].kind == 'blob' else 'length(' + text(a[0])}) AS bigint)", "int"),
    "UPPER": lambda a: Expr(f"upper({text(a[0])})", "text"), "LOWER": lambda a: Expr(f"lower({text(a[0])})", "text"),
    "SUBSTR": _substr, "SUBSTRING": _substr, "TRIM": _trim("btrim"), "LTRIM": _trim("ltrim"), "RTRIM": _trim("rtrim"),
    "REPLACE": lambda a: Expr(f"if({text(a[1])} = '', {text(a[0])}, replace({text(a[0])}, {text(a[1])}, {text(a[2])}))", "text"),
    "INSTR": lambda a: Expr(f"cast(instr({text(a[0])}, {text(a[1])}) AS bigint)", "int"),
    "HEX": _hex, "QUOTE": _quoted, "UNICODE": lambda a: Expr(f"cast(nullif(ascii({text(a[0])}), 0) AS bigint)", "int"), "CHAR": _char, "PRINTF": _printf, "FORMAT": _printf,
    "ZEROBLOB": lambda a: Expr(f"unhex(repeat('00', cast({value(a[0])} AS int)))", "blob"),
    "ROUND": lambda a: Expr(f"round(cast({number(a[0])} AS double), {'cast(' + value(a[1]) + ' AS int)' if len(a) > 1 else '0'})", "real"),
    "RANDOM": lambda a: Expr("xxhash64(uuid())", "int"), "MAX": _least("greatest"), "MIN": _least("least"),
    "COALESCE": _coalesce, "IFNULL": _coalesce, "NULLIF": _same("nullif"), "IIF": lambda a: Expr(f"if({truth(a[0])}, {value(a[1])}, {value(a[2])})", common([a[1].kind, a[2].kind])), "TYPEOF": _typeof,
    "JSON": _minified, "JSON_EXTRACT": _json_extract, "JSON_TYPE": _json_type, "JSON_ARRAY": _json_array, "JSON_OBJECT": _json_object,
    "JSON_ARRAY_LENGTH": lambda a: Expr(f"cast(json_array_length(get_json_object({text(a[0])}, {_path(a)})) AS bigint)", "int"),
    "JSON_VALID": lambda a: Expr(f"if({text(a[0])} IS NULL, NULL, cast(try_parse_json({text(a[0])}) IS NOT NULL AS bigint))", "int"),
    "DATE": _formatted("yyyy-MM-dd"), "TIME": _formatted("HH:mm:ss"), "DATETIME": _formatted("yyyy-MM-dd HH:mm:ss"), "STRFTIME": _strftime,
    "JULIANDAY": lambda a: Expr(_julian(moment(a)), "real"),
}
FUNCTIONS["LEN"] = FUNCTIONS["LENGTH"]
#: Functions registered by the user: name -> kind of the result.
REGISTERED: dict[str, str] = {}


def scalar(name: str, args: list[Expr]) -> Expr:
    if name in REGISTERED:
        return Expr(f"{name.lower()}({', '.join(map(value, args))})", REGISTERED[name])
    if name not in FUNCTIONS:
        raise ParseError(f"no such function: {name}")
    try:
        return FUNCTIONS[name](args)
    except IndexError:
        raise ParseError(f"too few arguments for {name}") from None
