"""PostgreSQL SELECT text as Spark SQL: null order, aggregate names and types, LIKE escapes, parameters; and the strict gate."""

from __future__ import annotations

import re
from collections.abc import Callable

from .errors import UnsupportedError

TOKEN = re.compile(r"""'(?:[^']|'')*'|"[^"]*"|\$\d+|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|::|<>|<=|>=|!=|\|\||\s+|.""", re.S)
AGGREGATES = ("count", "sum", "avg", "min", "max")
ENDS = {"limit", "offset", "fetch", "rows", "range", "window", "union", "having", "where", "from", "for"}


def tokens(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text) if not t.startswith(("--", "/*"))]


def outside_literals(text: str, change: Callable[[str], str]) -> str:
    """text with change applied to what stands between string literals and quoted names."""
    return "".join(x if i % 2 else change(x) for i, x in enumerate(re.split(r"""('(?:[^']|'')*'|"[^"]*")""", text)))


def bind(text: str, args: tuple) -> str:
    """$n as typed literals."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return str(x)
        if type(x).__name__ == "date":
            return f"DATE '{x}'"
        if type(x).__name__ == "datetime":
            return f"TIMESTAMP_NTZ '{x}'"
        return "'" + str(x).replace("\\", "\\\\").replace("'", "''") + "'"

    out = []
    for t in tokens(text):
        if re.fullmatch(r"\$\d+", t):
            n = int(t[1:])
            if not 1 <= n <= len(args):
                raise UnsupportedError(f"there is no parameter {t}")
            t = literal(args[n - 1])
        out.append(t)
    return "".join(out)


def null_order(parts: list[str]) -> list[str]:
    """Every sort item with its NULLS clause: last ascending, first descending."""
    out: list[str] = []
    i = 0
    while i < len(parts):
        out.append(parts[i])
        if parts[i].lower() == "order":
            j = i + 1
            while j < len(parts) and parts[j].isspace():
                j += 1
            if j < len(parts) and parts[j].lower() == "by":
                out += parts[i + 1 : j + 1]
                depth, item, i = 0, [], j + 1

                def close() -> None:
                    words = [x.lower() for x in item if not x.isspace()]
                    if words and "nulls" not in words:
                        tail = len(item)
                        while tail and item[tail - 1].isspace():
                            tail -= 1
                        item.insert(tail, " NULLS FIRST" if words[-1] == "desc" else " NULLS LAST")
                    out.extend(item)
                    item.clear()

                while i < len(parts):
                    t = parts[i]
                    if depth == 0 and (t in (")", ";") or t.lower() in ENDS):
                        break
                    depth += (t == "(") - (t == ")")
                    if t == "," and depth == 0:
                        close()
                        out.append(t)
                    else:
                        item.append(t)
                    i += 1
                close()
                continue
        i += 1
    return out


def like_escapes(parts: list[str]) -> list[str]:
    """Literal patterns after LIKE: a backslash before an ordinary character is that character. Spark reads backslashes in literals itself."""
    out, after = [], False
    for t in parts:
        if after and t.startswith("'"):
            body = re.sub(r"\\([^%_\\])", r"\1", t[1:-1]).replace("\\", "\\\\")
            t = f"'{body}'"
        elif t.startswith("'"):
            t = t.replace("\\", "\\\\")
        out.append(t)
        if not t.isspace():
            after = t.lower() == "like"
    return out


def select_list(parts: list[str]) -> tuple[int, int]:
    """Where the top SELECT's list begins and ends in parts."""
    depth, begin = 0, -1
    for i, t in enumerate(parts):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.lower() == "select" and begin < 0:
            begin = i + 1
        elif depth == 0 and t.lower() == "from" and begin >= 0:
            return begin, i
    return begin, len(parts)


def typed_aggregates(parts: list[str], kind_of) -> list[str]:
    """SUM and AVG of a plain column with PostgreSQL's result type; unnamed aggregates of the list get their default names.

    kind_of(column) is the column's Spark type text, or None.
    """
    begin, end = select_list(parts)
    out, i = [], 0
    while i < len(parts):
        t = parts[i].lower()
        rest = "".join(parts[i : i + 8])
        m = re.match(r"(?i)(sum|avg)\s*\(\s*((?:[a-z_]\w*\.)?[a-z_]\w*)\s*\)", rest) if t in ("sum", "avg") else None
        if m:
            kind = kind_of(m[2]) or ""
            scale = re.fullmatch(r"decimal\(\d+,(\d+)\)", kind)
            cast = f"CAST({m[2]} AS DECIMAL(38,{scale[1]}))" if scale else f"CAST({m[2]} AS DECIMAL(38,0))" if kind == "bigint" else f"CAST({m[2]} AS BIGINT)" if kind in ("int", "smallint") else m[2]
            to = f"DECIMAL(38,{scale[1]})" if scale else "DECIMAL(38,0)" if kind == "bigint" else "BIGINT"
            total = f"CAST(SUM({cast}) AS {to})" if kind else f"SUM({m[2]})"
            text = total if m[1].lower() == "sum" else f"CAST(try_divide(CAST(SUM({cast}) AS DECIMAL(38,16)), CAST(COUNT({m[2]}) AS DECIMAL(20,0))) AS DECIMAL(38,16))" if kind else f"AVG({m[2]})"
            used, n = 0, 0
            while used < m.end():
                used += len(parts[i + n])
                n += 1
            out.append(text)
            if begin <= i < end and _unnamed(parts, i + n, end):
                out.append(f" AS {m[1].lower()}")
            i += n
            continue
        out.append(parts[i])
        if t in AGGREGATES and begin <= i < end and i + 1 < len(parts) and parts[i + 1] == "(":
            depth, j = 0, i + 1
            while j < end:
                depth += (parts[j] == "(") - (parts[j] == ")")
                out.append(parts[j])
                j += 1
                if depth == 0:
                    break
            if _unnamed(parts, j, end) and _opens_item(parts, begin, i):
                out.append(f" AS {t}")
            i = j
            continue
        i += 1
    return out


def _unnamed(parts: list[str], at: int, end: int) -> bool:
    rest = [t for t in parts[at:end] if not t.isspace()]
    return not rest or rest[0] == ","


def _opens_item(parts: list[str], begin: int, at: int) -> bool:
    before = [t for t in parts[begin:at] if not t.isspace()]
    return not before or before[-1] == ","


def _group(parts: list[str], at: int) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(parts)):
        depth += (parts[i] == "(") - (parts[i] == ")")
        if depth == 0:
            return i + 1
    raise UnsupportedError("a bracket is not closed")


def named_windows(parts: list[str]) -> list[str]:
    """WINDOW definitions put in place of their names, those that extend another definition included."""
    plain = [i for i, t in enumerate(parts) if not t.isspace()]
    depth, begin, end, windows = 0, -1, -1, {}
    for k, i in enumerate(plain):
        depth += (parts[i] == "(") - (parts[i] == ")")
        if depth or parts[i].lower() != "window" or k + 3 >= len(plain) or parts[plain[k + 2]].lower() != "as":
            continue
        begin, at = i, k + 1
        while True:
            name, opening = parts[plain[at]].lower(), plain[at + 2]
            end = _group(parts, opening)
            windows[name] = _extended(parts[opening + 1 : end - 1], windows)
            at = next((n for n, j in enumerate(plain) if j >= end), len(plain))
            if at >= len(plain) or parts[plain[at]] != ",":
                break
            at += 1
        break
    if begin < 0:
        return parts
    out, i, body = [], 0, parts[:begin] + parts[end:]
    while i < len(body):
        out.append(body[i])
        i += 1
        if out[-1].lower() == "over":
            while i < len(body) and body[i].isspace():
                i += 1
            if i < len(body) and body[i].lower() in windows:
                out += [" (", *windows[body[i].lower()], ")"]
                i += 1
            elif i < len(body) and body[i] == "(":
                stop = _group(body, i)
                out += [" (", *_extended(body[i + 1 : stop - 1], windows), ")"]
                i = stop
    return out


def _extended(spec: list[str], windows: dict[str, list[str]]) -> list[str]:
    first = next((i for i, t in enumerate(spec) if not t.isspace()), -1)
    if first >= 0 and spec[first].lower() in windows:
        return [*windows[spec[first].lower()], " ", *spec[first + 1 :]]
    return spec


def wide_ranks(parts: list[str]) -> list[str]:
    """Ranking functions as int8, under their own names where the query gives none."""
    out, i = [], 0
    while i < len(parts):
        words = [j for j in range(i, min(i + 12, len(parts))) if not parts[j].isspace()]
        if parts[i].lower() in ("row_number", "rank", "dense_rank") and [parts[j].lower() for j in words[1:5]] == ["(", ")", "over", "("]:
            end = _group(parts, words[4])
            rest = [t for t in parts[end:] if not t.isspace()]
            out += ["CAST(", *parts[i:end], " AS BIGINT)"] + ([f" AS {parts[i].lower()}"] if rest and (rest[0] == "," or rest[0].lower() == "from") else [])
            i = end
        else:
            out.append(parts[i])
            i += 1
    return out


def to_spark(text: str, kind_of=lambda name: None) -> str:
    parts = wide_ranks(tokens("".join(named_windows(tokens(text.strip().rstrip(";"))))))
    return "".join(null_order(typed_aggregates(like_escapes(parts), kind_of)))


#: A table joined to itself by equal columns, where one column is less on one side than on the other.
NAME = r'(?:"[^"]+"|[A-Za-z_]\w*)'
ORDERED_PAIRS = re.compile(rf"""(?is)select\s+(?P<list>[^()']+?)\s+from\s+(?P<table>{NAME})\s+(?:as\s+)?(?P<a>{NAME})\s+(?:inner\s+)?join\s+(?P=table)\s+(?:as\s+)?(?P<b>{NAME})
    \s+on\s+(?P<on>[^()']+?)\s+where\s+(?P<less>{NAME}\.{NAME}\s*[<>]=?\s*{NAME}\.{NAME})""".replace("\n    ", ""))


def ordered_pairs(text: str) -> dict | None:
    """The parts of a SELECT of just that shape: table, keys, by, equal (whether equal values pair too) and list, of (side, column, name) with
    the sides low and high; None for any other."""
    m = ORDERED_PAIRS.fullmatch("".join(tokens(text)).strip().rstrip(";").strip())
    plain = lambda name: name[1:-1] if name.startswith('"') else name.lower()
    if m is None or plain(m["a"]) == plain(m["b"]):
        return None

    def column(item: str) -> tuple[str, str] | None:
        c = re.fullmatch(rf"\s*({NAME})\.({NAME})\s*", item)
        return (plain(c[1]), plain(c[2])) if c and plain(c[1]) in (plain(m["a"]), plain(m["b"])) else None

    one, sign, other = re.split(r"([<>]=?)", m["less"])
    low, high = (column(x) for x in ((one, other) if sign[0] == "<" else (other, one)))
    keys = [[column(x) for x in item.split("=")] for item in re.split(r"(?i)\s+and\s+", m["on"])]
    if not low or not high or low[0] == high[0] or low[1] != high[1]:
        return None
    if any(len(k) != 2 or not all(k) or k[0][0] == k[1][0] or k[0][1] != k[1][1] for k in keys):
        return None
    out = []
    for item in m["list"].split(","):
        x = re.fullmatch(rf"(?is)(\s*{NAME}\.{NAME})(?:\s+as\s+({NAME}))?\s*", item)
        c = column(x[1]) if x else None
        if c is None:
            return None
        written = x[2] or x[1].rpartition(".")[2]
        out.append(("low" if c[0] == low[0] else "high", c[1], written[1:-1] if written.startswith('"') else written))
    return {"table": plain(m["table"]), "keys": [k[0][1] for k in keys], "by": low[1], "equal": sign.endswith("="), "list": out}


#: Shapes refused in strict mode: (pattern over the text without literals, what it is).
REFUSED = (
    (r"\b(union|intersect|except)\b", "set operations"),
    (r"^\s*with\b", "WITH"),
    (r"\bfrom\s*\(", "a subquery in FROM"),
    (r"\bin\s*\(\s*select\b|\bexists\s*\(", "a subquery in a predicate"),
    (r"\bfor\s+(update|share)\b", "row locks"),
    (r"\bselect\b.*\binto\b", "SELECT INTO"),
    (r"^\s*values\b", "VALUES"),
    (r"\bnot\s+like\b", "NOT LIKE"),
    (r"\bfilter\s*\(", "aggregate FILTER"),
    (r"\bselect\s+distinct\s+\*", "SELECT DISTINCT *"),
    (r"\b(sum|avg|min|max)\s*\(\s*distinct\b", "DISTINCT in an aggregate other than COUNT"),
    (r"[^<>=!]/|%", "division"),
    (r"\blimit\s+-|\boffset\s+-", "a negative LIMIT or OFFSET"),
    (r";\s*\S", "several statements"),
    (r"\bnot\s*\(", "NOT over an expression"),
    (r"(?:[=<>(,]|\b(?:select|where|and|or|by))\s*[-+~]\s*[A-Za-z_(]", "a unary operator"),
    (r"\border\s+by\b[^()]*\busing\s*[<>]", "ORDER BY USING"),
)


CLAUSES = ("select", "from", "where", "group by", "having", "window", "order by", "limit", "offset", "fetch")
COLUMN = r'(?:[A-Za-z_]\w*|"[^"]+")(?:\.(?:[A-Za-z_]\w*|"[^"]+"))*'


def clauses(text: str) -> dict[str, str]:
    """The clauses of a SELECT, those inside brackets left where they are."""
    out, now, depth = {}, "", 0
    toks = [t for t in tokens(re.sub(r"(?i)\b(group|order)\s+by\b", r"\1_by", text))]
    for t in toks:
        depth += (t == "(") - (t == ")")
        name = t.lower().replace("_by", " by")
        if not depth and name in CLAUSES:
            now = name
            out[now] = ""
        elif now:
            out[now] += t
    return {k: v.strip() for k, v in out.items()}


def listed(text: str) -> list[str]:
    """The items of a list, commas inside brackets not counted."""
    out, depth = [""], 0
    for t in tokens(text):
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append("")
        else:
            out[-1] += t
    return [x.strip() for x in out if x.strip()]


def check_shape(text: str) -> None:
    """Refuse projected expressions and keys of ORDER BY and HAVING that the result does not have."""
    parts = clauses(text)
    if "from" not in parts:
        return
    norm = lambda x: re.sub(r"\s+", "", x.lower()).rpartition(".")[2] if re.fullmatch(COLUMN, x.strip()) else re.sub(r"\s+", "", x.lower())
    distinct = bool(re.match(r"(?i)distinct\b", parts.get("select", "")))
    names, aggregate = set(), False
    items = listed(re.sub(r"(?i)^distinct\b", "", parts.get("select", "")).strip())
    for i, item in enumerate(items):
        m = re.fullmatch(rf"(?is)(.*?)(?:\s+as\s+|\s+)({COLUMN})", item)
        what, alias = (m[1].strip(), m[2]) if m and not re.search(r"(?i)\bover\s*$", m[1]) else (item, "")
        call = re.fullmatch(rf"(?is)(\w+)\s*\(\s*(?:(?:distinct\s+)?{COLUMN}|\*|{COLUMN}\s*,\s*\d+)?\s*\)(\s*over\s*(?:\(.*\)|{COLUMN}))?", what)
        if not call and not re.fullmatch(rf"(?:{COLUMN}\.)?\*|{COLUMN}", what):
            raise UnsupportedError(f"the projected expression {what} is not supported in strict mode")
        plain = call and not call[2] and call[1].lower() in AGGREGATES
        aggregate = aggregate or bool(plain)
        names |= {norm(what), str(i + 1), *([norm(alias)] if alias else []), *([call[1].lower()] if plain else [])}
    groups = {norm(x) for x in listed(parts.get("group by", ""))}
    if aggregate or groups or distinct:
        for key in listed(parts.get("order by", "")):
            by = re.sub(r"(?i)\s+(asc|desc)\b|\s+nulls\s+(first|last)\b", "", key)
            if norm(by) not in names | groups and not ("*" in names and distinct):
                raise UnsupportedError(f"ORDER BY {by} is not a column of the result, which strict mode asks for")
    for word in re.findall(rf"(?i)(?<![\w.'\"]){COLUMN}(?!\s*\()", re.sub(r"'(?:[^']|'')*'|\w+\s*\([^)]*\)", " ", parts.get("having", ""))):
        if word.lower() not in ("and", "or", "is", "not", "null", "true", "false", "between", "in", "like") and norm(word) not in names | groups:
            raise UnsupportedError(f"HAVING {word} is neither a group column nor a name of the result")


def check_strict(text: str) -> None:
    """Refuse what the strict surface has no exact meaning for."""
    bare = "".join("''" if t.startswith("'") else t for t in tokens(text))
    for pattern, what in REFUSED:
        if re.search(pattern, bare, re.I | re.S):
            raise UnsupportedError(f"{what} is not supported in strict mode")
    if re.search(r"\bhaving\b", bare, re.I) and not re.search(r"\bgroup\s+by\b", bare, re.I):
        raise UnsupportedError("HAVING without GROUP BY is not supported in strict mode")
    check_shape(bare)
