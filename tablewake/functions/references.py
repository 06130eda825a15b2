"""Kind, target and source tables of one SQL statement.

One pattern cuts a statement to its key words, parentheses and the names right behind them; one pass over these keeps the open
parentheses, so it holds at any depth. Verbs and their targets, what may stand before a verb, common table expressions and
copied tables are states of that pass. Statements it cannot place are reported, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEGINS = r"(?<![\p{L}\p{N}_$#.])"
ENDS = r"(?![\p{L}\p{N}_$#])"
NAME = r'(?:"[^"]+"|[\p{L}_][\p{L}\p{N}_$#]*+)'
TABLE = rf"{NAME}(?:\s*\.\s*{NAME})*+"

#: Quoted names are matched too, and put back, so that a quote inside one opens no literal.
UNREAD = r"""(?s)("[^"]*")|'[^']*'|--[^\n]*|/\*.*?\*/|[\x01\x02]"""

# Statement kinds and the words that open them.
KINDS = {
    "Delete": ("del", "delete"),
    "Insert": ("ins", "insert"),
    "Update": ("upd", "update"),
    "Merge": ("merge",),
    "Create": ("create", "replace"),
    "Drop": ("drop",),
    "Select": ("sel", "select", "with", "("),
    "Command": (
        "collect", "call", "alter", "exec", "execute", "grant", "revoke", "rename", "comment", "database", "set", "show",
        "help", "explain", "begin", "end", "bt", "et", "commit", "rollback", "abort", "diagnostic",
    ),
}
# Words of what may stand before a statement's verb, a row description and locks; alone they are a command.
MODIFIERS = ("using", "lock", "locking")
MODIFIED = "Modified"

# Words by their part in a statement. Those that end a table list, and further ones that are no name.
ENDS_LIST = ("where", "group", "having", "qualify", "order", "union", "intersect", "except", "minus", "set", "sample", "values", "window")
NO_NAME = (
    "on", "inner", "left", "right", "full", "outer", "cross", "natural", "when", "all", "and", "for", "as", "lateral", "table", "unnest",
    "is", "not", "or",
)
_VERBS = ("Delete", "Insert", "Update", "Merge", "Create", "Drop")
PARTS = (
    {"from": "from", "join": "join", "using": "using", "select": "select", "sel": "select", "with": "with", "as": "copy", ",": ",", "(": "(", ")": ")"}
    | dict.fromkeys(ENDS_LIST, "end")
    | {word: kind for kind in _VERBS for word in KINDS[kind]}
)


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")" + ENDS


_IS_NAME = "(?!" + _any("from", "join", "using", "select", "sel", "with", *ENDS_LIST, *NO_NAME) + ")"
_ALIAS = rf"(?:\s+as{ENDS})?\s*({_IS_NAME}{NAME})(?!\s*\.)(?!\s+with\s+(?:no\s+)?data{ENDS})"
_LATERAL = rf"(?:\s*lateral{ENDS})?"
_CREATED = (
    rf"(?:\s+or\s+replace)?(?:\s+(?:multiset|set|volatile|global|temporary|trace|recursive){ENDS})*+"
    rf"\s+(?:table|view|join\s+index){ENDS}(?:\s+if\s+not\s+exists{ENDS})?"
)
#: A key word, any open parentheses behind it, a name with its alias, and the parenthesis of a function's call. Quoted
#: names elsewhere, and the FROM of IS [NOT] DISTINCT FROM, are passed over. Where no word, comma or parenthesis begins, one look
#: ahead and one behind say so, in place of one for each kind of word.
UNIT = (
    rf'"[^"]*"|(?>(?=[(),])|(?=[a-zA-Z]){BEGINS})(?i:'
    rf"(?:(,){_LATERAL}"
    rf"|({_any('from', 'join')}){_LATERAL}"
    rf"|({_any('using', 'select', 'sel', 'drop', *ENDS_LIST)})"
    rf"|({_any('insert', 'ins', 'update', 'upd', 'merge', 'delete', 'del', 'with')})(?!(?<=with)\s+(?:no\s+)?data{ENDS})(?:\s+(?:into|recursive){ENDS})?"
    rf"|({_any('create', 'replace')}){_CREATED}"
    rf"|(as{ENDS})(?=\s+{TABLE}\s+with\s+(?:no\s+)?data{ENDS})"
    r")((?:\s*\()*+)"
    rf"(?:\s*({_IS_NAME}{TABLE})(?:{_ALIAS}|(?=\s*(\())|))?"
    rf"|is\s+(?:not\s+)?distinct\s+from{ENDS}|({_any('create', 'replace')})|([()]))"
)
#: What a unit becomes: its word, its parentheses, its name, alias, and a mark if these are a function's.
MARKED = "\x01$1$2$3$4$5$6$11$12\x02$7\x02$8\x02$9\x02$10\x02"


def readable(sql: Column) -> Column:
    """The statement without literals and comments."""
    return F.regexp_replace(sql, UNREAD, "$1 ")


def opening_kind(text: Column) -> Column:
    """Kind by the first word, `MODIFIED` if that is a modifier; null if it is none that opens a statement."""
    first = F.regexp_extract(text, r"^\s*(\(|[\p{L}_][\p{L}\p{N}_$#]*)", 1)
    return _look_up({w: kind for kind, words in {**KINDS, MODIFIED: MODIFIERS}.items() for w in words}, F.lower(first))


def _look_up(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def plain_name(name: Column) -> Column:
    """Parts joined by dots; quotes stay only around a part that holds a dot itself."""
    whole = F.regexp_replace(F.regexp_replace(name, r'\s*\.\s*(["\p{L}_])', ".$1"), r'"([^".]*)"', "$1")
    # Most names hold neither blanks nor quotes and are as they should be.
    return F.when(F.translate(name, '" \t\n\x0b\f\r', "") == name, name).otherwise(whole)


def units(text: Column) -> Column:
    """``part``, ``parentheses`` (as many open ones as follow), ``name``, ``alias`` and ``called`` of each key word."""
    marked = F.regexp_replace(text, UNIT, MARKED)

    def of(fields: Column) -> Column:
        return F.struct(
            _look_up(PARTS, F.lower(fields[0])).alias("part"),
            F.translate(fields[1], " \t\n\x0b\f\r", "").alias("parentheses"),
            fields[2].alias("name"),
            fields[3].alias("alias"),
            (fields[4] != "").alias("called"),
        )

    fields = F.transform(F.slice(F.split(marked, "\x01"), 2, 1 << 30), lambda unit: F.split(unit, "\x02"))
    return F.filter(F.transform(fields, of), lambda u: u["part"].isNotNull())


def _step(state: Column, unit: Column) -> Column:
    """One unit further.

    ``top`` is a sign for the innermost open parenthesis, ``rest`` has one for each of those around it and the statement itself: s no verb
    so far, d a delete without a target yet, c what is created, w common table expressions, 0 no query, 1 a query, 2 a query's table
    list. ``found`` gets a line for each name: what it is, the name and its alias. An aggregate's expressions are evaluated
    wherever they stand, so the innermost sign is a field of its own.
    """
    part, name, inner = unit["part"], unit["name"], unit["parentheses"]
    top, rest = state["top"], state["rest"]
    named = F.concat(name, F.lit("\x02"), unit["alias"])
    verb = (top == "s") & part.isin(*_VERBS)
    lists = part.isin("from", "join") & ~top.isin("0", "s")
    in_list = (part == ",") & (top == "2")
    deletes = (top == "d") & (part == "from") & (inner == "")
    own = (
        F.when(verb, F.when((part == "Delete") & (name == ""), "d").when(part == "Create", "c").otherwise("1"))
        .when(deletes, "1")
        .when(lists, "2")
        .when(part == "select", "1")
        .when(part == "with", "w")
        .when((part == "end") & (top == "2"), "1")
        .otherwise(top)
    )
    table = (
        ((lists & ~deletes) | in_list | ((part == "using") & (inner == "") & ~top.isin("0", "s"))) & ~unit["called"]
    ) | ((part == "copy") & top.isin("c", "w"))
    selects = part.isin("select", "with") & F.startswith(F.concat(rest, top), F.lit("s"))
    found = (
        F.when(verb, F.concat(F.lit("\x01"), part, F.lit("\x02"), F.when((inner == "") & (part != "Drop"), named).otherwise("\x02")))
        .when(selects & (part == "select"), "\x01Select\x02\x02")
        .when(selects, F.concat(F.lit("\x01Select\x02\x02\x01local\x02"), named))
        .when(name == "", "")
        .when(deletes, F.concat(F.lit("\x01Delete\x02"), named))
        .when(table, F.concat(F.lit("\x01table\x02"), named))
        .when((part == "with") | ((part == ",") & (top == "w")), F.concat(F.lit("\x01local\x02"), named))
        .otherwise("")
    )
    sign = F.when(lists | in_list, "2").otherwise("0")
    closes, opens = (part == ")") & (rest != ""), part == "("
    return F.struct(
        F.when(closes, F.substring(rest, -1, 1))
        .when(part == ")", top)
        .when(opens, "0")
        .when(inner == "", own)
        .otherwise(sign)
        .alias("top"),
        F.when(closes, F.left(rest, F.length(rest) - 1))
        .when(opens, F.concat(rest, top))
        .when((part == ")") | (inner == ""), rest)
        .otherwise(F.concat(rest, own, F.replace(F.substring(inner, 2, 1 << 30), F.lit("("), sign)))
        .alias("rest"),
        F.when(part.isin("(", ")", "end"), state["found"]).otherwise(F.concat(state["found"], found)).alias("found"),
    )


def names_found(kind: Column, units: Column) -> Column:
    """``what`` (a verb's kind with its target, ``table`` read, ``local`` to the statement), ``name`` and ``alias``, in order."""
    waits = kind.isin("Delete", "Insert", "Update", "Merge", "Create", MODIFIED)
    start = F.struct(F.when(waits, "s").otherwise("1").alias("top"), F.lit("").alias("rest"), F.lit("").alias("found"))
    found = F.aggregate(units, start, _step, lambda state: state["found"])
    lines = F.transform(F.slice(F.split(found, "\x01"), 2, 1 << 30), lambda line: F.split(line, "\x02"))
    return F.transform(lines, lambda f: F.struct(f[0].alias("what"), f[1].alias("name"), f[2].alias("alias")))


def verb_found(found: Column) -> Column:
    """The verb's entry; a delete's last one, which has its target."""
    verbs = F.filter(found, lambda f: ~f["what"].isin("table", "local"))
    return F.get(verbs, F.size(verbs) - 1)


def aliased_target(kind: Column, target: Column, found: Column) -> Column:
    """The table that an update or delete names by its alias; null if it names it itself."""
    same = F.filter(found, lambda t: (t["what"] == "table") & (t["alias"] != "") & (F.lower(plain_name(t["alias"])) == F.lower(plain_name(target))))
    return F.when(kind.isin("Update", "Delete"), F.get(same, F.lit(0)))


def source_tables(found: Column, target: Column) -> Column:
    """Distinct tables read; without common table expressions and without the aliased target."""
    others = F.filter(found, lambda t: (t["what"] == "table") & (target.isNull() | (t["name"] != target["name"]) | (t["alias"] != target["alias"])))
    local = F.transform(F.filter(found, lambda t: t["what"] == "local"), lambda t: F.lower(plain_name(t["name"])))
    return F.filter(F.array_distinct(F.transform(others, lambda t: plain_name(t["name"]))), lambda n: ~F.array_contains(local, F.lower(n)))
