"""Which way a query is answered, by patterns in its text: literally, along the graph, or by meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import _col, trimmed

# The patterns that routing goes by. Word borders are ASCII ones.
STRUCTURAL = "(?iu)호출|상속|구현|이어지|연결|참조|의존|생성하|발행자|구독|call(?:er|ee| graph)|who calls|inherit|implement|references?|depends?"
CALLERS = r"(?iu)호출자|누가\s*호출|(?:무엇|뭐|누가|어디서).{0,40}(?:참조|의존)|에\s*(?:참조|의존)하는|callers?|who calls|what\s+references?|who\s+depends?\s+on"
INHERITS = r"(?iu)상속|inherits?|base\s+type|derived\s+type"
IMPLEMENTS = "(?iu)구현|implements?|interface"
PATH = r"(?i)(?:^|[\\/])[\w .@()\-]+\.[A-Za-z0-9]+(?:\z|\s)|\.(?:cs|asmdef|json|ya?ml|md|asset)(?![A-Za-z0-9_])"
ERROR = r"(?i)(?<![A-Za-z0-9_])(?:CS\d{4}|0x[0-9a-f]+|[A-Za-z_]\w*(?:Exception|Error))(?![A-Za-z0-9_])|오류|에러"
IDENTIFIER = r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:\([^()\r\n]{0,256}\))?\z"
SYMBOL = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:\([^()\r\n]{0,256}\))?|[A-Za-z_]\w*\([^()\r\n]{0,256}\)|[A-Z][A-Za-z0-9_]{2,}"
QUOTED_PATH = r"[\"'`]([^\"'`\r\n]*[\\/][^\"'`\r\n]*\.[A-Za-z0-9]+)[\"'`]"
BARE_PATH = r"(?:[A-Za-z]:[\\/])?(?:[^\\/\s\"'<>|?*]+[\\/])+[^\\/\s\"'<>|?*]+\.[A-Za-z0-9]+"
BARE_FILE = r"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_@()\-]+\.(?:asmdef|asmref|asset|cs|js|jsx|meta|prefab|ts|tsx|unity)(?![A-Za-z0-9_])"
NAME = "[A-Za-z_][A-Za-z0-9_.]*"
STOP_WORDS = ("call", "caller", "callers", "callee", "callees", "interface", "where", "which")


def graph_direction(query) -> Column:
    q = _col(query)
    return F.when(q.rlike(CALLERS), "callers").when(q.rlike(INHERITS), "inherits").when(q.rlike(IMPLEMENTS), "implements").otherwise("callees")


def graph_symbol(query) -> Column:
    """The symbol or path that a query asks about: a quoted path, a path, a file, else the first name that isn't a stop word; null if none."""
    q = _col(query)
    found = lambda pattern, group: F.nullif(F.trim(F.regexp_extract(q, pattern, group)), F.lit(""))
    names = F.filter(F.regexp_extract_all(q, F.lit(SYMBOL), 0), lambda x: x.contains(".") | x.contains("(") | ~F.lower(x).isin(*STOP_WORDS))
    return F.coalesce(found(QUOTED_PATH, 1), found(BARE_PATH, 0), found(BARE_FILE, 0), F.get(names, F.lit(0)))


def route(query, scope="all") -> Column:
    """struct<route, symbol, direction>; ``scope`` is all, code or documents. A null query is answered by meaning."""
    q = F.coalesce(trimmed(query), F.lit(""))
    symbol = graph_symbol(q)
    graph = (F.lit(scope) != "documents") & q.rlike(STRUCTURAL) & symbol.isNotNull()
    exact = q.rlike(PATH) | q.rlike(ERROR) | q.rlike(IDENTIFIER)
    return F.struct(
        F.when(graph, "graph").when(exact, "exact").otherwise("semantic").alias("route"),
        F.when(graph, symbol).alias("symbol"), F.when(graph, graph_direction(q)).alias("direction"),
    )


def identifiers(query, most: int = 8) -> Column:
    """The ASCII names of two letters or more in a query that has other than ASCII: each once, as first spelled, the first ``most``, 512 characters; null without any."""
    q = _col(query)
    terms = F.filter(F.regexp_extract_all(q, F.lit(NAME), 0), lambda x: F.length(x) >= 2)
    new = lambda held, x: F.when((F.size(held) >= most) | F.exists(held, lambda y: F.lower(y) == F.lower(x)), held).otherwise(F.concat(held, F.array(x)))
    first = F.aggregate(terms, F.array().cast("array<string>"), new)
    value = F.substring(F.array_join(first, " "), 1, 512)
    return F.when(q.rlike(r"[^\x00-\x7F]"), F.nullif(value, F.lit("")))
