"""Text, identifier and path functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a query that carry no meaning for file names and symbols.
STOP_WORDS = frozenset(
    """the and for from with that this what when where how all not but has have get set new use can will
    should into each only does file files code function method class type return error value data name path
    index query result results search find create update delete remove add list check test run build""".split()
)
# Patterns of test and source paths.
TEST_PATH = r"(?i)(^|[/\\])tests?[/\\]|(^|[/\\])__tests__[/\\]|(^|[/\\])spec[/\\]|\.(test|spec)\.[^/\\]+$|(^|[/\\])test_"
SOURCE_PATH = r"(?i)(^|[/\\])(src|lib|app|pkg|packages|internal|cmd)[/\\]"
DOC_PATH = r"(?i)\.(md|mdx)$"
# Files full of vocabulary and without implementation.
BOILERPLATE = ("types.go", "doc.go", "types.ts", "types.d.ts", "index.d.ts", "constants.go", "defaults.go", "conversion.go")
IDENTIFIER = r"\b[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?\b"
#: Accented Latin letters and what they fold to, for the word tokenizer.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
MAX_IDENTIFIER = 80


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_identifier(c: Column | str) -> Column:
    """Lower-case word parts of two characters or more, cut at case changes and non-alphanumerics."""
    humps = F.regexp_replace(col(c), r"([a-z0-9])([A-Z])", "$1 $2")
    runs = F.regexp_replace(humps, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(runs, r"[^A-Za-z0-9]+"), lambda p: F.length(p) >= 2), F.lower)


def identifier_parts(c: Column | str) -> Column:
    """Distinct parts (array, in order of appearance) of identifiers with two parts or more; identifiers of more
    than 80 characters are passed over."""
    tokens = F.regexp_extract_all(col(c), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"), 0)
    split = F.transform(F.filter(tokens, lambda t: F.length(t) <= MAX_IDENTIFIER), split_identifier)
    return F.array_distinct(F.flatten(F.filter(split, lambda p: F.size(p) > 1)))


def word_tokens(c: Column | str) -> Column:
    """Tokens of the keyword index: runs of letters and digits, lower-cased, accents folded."""
    folded = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), 0)


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def dirname(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"/?[^/]*$", "")


def stem(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", ""))


def normalize_path(c: Column | str) -> Column:
    return F.translate(col(c), "\\", "/")


def project_relative(c: Column | str, root: str) -> Column:
    """Relative to ``root`` if inside it, without a leading ./"""
    p = normalize_path(c)
    root = root.rstrip("/") + "/"
    return F.regexp_replace(F.when(p.startswith(root), F.substring(p, F.lit(len(root) + 1), F.length(p))).otherwise(p), r"^(\./)+", "")


def is_test(c: Column | str) -> Column:
    return col(c).rlike(TEST_PATH)


def is_source(c: Column | str) -> Column:
    return col(c).rlike(SOURCE_PATH)


def is_doc(c: Column | str) -> Column:
    return col(c).rlike(DOC_PATH)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression of a glob: ** crosses separators, * and ? don't."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] in "*?":
            out, k = out + ("[^/]*" if pattern[k] == "*" else "[^/]"), k + 1
        else:
            out, k = out + re.escape(pattern[k]), k + 1
    return f"^{out}$"


def _include(p: str) -> str:
    esc = re.escape
    p = p.replace("\\", "/")
    if m := re.fullmatch(r"\*\*/\*(\.\w+)", p):
        return rf"^(?:.*/)?[^/]+{esc(m[1])}$" if m[1].count(".") == 1 else glob_regex(p)
    if m := re.fullmatch(r"(.+)/\*\*/\*(\.\w+)", p):
        return rf"^{esc(m[1].rstrip('/'))}/(?:.*/)?[^/]+{esc(m[2])}$"
    if m := re.fullmatch(r"\*\*/([^*?/]+)", p):
        return rf"^(?:.*/)?{esc(m[1])}$"
    if m := re.fullmatch(r"\*\*/([A-Za-z]\w*)\.\*", p):
        return rf"^(?:.*/)?{esc(m[1])}\.[^/]*$"
    if m := re.fullmatch(r"([^*?]+?)/?\*\*", p):
        return rf"^{esc(m[1].rstrip('/'))}/.*$"
    return glob_regex(p)


def _exclude(p: str) -> str:
    esc = re.escape
    if m := re.fullmatch(r"\*\*/([^*?/]+)/\*\*", p):
        return rf"(?:^|/){esc(m[1])}/|^{esc(m[1])}$"
    if m := re.fullmatch(r"([^*?]+?)/?\*\*", p):
        return rf"^{esc(m[1])}(?:/.*)?$"
    if not re.search(r"[*?/]", p):
        return rf"(?:^|/){esc(p)}$"
    if m := re.fullmatch(r"\*\*/([^*?/]+)", p):
        return rf"(?:^|/){esc(m[1])}$"
    if m := re.fullmatch(r"(?:\*\*/)?([^*?/]+)\.\*", p):
        return rf"(?:^|/){esc(m[1])}\.[^/]*$"
    if m := re.fullmatch(r"\*\*/\*([^*?/]+)", p):
        return rf"{esc(m[1])}$"
    if m := re.fullmatch(r"\*([^*?/]+)/\*\*", p):
        return rf"{esc(m[1])}(?:/|$)"
    if m := re.fullmatch(r"\*([^*?/]+)", p):
        return rf"{esc(m[1])}$"
    return glob_regex(p.replace("\\", "/"))


def included(c: Column | str, patterns: list[str]) -> Column:
    """Whether a path matches one of the include patterns: one regular expression for all."""
    return normalize_path(c).rlike("|".join(f"(?:{_include(p)})" for p in patterns)) if patterns else F.lit(False)


def excluded(c: Column | str, patterns: list[str]) -> Column:
    return col(c).rlike("|".join(f"(?:{_exclude(p)})" for p in patterns)) if patterns else F.lit(False)


def is_generated(c: Column | str, patterns: list[str]) -> Column:
    """Generated files: dir/** at any depth, **/*suffix and **/prefix* on the base name, else a substring of
    the base name in which * is anything."""
    tests = []
    for p in patterns:
        if m := re.fullmatch(r"([^*?]+?)/?\*\*", p):
            tests.append(col(c).startswith(m[1] + "/") | col(c).contains(f"/{m[1]}/"))
        elif m := re.fullmatch(r"\*\*/\*([^*?/]+)", p):
            tests.append(basename(c).endswith(m[1]))
        elif m := re.fullmatch(r"\*\*/([^*?/]+)\*", p):
            tests.append(basename(c).startswith(m[1]))
        else:
            tests.append(basename(c).rlike(re.escape(p).replace(r"\*", ".*")))
    return _any(tests)


def path_filter(c: Column | str, extensions=(), directories=(), exclude_directories=()) -> Column:
    """(one of the extensions) and (in one of the directories) and (in none of the excluded ones); an empty list
    sets no condition; the extensions' dot and the directories' last slash are optional."""
    out = F.lit(True)
    if extensions:
        out &= _any([col(c).endswith("." + e.lstrip(".")) for e in extensions])
    if directories:
        out &= _any([col(c).startswith(d.rstrip("/") + "/") for d in directories])
    for d in exclude_directories:
        out &= ~col(c).startswith(d.rstrip("/") + "/")
    return out


def suffix_path(c: Column | str, path: str) -> Column:
    """The path itself or one that ends with /path; the characters of LIKE stand for themselves."""
    return (col(c) == path) | col(c).endswith("/" + path)


def query_words(query: str) -> list[str]:
    return [w for w in re.split(r"[\s_/.-]+", query.lower()) if len(w) >= 3 and w not in STOP_WORDS]


def query_identifiers(query: str) -> list[str]:
    """Words of a query that look like identifiers: a capital, an underscore or a dot in them."""
    found = re.findall(IDENTIFIER, query)
    return [m for m in found if len(m) >= 3 and m.lower() not in STOP_WORDS and re.search(r"[A-Z_.]", m)]


def query_phrases(query: str) -> list[list[str]]:
    """Each white-space token of a query as a phrase of index terms; OR-ed by the search."""
    fold = str.maketrans(ACCENTED, PLAIN)
    phrases = [re.findall(r"[^\W_]+", t.lower().translate(fold)) for t in query.split()]
    return [p for p in phrases if p]


def like_literal(text: str) -> str:
    """``text`` in a LIKE pattern whose escape character is a backslash."""
    return re.sub(r"([%_\\])", r"\\\1", text)


def packed(c: Column | str) -> Column:
    """An array as JSON text, the form in which rows of other engines keep one."""
    return F.to_json(col(c))


def unpacked(c: Column | str, element: str = "string") -> Column:
    """The array of a JSON text; of what isn't one, an empty array."""
    return F.coalesce(F.from_json(col(c), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def preview(c: Column | str, length: int) -> Column:
    """The first characters of a text, with dots where it goes on."""
    t = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(t) > length, F.concat(F.btrim(F.substring(t, 1, length)), F.lit("..."))).otherwise(t)


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def entity_name(parent: Column, export: Column, syntax: Column) -> Column:
    """parent.symbol if there is a parent; the first exported name wins over the syntax tree's."""
    own = F.coalesce(export, syntax)
    return F.when(parent.isNotNull() & own.isNotNull(), F.concat_ws(".", parent, own)).otherwise(own)


def commit_embed_text(message: Column, files: Column, summary: Column | None = None) -> Column:
    tops = F.array_sort(F.array_distinct(F.transform(F.filter(files, lambda f: F.instr(f, "/") > 0), lambda f: F.split(f, "/")[0])))
    parts = [message, F.when(F.size(files) > 0, F.concat(F.lit("Files changed: "), F.array_join(files, ", "))), F.when(F.size(tops) > 0, F.concat(F.lit("Directories: "), F.array_join(tops, ", ")))]
    return F.concat_ws("\n", *parts, *([summary] if summary is not None else []))


def diff_summary(files: Column, limit: int = 20) -> Column:
    """At most ``limit`` files, and how many more there are."""
    more = F.size(files) - limit
    return F.concat_ws("\n", F.array_join(F.slice(files, 1, limit), "\n"), F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" more files"))))


def turn_text(user: Column, assistant: Column, tools: Column) -> Column:
    said = lambda who, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{who}: "), x))
    return F.concat_ws("\n\n", said("User", user), said("Assistant", assistant), F.when(F.size(tools) > 0, F.array_join(tools, "\n\n")))


def usage_line(snippet: Column, start_line: Column, ref_line: Column) -> Column:
    """The line of a chunk that a reference (0-based line of the file) stands on, else the first 120 characters."""
    k = ref_line + 1 - start_line + 1
    line = F.when(k > 0, F.try_element_at(F.split(snippet, "\n"), k.cast("int")))
    return F.coalesce(F.btrim(line), F.substring(snippet, 1, 120))


def match_line(snippet: Column, symbol: str, exact: bool) -> Column:
    """The first line that holds the symbol as a word (or the beginning of one)."""
    pattern = rf"(?i)\b{re.escape(symbol)}" + (r"\b" if exact else "")
    return F.try_element_at(F.filter(F.split(snippet, "\n"), lambda x: x.rlike(pattern)), F.lit(1))


def is_iso_date(c: Column | str) -> Column:
    return col(c).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?")


def line_span(text: Column, parts: Column) -> Column:
    """For each part, in order: its 1-based first and last line in ``text``, found from where the last one began; null
    for parts that aren't there. Line feeds are counted from one part to the next, so each character once."""
    feeds = lambda x: F.length(x) - F.length(F.translate(x, "\n", ""))
    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("line"), F.array().cast("array<struct<start_line:int,end_line:int>>").alias("out"))

    def step(a: Column, part: Column) -> Column:
        at = F.call_function("locate", part, text, a["at"])
        first = a["line"] + feeds(F.substring(text, a["at"], at - a["at"]))
        found = F.struct(F.when(at > 0, first).alias("start_line"), F.when(at > 0, first + feeds(part)).alias("end_line"))
        return F.struct(F.when(at > 0, at).otherwise(a["at"]).alias("at"), F.when(at > 0, first).otherwise(a["line"]).alias("line"), F.concat(a["out"], F.array(found)).alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])
