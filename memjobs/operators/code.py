"""Source files to symbols, call edges and the reach of a change."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjobs.operators.walks import walk

# Line patterns by language, in order of use; the first that fits names the line's symbol.
PATTERNS = {
    "py": [("class", r"^class\s+(\w+)"), ("function", r"^def\s+(\w+)"), ("method", r"^\s+def\s+(\w+)")],
    "js": [
        ("class", r"^class\s+(\w+)"), ("function", r"^function\s+(\w+)"), ("function", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function"),
        ("arrow_function", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\("), ("method", r"^\s+(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{"),
    ],
    "ts": [
        ("class", r"^class\s+(\w+)"), ("interface", r"^interface\s+(\w+)"), ("function", r"^function\s+(\w+)"), ("function", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function"),
        ("arrow_function", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\("), ("method", r"^\s+(?:async\s+)?(\w+)\s*\([^)]*\)\s*[:\{]"),
    ],
    "rs": [("struct", r"^struct\s+(\w+)"), ("enum", r"^enum\s+(\w+)"), ("trait", r"^trait\s+(\w+)"), ("function", r"^fn\s+(\w+)"), ("impl", r"^impl\s+(?:\w+\s+for\s+)?(\w+)"), ("method", r"^\s+fn\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s+)?(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")],
    "java": [
        ("class", r"^(?:public\s+|private\s+|protected\s+)?class\s+(\w+)"), ("interface", r"^(?:public\s+|private\s+|protected\s+)?interface\s+(\w+)"),
        ("method", r"^(?:public\s+|private\s+|protected\s+)?(?:static\s+)?\w+\s+(\w+)\s*\("),
    ],
    "c": [("function", r"^\w+\s+\*?\s*(\w+)\s*\([^)]*\)\s*\{"), ("struct", r"^typedef\s+struct\s+\{?[^}]*\}?\s*(\w+)")],
    "cpp": [("class", r"^class\s+(\w+)"), ("function", r"^\w+\s+\*?\s*(\w+)\s*\([^)]*\)\s*\{"), ("method", r"^\s+\w+\s+\*?\s*(\w+)\s*\([^)]*\)\s*\{")],
}
ENDINGS = {"h": "c", "hpp": "cpp"}
WINDOW = 5  # lines after a symbol's own that are searched for calls


def language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    for own, lang in ENDINGS.items():
        ending = F.when(ending == own, lang).otherwise(ending)
    return ending


def index_code_regex(files: DataFrame) -> DataFrame:
    """files (file_path, content) -> name, symbol_type, file_path, line_start, line_end, calls.

    Calls are the names before ``(`` in the symbol's line and the five after
    it, without its own name and names that begin with ``_``.  A file's lines lie
    in one array, so a line finds those after it without a shuffle; the language is
    a column below the explode, so that no line works it out again.
    """
    whole = files.select("file_path", language(F.col("file_path")).alias("lang"), F.split("content", "\n").alias("all"))
    each = F.transform("all", lambda line, i: F.struct(i.alias("at"), line.alias("line"), F.slice("all", i + 1, WINDOW + 1).alias("near")))
    lines = whole.where(F.col("lang").isin(*PATTERNS)).select("file_path", "lang", F.inline_outer(each))

    fits, kinds = F.lit(False), F.lit(None).cast("struct<symbol_type:string,name:string>")
    for lang, patterns in PATTERNS.items():
        fits = F.when(F.col("lang") == lang, F.col("line").rlike("|".join(p for _, p in patterns))).otherwise(fits)

    def symbol(line: Column) -> Column:
        found = kinds
        for lang, patterns in PATTERNS.items():
            own = kinds
            for kind, p in reversed(patterns):
                own = F.when(line.rlike(p), F.struct(F.lit(kind).alias("symbol_type"), F.regexp_extract(line, p, 1).alias("name"))).otherwise(own)
            found = F.when(F.col("lang") == lang, own).otherwise(found)
        return found

    found = F.get(F.transform(F.array("line"), symbol), F.lit(0))  # so many patterns outgrow one generated method
    called = F.flatten(F.transform("near", lambda x: F.regexp_extract_all(x, F.lit(r"\b(\w+)\s*\("), F.lit(1))))
    rows = lines.where(fits).select("file_path", "at", found.alias("s"), F.array_distinct(called).alias("near"))
    own = F.filter("near", lambda c: (c != F.col("s.name")) & ~c.startswith("_"))
    line = F.col("at") + 1
    return rows.select("s.name", "s.symbol_type", "file_path", line.alias("line_start"), line.alias("line_end"), own.alias("calls"))


PYTHON = "name string, symbol_type string, file_path string, line_start int, line_end int, signature string, docstring string, parent string, decorators array<string>, calls array<string>"


def _last_name(node: ast.expr) -> str | None:
    """``f`` of f, a.f, a.b().f and of a call of these."""
    while isinstance(node, ast.Call):
        node = node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def _facts(node: ast.AST, owner: str | None) -> list[dict]:
    """What a statement defines, as rows; an import defines a row for each name."""
    if isinstance(node, ast.Import | ast.ImportFrom):
        source = getattr(node, "module", None)
        return [{"name": f"{source}.{a.name}" if source else a.name, "symbol_type": "import"} for a in node.names]
    if not isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
        return []
    calls = sorted((c for c in ast.walk(node) if isinstance(c, ast.Call)), key=lambda c: (c.lineno, c.col_offset))
    row = {
        "docstring": (ast.get_docstring(node) or "")[:500] or None, "decorators": [ast.unparse(d) for d in node.decorator_list],
        "calls": list(dict.fromkeys(filter(None, map(_last_name, calls)))),
    }
    if isinstance(node, ast.ClassDef):
        return [row | {"name": node.name, "symbol_type": "class"}]
    head = f"def {node.name}({ast.unparse(node.args)})"
    return [row | {"name": f"{owner}.{node.name}", "symbol_type": "method", "parent": owner, "signature": head} if owner else row | {"name": node.name, "symbol_type": "function", "signature": head}]


def _symbols(tree: ast.Module, path: str) -> Iterator[dict]:
    """Rows in source order: a stack of statements with the class they stand in."""
    todo: list[tuple[ast.AST, str | None]] = [(n, None) for n in reversed(tree.body)]
    while todo:
        node, owner = todo.pop()
        lines = {"file_path": path, "line_start": getattr(node, "lineno", 1), "line_end": getattr(node, "end_lineno", 1), "decorators": [], "calls": []}
        yield from (lines | row for row in _facts(node, owner))
        inside = node.name if isinstance(node, ast.ClassDef) else owner
        todo += [(n, inside) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, ast.stmt | ast.excepthandler | ast.match_case)]


_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in PYTHON.split(", "))])
MOST_ROWS = 1000  # symbols that a task holds before it passes them on, besides one file's


def symbol_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of files (file_path, content) to batches of up to ``MOST_ROWS`` symbols; one file's text is taken at a time."""
    rows: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            path, content = (batch.column(c)[at].as_py() for c in (0, 1))
            try:
                rows += _symbols(ast.parse(content or ""), path)
            except (SyntaxError, ValueError, RecursionError):
                continue
            while len(rows) >= MOST_ROWS:
                yield pa.RecordBatch.from_pylist(rows[:MOST_ROWS], schema=SCHEMA)
                rows = rows[MOST_ROWS:]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def index_code_python(files: DataFrame) -> DataFrame:
    """Symbols of Python files by their syntax tree; files that don't parse give none."""
    return files.select("file_path", "content").mapInArrow(symbol_batches, PYTHON)


def search_symbols(symbols: DataFrame, needles: list[str]) -> DataFrame:
    """Symbols whose name contains a needle, with ``needle``: a stated list, held against each row in one pass."""
    found = F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(F.col("name"), n))
    return symbols.withColumn("needle", F.explode(found))


def call_edges(symbols: DataFrame, root: Column | None = None) -> DataFrame:
    """Distinct (file_path, caller, callee_path, callee): explode calls, equi-join on the bare name.

    Files of one ``root`` (an expression over file_path; all files without it)
    call each other, so a name finds its definitions in other files too.  Both
    sides are distinct, and an edge tells its root and bare name, so none comes twice.
    """
    within = F.lit("") if root is None else root
    bare = F.element_at(F.split("name", r"\."), -1)
    callers = symbols.select(within.alias("root"), "file_path", F.col("name").alias("caller"), F.explode(F.array_distinct("calls")).alias("bare")).distinct()
    callees = symbols.where("symbol_type <> 'import'").select(within.alias("root"), F.col("file_path").alias("callee_path"), bare.alias("bare"), F.col("name").alias("callee")).distinct()
    return callers.join(callees, ["root", "bare"]).where("caller <> callee or file_path <> callee_path").select("file_path", "caller", "callee_path", "callee")


def callers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """names (callee): what calls them, in any file."""
    return edges.join(names.select("callee").distinct(), "callee", "left_semi").select("callee", "file_path", "caller").distinct()


def callees(edges: DataFrame, names: DataFrame) -> DataFrame:
    """names (caller): what they call, in any file."""
    return edges.join(names.select("caller").distinct(), "caller", "left_semi").select("caller", "callee_path", "callee").distinct()


LINE_BIN = 64


def affected_symbols(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_path, name) of symbols whose lines hold a changed line.

    Spans and lines meet by file and bin of ``LINE_BIN`` lines: a span lies in each
    bin that it touches, a line in one, so a file of any number of symbols and
    changes costs what its bins hold.
    """
    bin_of = lambda c: F.floor(F.col(c) / LINE_BIN)
    lines = changes.select("file_path", "line").where("line is not null").distinct().withColumn("bin", bin_of("line"))
    spans = symbols.where("symbol_type <> 'import' and line_start <= line_end").select("file_path", "name", "line_start", "line_end", F.explode(F.sequence(bin_of("line_start"), bin_of("line_end"))).alias("bin"))
    return spans.join(lines, ["file_path", "bin"]).where("line between line_start and line_end").select("file_path", "name").distinct()


def transitive_affected(seeds: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """(file_path, name) reached over callers and callees, across files, in rounds 0..max_hops-1."""
    caller, callee = F.struct("file_path", F.col("caller").alias("name")), F.struct(F.col("callee_path").alias("file_path"), F.col("callee").alias("name"))
    ways = F.array(F.struct(caller.alias("node"), callee.alias("next")), F.struct(callee.alias("node"), caller.alias("next")))
    both = edges.select(F.inline(ways))  # both ways of an edge from one reading of it
    reached = walk(seeds.select(F.lit(0).alias("group"), F.struct("file_path", "name").alias("node"), F.lit(max_hops).alias("hops")), both, max_hops)
    return reached.select("node.file_path", "node.name")


def dependency_chain(edges: DataFrame) -> DataFrame:
    """file_path, name, upstream callers and downstream callees by name, sorted."""
    none = F.lit(None).cast("string")
    of_callee = F.struct(F.col("callee_path").alias("file_path"), F.col("callee").alias("name"), F.col("caller").alias("up"), none.alias("down"))
    of_caller = F.struct(F.col("file_path"), F.col("caller").alias("name"), none.alias("up"), F.col("callee").alias("down"))
    ends = edges.select(F.inline(F.array(of_callee, of_caller)))  # both ends of an edge from one reading of it
    found = ends.groupBy("file_path", "name").agg(F.array_sort(F.collect_set("up")).alias("upstream"), F.array_sort(F.collect_set("down")).alias("downstream"))
    return found.select("file_path", "name", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("upstream", "downstream")])


def symbols_to_memories(symbols: DataFrame) -> DataFrame:
    text = F.concat("symbol_type", F.lit(" "), "name", F.lit(" in "), "file_path", F.lit(":"), F.col("line_start").cast("string"))
    return symbols.select(F.lit("code_change").alias("memory_type"), text.alias("raw_text"), F.array("file_path").alias("file_references"), F.lit(0.6).alias("importance_score"), F.lit(0.9).alias("confidence_score"))
