"""Source file measures: lines of code by ending, functions, classes, and branch counts of Python sources."""

from __future__ import annotations

import ast
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings whose comment lines begin with '#' and with '//' (fixed values).
HASH_COMMENTS = ("py", "yaml", "yml", "toml", "sh")
SLASH_COMMENTS = ("js", "jsx", "ts", "tsx", "go", "rs", "c", "cpp", "java")
#: What counts as a function and as a class, by ending (fixed values).
_SCRIPTS = ("js", "jsx", "ts", "tsx")
FUNCTIONS = {
    ("py",): r"^\s*(?:async\s+)?def\s+\w+\s*\(",
    _SCRIPTS: r"(?:^\s*function\s+\w+\s*\()|(?:^\s*(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*=>))|(?:^\s*\w+\s*\([^)]*\)\s*\{)",
    ("go",): r"^func\s+(?:\([^)]*\)\s+)?\w+\s*\(",
    ("rs",): r"^\s*(?:pub\s+)?fn\s+\w+",
}
CLASSES = {("py",): r"^\s*class\s+\w+", _SCRIPTS: r"^\s*(?:export\s+)?class\s+\w+", ("go",): r"^type\s+\w+\s+struct", ("rs",): r"^\s*(?:pub\s+)?struct\s+\w+"}
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
CYCLOMATIC = T.StructType([T.StructField("max", T.IntegerType()), T.StructField("mean", T.DoubleType()), T.StructField("sum", T.IntegerType()), T.StructField("n", T.IntegerType())])
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)


def _branches(node: ast.AST) -> int:
    total, stack = 1, list(ast.iter_child_nodes(node))
    while stack:
        n = stack.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        total += len(n.values) - 1 if isinstance(n, ast.BoolOp) else int(isinstance(n, _BRANCHES)) + (len(n.ifs) if isinstance(n, ast.comprehension) else 0)
        stack += ast.iter_child_nodes(n)
    return total


@F.pandas_udf(CYCLOMATIC)
def cyclomatic(sources: pd.Series) -> pd.DataFrame:
    """Branch counts over the functions of Python sources; zeros without functions, nulls for what doesn't parse."""
    rows = []
    for s in sources:
        try:
            tree = ast.parse(s) if s is not None else None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree = None
        if tree is None:
            rows.append((None, None, None, None))
            continue
        c = [_branches(n) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        rows.append((max(c, default=0), sum(c) / len(c) if c else 0.0, sum(c), len(c)))
    return pd.DataFrame(rows, columns=["max", "mean", "sum", "n"])


HALSTEAD = T.StructType([T.StructField("operators", T.IntegerType()), T.StructField("operands", T.IntegerType()), T.StructField("distinct_operators", T.IntegerType()), T.StructField("distinct_operands", T.IntegerType()), T.StructField("volume", T.DoubleType())])


def _operations(node: ast.AST) -> tuple[list[str], list[ast.AST]] | None:
    """The operators an expression applies and what to."""
    if isinstance(node, ast.BinOp):
        return [type(node.op).__name__], [node.left, node.right]
    if isinstance(node, ast.UnaryOp):
        return [type(node.op).__name__], [node.operand]
    if isinstance(node, ast.BoolOp):
        return [type(node.op).__name__], node.values
    if isinstance(node, ast.AugAssign):
        return [type(node.op).__name__], [node.target, node.value]
    if isinstance(node, ast.Compare):
        return [type(o).__name__ for o in node.ops], [node.left, *node.comparators]
    return None


def _operand(node: ast.AST) -> object:
    return node.value if isinstance(node, ast.Constant) else node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ast.dump(node)


def halstead_of(source: str | None) -> tuple[int, int, int, int, float] | None:
    """Counts of operators and operands, all and distinct (operands apart by function), and the volume N log2(n); None for what doesn't parse."""
    try:
        tree = ast.parse(source) if source is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    if tree is None:
        return None
    n_operators = n_operands = 0
    operators: set[str] = set()
    operands: set[tuple] = set()
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, inside = stack.pop()
        found = _operations(node)
        if found:
            names, values = found
            n_operators, n_operands = n_operators + len(names), n_operands + len(values)
            operators.update(names)
            operands.update((inside, type(v := _operand(x)).__name__, v) for x in values)
        below = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else inside
        stack += ((x, below) for x in ast.iter_child_nodes(node))
    size, words = n_operators + n_operands, len(operators) + len(operands)
    return n_operators, n_operands, len(operators), len(operands), size * math.log2(words) if words else 0.0


@F.pandas_udf(HALSTEAD)
def halstead(sources: pd.Series) -> pd.DataFrame:
    """``halstead_of`` each source; nulls for what doesn't parse."""
    return pd.DataFrame([halstead_of(s) or (None,) * 5 for s in sources], columns=HALSTEAD.names)


def _by_ending(ext: Column, table: dict[tuple, str]) -> Column:
    out = None
    for endings, pattern in table.items():
        hit = ext.isin(*endings)
        value = F.lit("(?Um)(?d)" + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def measures(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Add loc, code_lines (not blank, no comment), n_chars, n_functions, n_classes by the file's ending.

    A last line without a line end counts, nothing after the last line end does; a null content has nulls and no functions.
    """
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1))
    lines = F.split(F.col(content), LINE_END)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    sign = F.when(ext.isin(*HASH_COMMENTS), F.lit("#")).when(ext.isin(*SLASH_COMMENTS), F.lit("//"))
    blank = r"(?U)[\s\x{1C}-\x{1F}]+"
    bare = lambda x: F.regexp_replace(x, f"^{blank}", "")
    code = F.filter(lines, lambda x: (bare(x) != "") & ~F.coalesce(bare(x).startswith(sign), F.lit(False)))
    n = lambda table: F.coalesce(F.regexp_count(F.col(content), _by_ending(ext, table)), F.lit(0))
    size = lambda x: F.when(F.col(content).isNotNull(), F.size(x))
    return files.select("*", size(lines).alias("loc"), size(code).alias("code_lines"), F.length(content).alias("n_chars"), n(FUNCTIONS).alias("n_functions"), n(CLASSES).alias("n_classes"))


def canonical_path(raw: Column, cwd: Column) -> Column:
    """Absolute path with '.' and '..' resolved by text (links on disk can't be followed); relative without cwd stays as it is."""
    full = F.when(raw.startswith("/"), raw).when(cwd.isNotNull(), F.concat_ws("/", cwd, raw))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(full.isNull(), raw).otherwise(F.concat(F.lit("/"), F.array_join(walked, "/")))
