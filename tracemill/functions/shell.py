"""File paths named by shell commands, and tool arguments written as literals or markup."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import dropwhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Command:
    """What a command's words mean: ``valued`` options take the next word; ``pattern`` are those that bring a pattern, which else is the
    first operand (None: the command has no pattern); with one of ``mute`` it names no file. Of the operands, ``most`` at most, those
    that ``path`` matches are paths."""

    valued: frozenset[str] = frozenset()
    pattern: frozenset[str] | None = None
    mute: frozenset[str] = frozenset()
    most: int | None = None
    path: re.Pattern = re.compile(r"(?s).+")


def _options(*names: str) -> frozenset[str]:
    return frozenset(names)


_COUNTS = _options("-n", "-c", "--lines", "--bytes")
_NO_NUMBER = re.compile(r"(?s)(?!\d+\Z).+")
_SEARCH = _options("-e", "--regexp", "-f", "--file")
_AROUND = _options("-m", "-A", "-B", "-C")
_SCRIPT = _options("-e", "--expression", "-f", "--file")
_RUN = Command(_options("-W", "-X"), mute=_options("-m", "-c"), most=1, path=re.compile(r"(?s).*\.py\Z"))
#: The commands whose words are read (names and options are fixed values).
COMMANDS = {
    "cat": Command(path=_NO_NUMBER), "less": Command(path=_NO_NUMBER), "head": Command(_COUNTS, path=_NO_NUMBER), "tail": Command(_COUNTS, path=_NO_NUMBER),
    "sed": Command(_SCRIPT, pattern=_SCRIPT), "awk": Command(_options("-f", "-v", "-F"), pattern=_options("-f")),
    "grep": Command(_SEARCH | _AROUND | _options("--include", "--exclude", "--exclude-dir"), pattern=_SEARCH), "rg": Command(_SEARCH | _AROUND | _options("-g", "--glob", "-t", "--type"), pattern=_SEARCH),
    "python": _RUN, "python3": _RUN,
}

#: A redirection, what ends a simple command, or a word: quoted parts and bare characters; a quote without its partner is a character like others.
_LEXEME = re.compile(r"""(?P<into>\d*>>?&?|<+)|(?P<end>[|&;\n]+)|(?P<word>(?:'[^']*'|"(?:\\.|[^"\\])*"|\\.|[^\s|&;<>])+)""", re.S)
_PART = re.compile(r"""'([^']*)'|"((?:\\.|[^"\\])*)"|\\(.)|([^'"\\]+|.)""", re.S)
_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*=")


def _unquoted(word: str) -> str:
    return "".join(plain or re.sub(r'\\(["\\$`])', r"\1", soft) or hard or escaped for hard, soft, escaped, plain in _PART.findall(word))


def simple_commands(line: str) -> Iterator[tuple[list[str], list[str]]]:
    """(words, files written by redirection) of every simple command of a line."""
    words: list[str] = []
    written: list[str] = []
    target = None
    for m in _LEXEME.finditer(line):
        if m["end"]:
            yield words, written
            words, written, target = [], [], None
        elif m["into"]:
            target = m["into"]
        elif target is None:
            words.append(_unquoted(m["word"]))
        else:
            written += [_unquoted(m["word"])] if target in (">", ">>") else []
            target = None
    yield words, written


def operands(words: list[str], valued: frozenset[str]) -> tuple[set[str], list[str]]:
    """Options and operands of the words after a command's name; after '--' all are operands."""
    options: set[str] = set()
    end = words.index("--") if "--" in words else len(words)
    rest, value = [], False
    for w in words[:end]:
        if value:
            value = False
        elif w.startswith("-"):
            options.add(w)
            value = w in valued
        else:
            rest.append(w)
    return options, rest + words[end + 1 :]


def named_files(words: list[str]) -> list[str]:
    """The paths among the words of one simple command, by the table; assignments before the name are passed over."""
    bare = list(dropwhile(_ASSIGNMENT.match, words))
    command = COMMANDS.get(bare[0].rpartition("/")[2]) if bare else None
    if command is None:
        return []
    options, rest = operands(bare[1:], command.valued)
    if options & command.mute:
        return []
    if command.pattern is not None and not options & command.pattern:
        rest = rest[1:]
    return [w for w in rest[: command.most] if command.path.match(w)]


def paths_of(command: str | None) -> list[str]:
    """Paths read, searched, run or written by a command line, in order, each once; null and blank lines name none."""
    found = (w for words, written in simple_commands(command or "") for w in (*named_files(words), *written))
    return list(dict.fromkeys(w for w in found if w not in ("", ".") and not w.startswith("-")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_paths(commands: pd.Series) -> pd.Series:
    return commands.map(paths_of, na_action=None)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def literal_arguments(texts: pd.Series) -> pd.Series:
    """Arguments written as a Python literal dict; never read as JSON; null if it is anything else."""

    def one(text: str | None) -> dict | None:
        try:
            value = ast.literal_eval(text) if text else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None
        return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in value.items()} if isinstance(value, dict) else None

    return texts.map(one, na_action=None)


def function_calls(text: Column) -> Column:
    """Names of ``<function=name>...</function>`` calls; an opener without its closer is none."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<function=([^>]+)>(?:(?!<function=).)*?</function>"), F.lit(1))


def thought_span(text: Column) -> Column:
    """Text after the first 'THOUGHT:' up to the first bash fence, null without the label."""
    start, end = F.locate("THOUGHT:", text), F.locate("```bash", text)
    size = F.when(end > 0, F.greatest(end - start - 8, F.lit(0))).otherwise(F.length(text))
    return F.when(start > 0, F.substr(text, start + 8, size))


def think_span(text: Column) -> Column:
    """Text from the first <think> to the last </think> after it, else to the end; null without an opener."""
    start = F.locate("<think>", text)
    body = F.substr(text, start + 7, F.length(text))
    last = F.length(body) - F.locate(">kniht/<", F.reverse(body)) - 6
    return F.when(start > 0, F.when(body.contains("</think>"), F.substr(body, F.lit(1), last - 1)).otherwise(body))


#: Tools whose ``path`` argument is a file, and those whose ``command`` is a command line (fixed values).
EDITORS = ("str_replace_editor", "str_replace_based_edit_tool", "Str Replace Editor")
SHELLS = ("bash", "execute_bash", "Run Command Line Tool")


def argument_paths(tool: str | None, arguments: dict | None, editors: tuple[str, ...] = EDITORS, shells: tuple[str, ...] = SHELLS) -> list[str]:
    """Files that a tool's arguments name: an editor's path, those of a shell's command; other tools and other types name none."""
    value = (arguments or {}).get("path" if tool in editors else "command") if tool in editors or tool in shells else None
    if not isinstance(value, str) or not value:
        return []
    return [value] if tool in editors else paths_of(value)


def action_of(text: str | None, editor: str = EDITORS[0]) -> tuple[str, list[str]]:
    """(tool, files) of an action written as text: the editor's name, its command and a path, or else a command line."""
    words = [w for w, _ in simple_commands((text or "").strip()) if w and w[0] != "cd"]
    if words and words[0][0] == editor:
        path = words[0][2] if len(words[0]) > 2 and not words[0][2].startswith("-") else ""
        return editor, [path] if path not in ("", ".") else []
    return SHELLS[0], paths_of(text)


_ACTION = T.StructType([T.StructField("tool", T.StringType()), T.StructField("paths", T.ArrayType(T.StringType()))])


@F.pandas_udf(_ACTION)
def actions(texts: pd.Series) -> pd.DataFrame:
    """``action_of`` each text."""
    return pd.DataFrame([action_of(t) for t in texts], columns=["tool", "paths"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def paths_of_arguments(tools: pd.Series, arguments: pd.Series) -> pd.Series:
    """``argument_paths`` of arguments written as JSON objects; what is no object has none."""

    def one(tool: str | None, text: str | None) -> list[str]:
        try:
            value = json.loads(text) if text else None
        except (ValueError, RecursionError):
            value = None
        return argument_paths(tool, value if isinstance(value, dict) else None)

    return pd.Series([one(t, a) for t, a in zip(tools, arguments, strict=True)], dtype=object)
