"""What candidate code and service answers must not contain."""

from __future__ import annotations

import ast
import re
import textwrap

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import any_of, in_order

#: Import roots that candidates may use (fixed values).
ALLOWED_IMPORTS = frozenset({"math", "heapq", "random", "itertools", "collections", "networkx", "numpy"})
#: Substrings that candidates must not have, in order of report (fixed values).
FORBIDDEN = (
    "__import__", "open(", "exec(", "eval(", "compile(", "input(", "globals(", "locals(", "subprocess", "socket", "requests", "urllib", "shutil", "pathlib", "pickle", "marshal", "ctypes", "multiprocessing", "threading", "os.", "sys.", "write(",
    "rmdir(", "unlink(",
)
#: What a service says when it has no capacity, in order of report (fixed values).
CAPACITY = (
    "模型已满", "换个模型", "模型繁忙", "模型忙", "model full", "at capacity", "model capacity", "capacity", "overloaded", "currently overloaded", "temporarily unavailable", "no available model", "model_not_available", "insufficient_quota", "rate limit",
    "429", "503", "504",
)
#: How an answer is reported that asks for another model, or speaks of one that is full (fixed values).
ASKS_FOR_ANOTHER, SPEAKS_OF_FULL = "模型/换模型相关中文提示", "model/full/capacity related prompt"


def first_needle(text: Column, needles: tuple[str, ...]) -> Column:
    """The first needle, in their order, that the text holds in any case; null without one."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(n.lower()), F.lit(n)) for n in needles])


def forbidden_token(code: Column) -> Column:
    return first_needle(code, FORBIDDEN)


def capacity_issue(text: Column) -> Column:
    """Why an answer looks like a service without capacity; '' if it doesn't."""
    low = F.lower(text)
    asks = (text.contains("模型") & text.contains("满")) | (text.contains("请") & text.contains("换") & text.contains("模型"))
    pairs = in_order(low, "model", "full") | in_order(low, "full", "model")
    return F.coalesce(first_needle(text, CAPACITY), F.when(asks, F.lit(ASKS_FOR_ANOTHER)), F.when(pairs, F.lit(SPEAKS_OF_FULL)), F.lit(""))


def checked_code(code: str, function: str) -> str:
    """The dedented code; raises ValueError if it lacks the function, holds a forbidden token or imports what isn't allowed.

    Nothing is run.
    """
    code = textwrap.dedent(code).strip()
    if not re.search(rf"def {re.escape(function)}", code):
        raise ValueError(f"missing {function} function")
    low = code.lower()
    if found := next((t for t in FORBIDDEN if t.lower() in low), None):
        raise ValueError(f"forbidden token: {found}")
    for node in ast.walk(ast.parse(code)):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        for name in names:
            if name.partition(".")[0] not in ALLOWED_IMPORTS:
                raise ValueError(f"import not allowed: {name}")
    return code


__all__ = ["ALLOWED_IMPORTS", "CAPACITY", "FORBIDDEN", "any_of", "capacity_issue", "checked_code", "first_needle", "forbidden_token"]
